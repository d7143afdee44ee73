"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function). Each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All but the last keep the columns of ``documents``.

1. toxicity: documents that the sentence model scores 0.7 or more go.
2. line_dedup: later occurrences of repeated three-line windows go, and
   documents of which nothing is left.
3. near_duplicates: of each group linked by five-word shingles at 0.8, the
   document of the smallest id stays, and one of rows equal in id and text.
4. decontamination: documents with a benchmark passage of ten words go.
5. packing: what is left, as sequences of at most 2048 tokens.

Rows of one id with different texts are documents of their own, and columns of
other names are carried along. Null texts pass every filter and are packed as
an end token alone; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from lodestrata.llm.common import shared_dir, table
from lodestrata.session import tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model, 0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = [c for c in ("n_lines", "n_removed") if c in docs.columns]  # names that the operator takes for itself
    found = line_dedup.dedup_lines(docs.withColumnsRenamed({c: f"own_{c}_of_documents" for c in own}))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    text = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", text).drop("n_lines", "n_removed").withColumnsRenamed({f"own_{c}_of_documents": c for c in own}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64("doc_id", "text")  # ids may have several texts
    found = decontamination.contamination(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("row"))
    return docs.join(hit, row == hit["row"], "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tuned(stage: Stage) -> Stage:
    """``stage`` in a session tuned as the registered queries tune it: texts are long, so Arrow batches are bounded by bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune(spark), docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _tuned(drop_toxic)),
    ("line_dedup", _tuned(drop_repeated_lines)),
    ("near_duplicates", _tuned(drop_near_duplicates)),
    ("decontamination", _tuned(drop_contaminated)),
    ("packing", _tuned(pack_sequences)),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
