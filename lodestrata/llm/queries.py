"""The registered queries of the training-data operators.

Each applies its operator with production parameters to its whole table and
keeps the digest columns of the contract.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, packing, progressive_jpeg, token_files, toxicity
from .common import shared_dir, table
from .content_sort import exact_duplicates
from .decontamination import contamination
from .html_text import extract
from .jaccard_join import near_duplicates
from .line_dedup import dedup_lines
from .periodic_runs import periodic_runs
from .spelling import spelling_variants
from .token_counts import count_tokens


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = toxicity.remainder("doc_id", 10)
    scores = class_lm.score(table(spark, sf_dir, "documents"), remainder != 0)
    return scores.withColumns({"held_out": remainder == 0, "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    held_out = toxicity.remainder("doc_id", 3) == 1
    return toxicity.score(docs, model).withColumns({"held_out": held_out, "predicted": (F.col("score") >= 0.7).cast("int")})


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, first_rule=49408, shards=shards)
    rows = token_files.read(spark, path).join(token_files.starts(spark, path), ["shard", "block"])
    return rows.select("doc_id", (F.col("before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", counts["n_tokens"] > 1024)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("payload"))
    media = progressive_jpeg.store(texts, f"{shared_dir(spark)}/media-{uuid.uuid4().hex}")
    return progressive_jpeg.digests(media).withColumnRenamed("id", "doc_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of one document in ten (by its id) begin to repeat, and after how many words."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), tail=periodic_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.n")).alias("length"), F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.n") / F.col("longest.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), misspelt=31)


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_class_lm, op3_line_dedup, op4_decontamination, op5_toxicity, op6_token_files, op7_token_counts, op8_packing, op9_progressive_jpeg, op10_html_text, op11_periodic_runs, op12_spelling_variants, op13_content_sort)}


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), own AS (
  SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_replace(ls[i], '^[\t-\r ]+|[\t-\r ]+$', '', 'g') <> '') AS o FROM lines
), trimmed AS (
  SELECT *, list_transform(o, lambda i: regexp_replace(ls[i], '^[\t-\r ]+|[\t-\r ]+$', '', 'g')) AS t FROM own
), places AS (
  SELECT doc_id, t, unnest(range(0, greatest(len(t) - 3, 0) + 1)) AS p FROM trimmed WHERE len(t) > 0
), windows AS (
  SELECT doc_id, p, array_to_string(t[p + 1 : p + 3], chr(10)) AS w FROM places
), firsts AS (
  SELECT w, min({'d': doc_id, 'a': p}) AS f FROM windows GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE doc_id <> f.d OR p <> f.a
), covered AS (
  SELECT doc_id, list_distinct(flatten(list([p + 1, p + 2, p + 3]))) AS ks FROM later GROUP BY doc_id
), gone AS (
  SELECT own.doc_id, text, ls, len(o) AS n_lines, CASE WHEN ks IS NULL THEN NULL ELSE list_transform(list_filter(ks, lambda k: k <= len(o)), lambda k: o[k]) END AS g
  FROM own LEFT JOIN covered ON own.doc_id = covered.doc_id
)
SELECT doc_id,
  CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)), '') END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM gone
"""

OP4_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM item_words WHERE len(w) > 0
), runs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), ks AS (SELECT DISTINCT k FROM runs
), doc_runs AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, ks WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, d.k, i, item_id FROM doc_runs d JOIN runs r ON d.k = r.k AND d.run = r.run
), per_doc AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + k))))) AS n_hit, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items, count(DISTINCT item_id) AS n_items FROM hits GROUP BY doc_id
)
SELECT doc_words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN per_doc ON doc_words.doc_id = per_doc.doc_id
"""


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, sha256(x) AS text_sha256, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op13_content_sort": OP13_SQL}
