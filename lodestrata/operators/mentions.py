"""Names in texts: harvesting a lexicon, finding its terms, filling relations."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import lexicon_values as V

#: Characters of the terms that one automaton holds; a lexicon beyond that is dealt into shards.
SHARD = 1 << 20

_automata: dict[str, object] = {}  # a worker keeps the last one


def _automaton(name: str, terms: list[str]):
    """The automaton of ``terms`` (term as value), built once per worker."""
    if name not in _automata:
        from ahocorasick import Automaton

        _automata.clear()
        a = Automaton()
        for t in terms:
            a.add_word(t, t)
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def _matched(texts: DataFrame, terms: list[str], maximal: bool) -> DataFrame:
    """``doc_id, hits``: for each text that has some, the terms and where each begins first, by place, then term.

    A text passes the automaton once, whatever the number of terms. With
    ``maximal``, terms within another term found are left out: which terms a
    term holds is its own pass through the automaton, remembered per worker.
    """
    name, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(terms)
    kind = StructType([texts.schema["doc_id"], StructField("hits", ArrayType(StructType([StructField("at", LongType()), StructField("term", StringType())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(name, shared.value).iter if shared.value else lambda text: ()
        within: dict[str, frozenset[str]] = {}
        for b in batches:
            keep, hits = [], []
            for i, text in enumerate(b.column(1)):
                first: dict[str, int] = {}
                for end, term in search(text.as_py() or ""):
                    if term not in first:
                        first[term] = end + 1 - len(term)
                if first and maximal:
                    for term in first:
                        if term not in within:
                            within[term] = frozenset(t for _, t in search(term) if t != term)
                    inner = frozenset().union(*(within[t] for t in first))
                    first = {t: at for t, at in first.items() if t not in inner}
                if first:
                    keep.append(i)
                    hits.append([{"at": at, "term": t} for at, t in sorted((at, t) for t, at in first.items())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("term", pa.string())])))], names=["doc_id", "hits"])

    return texts.select("doc_id", "text").mapInArrow(run, kind)


def mentions(texts: DataFrame, lexicon: DataFrame, maximal: bool = True, shard: int = SHARD) -> DataFrame:
    """``doc_id, terms``: lexicon terms that occur anywhere in each text, by first position.

    ``texts(doc_id, text)`` has distinct ids; texts without terms are left out.
    ``maximal`` drops a term that is part of another one found in the text.
    Terms and texts are compared as they are. The lexicon's characters are
    counted first: up to ``shard`` of them are one automaton, broadcast; a
    larger lexicon is dealt into shards by hash, one read after another, and
    the texts pass each.
    """
    terms = lexicon.select("term").where("term <> ''").distinct()
    size = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    shards = -(-size // shard)
    if shards <= 1:
        return _matched(texts, sorted(r["term"] for r in terms.collect()), maximal).select("doc_id", F.transform("hits", lambda h: h["term"]).alias("terms"))
    dealt = [sorted(r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k).collect()) for k in range(shards)]

    def passed(rows: DataFrame) -> DataFrame:
        found = [_matched(rows, part, False) for part in dealt]
        return _union(found).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.at", "h.term")

    hits = passed(texts)
    if maximal:
        inner = passed(terms.select(F.col("term").alias("doc_id"), F.col("term").alias("text"))).where("term <> doc_id").select(F.col("doc_id").alias("longer"), F.col("term").alias("inner"))
        gone = hits.join(inner, hits["term"] == inner["longer"]).select("doc_id", F.col("inner").alias("term")).distinct()
        hits = hits.join(gone, ["doc_id", "term"], "left_anti")
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("hits")).select("doc_id", F.transform("hits", lambda h: h["term"]).alias("terms"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def harvest(rows: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Distinct values of several columns with how often each occurs, ``least`` times or more."""
    each = rows.select(F.explode(F.array(*(F.trim(F.col(c)) for c in columns))).alias("term")).where("term is not null and term <> ''")
    return each.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def harvested_places(chunks: DataFrame) -> DataFrame:
    """``term``: names of places that ``chunks(content_type, attraction_name, item_name, file_title)`` about places give, distinct: their own, and their subject where it is not the file's title."""
    own = F.trim(F.coalesce("attraction_name", F.lit("")))
    item, title = F.trim(F.coalesce("item_name", F.lit(""))), F.trim(F.coalesce("file_title", F.lit("")))
    names = F.array(own, F.when(item != title, item).otherwise(F.lit("")))
    return chunks.where(F.col("content_type").isin(*V.SOURCE_KINDS)).select(F.explode(names).alias("term")).where("term <> ''").distinct()


def place_lexicon(sources: DataFrame, extra: DataFrame | None = None, least: int = 2) -> DataFrame:
    """``term`` of a lexicon from ``sources(text)``, whole texts about places, and ``extra(term)``.

    Terms of topic lines enter as they are, those of headings if their own text
    has them ``least`` times; extra terms may be administrative names, too.
    """
    made = sources.select("text", L.topic_terms("text").alias("topics"), L.heading_terms("text").alias("headings"))
    times = lambda t: (F.length("text") - F.length(F.replace(F.col("text"), t, F.lit("")))) / F.length(t)
    kept = F.array_union("topics", F.filter("headings", lambda t: times(t) >= max(1, least)))
    terms = made.select(F.explode(kept).alias("term"))
    if extra is not None:
        own = extra.select(L.normalised("term").alias("term"))
        terms = terms.unionByName(own.where(L.valid_term("term") | L.admin_name("term")))
    return terms.distinct()


def relation_key(kind: Column | str, keys: dict[str, str]) -> Column:
    """The relation that chunks of a kind fill, or null."""
    pairs = F.create_map(*(F.lit(x) for pair in keys.items() for x in pair))
    return F.try_element_at(pairs, F.col(kind) if isinstance(kind, str) else kind)


def backfill(chunks: DataFrame, found: DataFrame, relation: str) -> DataFrame:
    """``relation`` filled from the terms found where it is empty; filled rows stay, so a second run changes nothing."""
    empty = F.col(relation).isNull() | (F.size(relation) == 0)
    return chunks.join(found, "doc_id", "left").withColumn(relation, F.when(empty, F.coalesce("terms", F.array().cast("array<string>"))).otherwise(F.col(relation))).drop("terms")


def backfill_plan(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, content_type, key, terms``: what fills the relation of chunks whose kind has one and that have none yet.

    ``chunks(doc_id, content_type, text, relations)``, ids distinct, with
    ``relations`` as ``map<key, array<term>>``; ``text`` is what is searched:
    title, parent title and content. A second run finds nothing to fill.
    """
    keyed = chunks.withColumn("key", relation_key(F.trim(F.col("content_type")), V.RELATION_KEYS))
    empty = F.coalesce(F.size(F.try_element_at("relations", F.col("key"))), F.lit(0)) <= 0
    open_ = keyed.where(F.col("key").isNotNull() & empty).select("doc_id", F.trim(F.col("content_type")).alias("content_type"), "key", "text")
    return open_.drop("text").join(mentions(open_, lexicon), "doc_id")


def backfill_coverage(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """``content_type, chunks, filled, planned, share``: by kind, chunks, relations that are there, chunks that ``plan`` fills, and their share."""
    filled = F.size(F.filter(F.array(*(F.try_element_at("relations", F.lit(k)) for k in dict.fromkeys(V.RELATION_KEYS.values()))), lambda v: F.coalesce(F.size(v), F.lit(0)) > 0))
    kinds = chunks.groupBy("content_type").agg(F.count("*").alias("chunks"), F.sum(filled).alias("filled"))
    planned = plan.groupBy("content_type").agg(F.count("*").alias("planned"))
    return kinds.join(planned, "content_type", "left").na.fill(0, ["planned"]).withColumn("share", F.round(F.col("planned") / F.col("chunks"), 4))


def coverage(chunks: DataFrame, by: str, relation: str) -> DataFrame:
    """Chunks and how many have a relation, by kind."""
    filled = F.count_if(F.size(relation) > 0)
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), filled.alias("filled"), F.round(filled / F.count("*"), 4).alias("share"))


def top_terms(found: DataFrame, n: int = 40) -> DataFrame:
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(n)
