"""Queries on search and ranking. Documents stand for chunks, benchmark items for questions, pages for web results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, terms
from ..operators import keyword_index, ranking, retrieval
from ..sources.store import scratch, staged
from .registry import query, table, version

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
_ASKED = "SELECT item_id AS query_id, text FROM benchmark"


def _bm25_sql(asked: str = _ASKED, docs: str = "SELECT doc_id, source, text FROM documents", terms: str = _TERMS) -> str:
    return f"""
words AS (SELECT doc_id, source, {terms} AS w FROM ({docs})),
index AS (SELECT doc_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM words) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM index, stats GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms}) AS term FROM ({asked})) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM index JOIN asked USING (term) JOIN idf USING (term), stats GROUP BY query_id, doc_id HAVING score > 0
)"""


_BM25 = _bm25_sql()


_indexes: dict[tuple[str, str], keyword_index.KeywordIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> keyword_index.KeywordIndex:
    """The keyword index of the documents: one for all queries of an application, as long as the table's files stay the same."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, version(docs))
    if key not in _indexes:
        _indexes[key] = keyword_index.build(docs, f"{scratch(spark)}/keywords-{uuid.uuid4().hex}")
    return _indexes[key]


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH {_BM25}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
FROM scored JOIN documents USING (doc_id) WHERE source IN ('src0', 'src3', 'src7')) WHERE rank <= 5""")
def bm25_allowed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where(F.col("source").isin("src0", "src3", "src7")).select("doc_id")
    return retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), allowed=allowed).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}
SELECT query_id, doc_id, round(score, 6) AS score, rank, lang FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) JOIN documents USING (doc_id) WHERE rank <= 5 AND lang = 'fr'""")
def bm25_language_after_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the first five, so fewer may be left."""
    docs = table(spark, sf_dir, "documents")
    hits = retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return hits.join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'fr'").select("query_id", "doc_id", "score", "rank", "lang")


_VECTORS = """
q AS (SELECT vec_id AS query_id, embedding AS x, label FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT query_id, vec_id, q.label AS ql, e.label AS el, list_sum(list_transform(list_zip(x, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM q, embeddings e)"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(f"""WITH {_VECTORS}
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense(vectors, _vector_queries(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_VECTORS}
SELECT query_id, vec_id, el AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, el ORDER BY round(score, 12) DESC, vec_id) AS rank FROM pairs) WHERE rank = 1 AND score >= 0.65""")
def entity_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query vector, the nearest vector of each label, if near enough."""
    rows = lambda df, key: df.select(key, F.col("label").alias("grp"), "embedding")
    found = retrieval.near(rows(table(spark, sf_dir, "embeddings"), "vec_id"), rows(_vector_queries(spark, sf_dir), "query_id"), 0.65, False)
    return found.select("query_id", "vec_id", F.col("grp").cast("int").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTORS}
SELECT query_id, ql AS namespace, vec_id AS key, round(score, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM pairs WHERE ql = el AND vec_id <> query_id AND round(score, 12) >= 0.2) WHERE rank = 1""")
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("namespace"), F.col("vec_id").alias("key"), "embedding")
    asked = _vector_queries(spark, sf_dir).select("query_id", F.col("label").alias("namespace"), "embedding")
    return retrieval.similar_cached(vectors, asked, 0.2).withColumn("similarity", F.round("similarity", 6))


_SPARSE = f"""
dw AS (SELECT doc_id, {_TERMS} AS w FROM documents),
qw AS (SELECT item_id AS query_id, {_TERMS} AS w FROM benchmark),
d AS (SELECT doc_id, term, count(*) / n AS x FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw) GROUP BY doc_id, term, n),
q AS (SELECT query_id, term, count(*) / n AS y FROM (SELECT query_id, len(w) AS n, unnest(w) AS term FROM qw) GROUP BY query_id, term, n),
sparse AS (SELECT query_id, doc_id, sum(x * y) AS score FROM d JOIN q USING (term) GROUP BY query_id, doc_id)"""


@query(f"""WITH {_SPARSE}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sparse) WHERE rank <= 10""")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_index.shares(_index(spark, sf_dir), _queries(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


_LISTS = f"""WITH {_BM25}, {_SPARSE},
a AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10),
b AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sparse) WHERE rank <= 10)"""


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index, asked = _index(spark, sf_dir), _queries(spark, sf_dir)
    return retrieval.bm25(index, asked, 10), keyword_index.shares(index, asked, 10)


@query(f"""{_LISTS},
f AS (SELECT query_id, doc_id, 0.9 * coalesce(0.5 + atan(a.score) / pi(), 0) + 0.1 * coalesce(0.5 + atan(b.score) / pi(), 0) AS score FROM a FULL JOIN b USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_lists(spark, sf_dir)
    return retrieval.hybrid(a, b).withColumn("score", F.round("score", 6))


_RRF = f"""{_LISTS},
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS gain, rank AS seen FROM a UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), 1000000000 + rank FROM b),
f AS (SELECT query_id, doc_id, CAST(sum(CAST(gain AS DOUBLE)) AS DOUBLE) AS score, min(seen) AS seen FROM u GROUP BY query_id, doc_id),
fused AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM f) WHERE rank <= 20)"""


@query(f"{_RRF} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused WHERE rank <= 5")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(list(_two_lists(spark, sf_dir))).withColumn("score", F.round("score", 9))


@query(f"""{_LISTS}, u AS (SELECT query_id, doc_id, 0 AS path, rank FROM a UNION ALL SELECT query_id, doc_id, 1, rank FROM b)
SELECT query_id, doc_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY path, rank) AS n FROM u) WHERE n = 1""")
def multi_query_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_lists(spark, sf_dir)
    rows = a.select("query_id", "doc_id", F.lit(0).alias("path"), "rank").unionByName(b.select("query_id", "doc_id", F.lit(1).alias("path"), "rank"))
    return retrieval.first_seen(rows, ["query_id", "doc_id"], ["path", "rank"])


_CLIFF = f"""WITH {_BM25},
r AS (SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 20),
h AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS drop FROM r WHERE rank <= 10),
c AS (SELECT *, min(CASE WHEN drop > 2 OR drop / (score + 1e-7) > 2 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM h)"""


@query(f"{_CLIFF} SELECT query_id, doc_id, score, rank FROM c WHERE cut IS NULL OR rank <= cut")
def cliff_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), 20).withColumn("score", F.round("score", 6))
    return ranking.cliff_cut(hits)


@query(f"""WITH {_BM25},
f AS (SELECT query_id, doc_id, rank, CASE WHEN lang = 'en' THEN 'web' ELSE 'local' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) JOIN documents USING (doc_id) WHERE rank <= 20),
t AS (SELECT * FROM f WHERE rank <= 10),
m AS (SELECT query_id, 3 - count(*) FILTER (kind <> 'web') AS missing FROM t WHERE rank <= 5 GROUP BY query_id HAVING missing > 0),
w AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS n FROM t WHERE rank <= 5 AND kind = 'web'),
o AS (SELECT query_id, doc_id AS new_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM f WHERE kind <> 'web' AND rank > 5),
s AS (SELECT w.query_id, rank, new_id FROM w JOIN m USING (query_id) JOIN o USING (query_id, n) WHERE n <= missing)
SELECT t.query_id, t.rank, coalesce(new_id, doc_id) AS doc_id, CASE WHEN new_id IS NULL THEN kind ELSE 'local' END AS kind FROM t LEFT JOIN s ON t.query_id = s.query_id AND t.rank = s.rank""")
def source_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = docs.select("doc_id", F.when(F.col("lang") == "en", "web").otherwise("local").alias("kind"))
    full = staged(retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), 20).join(kinds, "doc_id").select("query_id", "doc_id", "rank", "kind"), "ranked")
    return ranking.quota(full.where("rank <= 10"), full)


_LIST = """SELECT item_id * 10 AS query_id, split_part(text, '. ', 1) AS text FROM benchmark WHERE split_part(text, '. ', 1) <> text
UNION ALL SELECT item_id * 10 + 1, text || ',' || split_part(text, '. ', 2) FROM benchmark WHERE split_part(text, '. ', 2) <> ''"""


@query(f"""WITH {_bm25_sql(_LIST)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id, path, rank FROM (SELECT query_id // 10 AS query_id, doc_id, CAST(query_id % 10 AS INT) AS path, rank, row_number() OVER (PARTITION BY query_id // 10, doc_id ORDER BY query_id % 10, rank) AS n FROM r WHERE rank <= 5) WHERE n = 1""")
def multi_query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions searched by their first sentence and by the text with an assumed answer, their second one; the repeat of the original goes."""
    text, first, second = F.col("text"), F.split_part("text", F.lit(". "), F.lit(1)), F.split_part("text", F.lit(". "), F.lit(2))
    queries = retrieval.query_list(text, F.array(first, text, first, F.lit("")), second)
    return retrieval.multi_query(_index(spark, sf_dir), _queries(spark, sf_dir).select("query_id", queries.alias("queries")))


@query(None)
def condensed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document of each question, condensed to 400 characters. Sentence ends need look-behind, which the checking SQL lacks."""
    docs = table(spark, sf_dir, "documents")
    asked = _queries(spark, sf_dir)
    hits = retrieval.bm25(_index(spark, sf_dir), asked, 1).join(docs.select("doc_id", "text"), "doc_id").join(asked.select("query_id", F.col("text").alias("question")), "query_id")
    return ranking.condense(hits.select(F.col("query_id").alias("id"), "question", "text"), 400)


@query(f"""WITH {_BM25},
r AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5),
k AS (SELECT query_id, rank, CASE WHEN url IS NOT NULL THEN 1 ELSE 0 END AS web, coalesce(url, source) AS name FROM r JOIN documents USING (doc_id) LEFT JOIN pages ON page_id = doc_id),
o AS (SELECT query_id, web, name, min(rank) AS place FROM k GROUP BY ALL)
SELECT query_id, list(name ORDER BY web, place, name) AS sources FROM o GROUP BY query_id""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    hits = retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), 5).join(docs.select("doc_id", F.col("source").alias("title")), "doc_id").join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return ranking.source_list(hits.withColumn("kind", F.when(F.col("url").isNotNull(), "web").otherwise("local")))


@query("""SELECT 'local' AS kind, doc_id AS id, 0.5 AS score, source AS title, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'web', page_id, 0.0, NULL, url FROM pages""")
def local_and_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"), F.col("source").alias("title"))
    return ranking.with_web(local, table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


#: A few sentences in Chinese, which the given tables lack.
_CHINESE = ((-1, "灵隐之后去西湖，西湖边有断桥"), (-2, "西湖龙井茶产自杭州西湖景区"), (-3, "兵马俑在西安，离机场很远"), (-4, "West Lake 西湖 in Hangzhou"), (-5, "鼓浪屿是厦门的小岛"), (-6, ""))
_CHINESE_ASKED = ((-1, "西湖有什么"), (-2, "西安兵马俑怎么去"), (-3, "lake 杭州"))
_VALUES = lambda rows: ", ".join(f"({i}, '{t}')" for i, t in rows)
_PAIR_TERMS = f"list_concat({_TERMS}, list_filter(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{{4E00}}-\\x{{9FFF}}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), lambda w: true))"


@query(f"""WITH {_bm25_sql(f"SELECT * FROM (VALUES {_VALUES(_CHINESE_ASKED)}) v(query_id, text) UNION ALL {_ASKED}", f"SELECT doc_id, '' AS source, text FROM (VALUES {_VALUES(_CHINESE)}) v(doc_id, text) UNION ALL SELECT doc_id, source, text FROM documents", _PAIR_TERMS)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""")
def bm25_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in texts with and without spaces, by words and pairs of characters: the documents' index with sentences appended."""
    docs, asked = spark.createDataFrame(_CHINESE, "doc_id long, text string"), spark.createDataFrame(_CHINESE_ASKED, "query_id long, text string")
    index = keyword_index.build(table(spark, sf_dir, "documents"), f"{scratch(spark)}/keywords-{uuid.uuid4().hex}").append(docs)
    return retrieval.bm25(index, asked.unionByName(_queries(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(f"""WITH {_VECTORS}
SELECT query_id, ql AS namespace, vec_id AS key, round(score, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM pairs WHERE ql = el AND vec_id <> query_id AND round(score, 12) >= 0.92) WHERE rank = 1""")
def semantic_cache_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the threshold of the service."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("namespace"), F.col("vec_id").alias("key"), "embedding")
    asked = _vector_queries(spark, sf_dir).select("query_id", F.col("label").alias("namespace"), "embedding")
    return retrieval.similar_cached(vectors, asked).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_VECTORS}
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM pairs WHERE el IN (1, 3)) WHERE rank <= 10""")
def dense_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among the confirmed subjects' vectors, chosen before the ranking."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense(vectors, _vector_queries(spark, sf_dir), 10, allowed=vectors.where("label IN (1, 3)").select("vec_id")).withColumn("score", F.round("score", 6))
