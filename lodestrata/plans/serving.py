"""Queries on conversations, service events and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing
from ..operators import evaluation, history, operations
from ..sources.snapshots import Snapshots
from ..sources.store import scratch
from .registry import query, table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4""")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_messages(_messages(spark, sf_dir), 4).select("conv_id", "turn", "role", "place")


@query("""SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, substr(coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_max(text, turn)), 1, 60) AS title, substr(arg_max(text, turn), 1, 80) AS preview FROM conversations GROUP BY conv_id""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sessions(_messages(spark, sf_dir))


@query("""SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…(已截断)' ELSE text END, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")
def history_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_text(_messages(spark, sf_dir))


@query("""WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
z AS (SELECT *, CASE WHEN i <= 2 THEN 'h' WHEN i > greatest(2, n - 3) THEN 't' ELSE 'm' END AS z FROM p)
SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (z = 'h'), '') AS head, substr(coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (z = 'm'), ''), 1, 200) AS middle, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (z = 't'), '') AS tail FROM z GROUP BY conv_id""")
def compressed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compress(_messages(spark, sf_dir), head=2, tail=3, most=200)


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), -1) AS inherited_turn FROM conversations""")
def follow_up_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("domain", F.col("role"))
    return history.inherited(rows, "user").select("conv_id", "turn", F.coalesce("inherited_turn", F.lit(-1)).alias("inherited_turn"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(hi|hello|thanks)\\b') THEN 'chat' WHEN regexp_matches(lower(text), '(plan|trip|day)') THEN 'plan' WHEN contains(text, '?') THEN 'knowledge' ELSE '' END AS intent, length(text) < 15 AS short FROM conversations""".replace("\\\\", "\\"))
def rule_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    intent = F.when(t.rlike(r"\b(hi|hello|thanks)\b"), "chat").when(t.rlike("(plan|trip|day)"), "plan").when(F.col("text").contains("?"), "knowledge").otherwise("")
    return _messages(spark, sf_dir).select("conv_id", "turn", intent.alias("intent"), (F.length("text") < 15).alias("short"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH r AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT *, CASE WHEN n > 2 THEN 'user_hour' END AS r1 FROM r),
b AS (SELECT *, sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM a),
c AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN m > 3 THEN 'user_day' END AS r2 FROM b),
d AS (SELECT *, sum(CASE WHEN r2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT event_id, CASE WHEN r2 IS NOT NULL THEN r2 WHEN k > 5 THEN 'type_hour' END AS rejected_by FROM d""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = (("user_hour", "user_id", "hour", 2), ("user_day", "user_id", "day", 3), ("type_hour", "event_type", "hour", 5))
    rows = _events(spark, sf_dir).withColumnRenamed("event_id", "request_id")
    return operations.fixed_windows(rows, limits).select(F.col("request_id").alias("event_id"), "rejected_by")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def sliding_window_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.sliding_load(_events(spark, sf_dir), "user_id", 86_400).select("event_id", "in_window")


@query("""WITH m AS (SELECT event_id, event_type, value >= 20 AS ok, sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_type, run::BIGINT AS run, count(*) AS failures, min(event_id) AS first_id, max(event_id) AS last_id FROM m WHERE NOT ok GROUP BY event_type, run HAVING count(*) >= 5""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select(F.col("event_id").alias("call_id"), "event_type", "ts", (F.col("value") >= 20).alias("ok"))
    return operations.failure_runs(calls, "event_type", ["ts", "call_id"])


@query("""WITH reg(event_type, expiry) AS (VALUES ('click', 86400), ('view', 604800), ('purchase', NULL)), now AS (SELECT max(ts) AS now FROM events)
SELECT event_id, coalesce(epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= expiry, true) AS fresh FROM events LEFT JOIN reg USING (event_type), now""")
def fresh_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    registry = spark.createDataFrame([("click", 86_400), ("view", 604_800), ("purchase", None)], "source string, expiry_seconds int")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))).withColumnRenamed("event_type", "source")
    return operations.freshness(rows, registry, F.col("now")).select("event_id", "fresh")


@query("""SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, count(*) AS changes FROM events GROUP BY user_id""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.latest_status(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH h AS (SELECT event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) > 1 AS hit FROM events)
SELECT event_type, count(*) AS calls, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*) * 100, 1) AS rate FROM h GROUP BY event_type""")
def cache_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).withColumnsRenamed({"user_id": "key", "event_id": "call_id"})
    return operations.cache_rates(calls, "event_type")


@query("""WITH k AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM k WHERE back <= 20 GROUP BY user_id""")
def user_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.last_items(_events(spark, sf_dir), "user_id", "event_id", "event_type", 20).withColumn("items", F.array_join("items", ","))


@query("""SELECT event_type AS policy, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 2) AS payload FROM events GROUP BY event_type""")
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("policy")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("payload"))


@query("""SELECT event_id, event_type, value FROM events WHERE event_type LIKE '%c%' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest records that hold a substring: a top-k report."""
    return _events(spark, sf_dir).where(F.col("event_type").contains("c")).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases: what was expected, and a verdict that is open for some."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    accept = F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") > 1500) & (F.col("toxic") == 0))
    return docs.select("doc_id", "lang", (F.col("quality") == 1).alias("expected"), accept.alias("accept"), "n_chars")


_JUDGED = "j AS (SELECT d.doc_id, lang, n_chars, quality = 1 AS expected, CASE WHEN n_chars % 7 <> 0 THEN n_chars > 1500 AND toxic = 0 END AS accept FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_RATES = """round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 4) AS accuracy"""
_COUNTS = "count(*) FILTER (expected AND accept) AS tp, count(*) FILTER (NOT expected AND accept) AS fp, count(*) FILTER (expected AND NOT accept) AS fn, count(*) FILTER (NOT expected AND NOT accept) AS tn, count(*) FILTER (accept IS NULL) AS unresolved"
_PRF = f"""{_RATES}, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall"""


@query(f"""WITH {_JUDGED}, c AS (SELECT {_COUNTS} FROM j), r AS (SELECT *, {_PRF} FROM c)
SELECT *, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM r""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir))


@query(f"""WITH {_JUDGED}, g AS (SELECT *, unnest(CASE WHEN n_chars > 3000 THEN [lang, 'long'] ELSE [lang] END) AS domain FROM j), c AS (SELECT domain, {_COUNTS} FROM g GROUP BY domain), r AS (SELECT *, {_PRF} FROM c)
SELECT *, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM r""")
def metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups overlap: a long document is in its language and in ``long``."""
    groups = F.when(F.col("n_chars") > 3000, F.array("lang", F.lit("long"))).otherwise(F.array("lang"))
    return evaluation.confusion(_judged(spark, sf_dir).withColumn("domain", F.explode(groups)), ["domain"])


@query(f"""WITH {_JUDGED}, h AS (SELECT doc_id, expected AS human FROM j WHERE n_chars % 5 = 0)
SELECT j.doc_id AS id, CAST(coalesce(human, accept) AS VARCHAR) AS accept, human IS NOT NULL AS reviewed FROM j LEFT JOIN h ON j.doc_id = h.doc_id""")
def human_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir).withColumnRenamed("doc_id", "id")
    human = judged.where("n_chars % 5 = 0").select("id", F.col("expected").alias("accept"))
    return evaluation.overridden(judged, human).withColumn("accept", F.col("accept").cast("string"))


@query(f"""WITH {_JUDGED}, b AS (SELECT doc_id AS id, accept FROM j WHERE lang <> 'es'), n AS (SELECT doc_id AS id, CASE WHEN n_chars % 11 <> 0 THEN n_chars > 1200 END AS accept FROM j WHERE lang <> 'de')
SELECT coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'only_base' WHEN b.id IS NULL THEN 'only_new' WHEN b.accept IS NOT DISTINCT FROM n.accept THEN 'same' WHEN b.accept IS NULL OR n.accept IS NULL THEN 'unresolved' WHEN n.accept THEN 'improved' ELSE 'regressed' END AS change FROM b FULL JOIN n ON b.id = n.id""")
def verdict_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    base = rows.where("lang <> 'es'").select(F.col("doc_id").alias("id"), "accept")
    new = rows.where("lang <> 'de'").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") > 1200).alias("accept"))
    return evaluation.flips(base, new)


@query("""WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, round(avg(value), 4) AS mean, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS most FROM a GROUP BY event_type""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(_events(spark, sf_dir), "event_type", "value")


@query(f"""WITH {_JUDGED}, r AS (SELECT doc_id AS id, coalesce(accept, false) AS passed FROM j), t AS (SELECT CAST(ceil(count(*) * 0.9) AS BIGINT) AS want, count(*) FILTER (NOT passed) AS failed FROM r),
p AS (SELECT id, passed, row_number() OVER (ORDER BY md5(id || ':7'), id) AS n FROM r WHERE passed)
SELECT id, passed FROM r WHERE NOT passed UNION ALL SELECT id, passed FROM p, t WHERE n <= want - failed""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce("accept", F.lit(False)).alias("passed"))
    return evaluation.review_sample(rows, 0.9, 7)


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS found FROM documents), g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS gold FROM benchmark),
h AS (SELECT doc_id AS id, found, gold, len(list_intersect(found, gold)) AS hits FROM w JOIN g ON doc_id = item_id),
m AS (SELECT id, hits > 0 AS hit, round(CASE WHEN len(found) + len(gold) = 0 THEN 0 ELSE 2 * hits / (len(found) + len(gold)) END, 4) AS f1, round(CASE WHEN len(found) = 0 THEN 0 ELSE hits / len(found) END, 4) AS precision, round(CASE WHEN len(gold) = 0 THEN 0 ELSE hits / len(gold) END, 4) AS recall FROM h)
SELECT * FROM m""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{6,})"), F.lit(1)))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), long_words("text").alias("found"))
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), long_words("text").alias("gold"))
    return evaluation.retrieval_metrics(found.join(gold, "id"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN replace(text, 'e', '?') ELSE text END AS t, role <> 'user' AS other, regexp_extract_all(text, '[A-Z][a-z]{8,}') AS names FROM conversations),
c AS (SELECT conv_id, turn, role, names, regexp_replace(coalesce(t, ''), '^[\\s]+|[\\s]+$', '', 'g') AS t, CASE WHEN other THEN 400 ELSE 160 END AS most FROM m)
SELECT conv_id, string_agg('角色:' || role || ',内容:' || CASE WHEN length(t) > most THEN substr(t, 1, most) || '…(已截断)' ELSE t END || ',关联主体: ' || array_to_string(names, '、'), chr(10) ORDER BY turn) AS history FROM c GROUP BY conv_id""")
def prompt_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a prompt has them, answers at the larger limit."""
    rows = table(spark, sf_dir, "conversations").withColumns({"rewritten_query": F.replace("text", F.lit("e"), F.lit("?")), "item_names": F.regexp_extract_all("text", F.lit("([A-Z][a-z]{8,})"), F.lit(1))})
    return history.prompt_history(rows, answers=400)


@query("""SELECT conv_id, turn, length(coalesce(text, '')) >= 15 AND len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{8,}')) = 0 AS expands FROM conversations""")
def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages would be searched by rewrites: not short, and without a subject."""
    names = F.regexp_extract_all("text", F.lit("([A-Z][a-z]{8,})"), F.lit(1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.expands("text", names).alias("expands"))


@query("""WITH f AS (SELECT user_id, event_type AS kind, CAST(floor(value / 20) AS INT)::VARCHAR AS v, min((ts, event_id)) AS first FROM events GROUP BY ALL)
SELECT user_id, kind, list(v ORDER BY first) AS interests FROM f WHERE v <> '' GROUP BY user_id, kind""")
def user_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"kind": F.col("event_type"), "v": F.floor(F.col("value") / 20).cast("int").cast("string")})
    return operations.interests(rows, "user_id", "kind", "v", ["ts", "event_id"])


@query("""SELECT 'chunks' AS name, source, count(*) AS n, false AS fresh FROM documents WHERE source <> 'src1' GROUP BY source UNION ALL SELECT 'chunks', 'src1', count(*), true FROM documents WHERE source = 'src1' AND n_chars > 500
UNION ALL SELECT 'items', source, 1, false FROM documents WHERE source <> 'src1' GROUP BY source UNION ALL SELECT 'items', 'src1', 2, true""")
def replaced_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and items of one source replaced in one commit."""
    docs = table(spark, sf_dir, "documents")
    store = Snapshots(spark, f"{scratch(spark)}/snapshots-{uuid.uuid4().hex}")
    chunks, items = docs.select("source", "doc_id"), docs.select("source").distinct()
    store.commit({"chunks": chunks.withColumn("fresh", F.lit(False)), "items": items.withColumn("fresh", F.lit(False))})
    new = docs.where("source = 'src1' AND n_chars > 500").select("source", "doc_id").withColumn("fresh", F.lit(True))
    store.replace("source", "src1", {"chunks": new, "items": spark.createDataFrame([("src1", True), ("src1", True)], "source string, fresh boolean")})
    count = lambda name: store.read(name).groupBy("source", "fresh").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "source", "n", "fresh")
    return count("chunks").unionByName(count("items"))
