"""Queries of review evidence, consistency and standing verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions.identifiers import content_hash
from glossaria.operators import review
from glossaria.plans import match as plan
from glossaria.queries import sql
from glossaria.queries.fixtures import frame, with_tables
from glossaria.queries.matching import CFG, E2E, _inputs
from glossaria.queries.registry import query, table

_DELTAS = ", ".join(f"{{'signal': 's{i}', 'o': {i}, 'd': round(a.s{i} - b.s{i}, 6), 'w': round({w} * (a.s{i} - b.s{i}), 6)}}" for i, w in enumerate(CFG.weights, 1))


@query(
    "contrast_top_two",
    f"{E2E}, t AS (SELECT a.field_key, round(a.confidence - b.confidence, 6) AS gap, [{_DELTAS}] AS p FROM m a JOIN m b ON a.field_key = b.field_key AND a.rank = 1 AND b.rank = 2), x AS (SELECT field_key, gap, unnest(p) AS s FROM t), "
    "l AS (SELECT field_key, arg_min(s.signal, {'k': -abs(s.w), 'o': s.o}) AS largest FROM x WHERE abs(s.d) > 1e-6 GROUP BY field_key) "
    "SELECT x.field_key, CASE WHEN gap > 1e-6 THEN 'SEPARATED' ELSE 'TIED' END AS status, CAST(gap AS DOUBLE) AS gap, CASE WHEN gap > 1e-6 THEN largest END AS largest, s.signal AS signal, CAST(s.d AS DOUBLE) AS delta, CAST(s.w AS DOUBLE) AS weighted, abs(s.d) > 1e-6 AS separating, abs(s.d) > 1e-6 AND s.w > 0 AND gap - s.w <= 1e-6 AS deciding FROM x LEFT JOIN l USING (field_key)",
)
def contrast_top_two(spark, sf):
    return review.contrast_top_two(plan.match(*_inputs(spark), CFG), CFG.weights)


_LABEL = f"concat_ws('|', CASE ordinal % 2 WHEN 0 THEN 'left' ELSE 'right' END, {sql.token_text('name')}, data_type)"


@query("concept_groups", f"{with_tables('lit_fields')}, c AS (SELECT schema_name || '|' || {sql.token_text('name')} || '|' || data_type AS concept, field_key FROM lit_fields UNION ALL SELECT schema_name || '|' || {sql.token_text('name')} || '|' || data_type, field_key || ':twin' FROM lit_fields WHERE ordinal % 3 = 0) SELECT concept, count(*) AS n, string_agg(field_key, ',' ORDER BY field_key) AS members FROM c GROUP BY concept HAVING count(*) >= 2")
def concept_groups(spark, sf):
    f = frame(spark, "lit_fields").withColumn("qualifier", F.col("schema_name"))
    twins = f.filter("ordinal % 3 = 0").withColumn("field_key", F.concat("field_key", F.lit(":twin")))
    return review.concept_groups(f.unionByName(twins))


_ANS = "SELECT p_type AS concept, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS answer FROM part WHERE p_retailprice > 1000"


@query(
    "consistency",
    f"WITH a AS ({_ANS}), c AS (SELECT concept, answer, count(*) AS c FROM a WHERE answer IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER k AS r, lead(c) OVER k AS nxt, sum(c) OVER (PARTITION BY concept) AS total, count(*) OVER (PARTITION BY concept) AS kinds FROM c WINDOW k AS (PARTITION BY concept ORDER BY c DESC, answer)), "
    "t AS (SELECT DISTINCT concept FROM a) SELECT t.concept, CASE WHEN coalesce(total, 0) < 2 THEN 'UNDECIDED' WHEN kinds = 1 THEN 'AGREE' ELSE 'DISAGREE' END AS verdict, CASE WHEN nxt IS NULL OR c > nxt THEN answer END AS majority, CAST(CASE WHEN c IS NOT NULL AND (nxt IS NULL OR c > nxt) THEN c ELSE 0 END AS BIGINT) AS majority_n FROM t LEFT JOIN r ON r.concept = t.concept AND r.r = 1",
)
def consistency(spark, sf):
    a = table(spark, sf, "part").filter("p_retailprice > 1000").select(F.col("p_type").alias("concept"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("answer"))
    return review.consistency(a)


_VERDICT = "CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'APPROVED' WHEN 'signup' THEN 'APPROVED' WHEN 'click' THEN 'MANUAL_OVERRIDE' ELSE 'UNSPECIFIED' END"


def verdict_log(spark, sf):
    kind = F.col("event_type")
    v = F.when(kind == "error", "REJECTED").when(kind.isin("purchase", "signup"), "APPROVED").when(kind == "click", "MANUAL_OVERRIDE").otherwise("UNSPECIFIED")
    return table(spark, sf, "events").select(F.col("user_id").alias("field_key"), F.col("event_id").alias("entry_id"), v.alias("verdict"), "ts", "event_id")


_STAND = f"WITH v AS (SELECT user_id AS field_key, event_id AS entry_id, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), st AS (SELECT field_key, entry_id, verdict FROM v WHERE r = 1 AND verdict <> 'REJECTED')"


@query("standing_verdicts", f"{_STAND} SELECT * FROM st")
def standing_verdicts(spark, sf):
    return review.standing_verdicts(verdict_log(spark, sf), ["ts", "event_id"])[0]


@query("revoked_verdicts", f"SELECT count(*) AS revoked FROM (SELECT {_VERDICT} AS verdict, lag({_VERDICT}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE verdict = 'REJECTED' AND p <> 'REJECTED'")
def revoked_verdicts(spark, sf):
    return spark.createDataFrame([(review.standing_verdicts(verdict_log(spark, sf), ["ts", "event_id"])[1],)], "revoked long")


_BIND = (
    f"{_STAND}, now AS (SELECT event_id AS entry_id, 'f' || (event_id % 7) AS fingerprint FROM events WHERE event_id % 5 <> 0), was AS (SELECT event_id AS entry_id, 'f' || (event_id % 7 + (event_id % 11 = 0)::INT) AS fingerprint FROM events WHERE event_id % 2 = 0), "
    "b AS (SELECT st.field_key, st.entry_id, st.verdict, CASE WHEN now.entry_id IS NULL AND was.entry_id IS NOT NULL THEN 'retired' WHEN now.entry_id IS NULL THEN 'unresolved' WHEN was.fingerprint IS NOT NULL AND was.fingerprint <> now.fingerprint THEN 'invalidated' WHEN verdict = 'UNSPECIFIED' THEN 'ambiguous' ELSE 'bound' END AS outcome FROM st LEFT JOIN now USING (entry_id) LEFT JOIN was USING (entry_id))"
)


def _bound(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("entry_id"))
    mark = lambda n: F.concat(F.lit("f"), n.cast("string"))
    now = e.filter("entry_id % 5 <> 0").withColumn("fingerprint", mark(F.col("entry_id") % 7))
    was = e.filter("entry_id % 2 = 0").withColumn("fingerprint", mark(F.col("entry_id") % 7 + (F.col("entry_id") % 11 == 0).cast("int")))
    return review.bind(review.standing_verdicts(verdict_log(spark, sf), ["ts", "event_id"])[0], now, was)


@query("bypass_bind", f"{_BIND} SELECT field_key, entry_id, outcome FROM b")
def bypass_bind(spark, sf):
    return _bound(spark, sf).select("field_key", "entry_id", "outcome")


@query("bypass_report", f"{_BIND} SELECT outcome, count(*) AS n FROM b GROUP BY outcome")
def bypass_report(spark, sf):
    return _bound(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("approval_binding", "SELECT doc_id, sha256(concat_ws('|', sha256(text), lang)) AS fingerprint FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def approval_binding(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null and lang is not null")
    return d.select("doc_id", review.fingerprint(content_hash(F.col("text")), F.col("lang")).alias("fingerprint"))


_IDS = "SELECT o_custkey AS entry_id FROM orders UNION ALL SELECT o_custkey + 10000000 FROM orders WHERE o_orderkey % 50 = 0"


def _asked(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("entry_id")).union(o.filter("o_orderkey % 50 = 0").select(F.col("o_custkey") + 10_000_000))


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), "c_name")


@query("lookup_ids", f"SELECT i.entry_id, c_name, count(*) AS n FROM ({_IDS}) i LEFT JOIN customer ON c_custkey = i.entry_id GROUP BY ALL")
def lookup_ids(spark, sf):
    return review.lookup(_asked(spark, sf), _customers(spark, sf)).groupBy("entry_id", "c_name").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_missing", f"SELECT DISTINCT entry_id FROM ({_IDS}) WHERE entry_id NOT IN (SELECT c_custkey FROM customer)")
def lookup_missing(spark, sf):
    return review.missing(_asked(spark, sf), _customers(spark, sf)).distinct()


@query("feedback_wire_loss", f"SELECT verdict, count(*) AS events, count(*) FILTER (WHERE event_id % 3 <> 0 AND verdict = 'MANUAL_OVERRIDE') AS rerank_like, count(*) FILTER (WHERE event_id % 3 = 0 AND verdict = 'MANUAL_OVERRIDE') AS outside FROM (SELECT event_id, {_VERDICT} AS verdict FROM events) GROUP BY verdict")
def feedback_wire_loss(spark, sf):
    """Overrides whose choice was proposed look like re-ranks on a wire that keeps only whether the first was right."""
    log = verdict_log(spark, sf).withColumn("proposed", F.filter(F.array(F.col("event_id") - 1, F.col("event_id"), F.col("event_id") + 1), lambda x: (x != F.col("event_id")) | (F.col("event_id") % 3 != 0)))
    inside = F.array_contains("proposed", F.col("entry_id"))
    override = F.col("verdict") == "MANUAL_OVERRIDE"
    return log.groupBy("verdict").agg(F.count(F.lit(1)).alias("events"), F.count_if(inside & override).alias("rerank_like"), F.count_if(~inside & override).alias("outside"))
