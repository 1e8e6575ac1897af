"""Queries of metrics, calibration and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions.identifiers import identifier_tokens
from glossaria.operators import dense, evaluation
from glossaria.queries import sql
from glossaria.queries.indexing import _COS, _VEC, _vectors
from glossaria.queries.registry import query, table

# Neighbours of the vectors whose id is divisible by 20; the gold id of a query is its nearest neighbour of the same label.
_NN = (
    f"WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label = b.label AS same, {_COS} AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), "
    "top AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS confidence, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS gap, bool_or(same) FILTER (WHERE rank = 1) AS correct FROM r GROUP BY query_id), "
    "gold AS (SELECT query_id, min(rank) AS rank FROM r WHERE same AND rank <= 20 GROUP BY query_id), ranks AS (SELECT top.query_id, gold.rank FROM top LEFT JOIN gold USING (query_id))"
)


def _neighbours(spark, sf):
    q, e = _vectors(spark, sf)
    labels = e.select("entry_id", "label")
    top = dense.top_k(q, e, 21).filter("query_id <> entry_id")
    from pyspark.sql import Window

    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))).filter("rank <= 20")
    own = labels.select(F.col("entry_id").alias("query_id"), F.col("label").alias("ql"))
    return top.join(labels, "entry_id").join(own, "query_id").withColumn("same", F.col("label") == F.col("ql"))


def _tops(spark, sf):
    n = _neighbours(spark, sf)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return n.groupBy("query_id").agg(at(1, "score").alias("confidence"), F.round(at(1, "score") - at(2, "score"), 6).alias("gap"), at(1, "same").alias("correct"))


def _ranks(spark, sf):
    return _neighbours(spark, sf).groupBy("query_id").agg(F.min(F.when(F.col("same"), F.col("rank"))).alias("rank"))


@query("retrieval_metrics", f"{_NN} SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10 FROM ranks")
def retrieval_metrics(spark, sf):
    return evaluation.retrieval_metrics(_ranks(spark, sf))


_TS = [round(0.05 * i, 2) for i in range(0, 20)]
_GRID = "g AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(0, 20) t(i))"
_SWEEP = f"{_NN}, {_GRID}, sw AS (SELECT threshold, count(*) FILTER (WHERE hit) AS n_auto, round(count(*) FILTER (WHERE hit) / count(*), 6) AS coverage, round(avg(correct::INT) FILTER (WHERE hit), 6) AS precision FROM (SELECT threshold, correct, confidence >= threshold AND gap >= 0.005 AS hit FROM top, g) GROUP BY threshold)"


@query("threshold_sweep", f"{_SWEEP} SELECT * FROM sw")
def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(_tops(spark, sf), _TS, 0.005)


@query("recommended_threshold", f"{_SWEEP} SELECT t.target, arg_min(threshold, {{'c': -coverage, 't': threshold}}) AS threshold, max(coverage) AS coverage FROM sw, (VALUES (0.1::DOUBLE), (0.2), (0.5)) AS t(target) WHERE precision >= target GROUP BY t.target")
def recommended_threshold(spark, sf):
    return evaluation.recommended_thresholds(threshold_sweep(spark, sf), [0.1, 0.2, 0.5])


@query("threshold_transfer", f"{_SWEEP} SELECT min(threshold) AS threshold, count(*) AS candidates FROM sw WHERE n_auto >= 5 AND precision >= 0.1")
def threshold_transfer(spark, sf):
    return threshold_sweep(spark, sf).filter("n_auto >= 5 and precision >= 0.1").agg(F.min("threshold").alias("threshold"), F.count(F.lit(1)).alias("candidates"))


_OBS = (
    "WITH o AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars, row_number() OVER (PARTITION BY d.doc_id ORDER BY l.quality) AS k FROM documents d JOIN labels l ON l.doc_id = d.doc_id), "
    "b AS (SELECT doc_id, quality = 1 AS answerable, toxic = 1 AS trapped, n_chars % 3 <> 0 AS correct, n_chars % 10 = 0 AS abstained, n_chars % 4 = 0 AS auto FROM o WHERE k = 1)"
)


def _obs(spark, sf):
    l = table(spark, sf, "labels").dropDuplicates(["doc_id"])  # noqa: E741
    d = table(spark, sf, "documents").join(l, "doc_id")
    n = F.col("n_chars")
    truth = d.select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.array("doc_id")).otherwise(F.array().cast("array<bigint>")).alias("correct_ids"), F.when(F.col("toxic") == 1, F.when(n % 3 != 0, F.col("doc_id")).otherwise(F.lit(-2))).alias("trap_id"))
    tops = d.select(F.col("doc_id").alias("key"), F.when(n % 3 != 0, F.col("doc_id")).otherwise(F.lit(-1)).alias("top_id"), F.when(n % 10 == 0, "NO_MATCH").when(n % 4 == 0, "AUTO_APPROVE").otherwise("REVIEW").alias("verdict"))
    return evaluation.observations(truth, tops)


@query("eval_observations", f"{_OBS} SELECT doc_id AS key, answerable, answerable AND correct AS correct, abstained FROM b")
def eval_observations(spark, sf):
    return _obs(spark, sf).select("key", "answerable", "correct", "abstained")


@query(
    "eval_scored",
    f"{_OBS}, c AS (SELECT *, answerable AND correct AS right_one, auto AND NOT abstained AS automatic, trapped AND correct AS caught FROM b) SELECT count(*) AS n, round(count(*) FILTER (WHERE right_one AND NOT abstained AND answerable) / count(*) FILTER (WHERE answerable), 6) AS p_at_1, "
    "round(count(*) FILTER (WHERE abstained AND NOT answerable) / count(*) FILTER (WHERE NOT answerable), 6) AS abstention, round(count(*) FILTER (WHERE abstained AND answerable) / count(*) FILTER (WHERE answerable), 6) AS false_abstention, round(count(*) FILTER (WHERE caught) / count(*) FILTER (WHERE trapped), 6) AS trap_hit, "
    "round(count(*) FILTER (WHERE automatic) / count(*), 6) AS auto_coverage, round(count(*) FILTER (WHERE right_one AND automatic) / count(*) FILTER (WHERE automatic), 6) AS auto_precision FROM c",
)
def eval_scored(spark, sf):
    return evaluation.scored(_obs(spark, sf))


_SCORED = "SELECT n_chars::DOUBLE AS score, quality = 1 AS positive FROM documents d JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"


def _scored(spark, sf):
    l = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))  # noqa: E741
    return table(spark, sf, "documents").join(l, "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))


@query("auc_ranksum", f"WITH s AS ({_SCORED}) SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auc, (SELECT count(*) FROM s WHERE positive) AS n_pos, (SELECT count(*) FROM s WHERE NOT positive) AS n_neg FROM s a, s b WHERE a.positive AND NOT b.positive")
def auc_ranksum(spark, sf):
    return evaluation.auc(_scored(spark, sf))


@query("youden_floor", f"WITH s AS ({_SCORED}), j AS (SELECT c.score AS floor, round(count(*) FILTER (WHERE s.positive AND s.score >= c.score) / (SELECT count(*) FROM s WHERE positive) - count(*) FILTER (WHERE NOT s.positive AND s.score >= c.score) / (SELECT count(*) FROM s WHERE NOT positive), 6) AS j FROM (SELECT DISTINCT score FROM s) c, s GROUP BY c.score) SELECT floor, j FROM j ORDER BY j DESC, floor LIMIT 1")
def youden_floor(spark, sf):
    return evaluation.youden_floor(_scored(spark, sf))


_FLOORS = "(SELECT i, min(score) + (max(score) - min(score)) * i / 24 AS floor FROM s, range(0, 25) t(i) GROUP BY i)"


@query("floor_sweep", f"WITH s AS ({_SCORED}) SELECT i::INTEGER AS step, count(*) FILTER (WHERE NOT positive AND score < floor) AS declined, count(*) FILTER (WHERE positive AND score < floor) AS lost FROM {_FLOORS} f, s GROUP BY i")
def floor_sweep(spark, sf):
    s = _scored(spark, sf)
    low, high = s.agg(F.min("score"), F.max("score")).first()
    floors = [(low or 0.0) + ((high or 0.0) - (low or 0.0)) * i / 24 for i in range(25)]
    marks = F.filter(F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(floors)]), lambda x: x), lambda x: F.col("score") < x["v"])
    below = s.select("positive", F.explode(marks).alias("m")).groupBy(F.col("m.i").alias("step")).agg(F.count_if(~F.col("positive")).alias("declined"), F.count_if("positive").alias("lost"))
    grid = spark.range(25).select(F.col("id").cast("int").alias("step"))
    return grid.join(below, "step", "left").select("step", F.coalesce("declined", F.lit(0).cast("long")).alias("declined"), F.coalesce("lost", F.lit(0).cast("long")).alias("lost"))


@query("mcnemar_counts", "SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT a AND b) AS gained, count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT l_quantity > 25 AS a, l_extendedprice > 30000 AS b FROM lineitem)")
def mcnemar_counts(spark, sf):
    return evaluation.mcnemar(table(spark, sf, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_extendedprice") > 30000).alias("b"))).select("both", "gained", "lost", "neither")


@query("mcnemar_p")
def mcnemar_p(spark, sf):
    return evaluation.mcnemar(_tops(spark, sf).select(F.col("correct").alias("a"), (F.col("gap") > 0.01).alias("b")))


@query("paired_delta", "SELECT count(*) AS n, round(avg(a.v), 6) AS mean_a, round(avg(b.v), 6) AS mean_b, round(avg(b.v - a.v), 6) AS delta FROM (SELECT p_partkey AS key, p_size::DOUBLE AS v FROM part WHERE p_partkey % 3 <> 0) a JOIN (SELECT p_partkey AS key, p_size * 2.0::DOUBLE AS v FROM part WHERE p_partkey % 4 <> 0) b USING (key)")
def paired_delta(spark, sf):
    p = table(spark, sf, "part")
    a = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("value"))
    b = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 2.0).alias("value"))
    return evaluation.paired_delta(a, b)


def _deltas(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), ((F.col("p_size") - 25) / 25.0).alias("delta"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return evaluation.bootstrap_ci(_deltas(spark, sf))


@query("sign_flip")
def sign_flip(spark, sf):
    return evaluation.sign_flip(_deltas(spark, sf), 200)


@query("confidence_profile", f"{_NN}, q AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS i, count(*) OVER () AS n FROM top) SELECT count(*) AS n, min(confidence) AS min, max(confidence) FILTER (WHERE i = n // 4) AS p25, max(confidence) FILTER (WHERE i = n // 2) AS median, max(confidence) AS max, round(avg((confidence >= 0.5)::INT), 6) AS share_50, round(avg((confidence >= 0.87)::INT), 6) AS share_87 FROM q")
def confidence_profile(spark, sf):
    return evaluation.confidence_profile(_tops(spark, sf), "confidence")


@query("confidence_histogram", f"{_NN} SELECT CAST(least(19, greatest(0, floor(confidence * 20))) AS INTEGER) AS bin, count(*) AS n FROM top GROUP BY ALL")
def confidence_histogram(spark, sf):
    b = F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.col("confidence") * 20))).cast("int")
    return _tops(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "histogram_stats",
    "WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, row_number() OVER k - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WHERE l_quantity IS NOT NULL WINDOW k AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity)) "
    "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(v), 4) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 4) AS avg, max(v) FILTER (WHERE i = n // 2) AS p50, max(v) FILTER (WHERE i = floor(n * 0.9)) AS p90, CASE WHEN max(n) >= 100 THEN max(v) FILTER (WHERE i = floor(n * 0.99)) ELSE max(v) END AS p99 FROM r GROUP BY ALL",
)
def histogram_stats(spark, sf):
    return evaluation.histogram_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


_PROFILED = {"orders": ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"]}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT nullif(trim(CAST({c} AS VARCHAR)), '')) AS n_distinct, round(1 - count({c}) / count(*), 6) AS null_rate, {num} AS is_numeric, "
        + (f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c})::DOUBLE, 4) AS mean" if num == "TRUE" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean")
        + " FROM orders"
        for c, num in (("o_orderstatus", "FALSE"), ("o_orderpriority", "FALSE"), ("o_custkey", "TRUE"), ("o_totalprice", "TRUE"))
    ),
)
def column_profile(spark, sf):
    return evaluation.column_profile(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"])


@query("top_values", "SELECT p_type AS value, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type ORDER BY n DESC, first LIMIT 25")
def top_values(spark, sf):
    return evaluation.top_values(table(spark, sf, "part"), "p_type", "p_partkey")


@query("pool_ceiling", f"{_NN} SELECT round(avg((rank IS NOT NULL)::INT), 6) AS in_pool, round(count(*) FILTER (WHERE rank = 1) / greatest(1, count(rank)), 6) AS p_at_1_given_pool FROM ranks")
def pool_ceiling(spark, sf):
    r = F.col("rank")
    return _ranks(spark, sf).agg(F.round(F.avg(r.isNotNull().cast("double")), 6).alias("in_pool"), F.round(F.count_if(r == 1) / F.greatest(F.lit(1), F.count(r)), 6).alias("p_at_1_given_pool"))


@query("leaf_collapse", "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_brand = first_brand) AS same_answer FROM (SELECT p_type, p_brand, first_value(p_brand) OVER (PARTITION BY p_type ORDER BY p_partkey) AS first_brand FROM part) GROUP BY p_type")
def leaf_collapse(spark, sf):
    p = table(spark, sf, "part")
    first = p.groupBy("p_type").agg(F.min_by("p_brand", "p_partkey").alias("first_brand"))
    return p.join(first, "p_type").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_brand") == F.col("first_brand")).alias("same_answer"))


@query("decline_triggers", f"SELECT p_partkey, len(list_intersect(a, b)) = 0 AS lexical_trigger, len(a) <= 1 AS structural_trigger FROM (SELECT p_partkey, {sql.tokens('p_name')} AS a, {sql.tokens('p_type')} AS b FROM part)")
def decline_triggers(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", identifier_tokens(F.col("p_name")).alias("a"), identifier_tokens(F.col("p_type")).alias("b"))
    return rows.select("p_partkey", (~F.arrays_overlap("a", "b")).alias("lexical_trigger"), (F.size("a") <= 1).alias("structural_trigger"))


_OV = f"SELECT len(list_intersect(a, b)) / greatest(1, least(len(a), len(b))) AS o, a = b AS exact FROM (SELECT {sql.tokens('p_name')} AS a, {sql.tokens('p_type')} AS b FROM part)"


@query("overlap_report", f"SELECT count(*) AS n, round(avg(o), 6) AS mean, round(quantile_cont(o, 0.5), 6) AS median, round(avg(exact::INT), 6) AS exact_rate, round(avg((o = 0)::INT), 6) AS zero_rate FROM ({_OV})")
def overlap_report(spark, sf):
    rows = table(spark, sf, "part").select(identifier_tokens(F.col("p_name")).alias("a"), identifier_tokens(F.col("p_type")).alias("b"))
    rows = rows.select((F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.least(F.size("a"), F.size("b")))).alias("o"), (F.col("a") == F.col("b")).alias("exact"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 6).alias("mean"), F.round(F.percentile("o", 0.5), 6).alias("median"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"), F.round(F.avg((F.col("o") == 0).cast("double")), 6).alias("zero_rate"))
