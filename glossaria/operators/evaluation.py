"""Retrieval metrics, calibration, tests of differences, and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.scratch import materialise


def gold_ranks(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank of the best gold id (null if none is ranked) for ``rankings`` (query_id, doc_id, rank) and ``gold`` (query_id, gold_id)."""
    hit = gold.join(rankings, (gold["query_id"] == rankings["query_id"]) & (gold["gold_id"] == rankings["doc_id"]), "left")
    return hit.groupBy(gold["query_id"]).agg(F.min(rankings["rank"]).alias("rank"))


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """n, p_at_k / recall_at_k for each k, mrr_at_10: missing ranks count 0."""
    share = lambda test: F.round(F.avg(F.coalesce(test.cast("double"), F.lit(0.0))), 6)
    r = F.col("rank")
    return ranks.agg(F.count(F.lit(1)).alias("n"), *[share(r <= k).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)), 6).alias("mrr_at_10"))


def observations(truth: DataFrame, tops: DataFrame) -> DataFrame:
    """``truth`` (key, truth_class, correct_ids, trap_id) with the run's top id, confidence, gap, verdict and flags."""
    rows = truth.join(tops, "key", "left")
    top = F.col("top_id")
    return rows.withColumns(
        {"answerable": F.size("correct_ids") > 0, "correct": F.coalesce(F.array_contains("correct_ids", top), F.lit(False)), "abstained": F.coalesce(F.col("verdict") == "NO_MATCH", F.lit(True)), "trapped": F.coalesce(top == F.col("trap_id"), F.lit(False))}
    )


def scored(obs: DataFrame) -> DataFrame:
    """p@1 on answerable, abstention on unanswerable, false abstention, trap hits, automatic coverage and precision."""
    share = lambda hit, base: F.round(F.when(F.count_if(base) > 0, F.count_if(hit & base) / F.count_if(base)), 6)
    yes, auto = F.col("answerable"), F.coalesce(F.col("verdict") == "AUTO_APPROVE", F.lit(False))
    return obs.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("correct") & ~F.col("abstained"), yes).alias("p_at_1"),
        share(F.col("abstained"), ~yes).alias("abstention"),
        share(F.col("abstained"), yes).alias("false_abstention"),
        share(F.col("trapped"), F.col("trap_id").isNotNull()).alias("trap_hit"),
        share(auto, F.lit(True)).alias("auto_coverage"),
        share(F.col("correct"), auto).alias("auto_precision"),
    )


def threshold_sweep(rows: DataFrame, thresholds: list[float], min_gap: float) -> DataFrame:
    """threshold, n_auto, coverage, precision for ``rows`` (confidence, gap, correct).

    One pass: every row adds to the thresholds it reaches.
    """
    ts = F.array(*[F.lit(t) for t in thresholds])
    total = rows.count()
    reached = rows.filter(F.col("gap") >= min_gap).select("correct", F.explode(F.filter(ts, lambda t: F.col("confidence") >= t)).alias("threshold"))
    n = reached.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_auto"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("precision"))
    grid = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return grid.join(n, "threshold", "left").select("threshold", F.coalesce("n_auto", F.lit(0).cast("long")).alias("n_auto"), F.round(F.coalesce("n_auto", F.lit(0)) / max(1, total), 6).alias("coverage"), "precision")


def recommended_thresholds(sweep: DataFrame, targets: list[float]) -> DataFrame:
    """target, threshold, coverage: the largest coverage whose precision reaches each target."""
    hit = sweep.select("threshold", "coverage", F.explode(F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: F.col("precision") >= t)).alias("target"))
    return hit.groupBy("target").agg(F.min_by("threshold", F.struct((-F.col("coverage")).alias("c"), "threshold")).alias("threshold"), F.max("coverage").alias("coverage"))


def running_sums(rows: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with ``before_<value>``: the sum over all rows before in ``order``, which must not tie.

    Rows are range-partitioned; a task sums its own range, and only one total
    for each range meets in one task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "running-sums")
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    over = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    base = totals.select("_r", *[(F.sum(f"_t_{v}").over(over) - F.col(f"_t_{v}")).alias(f"_b_{v}") for v in values])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(base, F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, *[(F.col(f"_b_{v}") + F.sum(v).over(own) - F.col(v)).alias(f"before_{v}") for v in values])


def value_places(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, value, c, lo, hi, n: each distinct value's places [lo, hi) among the n sorted ones of its group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    placed = running_sums(counts, [F.col(x) for x in (*by, value)], ["c"])
    groups = placed.groupBy(*[F.col(x).alias(f"_g{i}") for i, x in enumerate(by)]).agg(F.min("before_c").alias("_start"), F.sum("c").alias("n"))
    same = [F.col(x).eqNullSafe(F.col(f"_g{i}")) for i, x in enumerate(by)] or [F.lit(True)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    lo = F.col("before_c") - F.col("_start")
    return placed.join(groups, on).select(*by, value, "c", lo.alias("lo"), (lo + F.col("c")).alias("hi"), "n")


def histogram_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, sum, min, max, avg, p50, p90, p99 per group: quantiles by index; p99 is the maximum under 100 values."""
    placed = value_places(rows, by, value)
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col(value)))
    n = F.col("n")
    # sums and averages over the rows themselves, so that they are those of a plain aggregate
    plain = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(value), 4).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("avg"))
    marks = placed.groupBy(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(by)]).agg(
        at(F.floor(n / 2)).alias("p50"), at(F.floor(n * F.lit(0.9))).alias("p90"), F.when(F.max(n) >= 100, at(F.floor(n * F.lit(0.99)))).otherwise(F.max(value)).alias("p99")
    )
    on = F.lit(True)
    for i, x in enumerate(by):
        on = on & F.col(x).eqNullSafe(F.col(f"_k{i}"))
    return plain.join(marks, on).select(*by, "count", "sum", "min", "max", "avg", "p50", "p90", "p99")


def auc(rows: DataFrame) -> DataFrame:
    """auc, n_pos, n_neg for ``rows`` (score, positive): by rank sums over distinct scores, ties half."""
    by = rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    below = running_sums(by, [F.col("score")], ["q"])
    return below.agg(F.round(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)) / (F.sum("p") * F.sum("q")), 6).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))


def youden_floor(rows: DataFrame, most: int = 2000) -> DataFrame:
    """floor, j: the score at which true less false positive rate is largest, smaller floors first."""
    by = rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    total = by.agg(F.sum("p"), F.sum("q")).first()
    run = running_sums(by, [F.desc("score")], ["p", "q"]).select("score", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_q") + F.col("q")).alias("fp"))
    j = F.round(F.col("tp") / max(1, total[0] or 0) - F.col("fp") / max(1, total[1] or 0), 6)
    return run.select(F.col("score").alias("floor"), j.alias("j")).orderBy(F.desc("j"), "floor").limit(1)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """both, gained, lost, neither, p for ``pairs`` (a, b booleans): exact two-sided binomial tail."""
    counts = pairs.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & F.col("b")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))

    @F.pandas_udf("double")
    def tail(gained, lost):
        from math import exp, lgamma, log

        import pandas as pd

        def p(g, x):
            n, k = int(g + x), int(min(g, x))
            if not n:
                return 1.0
            return min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(k + 1)))

        return pd.Series([p(g, x) for g, x in zip(gained, lost)])

    return counts.withColumn("p", F.round(tail("gained", "lost"), 6))


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, mean_a, mean_b, delta over the keys of both (key, value)."""
    rows = a.select("key", F.col("value").alias("va")).join(b.select("key", F.col("value").alias("vb")), "key")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("va"), 6).alias("mean_a"), F.round(F.avg("vb"), 6).alias("mean_b"), F.round(F.avg(F.col("vb") - F.col("va")), 6).alias("delta"))


def _uniform(*of) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def bootstrap_ci(rows: DataFrame, draws: int = 200, seed: int = 3, level: float = 0.95) -> DataFrame:
    """mean, low, high of ``rows`` (key, delta): Poisson bootstrap, whose weights are hashed from key and draw.

    Weights need no joint resampling, so each draw is a partial sum.
    """
    u = _uniform("key", "draw", F.lit(seed))
    steps, total, term = F.lit(0), 0.0, 1.0
    for i in range(8):  # inverse of the Poisson(1) distribution function
        total += term * 0.36787944117144233
        steps = steps + (u >= total).cast("int")
        term /= i + 1
    drawn = rows.select("key", "delta", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", steps)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("m"))
    ci = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return rows.agg(F.avg("delta").alias("mean")).join(ci).select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))  # single rows


def sign_flip(rows: DataFrame, draws: int = 500, seed: int = 9) -> DataFrame:
    """observed, p of ``rows`` (key, delta) under random signs hashed from key and draw."""
    sign = F.when(_uniform("key", "draw", F.lit(seed)) < 0.5, -1.0).otherwise(1.0)
    drawn = rows.select("key", "delta", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).groupBy("draw").agg(F.sum(sign * F.col("delta")).alias("s"))
    observed = rows.agg(F.sum("delta")).first()[0] or 0.0
    return drawn.agg(F.round(F.lit(observed), 6).alias("observed"), F.round((F.count_if(F.abs("s") >= abs(observed) - 1e-12) + 1) / (F.count(F.lit(1)) + 1), 6).alias("p"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_distinct, null_rate, is_numeric, min, max, mean: one pass; blanks count as null."""
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    num = lambda c: F.expr(f"try_cast(nullif(trim(cast(`{c}` AS string)), '') AS double)")
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(text(c)).alias(f"f{i}"), F.count_distinct(text(c)).alias(f"d{i}"), F.count(num(c)).alias(f"k{i}"), F.min(num(c)).alias(f"a{i}"), F.max(num(c)).alias(f"b{i}"), F.avg(num(c)).alias(f"m{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    numeric = lambda i: (F.col(f"f{i}") > 0) & (F.col(f"f{i}") == F.col(f"k{i}"))
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("n"),
            F.col(f"d{i}").alias("n_distinct"),
            F.round(F.when(F.col("n") > 0, 1 - F.col(f"f{i}") / F.col("n")).otherwise(0.0), 6).alias("null_rate"),
            numeric(i).alias("is_numeric"),
            F.when(numeric(i), F.round(f"a{i}", 4)).alias("min"),
            F.when(numeric(i), F.round(f"b{i}", 4)).alias("max"),
            F.when(numeric(i), F.round(f"m{i}", 4)).alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def top_values(df: DataFrame, column: str, ordinal: str, most: int = 25) -> DataFrame:
    """value, n, first: the most frequent values (60 characters), ties by first appearance."""
    value = F.substring(F.trim(F.col(f"`{column}`").cast("string")), 1, 60)
    counts = df.select(value.alias("value"), F.col(ordinal).alias("_o")).filter("value is not null and value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(most)


def confidence_profile(rows: DataFrame, value: str, bars: tuple[float, ...] = (0.5, 0.87)) -> DataFrame:
    """n, min, p25, median, max (by index) and the share at or above each bar."""
    placed = value_places(rows, [], value)
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col(value)))
    n, all_ = F.col("n"), F.sum("c")
    shares = [F.round(F.coalesce(F.sum(F.when(F.col(value) >= b, F.col("c"))), F.lit(0)) / all_, 6).alias(f"share_{int(b * 100)}") for b in bars]
    return placed.agg(F.coalesce(all_, F.lit(0)).alias("n"), F.min(value).alias("min"), at(F.floor(n / 4)).alias("p25"), at(F.floor(n / 2)).alias("median"), F.max(value).alias("max"), *shares)


def cache_statistics(requests: DataFrame, key: str, at: str, ttl_seconds: float | None = None) -> DataFrame:
    """requests, hits, misses, evictions, hit_rate of a cache of unbounded size in which an entry lives ``ttl_seconds`` after its last request.

    A request hits if its key was asked for within that time before; what
    outlives the time is an eviction when it is asked for again.
    """
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = (micros(at) - micros("_before")) / 1e6
    rows = requests.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at).withColumn("_before", before)
    fresh = F.col("_before").isNotNull() & (F.lit(True) if ttl_seconds is None else age <= ttl_seconds)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("requests"), F.count_if(fresh).alias("hits"), F.count_if(~fresh).alias("misses"), F.count_if(~fresh & F.col("_before").isNotNull()).alias("evictions"), F.round(F.when(n > 0, F.count_if(fresh) / n).otherwise(0.0), 6).alias("hit_rate"))


def fusion_sweep(dense: DataFrame, sparse: DataFrame, gold: DataFrame, alphas: tuple[float, ...], k: int = 5) -> DataFrame:
    """alpha, queries, at_1, at_k: how many gold pairs (query_id, gold_id) linear fusion puts first, and among the first k."""
    from glossaria.operators import fusion

    d, s, g = fusion.ranked(dense, "dense"), fusion.ranked(sparse, "sparse"), gold.select("query_id", "gold_id")
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    rows = both.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    rows = rows.withColumn("fused", F.round(F.col("alpha") * F.coalesce("dense_norm", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("sparse_norm", F.lit(0.0)), 6))
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "doc_id")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("alpha", "query_id", "doc_id", "rank")
    asked = g.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    hit = asked.join(top, (asked["alpha"] == top["alpha"]) & (asked["query_id"] == top["query_id"]) & (asked["gold_id"] == top["doc_id"]), "left").select(asked["alpha"].alias("alpha"), "rank")
    return hit.groupBy("alpha").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("rank") == 1).alias("at_1"), F.count("rank").alias("at_k"))
