"""Evidence for reviewers, consistency of answers, and standing verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.identifiers import concept_label

RESOLUTION = 1e-6
SIGNALS = ("s1", "s2", "s3", "s4", "s5")


def contrast_top_two(matches: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """field_key, status, gap, and per signal delta, weighted, separating, deciding; ``largest`` names the heaviest.

    SEPARATED: the two best differ by more than the resolution. A deciding
    signal's weighted difference accounts for the whole gap.
    """
    best = matches.filter("rank <= 2").groupBy("field_key").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in ("confidence", *SIGNALS)])
    best = best.filter("confidence_2 is not null").withColumn("gap", F.round(F.col("confidence_1") - F.col("confidence_2"), 6))
    separated = F.col("gap") > RESOLUTION
    parts = [
        F.struct(F.lit(i).alias("o"), F.lit(s).alias("signal"), F.round(F.col(f"{s}_1") - F.col(f"{s}_2"), 6).alias("delta"), F.round(w * (F.col(f"{s}_1") - F.col(f"{s}_2")), 6).alias("weighted")) for i, (s, w) in enumerate(zip(SIGNALS, weights))
    ]
    rows = best.withColumn("status", F.when(separated, "SEPARATED").otherwise("TIED")).withColumn("p", F.array(*parts))
    apart = F.filter("p", lambda x: F.abs(x["delta"]) > RESOLUTION)
    heaviest = F.array_min(F.transform(apart, lambda x: F.struct((-F.abs(x["weighted"])).alias("k"), x["o"].alias("o"), x["signal"].alias("signal"))))
    rows = rows.withColumn("largest", F.when(separated, heaviest["signal"]))
    one = rows.select("field_key", "status", "gap", "largest", F.explode("p").alias("x"))
    separating = F.abs(F.col("x.delta")) > RESOLUTION
    deciding = separating & (F.col("x.weighted") > 0) & (F.col("gap") - F.col("x.weighted") <= RESOLUTION)
    return one.select("field_key", "status", "gap", "largest", "x.signal", "x.delta", "x.weighted", separating.alias("separating"), deciding.alias("deciding"))


def concept_groups(fields: DataFrame, least: int = 2) -> DataFrame:
    """concept, n, members: columns that mean the same by qualifier, leaf tokens and type."""
    label = concept_label(F.col("qualifier"), F.col("name"), F.col("data_type"))
    return fields.groupBy(label.alias("concept")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("field_key")), ",").alias("members")).filter(F.col("n") >= least)


def consistency(answers: DataFrame) -> DataFrame:
    """concept, verdict, majority, majority_n for ``answers`` (concept, answer; null: undecided)."""
    counts = answers.filter("answer is not null").groupBy("concept", "answer").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("concept").orderBy(F.desc("c"), "answer")
    ranked = counts.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy("concept"))).withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("concept")))
    first = ranked.filter("r = 1").select("concept", "answer", "c", "all", "kinds", (F.col("next").isNull() | (F.col("c") > F.col("next"))).alias("ahead"))
    rows = answers.select("concept").distinct().join(first, "concept", "left")
    verdict = F.when(F.coalesce("all", F.lit(0)) < 2, "UNDECIDED").when(F.col("kinds") == 1, "AGREE").otherwise("DISAGREE")
    return rows.select("concept", verdict.alias("verdict"), F.when(F.col("ahead"), F.col("answer")).alias("majority"), F.when(F.col("ahead"), F.col("c")).otherwise(0).alias("majority_n"))


def standing_verdicts(events: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The latest verdict of each field unless REJECTED (field_key, entry_id, verdict), and how many were revoked.

    ``events``: field_key, entry_id, verdict and the columns of ``order``. A
    rejection revokes if a verdict stood just before it.
    """
    w = Window.partitionBy("field_key").orderBy(*order)
    revoked = events.select("verdict", F.lag("verdict").over(w).alias("p")).filter("verdict = 'REJECTED' and p is not null and p <> 'REJECTED'").count()
    last = events.groupBy("field_key").agg(F.max_by(F.struct("entry_id", "verdict"), F.struct(*order)).alias("v"))
    return last.select("field_key", "v.entry_id", "v.verdict").filter("verdict <> 'REJECTED'"), revoked


def bind(verdicts: DataFrame, entries: DataFrame, bound: DataFrame) -> DataFrame:
    """``verdicts`` with outcome against the current glossary.

    ``entries``: entry_id, fingerprint; ``bound``: entry_id, fingerprint when
    last bound. missing and bound before: retired; missing: unresolved;
    fingerprint changed: invalidated; UNSPECIFIED verdicts bind as ambiguous.
    """
    rows = verdicts.join(entries.select("entry_id", F.col("fingerprint").alias("_now")), "entry_id", "left").join(bound.select("entry_id", F.col("fingerprint").alias("_then")), "entry_id", "left")
    outcome = (
        F.when(F.col("_now").isNull() & F.col("_then").isNotNull(), "retired")
        .when(F.col("_now").isNull(), "unresolved")
        .when(F.col("_then").isNotNull() & (F.col("_then") != F.col("_now")), "invalidated")
        .when(F.col("verdict") == "UNSPECIFIED", "ambiguous")
        .otherwise("bound")
    )
    return rows.withColumn("outcome", outcome).drop("_now", "_then")


def fingerprint(content_hash: Column, code: Column) -> Column:
    return F.sha2(F.concat_ws("|", content_hash, F.coalesce(code, F.lit(""))), 256)


def unique_keys(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``rows`` with ``result_key``: the n-th row of a key gets ``#n``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    return rows.withColumn("_n", n).withColumn("result_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat_ws("#", F.col(key), F.col("_n").cast("string")))).drop("_n")


def lookup(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Every asked id with its entry's columns, null where there is none."""
    return ids.join(entries, "entry_id", "left")


def missing(ids: DataFrame, entries: DataFrame) -> DataFrame:
    return ids.join(entries.select("entry_id"), "entry_id", "left_anti")
