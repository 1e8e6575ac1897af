"""Protection classes: resolving codes, checking rows against the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions.types import parse_flag


def norm_code(code: Column) -> Column:
    """Upper-case letters and digits (composed form is up to the input)."""
    return F.regexp_replace(F.upper(code), r"[^\p{L}\p{N}]", "")


def norm_tier(tier: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(tier, r"\s+", " ")))


def resolve(entries: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entries`` (id, code) with status and class_code.

    absent: no code; known: a class, directly or by an alias; dropped: an alias of nothing; unknown: neither.
    The vocabulary is small; joins are left to the planner.
    """
    keyed = entries.withColumn("_key", norm_code(F.coalesce("code", F.lit(""))))
    direct = classes.select(norm_code(F.col("code")).alias("_key"), F.col("code").alias("_direct"))
    by_alias = aliases.select(norm_code(F.col("token")).alias("_key"), norm_code(F.col("target")).alias("_target"), F.lit(True).alias("_alias"))
    targets = classes.select(norm_code(F.col("code")).alias("_target"), F.col("code").alias("_via"))
    rows = keyed.join(direct, "_key", "left").join(by_alias, "_key", "left").join(targets, "_target", "left")
    status = F.when(F.col("_key") == "", "absent").when(F.coalesce("_direct", "_via").isNotNull(), "known").when(F.col("_alias") & F.col("_target").isNull(), "dropped").otherwise("unknown")
    return rows.withColumn("status", status).withColumn("class_code", F.when(F.col("_key") != "", F.coalesce("_direct", "_via"))).drop("_key", "_target", "_direct", "_alias", "_via")


def problems(rows: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, problems: what a row's own tier and flags contradict in its class (columns classification, personal, direct)."""
    c = classes.select(F.col("code").alias("class_code"), F.col("classification").alias("_tier"), F.col("personal_information").alias("_pi"), F.col("direct_identifier").alias("_di"))
    got = resolve(rows, classes, aliases).join(c, "class_code", "left")
    says = F.nullif(F.trim("classification"), F.lit(""))
    found = F.array_compact(
        F.array(
            F.when(F.col("status") == "unknown", F.lit("unknown code")),
            F.when((F.col("status") == "known") & says.isNotNull() & (norm_tier(says) != norm_tier(F.col("_tier"))), F.lit("classification")),
            F.when((F.col("status") == "known") & (parse_flag(F.col("personal")) != F.col("_pi")), F.lit("personal information")),
            F.when((F.col("status") == "known") & (parse_flag(F.col("direct")) != F.col("_di")), F.lit("direct identifier")),
        )
    )
    return got.select("id", found.alias("problems")).filter(F.size("problems") > 0)


def unresolved(entries: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries whose code is neither a class nor an alias; strict loading refuses any."""
    return resolve(entries, classes, aliases).filter("status = 'unknown'").select("id", "code")


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Ids in both whose code differs (null is a value)."""
    rows = previous.select("id", F.col("code").alias("before")).join(current.select("id", F.col("code").alias("after")), "id")
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def check_vocabulary(document: dict) -> dict:
    """A vocabulary document (classes as list or by code, aliases, tiers, open classification), checked."""
    classes = document.get("classes", document if "classes" not in document and "tiers_most_open_first" not in document else [])
    if isinstance(classes, dict):
        classes = [{"code": code, **row} for code, row in classes.items()]
    clean = lambda s: "".join(ch for ch in str(s).upper() if ch.isalnum())
    codes = [clean(c["code"]) for c in classes]
    if len(set(codes)) < len(codes) or "" in codes:
        raise ValueError("class codes must be distinct and not empty")
    aliases = document.get("aliases", {})
    for token, target in aliases.items():
        if clean(token) in codes:
            raise ValueError(f"alias {token} is a class code")
        if target is not None and clean(target) not in codes:
            raise ValueError(f"alias {token} has an unknown target")
    tiers = document.get("tiers_most_open_first", [])
    fold = lambda t: " ".join(str(t).split()).casefold()
    known = {fold(t) for t in tiers}
    if len(known) < len(tiers):
        raise ValueError("a tier occurs twice")
    if tiers and (missing := [c["code"] for c in classes if fold(c.get("classification", "")) not in known]):
        raise ValueError(f"classes without a tier in the order: {', '.join(missing)}")
    if tiers and "open_classification" in document and fold(document["open_classification"]) not in known:
        raise ValueError("the open classification is no tier")
    return {"classes": classes, "aliases": aliases, "tiers_most_open_first": tiers, "open_classification": document.get("open_classification")}


def frames(spark, vocabulary: dict) -> tuple[DataFrame, DataFrame]:
    """Classes and aliases of a checked vocabulary."""
    c = [(r["code"], r.get("name"), r.get("classification"), r.get("personal_information"), r.get("direct_identifier")) for r in vocabulary["classes"]]
    return spark.createDataFrame(c, "code string, name string, classification string, personal_information boolean, direct_identifier boolean"), spark.createDataFrame(list(vocabulary["aliases"].items()), "token string, target string")
