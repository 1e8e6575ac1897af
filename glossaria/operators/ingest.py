"""Loading glossaries: header mapping, admission, validation, ids, metadata, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.constants import COLUMN_ALIASES


def _header(name: str) -> str:
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def map_columns(columns: list[str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Field -> source column: the first alias that an unused column has; ``explicit`` comes first."""
    out = dict(explicit or {})
    if unknown := [c for c in out.values() if c not in columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    by: dict[str, str] = {}
    for c in columns:
        by.setdefault(_header(c), c)
    for field, names in COLUMN_ALIASES.items():
        if field not in out:
            found = next((by[n] for n in names if n in by and by[n] not in out.values()), None)
            if found is not None:
                out[field] = found
    return out


def map_frame(df: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """The mapped fields as columns, and the others in ``source_metadata``."""
    found = map_columns(df.columns, explicit)
    rest = [c for c in df.columns if c not in found.values()]
    fields = [F.trim(F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit(""))).alias(f) if f in found else F.lit("").alias(f) for f in COLUMN_ALIASES]
    pairs = [x for c in rest for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*fields, F.map_filter(extra, lambda k, v: v != "").alias("source_metadata"))


def _folded(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))))


def _accepted(admit: dict[str, list[str]], columns: list[str]) -> None:
    if unknown := [c for c in admit if c not in columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    if empty := [c for c, values in admit.items() if not values]:
        raise ValueError(f"no accepted values for {', '.join(empty)}")


def admit_rows(df: DataFrame, admit: dict[str, list[str]]) -> DataFrame:
    """Rows whose every named column has an accepted value (case and outer blanks ignored)."""
    _accepted(admit, df.columns)
    for c, values in admit.items():
        df = df.filter(_folded(c).isin(*[v.strip().lower() for v in values]))
    return df


def refused_by_column(df: DataFrame, admit: dict[str, list[str]]) -> DataFrame:
    """column, refused: refused rows by the first column that refuses them."""
    _accepted(admit, df.columns)
    first = F.coalesce(*[F.when(~_folded(c).isin(*[v.strip().lower() for v in values]), F.lit(c)) for c, values in admit.items()])
    return df.select(first.alias("column")).filter("column is not null").groupBy("column").agg(F.count(F.lit(1)).alias("refused"))


def require_admitted(df: DataFrame) -> DataFrame:
    if not df.limit(1).count():
        raise ValueError("no row is admitted")
    return df


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a business name, and the others with ``reason``."""
    reason = F.concat_ws(", ", F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.lit("no id")), F.when(F.coalesce(F.trim("business_name"), F.lit("")) == "", F.lit("no business name")))
    marked = df.withColumn("reason", reason)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def load_report(df: DataFrame) -> DataFrame:
    """One row: rows, unmatchable (neither name nor definition), loaded, with_definition, with_domain, distinct_names."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = blank("business_name") & blank("definition")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(none).alias("unmatchable"),
        F.count_if(~none).alias("loaded"),
        F.count_if(~none & ~blank("definition")).alias("with_definition"),
        F.count_if(~none & ~blank("domain")).alias("with_domain"),
        F.count_distinct(F.when(~none, F.lower(F.trim("business_name")))).alias("distinct_names"),
    )


def load_stats(df: DataFrame, error: Column) -> DataFrame:
    """total, succeeded, failed, success_rate, with ``error`` null for good rows."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(error.isNull()).alias("succeeded"), F.count_if(error.isNotNull()).alias("failed"), F.round(F.count_if(error.isNull()) / F.count(F.lit(1)), 6).alias("success_rate"))


def entry_ids(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``df`` with ``entry_id``: the source id, else a hash of the names; the n-th equal derived id gets ``-n``."""
    base = F.substring(F.sha2(F.concat_ws("|", "business_name", "logical_name"), 256), 1, 16)
    own = F.nullif(F.trim("id"), F.lit(""))
    marked = df.withColumn("_base", F.when(own.isNull(), base)).withColumn("_key", F.coalesce(own, base))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(ordinal))
    return marked.withColumn("_n", n).withColumn("entry_id", F.when(F.col("_base").isNull(), F.col("_key")).when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_n"))).drop("_base", "_key", "_n")


def bound_metadata(df: DataFrame, most: int = 1024, column: str = "source_metadata") -> DataFrame:
    """``df`` with the map's largest entries dropped until key and value bytes are ``most`` at most; ``metadata_truncated`` tells."""
    sized = F.transform(F.map_entries(column), lambda e: F.struct((F.octet_length(e["key"]) + F.octet_length(e["value"])).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    ordered = F.array_sort(sized)  # smallest first; the kept ones are a prefix
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("keep"))
    kept = F.aggregate(ordered, zero, lambda s, e: F.struct((s["total"] + e["n"]).alias("total"), (s["keep"] + (s["total"] + e["n"] <= most).cast("int")).alias("keep")))["keep"]
    entries = F.transform(F.slice(ordered, F.lit(1), kept), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    return df.withColumn("metadata_truncated", kept < F.size(column)).withColumn(column, F.map_from_entries(entries))


def delimiter_shares(cells: DataFrame, candidates: dict[str, str]) -> DataFrame:
    """name, share: part of the non-empty ``cells`` (cell) with each candidate delimiter in them, and ``n``."""
    full = cells.filter(F.coalesce("cell", F.lit("")) != "")
    row = full.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(F.col("cell").contains(d).cast("double")), F.lit(0.0)).alias(name) for name, d in candidates.items()])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.round(F.col(name), 6).alias("share")) for name in candidates])).alias("s")).select("s.name", "s.share", "n")


def wrong_delimiter(shares: DataFrame, declared: str) -> DataFrame:
    """The delimiter that the file seems to have, if the declared one splits almost nothing: one row or none."""
    own = shares.filter(F.col("name") == declared).select(F.col("share").alias("own"))
    best = shares.filter(F.col("name") != declared).agg(F.max_by("name", F.struct("share", "name")).alias("name"), F.max("share").alias("share"), F.max("n").alias("n"))
    return best.join(own).filter((F.col("n") >= 3) & (F.col("own") <= 0.05) & (F.col("share") >= 0.6)).select("name", "share")


def value_tally(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The most frequent values, ties by value."""
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(most)


def nth_occurrence_join(left: DataFrame, right: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Pairs the n-th row of each key on both sides; left rows without a partner keep nulls."""
    n = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal)))
    return n(left).join(n(right).drop(ordinal), [key, "_n"], "left").withColumnRenamed("_n", "occurrence")


def fill_merged(df: DataFrame, column: str, group: str, ordinal: str, ends: DataFrame | None = None) -> DataFrame:
    """Empty cells take the last value above them within their group; with ``ends`` (group, last) only inside the merged range."""
    last = F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(Window.partitionBy(group).orderBy(ordinal))
    filled = df.withColumn("_filled", last)
    if ends is not None:
        filled = filled.join(ends.withColumnRenamed("last", "_last"), group, "left")
        return filled.withColumn(column, F.when(F.col(ordinal) <= F.col("_last"), F.col("_filled")).otherwise(F.col(column))).drop("_filled", "_last")
    return filled.withColumn(column, F.col("_filled")).drop("_filled")


def validate_abbreviations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Abbreviation rows (short, expansion), trimmed, and the bad ones with ``reason``: empty, or its own expansion."""
    rows = df.select(F.trim(F.coalesce("short", F.lit(""))).alias("short"), F.trim(F.coalesce("expansion", F.lit(""))).alias("expansion"))
    reason = F.when((F.col("short") == "") | (F.col("expansion") == ""), F.lit("empty")).when(F.lower("short") == F.lower("expansion"), F.lit("expands to itself"))
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
