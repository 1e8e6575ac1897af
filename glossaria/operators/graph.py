"""Schema graphs: edges between fields, matching by structure, re-ranking.

Fields: field_key, name, full_path, parent_path, data_type, ordinal. Pairs of
all fields aren't formed: structure is compared between fields that share a
neighbourhood signature (type group), whose distinct signatures are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARENT_CHILD, SIBLING, TYPE_SIMILAR = 1.0, 0.5, 0.3


def type_group(data_type: Column) -> Column:
    return (
        F.when(data_type.isin("integer", "long", "float", "double", "decimal"), "numeric")
        .when(data_type.isin("string", "uuid", "enum"), "string")
        .when(data_type.isin("date", "timestamp"), "temporal")
        .when(data_type.isin("array", "record", "json"), "complex")
        .otherwise(data_type)
    )


def edges(fields: DataFrame, type_edges: bool = True) -> DataFrame:
    """src, dst, kind, weight: parent to child, siblings both ways, and earlier to later of a type group without another edge.

    The type edges of a group are a chain of complete links in the model; they
    are made within (schema, group), so pass ``type_edges=False`` for schemas
    whose groups are large.
    """
    f = fields.select("schema_name", "field_key", "full_path", "parent_path", "ordinal", type_group(F.col("data_type")).alias("g"))
    a = f.select("schema_name", F.col("field_key").alias("src"), F.col("full_path").alias("p"), F.col("ordinal").alias("o1"), F.col("parent_path").alias("pp1"), F.col("g").alias("g1"))
    b = f.select(F.col("schema_name").alias("s2"), F.col("field_key").alias("dst"), F.col("parent_path").alias("pp2"), F.col("ordinal").alias("o2"), F.col("g").alias("g2"))
    child = a.join(b, (F.col("schema_name") == F.col("s2")) & (F.col("p") == F.col("pp2"))).select("src", "dst", F.lit("parent_child").alias("kind"), F.lit(PARENT_CHILD).alias("weight"))
    sibling = a.join(b, (F.col("schema_name") == F.col("s2")) & (F.col("pp1") == F.col("pp2")) & (F.col("pp1") != "")).filter("src <> dst").select("src", "dst", F.lit("sibling").alias("kind"), F.lit(SIBLING).alias("weight"))
    first = child.union(sibling.join(child.select("src", "dst"), ["src", "dst"], "left_anti"))
    if not type_edges:
        return first
    alike = a.join(b, (F.col("schema_name") == F.col("s2")) & (F.col("g1") == F.col("g2"))).filter("o1 < o2").select("src", "dst", F.lit("type_similar").alias("kind"), F.lit(TYPE_SIMILAR).alias("weight"))
    return first.union(alike.join(first.select("src", "dst"), ["src", "dst"], "left_anti"))


def stats(fields: DataFrame, links: DataFrame) -> DataFrame:
    """nodes, edges, max_depth: one row."""
    nodes = fields.agg(F.count_distinct("field_key").alias("nodes"), F.max(F.length("full_path") - F.length(F.replace("full_path", F.lit("."), F.lit("")))).alias("max_depth"))
    n = links.agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(n).select("nodes", "edges", "max_depth")  # two single rows


def profiles(fields: DataFrame, links: DataFrame) -> DataFrame:
    """field_key, depth, length, type, group and the sorted set of the out-neighbours' type groups."""
    g = fields.select(F.col("field_key").alias("dst"), type_group(F.col("data_type")).alias("ng"))
    around = links.join(g, "dst").groupBy(F.col("src").alias("field_key")).agg(F.array_sort(F.collect_set("ng")).alias("around"))
    path = F.col("full_path")
    return fields.select("field_key", (F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))).alias("depth"), F.length("name").alias("len"), "data_type", type_group(F.col("data_type")).alias("g")).join(around, "field_key", "left")


def match_score(left: str = "l", right: str = "r") -> Column:
    """0.4 structure (0.6 depth, 0.4 name length) + 0.3 neighbour types (Jaccard, 0.5 if either has none) + 0.3 type."""
    c = lambda side, name: F.col(f"{side}_{name}")
    near = lambda a, b: 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))
    structure = 0.6 * near(c(left, "depth"), c(right, "depth")) + 0.4 * near(c(left, "len"), c(right, "len"))
    la, ra = c(left, "around"), c(right, "around")
    context = F.when(la.isNull() | ra.isNull(), 0.5).otherwise(F.size(F.array_intersect(la, ra)) / F.size(F.array_union(la, ra)))
    kind = F.when(c(left, "data_type") == c(right, "data_type"), 1.0).when(c(left, "g") == c(right, "g"), 0.8).when((c(left, "data_type") == "string") | (c(right, "data_type") == "string"), 0.3).otherwise(0.0)
    return 0.4 * structure + 0.3 * context + 0.3 * kind


def match(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """l_field_key, r_field_key, score, rank: the best ``k`` fields of ``right`` per field of ``left``.

    Fields with equal profiles score alike, so distinct profiles are compared
    (their number doesn't grow with the schemas) and each keeps its ``k``
    smallest keys.
    """
    from pyspark.sql import Window

    p = ["depth", "len", "data_type", "g", "around"]
    lp = left.groupBy(*p).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(x).alias(f"l_{x}") for x in p])
    first = right.withColumn("_r", F.row_number().over(Window.partitionBy(*p).orderBy("field_key"))).filter(F.col("_r") <= k)
    rp = first.select(*[F.col(x).alias(f"r_{x}") for x in p], F.col("field_key").alias("r_field_key"))
    scored = lp.withColumn("_j", F.lit(1)).join(rp.withColumn("_j", F.lit(1)), "_j").withColumn("score", F.round(match_score(), 6))
    order = Window.partitionBy(*[f"l_{x}" for x in p]).orderBy(F.desc("score"), "r_field_key")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    on = [F.col(x).eqNullSafe(F.col(f"l_{x}")) for x in p]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(best, cond).select(F.col("field_key").alias("l_field_key"), "r_field_key", "score", "rank")


def rerank(semantic: DataFrame, structural: DataFrame, alpha: float = 0.6) -> DataFrame:
    """query_id, doc_id, score: alpha * semantic + (1 - alpha) * graph score, none counting as 0."""
    rows = semantic.join(structural.withColumnRenamed("score", "_g"), ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", F.round(alpha * F.col("score") + (1 - alpha) * F.coalesce("_g", F.lit(0.0)), 6).alias("score"))
