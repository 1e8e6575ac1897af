"""Domain trees: closure, relations and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions.constants import RELATION_SCORES, UNKNOWN_DOMAIN_SCORE

DEPTH = 12


def closure(tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """name, ancestor, distance (0: itself) for ``tree`` (name, parent).

    Joins on the parent until a step adds nothing, ``depth`` at most; each step joins only the last step's rows.
    """
    step = tree.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("distance"), F.col("parent").alias("next"))
    out = step
    up = tree.select(F.col("name").alias("_name"), F.col("parent").alias("_parent"))
    for n in range(1, depth + 1):
        step = step.join(up, F.col("next") == F.col("_name")).select("name", F.col("next").alias("ancestor"), F.lit(n).alias("distance"), F.col("_parent").alias("next"))
        out = out.union(step)
        if step.limit(1).count() == 0:
            break
    return out.select("name", "ancestor", "distance")


def paths(tree: DataFrame) -> DataFrame:
    """name, path (root first), depth."""
    rows = closure(tree).groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor"))).alias("a"), F.max("distance").alias("depth"))
    return rows.select("name", F.array_join("a.ancestor", "/").alias("path"), "depth")


def relations(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with relation and score; names are trimmed and upper-cased.

    PARENT: a is above b. A name outside the tree scores as unknown.
    """
    up = closure(tree)
    wanted = pairs.select("a", "b").distinct().withColumn("_a", F.upper(F.trim("a"))).withColumn("_b", F.upper(F.trim("b")))
    left = up.select(F.col("name").alias("_a"), F.col("ancestor").alias("_x"), F.col("distance").alias("da"))
    right = up.select(F.col("name").alias("_b"), F.col("ancestor").alias("_y"), F.col("distance").alias("db"))
    common = wanted.join(left, "_a").join(right, "_b").filter("_x = _y").groupBy("a", "b").agg(F.min(F.struct(F.col("db"), F.col("da"))).alias("m"))
    known = wanted.join(tree.select(F.col("name").alias("_a"), F.lit(True).alias("ka")), "_a", "left").join(tree.select(F.col("name").alias("_b"), F.lit(True).alias("kb")), "_b", "left")
    rows = known.join(common, ["a", "b"], "left")
    da, db = F.col("m.da"), F.col("m.db")
    relation = (
        F.when((da == 0) & (db == 0), "EXACT").when(da == 0, "PARENT").when(db == 0, "CHILD").when((da == 1) & (db == 1), "SIBLING").when((da <= 2) & (db <= 2), "COUSIN").otherwise("UNRELATED")
    )
    scores = F.create_map(*[F.lit(x) for kv in RELATION_SCORES.items() for x in kv])
    unknown = F.col("ka").isNull() | F.col("kb").isNull()
    return rows.select("a", "b", relation.alias("relation"), F.when(unknown, F.lit(UNKNOWN_DOMAIN_SCORE)).otherwise(scores[relation]).alias("score"))
