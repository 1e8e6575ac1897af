"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set; a partition fixes how
many minhashes stand for an item (all of a small item's shingles, or the
minima under ``HASHES`` orderings). The share of an item's minima that a
document holds estimates the share of the item that it contains, whatever the
document's length, so a document becomes a candidate of an item when it holds
one of its minima and is large enough for it. At a containment of 0.8, an item
of n minima is missed with probability 0.2**n. Candidates are verified by the
exact containment of the item's distinct shingles.

Everything is DataFrame expressions. The minima are broadcast only while
their counted number is below ``BROADCAST_ROWS``; beyond, they are joined by
shuffling.

Defined results: text is lower-cased, runs of anything but letters and digits
separate words; items of fewer than ``k`` words and null texts are never
found; a null doc_id or item_id is never reported; repeated rows count once;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.storage import free_name, materialise

K = 5
PERCENT = 80
HASHES = 16
BROADCAST_ROWS = 200_000


def word_array(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(k)])


def shingle_rows(df: DataFrame, key: str, k: int) -> DataFrame:
    """key, n (number of word runs), h: one row for each run of ``k`` words."""
    split = df.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias(key), word_array(F.col("text")).alias("_w"))
    split = split.filter(F.size("_w") >= k)
    each = split.select(key, "_w", (F.size("_w") - k + 1).alias("n"), F.explode(F.sequence(F.lit(0), F.size("_w") - k)).alias("_at"))
    return each.select(key, "n", _shingle("_w", F.col("_at"), k).alias("h"))


def item_minima(items: DataFrame, hashes: int = HASHES) -> DataFrame:
    """item_id, n_item, h: the shingles that stand for each item.

    ``items`` has item_id and h, distinct. The orderings are h xor a mask.
    """
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), *[F.min_by("h", F.col("h").bitwiseXOR(F.xxhash64(F.lit(j)))).alias(f"_m{j}") for j in range(hashes)])
    large = sizes.filter(F.col("n_item") > hashes).select("item_id", "n_item", F.explode(F.array_distinct(F.array(*[f"_m{j}" for j in range(hashes)]))).alias("h"))
    small = items.join(sizes.filter(F.col("n_item") <= hashes).select(F.col("item_id").alias("_i"), "n_item"), F.col("item_id") == F.col("_i")).select("item_id", "n_item", "h")
    return large.union(small)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_matched for every contained item."""
    items = materialise(shingle_rows(benchmark, "item_id", k).select("item_id", "h").distinct(), "benchmark-shingles")
    minima = materialise(item_minima(items), "benchmark-minima")
    small = minima.count() <= BROADCAST_ROWS
    probe = minima.select(F.col("h").alias("_h"), "item_id", "n_item")
    rows = shingle_rows(docs, "doc_id", k)
    candidates = rows.join(F.broadcast(probe) if small else probe, (F.col("h") == F.col("_h")) & (100 * F.col("n") >= percent * F.col("n_item")))
    candidates = materialise(candidates.select("doc_id", "item_id").distinct(), "benchmark-candidates")

    # exact: the candidate documents again, their shingles against those of their items
    pairs = candidates.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("item_id").alias("_items"))
    # candidates grow with the documents, so they are never broadcast, however few they are in a small table
    chosen = docs.select("doc_id", "text").join(pairs.hint("shuffle_hash"), F.col("doc_id") == F.col("_d"))
    split = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "_items", word_array(F.col("text")).alias("_w")).filter(F.size("_w") >= k)
    each = split.select("doc_id", "_items", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - k)).alias("_at")).select("doc_id", "_items", _shingle("_w", F.col("_at"), k).alias("h"))
    known = items.select(F.col("h").alias("_h"), "item_id")
    held = each.join(F.broadcast(known) if items.count() <= BROADCAST_ROWS else known, F.col("h") == F.col("_h")).filter(F.expr("array_contains(_items, item_id)"))
    counted = held.select("doc_id", "item_id", "h").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_matched"))
    sizes = items.groupBy(F.col("item_id").alias("_i")).agg(F.count(F.lit(1)).alias("n_item_shingles"))
    out = counted.join(sizes, F.col("item_id") == F.col("_i")).filter(100 * F.col("n_matched") >= percent * F.col("n_item_shingles"))
    return out.select("doc_id", "item_id", "n_item_shingles", "n_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns kept."""
    key = free_name(docs, "found")
    found = materialise(contaminated(docs, benchmark, k, percent).select(F.col("doc_id").alias(key)).distinct(), "benchmark-found")
    return docs.join(found, F.col("doc_id") == F.col(key), "left_anti")


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{K - 1}], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) i FROM d WHERE len(w) >= {K})),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+{K - 1}], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - {K - 2})) i FROM b WHERE len(w) >= {K})),
n AS (SELECT item_id, count(*) n FROM bs GROUP BY item_id)
SELECT doc_id, bs.item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_matched
FROM ds JOIN bs USING (s) JOIN n ON n.item_id = bs.item_id
GROUP BY doc_id, bs.item_id HAVING 100 * count(*) >= {PERCENT} * any_value(n.n)
"""
