"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``SIDE`` sketches, each of ``DEPTH`` minhashes, are
computed per set; every pair of a sketch of the one and a sketch of the other
keys one table, so SIDE * SIDE tables of 2 * DEPTH minhashes cost only
2 * SIDE * DEPTH minhash computations. Two sets of similarity s share a table
unless all sketches of a side differ: (1 - s**DEPTH)**SIDE, 0.0003 for a side
at s = 0.8.

Equal sets are one class, kept by its smallest doc_id. Only classes that share
a sketch on both sides get table keys. Within a bucket no pairs are formed
among all members: each is compared with the bucket's leader, the member that
shares most sketches (so the original of many edited copies leads them). That
leaves few buckets with several components. In these, all members of different
components are compared, so no pair that shares a table is left unverified
between two components: members outside a bucket's largest component meet all
its members. Such buckets are cut into blocks of bounded bytes, two blocks
with their full sets meet in one task, and only links that join components
leave it, never pairs. A pair is compared under its first common sketch only.
Every link is confirmed on the full sets. Components come from alternating
large-star and small-star steps.

Defined results: null or blank text has an empty set, is linked with nothing
and is its own component; rows that repeat a doc_id count as one node; a null
doc_id has its class's component (null if it is alone) and is kept only then;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import discard, free_name, materialise

DEPTH = 2
SIDE = 8
#: Rows and shingles of a block; two blocks of a bucket meet in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 4000, 1_000_000
_SEEDS = tk.mix64(np.arange(1, 2 * SIDE * DEPTH + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BLOCK = "key long, p int, q int, slot int, probe boolean, main boolean, node long, n int, component long"


def sketches(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of both sides, (sets, SIDE) each; sets aren't empty."""
    out = np.empty((len(rows) - 1, 2 * SIDE), np.uint64)
    for i in range(2 * SIDE):
        total = np.zeros(len(rows) - 1, np.uint64)
        for d in range(DEPTH):
            h = found ^ _SEEDS[i * DEPTH + d]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            total = tk.mix64(total + np.minimum.reduceat(h, rows[:-1]))
        out[:, i] = total
    return out[:, :SIDE], out[:, SIDE:]


def _set_rows(docs: DataFrame, k: int, sketch: bool) -> DataFrame:
    """doc_id, n_shingles, fingerprint and either sketches a and b or the hashes of the set."""

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                found, rows = tk.distinct_sets(*tk.utf8(batch.column(1)), k)
                n = np.diff(rows)
                some = np.flatnonzero(n)
                prints = np.zeros((len(n), 2), np.uint64)
                if len(some):
                    edges = rows[:-1][some]
                    prints[some, 0] = np.add.reduceat(tk.mix64(found), edges)
                    prints[some, 1] = np.add.reduceat(tk.mix64(found ^ np.uint64(0xA5A5A5A55A5A5A5A)), edges)
                fp = pa.Array.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary())
                if sketch:
                    sides = []
                    for side in sketches(found, np.append(rows[:-1][some], len(found))) if len(some) else (np.zeros((0, SIDE), np.uint64),) * 2:
                        full = np.zeros((len(n), SIDE), np.int64)
                        full[some] = side.view(np.int64) if side.flags.c_contiguous else np.ascontiguousarray(side).view(np.int64)
                        sides.append(pa.ListArray.from_arrays(pa.array(np.arange(0, full.size + 1, SIDE, dtype=np.int32)), pa.array(full.ravel())))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), fp, *sides], names=["doc_id", "n_shingles", "fp", "a", "b"])
                else:
                    raw = found.tobytes()
                    sets = [raw[8 * x : 8 * y] for x, y in zip(rows[:-1], rows[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    kind = "doc_id long, n_shingles long, fp binary, a array<long>, b array<long>" if sketch else "doc_id long, shingles binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def _groups(batches) -> Iterator[pa.Table]:
    """The rows of each run of equal (key, p, q) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(keys[a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a binary column of 64-bit values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None and data.size else np.zeros(0, kind)
    return values, (off - off[0]) // 8


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between probes and members of a group that join components."""
    col = lambda name: table.column(name).to_numpy()
    probe, main, node, n, label = col("probe"), col("main"), col("node"), col("n").astype(np.int64), col("component").copy()
    slot = int(col("slot")[0])
    values, off = _flat(table.column("shingles"), np.uint64)
    members = np.flatnonzero(~probe)
    if not len(members) or len(members) == len(probe):
        return []
    if slot >= 0:
        sides = []
        for name in ("a", "b"):
            sig, at = _flat(table.column(name), np.int64)
            sides.append(sig.reshape(len(node), SIDE))
    if probe.sum() > 1:
        names, codes = np.unique(values, return_inverse=True)
        mark = np.zeros(len(names), bool)
    sizes = np.diff(off)
    links = []
    for u in np.flatnonzero(probe):
        fits = (label[members] != label[u]) & (node[members] != node[u]) & (100 * np.minimum(n[members], n[u]) >= percent * np.maximum(n[members], n[u]))
        if slot >= 0:
            # two members outside the largest component meet once, a pair under its first common sketch
            fits &= main[members] | (node[members] < node[u])
            some = members[fits]
            a, b = ((side[some] == side[u]) & (side[u] != 0) for side in sides)
            some = some[~a[:, :slot].any(axis=1) & b.any(axis=1)]
        else:
            some = members[fits]
        if not len(some):
            continue
        each = sizes[some]
        edge = np.cumsum(each) - each
        at = np.arange(each.sum()) + np.repeat(off[some] - edge, each)
        own = slice(off[u], off[u + 1])
        if probe.sum() > 1:
            mark[codes[own]] = True
            hit = mark[codes[at]]
            mark[codes[own]] = False
        else:
            mine, theirs = values[own], values[at]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), edge)
        near = some[100 * both >= percent * (n[u] + n[some] - both)]
        for x in dict(zip(label[near].tolist(), near.tolist())).values():
            links.append((int(node[u]), int(node[x])))
        label[np.isin(label, label[near])] = label[u]
    return links


def _verified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) found in the groups of ``rows`` (``_BLOCK``, a, b), with the full sets (doc_id, shingles) of their nodes."""

    def run(batches):
        for table in _groups(batches):
            links = _block_links(table, percent)
            if links:
                x, y = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    full = rows.join(sets.select(F.col("doc_id").alias("_id"), "shingles"), F.col("node") == F.col("_id")).drop("_id")
    return full.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (x, y).

    Large-star joins a node's larger neighbours to its smallest one,
    small-star its smaller ones; each keeps components and at most the number
    of edges. It ends when a pass changes nothing.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.pmod(F.xxhash64("y", "x"), F.lit(1 << 40)))).first()
    now = materialise(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x < y").distinct(), "star-edges")
    seen = mark(now)
    while True:
        both = now.select("x", "y").union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy(F.col("x").alias("_x")).agg(F.least(F.min("y"), F.col("_x")).alias("m"))
        large = both.join(low, F.col("x") == F.col("_x")).filter("y > x").select(F.col("m").alias("x"), "y").filter("x < y").distinct()
        down = large.groupBy(F.col("y").alias("_y")).agg(F.min("x").alias("m"))
        small = large.join(down, F.col("y") == F.col("_y")).select("m", "x", "y")
        edge = lambda c: F.struct(F.col("m").alias("x"), F.col(c).alias("y"))
        before, now = now, materialise(small.select(F.explode(F.array(edge("x"), edge("y"))).alias("e")).select("e.x", "e.y").filter("x < y").distinct(), "star-edges")
        discard(before)
        if (fresh := mark(now)) == seen:
            break
        seen = fresh
    roots = now.select(F.col("x").alias("node")).distinct()
    return roots.select("node", F.col("node").alias("component")).union(now.select(F.col("y").alias("node"), F.col("x").alias("component")))


def _candidates(rows: DataFrame) -> DataFrame:
    """node, n, prio, a, b of the classes that share a sketch on both sides, with the shared sketches (slot, value).

    ``prio`` orders leaders: most shared sketches first, then by hash.
    """
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", F.col("n_shingles").cast("int").alias("n"), "a", "b")).alias("c"))
    each = classes.select(F.col("c.doc_id").alias("node"), F.col("c.n").alias("n"), F.posexplode(F.concat("c.a", "c.b")).alias("slot", "value"))
    common = each.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("slot").alias("_slot"), F.col("value").alias("_value"), "c")
    hits = each.join(common, (F.col("slot") == F.col("_slot")) & (F.col("value") == F.col("_value")))
    value = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("value")))
    found = hits.groupBy("node").agg(F.max("n").alias("n"), F.sum("c").alias("pop"), *[value(i).alias(f"_v{i}") for i in range(2 * SIDE)])
    prio = F.shiftleft(F.least("pop", F.lit(1 << 30)), 32) * -1 + F.pmod(F.xxhash64("node"), F.lit(1 << 32))
    rows = found.select("node", "n", prio.alias("prio"), F.array(*[f"_v{i}" for i in range(SIDE)]).alias("a"), F.array(*[f"_v{i}" for i in range(SIDE, 2 * SIDE)]).alias("b"))
    return rows.filter((F.size(F.array_compact("a")) > 0) & (F.size(F.array_compact("b")) > 0))


def _keyed(nodes: DataFrame, *keep: str) -> DataFrame:
    """node, ``keep``, slot, key: a row for each table of a node; slot is the place of its sketch of the first side."""
    all_ = F.sequence(F.lit(0), F.lit(SIDE - 1))
    key = lambda i, j: F.when(F.get("a", i).isNotNull() & F.get("b", j).isNotNull(), F.struct(i.alias("slot"), F.xxhash64(i, j, F.get("a", i), F.get("b", j)).alias("key")))
    keys = F.array_compact(F.flatten(F.transform(all_, lambda i: F.transform(all_, lambda j: key(i, j)))))
    return nodes.select("node", *keep, F.explode(keys).alias("k")).select("node", *keep, "k.slot", "k.key")


def _blocks(rows, shingles):
    """The number of blocks for so many rows and shingles, one at least."""
    return F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(shingles / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")


def _block_of(count):
    return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")


def _with_component(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of ``node``; a node without links is its own."""
    return rows.join(labels.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")


def _led(nodes: DataFrame, percent: int) -> DataFrame:
    """Groups of a bucket leader, as the probe, and the members that its size fits, in blocks."""
    keyed = _keyed(nodes, "n", "prio")
    buckets = keyed.groupBy("key").agg(F.min(F.struct("prio", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("_k"), F.col("lead.node").alias("lead"), F.col("lead.n").alias("nl"))
    fits = (F.col("node") != F.col("lead")) & (100 * F.least("n", "nl") >= percent * F.greatest("n", "nl"))
    pairs = keyed.join(buckets, F.col("key") == F.col("_k")).filter(fits).select("lead", "nl", "node", "n").distinct()
    pairs = materialise(pairs, "dedup-led")
    leads = pairs.groupBy("lead").agg(F.max("nl").alias("nl"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("_q"))
    members = pairs.join(leads.select(F.col("lead").alias("_l"), "_q"), F.col("lead") == F.col("_l"))
    common = lambda probe: (F.lit(0).alias("q"), F.lit(-1).alias("slot"), F.lit(probe).alias("probe"), F.lit(False).alias("main"))
    side = (F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    left = members.select(F.col("lead").alias("key"), _block_of("_q").alias("p"), *common(False), "node", "n", F.col("node").alias("component"), *side)
    right = leads.select(F.col("lead").alias("key"), F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("p"), *common(True), F.col("lead").alias("node"), F.col("nl").alias("n"), F.col("lead").alias("component"), *side)
    return left.union(right)


def _apart(nodes: DataFrame) -> DataFrame:
    """Groups of two blocks of members of a bucket that holds several components.

    Buckets here are those of a sketch of the first side, with the members
    that have a table there with several components.
    """
    keyed = _keyed(nodes, "component")
    split = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(F.col("key").alias("_k"))
    open_ = keyed.join(split, F.col("key") == F.col("_k"), "left_semi").groupBy("node").agg(F.collect_set("slot").alias("slots"))
    sketch = lambda name: F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(F.get(name, F.lit(i)), F.lit(0))), 16, "0")) for i in range(SIDE)])
    rows = nodes.join(open_.select(F.col("node").alias("_n"), "slots"), F.col("node") == F.col("_n"))
    rows = rows.select("node", "n", "component", sketch("a").alias("_sa"), sketch("b").alias("_sb"), "a", F.explode("slots").alias("slot"))
    rows = rows.select("node", "n", "component", F.col("_sa").alias("a"), F.col("_sb").alias("b"), "slot", F.xxhash64("slot", F.get("a", F.col("slot"))).alias("key"))
    rows = materialise(rows, "dedup-open")
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "component")).alias("top")).filter("parts > 1")
    sizes = sizes.select(F.col("key").alias("_k"), F.col("top.component").alias("_main"), _blocks(F.col("c"), F.col("s")).alias("_p"), _blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("_q"))
    rows = rows.join(sizes, F.col("key") == F.col("_k")).withColumn("main", F.col("component") == F.col("_main"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ("main", "node", "n", "component", "a", "b")
    members = rows.select("key", _block_of("_p").alias("p"), all_of("_q").alias("q"), "slot", F.lit(False).alias("probe"), *cols)
    probes = rows.filter("not main").select("key", all_of("_p").alias("p"), _block_of("_q").alias("q"), "slot", F.lit(True).alias("probe"), *cols)
    return members.union(probes)


def _links(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component of all linked candidates."""
    chosen = docs.select("doc_id", "text").join(nodes.select("node").hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left_semi")
    sets = materialise(_set_rows(chosen, k, sketch=False), "dedup-sets")
    if sets.count() > nodes.count():
        # a repeated doc_id: the largest set stands for it
        sets = materialise(sets.groupBy("doc_id").agg(F.max_by("shingles", F.struct(F.length("shingles"), "shingles")).alias("shingles")), "dedup-sets")
    found = materialise(_verified(_led(nodes, percent), sets, percent), "dedup-links")
    labels = materialise(components(found), "dedup-components")
    more = materialise(_verified(_apart(_with_component(nodes, labels, "node", "component")), sets, percent), "dedup-links")
    if not more.limit(1).count():
        return labels
    return materialise(components(found.union(more)), "dedup-components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    rows = materialise(_set_rows(docs, k, sketch=True), "dedup-rows")
    nodes = materialise(_candidates(rows), "dedup-candidates")
    labels = _links(docs, nodes, k, percent)
    own = rows.filter("n_shingles > 0 and doc_id is not null").groupBy(F.col("fp").alias("_fp")).agg(F.min("doc_id").alias("node"))
    own = _with_component(own, labels, "node", "_component").drop("node")
    # as a table of its own it joins by an exchange, whose hot classes adaptive execution can split
    own = materialise(own, "dedup-classes")
    out = rows.select("doc_id", "n_shingles", "fp").join(own, (F.col("fp") == F.col("_fp")) & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("component_id", F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    Of rows that repeat a kept doc_id one stays, that with the longest text
    (of equally long ones the first by hash). Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, k, percent).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(kept, "dedup-kept")
    key = free_name(docs, "kept_id")
    ids = kept.select(F.col("doc_id").alias(key), F.col("rows").alias(f"{key}_rows"))
    same = F.col("doc_id").cast("long") == F.col(key)
    out = docs.filter("doc_id is null").union(docs.join(ids.filter(f"{key}_rows = 1").select(key), same, "left_semi"))
    again = ids.filter(f"{key}_rows > 1").select(key)
    if again.limit(1).count():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        order = F.struct(F.length("text"), F.xxhash64(F.to_json(whole)))
        one = docs.join(again, same, "left_semi").groupBy("doc_id").agg(F.max_by(whole, order).alias(key))
        out = out.union(one.select(f"{key}.*"))
    return out
