"""Quality classifier: interpolated modified Kneser-Ney over words.

Words (maximal runs of bytes other than blanks, A-Z folded) are hashed into
2**BITS buckets; a bigram of buckets is a 44-bit key, and the first word of a
text follows an edge mark. One pass over the texts writes, to shared storage,
what scoring gathers from the corpus: for every slice of documents its distinct
(bigram, document) entries, sorted by bigram, as compressed differences in
blocks. Ranges of keys of about equal weight are the shards. A shard's task
reads its blocks of all slices; it counts those of the trusted documents
(labels are joined by id, no text is shuffled) and writes the counts; the
numbers of distinct contexts of each word are summed over the shards and give
the lower order; then each shard joins its counts with the entries of all
documents, by key, and adds up their surprise for each document. A frequent
context can span shards; its totals are put together from theirs. A quarter of
the trusted documents, by a hash of their ids, isn't trained on: cutoffs are
quantiles of its perplexities for each language, so that a document isn't
rejected for not having been trained on.

A word's bucket is shared by another one with a probability of the words over
2**BITS. Workers hold one shard's counts and the lower order, 2**BITS numbers.

Defined results: null or blank text has no perplexity and isn't kept; a null
language is language ``""``; a language without such documents uses the
cutoff of all; rows with repeated ids are judged alike; with none at all
nothing is rejected; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import discard, materialise, open_fs, remove, scratch_path

BITS, DOC_BITS = 22, 16
WORD = np.uint64((1 << BITS) - 1)
EDGE = 0
#: Entries of a block, of a slice and of a shard, about. A shard reads whole blocks, so slices have more blocks than there are shards.
BLOCK, SLICE, SHARD = 4096, 4_000_000, 16_000_000
QUANTILE = 0.998
#: One of so many trusted documents sets the cutoffs.
HELD_OUT = 4
#: Cutoffs of so many languages at most are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Pseudo words of mean surprise that steady short texts.
STEADY = 10.0
INDEX = "kind string, file string, slice int, doc_id long, lang string, idx int, n long, first long, last long, at long, size long"
FOUND = "kind string, shard int, a long, b long, c long, file string"


def bigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key << DOC_BITS | row) of a slice, how often each comes, and the words of each row."""
    w = tk.words(data, off)
    bucket = tk.range_hashes(data, w.starts, w.ends, fold=True) >> np.uint64(64 - BITS)
    before = np.concatenate([[EDGE], bucket[:-1]]).astype(np.uint64) if len(bucket) else bucket
    first = w.first[:-1][w.first[:-1] < w.first[1:]]
    before[first] = EDGE
    key = before << np.uint64(BITS) | bucket
    entry, n = np.unique(key << np.uint64(DOC_BITS) | tk.row_of(w.first).astype(np.uint64), return_counts=True)
    return entry, n, np.diff(w.first)


def pack(entry: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers and their counts: Rice-coded differences, the low bits plain, quotients and counts compressed."""
    steps = np.diff(entry, prepend=entry[:1]).astype(np.uint64)
    low = max(0, int(np.log2(max(1.0, float(steps.mean())))))
    whole, odd = divmod(low, 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    parts = [planes[:, i].tobytes() for i in range(whole)]
    bits = (planes[:, whole, None] >> np.arange(odd, dtype=np.uint8)) & 1 if odd else np.zeros((0, 0), np.uint8)
    parts.append(np.packbits(bits.astype(np.uint8).T.ravel()).tobytes())
    rest = (steps >> np.uint64(low)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return int(entry[0]).to_bytes(8, "little") + len(entry).to_bytes(4, "little") + bytes([low]) + b"".join(parts) + zstandard.compress(rest, 3)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, n, low = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:12], "little"), raw[12]
    whole, odd = divmod(low, 8)
    at = 13 + whole * n
    steps = np.zeros(n, np.uint64)
    for i in range(whole):
        steps |= np.frombuffer(raw, np.uint8, n, 13 + i * n).astype(np.uint64) << np.uint64(8 * i)
    size = -(-odd * n // 8)
    if odd:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))[: odd * n].reshape(odd, n)
        for i in range(odd):
            steps |= bits[i].astype(np.uint64) << np.uint64(8 * whole + i)
    rest = np.frombuffer(zstandard.decompress(raw[at + size :]), np.uint8)
    planes = lambda x: np.ascontiguousarray(x.reshape(4, n).T).view("<u4").ravel()
    steps |= planes(rest[: 4 * n]).astype(np.uint64) << np.uint64(low)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first), planes(rest[4 * n :])


def _table(rows: list[tuple], kind: str) -> pa.RecordBatch:
    parts = [x.split() for x in kind.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(parts)], names=[c for c, _ in parts])


def write_entries(docs: DataFrame, path: str) -> DataFrame:
    """Write the entries of ``docs`` (doc_id, lang, text) below ``path``; a row (``INDEX``) for each document (d) and block (b).

    A task writes a file of its own name, so a repeated attempt leaves at most
    a file that no row names.
    """

    def run(batches):
        fs, base = open_fs(path)
        fs.create_dir(base, recursive=True)
        name, at, number = uuid.uuid4().hex, 0, 0
        rows, entries, counts, held, docs_ = [], [], [], 0, 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:

            def flush():
                nonlocal rows, entries, counts, held, docs_, at, number
                entry = np.concatenate(entries)
                order = np.argsort(entry, kind="stable")
                entry, n = entry[order], np.concatenate(counts)[order]
                entry = (entry >> np.uint64(DOC_BITS)) * np.uint64(docs_) + (entry & np.uint64((1 << DOC_BITS) - 1))
                for i in range(0, len(entry), BLOCK):
                    raw = pack(entry[i : i + BLOCK], n[i : i + BLOCK])
                    f.write(raw)
                    some = entry[i : i + BLOCK] // np.uint64(docs_)
                    rows.append(("b", name, number, None, None, None, len(some), int(some[0]), int(some[-1]), at, len(raw)))
                    at += len(raw)
                out = _table(rows, INDEX)
                rows, entries, counts, held, docs_, number = [], [], [], 0, 0, number + 1
                return out

            for whole in batches:
                for piece in tk.slices(whole, "text"):
                    for start in range(0, piece.num_rows, 1 << DOC_BITS):
                        batch = piece.slice(start, 1 << DOC_BITS)
                        if entries and (held > SLICE or docs_ + batch.num_rows > 1 << DOC_BITS):
                            yield flush()
                        entry, n, words = bigrams(*tk.utf8(batch.column(2)))
                        rows += [("d", name, number, d, x, docs_ + i, k, None, None, None, None) for i, (d, x, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words.tolist()))]
                        entries.append(entry + np.uint64(docs_))
                        counts.append(n)
                        held += len(entry)
                        docs_ += batch.num_rows
            if entries:
                yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return materialise(source.mapInArrow(run, INDEX), "perplexity-index")


def _runs(batches) -> Iterator[pa.Table]:
    """The rows of each shard (first column) in sorted batches."""
    held, last = [], None
    for batch in batches:
        if batch.num_rows:
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and shard[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = shard[a]
    if held:
        yield pa.Table.from_batches(held)


class _Blocks:
    """Reads blocks, one open file at a time."""

    def __init__(self, path: str):
        self.fs, self.base = open_fs(path)
        self.name, self.file = None, None

    def read(self, name: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        return unpack(self.file.read_at(size, at))


def _within(entry: np.ndarray, n: np.ndarray, docs: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows and counts of the entries (key * docs + row) with low <= key < high."""
    key = entry // np.uint64(docs)
    a, b = np.searchsorted(key, np.array([low, high], np.uint64))
    return key[a:b], (entry[a:b] - key[a:b] * np.uint64(docs)).astype(np.int64), n[a:b].astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate(counts)[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)


def _contexts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of sorted keys, and of each: total, and bigrams counted once, twice and more often."""
    v = key >> np.uint64(BITS)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    parts = [n, n == 1, n == 2, n > 2]
    return v[at], np.stack([np.add.reduceat(x.astype(np.int64), at) for x in parts], axis=1) if len(at) else np.zeros((0, 4), np.int64)


def count_shards(blocks: DataFrame, shards: int, path: str) -> DataFrame:
    """Count the trusted entries of each shard and write them; ``FOUND`` rows.

    m: the shard's file; n: a bigrams were counted b times (b up to 4); w: word
    a has b contexts; v0 to v3: total and numbers of the shard's first and last context a.
    """

    def run(batches):
        reader = _Blocks(path)
        for table in _runs(batches):
            shard, low, high = (table.column(i)[0].as_py() for i in range(3))
            keys, counts, held = [], [], 0
            for name, at, size, docs, trusted in zip(*(table.column(c).to_pylist() for c in ("file", "at", "size", "docs", "trusted"))):
                if trusted is None:
                    continue
                key, row, n = _within(*reader.read(name, at, size), docs, low, high)
                some = np.unpackbits(np.frombuffer(trusted, np.uint8), bitorder="little")[row].astype(bool)
                keys.append(key[some])
                counts.append(n[some])
                held += int(some.sum())
                if held > SHARD:
                    key, n = _summed(keys, counts)
                    keys, counts, held = [key], [n], 0
            key, n = _summed(keys, counts)
            name = f"counts-{shard}-{uuid.uuid4().hex}"
            with reader.fs.open_output_stream(f"{reader.base}/{name}", compression=None) as f:
                f.write(pack(key, n) if len(key) else b"")
            rows = [("m", shard, len(key), None, None, name)] + [("n", shard, int((n == i).sum()), i, None, None) for i in range(1, 5)]
            v, stats = _contexts(key, n)
            for i in {0, len(v) - 1} if len(v) else ():
                rows += [(f"v{j}", shard, int(v[i]), int(stats[i, j]), None, None) for j in range(4)]
            yield _table(rows, FOUND)
            w, types = np.unique(key & WORD, return_counts=True)
            for i in range(0, len(w), 100_000):
                part = len(w[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(["w"] * part), pa.array(np.full(part, shard, np.int32)), pa.array(w[i : i + 100_000].astype(np.int64)), pa.array(types[i : i + 100_000].astype(np.int64)), pa.nulls(part, pa.int64()), pa.nulls(part, pa.string())], names=[x.split()[0] for x in FOUND.split(", ")])

    return materialise(_by_shard(blocks, shards).mapInArrow(run, FOUND), "perplexity-counts")


def _by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    """A task for each shard, more or less; the rows are small, what they name isn't, so tasks aren't put together."""
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard", "file", "at")


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, 0.1 at least, from the numbers of n-grams counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return [min(i - 0.1, max(0.1, i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i)) for i in (1, 2, 3)]


def cut(n: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(n, 3)]


_lower: dict[str, np.ndarray] = {}


def lower_order(path: str, d: list[float]) -> np.ndarray:
    """The share of each word among the contexts' words, from the table (word, types) at ``path``."""
    if path not in _lower:
        fs, base = open_fs(path)
        types = np.zeros(1 << BITS, np.int64)
        for i in fs.get_file_info(pafs.FileSelector(base)):
            if i.base_name.endswith(".parquet"):
                with fs.open_input_file(i.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches():
                        types[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        off, total = cut(types, d), max(1, int(types.sum()))
        rest = off.sum() / total if types.any() else 1.0
        _lower.clear()
        _lower[path] = (np.maximum(types - off, 0) / total + rest / len(types)).astype(np.float64)
    return _lower[path]


def score_shards(blocks: DataFrame, shards: int, path: str, words: str, d2: list[float], d1: list[float]) -> DataFrame:
    """file, slice, nats: a shard's share of the surprise of each document of a slice, 8 bytes each.

    ``blocks`` has the shard's counts (``counts``) and the whole totals of its first and last context (``edges``).
    """

    def run(batches):
        reader = _Blocks(path)
        p1 = None
        for table in _runs(batches):
            p1 = lower_order(words, d1) if p1 is None else p1
            _, low, high = (table.column(i)[0].as_py() for i in range(3))
            with reader.fs.open_input_file(f"{reader.base}/{table.column('counts')[0].as_py()}") as f:
                raw = f.read()
            known, c = unpack(raw) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            c = c.astype(np.int64)
            v, stats = _contexts(known, c)
            for e in table.column("edges")[0].as_py() or []:
                stats[np.searchsorted(v, np.uint64(e["v"]))] = e["t"]
            total = np.maximum(stats[:, 0], 1)
            share = (c - cut(c, d2)) / np.repeat(total, np.diff(np.append(np.searchsorted(known, v << np.uint64(BITS)), len(known)))) if len(known) else np.zeros(0)
            rest = (stats[:, 1:] @ np.array(d2)) / total
            known, share = np.append(known, np.uint64(1 << 63)), np.append(share, 0.0)
            v, rest = np.append(v, np.uint64(1 << 63)), np.append(rest, 1.0)
            rows = list(zip(*(table.column(x).to_pylist() for x in ("file", "slice", "at", "size", "docs"))))
            nats = None
            for i, (name, number, at, size, docs) in enumerate(rows):
                key, row, n = _within(*reader.read(name, at, size), docs, low, high)
                at_key, at_v = np.searchsorted(known, key), np.searchsorted(v, key >> np.uint64(BITS))
                p = np.where(known[at_key] == key, share[at_key], 0.0) + np.where(v[at_v] == key >> np.uint64(BITS), rest[at_v], 1.0) * p1[(key & WORD).astype(np.int64)]
                found = np.bincount(row, -np.log(p) * n, docs)
                nats = found if nats is None else nats + found
                if i + 1 < len(rows) and rows[i + 1][:2] == (name, number):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int32()), pa.array([nats.astype("<f4").tobytes()], pa.binary())], names=["file", "slice", "nats"])
                nats = None

    return _by_shard(blocks, shards).mapInArrow(run, "file string, slice int, nats binary")


def _document_sums(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("nats").to_pylist()]
    nats = np.sum(parts, axis=0)
    n = len(nats)
    return pa.table({"file": pa.array([table.column("file")[0].as_py()] * n), "slice": pa.array([table.column("slice")[0].as_py()] * n, pa.int32()), "idx": pa.array(np.arange(n, dtype=np.int32)), "nats": pa.array(nats.round(3))})


def surprise(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, nats of each row of ``docs``, by the model of the documents in ``trusted`` (_t)."""
    path = scratch_path(docs.sparkSession, "perplexity")
    index = write_entries(docs, path)
    rows = index.filter("kind = 'd'").select("file", "slice", "idx", "doc_id", "lang", F.col("n").alias("n_words"))
    plain = index.filter("kind = 'b'").select("file", "slice", "first", "last", "at", "size", "n")
    slices = rows.join(trusted, F.col("doc_id") == F.col("_t"), "left").groupBy("file", "slice").agg(F.count(F.lit(1)).cast("int").alias("docs"), F.collect_list(F.when(F.col("_t").isNotNull(), F.col("idx"))).alias("i"))

    @F.pandas_udf("binary")
    def bitmap(series: pd.Series) -> pd.Series:
        def one(i):
            bits = np.zeros(1 << DOC_BITS, np.uint8)
            bits[np.asarray(i, np.int64)] = 1
            return np.packbits(bits, bitorder="little").tobytes() if len(i) else None

        return series.map(one)

    slices = slices.select(F.col("file").alias("_f"), F.col("slice").alias("_s"), "docs", bitmap("i").alias("trusted"))
    entries = plain.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-entries // SHARD))
    # bounds of about equal weight, from the blocks' first keys; there are as many as shards
    inner = plain.agg(F.percentile_approx("first", [i / shards for i in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    bounds = np.array([0, *sorted(set(inner or [])), 1 << 62], np.int64)

    def route(batches):
        for batch in batches:
            first, last = (batch.column(i).to_numpy() for i in (2, 3))
            a, b = np.searchsorted(bounds, first, "right") - 1, np.searchsorted(bounds, last, "right") - 1
            at = np.repeat(np.arange(len(a)), b - a + 1)
            shard = a[at] + np.arange(len(at)) - np.searchsorted(at, at)
            keep = [batch.column(i).take(pa.array(at)) for i in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(bounds[shard]), pa.array(bounds[shard + 1]), *keep], names=["shard", "low", "high", "file", "slice", "at", "size"])

    blocks = plain.mapInArrow(route, "shard int, low long, high long, file string, slice int, at long, size long")
    blocks = blocks.join(slices, (F.col("file") == F.col("_f")) & (F.col("slice") == F.col("_s"))).drop("_f", "_s")
    blocks = materialise(blocks, "perplexity-blocks")

    found = count_shards(blocks, shards, path)
    seen = {r["b"]: r["n"] for r in found.filter("kind = 'n'").groupBy("b").agg(F.sum("a").alias("n")).collect()}
    d2 = discounts([seen.get(i, 0) for i in range(1, 5)])
    types = materialise(found.filter("kind = 'w'").groupBy(F.col("a").alias("word")).agg(F.sum("b").alias("types")), "perplexity-words")
    some = types.agg(*[F.count_if(F.col("types") == i) for i in range(1, 5)]).first()
    d1 = discounts([some[i] for i in range(4)])
    # a context that two shards share has the totals of both
    ends = found.filter("kind like 'v%'").groupBy("shard", F.col("a").alias("v")).agg(*[F.max(F.when(F.col("kind") == f"v{j}", F.col("b"))).alias(f"t{j}") for j in range(4)])
    whole = ends.groupBy(F.col("v").alias("_v")).agg(F.array(*[F.sum(f"t{j}") for j in range(4)]).alias("t"))
    edges = ends.join(whole, F.col("v") == F.col("_v")).groupBy(F.col("shard").alias("_e")).agg(F.collect_list(F.struct("v", "t")).alias("edges"))
    files = found.filter("kind = 'm'").select(F.col("shard").alias("_m"), F.col("file").alias("counts"))
    scored = blocks.join(files, F.col("shard") == F.col("_m")).join(edges, F.col("shard") == F.col("_e"), "left").select("shard", "low", "high", "file", "slice", "at", "size", "docs", "counts", "edges")
    parts = score_shards(scored, shards, path, types._scratch_path, d2, d1)
    sums = parts.groupBy("file", "slice").applyInArrow(_document_sums, "file string, slice int, idx int, nats double").select(F.col("file").alias("_f"), F.col("slice").alias("_s"), F.col("idx").alias("_i"), "nats")
    on = (F.col("file") == F.col("_f")) & (F.col("slice") == F.col("_s")) & (F.col("idx") == F.col("_i"))
    out = materialise(rows.join(sums, on, "left").select("doc_id", "lang", "n_words", F.coalesce("nats", F.lit(0.0)).alias("nats")), "perplexity-rows")
    discard(index, blocks, found, types)
    remove(docs.sparkSession, path)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, cutoff, kept.

    Trusted are the documents labelled with quality 1 and not toxic.
    """
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_t")).distinct()
    trusted = materialise(trusted.withColumn("_held", F.pmod(F.xxhash64("_t", F.lit(29)), F.lit(HELD_OUT)) == 0), "perplexity-trusted")
    rows = surprise(docs, trusted.filter("not _held"))
    known = rows.join(trusted.filter("_held"), F.col("doc_id") == F.col("_t"), "left_semi").filter("n_words > 0")
    mean = known.agg(F.coalesce(F.sum("nats") / F.sum("n_words"), F.lit(0.0))).first()[0]
    steadied = F.exp((F.col("nats") + STEADY * F.lit(mean)) / (F.col("n_words") + STEADY))
    scored = lambda df: df.withColumn("perplexity", F.when(F.col("n_words") > 0, F.round(steadied, 6)))
    by = scored(known).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("_cut")).select(F.col("lang").alias("_lang"), "_cut")
    by = materialise(by, "perplexity-cutoffs")
    by = F.broadcast(by) if by.count() <= BROADCAST_LANGUAGES else by
    overall = scored(known).agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = scored(rows).join(by, F.col("lang") == F.col("_lang"), "left").withColumn("cutoff", F.coalesce("_cut", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "n_words", "perplexity", "cutoff", ((F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("cutoff"), F.lit(True))).alias("kept"))
