"""Best-fit packing of token sequences, bulk-synchronously.

Documents and gaps of one size are interchangeable, so the range-sorted
documents and gaps are held as runs (size, count): at most one class per size
up to the capacity, however large the corpus. A superstep sweeps the sorted
gaps for the successor (the tightest gap that fits) of every document class
that is its turn, resolves the conflicts of classes with the same successor by
rank (longer documents first, each class as far as the run's gaps go), places
the winners, updates the gaps, and repeats; the longest class that no gap fits
opens new sequences. It is the turn of the classes longer than half the
longest unplaced one, so short documents wait until the gaps of long ones are
there. Runs are bounded by the capacity, so the supersteps are vector
operations of one task on an executor; the places are a table of runs. Which
document gets which place is settled by its rank within its length, which is
counted in parallel over hashed blocks and blocks of blocks. So rows meet in
blocks of bounded size, and nothing goes through the driver.

Defined results: null text is a document of its end id alone; repeated rows
are documents of their own (identical rows are interchangeable); a null
doc_id is kept as null; an empty table gives no pieces; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import materialise
from glossaria.llm.tokens import encoder

#: Rows of a block, and blocks of a block of blocks, about.
BLOCK_ROWS, BLOCKS = 256, 1024
#: Runs of places up to which their table is broadcast.
BROADCAST_PLACES = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "size long, from_rank long, to_rank long, first_sequence long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of each document (doc_id, text): ``PIECES``."""

    def run(batches):
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([x or "" for x in batch.column(1).to_pylist()])):
                    ids += end
                    rows += [(doc, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for runs of (size, count): rows of ``PLACES``.

    The documents of ranks [from_rank, to_rank) of a size go, in rank order,
    to the sequences from first_sequence on, each at ``offset``.
    """
    runs = sorted(sizes)
    size, left = np.array([x for x, _ in runs], np.int64), np.array([n for _, n in runs], np.int64)
    rank = np.zeros(len(size), np.int64)
    #: gap -> runs of sequences (first, count) that have it
    gaps: dict[int, list[tuple[int, int]]] = {}
    places, opened = [], 0

    def place(i: int, n: int, first: int, gap: int):
        places.append((int(size[i]), int(rank[i]), int(rank[i] + n), first, capacity - gap))
        rank[i] += n
        left[i] -= n
        if gap > size[i]:
            gaps.setdefault(gap - int(size[i]), []).append((first, n))

    while (open_ := np.flatnonzero(left)).size:
        turn = open_[2 * size[open_] > size[open_[-1]]][::-1]  # longest first
        sorted_gaps = np.array(sorted(gaps), np.int64)
        successor = np.searchsorted(sorted_gaps, size[turn])
        fits = successor < len(sorted_gaps)
        for at in np.unique(successor[fits]):
            gap = int(sorted_gaps[at])
            pool = gaps.pop(gap)
            rivals = [int(i) for i in turn[fits & (successor == at)]]
            while pool and rivals:
                first, count = pool.pop()
                n = min(count, int(left[rivals[0]]))
                place(rivals[0], n, first, gap)
                if n < count:
                    pool.append((first + n, count - n))
                if not left[rivals[0]]:
                    rivals.pop(0)
            if pool:
                gaps.setdefault(gap, []).extend(pool)
        if not fits[0]:
            i = int(turn[0])
            n = int(left[i]) // (capacity // int(size[i])) or 1
            place(i, n, opened, capacity)
            opened += n
    return places


def placed_runs(runs: DataFrame, capacity: int) -> DataFrame:
    """``PLACES`` for the runs (length, count), at most ``capacity`` rows, made by one task."""

    def run(batches):
        sizes = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows = best_fit(sizes, capacity)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PLACES.split(", ")])

    return materialise(runs.coalesce(1).mapInArrow(run, PLACES), "packing-places")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with _rank, from 0 within each length, without a task for a whole length."""
    order = ("doc_id", "piece", "start", "ids_crc32")
    blocks = max(1, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.floor(F.col("_b") / BLOCKS))
    before = lambda *by: F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    # a length has as many blocks as a thousandth of its pieces, and a thousandth of these blocks of blocks
    large = counts.groupBy("length", "_s").agg(F.sum("_n").alias("_n")).select(F.col("length").alias("_l"), F.col("_s").alias("_t"), before("length", "_s").alias("_base"))
    small = counts.select("length", "_b", "_s", before("length", "_s", "_b").alias("_before"))
    start = small.join(large, (F.col("length") == F.col("_l")) & (F.col("_s") == F.col("_t"))).select(F.col("length").alias("_l"), F.col("_b").alias("_c"), (F.col("_base") + F.col("_before")).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order))
    out = rows.withColumn("_r", inner).join(start, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_c")))
    return out.withColumn("_rank", F.col("_start") + F.col("_r") - 1)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is 1 to ``capacity``."""
    pieces = materialise(pieces, "packing-pieces")
    places = placed_runs(pieces.groupBy("length").count(), capacity)
    # their number depends on the capacity alone
    table = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places
    at = (F.col("length") == F.col("size")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank"))
    return ranked(pieces).join(table, at).select(*pieces.columns, (F.col("first_sequence") + F.col("_rank") - F.col("from_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenise, cut and pack ``docs``: ``PIECES``, sequence_id and offset."""
    return pack(token_pieces(docs, vocabulary, end_id, capacity), capacity)
