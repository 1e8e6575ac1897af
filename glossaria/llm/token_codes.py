"""Token ids in directly addressable codes.

A file holds a run of documents in ascending id order. Ids are cut into 8-bit
chunks, low first; level l stores chunk l of every id that has one, a
continuation bitmap tells which ids go on to level l+1, and a rank directory
(ones before each 512-bit block) finds their place there. Any token is read
by one byte, one bit and one count per level; nothing is decoded in blocks.

Layout: magic, then sections, then a JSON directory of section offsets and its
length. Sections: doc ids (int64), token offsets (int64, one more than the
documents), and per level chunks (uint8), bitmap (little bit order, padded to
64 bytes) and directory (uint64).

Defined results: null text is empty (its end id alone); rows that repeat a
doc_id follow each other in text-hash order, and identical rows are
interchangeable; a null doc_id sorts first; an empty table gives no files;
further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import materialise, open_fs, scratch_path
from glossaria.llm.tokens import encoder

MAGIC = b"GLDAC001"
BLOCK_BYTES = 64
FILE_TOKENS = 1_000_000
#: Files that one task reads back, on average.
FILES_A_TASK = 8
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory per level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % BLOCK_BYTES))
        ones = np.unpackbits(bits).reshape(-1, BLOCK_BYTES * 8).sum(axis=1, dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        out.append(((rest & 255).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint64) if len(ones) else ones))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            return out


def to_bytes(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    parts, at, table = [MAGIC], len(MAGIC), {}
    sections = {"docs": doc_ids.astype("<i8"), "offsets": offsets.astype("<i8")}
    levels = encode_levels(ids)
    for i, (chunks, bits, ranks) in enumerate(levels):
        sections |= {f"chunks{i}": chunks, f"bits{i}": bits, f"ranks{i}": ranks.astype("<u8")}
    for name, values in sections.items():
        raw = values.tobytes()
        table[name] = [at, len(raw)]
        parts.append(raw)
        at += len(raw)
    foot = json.dumps({"levels": len(levels), "sections": table}).encode()
    return b"".join([*parts, foot, len(foot).to_bytes(8, "little")])


class CodeFile:
    """Reads a file; ``read_at(offset, length)`` fetches bytes of it."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        n = int.from_bytes(read_at(size - 8, 8), "little")
        foot = json.loads(read_at(size - 8 - n, n))
        self.levels, self.sections = foot["levels"], foot["sections"]
        self.docs = self._section("docs", "<i8")
        self.offsets = self._section("offsets", "<i8")

    def _section(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self.read_at(*self.sections[name]), kind)

    def token(self, i: int) -> int:
        """The i-th id of the file, by a few bytes per level."""
        value = 0
        for level in range(self.levels):
            at = self.sections[f"chunks{level}"][0]
            value |= self.read_at(at + i, 1)[0] << (8 * level)
            block, bit = divmod(i, BLOCK_BYTES * 8)
            bits = np.unpackbits(np.frombuffer(self.read_at(self.sections[f"bits{level}"][0] + block * BLOCK_BYTES, BLOCK_BYTES), np.uint8), bitorder="little")
            if not bits[bit]:
                return value
            before = int.from_bytes(self.read_at(self.sections[f"ranks{level}"][0] + 8 * block, 8), "little")
            i = before + int(bits[:bit].sum())
        raise ValueError("a code goes on below the last level")

    def all(self) -> np.ndarray:
        """All ids of the file."""
        value, place = None, None
        for level in range(self.levels):
            chunks = self._section(f"chunks{level}", "u1").astype(np.uint32)
            on = np.unpackbits(self._section(f"bits{level}", "u1"), bitorder="little")[: len(chunks)].astype(bool)
            if value is None:
                value, place = chunks, np.arange(len(chunks))
            else:
                value[place] |= chunks << np.uint32(8 * level)
            place = place[on]
        return value


def write_codes(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) to files below ``path``; returns their manifest.

    A task writes files of its own name, so a repeated attempt leaves at most
    files that no manifest row names.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        fs, base = open_fs(path)
        fs.create_dir(base, recursive=True)
        held: list[tuple[np.ndarray, list[bytes]]] = []
        tokens = seq = 0

        def flush():
            nonlocal held, tokens, seq
            docs_, raw = np.concatenate([d for d, _ in held]), [b for _, bs in held for b in bs]
            counts = np.array([len(b) // 4 for b in raw], np.int64)
            name = f"{path}/part-{part:06d}-{seq:05d}-{attempt}.dac"
            with fs.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}") as f:
                f.write(to_bytes(docs_, np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(b"".join(raw), "<u4")))
            row = (part, seq, name, len(raw), int(counts.sum()))
            held, tokens, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "path", "n_docs", "n_tokens"])

        end = np.array([end_id], "<u4").tobytes()
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                raw = [b + end for b in enc.encode([x or "" for x in batch.column(1).to_pylist()])]
                held.append((batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), raw))
                tokens += sum(map(len, raw)) // 4
                if tokens >= FILE_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return materialise(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_codes(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files of a manifest."""
    # tokens before a part (a row for each range partition), and before a file within its part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("_part"), (F.sum("n").over(before) - F.col("n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    files = manifest.withColumn("_within", within).join(parts, F.col("part") == F.col("_part")).select("path", (F.col("_before") + F.col("_within")).cast("long").alias("base"))
    files = files.repartition(max(1, manifest.count() // FILES_A_TASK))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = open_fs(name)
                with fs.open_input_file(at) as f:
                    code = CodeFile(lambda o, n: f.read_at(n, o), f.size())
                    ids = code.all().astype("<u4").tobytes()
                offs = code.offsets
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(code.docs, mask=code.docs == NULL_ID), pa.array(offs[:-1] + base), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    return read_codes(write_codes(docs, vocabulary, end_id, scratch_path(spark, "token-codes")))
