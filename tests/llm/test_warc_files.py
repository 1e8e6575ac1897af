"""WARC files of other writers, and how much of a file is read."""

import gzip
import os

import pytest

from glossaria.llm import warc


def record(i: int, kind: str, body: bytes) -> bytes:
    return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{i}>")], body)


def rows_of(path, payload=True, tests=()):
    reader = warc.WarcReader(str(path), payload)
    reader.tests = list(tests)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.fixture
def taken(monkeypatch):
    count = [0]
    read = warc.Raw.readinto
    monkeypatch.setattr(warc.Raw, "readinto", lambda self, b: [n := read(self, b), count.__setitem__(0, count[0] + n)][0])
    return count


def test_gzip_files_of_other_writers(tmp_path):
    rows = [record(i, "response" if i % 2 else "request", b"x%d" % i * (i * 3000 + 1)) for i in range(9)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows[:4]) + gzip.compress(b"".join(rows[4:])))
    got = rows_of(tmp_path)
    assert [r["record_id"] for r in got] == [f"<urn:page:{i}>" for i in range(9)]
    assert [r["payload"] for r in got] == [b"x%d" % i * (i * 3000 + 1) for i in range(9)]
    some = rows_of(tmp_path, tests=[("eq", "record_type", "response")])
    assert [r["record_id"] for r in some] == [f"<urn:page:{i}>" for i in range(1, 9, 2)]
    assert all(r["payload"] is None for r in rows_of(tmp_path, payload=False))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rows[3])[:-40])
    with pytest.raises((EOFError, ValueError)):
        rows_of(tmp_path, tests=[("eq", "record_type", "request")])


@pytest.mark.parametrize("compressed", [False, True])
def test_unwanted_blocks_are_not_read(tmp_path, taken, compressed):
    pack = warc.gzip_member if compressed else bytes
    bodies = [os.urandom(2_000_000) for _ in range(5)]
    path = tmp_path / ("a.warc.gz" if compressed else "a.warc")
    path.write_bytes(b"".join(pack(record(i, "response" if i == 3 else "request", b)) for i, b in enumerate(bodies)))
    size = path.stat().st_size
    got = rows_of(tmp_path, tests=[("eq", "record_type", "response")])
    assert [r["payload"] for r in got] == [bodies[3]] and taken[0] < 0.3 * size
    taken[0] = 0
    assert len(rows_of(tmp_path, payload=False)) == 5 and taken[0] < 0.1 * size


def test_a_member_tells_its_length():
    body = warc.gzip_member(b"abc" * 1000)
    assert gzip.decompress(body) == b"abc" * 1000 and int.from_bytes(body[16:20], "little") == len(body)
