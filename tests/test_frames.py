"""Framed segment files: checksums, both kinds of entries, torn ends, damage."""

import io
import random
import struct

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from stratakeep.cli import run
from stratakeep.functions.checksums import crc32c
from stratakeep.plans.changelog import COMMIT, DELETE, LINK, PUT
from stratakeep.plans.replay import state
from stratakeep.sources.frames import frame_problems, read_frames


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def framed(type_, tx, key, value, expires=0):
    head = struct.pack(">BIQqI", type_ | 0x80, 37 + len(key) + len(value), tx, expires, len(key))
    body = head + struct.pack(">I", slow_crc(head)) + key + struct.pack(">I", len(value)) + value
    return body + struct.pack(">I", slow_crc(body))


def plain(type_, tx, key, value, expires=0):
    return struct.pack(">BQqI", type_, tx, expires, len(key)) + key + struct.pack(">I", len(value)) + value


def write(folder, *segments):
    for number, parts in enumerate(segments):
        (folder / f"{number:016x}.log").write_bytes(b"".join(parts))
    return str(folder)


def rows(log):
    return sorted((r["pos"], r["type"], r["tx_id"], r["key"], None if r["value"] is None else bytes(r["value"]), r["link_pos"], r["expires_at_ns"]) for r in log.collect())


def test_checksums_equal_those_bit_by_bit():
    assert slow_crc(b"123456789") == 0xE3069283  # the check value of this sum
    r = random.Random(1)
    data = r.randbytes(20_000)
    spans = [(a, a + n) for n in (4, 5, 63, 64, 65, 128, 1000, 9000) for a in (0, 7, r.randrange(10_000))]
    got = crc32c(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [slow_crc(data[a:b]) for a, b in spans]
    assert len(crc32c(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_entries_of_both_kinds(spark, tmp_path):
    first = [framed(PUT, 0, b"a", b"one"), plain(PUT, 0, "é".encode(), b"\xff\x00", 77), framed(LINK, 0, b"b", struct.pack(">q", 0)), framed(PUT, 9, b"a", b"two"), framed(DELETE, 0, b"", b"")]
    second = [framed(COMMIT, 9, b"", b""), framed(PUT, 1 << 63, b"big", b"x" * 100_000)]
    path = write(tmp_path, first, second, [])
    (tmp_path / "notes.log").write_bytes(b"no segment")
    at = np.cumsum([0, *map(len, first)]).tolist()
    want = [(at[0], PUT, 0, "a", b"one", None, 0), (at[1], PUT, 0, "é", b"\xff\x00", None, 77), (at[2], LINK, 0, "b", None, 0, 0), (at[3], PUT, 9, "a", b"two", None, 0), (at[4], DELETE, 0, "", b"", None, 0)]
    want += [(1 << 32, COMMIT, 9, "", b"", None, 0), ((1 << 32) + len(second[0]), PUT, -(1 << 63), "big", b"x" * 100_000, None, 0)]
    log = read_frames(spark, path)
    assert rows(log) == want and frame_problems(spark, path).count() == 0
    assert {r["key"]: bytes(r["value"]) for r in state(log, 100, link_depth=2).collect()} == {"a": b"two", "b": b"one"}


def test_only_the_newest_segment_may_end_torn(spark, tmp_path):
    whole, cut = framed(PUT, 0, b"a", b"one"), framed(PUT, 0, b"b", b"two")
    for n in (1, 28, 29, len(cut) - 1):
        path = write(tmp_path, [whole], [whole, cut[:n]])
        assert [r[0] for r in rows(read_frames(spark, path))] == [0, 1 << 32]
    path = write(tmp_path, [whole, cut[:-1]], [whole])
    assert [tuple(r) for r in frame_problems(spark, path).collect()] == [(0, len(whole), "the file ends inside an entry")]
    with pytest.raises((PySparkException, Py4JJavaError), match=f"damaged segment 0 at offset {len(whole)}"):  # the latter if two stages fail at once
        state(read_frames(spark, path), 0).collect()
    path = write(tmp_path, [], [whole, plain(PUT, 0, b"k", b"v")[:-1]])  # without checksums nothing tells torn from damaged
    assert frame_problems(spark, path).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_any_flipped_bit_is_found(spark, tmp_path, seed):
    r = random.Random(seed)
    parts = [framed(PUT, 0, b"k%d" % i, r.randbytes(r.randrange(0, 90))) for i in range(60)]
    segments = []
    at = np.cumsum([0, *map(len, parts)]).tolist()
    hit = [r.randrange(len(parts)) for _ in range(8)]
    for h in hit:
        data = bytearray(b"".join(parts))
        place = r.randrange(at[h] + 1, at[h + 1])  # the type's byte also tells the kind of entry
        data[place] ^= 1 << r.randrange(8)
        segments.append([bytes(data)])
    path = write(tmp_path, *segments)
    assert sorted((p["segment"], p["offset"]) for p in frame_problems(spark, path).collect()) == [(k, at[h]) for k, h in enumerate(hit)]


def test_keys_links_and_nothing(spark, tmp_path):
    assert rows(read_frames(spark, str(tmp_path))) == []
    path = write(tmp_path, [framed(PUT, 0, b"\xff", b"")], [framed(LINK, 0, b"k", b"123")])
    assert sorted(tuple(p) for p in frame_problems(spark, path).collect()) == [(0, 0, "the key is not UTF-8"), (1, 0, "a link of 3 bytes")]


def test_command_line_import(spark, tmp_path):
    (tmp_path / "old").mkdir()
    later = 4_000_000_000 * 10**9
    write(tmp_path / "old", [framed(PUT, 0, b"a", b"one"), framed(PUT, 0, b"gone", b"x", 5), framed(PUT, 0, b"b", b"two", later), framed(PUT, 3, b"c", b"open")])
    at = ["--path", str(tmp_path / "new")]
    assert run(spark, [*at, "import", str(tmp_path / "old")]) == 0
    out = io.StringIO()
    assert run(spark, [*at, "list"], out) == 0
    assert sorted(out.getvalue().split("\n")) == ["", "a\tone", "b\ttwo"]
    write(tmp_path / "old", [framed(PUT, 0, b"a", b"newer")[:-1]], [])
    assert run(spark, [*at, "import", str(tmp_path / "old")]) == 1 and run(spark, [*at, "get", "a"], out) == 0
    assert out.getvalue().endswith("one\n")
