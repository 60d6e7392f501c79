"""Change logs out of framed binary segment files, for stores that move here.

A folder holds segments ``<number, 16 hex digits>.log``; an entry's position is its segment and its offset in the
file, packed as everywhere here. One task decodes a file, as only the length of an entry tells where the next begins;
files of other writers are of tens of megabytes, and Spark packs files into tasks by their size.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from struct import unpack_from

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pack_position
from ..functions.checksums import crc32c
from ..plans.changelog import COLUMNS, LINK, PUT
from .files import Files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy

# Fixed values of the format, all numbers big endian. An entry with checksums: type with the top bit set (1 byte),
# length of the entry (4), transaction (8), expiry (8), length of the key (4), CRC-32C of these 25 bytes (4), key,
# length of the value (4), value, CRC-32C of all before (4). An entry without: type (1), transaction (8), expiry (8),
# length of the key (4), key, length of the value (4), value. The value of a link is its target's position (8).
CHECKED = 0x80
HEADER, HEADER_BYTES = ">BIQqII", 29
PLAIN, PLAIN_BYTES = ">BQqI", 21
LENGTH = ">I"
LEAST = HEADER_BYTES + 8
NAME = r"([0-9a-f]+)\.log"

_DECODED = "segment long, offset long, type int, tx_id long, key string, value binary, link_pos long, expires_at_ns long, problem string"
_BATCH_BYTES = 1 << 23


def entries(data: bytes, active: bool) -> Iterator[tuple]:
    """(offset, type, tx_id, key, value, link_pos, expires_at_ns, problem) of each entry of a file.

    The last one may be a problem, and then stands for the rest of the file. An entry with checksums that the file's
    end cuts off is none if the segment is the ``active`` one: its writer has not finished it.
    """
    spans, at, problem = [], 0, None  # (begin, end, whether it has checksums) of entries; a cut one ends beyond the file
    size = len(data)
    while at < size and problem is None:
        if data[at] & CHECKED:
            if size - at < HEADER_BYTES:
                problem = "torn"
                break
            total, key_bytes = unpack_from(LENGTH, data, at + 1)[0], unpack_from(LENGTH, data, at + 21)[0]
            spans.append((at, at + total, True))
            if total < LEAST or key_bytes > total - LEAST:
                problem = "lengths contradict each other"
            elif total > size - at:
                problem = "torn"
            else:
                at += total
            continue
        value_at = at + PLAIN_BYTES + (unpack_from(PLAIN, data, at)[3] if size - at >= PLAIN_BYTES else size)
        end = value_at + 4 + (unpack_from(LENGTH, data, value_at)[0] if value_at + 4 <= size else size)
        if end > size:
            problem = "the file ends inside an entry"
        else:
            spans.append((at, end, False))
            at = end
    bytes_ = np.frombuffer(data, np.uint8)
    checked = np.array([s[:2] for s in spans if s[2]], np.int64).reshape(-1, 2)
    at_begin, at_end = checked[:, 0], checked[:, 1]
    header_ok = crc32c(bytes_, at_begin, at_begin + 25) == _numbers(bytes_, at_begin + 25)
    whole = header_ok & (at_end <= size) & (at_end - at_begin >= LEAST)
    record_ok = np.zeros(len(checked), bool)
    record_ok[whole] = crc32c(bytes_, at_begin[whole], at_end[whole] - 4) == _numbers(bytes_, at_end[whole] - 4)
    sound = {b: (h, r) for b, h, r in zip(at_begin.tolist(), header_ok.tolist(), record_ok.tolist())}

    for begin, end, has_checksums in spans:
        fault = None
        if has_checksums:
            header, record = sound[begin]
            if not header:
                fault = "the header does not match its checksum"
            elif begin == at and problem:
                break
            elif not record:
                fault = "the entry does not match its checksum"
            else:
                type_, _, tx, expires, key_bytes, _ = unpack_from(HEADER, data, begin)
                key_at, end, type_ = begin + HEADER_BYTES, end - 4, type_ & ~CHECKED
        else:
            type_, tx, expires, key_bytes = unpack_from(PLAIN, data, begin)
            key_at = begin + PLAIN_BYTES
        if fault is None:
            value_at = key_at + key_bytes + 4
            value, link = data[value_at:end], None
            if unpack_from(LENGTH, data, value_at - 4)[0] != len(value):
                fault = "lengths contradict each other"
            elif type_ == LINK:
                fault, link, value = (None, int.from_bytes(value, "big", signed=True), None) if len(value) == 8 else (f"a link of {len(value)} bytes", None, None)
            try:
                key = data[key_at : key_at + key_bytes].decode()
            except UnicodeDecodeError:
                fault = fault or "the key is not UTF-8"
        if fault:
            yield begin, PUT, 0, None, None, None, 0, fault
            return
        yield begin, type_, tx - (1 << 64) if tx >> 63 else tx, key, value, link, expires, None
    if problem and not (problem == "torn" and active):
        yield at, PUT, 0, None, None, None, 0, "the file ends inside an entry" if problem == "torn" else problem


def _numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The four-byte numbers at these places."""
    return data[at[:, None] + np.arange(4)].astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)


def _decode(active: int):
    schema = pa.schema([("segment", pa.int64()), ("offset", pa.int64()), ("type", pa.int32()), ("tx_id", pa.int64()), ("key", pa.string()), ("value", pa.binary()), ("link_pos", pa.int64()), ("expires_at_ns", pa.int64()), ("problem", pa.string())])

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("segment")[k].as_py()
                held, size = [], 0
                for entry in entries(batch.column("content")[k].as_py(), number == active):
                    held.append((number, *entry))
                    size += 64 + len(entry[3] or "") + len(entry[4] or b"")
                    if size > _BATCH_BYTES:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return run


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    numbers = [int(n[:-4], 16) for n in Files(spark, path).names(".") if re.fullmatch(NAME, n)]
    if not numbers:
        return spark.createDataFrame([], _DECODED)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).where(F.col("path").rlike(f"/{NAME}$"))
    number = F.conv(F.regexp_extract("path", f"/{NAME}$", 1), 16, 10).cast("long")
    return files.select(number.alias("segment"), "content").mapInArrow(_decode(max(numbers)), _DECODED)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The change log of all segments in a folder, values as bytes; the position of a damaged entry is in the error that it raises.

    A cut last entry of the newest segment is left out. No files give an empty log. Repeated entries are entries of their
    own. Keys must be UTF-8. Transactions and links are kept, for :func:`~stratakeep.plans.replay.state` to judge.
    """
    d = _decoded(spark, path)
    at = F.concat(F.lit("damaged segment "), F.col("segment").cast("string"), F.lit(" at offset "), F.col("offset").cast("string"), F.lit(": "), F.col("problem"))
    # a filter, which no projection can prune; a damaged row has the look of a put, so that no other filter hides it
    sound = d.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(at).cast("boolean")))
    return sound.select(pack_position("segment", "offset").alias("pos"), *COLUMNS[1:])


def frame_problems(spark: SparkSession, path: str) -> DataFrame:
    """(segment, offset, problem) of the first damaged entry of each segment; sound ones give no row."""
    return _decoded(spark, path).where("problem is not null").select("segment", "offset", "problem")
