"""Bloom filters of 64-bit keys that count to two, built by partition and merged by segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

SEGMENT_BITS = 65536
SCHEMA = "seg int, once binary, twice binary"


def places(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each key and its two bits in there."""
    keys = keys.astype(np.uint64, copy=False)
    seg = (keys & np.uint64(segments - 1)).astype(np.int64)
    one = ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
    two = ((keys >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
    return seg, one, np.where(two == one, (two + 1) & 0xFFFF, two)


class Counter:
    """Bits seen once and bits seen at least twice, for all segments."""

    def __init__(self, segments: int):
        self.segments = segments
        self.once = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
        self.twice = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        seg, one, two = places(keys, self.segments)
        bits, times = np.unique(np.concatenate([seg * SEGMENT_BITS + one, seg * SEGMENT_BITS + two]), return_counts=True)
        byte, bit = bits >> 3, (1 << (bits & 7)).astype(np.uint8)
        again = (times > 1) | ((self.once[byte] & bit) != 0)
        np.bitwise_or.at(self.once, byte, bit)
        np.bitwise_or.at(self.twice, byte[again], bit[again])

    def merge(self, seg: int, once: bytes, twice: bytes) -> None:
        at = slice(seg * SEGMENT_BITS // 8, (seg + 1) * SEGMENT_BITS // 8)
        a, b = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
        self.twice[at] |= b | (self.once[at] & a)
        self.once[at] |= a

    def rows(self) -> Iterator[pa.RecordBatch]:
        once, twice = (x.reshape(self.segments, -1) for x in (self.once, self.twice))
        full = np.flatnonzero(once.any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 256)):
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), *(pa.array([x[i].tobytes() for i in part], pa.binary()) for x in (once, twice))],
                    names=["seg", "once", "twice"],
                )


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], segments: int) -> DataFrame:
    """The merged filter of all keys: a row for each segment that has bits.

    Each task counts its own keys in at most 64 MiB, sends its non-empty segments, and these are merged as they arrive.
    """

    small_batches(df)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(segments)
        for batch in batches:
            for keys in keys_of(batch):
                counter.add(keys)
        yield from counter.rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for seg, once, twice in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                counter = counter or Counter(segments)
                counter.merge(seg, once, twice)
        if counter:
            yield from counter.rows()

    return df.mapInArrow(local, SCHEMA).repartition(F.col("seg")).mapInArrow(merged, SCHEMA)


def test_bit(bits: Column, place: Column) -> Column:
    """Whether that bit of a binary is set; false for a null binary."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")), F.lit(2)) == 1, F.lit(False))


def maybe_twice(df: DataFrame, key: str, filters: DataFrame, segments: int, flag: str) -> DataFrame:
    """df with a flag: false if no other row has this key.  The filter is broadcast; segments bounds it to 32 MiB."""
    k = F.col(key)
    one = F.shiftrightunsigned(k, 16).bitwiseAND(F.lit(0xFFFF))
    two = F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(0xFFFF))
    two = F.when(two == one, F.pmod(two + 1, F.lit(65536))).otherwise(two)
    at, bits = free_name("at"), free_name("bits")
    narrow = filters.select(F.col("seg").alias(at), F.col("twice").alias(bits))
    joined = df.withColumn(at, k.bitwiseAND(F.lit(segments - 1)).cast("int")).join(F.broadcast(narrow), at, "left")
    return joined.withColumn(flag, test_bit(F.col(bits), one) & test_bit(F.col(bits), two)).drop(at, bits)


class Probe:
    """A filter of at most 32 MiB as the tasks read it."""

    def __init__(self, rows: list, segments: int, column: str):
        self.segments = segments
        self.bits = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
        for r in rows:
            at = r["seg"] * SEGMENT_BITS // 8
            self.bits[at : at + SEGMENT_BITS // 8] = np.frombuffer(r[column], np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        seg, one, two = places(keys, self.segments)
        found = np.ones(len(keys), bool)
        for place in (one, two):
            bit = seg * SEGMENT_BITS + place
            found &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return found
