"""What the operators of this subpackage share: staged tables, row keys and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import shared_dir

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: First surrogate id.  Rows without an id get one above it, so that a real id is always the smaller.
SURROGATE = 1 << 62
CHUNK_BYTES = 1 << 18


#: Spark's setting that a query's shuffle files go when it ends, not when the driver's JVM happens to collect its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, compression: str = "snappy", drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The tables live beside the checkpoints and go with them, or by `release`.  drop_shuffles: nothing else is made of df, so its
    shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if drop_shuffles and before is None:
            spark.conf.unset(DROP_SHUFFLES)
        elif drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete staged tables; for those that nothing reads any more, as what was made of them is staged itself."""
    for df in staged:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(df: DataFrame, most: int = 4 << 20) -> None:
    """Hand rows to Python in batches of about 4 MiB, unless the session sets spark.sql.execution.arrow.maxBytesPerBatch itself.

    Spark's own limit is 64 MiB, which a stage of several Python operators holds several times over.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(most))


def free_name(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex}"


def row_id(id_col: str, text_col: str) -> Column:
    """The row's id, or for a null id one above every real id made from the text."""
    made = F.lit(SURROGATE) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(id_col).cast("long"), made)


def real_id(col: Column) -> Column:
    """Null where row_id made the id up."""
    return F.when(col < SURROGATE, col)


def binary(column: pa.Array) -> pa.Array:
    """A string or binary column as binary with 32-bit offsets, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows with about `most` bytes: first row, row after the last, bytes, offsets from 0."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted.  By sorting: np.unique would first put them into a hash table, which takes several times as long."""
    values = np.sort(values)
    return values[np.concatenate([values[:1] == values[:1], values[1:] != values[:-1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Words are runs of bytes that are no blank: [^\x20\x09-\x0D]+
BLANK = np.ones(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_P, _PINV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, word: np.ndarray):
    """64-bit hash of each word of a slice; per row the index of its first word (one longer); byte starts and ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    data = fold[data]
    inside = word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each place on, in order; k - 1 places fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + words[j : j + n] * _ORDER[j % 64]
    return mix(out)


def slot_count(n_items: int, bits_each: int = 16, most_bytes: int = 1 << 25) -> int:
    """Segments of 8 KiB that hold bits_each bits an item, at most most_bytes in all; a power of two."""
    want = -(-max(1, n_items) * bits_each // 65536)
    return 1 << min(max(0, (want - 1).bit_length()), (most_bytes // 8192).bit_length() - 1)
