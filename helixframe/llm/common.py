"""What several operators share: numbered rows, hashes as fractions, and token hashes; the library's written tables, checked
broadcasts, ranks and components are taken on from here."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import bounded, components, ranked
from ..sources.lineage import fresh_path, shared_dir, stash

__all__ = ["bounded", "components", "fresh_path", "ranked", "shared_dir", "stash"]  # others take these from here


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, kind: str = "rows") -> tuple[DataFrame, str]:
    """df as a written table in which each row has a number of its own, and the name of that column. Whatever is decided by this
    number is decided row by row, be ids null or repeated."""
    name = unused(df, "_row")
    return stash(df.withColumn(name, F.monotonically_increasing_id()), kind), name


def hex_fraction(h: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of h: the middle of one of 2**52 equal steps."""
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


# ---- token hashes: numpy over the bytes of a whole Arrow batch -------------------------------------------------------

#: Batches are cut into slices of about so many bytes and rows at most, so that memory doesn't follow the batch; a longer
#: text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 400_000, 500
#: Rows with whole texts go to Python so many at a time.
BATCH_ROWS = 1000
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 2**64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a word: ASCII letters and digits, the underscore, and every byte of a character beyond ASCII.
WORD_BYTES = np.array([chr(i).isalnum() or i == 95 or i >= 128 for i in range(256)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, kind: str) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 20), _M if kind == "up" else _M_INV, np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python BATCH_ROWS at a time, unless the session has a number of its own: ten thousand texts, its default,
    are some 30 MB in each of several buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def small_broadcasts(spark: SparkSession) -> None:
    """Has the driver cut what it broadcasts into pieces of 256 kB from now on, unless the application has a number of its own. Spark
    takes a whole piece, 4 MB by its default, for each broadcast of a few bytes. Arrays that large stand apart in the driver's heap
    and set off a collection each time; a fit, whose every step is a job with two broadcasts, makes hundreds of them, and the heap
    grows to several times what lives in it. What is broadcast stays the same."""
    conf, key = spark.sparkContext._jsc.sc().env().conf(), "spark.broadcast.blockSize"
    if not conf.contains(key):
        conf.set(key, "256k")


def slices(batches: Iterable[pa.RecordBatch], column: str | tuple[str, ...], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes (or those of several together) stay near SLICE_BYTES, and the rows at most
    `rows`."""
    columns = (column,) if isinstance(column, str) else column
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in columns)
        piece = np.cumsum(sizes) // SLICE_BYTES
        cuts = sorted({*range(0, batch.num_rows, rows), *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows})
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside an executor that needs it."""
    _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def token_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and the n + 1 offsets of its rows' words. Words are maximal runs of
    WORD_BYTES in the lower-cased text; equal words have equal hashes in every process."""
    data, offsets = text_bytes(pc.utf8_lower(column) if lower else column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = WORD_BYTES[data]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, word[:-1]
    prev[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, word[1:]
    inner = offsets[1:-1]
    nxt[inner[(inner > 0) & (inner <= n)] - 1] = False
    ends = np.flatnonzero(word & ~nxt) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _power(n, "up"), out=sums[1:])
        h = mix64((sums[ends] - sums[starts]) * _power(n, "down")[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets).astype(np.int64)


def windows(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the n + 1 offsets of the rows' windows; a row with 1 to k - 1 words has one window of
    all its words, a row without words has none."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        acc = np.zeros(len(h), np.uint64)
        for j in range(k):
            acc += padded[j : j + len(h)] * _PLACE[j]
        first = np.repeat(offsets[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
        out = acc[first]
        for r in np.flatnonzero((n > 0) & (n < k)):
            w = h[offsets[r] : offsets[r + 1]]
            out[out_at[r]] = (w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
        return mix64(out), out_at
