"""Counting over many sequences at once: numpy over the bytes of an Arrow batch. A sequence is a row, so that its counts need no
shuffle; memory is bounded by cutting batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Batches are cut into slices of about so many letters and of so many result cells.
SLICE_LETTERS, SLICE_CELLS = 1_000_000, 2_000_000


def letter_codes(column: pa.Array, alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """The place of each letter in the alphabet, -1 for others, of all rows end to end, and the n + 1 offsets of the rows. Null counts
    as empty. A letter beyond ASCII is one -1."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    if (data & 0xC0 == 0x80).any():  # bytes that go on with a letter are none of their own
        first = data & 0xC0 != 0x80
        offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
        data = data[first]
    return table[data], offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def word_codes(codes: np.ndarray, offsets: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place in the row and code (a number in base `size`, -1 with a letter of none) of all windows of k letters."""
    n = np.maximum(np.diff(offsets) - (k - 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[:-1][row] + pos
    code, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(k):
        c = codes[at + j]
        known &= c >= 0
        code = code * size + c
    return row, pos, np.where(known, code, -1)


def count_codes(row: np.ndarray, code: np.ndarray, rows: int, size: int) -> np.ndarray:
    """rows x size counts; codes of -1 don't count."""
    keep = code >= 0
    return np.bincount(row[keep] * size + code[keep], minlength=rows * size).reshape(rows, size)


def batches_of(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches (seq_id, seq) of about SLICE_LETTERS letters, and SLICE_CELLS result cells at `cells` for each row. A longer
    sequence is a slice of its own."""
    rows = max(1, SLICE_CELLS // max(cells, 1))
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column("seq")), 0), np.int64)
        cuts = {*range(0, b.num_rows, rows), *(np.flatnonzero(np.diff(np.cumsum(size) // SLICE_LETTERS)) + 1).tolist(), b.num_rows}
        cuts = sorted(cuts)
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)


def strings(names: list[str], index: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())


def by_row(seqs: DataFrame, cells: int, made: Callable[[pa.Array], tuple[np.ndarray, dict[str, pa.Array]]], fields: str) -> DataFrame:
    """seq_id and what `made` gives for a column of sequences: the row of each result row, and its columns. A sequence may stand on
    several rows, each of which is counted for itself."""
    rows = seqs.select("seq_id", F.col("seq").cast("string").alias("seq"))
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, cells):
            row, columns = made(b.column("seq"))
            if len(row):
                yield pa.RecordBatch.from_pydict({"seq_id": b.column("seq_id").take(pa.array(row)), **columns})

    return rows.mapInArrow(run, f"seq_id {kind}, {fields}")


def dense(counts: np.ndarray, names: list[str], kind: pa.DataType) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """A result row (word, value) for each cell of rows x names."""
    n = len(counts)
    return np.repeat(np.arange(n), len(names)), {"word": strings(names, np.tile(np.arange(len(names)), n)), "value": pa.array(counts.ravel(), kind)}


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, as decimal digits of the shortest text that names the number, without negative zeros."""
    scale = 10.0**digits
    part = np.abs(x) * scale
    y = np.floor(part)
    part -= y
    y += part >= 0.5
    y /= scale
    # products with the scale may land beside a half that the number's own digits stand on
    part -= 0.5
    unsure = np.flatnonzero(np.abs(part, out=part) < 1e-6)
    if len(unsure):
        from decimal import ROUND_HALF_UP, Decimal

        step = Decimal(1).scaleb(-digits)
        found, which = np.unique(np.abs(x.flat[unsure]), return_inverse=True)  # shares of small counts are the same few numbers
        y.flat[unsure] = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in found.tolist()])[which]
    np.copysign(y, x, out=y)
    y += 0.0
    return y
