"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, a run of min_match words, are joined by the seed's hash. For each
such pair the longest common runs of unmarked words are marked as tiles again and again, down to min_match words, so that a
passage is found whatever the order of its parts. A document is contaminated if tiles cover enough of an item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, small_batches, stash, token_hashes, unused, windows

#: The benchmark is the query set; it is held in blocks of about so many bytes of text, and each block meets all documents.
BLOCK_BYTES = 16_000_000
_FLAG_BITS = 22


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


class Rolling:
    """Karp-Rabin hashes of all windows of an array of word hashes, for any length, from sums of powers."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        with np.errstate(over="ignore"):
            up = np.full(len(words), _BASE, np.uint64)
            up[:1] = 1
            self.down = np.full(len(words) + 1, _BASE_INV, np.uint64)
            self.down[0] = 1
            self.down = np.multiply.accumulate(self.down)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(up), dtype=np.uint64)])

    def windows(self, starts: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + n] - self.sums[starts]) * self.down[starts]


def _free(marked: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Those starts whose n words are there and bear no mark."""
    used = np.concatenate([[0], np.cumsum(marked)])
    starts = starts[starts + n <= len(marked)]
    return starts[used[starts + n] == used[starts]]


def _longest_run(places: np.ndarray) -> int:
    """How many neighbours follow each other at most in a sorted array of places."""
    if not len(places):
        return 0
    cuts = np.flatnonzero(np.diff(places) != 1)
    return int(np.diff(np.concatenate([[-1], cuts, [len(places) - 1]])).max())


def tiles(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash arrays, given in order the places where the doc's m-word windows occur in the item
    and where the item's occur in the doc. Gives (start in doc, start in item, words), the longest first; on a tie the first in
    doc, then in item.

    The longest common run of unmarked words is found by halving over its length, comparing the sets of Karp-Rabin hashes of
    that length; then it is tiled wherever it stands. Pairs of places are never listed, so memory follows the two texts, however
    repetitive they are."""
    found: list[tuple[int, int, int]] = []
    marked_doc, marked_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    a, b = Rolling(doc), Rolling(item)
    most = len(item)
    while True:
        at_doc, at_item = _free(marked_doc, at_doc, m), _free(marked_item, at_item, m)
        most = min(most, _longest_run(at_doc) + m - 1, _longest_run(at_item) + m - 1)
        if not len(at_doc) or not len(at_item) or most < m:
            return found

        def common(n: int) -> np.ndarray:
            """Starts in doc of runs of n words that are also in the item, all unmarked."""
            s, t = _free(marked_doc, at_doc, n), _free(marked_item, at_item, n)
            return s[np.isin(a.windows(s, n), b.windows(t, n))]

        low, high = m - 1, most  # a common run of low words exists (or none of m), none longer than high
        at = common(high)
        if len(at):
            low = high
        while low < high - 1:
            middle = (low + high) // 2
            if len(now := common(middle)):
                low, at = middle, now
            else:
                high = middle
        n = low
        if n < m:
            return found
        t = _free(marked_item, at_item, n)
        h = b.windows(t, n)
        order = np.argsort(h, kind="stable")
        t, h = t[order], h[order]
        first = dict(zip(*(x.tolist() for x in np.unique(h, return_index=True))))  # where each hash's places begin
        for d, x in zip(at.tolist(), a.windows(at, n).tolist()):
            if marked_doc[d : d + n].any():
                continue
            k = first.get(x, len(h))
            while k < len(h) and h[k] == x:
                i = int(t[k])
                k += 1
                if not marked_item[i : i + n].any():
                    if np.array_equal(doc[d : d + n], item[i : i + n]):  # a hash is only a hint
                        marked_doc[d : d + n] = marked_item[i : i + n] = True
                        found.append((d, i, n))
                        break
                elif h[k - 1] == x:
                    first[x] = k  # marked for good: the next one begins behind it
        most = n - 1


class Block:
    """The seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], m: int) -> None:
        self.m = m
        self.words, self.at = token_hashes(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        h, at = windows(self.words, self.at, m)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        pos = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
        order = np.argsort(h, kind="stable")
        h, self.item, self.pos = h[order], item[order], pos[order]
        self.seeds, self.first = np.unique(h, return_index=True)
        self.last = np.concatenate([self.first[1:], [len(h)]])
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[(self.seeds & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, at: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, list]]:
        """(row, item id, coverage, tiles) for the rows' words."""
        if not len(self.seeds):
            return
        h, w_at = windows(words, at, self.m)
        hit = np.flatnonzero(self.flags[(h & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.seeds, h[hit]), len(self.seeds) - 1)
        good = self.seeds[seed] == h[hit]
        hit, seed = hit[good], seed[good]
        rows = np.searchsorted(w_at, hit, side="right") - 1
        size = np.diff(self.at)
        words_in = np.diff(at)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for of in np.split(np.arange(len(rows)), cuts) if len(rows) else []:
            row = int(rows[of[0]])
            text = words[at[row] : at[row + 1]]
            mine, place = seed[of], hit[of] - w_at[row]
            # the entries of this text's different seeds: as many as the block has at most
            own = np.unique(mine)
            n = self.last[own] - self.first[own]
            which = np.repeat(self.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of_seed, item, pos = np.repeat(own, n), self.item[which], self.pos[which]
            order = np.lexsort((pos, item))
            of_seed, item, pos = of_seed[order], item[order], pos[order]
            # seeds that can't cover enough of an item even together need no tiling
            step = np.full(len(pos), self.m)
            near = np.flatnonzero(item[1:] == item[:-1])
            step[near] = np.minimum(self.m, pos[near + 1] - pos[near])
            most = np.bincount(item, step, len(size))
            for x in np.flatnonzero((most > 0) & (most >= coverage * size)).tolist():
                other = self.words[self.at[x] : self.at[x + 1]]
                if len(other) < self.m or words_in[row] < self.m:  # too short to tile: the whole of one is the whole of the other
                    if len(other) == len(text) and (other == text).all():
                        yield row, int(self.ids[x]), 1.0, [(0, 0, len(text))]
                    continue
                s, e = np.searchsorted(item, [x, x + 1])
                found = tiles(text, other, place[np.isin(mine, of_seed[s:e])], pos[s:e], self.m)
                share = sum(t[2] for t in found) / len(other)
                if share >= coverage:
                    yield row, int(self.ids[x]), share, found


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item of which tiles cover at least `coverage`: id_col, item_id, coverage, tiles (doc_start,
    item_start, words; counted in words).

    Words are runs of letters, digits and underscores in lower case. Null and empty texts match nothing, nor does an item
    without an id. An item of fewer than min_match words can't be tiled: it matches a text of exactly its words. Repeated rows
    are judged each for itself. The whole text is searched, however long and repetitive, in memory that follows its length.
    Other columns are ignored; an empty table on either side gives no rows.

    Documents never move between executors, but they are read once for each BLOCK_BYTES of benchmark text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().collect()  # bounded: BLOCK_BYTES of text
        held = spark.sparkContext.broadcast(Block([r.item_id for r in part], [r.text for r in part], min_match))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                words, at = token_hashes(b.column("text"))
                found = list(held.value.matches(words, at, coverage))
                if found:
                    rows = pa.array([f[0] for f in found])
                    spans = [[{"doc_start": d, "item_start": i, "words": n} for d, i, n in f[3]] for f in found]
                    columns = [b.column("id").take(rows), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array(spans, _SPANS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "coverage", "tiles"])

        one = thin.mapInArrow(run, f"id {kind}, item_id long, coverage double, tiles array<struct<doc_start:int,item_start:int,words:int>>")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


_SPANS = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id_col, contaminated, n_items, item_ids (in order) and best_coverage (0 for a clean one).
    Rows with equal ids share their matches. See find_contamination for the rest."""
    found = find_contamination(docs, benchmark, id_col=id_col, **options)
    found = stash(found.select(F.col(id_col).alias("_id"), "item_id", "coverage"), "contamination")
    per = found.groupBy("_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("best_coverage"))
    out = docs.select(id_col).join(per, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select(id_col, (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item contaminates."""
    found = find_contamination(docs, benchmark, id_col=id_col, **options)
    name = unused(docs, "_bad")
    bad = stash(found.select(F.col(id_col).alias(name)).distinct(), "contaminated")
    return docs.join(bounded(bad), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
