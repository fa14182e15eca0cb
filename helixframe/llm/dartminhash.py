"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word windows, each with the number of times that it occurs. Every window owns a strip
of the plane, as wide as its weight and endless along the rank axis, on which darts lie at places fixed by hashes alone. The
strip is cut into dyadic regions of weight and rank; a region's hash gives how many darts hit it (Poisson, by its area) and
where. Each dart belongs to one of k coordinates, and each coordinate keeps its dart of lowest rank: the chance that two
documents keep the same dart is their weighted Jaccard similarity. Work per document is its windows plus about k ln k darts.

Signatures are cut into bands; documents that share a band are candidates, whose similarity is then computed exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, mix64, slices, small_batches, stash, token_hashes, windows

#: Rank regions: [0, 1/64), then each four times as far: [1/64, 1/16), [1/16, 1/4), ...
_FIRST = 1 / 64
_HASH_BITS = 48
_NONE = np.uint64(2**64 - 1)


@lru_cache(maxsize=4096)
def _poisson_cdf(mean: float) -> np.ndarray:
    """P(count <= i) for i = 0, 1, ... until it is 1 in double precision."""
    top = int(mean + 12 * np.sqrt(mean) + 20)
    i = np.arange(1, top + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / i))]) - mean
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def weighted(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' windows as weighted sets: row, element hash and weight of each different window of each row."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = np.sort(row << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64(2**_HASH_BITS - 1), weight


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of n weighted sets given as sorted rows, element hashes and whole weights. A row without elements
    gets zeros."""
    total = np.bincount(row, weight, n)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1  # weight regions [0,1), [1,2), [2,4), ...
    which = np.repeat(np.arange(len(row)), levels)
    nu = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    with np.errstate(over="ignore"):
        cell = mix64(element[which] + nu.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    cell_row, cell_weight = row[which], weight[which]
    low_w, wide = np.where(nu > 0, 2.0 ** (nu - 1), 0.0), np.where(nu > 0, 2.0 ** (nu - 1), 1.0)
    best = np.full(n * k, _NONE, np.uint64)
    reach = np.zeros(n)  # the rank up to which a row's darts are thrown
    need = np.where(total > 0, (np.log(k) + 1.5) * k / np.maximum(total, 1), 0.0)
    rho = 0
    while True:
        empty = (best.reshape(n, k) == _NONE).any(1) & (total > 0)
        active = (reach < need) | (empty & (reach >= need))
        active &= total > 0
        if not active.any():
            break
        low_r, high_r = (0.0, _FIRST) if rho == 0 else (_FIRST * 4.0 ** (rho - 1), _FIRST * 4.0**rho)
        c = np.flatnonzero(active[cell_row])
        with np.errstate(over="ignore"):
            seed = mix64(cell[c] ^ np.uint64((0xA0761D6478BD642F * (rho + 1)) % 2**64))
            u = _unit(mix64(seed + np.uint64(1)))
            count = np.zeros(len(c), np.int64)
            for w in np.unique(wide[c]):
                of = wide[c] == w if len(wide) else slice(None)
                count[of] = np.searchsorted(_poisson_cdf(float(w * (high_r - low_r))), u[of], side="right")
            hit = np.flatnonzero(count)
            times = count[hit]
            dart_of = np.repeat(hit, times)
            t = np.arange(len(dart_of)) - np.repeat(np.cumsum(times) - times, times)
            x = mix64(seed[dart_of] + (t.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15))
            y = mix64(x ^ np.uint64(0x2545F4914F6CDD1D))
            rank = (low_r + (high_r - low_r) * _unit(x)).astype(np.float32)
            j = (y >> np.uint64(40)).astype(np.int64) * k >> 24
            src = c[dart_of]
            inside = np.ones(len(src), bool)
            big = np.flatnonzero(cell_weight[src] > 1)
            inside[big] = low_w[src[big]] + wide[src[big]] * _unit(mix64(y[big])) < cell_weight[src[big]]
            packed = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | (y & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, cell_row[src[inside]] * k + j[inside], packed[inside])
        reach[active] = high_r
        rho += 1
    best[best == _NONE] = 0
    return (mix64(best) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)


def text_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return weighted(*windows(*token_hashes(column), words))


def _counted(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' windows as row, a key of row and 64-bit window hash, and weight, in the order of the keys."""
    h, at = windows(*token_hashes(column), words)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    with np.errstate(over="ignore"):
        key, first, weight = np.unique(mix64(h ^ mix64(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    return row[first], key, weight


def pair_similarity(a: pa.Array, b: pa.Array, words: int) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in the same rows of a and b; 0 where either has no words."""
    n = len(a)
    ra, key_a, wa = _counted(a, words)
    rb, key_b, wb = _counted(b, words)
    _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    both = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), n)
    either = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of `rows` coordinates; a band's place is part of its hash."""
    parts = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
        for j in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return acc.view(np.int64)


def _key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sketches(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (a 128-bit hash of the whole text), n (its words) and bands (hashes) of each row. A null text counts as empty."""
    thin = docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 300):
            h, at = token_hashes(b.column("text"))
            sig = dart_signatures(*weighted(*windows(h, at, words)), b.num_rows, bands * rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), pa.array(band_hashes(sig, rows).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(np.diff(at)), lists], names=["id", "key", "n", "bands"])

    return thin.mapInArrow(run, "id long, key string, n long, bands array<long>")


def window_sets(texts: DataFrame, words: int) -> DataFrame:
    """rep and set of each row of texts (rep, text): hashes, one for each occurrence of each window, so that the weighted
    similarity of two texts is the plain Jaccard similarity of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 300):
            h, at = windows(*token_hashes(b.column("text")), words)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([first, [len(h)]]))
            nth = np.arange(len(h)) - np.repeat(first, size)
            with np.errstate(over="ignore"):
                each = mix64(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([_packed(each[s:e]) for s, e in zip(at, at[1:])], pa.binary())], names=["rep", "set"])

    return texts.mapInArrow(run, "rep long, set binary")


def _packed(x: np.ndarray) -> bytes:
    return x.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, part: np.ndarray, threshold: float, buckets: list | None = None) -> np.ndarray:
    """For each member the least place that links between left and right, of members of different parts, join it with. buckets:
    those of each member; members without a common one don't link."""
    root = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    every, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[code] > 1  # what only one member has is no part of any intersection
    kept, code = np.unique(code[shared], return_inverse=True)
    member = member[shared]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, member = code[order], member[order]
    for lo in range(0, len(kept), 2048):
        s, e = np.searchsorted(code, [lo, lo + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[member[s:e], code[s:e] - lo] = 1
        both += m[left] @ m[right].T
    either = size[left][:, None] + size[right][None, :] - both
    linked = (both >= threshold * either) & (part[left][:, None] != part[right][None, :])
    if buckets is not None:
        _, code = np.unique(np.concatenate(buckets), return_inverse=True)
        held = np.zeros((len(sets), int(code.max()) + 1), np.float32)
        held[np.repeat(np.arange(len(sets)), [len(x) for x in buckets]), code] = 1
        linked &= held[left] @ held[right].T > 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked)):
        x, y = find(int(left[i])), find(int(right[j]))
        root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


#: Members of a bucket are compared in blocks of about so many, so that no task holds a whole bucket.
BLOCK = 512
#: Buckets that share members are sent as one group up to so many members, in smaller blocks (of at least so many members, but so
#: many blocks at most), and each for itself beyond. Which members are compared is the same: those that share a bucket.
CLUSTER, CLUSTER_BLOCK, CLUSTER_PARTS = 8192, 128, 24


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id (the smallest id with the same text), component_id (the smallest id of its
    near-duplicate group, itself included) and kept (the id is its group's smallest).

    A group is what links join; a link is a weighted Jaccard similarity of at least threshold between the five-word windows
    of two texts that agree in one of the bands, computed from 64-bit hashes of all their windows. Words are runs of letters,
    digits and underscores, in lower case. A text of fewer than `words` words is one window; a text without words, null and
    empty included, is grouped with equal texts only (null counts as empty). Ids should be unique; rows with equal ids and
    texts are alike, and an id on different texts stands for each of them. Rows without an id get null columns and are kept.
    Other columns are ignored; an empty table gives an empty result.

    Equal texts are collapsed first, into numbered classes. Then each bucket compares its members with its first only, so that a
    bucket of n near copies costs n comparisons; buckets whose members are still apart do so once more with a member chosen by
    a hash. In buckets that hold more than one component even then, all members are compared, block by block, and only a
    forest of the links found leaves a task. So all members of all buckets have been compared that links don't already join:
    there is no cap on a bucket, no candidate is dropped, and what a link is doesn't depend on how many share a bucket."""
    small_batches(docs.sparkSession)
    all_rows = stash(sketches(docs, words, bands, rows, id_col, text_col), "sketches")
    some = all_rows.where("id is not null")
    classes = stash(some.groupBy("key").agg(F.min("id").alias("low")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = some.where("n > 0").join(classes, "key").where("id = low").dropDuplicates(["key"])

    once = some.count() == some.select("id").distinct().count()

    def texts_of(reps: DataFrame) -> DataFrame:
        """rep and text of some classes: that of the row with the class's smallest id, once."""
        wanted = classes.join(bounded(stash(reps.distinct(), "wanted")), "rep").select("rep", F.col("low").alias("__low"), F.col("key").alias("__key"))
        thin = docs.select(F.col(id_col).cast("long").alias("__id"), _key(text_col).alias("__own"), F.col(text_col).cast("string").alias("text"))
        found = thin.join(bounded(stash(wanted, "wanted")), (F.col("__id") == F.col("__low")) & (F.col("__own") == F.col("__key")))
        found = found.select("rep", "text")
        return found if once else found.dropDuplicates(["rep"])  # where no row repeats, joins stay free to split a member of many pairs
    banded = stash(reps.select("rep", "bands"), "reps").select("rep", F.explode("bands").alias("h"))
    chosen = banded.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("centre")).where("size > 1")
    inside = stash(banded.join(stash(chosen, "buckets"), "h"), "members")
    pair = [F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")]
    tested = stash(_verified(inside.where("rep <> centre").select(*pair).distinct(), texts_of, words), "pairs")
    linked = F.col("similarity") >= threshold
    found = components(tested.where(linked).select("a", "b"))

    apart = _apart(inside.where("size > 2"), found)
    others = apart.where("rep <> centre")
    chosen = others.groupBy("h").agg(F.min_by("rep", F.xxhash64("rep", "h")).alias("second"), F.min_by("component", F.xxhash64("rep", "h")).alias("home"))
    again = apart.join(stash(chosen, "buckets"), "h").where("component <> home").select(F.least("rep", "second").alias("a"), F.greatest("rep", "second").alias("b")).distinct()
    again = stash(_verified(again.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts_of, words), "pairs")
    tested = tested.unionByName(again)
    found = components(tested.where(linked).select("a", "b"))

    # All pairs of a bucket of three have been compared by now. Larger buckets that share members mostly hold the same few
    # documents: as long as such a cluster is small it is sent as one group, so that a document's windows are sent once and
    # not for every band; the buckets of larger clusters are sent each for itself.
    apart = _apart(apart.where("size > 3").select("h", "rep", "size", "centre"), found)
    lowest = apart.groupBy("h").agg(F.min("rep").alias("b"))
    clusters = components(apart.select("h", F.col("rep").alias("a")).join(lowest, "h"))
    clusters = clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    placed = apart.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "n"), "rep")
    small = F.col("n") <= CLUSTER
    grouped = placed.groupBy(small.alias("whole"), F.when(small, F.col("cluster")).otherwise(F.col("h")).alias("g"), F.when(small, F.col("n")).otherwise(F.col("size")).alias("size"), "rep", "component").agg(F.collect_set("h").alias("hs"))
    blocks = F.ceil(F.col("size") / F.when(F.col("whole"), F.greatest(F.lit(min(CLUSTER_BLOCK, BLOCK)), F.ceil(F.col("size") / CLUSTER_PARTS))).otherwise(F.lit(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int")
    dealt = grouped.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("whole", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "hs")
    sets = window_sets(texts_of(apart.select("rep")), words)

    def link(table: pa.Table) -> pa.Table:
        rep, comp, own, i, j = (table.column(c).to_numpy() for c in ("rep", "component", "own", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        root = np.arange(len(rep))
        if len(set(comp.tolist())) > 1:
            members = [_unpacked(x) for x in table.column("set").to_pylist()]
            buckets = [np.array(x, np.int64) for x in table.column("hs").to_pylist()]
            root = block_links(members, left, right, comp, threshold, buckets)
        moved = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"a": rep[moved].astype(np.int64), "b": rep[root[moved]].astype(np.int64)})

    late = dealt.join(sets.hint("merge"), "rep").groupBy("whole", "g", "i", "j").applyInArrow(link, "a long, b long")
    found = components(tested.where(linked).select("a", "b").unionByName(late))

    found = stash(found.withColumnRenamed("node", "rep"), "components")
    lowest = found.join(classes.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("lowest"))
    labels = stash(classes.join(found.join(lowest, "component"), "rep", "left").select("key", "low", F.coalesce("lowest", "low").alias("component_id")), "labels")
    with_id = F.col("id").isNotNull()
    out = all_rows.select("id", "key").join(labels, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(with_id, F.col("low")).alias("class_id"), F.when(with_id, F.col("component_id")).alias("component_id"), (~with_id | (F.col("id") == F.col("component_id"))).alias("kept"))


def _apart(inside: DataFrame, found: DataFrame) -> DataFrame:
    """The members (h, rep, size, centre) of buckets that hold more than one component, each with its component."""
    held = inside.select("h", "rep", "size", "centre").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = held.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    return stash(held.join(stash(open_, "open"), "h", "left_semi"), "apart")


def _verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int) -> DataFrame:
    """pairs (a, b) with the similarity of their texts."""
    pairs = stash(pairs, "candidates")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    # sorted joins at every size: adaptive execution splits what a member of many pairs would pile up
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ("ta", "tb"), 300):
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(pair_similarity(b.column("ta"), b.column("tb"), words))], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")
