"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors of a label are scaled to length 1, where a cosine of at least c is a distance of at most sqrt(2 - 2c). A label with more
vectors than a block holds is split around some of its own vectors, again and again, until its cells fit; a table keeps each
cell's centre and covering radius, and pairs of cells that are too far apart are dropped level by level, before any vector is
sent. Neighbouring cells share a block, and a vector goes to the blocks that hold a cell near its own. Every block is a cover tree whose levels are nested and halve their radius. Two blocks are compared from the roots down: a
pair of nodes is dropped when the distance of their centres is more than the limit and both covering radii, and taken whole,
without looking at its vectors, when it is so much less."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, components, stash

#: A block holds at most so many vectors and so many numbers; a larger cell is split around so many of its vectors.
BLOCK, BLOCK_VALUES, PIVOTS = 8192, 524_288, 64
#: Cells of a label that is split are split on while they are wider than the limit and hold more than this part of a block, so that
#: their bounds tell them apart.
FINE = 8
#: Rounds of splitting; cells that are too large even then, which are those of vectors all alike, are dealt by a hash.
ROUNDS = 12
#: Nodes of a tree with so many vectors or fewer are compared vector by vector.
LEAF = 32
#: Bounds keep this distance from the limit, so that rounding can't decide; nearer cosines are computed from the vectors as given.
_SLACK = 1e-7
_CLOSE = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nested levels: a node's centre is also the centre of its first child, whose radius is half. A node's vectors are a
    stretch of `order`; `radius` is the farthest of them from the centre as measured. x: rows of length 1; given: the rows that
    cosines near the threshold are computed from, x itself if there is nothing else."""

    def __init__(self, x: np.ndarray, given: np.ndarray | None = None) -> None:
        if not np.isfinite(x).all():
            raise ValueError("a cover tree takes finite vectors only")
        self.x = x
        self.given = x if given is None else given
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        dist = np.linalg.norm(x - x[0], axis=1)
        todo = [(self._node(0, dist, 0, len(x)), dist, 1.0)]  # node, distances of its stretch to its centre, next radius
        while todo:
            node, dist, r = todo.pop()
            lo, hi = self.span[node]
            if self.radius[node] == 0.0 or hi - lo <= LEAF:
                continue
            while r / 2 >= self.radius[node]:  # levels that would only repeat the node
                r /= 2
            at = lo
            idx = self.order[lo:hi].copy()
            for c, members, d in self._cover(self.centre[node], idx, dist, r):
                self.order[at : at + len(members)] = members
                kid = self._node(c, d, at, at + len(members))
                self.children[node].append(kid)
                todo.append((kid, d, r / 2))
                at += len(members)

    def _cover(self, centre: int, idx: np.ndarray, dist: np.ndarray, r: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Groups (centre, members, distances) that cover idx, none reaching beyond r and no centre within another's r."""
        near = dist <= r
        first = int(np.flatnonzero(idx[near] == centre)[0])
        members, d = idx[near], dist[near]
        order = np.concatenate([[first], np.delete(np.arange(len(members)), first)])
        yield centre, members[order], d[order]
        left = idx[~near]
        while len(left):
            # the next centres in their order, chosen among a few at a time so that distances are products of matrices
            some = left[:256]
            among = _distances(self.x[some], self.x[some])
            free, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    chosen.append(i)
                    free &= among[i] > r
            centres = some[chosen]
            rest = np.setdiff1d(left, centres, assume_unique=True)
            owner, far = np.full(len(rest), -1), np.zeros(len(rest))
            for s in range(0, len(rest), 4096):
                part = _distances(self.x[rest[s : s + 4096]], self.x[centres])
                best = part.argmin(1)
                far[s : s + 4096] = part[np.arange(len(part)), best]
                owner[s : s + 4096] = np.where(far[s : s + 4096] <= r, best, -1)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(len(centres) + 1))
            for j, c in enumerate(centres.tolist()):
                mine = rest[by[cuts[j] : cuts[j + 1]]]
                d = np.linalg.norm(self.x[mine] - self.x[c], axis=1)
                yield c, np.concatenate([[c], mine]), np.concatenate([[0.0], d])
            left = rest[owner < 0]

    def _node(self, centre: int, dist: np.ndarray, lo: int, hi: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(dist.max()))
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def members(self, node: int) -> np.ndarray:
        lo, hi = self.span[node]
        return self.order[lo:hi]


def dual_links(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For every vector of a the weight of the vectors of b that it links with, the same for b, and pairs (place in a, place
    in b) of links that join all that links join. With a is b each pair counts once for either side and none with itself."""
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    if limit <= _SLACK:
        raise ValueError("the cosine must be below 1")
    add_a, add_b = np.zeros(len(a.x) + 1), np.zeros(len(b.x) + 1)  # differences along the orders, for whole stretches
    one_a, one_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    sums_a = np.concatenate([[0.0], np.cumsum(weight_a[a.order])])
    sums_b = np.concatenate([[0.0], np.cumsum(weight_b[b.order])])
    joins: list[tuple[int, int]] = []
    twin = a is b
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = np.array(a.centre), np.array(b.centre)
    size_a, size_b = (np.array([e - s for s, e in t.span]) for t in (a, b))
    begin_a, begin_b = (np.array([s for s, _ in t.span]) for t in (a, b))
    leaf_a, leaf_b = (np.array([not k for k in t.children]) for t in (a, b))

    def whole(p: int, q: int) -> None:
        (s, e), (t, f) = a.span[p], b.span[q]
        add_a[s] += sums_b[f] - sums_b[t]
        add_a[e] -= sums_b[f] - sums_b[t]
        add_b[t] += sums_a[e] - sums_a[s]
        add_b[f] -= sums_a[e] - sums_a[s]
        first, other = int(a.order[s]), int(b.order[t])
        joins.extend((int(m), other) for m in a.members(p))
        joins.extend((first, int(m)) for m in b.members(q)[1:])

    def singles(u: np.ndarray, v: np.ndarray, cos: np.ndarray) -> None:
        """Pairs of vectors with their cosines as far as products of matrices give them."""
        linked = cos >= cosine
        for k in np.flatnonzero(np.abs(cos - cosine) < _CLOSE):
            x, y = a.given[u[k]], b.given[v[k]]
            linked[k] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= cosine
        u, v = u[linked], v[linked]
        np.add.at(one_a, u, weight_b[v])
        np.add.at(one_b, v, weight_a[u])
        joins.extend(zip(u.tolist(), v.tolist()))

    def each(p: int, q: int) -> None:
        """All vectors of two nodes."""
        u, v = a.members(p), b.members(q)
        cos = a.x[u] @ b.x[v].T
        near = cos >= cosine - _CLOSE
        if twin and p == q:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        singles(u[i], v[j], cos[i, j])

    def small(p: np.ndarray, q: np.ndarray) -> None:
        """All vectors of many pairs of small nodes at once."""
        per = size_a[p] * size_b[q]
        for some in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(per) // 50_000)) + 1):
            n = per[some]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(size_b[q[some]], n)
            u = a.order[np.repeat(begin_a[p[some]], n) + k // wide]
            v = b.order[np.repeat(begin_b[q[some]], n) + k % wide]
            cos = np.einsum("ij,ij->i", a.x[u], b.x[v])
            near = cos >= cosine - _CLOSE
            singles(u[near], v[near], cos[near])

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        p, q = stack.pop()
        same = twin and p == q
        if same and 2.0 * ra[p] <= limit - _SLACK:  # any two of its vectors are within twice its radius
            m = a.members(p)
            one_a[m] += weight_a[m].sum() - weight_a[m]
            joins.extend((int(i), int(m[0])) for i in m[1:])
            continue
        if not a.children[p] and not b.children[q]:
            each(p, q)
            continue
        kids_p = a.children[p] if a.children[p] and (same or ra[p] >= rb[q] or not b.children[q]) else [p]
        kids_q = b.children[q] if b.children[q] and (same or rb[q] >= ra[p] or not a.children[p]) else [q]
        every_q = np.array(kids_q)
        for lo in range(0, len(kids_p), 256):
            kp = np.array(kids_p[lo : lo + 256])
            for at in range(lo if same else 0, len(every_q), 8192):
                kq = every_q[at : at + 8192]
                cos = a.x[ca[kp]] @ b.x[cb[kq]].T
                dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
                bound = ra[kp][:, None] + rb[kq][None, :]
                alive = dist - bound <= limit + _SLACK
                if same:  # each pair of children once
                    alive &= (lo + np.arange(len(kp)))[:, None] <= (at + np.arange(len(kq)))[None, :]
                i, j = np.nonzero(alive)
                own = kp[i] == kq[j] if same else np.zeros(len(i), bool)
                alone = (size_a[kp[i]] == 1) & (size_b[kq[j]] == 1)
                inside = ~alone & ~own & (dist[i, j] + bound[i, j] <= limit - _SLACK)
                some = alone & ~own
                singles(ca[kp[i[some]]], cb[kq[j[some]]], cos[i[some], j[some]])
                for x, y in zip(kp[i[inside]].tolist(), kq[j[inside]].tolist()):
                    whole(x, y)
                open_ = ~inside & ~alone
                few = open_ & ~own & leaf_a[kp[i]] & leaf_b[kq[j]]
                if few.any():
                    small(kp[i[few]], kq[j[few]])
                open_ &= ~few
                stack.extend(zip(kp[i[open_]].tolist(), kq[j[open_]].tolist()))
    got_a, got_b = one_a.copy(), one_b.copy()
    got_a[a.order] += np.cumsum(add_a)[:-1]
    got_b[b.order] += np.cumsum(add_b)[:-1]
    if twin:
        got_a = got_a + got_b
    return got_a, got_b, joins


def _forest(n: int, joins: list[tuple[int, int]]) -> np.ndarray:
    """The least place that each of n places is joined with."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q in joins:
        p, q = find(p), find(q)
        root[max(p, q)] = min(p, q)
    return np.array([find(i) for i in range(n)], np.int64) if n else root


_KIND = ["label", "dim"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _split(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Some rows of a cell, each with the nearest pivot's number as its new cell, and the distance."""
    if not rows.num_rows:
        return pa.table({"num": pa.array([], pa.int64()), "to": pa.array([], pa.string()), "dist": pa.array([], pa.float64())})
    pivots = pivots.sort_by("pivot")
    p = _unit(_matrix(pivots.column("v")))
    d = _distances(_unit(_matrix(rows.column("v"))), p)
    best = d.argmin(1)
    names = [f"{rows.column('cell')[0].as_py()}.{k}" for k in pivots.column("pivot").to_pylist()]
    return pa.table({"num": rows.column("num"), "to": pa.array([names[i] for i in best.tolist()]), "dist": pa.array(d[np.arange(len(d)), best])})


def _room(dim: Column) -> Column:
    """How many vectors of so many numbers a block holds."""
    return F.greatest(F.lit(min(BLOCK, 64)), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / dim))).cast("int")


def _cells(reps: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """The cell of each vector (num, cell), and the pairs of cells (label, dim, cell, other) that may hold links, either way
    round and each with itself. A cell's name is the path of pivots that led to it. Each round reads only the rows of the cells
    that it splits; a label that fits in a block isn't split at all."""
    at = reps.select("num", *_KIND, F.lit("").alias("cell"))
    known = reps.select(*_KIND).distinct().select(*_KIND, F.lit("").alias("cell"), F.lit("").alias("other"))
    pairs = stash(known, "cell_pairs")
    radius = at.groupBy(*_KIND, "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.lit(4.0))
    sizes = stash(radius, "cell_sizes")
    for turn in range(ROUNDS):
        full = F.col("n") > _room(F.col("dim"))
        wide = (F.col("cell") != "") & (F.col("n") > _room(F.col("dim")) / FINE) & (F.col("r") > limit)
        big = sizes.where((full & (F.col("r") > limit / 2)) | wide).select(*_KIND, "cell", "n")
        if big.isEmpty():
            break
        big = stash(big, "big_cells")
        rows = at.join(bounded(big), [*_KIND, "cell"]).join(reps.select("num", "v"), "num")
        rows = stash(rows, "cell_rows")
        # pivots: some four times as many as needed by hash, of these the first
        h = F.xxhash64("num", F.lit(turn))
        few = rows.where(F.pmod(h, F.lit(1 << 30)) < (4 * PIVOTS / F.col("n") * (1 << 30)).cast("long")).groupBy(*_KIND, "cell").agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), "num", "v"))).alias("p"))
        few = few.select(*_KIND, "cell", F.posexplode(F.slice("p", 1, PIVOTS)).alias("pivot", "x")).select(*_KIND, "cell", "pivot", "x.v")
        few = stash(few, "pivots")
        salts = F.ceil(F.col("n") / _room(F.col("dim"))).cast("int")
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("num", F.lit("salt")), salts).cast("int"))
        spread = few.join(F.broadcast(big) if big.count() < 100_000 else big, [*_KIND, "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
        key = [*_KIND, "cell", "salt"]
        moved = dealt.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(_split, "num long, to string, dist double")
        moved = stash(moved, "moved")
        at = stash(at.join(moved.select("num", "to"), "num", "left").select("num", *_KIND, F.coalesce("to", "cell").alias("cell")), "cells")
        new = rows.select("num", *_KIND, "cell").join(moved, "num").groupBy(*_KIND, F.col("cell").alias("parent"), F.col("to").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"))
        new = new.join(few.select(*_KIND, F.concat_ws(".", F.col("cell"), F.col("pivot").cast("string")).alias("cell"), F.col("v").alias("centre")), [*_KIND, "cell"])
        new = stash(new.withColumn("centre", _unit_column(F.col("centre"))), "new_cells")
        old = sizes.join(big.select(*_KIND, "cell"), [*_KIND, "cell"], "left_anti")
        nothing = F.lit(None).cast("array<double>")
        old = old if "centre" in old.columns else old.withColumn("centre", nothing)
        sizes = stash(old.select(*_KIND, "cell", "n", "r", "centre").unionByName(new.select(*_KIND, "cell", "n", "r", "centre")), "cell_sizes")
        kids = new.select(*_KIND, "parent", F.col("cell").alias("kid"), F.col("r"), "centre").unionByName(old.select(*_KIND, F.col("cell").alias("parent"), F.col("cell").alias("kid"), "r", "centre"))
        kids = stash(kids, "kids")
        left = kids.select(*_KIND, F.col("parent").alias("cell"), F.col("kid").alias("c"), F.col("r").alias("r1"), F.col("centre").alias("x"))
        right = kids.select(*_KIND, F.col("parent").alias("other"), F.col("kid").alias("o"), F.col("r").alias("r2"), F.col("centre").alias("y"))
        apart = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
        pairs = pairs.join(left, [*_KIND, "cell"]).join(right, [*_KIND, "other"])
        pairs = pairs.where((F.col("c") == F.col("o")) | F.coalesce(apart - F.col("r1") - F.col("r2") <= limit + 2 * _SLACK, F.lit(True)))
        pairs = stash(pairs.select(*_KIND, F.col("c").alias("cell"), F.col("o").alias("other")), "cell_pairs")
    return at, pairs


def _deal(reps: DataFrame, limit: float) -> DataFrame:
    """num, label, dim, own (the block of each vector) and to: a row for each block that holds a cell near the vector's own.

    Cells smaller than a block share blocks, in the order of their names; larger ones are dealt over some by a hash."""
    at, pairs = _cells(reps, limit)
    sizes = at.groupBy(*_KIND, "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("subs", F.ceil(F.col("n") / _room(F.col("dim"))).cast("int"))
    before = Window.partitionBy(*_KIND, F.col("subs") > 1).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.concat(F.lit("b"), F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / _room(F.col("dim"))).cast("string"))
    sizes = stash(sizes.withColumn("block", F.when(F.col("subs") > 1, F.concat(F.lit("c"), "cell")).otherwise(shared)), "blocks")
    names = F.when(F.col("subs") > 1, F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda k: F.concat(F.col("block"), F.lit("/"), k.cast("string")))).otherwise(F.array("block"))
    near = pairs.join(sizes.select(*_KIND, F.col("cell").alias("other"), names.alias("names")), [*_KIND, "other"])
    near = near.select(*_KIND, "cell", F.explode("names").alias("to")).distinct().join(sizes.select(*_KIND, "cell", "subs", "block"), [*_KIND, "cell"])
    near = bounded(stash(near, "near_cells"))
    own = F.when(F.col("subs") > 1, F.concat(F.col("block"), F.lit("/"), F.pmod(F.xxhash64("num"), F.col("subs")).cast("string"))).otherwise(F.col("block"))
    return at.join(near, [*_KIND, "cell"]).select("num", *_KIND, own.alias("own"), "to")


def _unit_column(v: Column) -> Column:
    """A vector of length 1; components are first divided by the largest."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    near = F.transform(v, lambda x: x / top)
    norm = F.sqrt(F.aggregate(near, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(near, lambda x: x / norm)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links (how many other rows of its label have a cosine of at least `cosine` with
    it), component_id (the smallest id reachable by links, itself included) and kept (the id is that id).

    cosine is above -1 and below 1. Only rows with equal labels that are not null are compared, in double precision and whatever
    the vectors' magnitudes. A vector that is null, empty, all zero, or holds null or non-finite components links with nothing,
    nor do rows without an id; vectors of different lengths don't link. Ids should be unique; repeated rows count as other
    rows. Extra columns are ignored; an empty table gives an empty result.

    Equal vectors are one weighted vector throughout. Links are counted where they are found and only a forest of them leaves
    a task, so a group of near copies costs its size, not its square. A vector is sent once for each block that it may
    have a link in; where vectors have no structure at all, that is every block of the label."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    parts = F.concat_ws("|", F.length("label").cast("string"), F.size("v").cast("string"), F.hex(F.xxhash64(F.lit(1), "label", "v")), F.hex(F.xxhash64(F.lit(2), "v", "label")))
    rows = stash(rows.withColumn("key", F.when(F.col("fine"), parts)), "vectors")
    classes = rows.where("fine").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = stash(classes.withColumn("num", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "reps")

    limit = float(np.sqrt(2.0 - 2.0 * cosine))
    cut = reps.select("num", "copies", "v").join(_deal(reps, limit), "num")
    # each pair of blocks once
    cut = cut.select(*_KIND, F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), (F.col("own") <= F.col("to")).alias("first"), "num", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("num")
        num, weight, first = table.column("num").to_numpy(), table.column("copies").to_numpy().astype(float), table.column("first").to_numpy(zero_copy_only=False)
        given = scaled(_matrix(table.column("v")))
        x = _unit(given)
        twin = table.column("p")[0] == table.column("q")[0]
        pa_ = np.arange(len(num)) if twin else np.flatnonzero(first)
        pb_ = pa_ if twin else np.flatnonzero(~first)
        out_num, out_n, out_to = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pa_) and len(pb_):
            ta = CoverTree(x[pa_], given[pa_])
            tb = ta if twin else CoverTree(x[pb_], given[pb_])
            na, nb, joins = dual_links(ta, tb, cosine, weight[pa_], weight[pb_])
            n = np.zeros(len(num))
            n[pa_] += na
            if not twin:
                n[pb_] += nb
            root = _forest(len(num), [(int(pa_[i]), int(pb_[j])) for i, j in joins])
            some = np.flatnonzero((n > 0) | (root != np.arange(len(num))))
            out_num, out_n, out_to = num[some], np.rint(n[some]).astype(np.int64), num[root[some]]
        return pa.table({"num": out_num, "n": out_n, "to": out_to})

    links = stash(cut.groupBy(*_KIND, "p", "q").applyInArrow(compare, "num long, n long, to long"), "links")
    counts = links.groupBy("num").agg(F.sum("n").alias("n"))
    found = stash(components(links.select(F.col("num").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "num"), "components")
    lowest = found.join(reps.select("num", "low"), "num").groupBy("component").agg(F.min("low").alias("lowest"))
    labels = reps.select("key", "num", "low", "copies").join(counts, "num", "left").join(found.join(lowest, "component"), "num", "left")
    labels = stash(labels.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component")), "labels")
    out = rows.select("id", "key").join(labels, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
