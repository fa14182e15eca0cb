"""Syntax rules: autocorrelations, pseudo composition and profile features. Everything about one sequence is computed from its
own arrays, without a shuffle. Results are long: seq_id, feature, value. Sequences too short for a lag have no row for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import tables as T
from ..functions.exprs import letters, rounded


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _along(weights: list[list[float]]) -> Column:
    """Scores of a motif at each start along m, negative ones as 0."""
    flat = F.array(*[F.lit(float(x)) for r in weights for x in r])
    width = len(weights)
    return F.transform(F.sequence(F.lit(0), F.col("n") - width), lambda s: F.greatest(F.lit(0.0), _sum(F.zip_with(F.flatten(F.slice("m", s + 1, F.lit(width))), flat, lambda a, b: a * b))))


class Windows:
    """The values of properties along the windows of sequences: x has a row for each property and a place for each window, NaN where a
    table doesn't have the word. row, pos and n: each window's sequence, its place, and how many windows that sequence has."""

    def __init__(self, column: pa.Array, k: int, props: dict[str, dict[str, float]]) -> None:
        letters_ = "".join(sorted({c for t in props.values() for w in t for c in w}))
        place = {c: i for i, c in enumerate(letters_)}
        table = np.full((len(props), len(letters_) ** k), np.nan)
        for i, t in enumerate(props.values()):
            for w, x in t.items():
                code = 0
                for ch in w:
                    code = code * len(letters_) + place[ch]
                table[i, code] = x
        codes, at = A.letter_codes(column, letters_)
        self.rows = len(column)
        self.row, self.pos, code = A.word_codes(codes, at, k, len(letters_))
        self.size = np.maximum(np.diff(at) - (k - 1), 0)
        self.n = self.size[self.row]
        self.x = np.where(code >= 0, table[:, np.maximum(code, 0)], np.nan)

    def sums(self, values: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """values summed up for each sequence, over the windows `some` that they belong to."""
        return np.bincount(self.row if some is None else self.row[some], values, self.rows)

    def ahead(self, lag: int) -> np.ndarray:
        """The windows that have another so many places on."""
        return np.flatnonzero(self.pos < self.n - lag)


def _features(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Result rows of (feature, sequences, their values); NaN is null."""
    names = [f for f, _, _ in parts]
    rows = np.concatenate([r for _, r, _ in parts]) if parts else np.zeros(0, np.int64)
    index = np.repeat(np.arange(len(parts)), [len(r) for _, r, _ in parts])
    values = np.concatenate([v for _, _, v in parts]) if parts else np.zeros(0)
    return rows, {"feature": A.strings(names, index), "value": pa.array(values, from_pandas=True)}


def covariance(seqs: DataFrame, kind: str, lags: int, k: int, props: dict[str, dict[str, float]], digits: int = 8) -> DataFrame:
    """kind 'ac' (DAC, TAC, AC), 'cc' (DCC, TCC, CC) or 'acc' (both). Means leave a sequence's last window out; the second factor of
    an autocovariance isn't centred; a cross covariance is that of every ordered pair of different properties, both centred."""
    names = list(props)

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        w = Windows(column, k, props)
        inner = w.pos < w.n - 1
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.stack([w.sums(x * inner) for x in w.x]) / (w.size - 1)
        parts = []
        for g in range(1, lags + 1):
            some = w.ahead(g)
            has = np.flatnonzero(w.size > max(g, 1))
            centred = w.x[:, some] - mean[:, w.row[some]]
            later = w.x[:, some + g]
            m = w.size[has] - g
            if kind in ("ac", "acc"):
                parts += [(f"ac|{g}|{p}", has, A.half_up(w.sums(centred[i] * later[i], some)[has] / m, digits)) for i, p in enumerate(names)]
            if kind in ("cc", "acc"):
                later = later - mean[:, w.row[some]]
                parts += [(f"cc|{g}|{p}|{q}", has, A.half_up(w.sums(centred[i] * later[j], some)[has] / m, digits)) for i, p in enumerate(names) for j, q in enumerate(names) if i != j]
        return _features(parts)

    return A.by_row(seqs, 4 * len(names) * lags, made, "feature string, value double")


def autocorrelation(seqs: DataFrame, kind: str, lag: int, k: int, props: dict[str, dict[str, float]], digits: int = 3) -> DataFrame:
    """kind 'moran', 'geary' or 'moreau' at one lag, 0 < lag < 16. A constant property gives no value (null)."""
    if not 0 < lag < 16:
        raise ValueError("the lag must be from 1 to 15")

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        w = Windows(column, k, props)
        some, has = w.ahead(lag), np.flatnonzero(w.size > lag)
        n = np.maximum(w.size, 1)
        m = np.maximum(w.size - lag, 1)
        parts = []
        for p, x in zip(props, w.x):
            one, two = x[some], x[some + lag]
            if kind == "moreau":
                value = w.sums(one * two, some) / m
            else:
                mean = w.sums(x) / n
                if kind == "moran":
                    top = w.sums((one - mean[w.row[some]]) * (two - mean[w.row[some]]), some) / m
                    bottom = w.sums((x - mean[w.row]) ** 2) / n
                else:
                    top = w.sums((one - two) ** 2, some) * n
                    bottom = w.sums((one - mean[w.row[some]]) ** 2, some) * m * 2
                flat = ~(np.abs(bottom) > 1e-12)
                value = np.where(flat, np.nan, top / np.where(flat, 1.0, bottom))
            parts.append((p, has, A.half_up(value[has], digits)))
        return _features(parts)

    return A.by_row(seqs, 4 * len(props), made, "feature string, value double")


def nd(seqs: DataFrame, digits: int = 3) -> DataFrame:
    """seq_id, pos, value: how often the letter at pos has occurred up to there, by the letters so far; 0 for X."""
    from pyspark.sql import Window

    rows = seqs.select("seq_id", F.posexplode(letters(F.col("seq"))).alias("pos", "letter"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("seq_id", "letter").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("seq_id", "pos", F.when(F.col("letter") == "X", 0.0).otherwise(F.round(seen / (F.col("pos") + 1), digits)).alias("value"))


def zcpseknc(seqs: DataFrame, k: int, lamada: int, w: float, digits: int = 8, alphabet: str = T.DNA) -> DataFrame:
    """Z-curve pseudo k-tuple composition: x, y and z of each (k - 1)-letter prefix in each codon phase by the windows, then the
    theta of each lag to lamada, all by their sum. Phase 1 begins at starts 2, 5, ..., phase 2 at 0, phase 3 at 1. Windows with a
    letter that isn't in the alphabet count for nothing but their number."""
    size = len(alphabet)
    prefixes = T.universe(k - 1, alphabet) if k > 1 else [""]
    names = [f"{a}|{p}|{f}" for a in "xyz" for p in prefixes for f in (1, 2, 3)] + [f"theta|{g}" for g in range(1, lamada + 1)]
    signs = np.array([[1 if c in plus else -1 for c in alphabet] for plus in ("AG", "AC", "AT")])

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        codes, at = A.letter_codes(column, alphabet)
        row, pos, code = A.word_codes(codes, at, k, size)
        rows, n = len(column), np.maximum(np.diff(at) - (k - 1), 0)
        share = 1 / np.maximum(n, 1)
        known = code >= 0
        cell = (code // size) * 3 + (pos + 1) % 3
        cells = 3 * len(prefixes)
        there = A.count_codes(row, np.where(known, cell, -1), rows, cells) > 0
        values = []
        for s in signs:
            total = np.bincount(row[known] * cells + cell[known], s[code[known] % size], rows * cells).reshape(rows, cells)
            values.append(np.where(there, total * share[:, None], np.nan))
        # how frequent each window's word is in its sequence
        _, back, times = np.unique(row * size**k + np.maximum(code, 0), return_inverse=True, return_counts=True)
        often = times[back] * share[row] * known
        for g in range(1, lamada + 1):
            some = np.flatnonzero(pos < n[row] - g)
            sums = np.bincount(row[some], (often[some] - often[some + g]) ** 2, rows)
            values.append(np.where(n > g, sums / np.maximum(n - g, 1) * w, np.nan)[:, None])
        all_ = np.concatenate(values, 1)
        total = np.nansum(all_, 1)
        i, j = np.nonzero(~np.isnan(all_) & (np.abs(total) > 1e-9)[:, None])
        return i, {"feature": A.strings(names, j), "value": pa.array(A.half_up(all_[i, j] / total[i], digits))}

    return A.by_row(seqs, 2 * len(names), made, "feature string, value double")


def z_scored(props: dict[str, dict[str, float]], sample: bool) -> dict[str, dict[str, float]]:
    """property -> word -> z-score, two decimals."""
    return {p: T.standardised(v, sample) for p, v in props.items()}


# ---- profiles: rows (seq_id, pos, vec), a supplied profile or BLOSUM62's ------------------------------------------------


def _matrix(rows: DataFrame) -> DataFrame:
    """seq_id, m (the rows of a profile in order), n."""
    got = rows.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda r: r["vec"]).alias("m"))
    return got.withColumn("n", F.size("m"))


def _each_profile(rows: DataFrame, made, fields: str) -> DataFrame:
    """What `made` gives for each sequence's profile, an array of its rows in order: columns of results, one group at a time. Rows
    (seq_id, pos, vec) are shuffled once; a group is one sequence."""
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        vec = table.column("vec").combine_chunks()
        m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        columns = made(m)
        n = len(next(iter(columns.values())))
        return pa.table({"seq_id": table.column("seq_id").take(pa.array(np.zeros(n, np.int64))), **{k: pa.array(v) for k, v in columns.items()}})

    return rows.select("seq_id", "pos", "vec").groupBy("seq_id").applyInArrow(run, f"seq_id {kind}, {fields}")


def _lagged(m: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """lag, i, j, value: the mean product of column i and, a lag later, column j."""
    lag, value, width = [], [], m.shape[1]
    for d in range(1, min(lags, len(m) - 1) + 1):
        lag.append(np.full(width * width, d, np.int32))
        value.append((m[:-d].T @ m[d:] / (len(m) - d)).ravel())
    n = len(lag)
    i, j = (np.tile(x.ravel().astype(np.int32), n) for x in np.indices((width, width)))
    return {"lag": np.concatenate(lag) if n else np.zeros(0, np.int32), "i": i, "j": j, "value": np.concatenate(value) if n else np.zeros(0)}


def pssm_dt(rows: DataFrame, lags: int = 4, digits: int = 6) -> DataFrame:
    """seq_id, lag, i, j, value: the mean of column i times column j of the row at lag, over the rows that have one."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        out = _lagged(m, lags)
        return out | {"value": A.half_up(out["value"] + 1e-9, digits)}

    return _each_profile(rows, made, "lag int, i int, j int, value double")


def _matrix_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of each letter among BLOSUM62's and the offsets of the rows, as letter_codes() has them, without other letters."""
    codes, at = A.letter_codes(column, "".join(T.BLOSUM62))
    if len(codes) and codes.min() < 0:
        raise ValueError("a sequence has a letter that BLOSUM62 doesn't have")
    return codes, at


def letter_pair_dt(seqs: DataFrame, lags: int = 4, digits: int = 6) -> DataFrame:
    """pssm_dt() for the BLOSUM62 rows: a pair of rows depends on its two letters alone, so that a sequence's 20 x 20 letter pairs
    are counted where it stands and the counts multiplied by the matrix from both sides. Letters that the matrix doesn't have
    are in no pair."""
    letters_, size = "".join(T.BLOSUM62), len(T.BLOSUM62)
    matrix = np.array([T.BLOSUM62[a] for a in letters_], float)
    cells = np.arange(matrix.shape[1] ** 2)
    i, j = np.divmod(cells, matrix.shape[1])

    def made(column: pa.Array):
        codes, at = A.letter_codes(column, letters_)
        of = A.row_of(at)
        row, lag, value = [], [], []
        for d in range(1, lags + 1):
            here = np.flatnonzero(of[d:] == of[:-d]) if len(of) > d else np.zeros(0, np.int64)
            x, y = codes[here], codes[here + d]
            counts = A.count_codes(of[here], np.where((x >= 0) & (y >= 0), x * size + y, -1), len(column), size * size)
            some = np.flatnonzero(counts.any(1))
            sums = matrix.T @ counts[some].reshape(-1, size, size) @ matrix
            row.append(some)
            lag.append(np.full(len(some), d, np.int32))
            value.append(sums.reshape(len(some), len(cells)) / counts[some].sum(1)[:, None])
        row, lag, value = np.concatenate(row), np.concatenate(lag), np.concatenate(value)
        value = A.half_up(value + 1e-9, digits)  # exact halves round up
        n = len(row)
        return np.repeat(row, len(cells)), {"lag": pa.array(np.repeat(lag, len(cells))), "i": pa.array(np.tile(i, n).astype(np.int32)), "j": pa.array(np.tile(j, n).astype(np.int32)), "value": pa.array(value.ravel())}

    return A.by_row(seqs, len(cells) * lags * 2, made, "lag int, i int, j int, value double")


def acc_pssm(rows: DataFrame, lags: int, digits: int = 3) -> DataFrame:
    """seq_id, kind, lag, i, j, value: auto (ac, i = j) and cross (cc) covariances of the centred columns of a profile, for every lag
    that the sequence has."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        out = _lagged(m - m.mean(0), lags)
        kind = pa.array(np.where(out["i"] == out["j"], "ac", "cc").astype(object), pa.string())  # a profile of one row has no lag
        return {"kind": kind, **out, "value": A.half_up(out["value"] + 1e-9, digits)}

    return _each_profile(rows, made, "kind string, lag int, i int, j int, value double")


def letter_acc(seqs: DataFrame, lags: int, kind: str = "acc", digits: int = 3) -> DataFrame:
    """acc_pssm() for the BLOSUM62 rows, with kind 'ac' or 'cc' one half of it: seq_id, kind, lag, i, j, value. Sums of products come from
    the letter pairs that a sequence has at a lag, sums over rows from its letters, those at its ends taken off. A letter that the
    matrix doesn't have fails."""
    matrix = np.array(list(T.BLOSUM62.values()), float)
    size, width = matrix.shape
    i, j = (x.ravel() for x in np.indices((width, width)))
    some = np.flatnonzero({"acc": i >= 0, "ac": i == j, "cc": i != j}[kind])
    i, j = i[some], j[some]

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        codes, at = _matrix_codes(column)
        of, n = A.row_of(at), np.diff(at)
        pos = np.arange(len(codes)) - at[:-1][of]
        total = A.count_codes(of, codes, len(column), size) @ matrix
        row, lag, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, len(some)))]
        for d in range(1, lags + 1):
            has = np.flatnonzero(n > d)
            here = np.flatnonzero(pos < n[of] - d)
            pairs = A.count_codes(of[here], codes[here] * size + codes[here + d], len(column), size * size)[has].reshape(-1, size, size)
            last, first = (A.count_codes(of[x], codes[x], len(column), size)[has] @ matrix for x in (np.flatnonzero(pos >= n[of] - d), np.flatnonzero(pos < d)))
            whole, m = total[has], (n[has] - d)[:, None]
            mean = whole / n[has][:, None]
            if kind == "ac":
                sums = ((pairs @ matrix) * matrix).sum(1)
            else:
                sums = (matrix.T @ pairs @ matrix).reshape(len(has), width * width)[:, some]
            sums = sums - mean[:, i] * (whole - first)[:, j] - mean[:, j] * (whole - last)[:, i] + m * mean[:, i] * mean[:, j]
            row.append(has)
            lag.append(np.full(len(has), d, np.int32))
            value.append(sums / m)
        row, lag, value = np.concatenate(row), np.concatenate(lag), np.concatenate(value)
        k = len(row)
        columns = {"kind": A.strings(["cc", "ac"], np.tile(i == j, k)), "lag": pa.array(np.repeat(lag, len(some))), "i": pa.array(np.tile(i, k).astype(np.int32)), "j": pa.array(np.tile(j, k).astype(np.int32))}
        return np.repeat(row, len(some)), {**columns, "value": pa.array(A.half_up(value.ravel() + 1e-9, digits))}

    return A.by_row(seqs, size * size * lags * 2, made, "kind string, lag int, i int, j int, value double")


def ac_pssm(rows: DataFrame, lags: int, digits: int = 3) -> DataFrame:
    """seq_id, lag, i, value: autocovariance of each centred profile column."""
    return acc_pssm(rows, lags, digits).where("kind = 'ac'").select("seq_id", "lag", "i", "value")


def cc_pssm(rows: DataFrame, lags: int, digits: int = 3) -> DataFrame:
    """seq_id, lag, i, j, value: cross covariance of different centred columns."""
    return acc_pssm(rows, lags, digits).where("kind = 'cc'").select("seq_id", "lag", "i", "j", "value")


def pssm_rt(rows: DataFrame, length: int, digits: int = 6) -> DataFrame:
    """seq_id, part, a, b, value of profiles squashed by 1 / (1 + e^x) and cut or padded to `length` rows: 'residue' (row a,
    column b), 'pair' (the sum over rows i <> t of products with the middle row t, the first such row twice) and 'multi' (for
    columns 0 to 4 the sums above and below the middle). t is length / 2, one more for an odd length."""
    t = length // 2 + length % 2
    t = min(t, length - 1)
    m = _matrix(rows.where(F.col("pos") < length))
    zeros = F.array(*[F.lit(0.0)] * 20)
    m = m.select("seq_id", F.transform(F.concat("m", F.array_repeat(zeros, F.lit(length) - F.col("n"))), lambda r: F.transform(r, lambda x: 1 / (1 + F.exp(x)))).alias("m"))
    long = m.select("seq_id", F.posexplode("m").alias("a", "r"), F.element_at("m", t + 1).alias("mid"))
    cells = long.select("seq_id", "a", "mid", F.posexplode("r").alias("b", "x"))
    residue = cells.select("seq_id", F.lit("residue").alias("part"), "a", "b", F.col("x").alias("value"))
    first = 0 if t else 1
    times = F.when(F.col("a") == t, 0.0).when(F.col("a") == first, 2.0).otherwise(1.0)
    pair = cells.select("seq_id", F.col("b").alias("i"), (F.col("x") * times).alias("x"), F.posexplode("mid").alias("j", "y")).groupBy("seq_id", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    pair = pair.select("seq_id", F.lit("pair").alias("part"), F.col("i").alias("a"), F.col("j").alias("b"), "value")
    side = F.when(F.col("a") < t - 1, 0).when(F.col("a") >= t, 1)
    multi = cells.where("b < 5").withColumn("side", side).where("side is not null").groupBy("seq_id", F.col("side").alias("a"), "b").agg(F.sum("x").alias("value")).select("seq_id", F.lit("multi").alias("part"), "a", "b", "value")
    return residue.unionByName(pair).unionByName(multi).withColumn("value", rounded(F.col("value"), digits))


def pssm_rt_whole(rows: DataFrame, digits: int = 6) -> DataFrame:
    """The parts 'pair' and 'multi' of pssm_rt() for profiles as long as they are, neither cut nor padded: t is the middle of each."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        x = 1 / (1 + np.exp(m))
        n, width = x.shape
        t = min(n // 2 + n % 2, n - 1)
        times = np.ones(n)
        times[t] = 0.0
        if n > 1:
            times[0 if t else 1] = 2.0
        pair = np.outer(times @ x, x[t])
        sides = [x[: max(t - 1, 0), :5].sum(0), x[t:, :5].sum(0)]
        a, b = np.indices(pair.shape)
        c, d = np.indices((2, 5))
        out = {"part": np.array(["pair"] * pair.size + ["multi"] * 10, object), "a": np.concatenate([a.ravel(), c.ravel()]).astype(np.int32), "b": np.concatenate([b.ravel(), d.ravel()]).astype(np.int32)}
        return out | {"value": A.half_up(np.concatenate([pair.ravel(), np.concatenate(sides)]) + 1e-9, digits)}

    return _each_profile(rows, made, "part string, a int, b int, value double")


def motif_scores(rows: DataFrame, motifs: dict[str, list[list[float]]], digits: int = 6) -> DataFrame:
    """seq_id, motif, mean, peak: a motif's weights (rows of 20, in the profile's order) slide along the profile; negative scores
    are 0, neighbours in pairs give their larger one, and of these mean and maximum are kept. Profiles shorter than a motif have
    no row."""
    m = _matrix(rows)
    made = []
    for name, weights in motifs.items():
        made.append(F.when(F.col("n") >= len(weights), F.struct(F.lit(name).alias("motif"), _along(weights).alias("s"))))
    long = m.select("seq_id", F.explode(F.array(*made)).alias("r")).where("r is not null").select("seq_id", "r.motif", "r.s")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 2).cast("int")), lambda i: F.greatest(F.element_at("s", 2 * i + 1), F.when(2 * i + 2 <= F.size("s"), F.element_at("s", F.least(2 * i + 2, F.size("s"))))))
    pooled = long.select("seq_id", "motif", pairs.alias("p"))
    return pooled.select("seq_id", "motif", rounded(_sum(F.col("p")) / F.size("p"), digits).alias("mean"), rounded(F.array_max("p"), digits).alias("peak"))


def letter_motif_scores(seqs: DataFrame, motifs: dict[str, list[list[float]]], digits: int = 6) -> DataFrame:
    """motif_scores() for the BLOSUM62 rows: what a letter adds at each row of a motif is a fixed number, so that a sequence is scored
    from its letters where it stands."""
    matrix = np.array(list(T.BLOSUM62.values()), float)
    names, gains = list(motifs), [np.array(w, float) @ matrix.T for w in motifs.values()]

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        codes, at = _matrix_codes(column)
        rows, index, mean, peak = [], [], [], []
        for k, gain in enumerate(gains):
            n = np.maximum(np.diff(at) - (len(gain) - 1), 0)
            row, begins = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            pos = np.arange(n.sum()) - begins[row]
            start = at[:-1][row] + pos
            score = np.zeros(len(row))
            for r, g in enumerate(gain):
                score += g[codes[start + r]]
            score = np.maximum(score, 0.0)
            even = np.flatnonzero(pos % 2 == 0)
            paired = pos[even] < n[row[even]] - 1
            best = score[even]
            best[paired] = np.maximum(best[paired], score[even[paired] + 1])
            has, times = np.flatnonzero(n), -(-n // 2)
            rows.append(has)
            index.append(np.full(len(has), k))
            mean.append(np.bincount(row[even], best, len(n))[has] / times[has])
            peak.append(np.maximum.reduceat(best, (np.cumsum(times) - times)[has]) if len(has) else np.zeros(0))
        mean, peak = (pa.array(A.half_up(np.concatenate(x), digits)) for x in (mean, peak))
        return np.concatenate(rows), {"motif": A.strings(names, np.concatenate(index)), "mean": mean, "peak": peak}

    return A.by_row(seqs, 4 * len(names), made, "motif string, mean double, peak double")


def pdt(seqs: DataFrame, lags: int, props: dict[str, dict[str, float]], digits: int = 3) -> DataFrame:
    """The mean squared difference of each property at each distance (the published definition)."""

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        w = Windows(column, 1, props)
        parts = []
        for g in range(1, lags + 1):
            some, has = w.ahead(g), np.flatnonzero(w.size > g)
            parts += [(f"{g}|{p}", has, A.half_up(w.sums((x[some] - x[some + g]) ** 2, some)[has] / (w.size[has] - g), digits)) for p, x in zip(props, w.x)]
        return _features(parts)

    return A.by_row(seqs, 4 * len(props) * lags, made, "feature string, value double")


def pdt_profile(seqs: DataFrame, n: int, lags: int, props: dict[str, dict[str, float]], digits: int = 3, profile: DataFrame | None = None) -> DataFrame:
    """pdt() of the sequences of residues' n most frequent amino acids, by a profile or, without one, by BLOSUM62."""
    from .words import top_n_gram

    return pdt(top_n_gram(seqs, n, profile), lags, props, digits)
