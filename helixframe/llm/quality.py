"""A quality classifier by co-training.

Two logistic regressions see a document from two sides: one its text (byte-pair frequencies and a few counts), one its
metadata (language, source, stated length). Over some rounds each gives the documents that it is most sure of, out of all that
have no label, to the other as further training rows, with its calibrated probability as their label: so a view that knows
little teaches little. Both are calibrated on labelled rows that neither has trained on, and their calibrated odds are combined
into one score for every document."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, give_back, slices, small_batches, stash, text_bytes, token_hashes

#: The fit is made on at most so many labelled documents, those with the lowest hashes of their ids. The documents without label
#: that the views teach each other with are the surest of all there are, so many a round from each view.
LABELLED, EXCHANGED = 6000, 400
PAIRS = 256
_pair_bucket = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int32)
_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "mark", "other"]


def _class_of(i: int) -> int:
    c = chr(i)
    if i >= 128:
        return 7
    return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:'\"-?()" else 6


_byte_class = np.array([_class_of(i) for i in range(256)], np.int32)
TEXT_DIM = PAIRS + len(_CLASSES) + 4
META_LANG, META_SOURCE = 32, 64
META_DIM = META_LANG + META_SOURCE + 3


def text_features(column: pa.Array) -> np.ndarray:
    """A row per text: square roots of byte-pair frequencies by hash, shares of byte classes, the share of words equal to the
    word before, the share of different words, the mean word length and whether there are words. All 0 for an empty text."""
    data, at = text_bytes(column)
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    pair = np.full(len(data), PAIRS, np.int64)
    if len(data) > 1:
        pair[:-1] = _pair_bucket[data[:-1].astype(np.int32) << 8 | data[1:]]
    ends = at[1:][size > 0] - 1
    pair[ends] = PAIRS  # the last byte of a text has no partner
    pairs = np.bincount(row * (PAIRS + 1) + pair, minlength=n * (PAIRS + 1)).reshape(n, PAIRS + 1)[:, :PAIRS]
    kinds = np.bincount(row * 8 + _byte_class[data], minlength=n * 8).reshape(n, 8)
    per = np.maximum(size, 1)[:, None]
    h, w_at = token_hashes(column)
    words = np.diff(w_at)
    w_row = np.repeat(np.arange(n), words)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w_row[1:] == w_row[:-1])
    order = np.lexsort((h, w_row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w_row[order][1:] != w_row[order][:-1])
    many = np.maximum(words, 1)
    letters = np.bincount(row, WORD_BYTES[data], n)
    more = np.stack([np.bincount(w_row, again, n) / many, np.bincount(w_row[order], new, n) / many, np.minimum(letters / many, 40) / 10, words > 0], 1)
    return np.concatenate([np.sqrt(pairs / per) * 4, kinds / per * 4, more * 2], 1) * (size > 0)[:, None]


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """A row per document: language and source by hash, the logarithm of the stated length, and whether it is there."""
    out = np.zeros((len(lang), META_DIM))
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(f"l{a}".encode()) % META_LANG] = 1
        out[i, META_LANG + zlib.crc32(f"s{b}".encode()) % META_SOURCE] = 1
        if c is not None and c >= 0:
            x = np.log1p(c) / 10
            out[i, -3:] = x, x * x, 1
    return out


@dataclass
class View:
    """A logistic regression and the straight line that calibrates its log odds."""

    w: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and intercept (last) by Newton's method; the intercept isn't held down."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ w)
        s = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = fit_logistic(view.raw(x)[:, None], target, np.ones(len(y)), 1e-3)
    view.slope, view.shift = max(float(w[0]), 0.0), float(w[1])


@dataclass
class CoTrained:
    text: View | None = None
    meta: View | None = None
    prior: float = 0.0
    report: dict = field(default_factory=dict)

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the combined views, the text and the metadata. Given the class the views are taken as independent:
        log odds add up, less the prior's, which both have."""
        if self.text is None:
            p = np.full(len(xt), _sigmoid(np.array(self.prior)))
            return p, p, p
        a, b = self.text.odds(xt), self.meta.odds(xm)
        return _sigmoid(a + b - self.prior), _sigmoid(a), _sigmoid(b)


#: What a round asks for: (name of the view that is sure, class, how many rows).
Wish = tuple[str, int, int]
#: Picks the surest rows without label for each wish, by the views as they are: text rows and metadata rows. A view gives a row once.
Pick = Callable[[dict[str, "View"], list[Wish]], list[tuple[np.ndarray, np.ndarray]]]


def pool(ut: np.ndarray, um: np.ndarray) -> Pick:
    """Picks from rows in memory."""
    given = {"text": np.zeros(len(ut), bool), "meta": np.zeros(len(ut), bool)}
    views = {"text": ut, "meta": um}

    def pick(fitted: dict[str, View], wishes: list[Wish]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for name, label, n in wishes:
            odds = fitted[name].raw(views[name]) * (1 if label else -1)
            free = np.flatnonzero(~given[name])
            best = free[np.argsort(-odds[free], kind="stable")][:n]
            given[name][best] = True
            out.append((ut[best], um[best]))
        return out

    return pick


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, pick: Pick, rounds: int = 3, exchanged: int = EXCHANGED) -> CoTrained:
    """xt, xm, y: the labelled rows' two views and labels; held: 0 for the rows to fit on, 1 for calibration, 2 for the report.

    In each round a view hands `exchanged` of the rows without label to the other: those that it is surest of, by its own order,
    of either class and in the classes' proportion. They count half as much as a given label, with the calibrated probability
    as their label."""
    base = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = CoTrained(prior=float(np.log(base / (1 - base))))
    fit, hold, test = held == 0, held == 1, held == 2
    if len(set(y[fit])) < 2 or len(set(y[hold])) < 2:
        return model
    views = {"text": (xt, 1.0), "meta": (xm, 5.0)}
    got: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"text": [], "meta": []}  # rows and their labels that a view received
    fitted: dict[str, View] = {}
    alone = None
    for r in range(rounds + 1):
        for name, (x, ridge) in views.items():
            rows = np.concatenate([x[fit], *[g[0] for g in got[name]]])
            labels = np.concatenate([y[fit], *[g[1] for g in got[name]]])
            weight = np.concatenate([np.ones(fit.sum()), np.full(len(labels) - fit.sum(), 0.5)])
            view = View(fit_logistic(rows, labels, weight, ridge))
            _calibrate(view, x[hold], y[hold])
            fitted[name] = view
        alone = alone or fitted["text"]
        if r == rounds:
            break
        wishes = [(name, label, max(1, round(exchanged * part))) for name in ("text", "meta") for label, part in ((1, base), (0, 1 - base))]
        for (name, _, _), (ut, um) in zip(wishes, pick(fitted, wishes)):
            mine, theirs, other = (ut, um, "meta") if name == "text" else (um, ut, "text")
            if len(mine):
                got[other].append((theirs, _sigmoid(fitted[name].odds(mine))))
    model.text, model.meta = fitted["text"], fitted["meta"]
    some = test if len(set(y[test])) == 2 else hold
    p = [*model.scores(xt[some], xm[some]), _sigmoid(alone.odds(xt[some]))]
    good = y[some] > 0
    model.report = {"fitted": int(fit.sum()), "calibrated": int(hold.sum()), "unseen": int(test.sum()), "from_meta": sum(len(g[1]) for g in got["text"]), "from_text": sum(len(g[1]) for g in got["meta"])}
    model.report |= {k: float(((v >= 0.5) == good).mean()) for k, v in zip(("accuracy", "accuracy_text", "accuracy_meta", "accuracy_text_alone"), p)}
    loss = lambda v: float(-np.log(np.clip(np.where(good, v, 1 - v), 1e-9, 1)).mean())
    model.report |= {k: loss(v) for k, v in zip(("loss", "loss_text", "loss_meta", "loss_text_alone"), p)}
    model.report["clean_lost"] = float(((p[0] < 0.5) & good).sum() / max(1, good.sum()))
    return model


def _views(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = set(docs.columns)
    meta = [(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *meta)


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two views of a batch, in half precision wherever they are used, so that a model scores what it was fitted on."""
    xt, xm = text_features(b.column("text")), meta_features(*[b.column(c).to_pylist() for c in ("lang", "source", "n_chars")])
    return xt.astype(np.float16).astype(np.float64), xm.astype(np.float16).astype(np.float64)


def _unpack(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    f = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, TEXT_DIM + META_DIM).astype(np.float64)
    return f[:, :TEXT_DIM], f[:, TEXT_DIM:]


def _lowest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of the lowest `by`, a hash: what is far above is left out first, so that no partition sends many."""
    total = df.count()
    cut = int(-(2**63) + 2**64 * min(1.0, (2 * n + 100) / max(total, 1)))
    return df.where(F.col(by) <= F.lit(min(cut, 2**63 - 1))).orderBy(by).limit(n)


#: Odds are counted in steps of 1 / STEPS to find how sure the surest rows are.
STEPS = 64


def _distributed(features: DataFrame) -> Pick:
    """Picks from a table (row, f) of any size. All rows' odds are written as numbers of bins and the bins counted, which says how
    sure a row must be; only rows above that, and some of the last bin by a hash, come to the driver."""
    given: dict[str, set[int]] = {"text": set(), "meta": set()}  # rounds * EXCHANGED rows at most

    def pick(fitted: dict[str, View], wishes: list[Wish]) -> list[tuple[np.ndarray, np.ndarray]]:
        views = [fitted["text"], fitted["meta"]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    part = b.slice(lo, 1000)
                    bins = [np.clip(np.floor(v.raw(x) * STEPS), -100 * STEPS, 100 * STEPS).astype(np.int32) for v, x in zip(views, _unpack(part.column("f")))]
                    yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, bins)], names=["row", "text", "meta"])
            give_back()

        odds = stash(features.select("row", "f").mapInArrow(run, "row long, text int, meta int"), "odds")
        free = {name: ~F.col("row").isin(list(rows)) if rows else F.lit(True) for name, rows in given.items()}
        both = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.when(free[name], F.col(name)).alias("bin")) for name in given])).alias("b")
        counts: dict[str, dict[int, int]] = {name: {} for name in given}
        for r in odds.select(both).where("b.bin is not null").groupBy("b.name", "b.bin").count().collect():  # 400 * STEPS bins at most
            counts[r["name"]][r["bin"]] = r["count"]
        edges = []  # the last bin that a wish reaches, and how many rows it takes from there
        for name, label, n in wishes:
            edge, few = None, n
            for k in sorted(counts[name], reverse=bool(label)):
                edge = k
                if few <= counts[name][k]:
                    break
                few -= counts[name][k]
            edges.append((edge, few))
        tie = F.xxhash64("row", F.lit("tie"))
        taken = []
        for i, ((name, label, _), (edge, few)) in enumerate(zip(wishes, edges)):
            if edge is not None:
                share = min(1.0, (2 * few + 100) / counts[name][edge])  # of the last bin, those of the lowest hashes
                last = (F.col(name) == edge) & (tie <= F.lit(min(int(-(2**63) + 2**64 * share), 2**63 - 1)))
                beyond = F.col(name) > edge if label else F.col(name) < edge
                taken.append(F.when(free[name] & (beyond | last), F.struct(F.lit(i).alias("i"), "row", last.alias("last"), tie.alias("tie"))))
        some = odds.select(F.explode(F.array_compact(F.array(*taken))).alias("t")).select("t.*").collect() if taken else []
        chosen: list[list[int]] = [[] for _ in wishes]
        for i, (name, _, n) in enumerate(wishes):
            for r in sorted((r for r in some if r.i == i), key=lambda r: (r["last"], r.tie)):
                if len(chosen[i]) < n and r.row not in given[name]:
                    given[name].add(r.row)
                    chosen[i].append(r.row)
        wanted = sorted({row for rows in chosen for row in rows})
        if not wanted:
            return [(np.zeros((0, TEXT_DIM)), np.zeros((0, META_DIM))) for _ in wishes]
        found = features.where(F.col("row").isin(wanted)).select("row", "f").toArrow().sort_by("row")
        xt, xm = _unpack(found.column("f"))
        at = [np.searchsorted(found.column("row").to_numpy(), rows) for rows in chosen]
        return [(xt[k], xm[k]) for k in at]

    return pick


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> CoTrained:
    """Fit on a bounded sample of the labelled documents (LABELLED, chosen by hash), and in rounds on the surest of all others.
    Several labels of an id count by their mean, a mean of one half and null labels not at all; labels are 0 or 1. Of the sample
    three fifths are fitted on, a fifth calibrates and a fifth is for the report alone.

    The documents' features are written once (some 700 bytes each); the rounds read these and no text."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).where("y <> 0.5")
    known = known.select("id", (F.col("y") > 0.5).cast("int").alias("y"))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    known = stash(known.join(ids, "id", "left_semi").withColumn("h", F.xxhash64("id", F.lit("sample"))), "labelled")
    some = _lowest(known, "h", LABELLED).select("id", "y").toArrow()
    if not some.num_rows:
        return CoTrained()
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame(some, f"id {kind}, y int")  # from Arrow: a list would start Python workers of another kind, which stay
    rows = _views(docs, id_col, text_col).join(F.broadcast(chosen), "id", "left")  # LABELLED ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            f = np.concatenate(_features(b), 1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([x.tobytes() for x in f], pa.binary())], names=["id", "y", "f"])

    features = stash(rows.mapInArrow(run, f"id {kind}, y int, f binary").withColumn("row", F.monotonically_increasing_id()), "features")
    got = features.where("y is not null").select("id", "y", "f").toArrow().sort_by("id")  # LABELLED documents, or more if their rows repeat
    xt, xm = _unpack(got.column("f"))
    part = np.array([zlib.crc32(f"held:{i}".encode()) % 5 for i in got.column("id").to_pylist()])
    return co_train(xt, xm, got.column("y").to_numpy().astype(float), np.where(part < 3, 0, part - 2), _distributed(features.where("y is null")), **options)


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: id_col, score, text_score, meta_score (probabilities, six decimals) and kept (score of at least
    threshold) - or, with keep_columns, the kept rows of docs as they are.

    A null or empty text has nothing to learn from: its score is 0 and it isn't kept. Missing metadata columns count as null.
    Without labels of both classes every score is the share of good labels (one half without any) and everything with a text
    is kept. Texts are read whole; repeated rows are scored each for itself; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    limit = threshold if model.text is not None else -1.0
    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.schema
    views = _views(docs, id_col, text_col)

    def judge(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        p = [np.round(v, 6) for v in model.scores(*_features(b))]
        empty = np.diff(text_bytes(b.column("text"))[1]) == 0
        p[0] = np.where(empty, 0.0, p[0])
        return (*p, (p[0] >= limit) & ~empty)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(x) for x in judge(b)]], names=["id", "score", "text_score", "meta_score", "kept"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            names = {"lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
            view = {"text": b.column(text_col)} | {c: b.column(c).cast(t) if c in b.schema.names else pa.nulls(b.num_rows, t) for c, t in names.items()}
            yield b.filter(pa.array(judge(pa.RecordBatch.from_pydict(view))[3]))

    if keep_columns:
        return docs.mapInArrow(whole, schema)
    out = views.mapInArrow(rows, f"id {kind}, score double, text_score double, meta_score double, kept boolean")
    return out.withColumnRenamed("id", id_col)
