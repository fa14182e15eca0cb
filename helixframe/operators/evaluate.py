"""Folds, sampling, grids and metrics."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lineage import stash
from .scale import bounded, ranked, running


def folds(rows: DataFrame, k: int, id_col: str = "id", label_col: str | None = "y") -> DataFrame:
    """rows with a fold from 0 to k - 1, even within each class when a label is given. The order is that of the id's MD5. k of 0
    leaves one row out at a time: each row is a fold of its own. No class is sorted in one task."""
    rows = rows.withColumn("_md5", F.md5(F.col(id_col).cast("string")))
    at = ranked(rows, [label_col] if label_col and k else [], ["_md5", id_col], "_place")
    return at.withColumn("fold", (F.col("_place") % k if k else F.col("_place")).cast("int")).drop("_md5", "_place")


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of parameters, numbered in the order of their lists. Axes are short lists."""
    points = [(i, *map(str, p)) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(points, "idx long, " + ", ".join(f"{a} string" for a in axes))


def number_range(spec: list) -> list:
    """[a], [a, b] or [a, b, step], ends included; decimal steps don't drift."""
    from decimal import Decimal

    a, b, step = (Decimal(str(x)) for x in [spec[0], spec[-1] if len(spec) > 1 else spec[0], spec[2] if len(spec) > 2 else 1])
    if len(spec) > 1:
        b = Decimal(str(spec[1]))
    return [float(a + i * step) if "." in str(step) + str(a) else int(a + i * step) for i in range(int((b - a) / step) + 1)]


def top_auc(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """by, rows and AUC of the n best runs (groups of `by`) that have both classes, the first on a tie."""
    both = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").select(by, "n")
    return binary_metrics(rows, by).join(both, by).orderBy(F.desc("AUC"), by).limit(n).select(by, "n", F.col("AUC").alias("auc"))


def pick(results: DataFrame, metric: str) -> DataFrame:
    """The row of the best metric, the first on a tie."""
    return results.orderBy(F.desc(metric), "idx").limit(1)


def binary_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """rows: y and p (1 positive, anything else negative), score. Acc, MCC, AUC, BAcc, Sn, Sp, Pr, Rc and F1, one row per group; a
    division by 0 gives 0. AUC is the Mann-Whitney statistic by average ranks, from counts per score, so a class or score that
    has most rows is summed up before it is shuffled."""
    pos, said = F.col("y") == 1, F.col("p") == 1
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    per = rows.groupBy(*by, "score").agg(count(pos & said).alias("tp"), count(~pos & said).alias("fp"), count(pos & ~said).alias("fn"), count(~pos & ~said).alias("tn"))
    per = running(per.withColumn("neg", F.col("fp") + F.col("tn")), [F.asc("score")], {"upto": "neg"}, by).withColumn("below", F.col("upto") - F.col("neg") / 2)
    t = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.sum((F.col("tp") + F.col("fn")) * F.col("below")).alias("u"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sn, sp, pr = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return t.select(
        *by,
        F.round(ratio(tp + tn, tp + fp + fn + tn), 4).alias("Acc"),
        F.round(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), 4).alias("MCC"),
        F.round(ratio(F.col("u"), (tp + fn) * (tn + fp)), 4).alias("AUC"),
        F.round((sn + sp) / 2, 4).alias("BAcc"),
        F.round(sn, 4).alias("Sn"),
        F.round(sp, 4).alias("Sp"),
        F.round(pr, 4).alias("Pr"),
        F.round(sn, 4).alias("Rc"),
        F.round(ratio(2 * pr * sn, pr + sn), 4).alias("F1"),
    )


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 4).alias("Acc"))


def curve_points(rows: DataFrame) -> DataFrame:
    """score, tpr, fpr, precision at every threshold, from counts per score."""
    per = rows.groupBy("score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    total = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    up = running(per, [F.desc("score")], {"tp": "pos", "fp": "neg"}).join(F.broadcast(total))  # one row
    return up.select("score", F.round(F.col("tp") / F.col("P"), 6).alias("tpr"), F.round(F.col("fp") / F.col("N"), 6).alias("fpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


def fold_curves(rows: DataFrame) -> DataFrame:
    """fold, score, tpr, fpr at every threshold of each fold."""
    per = rows.groupBy("fold", "score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    total = per.groupBy("fold").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # a row per fold
    up = running(per, [F.desc("score")], {"tp": "pos", "fp": "neg"}, ("fold",)).join(F.broadcast(total), "fold")
    return up.select("fold", "score", F.round(F.col("tp") / F.col("P"), 6).alias("tpr"), F.round(F.col("fp") / F.col("N"), 6).alias("fpr"))


def mean_roc(points: DataFrame, grid_points: int = 100) -> DataFrame:
    """fpr, tpr: per-fold curves (fold, fpr, tpr) as steps on an even grid, averaged over folds."""
    at = F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("g")
    rows = points.select("fold", "tpr", F.ceil(F.col("fpr") * (grid_points - 1)).alias("from"))
    best = rows.groupBy("fold", "from").agg(F.max("tpr").alias("tpr"))
    every = points.select("fold").distinct().select("fold", at)
    got = every.join(best, (every["fold"] == best["fold"]) & (best["from"] <= every["g"]), "left").groupBy(every["fold"], "g").agg(F.coalesce(F.max("tpr"), F.lit(0.0)).alias("tpr"))
    return got.groupBy("g").agg(F.round(F.avg("tpr"), 6).alias("tpr")).select(F.round(F.col("g") / (grid_points - 1), 6).alias("fpr"), "tpr")


#: Rows of a block; nearest() compares all rows block by block, so that no task holds more than two blocks.
BLOCK = 2048


def nearest(rows: DataFrame, k: int = 1, within: str | None = None) -> DataFrame:
    """id, other, d: the k nearest other rows of each row by Euclidean distance (rounded to nine decimals; the lower id on a tie),
    exactly, among all rows or those with the same value of `within`. rows: id (unique numbers), x (arrays of one length). Every
    block of rows meets every block, so the work is quadratic; only k rows of each row leave a task."""
    import numpy as np
    import pandas as pd

    kind = [] if within is None else ["_w"]
    rows = rows.select("id", "x", *([F.col(within).alias("_w")] if kind else []))
    sizes = stash(rows.groupBy(*kind).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b")), "class_sizes") if kind else None
    dealt = rows.join(bounded(sizes), "_w") if kind else rows.withColumn("_b", F.lit(max(1, -(-rows.count() // BLOCK))))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    left = dealt.select(*kind, "id", "x", F.col("own").alias("i"), F.col("to").alias("j"))
    right = dealt.select(*[F.col(c).alias("_v") for c in kind], F.col("id").alias("other"), F.col("x").alias("z"), F.col("own").alias("j"), F.col("to").alias("i"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("other")
            ids, z = b["other"].to_numpy(), np.stack(b["z"].to_numpy()).T.copy()
            for lo in range(0, len(a), 256):
                part = a.iloc[lo : lo + 256]
                x, mine = np.stack(part["x"].to_numpy()), part["id"].to_numpy()
                d = np.zeros((len(x), len(ids)))
                for c in range(len(z)):  # one coordinate after the other, as a sum over the array would
                    d += (x[:, c, None] - z[c]) ** 2
                d = np.round(np.sqrt(d), 9)
                d[mine[:, None] == ids] = np.inf
                at = np.argsort(d, 1, kind="stable")[:, :k]
                found = np.take_along_axis(d, at, 1)
                ok = np.isfinite(found)
                out.append(pd.DataFrame({"id": np.repeat(mine, ok.sum(1)), "other": ids[at][ok], "d": found[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "d": []})

    number = rows.schema["id"].dataType.simpleString()
    some = left.groupBy(*kind, "i", "j").cogroup(right.groupBy(*["_v" for _ in kind], "i", "j")).applyInPandas(best, f"id {number}, other {number}, d double")
    some = some.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("n"))  # k rows of each block
    return some.select("id", F.explode("n").alias("n")).select("id", "n.other", "n.d")


def tomek_links(rows: DataFrame) -> DataFrame:
    """a, b (a < b): rows of different classes that are each other's nearest. rows: id, x, y."""
    near = stash(nearest(rows, 1).select(F.col("id").alias("a"), F.col("other").alias("b")), "nearest")
    mutual = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
    y = rows.select("id", "y")
    both = mutual.join(y.select(F.col("id").alias("a"), F.col("y").alias("ya")), "a").join(y.select(F.col("id").alias("b"), F.col("y").alias("yb")), "b")
    return both.where("ya <> yb").select("a", "b")


def _sizes(rows: DataFrame) -> DataFrame:
    """y, n and most, the size of the largest class."""
    sizes = stash(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "class_sizes")
    return sizes.join(F.broadcast(sizes.agg(F.max("n").alias("most"))))  # one row


def smote(rows: DataFrame, k: int = 5) -> DataFrame:
    """id (row~neighbour~number), y, x: made-up rows that bring every class up to the size of the largest. Rows of a class take turns
    in the order of their ids' MD5, each with its nearest neighbour of the class first, then the next up to the k-th; the new row
    lies between the two, where the MD5 of its id says. rows: id (unique numbers), x, y. A class of one row has no neighbours
    and stays as it is; an empty table gives no rows."""
    order = ranked(rows.select("id", "y", F.md5(F.col("id").cast("string")).alias("_md5")), ["y"], ["_md5", "id"], "r")
    wanted = order.join(bounded(stash(_sizes(rows), "classes")), "y").withColumn("missing", F.col("most") - F.col("n")).where("r < missing and n > 1")
    turns = wanted.withColumn("t", F.explode(F.sequence("r", F.col("missing") - 1, F.col("n"))))
    turns = turns.select("id", "y", "t", (F.floor(F.col("t") / F.col("n")) % F.least(F.lit(k), F.col("n") - 1) + 1).cast("int").alias("slot"))
    near = nearest(rows, k, "y").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "other"))), lambda v: v["other"]).alias("near"))
    pair = turns.join(near, "id").withColumn("other", F.element_at("near", F.col("slot")))
    pair = pair.join(rows.select("id", "x"), "id").join(rows.select(F.col("id").alias("other"), F.col("x").alias("z")), "other")
    name = F.concat_ws("~", "id", "other", "t")
    part = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 2.0**32
    pair = pair.select(name.alias("id"), "y", "x", "z", part.alias("part"))
    return pair.select("id", "y", F.zip_with("x", "z", lambda a, b: a + (b - a) * F.col("part")).alias("x"))


def balanced(rows: DataFrame, how: str, k: int = 5) -> DataFrame:
    """id (text), x, y of training rows after sampling: 'over' adds smote()'s rows, 'under' takes away the rows of the larger classes
    that are in a Tomek link, 'combine' adds rows and then takes away both ends of every link. rows: id (unique numbers), x, y."""
    if how not in ("over", "under", "combine"):
        raise ValueError("sampling is 'over', 'under' or 'combine'")
    plain = rows.select("id", "x", "y")
    if how == "under":
        links = tomek_links(plain)
        smallest = _sizes(plain).orderBy("n", "y").limit(1).select("y")
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(plain.select("id", "y"), "id").join(F.broadcast(smallest), "y", "left_anti")
        return plain.join(ends.select("id"), "id", "left_anti").select(F.col("id").cast("string").alias("id"), "x", "y")
    more = plain.select(F.col("id").cast("string").alias("id"), "x", "y").unionByName(smote(plain, k).select("id", "x", "y"))
    if how == "over":
        return more
    numbered = stash(more.withColumn("n", F.monotonically_increasing_id()), "sampled")
    links = tomek_links(numbered.select(F.col("n").alias("id"), "x", "y"))
    return numbered.join(links.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "n", "left_anti").select("id", "x", "y")
