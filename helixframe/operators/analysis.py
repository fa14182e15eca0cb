"""Feature analysis: normalising, selecting, clustering and reducing.

Feature matrices are long (id, feature, value) unless said otherwise; `wide` tables have x, an array of doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import stash
from .scale import components, ranked


def to_long(wide: DataFrame) -> DataFrame:
    return wide.select("id", F.posexplode("x").alias("feature", "value"))


def transpose(long: DataFrame) -> DataFrame:
    """Features as samples."""
    return long.select(F.col("feature").alias("id"), F.col("id").alias("feature"), "value")


def _with_stats(long: DataFrame, **aggs) -> DataFrame:
    """Each feature's statistics beside its values: partial sums are shuffled, not the matrix; a row per feature comes back."""
    return long.join(long.groupBy("feature").agg(*[v.alias(k) for k, v in aggs.items()]), "feature")


def min_max(long: DataFrame) -> DataFrame:
    """(x - min) / (max - min); 0 for a constant feature."""
    rows = _with_stats(long, lo=F.min("value"), hi=F.max("value"))
    return rows.select("id", "feature", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))


def standard(long: DataFrame) -> DataFrame:
    """Mean 0 and population deviation 1; a constant feature becomes 0."""
    rows = _with_stats(long, mean=F.avg("value"), sd=F.stddev_pop("value"))
    return rows.select("id", "feature", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("value"))


def normalise_rows(wide: DataFrame, p: int) -> DataFrame:
    """Rows of length 1 by the sum of sizes (p = 1) or squares (p = 2); a row of zeros stays."""
    sizes = F.transform("x", lambda v: F.abs(v) if p == 1 else v * v)
    total = F.aggregate(sizes, F.lit(0.0), lambda s, v: s + v)
    norm = total if p == 1 else F.sqrt(total)
    return wide.withColumn("_n", norm).withColumn("x", F.transform("x", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(v))).drop("_n")


def fit_scaler(long: DataFrame, kind: str) -> DataFrame:
    """feature, shift, scale learned from training rows; apply_scaler() uses them on others."""
    if kind == "min-max":
        return long.groupBy("feature").agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("scale"))
    return long.groupBy("feature").agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("scale"))


def apply_scaler(long: DataFrame, scaler: DataFrame) -> DataFrame:
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return long.join(scaler, "feature").select("id", "feature", ((F.col("value") - F.col("shift")) / scale).alias("value"))


def chi2(long: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, score: the chi-square statistic of a feature's sums by class against those expected from the classes' shares.
    Values must not be negative. labels: id, y."""
    share = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    seen = long.join(labels, "id").groupBy("feature", "y").agg(F.sum("value").alias("seen"))
    total = seen.groupBy("feature").agg(F.sum("seen").alias("total"))
    every = total.join(F.broadcast(share))  # a row per class
    rows = every.join(seen, ["feature", "y"], "left")
    expected = F.col("share") * F.col("total")
    gap = F.coalesce("seen", F.lit(0.0)) - expected
    return rows.groupBy("feature").agg(F.sum(F.when(expected > 0, gap * gap / expected).otherwise(0.0)).alias("score"))


def f_value(long: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, score: one-way ANOVA. One shuffle of partial sums."""
    per = long.join(labels, "id").groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = per.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return rows.select("feature", F.when(within > 0, between / within).alias("score"))


def mutual_information(long: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """feature, score: mutual information of equal-width bins and class, in nats (an estimator of its own, not by neighbours)."""
    rows = _with_stats(long, lo=F.min("value"), hi=F.max("value"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins))
    cells = rows.withColumn("bin", place).join(labels, "id").groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("b"))
    by_class = cells.groupBy("feature", "y").agg(F.sum("n").alias("c"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    rows = cells.join(by_bin, ["feature", "bin"]).join(by_class, ["feature", "y"]).join(total, "feature")
    return rows.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))).alias("score"))


def select_best(scores: DataFrame, n: int) -> DataFrame:
    """The n features of highest score, ties by feature, with their rank from 1."""
    top = scores.orderBy(F.desc_nulls_last("score"), "feature").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature")))


def _vector(wide: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return wide.withColumn("features", array_to_vector("x"))


def k_means(wide: DataFrame, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    rows = _vector(wide)
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def gaussian_mixture(wide: DataFrame, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture

    rows = _vector(wide)
    return GaussianMixture(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def bisecting(wide: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Hierarchical clusters from the top down; agnes() goes from the bottom up."""
    from pyspark.ml.clustering import BisectingKMeans

    rows = _vector(wide)
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def agnes(wide: DataFrame, k: int, neighbours: int = 10) -> DataFrame:
    """id, cluster (the smallest id in it): Ward's agglomeration along the graph of each row's nearest neighbours. wide: id (unique
    longs), x.

    In each round all pairs of clusters merge that are each other's nearest along the graph: Ward's distance never falls by a
    merge, so these merges would come anyway, whatever stands in between. The k - 1 highest of all merges are undone. Parts of
    the graph that nothing joins stay clusters of their own; there may then be more than k. Rounds are joins on the edges."""
    from .evaluate import nearest

    near = nearest(wide.select("id", "x"), neighbours)
    edges = stash(near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "graph")
    nodes = stash(wide.select(F.col("id").alias("c"), F.lit(1).cast("double").alias("n"), "x"), "clusters")
    merges = None
    dim = F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q))
    while not edges.isEmpty():
        left, right = (nodes.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), F.col("x").alias(f"x{s}")) for s in "ab")
        square = F.aggregate(dim, F.lit(0.0), lambda s, v: s + v)
        far = edges.join(left, "a").join(right, "b").select("a", "b", F.sqrt(2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * square).alias("d"))
        far = stash(far, "ward")
        both = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        # on a tie the lower pair of ids, so that two clusters always agree on which of them merge first
        best = both.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m")).select("a", "m.*")
        pairs = stash(best.groupBy("lo", "hi", "d").agg(F.count(F.lit(1)).alias("times")).where("times = 2").select("lo", "hi", "d"), "merged")
        merges = pairs if merges is None else stash(merges.unionByName(pairs), "merges")
        to = pairs.select(F.col("hi").alias("c"), F.col("lo").alias("to"))
        named = nodes.join(to, "c", "left").select(F.coalesce("to", "c").alias("c"), "n", "x")
        members = named.groupBy("c").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("n", "x"))).alias("m"))  # two at most
        one, two = F.element_at("m", 1), F.element_at("m", 2)
        mean = F.when(F.size("m") == 1, one["x"]).otherwise(F.zip_with(F.transform(one["x"], lambda v: v * one["n"]), F.transform(two["x"], lambda v: v * two["n"]), lambda p, q: (p + q) / F.col("total")))
        nodes = stash(members.select("c", F.col("total").alias("n"), mean.alias("x")), "clusters")
        moved = edges.join(to.select(F.col("c").alias("a"), F.col("to").alias("ta")), "a", "left").join(to.select(F.col("c").alias("b"), F.col("to").alias("tb")), "b", "left")
        moved = moved.select(F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q")).where("p <> q")
        edges = stash(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "graph")
    ids = wide.select("id")
    if merges is None:
        return ids.withColumn("cluster", F.col("id"))
    parts = nodes.count()  # what nothing joins
    undone = max(0, k - parts)
    top = merges.orderBy(F.desc("d"), F.desc("lo"), F.desc("hi")).limit(undone)
    kept = merges.join(F.broadcast(top.select("lo", "hi")), ["lo", "hi"], "left_anti")  # k rows at most
    found = components(kept.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def affinity_propagation(wide: DataFrame, rounds: int = 200, damping: float = 0.5, settled: int = 15) -> DataFrame:
    """feature, exemplar: affinity propagation of the columns of wide (x), which are clustered by their values in all rows. The
    similarity is the negative squared distance, the preference its median. Tasks sum up the d x d products of columns; messages
    pass on that matrix alone, whatever the number of rows. (Rows as samples would need all pairs of rows.)"""
    import numpy as np

    m = _gram(wide)
    d = len(m)
    s = -(np.diag(m)[:, None] + np.diag(m)[None, :] - 2 * m)
    off = s[~np.eye(d, dtype=bool)]
    s[np.diag_indices(d)] = np.median(off) if len(off) else 0.0
    r, a, last, same = np.zeros((d, d)), np.zeros((d, d)), None, 0
    for _ in range(rounds):
        both = a + s
        first = both.argmax(1)
        top = both[np.arange(d), first].copy()
        both[np.arange(d), first] = -np.inf
        new = s - top[:, None]
        new[np.arange(d), first] = s[np.arange(d), first] - both.max(1)
        r = damping * r + (1 - damping) * new
        plus = np.maximum(r, 0)
        plus[np.diag_indices(d)] = np.diag(r)
        total = plus.sum(0)
        new = np.minimum(total[None, :] - plus, 0)
        new[np.diag_indices(d)] = total - np.diag(plus)
        a = damping * a + (1 - damping) * new
        chosen = np.flatnonzero(np.diag(a) + np.diag(r) > 0)
        same = same + 1 if last is not None and np.array_equal(chosen, last) else 0
        last = chosen
        if same >= settled and len(chosen):
            break
    to = chosen[s[:, chosen].argmax(1)] if len(chosen) else np.arange(d)
    to[chosen] = chosen
    return wide.sparkSession.createDataFrame([(i, int(e)) for i, e in enumerate(to)], "feature int, exemplar int")


#: Rows of a block in dbscan(); every block meets every block.
BLOCK = 2048


def dbscan(wide: DataFrame, eps: float = 0.5, least: int = 5, scale: bool = True) -> DataFrame:
    """id, n (rows within eps, itself included), core (n is at least `least`) and cluster, exactly: 0, 1, ... in the order of the
    clusters' lowest core ids, -1 for noise. A row that isn't core joins the first cluster that has a core row within eps. With
    scale, columns are brought to mean 0 and deviation 1 before. wide: id (unique longs), x.

    Blocks of rows meet blocks; counts are made where two blocks meet, and in a second pass only a forest of the core rows'
    links and each other row's lowest core neighbour in a cluster leave a task."""
    import numpy as np
    import pandas as pd

    rows = wide.select("id", "x")
    if scale:
        long = standard(to_long(rows))
        rows = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda v: v["value"]).alias("x"))
    rows = stash(rows, "points")
    blocks = max(1, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        dealt = df.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.withColumnRenamed("own", "i").withColumnRenamed("to", "j").groupBy("i", "j"), dealt.select(*[F.col(c).alias(f"{c}_") for c in df.columns], F.col("own").alias("q"), F.col("to").alias("p")).groupBy("p", "q")

    def near(a: pd.DataFrame, b: pd.DataFrame):
        """For parts of a, which rows of b are within eps."""
        z = np.stack(b["x_"].to_numpy())
        for lo in range(0, len(a), 256):
            x = np.stack(a["x"].to_numpy()[lo : lo + 256])
            d = np.zeros((len(x), len(z)))
            for c in range(z.shape[1]):
                d += (x[:, c, None] - z[None, :, c]) ** 2
            yield lo, d <= eps * eps

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": []})
        return pd.DataFrame({"id": a["id"], "n": np.concatenate([m.sum(1) for _, m in near(a, b)])})

    left, right = sides(rows)
    counts = left.cogroup(right).applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = stash(rows.join(counts, "id").withColumn("core", F.col("n") >= least), "points")

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The lowest core row of b that each row of a is linked with, and for core rows a forest of all such links."""
        b = b[b["core_"].to_numpy(bool)].sort_values("id_") if len(b) else b
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "to": []})
        ids, mine, core = b["id_"].to_numpy(), a["id"].to_numpy(), a["core"].to_numpy(bool)
        root = np.arange(len(ids))
        out = []

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for lo, m in near(a, b):
            for i in np.flatnonzero(m.any(1)):
                to = np.flatnonzero(m[i])
                if not core[lo + i]:  # every cluster that it touches, by some core row
                    out += [(mine[lo + i], ids[t]) for t in to]
                    continue
                roots = sorted({find(int(t)) for t in to})
                root[roots[1:]] = roots[0]
                out.append((mine[lo + i], ids[roots[0]]))
        out += [(ids[t], ids[find(t)]) for t in range(len(ids)) if find(t) != t]
        return pd.DataFrame(out, columns=["id", "to"])

    left, right = sides(rows.select("id", "x", "core"))
    links = stash(left.cogroup(right).applyInPandas(link, "id long, to long"), "links")
    tagged = links.join(rows.select("id", "core"), "id")
    found = components(tagged.where("core").select(F.col("id").alias("a"), F.col("to").alias("b")))
    core = rows.where("core").select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c"))
    core = stash(core, "cores")
    names = ranked(core.select("c").distinct(), [], ["c"], "cluster")
    core = stash(core.join(names, "c").select("id", "cluster"), "cores")
    edge = tagged.where("not core").select("id", "to").join(core.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return rows.select("id", "n", "core").join(core.unionByName(edge), "id", "left").select("id", "n", "core", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def pca(wide: DataFrame, k: int, whiten: bool = True) -> DataFrame:
    """id, z: k components, each of deviation 1 when whitened."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vector(wide)
    n = F.size("x")
    out = PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("z"))
    if not whiten:
        return out
    stats = out.agg(*[F.struct(F.avg(F.col("z")[i]).alias("m"), F.stddev_samp(F.col("z")[i]).alias("s")).alias(f"c{i}") for i in range(k)])
    z = F.array(*[(F.col("z")[i] - F.col(f"c{i}.m")) / F.col(f"c{i}.s") for i in range(k)])
    return out.join(F.broadcast(stats)).select("id", z.alias("z"))  # one row


def _gram(wide: DataFrame):
    """The d x d products of the columns of x, summed up by tasks."""
    import numpy as np
    import pandas as pd

    def gram(batches):
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "v": total.ravel()})

    cells = wide.select("x").mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # d x d, whatever the rows
    d = int(cells["i"].max()) + 1 if len(cells) else 0
    m = np.zeros((d, d))
    m[cells["i"], cells["j"]] = cells["v"]
    return m


def truncated_svd(wide: DataFrame, k: int) -> DataFrame:
    """id, z: rows times the first k right singular vectors, from the d x d Gram matrix that tasks sum up. Signs make each vector's
    largest entry positive."""
    import numpy as np

    _, vectors = np.linalg.eigh(_gram(wide))
    v = vectors[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    dot = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(a)) for a in v[:, i]]), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a) for i in range(k)]
    return wide.select("id", F.array(*dot).alias("z"))


def tree_importance(wide: DataFrame, labels: DataFrame, n: int, trees: int = 50, seed: int = 42) -> DataFrame:
    """feature, score, rank by a forest's importances."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _vector(wide).join(labels.select("id", F.col("y").cast("double").alias("label")), "id")
    found = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows).featureImportances.toArray()
    scores = wide.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "feature int, score double")
    return select_best(scores, n)


def recursive_elimination(wide: DataFrame, labels: DataFrame, keep: int, step: int = 8) -> DataFrame:
    """feature: what is left when a linear machine's weakest features go, `step` at a time."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = wide.join(labels.select("id", F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("label")), "id").select("x", "label").cache()
    left = list(range(len(rows.first()["x"])))
    while len(left) > keep:
        part = rows.select("label", array_to_vector(F.array(*[F.col("x")[i] for i in left])).alias("features"))
        w = LinearSVC(maxIter=10, regParam=0.01).fit(part).coefficients.toArray()
        gone = sorted(range(len(left)), key=lambda i: abs(w[i]))[: min(step, len(left) - keep)]
        left = [f for i, f in enumerate(left) if i not in set(gone)]
    rows.unpersist()
    return wide.sparkSession.createDataFrame([(i,) for i in left], "feature int")
