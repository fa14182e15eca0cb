"""Learners: forests and networks by MLlib, RBF machines by random Fourier features, and a linear-chain CRF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import stash


def _rows(wide: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return wide.select("id", "fold", F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("label"), array_to_vector("x").alias("features"))


def _platt(fitted, rows: DataFrame):
    """Slope and shift that make probabilities of a machine's margins (label, features): a logistic regression on them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer

    margins = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1]).transform(fitted.transform(rows)).select("label", "margin")
    line = LogisticRegression(featuresCol="margin", regParam=1e-3, maxIter=50).fit(margins)
    return float(line.coefficients[0]), float(line.intercept)


def _scored(fitted, rows: DataFrame, line: tuple[float, float] | None):
    """rows with prediction and score, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    got = fitted.transform(rows)
    if line is None:
        return got.withColumn("score", vector_to_array("probability")[1])
    return got.withColumn("score", 1 / (1 + F.exp(-(vector_to_array("rawPrediction")[1] * line[0] + line[1]))))


def cross_validate(wide: DataFrame, make, k: int) -> DataFrame:
    """id, fold, y (0 or 1), p, score (a probability) of each fold by a model of the others. wide: id, x, y, fold. make() gives an
    MLlib estimator; machines without probabilities get Platt's line over the margins of their training rows."""
    rows = stash(_rows(wide), "folded")
    out = None
    for i in range(k):
        train = rows.where(F.col("fold") != i)
        model = make().fit(train)
        line = None if hasattr(model, "probabilityCol") else _platt(model, train)
        got = _scored(model, rows.where(F.col("fold") == i), line)
        part = got.select("id", "fold", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def save_model(wide: DataFrame, estimator, path: str) -> None:
    """Fit an MLlib estimator on all rows (id, x, y) and write the model below path, with Platt's line where it needs one."""
    from pyspark.ml import Pipeline

    rows = _rows(wide.withColumn("fold", F.lit(0)))
    model = Pipeline(stages=[estimator]).fit(rows)
    model.write().overwrite().save(f"{path}/model")
    line = (None, None) if hasattr(model.stages[0], "probabilityCol") else _platt(model.stages[0], rows)
    wide.sparkSession.createDataFrame([line], "slope double, shift double").write.mode("overwrite").parquet(f"{path}/platt")


def predict(wide: DataFrame, path: str) -> DataFrame:
    """id, p, score of rows (id, x) by a model that save_model() wrote."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector

    spark = wide.sparkSession
    model = PipelineModel.load(f"{path}/model")
    line = spark.read.parquet(f"{path}/platt").first()  # one row
    rows = wide.select("id", array_to_vector("x").alias("features"))
    got = _scored(model.stages[0], rows, None if line["slope"] is None else (line["slope"], line["shift"]))
    return got.select("id", F.col("prediction").cast("int").alias("p"), "score")


def score_vectors(scores: DataFrame) -> DataFrame:
    """id, x: the rows of a score matrix (i, j, score) as features, in the order of j."""
    return scores.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "score"))), lambda r: r["score"]).alias("x"))


def forest(trees: int = 100, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, seed=seed)


def network(width: int, hidden: int = 16, seed: int = 42):
    """A small perceptron of MLlib; convolutions, recurrent nets and encoders are in net.py."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=[width, hidden, 2], seed=seed, maxIter=50)


def linear_machine(cost: float = 1.0):
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(regParam=1.0 / (100 * cost), maxIter=30)


def fourier_features(wide: DataFrame, gamma: float, dim: int = 64, seed: int = 42) -> DataFrame:
    """x replaced by random Fourier features of the RBF kernel exp(-gamma |a - b|^2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = None
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_numpy())
            if w is None:
                rng = np.random.default_rng(seed)
                w, shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], dim)), rng.uniform(0, 2 * np.pi, dim)
            b["x"] = list(np.sqrt(2.0 / dim) * np.cos(x @ w + shift))
            yield b

    return wide.mapInPandas(run, wide.schema)


class Crf:
    """A linear-chain CRF: linear emissions, transitions with start and stop, trained by gradient steps on the exact likelihood."""

    def __init__(self, width: int, states: int = 2, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.01, (width, states))
        self.t = np.zeros((states, states))
        self.start, self.stop = np.zeros(states), np.zeros(states)

    @staticmethod
    def _lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of states, of transitions, and the log of the partition sum."""
        e = x @ self.w
        n, s = e.shape
        fwd, bwd = np.zeros((n, s)), np.zeros((n, s))
        fwd[0] = self.start + e[0]
        for i in range(1, n):
            fwd[i] = self._lse(fwd[i - 1][:, None] + self.t, 0) + e[i]
        bwd[-1] = self.stop
        for i in range(n - 2, -1, -1):
            bwd[i] = self._lse(self.t + (e[i + 1] + bwd[i + 1])[None, :], 1)
        z = float(self._lse(fwd[-1] + self.stop, 0))
        pairs = np.exp(fwd[:-1, :, None] + self.t[None] + (e[1:] + bwd[1:])[:, None, :] - z)
        return np.exp(fwd + bwd - z), pairs, z

    def log_likelihood(self, x: np.ndarray, y: np.ndarray) -> float:
        e = x @ self.w
        score = self.start[y[0]] + e[np.arange(len(y)), y].sum() + self.t[y[:-1], y[1:]].sum() + self.stop[y[-1]]
        return float(score - self.marginals(x)[2])

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, rate: float = 0.05, decay: float = 1e-4) -> Crf:
        for _ in range(epochs):
            for x, y in data:
                p, pairs, _ = self.marginals(x)
                seen = np.eye(len(self.start))[y]
                self.w += rate * (x.T @ (seen - p) / len(y) - decay * self.w)
                both = np.zeros_like(self.t)
                np.add.at(both, (y[:-1], y[1:]), 1.0)
                self.t += rate * ((both - pairs.sum(0)) / len(y) - decay * self.t)
                self.start += rate * (seen[0] - p[0])
                self.stop += rate * (seen[-1] - p[-1])
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best states (Viterbi)."""
        e = x @ self.w
        best, back = self.start + e[0], []
        for i in range(1, len(e)):
            step = best[:, None] + self.t
            back.append(step.argmax(0))
            best = step.max(0) + e[i]
        path = [int((best + self.stop).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def crf_cross_validate(rows: DataFrame, k: int, width: int, sample: int = 200, epochs: int = 5) -> DataFrame:
    """id, y, p (arrays): labels of each fold's sequences by a CRF of at most `sample` sequences of the other folds, those with the
    lowest hashes. rows: id, fold, x (array of rows), y (array of 0 and 1). Decoding runs where the rows are."""
    from .net import _sampled

    models = {}
    for i in range(k):
        data = [(np.array(r["x"], float), np.array(r["y"])) for r in _sampled(rows, i, sample) if len(r["y"])]  # bounded: `sample` sequences for each fold
        models[i] = Crf(width).fit(data, epochs) if data else Crf(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [models[f].decode(np.stack(x)).tolist() if len(x) else [] for f, x in zip(b["fold"], b["x"])]
            yield pd.DataFrame({"id": b["id"], "fold": b["fold"], "y": b["y"], "p": p})

    return rows.select("id", "fold", "x", "y").mapInPandas(run, "id long, fold int, y array<int>, p array<int>")


def topics(words: DataFrame, k: int, rounds: int = 5, seed: int = 0, vocabulary: int = 4096) -> DataFrame:
    """seq_id, topics by latent Dirichlet allocation."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    lists = words.groupBy("seq_id").agg(F.collect_list("word").alias("w"))
    counts = CountVectorizer(inputCol="w", outputCol="features", vocabSize=vocabulary).fit(lists).transform(lists)
    return LDA(k=k, maxIter=rounds, seed=seed).fit(counts).transform(counts).select("seq_id", vector_to_array("topicDistribution").alias("topics"))


def plsa(counts: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """seq_id, topic, p: probabilistic latent semantic analysis by EM on the sparse counts (seq_id, word, n), with a start that
    hashes decide. Topic-word shares are a vocabulary's size; everything else stays in tables of the counts' size."""
    topic = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("topic")
    drawn = lambda c: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(c).cast("string"), F.col("topic").cast("string"))), 1, 8), 16, 10).cast("long")
    start = lambda c: (F.pmod(drawn(c), F.lit(1000)) + 1) / 1000.0
    theta = counts.select("seq_id").distinct().select("seq_id", topic).withColumn("t", start("seq_id"))
    theta = theta.withColumn("t", F.col("t") / F.lit(float(k)))
    phi = counts.select("word").distinct().select("word", topic).withColumn("f", start("word"))
    phi = phi.join(phi.groupBy("topic").agg(F.sum("f").alias("s")), "topic").select("word", "topic", (F.col("f") / F.col("s")).alias("f"))
    counts, phi = stash(counts, "counts"), stash(phi, "phi")
    for _ in range(rounds):
        cell = counts.join(theta, "seq_id").join(phi, ["word", "topic"]).withColumn("w", F.col("t") * F.col("f"))
        total = cell.groupBy("seq_id", "word").agg(F.sum("w").alias("s"))
        cell = cell.join(total, ["seq_id", "word"]).withColumn("m", F.col("n") * F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1.0 / k))
        cell = stash(cell.select("seq_id", "word", "topic", "m"), "cells")
        theta = cell.groupBy("seq_id", "topic").agg(F.sum("m").alias("t"))
        theta = theta.join(theta.groupBy("seq_id").agg(F.sum("t").alias("s")), "seq_id").select("seq_id", "topic", (F.col("t") / F.col("s")).alias("t"))
        theta = stash(theta, "theta")
        phi = cell.groupBy("word", "topic").agg(F.sum("m").alias("f"))
        phi = phi.join(phi.groupBy("topic").agg(F.sum("f").alias("s")), "topic").select("word", "topic", (F.col("f") / F.col("s")).alias("f"))
        phi = stash(phi, "phi")
    return theta.select("seq_id", "topic", F.col("t").alias("p"))
