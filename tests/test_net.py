"""Gradients against differences, and nets that learn what they are shown."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import learn, net


@pytest.mark.parametrize("kind", [*net.ENCODERS, "autoencoder"])
@pytest.mark.parametrize("per_step", [False, True])
def test_gradients(kind, per_step):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 4, 5))
    x[0, 2:] = 0.0  # padding
    y = rng.integers(0, 2, (3, 4) if per_step else 3)
    if kind == "autoencoder" and per_step:
        pytest.skip("an autoencoder has no steps")
    one = net.AutoEncoder(2, 4) if kind == "autoencoder" else net.Net(kind, 2, 4, per_step)
    one.loss(x, y)
    for t in one.p.values():
        t.data = t.data + rng.normal(size=t.data.shape) * 0.3
    one.loss(x, y).backward()
    grads = {k: t.grad.copy() for k, t in one.p.items() if t.grad is not None}
    for k, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 4)]:
            t = one.p[k]
            was, sides = t.data[at], []
            for e in (1e-6, -1e-6):
                t.data = t.data.copy()
                t.data[at] = was + e
                sides.append(float(one.loss(x, y).data))
            t.data[at] = was
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=2e-5), (k, at)


@pytest.fixture(scope="module")
def task(spark):
    """Sequences whose label is whether a bump stands somewhere in them; each step's is whether it is in the bump."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x = rng.normal(size=(rng.integers(9, 13), 3)) * 0.3
        at = rng.integers(0, len(x) - 3)
        y = int(i % 2)
        if y:
            x[at : at + 3] += [1.5, -1.5, 1.0]
        rows.append((i, int(i % 7 % 3), x.tolist(), y, [int(bool(y) and at <= k < at + 3) for k in range(len(x))]))
    return spark.createDataFrame(rows, "id long, fold int, x array<array<double>>, y int, steps array<int>")


@pytest.mark.parametrize("kind", ["cnn", "gru", "cnn-bilstm", "transformer"])
def test_nets_learn(task, kind):
    got = net.cross_validate(task, 3, kind, 12, hidden=8, epochs=12).collect()
    assert len(got) == 240 and np.mean([r.p == r.y for r in got]) > 0.85
    again = net.cross_validate(task.repartition(3), 3, kind, 12, hidden=8, epochs=12).collect()
    assert {r.id: r.p for r in again} == {r.id: r.p for r in got}


def test_all_sequences_of_the_other_folds_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(net, "BLOCK", 300)  # four blocks
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1200, 6, 3)) * 0.3, np.arange(1200) // 3 % 2
    for i in np.flatnonzero(y):  # a bump, as in task
        at = rng.integers(0, 4)
        x[i, at : at + 3] += [1.5, -1.5, 1.0]
    rows = spark.createDataFrame([(i, i % 3, x[i].tolist(), int(y[i])) for i in range(1200)], "id long, fold int, x array<array<double>>, y int")
    get = lambda df: {r.id: (r.p, r.y, r.features) for r in net.cross_validate(df, 3, "cnn", 6, hidden=8, epochs=6).collect()}
    got = get(rows)
    assert len(got) == 1200 and np.mean([p == t for p, t, _ in got.values()]) > 0.85
    assert get(rows.repartition(5).orderBy(F.desc("id"))) == got
    late = rows.where("fold = 0").orderBy(F.desc(F.xxhash64("id", F.lit("net")))).limit(100).select("id")  # a sample of the lowest hashes lacks them
    other = get(rows.join(late.withColumn("flip", F.lit(1)), "id", "left").select("id", "fold", "x", F.when(F.col("flip").isNull(), F.col("y")).otherwise(1 - F.col("y")).alias("y")))
    assert all((other[i][2] == got[i][2]) == (i % 3 == 0) for i in got)


def test_steps_are_labelled_whole(task):
    rows = task.select("id", "fold", "x", F.col("steps").alias("y"))
    got = net.cross_validate_steps(rows, 3, "lstm", 6, hidden=8, epochs=10).collect()
    assert all(len(r.p) == len(r.y) for r in got)
    assert np.mean([a == b for r in got for a, b in zip(r.y, r.p)]) > 0.9


def test_autoencoder_features_keep_what_matters(task):
    got = net.cross_validate(task, 3, "autoencoder", 12, hidden=6, epochs=5).collect()
    assert all(len(r.features) == 6 and r.p is None and all(0 <= f <= 1 for f in r.features) for r in got)
    assert net.cross_validate(task.limit(0), 3, "cnn", 12).count() == 0


def test_models_are_saved_and_applied(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, (rng.normal(size=3) + (i % 2) * 2).tolist(), 1 if i % 2 else -1) for i in range(200)], "id long, x array<double>, y int")
    for make in (lambda: learn.forest(10), learn.linear_machine):
        learn.save_model(rows, make(), str(tmp_path / "m"))
        got = learn.predict(rows, str(tmp_path / "m")).collect()
        assert len(got) == 200 and np.mean([r.p == int(r.id % 2) for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)
