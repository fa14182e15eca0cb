"""Small neural networks in numpy: convolutions, recurrent nets, encoders with attention, and an autoencoder.

They are fitted on all of the other folds' sequences, dealt into blocks by the hash of their ids: in an epoch each block goes on from the
same net by itself, and the blocks' nets are averaged (iterative parameter mixing). Nets that label single steps are fitted in one
process on a bounded sample, the sequences with the lowest hashes. Then every sequence is scored or encoded where its row stands.
Results are out of fold: no sequence is seen by the net that reads it. Gradients come from a tape of the operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import stash

#: A net for single steps is fitted on at most so many sequences of the other folds.
SAMPLE = 400
#: Sequences of a block; there are at most BLOCKS of them, so that beyond BLOCK * BLOCKS sequences they are larger. As many sets of
#: parameters reach the driver in an epoch.
BLOCK, BLOCKS = 2048, 1024


class Tensor:
    """An array, and how its gradient reaches those that it was made of."""

    def __init__(self, data, parents: tuple = ()) -> None:
        self.data = np.asarray(data, float)
        self.grad: np.ndarray | None = None
        self.parents = parents  # (tensor, gradient of self -> gradient of it)

    def backward(self) -> None:
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            t, done = todo.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                todo.append((t, True))
                todo += [(p, False) for p, _ in t.parents]
        for t in order:
            t.grad = None
        self.grad = np.ones_like(self.data)
        for t in reversed(order):
            for p, back in t.parents:
                g = back(t.grad)
                p.grad = g if p.grad is None else p.grad + g

    def __add__(self, other) -> Tensor:
        other = as_tensor(other)
        return Tensor(self.data + other.data, ((self, lambda g: _fit(g, self.data)), (other, lambda g: _fit(g, other.data))))

    def __mul__(self, other) -> Tensor:
        other = as_tensor(other)
        return Tensor(self.data * other.data, ((self, lambda g: _fit(g * other.data, self.data)), (other, lambda g: _fit(g * self.data, other.data))))

    def __sub__(self, other) -> Tensor:
        return self + as_tensor(other) * -1.0

    def __matmul__(self, other: Tensor) -> Tensor:
        turn = lambda a: np.swapaxes(a, -1, -2)
        return Tensor(self.data @ other.data, ((self, lambda g: _fit(g @ turn(other.data), self.data)), (other, lambda g: _fit(turn(self.data) @ g, other.data))))

    def __getitem__(self, at) -> Tensor:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return out

        return Tensor(self.data[at], ((self, back),))

    def reshape(self, *shape: int) -> Tensor:
        return Tensor(self.data.reshape(shape), ((self, lambda g: g.reshape(self.data.shape)),))

    def transpose(self, *axes: int) -> Tensor:
        return Tensor(self.data.transpose(axes), ((self, lambda g: g.transpose(np.argsort(axes))),))

    def mean(self, axis: int) -> Tensor:
        n = self.data.shape[axis]
        return Tensor(self.data.mean(axis, keepdims=True), ((self, lambda g: np.broadcast_to(g / n, self.data.shape)),))

    def max(self, axis: int) -> Tensor:
        at = np.expand_dims(self.data.argmax(axis), axis)

        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.data)
            np.put_along_axis(out, at, np.expand_dims(g, axis), axis)
            return out

        return Tensor(np.take_along_axis(self.data, at, axis).squeeze(axis), ((self, back),))

    def power(self, p: float) -> Tensor:
        return Tensor(self.data**p, ((self, lambda g: g * p * self.data ** (p - 1)),))


def as_tensor(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def _fit(g: np.ndarray, like: np.ndarray) -> np.ndarray:
    """A gradient summed over the axes along which an array was repeated."""
    while g.ndim > like.ndim:
        g = g.sum(0)
    for axis, n in enumerate(like.shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def relu(x: Tensor) -> Tensor:
    return Tensor(np.maximum(x.data, 0), ((x, lambda g: g * (x.data > 0)),))


def sigmoid(x: Tensor) -> Tensor:
    y = 1 / (1 + np.exp(-np.clip(x.data, -60, 60)))
    return Tensor(y, ((x, lambda g: g * y * (1 - y)),))


def tanh(x: Tensor) -> Tensor:
    y = np.tanh(x.data)
    return Tensor(y, ((x, lambda g: g * (1 - y * y)),))


def softmax(x: Tensor) -> Tensor:
    e = np.exp(x.data - x.data.max(-1, keepdims=True))
    y = e / e.sum(-1, keepdims=True)
    return Tensor(y, ((x, lambda g: y * (g - (g * y).sum(-1, keepdims=True))),))


def join(parts: list[Tensor], axis: int) -> Tensor:
    cuts = np.cumsum([p.data.shape[axis] for p in parts])[:-1]
    return Tensor(np.concatenate([p.data for p in parts], axis), tuple((p, lambda g, i=i: np.split(g, cuts, axis)[i]) for i, p in enumerate(parts)))


def cross_entropy(x: Tensor, y: np.ndarray, weight: np.ndarray | None = None) -> Tensor:
    """The mean negative log likelihood of classes y under logits x (last axis), over the places with weight."""
    z = x.data - x.data.max(-1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(-1, keepdims=True))
    w = np.ones(y.shape) if weight is None else weight
    total = max(w.sum(), 1.0)
    one = np.eye(x.data.shape[-1])[y]
    return Tensor(-(logs * one).sum(-1) @ w / total if y.ndim == 1 else -((logs * one).sum(-1) * w).sum() / total, ((x, lambda g: g * (np.exp(logs) - one) * w[..., None] / total),))


# ---- networks: x is (sequences, steps, width); a step of nothing but zeros is padding ----------------------------------------


class Net:
    """Parameters by name, made when first asked for, from a seed."""

    def __init__(self, kind: str, classes: int = 2, hidden: int = 16, per_step: bool = False, seed: int = 42) -> None:
        if kind not in ENCODERS:
            raise ValueError(f"a net is one of {', '.join(ENCODERS)}")
        self.kind, self.classes, self.hidden, self.per_step = kind, classes, hidden, per_step
        self.rng = np.random.default_rng(seed)
        self.p: dict[str, Tensor] = {}

    def par(self, name: str, *shape: int) -> Tensor:
        if name not in self.p:
            bound = np.sqrt(6 / (shape[0] + shape[-1])) if len(shape) > 1 else 0.0
            self.p[name] = Tensor(self.rng.uniform(-bound, bound, shape))
        return self.p[name]

    def dense(self, name: str, x: Tensor, out: int) -> Tensor:
        return x @ self.par(f"{name}.w", x.data.shape[-1], out) + self.par(f"{name}.b", out)

    def conv(self, name: str, x: Tensor, out: int, wide: int = 3) -> Tensor:
        """A convolution along the steps that keeps their number."""
        n, steps, width = x.data.shape
        pad = Tensor(np.zeros((n, wide // 2, width)))
        full = join([pad, x, pad], 1)
        return self.dense(name, join([full[:, i : i + steps] for i in range(wide)], 2), out)

    def recurrent(self, name: str, x: Tensor, cell: str, back: bool) -> list[Tensor]:
        """The state after each step, in the order of the steps."""
        n, steps, _ = x.data.shape
        h = c = Tensor(np.zeros((n, self.hidden)))
        out: list = [None] * steps
        for i in range(steps)[:: -1 if back else 1]:
            now = x[:, i]
            live = (np.abs(now.data).sum(1, keepdims=True) > 0).astype(float)  # padding leaves the state as it is
            if cell == "lstm":
                z = self.dense(f"{name}.x", now, 4 * self.hidden) + h @ self.par(f"{name}.h", self.hidden, 4 * self.hidden)
                a, b, d, e = (z[:, k * self.hidden : (k + 1) * self.hidden] for k in range(4))
                new_c = sigmoid(b + 1.0) * c + sigmoid(a) * tanh(d)
                new = sigmoid(e) * tanh(new_c)
                c = new_c * live + c * (1 - live)
            else:
                z = self.dense(f"{name}.x", now, 2 * self.hidden) + h @ self.par(f"{name}.h", self.hidden, 2 * self.hidden)
                keep, use = sigmoid(z[:, : self.hidden]), sigmoid(z[:, self.hidden :])
                new = keep * h + (keep * -1.0 + 1.0) * tanh(self.dense(f"{name}.n", join([now, use * h], 1), self.hidden))
            h = new * live + h * (1 - live)
            out[i] = h
        return out

    def both_ways(self, name: str, x: Tensor, cell: str) -> Tensor:
        """Per step, or for the whole sequence, the states of a net that reads forwards and one that reads backwards."""
        there, back = self.recurrent(f"{name}.f", x, cell, False), self.recurrent(f"{name}.b", x, cell, True)
        if not self.per_step:
            return join([there[-1], back[0]], 1)
        n = x.data.shape[0]
        return join([join([t, b], 1).reshape(n, 1, 2 * self.hidden) for t, b in zip(there, back)], 1)

    def norm(self, name: str, x: Tensor) -> Tensor:
        mid = x - x.mean(-1)
        sd = ((mid * mid).mean(-1) + 1e-6).power(-0.5)
        return mid * sd * (self.par(f"{name}.g", x.data.shape[-1]) + 1.0) + self.par(f"{name}.s", x.data.shape[-1])

    def attend(self, name: str, x: Tensor, mask: np.ndarray, heads: int = 2, weighted: bool = False) -> Tensor:
        """A layer of an encoder: attention, then a dense layer, each added to its input and normalised. With weighted, each head is a
        branch with a learned share of the sum, as large as the others' at first."""
        n, steps, width = x.data.shape
        size = width // heads
        cut = lambda t: t.reshape(n, steps, heads, size).transpose(0, 2, 1, 3)
        q, k, v = (cut(self.dense(f"{name}.{c}", x, width)) for c in "qkv")
        score = q @ k.transpose(0, 1, 3, 2) * (1 / np.sqrt(size)) + (mask[:, None, None, :] - 1) * 1e9
        got = softmax(score) @ v
        if weighted:
            got = got * (softmax(self.par(f"{name}.share", heads)) * float(heads)).reshape(heads, 1, 1)
        mixed = self.dense(f"{name}.o", got.transpose(0, 2, 1, 3).reshape(n, steps, width), width)
        x = self.norm(f"{name}.n1", x + mixed)
        return self.norm(f"{name}.n2", x + self.dense(f"{name}.d2", relu(self.dense(f"{name}.d1", x, 2 * width)), width))

    def features(self, x: np.ndarray) -> Tensor:
        """What the last layer reads, for each sequence or each step."""
        return ENCODERS[self.kind](self, Tensor(x), (np.abs(x).sum(2) > 0).astype(float))

    def logits(self, x: np.ndarray) -> Tensor:
        return self.dense("out", self.features(x), self.classes)

    def loss(self, x: np.ndarray, y: np.ndarray) -> Tensor:
        return cross_entropy(self.logits(x), y, (np.abs(x).sum(2) > 0).astype(float) if self.per_step else None)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01) -> Net:
        """Adam on four fifths of the rows; the parameters of the epoch that is best on the other fifth stay."""
        held, own = self.split(len(x))
        self.loss(x[:1], y[:1])
        m, v = ({k: np.zeros_like(t.data) for k, t in self.p.items()} for _ in range(2))
        best, kept, step = np.inf, None, 0
        for _ in range(epochs):
            own = self.rng.permutation(own)
            step = self.epoch(x[own], y[own], m, v, step, batch, rate)
            now = float(self.loss(x[held], y[held]).data)
            if now < best:
                best, kept = now, {k: t.data.copy() for k, t in self.p.items()}
        for k, d in (kept or {}).items():
            self.p[k].data = d
        return self

    def split(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that are held out, and the others."""
        order = self.rng.permutation(n)
        return (order[: n // 5], order[n // 5 :]) if n >= 10 else (order, order)

    def epoch(self, x: np.ndarray, y: np.ndarray, m: dict, v: dict, step: int, batch: int = 32, rate: float = 0.01) -> int:
        """One pass of Adam over rows in their order. m and v, its moments, are changed; the number of steps so far comes back."""
        for lo in range(0, len(x), batch):
            self.loss(x[lo : lo + batch], y[lo : lo + batch]).backward()
            step += 1
            for k, t in self.p.items():
                if t.grad is not None:
                    m[k] = 0.9 * m[k] + 0.1 * t.grad
                    v[k] = 0.999 * v[k] + 0.001 * t.grad**2
                    t.data = t.data - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return step


class AutoEncoder(Net):
    """A dense layer with a sigmoid, which is the feature, one of as many numbers as classes, and one that makes the input again; the
    loss is the mean squared difference."""

    def __init__(self, classes: int = 2, hidden: int = 16, seed: int = 42) -> None:
        super().__init__("cnn", classes, hidden, False, seed)

    def features(self, x: np.ndarray) -> Tensor:
        return sigmoid(self.dense("in", Tensor(x.reshape(len(x), -1)), self.hidden))

    def loss(self, x: np.ndarray, y: np.ndarray) -> Tensor:
        flat = x.reshape(len(x), -1)
        gap = self.dense("back", self.dense("mid", self.features(x), self.classes), flat.shape[1]) - flat
        return (gap * gap).reshape(1, -1).mean(1).reshape()


def _pooled(net: Net, x: Tensor, mask: np.ndarray) -> Tensor:
    return x if net.per_step else (x + (mask[:, :, None] - 1) * 1e9 * (mask.sum(1) > 0)[:, None, None]).max(1)


def _convolved_then_read(net: Net, x: Tensor, mask: np.ndarray) -> Tensor:
    c = relu(net.conv("c1", x, net.hidden)) * mask[:, :, None]
    n, steps, width = c.data.shape
    if not net.per_step and steps % 2 == 0:  # pool pairs of steps
        c = c.reshape(n, steps // 2, 2, width).max(2)
    return relu(net.dense("fc", net.both_ways("r", c, "lstm"), net.hidden))


def _attending(weighted: bool) -> Callable:
    def encode(net: Net, x: Tensor, mask: np.ndarray) -> Tensor:
        h = net.dense("in", x, net.hidden)
        for k in range(2):
            h = net.attend(f"l{k}", h, mask, weighted=weighted)
        return _pooled(net, h, mask)

    return encode


ENCODERS: dict[str, Callable] = {
    "cnn": lambda net, x, mask: _pooled(net, relu(net.conv("c2", relu(net.conv("c1", x, net.hidden)), net.hidden)), mask),
    "lstm": lambda net, x, mask: net.both_ways("r", x, "lstm"),
    "gru": lambda net, x, mask: net.both_ways("r", x, "gru"),
    "cnn-bilstm": _convolved_then_read,
    "transformer": _attending(False),
    "weighted-transformer": _attending(True),
}


# ---- over tables -----------------------------------------------------------------------------------------------------------


def _padded(rows: list, steps: int, width: int | None = None) -> np.ndarray:
    width = width or max((len(r[0]) for r in rows if len(r)), default=1)
    out = np.zeros((len(rows), steps, width))
    for i, r in enumerate(rows):
        if len(r):
            out[i, : min(len(r), steps)] = np.stack(r[:steps])
    return out


def _sampled(rows: DataFrame, fold: int, sample: int) -> list:
    """At most `sample` rows of the other folds, those of the lowest hashes; what is far above is left out before the sort."""
    rest = rows.where(F.col("fold") != fold).withColumn("_h", F.xxhash64("id", F.lit("net")))
    share = min(1.0, (2 * sample + 100) / max(rest.count(), 1))
    low = rest.where(F.col("_h") <= F.lit(min(int(-(2**63) + 2**64 * share), 2**63 - 1))).select("id", "_h")
    ids = [r["id"] for r in low.orderBy("_h").limit(sample).collect()]  # ids alone
    return rows.where(F.col("id").isin(ids)).select("id", "x", "y").orderBy("id").collect()


def _packed(rows: DataFrame, blocks: int, steps: int, width: int) -> DataFrame:
    """A row for each block: fold, y (8 bytes each) and x (padded) of its sequences in the order of their ids. Dealt by hash: any order
    of the rows gives the same blocks."""

    def pack(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        x = _padded(t["x"].tolist(), steps, width)
        t = pd.DataFrame({"id": t["id"], "y": (t["y"] > 0).astype(np.int64), "fold": t["fold"].astype(np.int64), "x": [v.tobytes() for v in x]}).sort_values(["id", "y", "fold", "x"])
        return pd.DataFrame({"block": [key[0]], "fold": [t["fold"].to_numpy().tobytes()], "y": [t["y"].to_numpy().tobytes()], "x": [b"".join(t["x"])]})

    dealt = rows.select("id", "fold", F.slice("x", 1, steps).alias("x"), "y", F.pmod(F.xxhash64("id", F.lit("net")), F.lit(blocks)).alias("block"))
    return dealt.repartition(blocks, "block").groupBy("block").applyInPandas(pack, "block long, fold binary, y binary, x binary")


def _fitted(rows: DataFrame, k: int, made: Callable[[], Net], steps: int, width: int, epochs: int, blocks: int) -> dict[int, Net]:
    """A net for each fold, fitted on all sequences of the others; the averages of the epoch that is best on what blocks hold out stay."""
    packed = stash(_packed(rows, blocks, steps, width), "net_blocks")
    nets = {i: made() for i in range(k)}
    for net in nets.values():
        net.loss(np.zeros((1, steps, width)), np.zeros(1, int))  # names and shapes of the parameters
    names = list(nets[0].p) if nets else []
    shapes = {n: nets[0].p[n].data.shape for n in names}
    size = sum(nets[0].p[n].data.size for n in names)

    def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([int(np.prod(shapes[n])) for n in names])[:-1]
        return {n: v.reshape(shapes[n]) for n, v in zip(names, np.split(flat, cuts))}

    def one(x: np.ndarray, y: np.ndarray, start: np.ndarray, step: int, epoch: int) -> tuple[int, float, int, bytes]:
        """Of a block: rows held out and their mean loss before the epoch; steps so far and parameters with moments after it."""
        net = made()
        held, own = net.split(len(x))
        p, m, v = (parts(f.copy()) for f in np.split(start, 3))
        net.p = {n: Tensor(d) for n, d in p.items()}
        loss = sum(float(net.loss(x[at], y[at]).data) * len(at) for at in np.split(held, range(256, len(held), 256))) / len(held)
        if epoch < epochs:
            for _ in range(epoch + 1):
                own = net.rng.permutation(own)
            step = net.epoch(x[own], y[own], m, v, step)
        p = {n: t.data for n, t in net.p.items()}
        return len(held), loss, step, np.concatenate([of[n].ravel() for of in (p, m, v) for n in names]).tobytes()

    states = {i: (np.concatenate([*(net.p[n].data.ravel() for n in names), np.zeros(2 * size)]), 0) for i, net in nets.items()}
    best, kept = dict.fromkeys(nets, np.inf), {}
    for epoch in range(epochs + 1):

        def run(batches: Iterator[pd.DataFrame], states: dict = dict(states), epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, fold, y, x in zip(b["block"], b["fold"], b["y"], b["x"]):
                    fold, y = np.frombuffer(fold, np.int64), np.frombuffer(y, np.int64)
                    x = np.frombuffer(x).reshape(len(y), steps, width)
                    for i in range(k):
                        if len(some := np.flatnonzero(fold != i)):
                            yield pd.DataFrame([(i, block, len(some), *one(x[some], y[some], *states[i], epoch))], columns=["i", "block", "n", "held", "loss", "step", "state"])

        got: dict[int, list] = {}
        for r in packed.mapInPandas(run, "i int, block long, n long, held long, loss double, step long, state binary").collect():  # BLOCKS at most for each fold
            got.setdefault(r["i"], []).append(r)
        for i, of in got.items():
            of.sort(key=lambda r: r["block"])
            now = sum(r["loss"] * r["held"] for r in of) / sum(r["held"] for r in of)
            if epoch and now < best[i]:
                best[i], kept[i] = now, states[i][0][:size]
            total = sum(r["n"] for r in of)
            states[i] = sum(np.frombuffer(r["state"]) * (r["n"] / total) for r in of), max(r["step"] for r in of)
    for i, flat in kept.items():
        for n, d in parts(flat).items():
            nets[i].p[n].data = d
    return nets


def cross_validate(rows: DataFrame, k: int, kind: str, steps: int, hidden: int = 16, epochs: int = 10, seed: int = 42) -> DataFrame:
    """id, fold, y, p, score and features (what the net's last layer reads) of every sequence, by a net that is fitted on all sequences
    of the other folds. rows: id, fold, x (steps of numbers, cut or padded to `steps`), y (0 or 1). kind: one of ENCODERS, or
    'autoencoder', which knows no labels: its p and score are null."""

    def made() -> Net:
        return AutoEncoder(2, hidden, seed) if kind == "autoencoder" else Net(kind, 2, hidden, False, seed)

    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size(F.get("x", F.lit(0))))).first()
    width = max(width or 1, 1)
    nets = _fitted(rows, k, made, steps, width, epochs, min(-(-n // BLOCK), BLOCKS)) if n else {i: made() for i in range(k)}
    number = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                for fold, of in part.groupby("fold"):
                    x, net = _padded(of["x"].tolist(), steps, width), nets[int(fold)]
                    f = net.features(x).data
                    p = [None] * len(of) if kind == "autoencoder" else softmax(net.dense("out", Tensor(f), 2)).data[:, 1]
                    yield pd.DataFrame({"id": of["id"], "fold": of["fold"], "y": (of["y"] > 0).astype(int), "p": [None if s is None else int(s >= 0.5) for s in p], "score": p, "features": list(f)})

    return rows.select("id", "fold", "x", "y").mapInPandas(run, f"id {number}, fold int, y int, p int, score double, features array<double>")


def cross_validate_steps(rows: DataFrame, k: int, kind: str, steps: int, hidden: int = 16, epochs: int = 10, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """id, fold, y, p, score (arrays, one number for each step): labels of single steps. rows: id, fold, x, y (array of 0 and 1).
    Sequences are fitted and read in pieces of `steps`, so that each step of every sequence gets its label."""
    nets: dict[int, Net] = {}
    for i in range(k):
        some = _sampled(rows, i, sample)
        pieces = [(r["x"][lo : lo + steps], r["y"][lo : lo + steps]) for r in some for lo in range(0, len(r["x"]), steps)]
        net = Net(kind, 2, hidden, True, seed)
        if pieces:
            y = np.zeros((len(pieces), steps), int)
            for j, (_, labels) in enumerate(pieces):
                y[j, : len(labels)] = labels
            net.fit(_padded([x for x, _ in pieces], steps), y, epochs)
        nets[i] = net
    number = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = []
            for fold, x in zip(b["fold"], b["x"]):
                got: list[float] = []
                for lo in range(0, len(x), 128 * steps):
                    pieces = [x[a : a + steps] for a in range(lo, min(lo + 128 * steps, len(x)), steps)]
                    s = softmax(nets[int(fold)].logits(_padded(pieces, steps))).data[:, :, 1]
                    got += [v for row, piece in zip(s.tolist(), pieces) for v in row[: len(piece)]]
                scores.append(got)
            yield pd.DataFrame({"id": b["id"], "fold": b["fold"], "y": b["y"], "p": [[int(v >= 0.5) for v in s] for s in scores], "score": scores})

    return rows.select("id", "fold", "x", "y").mapInPandas(run, f"id {number}, fold int, y array<int>, p array<int>, score array<double>")
