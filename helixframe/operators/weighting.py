"""TF-IDF, TextRank, co-occurrence and embeddings over words (seq_id, pos, word)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.exprs import rounded
from ..functions.tables import universe
from ..sources.lineage import stash
from .words import word_counts


def tf_idf(words: DataFrame, digits: int = 6) -> DataFrame:
    """seq_id, word (lower case), value: tf x (ln((1 + n) / (1 + df)) + 1), rows of length 1. Words of one letter don't count; n
    is the number of sequences that have words. Only term rows are shuffled; the number of sequences is one value. words may be
    counted already (seq_id, word, n, a word's row once for each sequence)."""
    long = words.where(F.length("word") >= 2).withColumn("word", F.lower("word"))
    counts = long.select("seq_id", "word", "n") if "n" in words.columns else word_counts(long)
    n = counts.agg(F.count_distinct("seq_id").alias("docs"))
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rows = counts.join(df, "word").join(F.broadcast(n))  # one row
    rows = rows.withColumn("w", F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy("seq_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value = F.col("w") / F.col("norm")
    return rows.join(norm, "seq_id").select("seq_id", "word", (rounded(value, digits) if digits >= 0 else value).alias("value"))


def text_rank(tfidf: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """seq_id, rank: PageRank of the graph whose edges are the inner products of all TF-IDF rows, loops included. Steps end after
    `rounds` or when the ranks' changes sum up to less than `tolerance` for each sequence.

    The graph is never built: a step goes from sequences to words and back, so that the work is that of the TF-IDF table and
    not of its square."""
    tfidf = stash(tfidf.select("seq_id", "word", "value"), "tfidf")
    mass = tfidf.groupBy("word").agg(F.sum("value").alias("mass"))
    degree = stash(tfidf.join(mass, "word").groupBy("seq_id").agg(F.sum(F.col("value") * F.col("mass")).alias("degree")), "degree")
    n = degree.count()
    ranks = degree.select("seq_id", "degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        word = tfidf.join(ranks, "seq_id").groupBy("word").agg(F.sum(F.col("value") * F.col("rank") / F.col("degree")).alias("score"))
        new = tfidf.join(word, "word").groupBy("seq_id").agg((F.lit((1 - alpha) / max(n, 1)) + alpha * F.sum(F.col("value") * F.col("score"))).alias("rank"))
        new = stash(degree.join(new, "seq_id").select("seq_id", "degree", "rank"), "ranks")
        moved = new.join(ranks.select("seq_id", F.col("rank").alias("was")), "seq_id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        ranks = new
        if moved < n * tolerance:
            break
    return ranks.select("seq_id", "rank")


def text_rank_features(tfidf: DataFrame, ranks: DataFrame) -> DataFrame:
    """TF-IDF values times their sequence's rank."""
    return tfidf.join(ranks, "seq_id").select("seq_id", "word", (F.col("value") * F.col("rank")).alias("value"))


def co_occurrence(words: DataFrame, window: int) -> DataFrame:
    """a, b, weight: symmetric counts of word pairs at distance d <= window, each for 1 / d. A lead over positions, so every
    word meets at most `window` others."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("pos")
    pairs = F.array(*[F.struct(F.lead("word", d).over(w).alias("b"), F.lit(1.0 / d).alias("weight")) for d in range(1, window + 1)])
    rows = words.select(F.col("word").alias("a"), pairs.alias("pairs")).select("a", F.explode("pairs").alias("p")).select("a", "p.b", "p.weight").where(F.col("b").isNotNull())
    one = rows.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def near_words(words: DataFrame, window: int) -> DataFrame:
    """a, b, d, n: how often word b stands d words after word a in a sequence, for d up to `window`; d of 0 has how often a occurs."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("pos")
    ahead = [F.struct(F.lit(d).alias("d"), (F.lead("word", d).over(w) if d else F.col("word")).alias("b")) for d in range(window + 1)]
    rows = words.select(F.col("word").alias("a"), F.array(*ahead).alias("p")).select("a", F.explode("p").alias("p")).select("a", "p.b", "p.d").where(F.col("b").isNotNull())
    return rows.groupBy("a", "b", "d").agg(F.count(F.lit(1)).alias("n"))


def _tree(counts: np.ndarray) -> tuple[list[list[int]], list[list[int]], int]:
    """Of the Huffman tree of words with such counts: the inner nodes above each word, on which side it is (1 or 0), and their number."""
    import heapq

    heap = [(int(n), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    size, up = len(heap), {}
    node = size
    while len(heap) > 1:
        (n, i), (m, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i], up[j] = (node - size, 0), (node - size, 1)
        heapq.heappush(heap, (n + m, node))
        node += 1
    nodes, sides = [], []
    for i in range(size):
        at, path = i, []
        while at in up:
            path.append(up[at])
            at = up[at][0] + size
        nodes.append([t for t, _ in path])
        sides.append([s for _, s in path])
    return nodes, sides, max(node - size, 1)


def fit_skip_gram(a: np.ndarray, b: np.ndarray, weight: np.ndarray, counts: np.ndarray, dim: int, rounds: int, rate: float, seed: int) -> np.ndarray:
    """Vectors of words 0, 1, ...: word a is to tell word b, so often as `weight` says, by hierarchical softmax over the Huffman tree of
    counts. All pairs are in each of the rounds (Adam); what the loss needs of them are the sums for each word and node."""
    nodes, sides, inner = _tree(counts)
    paths = np.array([len(p) for p in nodes])
    first = np.cumsum(paths) - paths
    node, side = (np.array([x for p in of for x in p], np.int64) for of in (nodes, sides))
    keys, ones, alls = [], [], []
    for lo in range(0, len(a), 1 << 16):  # a pair is a row for each node above its second word
        x, y, w = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)], weight[lo : lo + (1 << 16)]
        at = np.repeat(first[y] - (np.cumsum(paths[y]) - paths[y]), paths[y]) + np.arange(paths[y].sum())
        key, back = np.unique(np.repeat(x, paths[y]) * inner + node[at], return_inverse=True)
        w = np.repeat(w, paths[y])
        keys.append(key)
        alls.append(np.bincount(back, w, len(key)))
        ones.append(np.bincount(back, w * side[at], len(key)))
    key, back = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
    total, one = (np.bincount(back, np.concatenate(v), len(key)) if len(key) else np.zeros(0) for v in (alls, ones))
    i, t = key // inner, key % inner
    scale = 1 / max(total.sum(), 1.0) * len(counts)  # a mean, so that the step doesn't depend on the size of the corpus
    rng = np.random.default_rng(seed)
    p = [(rng.random((len(counts), dim)) - 0.5) / dim, np.zeros((inner, dim))]
    m, v = ([np.zeros_like(x) for x in p] for _ in range(2))
    for step in range(1, rounds + 1):
        grad = [np.zeros_like(x) for x in p]
        for lo in range(0, len(key), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            x, y = p[0][i[s]], p[1][t[s]]
            err = (total[s] / (1 + np.exp(-np.clip((x * y).sum(1), -30, 30))) - one[s]) * scale
            np.add.at(grad[0], i[s], err[:, None] * y)
            np.add.at(grad[1], t[s], err[:, None] * x)
        for c in range(2):
            m[c] = 0.9 * m[c] + 0.1 * grad[c]
            v[c] = 0.999 * v[c] + 0.001 * grad[c] ** 2
            p[c] = p[c] - rate * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-12)
    return p[0]


def skip_gram(near: DataFrame, dim: int = 10, window: int = 5, min_count: int = 5, seed: int = 42, rounds: int = 200, rate: float = 0.05) -> DataFrame:
    """word, vector by skip-gram on counts (a, b, d, n) of words at distance d, as near_words() makes them: every pair of the corpus
    counts, at distance d for (window - d + 1) / window, the share that windows of random width would take. Words that occur fewer than
    min_count times have no vector and are in no pair. Counting is the work and is spread; the fit, in one task, grows with the
    pairs of different words, a vocabulary's square at most."""
    import pandas as pd

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        own = t[(t["d"] == 0) & (t["n"] >= min_count)].sort_values("a")
        names = own["a"].to_numpy()
        t = t[(t["d"] > 0) & t["a"].isin(names) & t["b"].isin(names)].sort_values(["d", "a", "b"])
        a, b = (np.searchsorted(names, t[c].to_numpy()) for c in "ab")
        w = t["n"].to_numpy(float) * (window - t["d"].to_numpy() + 1) / window
        x = fit_skip_gram(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), own["n"].to_numpy(), dim, rounds, rate, seed)
        return pd.DataFrame({"word": names, "vector": list(x)})

    rows = near.where(F.col("d") <= window).select("a", "b", "d", "n", F.lit(0).alias("_all"))
    return rows.groupBy("_all").applyInPandas(lambda t: fit(t), "word string, vector array<double>")


def word2vec(words: DataFrame, dim: int = 10, window: int = 5, min_count: int = 5, seed: int = 42) -> DataFrame:
    """word, vector by skip-gram on the sequences' word lists."""
    return skip_gram(near_words(words, window), dim, window, min_count, seed)


def out_of_fold(words: DataFrame, folds: DataFrame, train, dim: int) -> DataFrame:
    """seq_id, fold, features: each fold's sequences embedded with vectors that train() made of the others' words. words: seq_id, pos,
    word; folds: seq_id, fold; train: words -> (word, vector)."""
    words = stash(words.join(folds, "seq_id"), "fold_words")
    out = None
    for r in folds.select("fold").distinct().orderBy("fold").collect():  # as many as folds
        vectors = train(words.where(F.col("fold") != r["fold"]).drop("fold"))
        part = embed(words.where(F.col("fold") == r["fold"]).drop("fold"), vectors, dim).withColumn("fold", F.lit(r["fold"]))
        out = part if out is None else out.unionByName(part)
    return out.select("seq_id", "fold", "features")


def kmer_out_of_fold(seqs: DataFrame, k: int, alphabet: str, dim: int, window: int = 5, min_count: int = 5, seed: int = 42) -> DataFrame:
    """seq_id, fold, features, mean: out_of_fold() of word2vec() for k-mers, and embed_kmers()' mean. seqs: seq_id, seq, fold. Each fold's words are counted once; a fold's
    vectors are fitted on the others' counts, and its sequences embedded where they stand. The 4^k vectors at most reach the driver."""
    from .bow import kmer_neighbours

    folds = [r["fold"] for r in seqs.select("fold").distinct().orderBy("fold").collect()]  # as many as folds
    near = None
    for f in folds:
        part = kmer_neighbours(seqs.where(F.col("fold") == f), k, alphabet, window).withColumn("fold", F.lit(f))
        near = part if near is None else near.unionByName(part)
    if near is None:
        return seqs.select("seq_id", "fold", *[F.array().cast("array<double>").alias(c) for c in ("features", "mean")])
    near = stash(near, "near")
    out = None
    for f in folds:
        others = near.where(F.col("fold") != f).groupBy("a", "b", "d").agg(F.sum("n").alias("n"))
        vectors = {r["word"]: r["vector"] for r in skip_gram(others, dim, window, min_count, seed).collect()}
        part = embed_kmers(seqs.where(F.col("fold") == f), k, alphabet, vectors, dim).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out.select("seq_id", "fold", "features", "mean")


def embed_kmers(seqs: DataFrame, k: int, alphabet: str, vectors: dict[str, list[float]], dim: int) -> DataFrame:
    """embed() of a sequence's k-mers where it stands: seq_id, features, mean. Windows without a vector are zeros in features; mean is that
    of the windows that have one, zeros if none has. Sequences without windows have no row."""
    names = universe(k, alphabet)
    table = np.array([vectors.get(w, [0.0] * dim) for w in names] + [[0.0] * dim])  # the last for -1
    known = np.array([w in vectors for w in names] + [False])

    def made(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        codes, at = A.letter_codes(column, alphabet)
        row, _, code = A.word_codes(codes, at, k, len(alphabet))
        size = np.bincount(row, minlength=len(column))
        has = np.flatnonzero(size)
        ends = np.concatenate([[0], np.cumsum(size[has] * dim)]).astype(np.int32)
        each = table[code]
        n = np.maximum(np.bincount(row, known[code], len(column))[has], 1)
        mean = np.stack([np.bincount(row, v, len(column))[has] / n for v in each.T], 1)
        places = pa.array(np.arange(len(has) + 1, dtype=np.int32) * dim)
        return has, {"features": pa.ListArray.from_arrays(pa.array(ends), pa.array(each.ravel())), "mean": pa.ListArray.from_arrays(places, pa.array(mean.ravel()))}

    return A.by_row(seqs, 1, made, "features array<double>, mean array<double>")


def _grams(word: str, shortest: int, longest: int) -> Column:
    return F.expr(f"flatten(transform(sequence({shortest}, {longest}), n -> transform(sequence(1, greatest(length({word}) + 3 - n, 1)), i -> substring(concat('<', {word}, '>'), i, n))))")


def _mean_of_grams(words: DataFrame, trained: DataFrame, shortest: int, longest: int, dim: int) -> DataFrame:
    some = words.select("word").distinct().select("word", F.explode(_grams("word", shortest, longest)).alias("gram"))
    joined = some.join(trained.withColumnRenamed("word", "gram"), "gram")
    return joined.groupBy("word").agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(dim)]).alias("vector"))


def subword_vectors(words: DataFrame, dim: int = 10, shortest: int = 2, longest: int = 3, seed: int = 42) -> DataFrame:
    """word, vector: the mean of skip-gram vectors of a word's character n-grams (the subword approximation of fastText)."""
    parts = words.select("seq_id", (F.col("pos") * 64).alias("pos"), "word").select("seq_id", "word", F.posexplode(_grams("word", shortest, longest)).alias("g", "gram"), "pos")
    trained = word2vec(parts.select("seq_id", (F.col("pos") + F.col("g")).alias("pos"), F.col("gram").alias("word")), dim, seed=seed)
    return _mean_of_grams(words, trained, shortest, longest, dim)


def subword_near(near: DataFrame, length: int, window: int = 5, shortest: int = 2, longest: int = 3) -> DataFrame:
    """near_words() of the n-grams of words that all have `length` letters, from near_words() of the words themselves as far as window /
    grams of a word, rounded up: where a gram stands after another depends on their two words and on how far apart these are."""
    each = sum(max(length + 3 - n, 1) for n in range(shortest, longest + 1))
    far = -(-window // each)
    rows = near.where(F.col("d") <= far)
    rows = rows.select("d", "n", F.when(F.length("a") == length, F.col("a")).otherwise(F.raise_error(F.lit("words must have one length"))).alias("a"), "b")
    rows = rows.select("d", "n", "b", F.posexplode(_grams("a", shortest, longest)).alias("i", "x")).select("d", "n", "i", "x", F.posexplode(_grams("b", shortest, longest)).alias("j", "y"))
    rows = rows.withColumn("d", (F.col("d") * each + F.col("j") - F.col("i")).cast("int"))
    return rows.where((F.col("d") >= 0) & (F.col("d") <= window)).groupBy(F.col("x").alias("a"), F.col("y").alias("b"), "d").agg(F.sum("n").alias("n"))


def kmer_subword_vectors(seqs: DataFrame, k: int, alphabet: str, dim: int = 10, shortest: int = 2, longest: int = 3, seed: int = 42, window: int = 5) -> DataFrame:
    """subword_vectors() for k-mers, from counts that are made where a sequence stands."""
    from .bow import kmer_neighbours

    near = stash(kmer_neighbours(seqs, k, alphabet, window), "near")
    trained = skip_gram(subword_near(near, k, window, shortest, longest), dim, window, seed=seed)
    return _mean_of_grams(near.where("d = 0").select(F.col("a").alias("word")), trained, shortest, longest, dim)


def embed(words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """seq_id, features: the vectors of a sequence's words end to end; unknown words are zeros."""
    zeros = F.array(*[F.lit(0.0)] * dim)
    rows = words.join(vectors, "word", "left").select("seq_id", F.struct("pos", F.coalesce("vector", zeros).alias("v")).alias("r"))
    return rows.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"])).alias("features"))


def glove(table: DataFrame, dim: int = 100, rounds: int = 50, x_max: float = 100.0, power: float = 0.75, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """word, vector of GloVe by AdaGrad on a co-occurrence table (a, b, weight), whose size is that of a vocabulary's square at
    most; it is fitted by one task of one executor. Vectors are the mean of main and context, of length 1."""
    import pandas as pd

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]))
        i, j = np.searchsorted(names, t["a"]), np.searchsorted(names, t["b"])
        x = t["weight"].to_numpy(float)
        f, logs = np.minimum(1.0, (x / x_max) ** power), np.log(x)
        rng = np.random.default_rng(seed)
        w = [(rng.random((len(names), dim)) - 0.5) / (dim + 1) for _ in range(2)]
        c = [(rng.random(len(names)) - 0.5) / (dim + 1) for _ in range(2)]
        gw, gc = [np.ones_like(v) for v in w], [np.ones_like(v) for v in c]
        for _ in range(rounds):
            err = f * ((w[0][i] * w[1][j]).sum(1) + c[0][i] + c[1][j] - logs)
            for side, own, other in ((0, i, w[1][j]), (1, j, w[0][i])):
                grad = np.zeros_like(w[side])
                np.add.at(grad, own, err[:, None] * other)
                w[side] = w[side] - rate * grad / np.sqrt(gw[side])
                gw[side] += grad**2
                bias = np.bincount(own, err, len(names))
                c[side] = c[side] - rate * bias / np.sqrt(gc[side])
                gc[side] += bias**2
        v = (w[0] + w[1]) / 2
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"word": names, "vector": list(v)})

    return table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda t: fit(t), "word string, vector array<double>")
