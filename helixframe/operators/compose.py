"""Every kind of word with every kind of weight, topic model and embedding, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analysis, learn, weighting
from . import words as W
from .scale import ranked

#: seqs, k, alphabet -> words (seq_id, pos, word)
WORDS: dict[str, Callable[[DataFrame, int, str], DataFrame]] = {
    "Kmer": lambda s, k, a: W.kmer_words(s, k),
    "RevKmer": lambda s, k, a: W.revkmer_words(s, k),
    "Mismatch": lambda s, k, a: W.mismatch_words(s, k, a),
    "Subsequence": lambda s, k, a: W.subsequence_words(s, k),
    "Top-N-Gram": lambda s, k, a: W.tng_words(s, k, k),
    "DR": lambda s, k, a: W.dr_words(s, k).drop("dist"),
    "DT": lambda s, k, a: W.dt_words(s, k).drop("dist"),
}
SOURCES = ("BOW", "TF-IDF", "TextRank")
#: A topic model's vocabulary may have so many words; its matrix is as wide.
VOCABULARY = 8192


def sentence(seqs: DataFrame, kind: str, k: int, alphabet: str) -> DataFrame:
    """Words of sequences (seq_id, seq) by the name of their kind."""
    if kind not in WORDS:
        raise ValueError(f"words are one of {', '.join(WORDS)}")
    return WORDS[kind](seqs, k, alphabet)


def weighted(words: DataFrame, source: str, alpha: float = 0.85) -> DataFrame:
    """seq_id, word, value: counts, TF-IDF values, or these times their sequence's rank."""
    if source == "BOW":
        return W.word_counts(words).select("seq_id", "word", F.col("n").cast("double").alias("value"))
    if source not in SOURCES:
        raise ValueError(f"a source is one of {', '.join(SOURCES)}")
    rows = weighting.tf_idf(words, digits=-1)
    return rows if source == "TF-IDF" else weighting.text_rank_features(rows, weighting.text_rank(rows, alpha))


def wide(rows: DataFrame) -> DataFrame:
    """id, x: a row's values (seq_id, word, value) in the order of all words, zeros where it has none."""
    names = ranked(rows.select("word").distinct(), [], ["word"], "place")
    n = names.count()
    if n > VOCABULARY:
        raise ValueError(f"{n} words are more than the {VOCABULARY} that a topic model's matrix may have")
    some = rows.join(F.broadcast(names), "word").groupBy(F.col("seq_id").alias("id")).agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "value")).alias("v"))
    kind = some.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                v = part.column("v")
                flat = v.flatten()
                x = np.zeros((part.num_rows, n))
                x[np.repeat(np.arange(part.num_rows), v.value_lengths().to_numpy(zero_copy_only=False)), flat.field("place").to_numpy(zero_copy_only=False)] = flat.field("value").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    return some.mapInArrow(run, f"id {kind}, x array<double>")


def topic_features(words: DataFrame, source: str, method: str, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """id, topics: LSA, PLSA, LDA or Labeled-LDA of words by a source's weights. Labeled-LDA is LDA: the original hands its labels to a
    fit that doesn't look at them."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = weighted(words, source)
    if method == "LSA":
        return analysis.truncated_svd(wide(rows), k).withColumnRenamed("z", "topics")
    if method == "PLSA":
        got = learn.plsa(rows.withColumnRenamed("value", "n"), k, rounds)
        return got.groupBy(F.col("seq_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "p"))), lambda r: r["p"]).alias("topics"))
    if method in ("LDA", "Labeled-LDA"):
        vectors = wide(rows).select("id", array_to_vector("x").alias("features"))
        return LDA(k=k, maxIter=rounds, seed=seed).fit(vectors).transform(vectors).select("id", vector_to_array("topicDistribution").alias("topics"))
    raise ValueError("a topic model is LSA, PLSA, LDA or Labeled-LDA")


def word_vectors(words: DataFrame, method: str, dim: int, window: int = 5) -> DataFrame:
    """word, vector by word2vec, Glove or fastText."""
    if method == "word2vec":
        return weighting.word2vec(words, dim, window)
    if method == "Glove":
        return weighting.glove(weighting.co_occurrence(words, window), dim)
    if method == "fastText":
        return weighting.subword_vectors(words, dim)
    raise ValueError("an embedding is word2vec, Glove or fastText")
