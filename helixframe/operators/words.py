"""Biological words of sequences. seqs: seq_id, seq. Results are long (seq_id, pos, word) unless said otherwise; pos is from 0.

A null or empty sequence has no words; letters outside the alphabet stay in the words that they stand in."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fixed, kmers, letters, lookup, revcomp
from ..functions.tables import top_letters


def _exploded(seqs: DataFrame, words: Column) -> DataFrame:
    return seqs.select("seq_id", F.posexplode(words).alias("pos", "word"))


def padded(seqs: DataFrame, length: int) -> DataFrame:
    """Sequences of one length, cut or padded with X."""
    return seqs.withColumn("seq", fixed(F.col("seq"), length))


def kmer_words(seqs: DataFrame, k: int) -> DataFrame:
    return _exploded(seqs.withColumn("c", letters(F.col("seq"))), kmers(F.col("c"), k))


def revkmer_words(seqs: DataFrame, k: int) -> DataFrame:
    """Each window as its reverse complement."""
    return kmer_words(seqs, k).withColumn("word", revcomp(F.col("word")))


def mismatch_words(seqs: DataFrame, k: int, alphabet: str, m: int = 1) -> DataFrame:
    """Each window and, for m = 1, all words that differ from it in one letter; m = 0 gives the windows alone."""
    rows = kmer_words(seqs, k)
    if m == 0:
        return rows
    every = [F.array("word")]
    for i in range(1, k + 1):
        here, before, after = (F.substring("word", *x) for x in ((i, 1), (1, i - 1), (i + 1, k)))
        every += [F.array(F.when(here != a, F.concat(before, F.lit(a), after))) for a in alphabet]
    return rows.select("seq_id", "pos", F.explode(F.array_compact(F.concat(*every))).alias("word"))


def subsequence_words(seqs: DataFrame, k: int) -> DataFrame:
    """For each letter, it and any k - 1 of the four letters after it, in order; none for k > 5."""
    c = F.col("c")
    rows = seqs.withColumn("c", letters(F.col("seq"))).select("seq_id", "c", F.posexplode("c").alias("pos", "first"))
    ways = [F.when(F.col("pos") + 1 + w[-1] <= F.size(c), F.concat("first", *[F.element_at(c, F.col("pos") + 1 + j) for j in w])) if w else F.col("first") for w in combinations(range(1, 5), k - 1)]
    if not ways:
        return rows.select("seq_id", "pos", F.lit("").alias("word")).limit(0)
    return rows.select("seq_id", "pos", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("word"))


def top_n_gram(seqs: DataFrame, n: int, profile: DataFrame | None = None) -> DataFrame:
    """seqs with each residue replaced by its n most frequent amino acids: by profile (seq_id, pos, scores in the matrices'
    order) where there is one, else by BLOSUM62."""
    from ..functions.tables import MATRIX_ORDER

    fallback = F.array_join(F.transform(letters(F.col("seq")), lambda x: F.coalesce(lookup(x, top_letters(n)), F.lit(""))), "")
    if profile is None:
        return seqs.withColumn("seq", fallback)
    names = F.array(*[F.lit(a) for a in MATRIX_ORDER])
    ranked = F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    gram = F.array_join(F.transform(F.slice(ranked, 1, n), lambda r: F.element_at(names, r["i"] + 1)), "")
    per = profile.select("seq_id", "pos", gram.alias("gram")).groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gram"))), lambda r: r["gram"]), "").alias("grams"))
    return seqs.join(per, "seq_id", "left").withColumn("seq", F.coalesce("grams", fallback)).drop("grams")


def tng_words(seqs: DataFrame, n: int, k: int, profile: DataFrame | None = None) -> DataFrame:
    return kmer_words(top_n_gram(seqs, n, profile), k)


def dr_words(seqs: DataFrame, max_distance: int) -> DataFrame:
    """Each letter, and it with the letter at distance 1 to max_distance; `dist` is 0 for single letters."""
    c = F.col("c")
    rows = seqs.withColumn("c", letters(F.col("seq"))).select("seq_id", "c", F.posexplode("c").alias("pos", "a"))
    made = [F.struct(F.lit(0).alias("dist"), F.col("a").alias("word"))]
    made += [F.struct(F.lit(d).alias("dist"), F.when(F.col("pos") + 1 + d <= F.size(c), F.concat("a", F.element_at(c, F.col("pos") + 1 + d))).alias("word")) for d in range(1, max_distance + 1)]
    rows = rows.select("seq_id", "pos", F.explode(F.array(*made)).alias("w")).select("seq_id", "pos", "w.dist", "w.word")
    return rows.where(F.col("word").isNotNull())


def dt_words(seqs: DataFrame, max_distance: int, profile: DataFrame | None = None) -> DataFrame:
    return dr_words(top_n_gram(seqs, 1, profile), max_distance)


def word_counts(words: DataFrame, *more: str) -> DataFrame:
    """seq_id, word, n."""
    return words.groupBy("seq_id", *more, "word").agg(F.count(F.lit(1)).alias("n"))
