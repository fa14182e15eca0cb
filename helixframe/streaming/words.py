"""Streaming ingest: the stateless encoders work on streams as they are; counts are kept by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.words import kmer_words


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """name, seq, arrived of FASTA files as they appear in a folder."""
    from ..sources.formats import parse_fasta

    rows = spark.readStream.option("lineSep", "\n>").text(folder).where(F.length(F.trim("value")) > 0)
    return rows.select(*parse_fasta(F.regexp_replace("value", "\r", "")), F.current_timestamp().alias("arrived"))


def deduplicated(seqs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sequences (seq, arrived) whose letters haven't come within `late` before; state is a hash for each sequence of that time."""
    rows = seqs.withColumn("_hash", F.md5("seq")).withWatermark("arrived", late)
    return rows.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def running_composition(seqs: DataFrame, alphabet: str) -> DataFrame:
    """letter, n: the letters of all sequences (seq) so far; state is a row for each letter. A stream's output mode is complete."""
    letters = F.explode(F.split(F.regexp_replace(F.upper("seq"), f"[^{alphabet}]", ""), "")).alias("letter")
    return seqs.select(letters).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


def windowed_words(seqs: DataFrame, k: int, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """start, word, n: k-mers of sequences (seq, arrived) by event-time window. Rows later than `late` are dropped, as watermarks
    do; state is a row for each word of an open window."""
    rows = seqs.withWatermark("arrived", late).withColumn("seq_id", F.col("arrived"))
    words = kmer_words(rows.select("seq_id", "seq"), k)
    return words.groupBy(F.window("seq_id", window).alias("w"), "word").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "word", "n")
