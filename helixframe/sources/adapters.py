"""Sequences, labels and vectors from the driver's tables, which hold no biological data.

Illegal letters are dropped before upper-casing: Java's upper() can turn one letter into two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import DNA, PROTEIN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sequences(spark: SparkSession, sf_dir: str, alphabet: str) -> DataFrame:
    keep = f"[^{alphabet}{alphabet.lower()}]"
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", keep, "")).alias("seq"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, DNA)


def rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).withColumn("seq", F.translate("seq", "T", "U"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, PROTEIN)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, y (+1 or -1)."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x (doubles), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


# The same views for the SQL that checks the queries.
SQL_VIEWS = {
    "dna": "dna AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)",
    "rna": "rna AS (SELECT doc_id AS seq_id, replace(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 'T', 'U') AS seq FROM documents)",
    "protein": f"protein AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^{PROTEIN}{PROTEIN.lower()}]', '', 'g')) AS seq FROM documents)",
    "labelled": "labelled AS (SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS y FROM labels)",
    "vectors": "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)",
}
