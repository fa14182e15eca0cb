"""A corpus from raw documents to training shards, in stages that are each written as Parquet and read again.

Stages that look for rows again number them first, so that null and repeated ids are judged row by row. The quality stage drops
rows without a text; a null source is a source of its own; an empty table goes through all stages. Other columns are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import dartminhash, decontam, mixing, quality, sharding
from helixframe.llm.common import bounded, fresh_path, numbered, stash, unused
from helixframe.llm.queries import MIX_WEIGHTS, SHARDS
from helixframe.sources.lineage import swept

#: The stages before the mix fit models and hash signatures that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep_columns=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, repeated rows and rows without an id included: that of the smallest id, null last."""
    rows, row = numbered(docs)
    groups = dartminhash.near_duplicates(rows, threshold=0.8, words=5, id_col=row)
    groups = stash(groups.select(F.col(row).alias("r"), F.col("component_id").alias("g"), "kept"), "groups")
    many = stash(groups.where("not kept").select("g").distinct(), "many")  # the groups of more than one row
    members = groups.join(bounded(many), "g").join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("i")), "r")
    members = stash(members.select("g", "r", "i"), "members")
    stays = members.groupBy("g").agg(F.min(F.struct(F.col("i").isNull(), "i", "r")).getField("r").alias("stays"))
    name = unused(rows, "_gone")
    gone = stash(members.join(bounded(stash(stays, "stays")), "g").where("r <> stays").select(F.col("r").alias(name)), "copies")
    return rows.join(bounded(gone), F.col(row) == F.col(name), "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no benchmark item contaminates."""
    rows, row = numbered(docs)
    return decontam.clean_documents(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_match=4, coverage=0.5, id_col=row).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows, row = numbered(docs)
    return mixing.apply_mix(rows, mixing.mix(rows, MIX_WEIGHTS, budget=1.5, cap=2.0, row_col=row), id_col=row).select(*docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row that is left."""
    return sharding.shard_documents(docs, [1.0] * SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "_"))
        with swept(spark):  # what a stage wrote for itself goes when its result stands
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
