"""Sharding by weighted rendezvous hashing.

Every shard draws a number for every record key; the record goes to the shard with the lowest draw divided by its weight.
A shard's draw for a key doesn't depend on the other shards, so a new shard takes only the records that it wins, and a
shard that goes gives up only its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_fraction, ranked, stash


def rendezvous(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard (0, 1, ...) of a record key; weights are finite and positive, one for each shard.

    The draw is -ln(u) / weight with u from the key's and the shard's MD5; the least draw wins, the lowest shard on a tie.
    A null key is hashed as the word null: all such records share a shard."""
    if not weights or not all(0 < w < float("inf") for w in weights):
        raise ValueError("every shard needs a finite positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    draws = [
        F.struct((-F.ln(hex_fraction(F.md5(F.concat(F.lit(f"{seed}:{i}:"), text)))) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*draws)).getField("shard")


def shard_documents(docs: DataFrame, weights: list[float], grow_by: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its shard and its slot in that shard.

    Gives id_col, size (UTF-8 bytes of the text plus 8, so 8 for a null text), text_crc32 (unsigned; null for a null text),
    shard, slot and grown_shard (the shard if one more of weight grow_by joined, null without grow_by). The slots of a shard
    run from 0 without gaps, in the order of a hash of the id, so that a shard reads as a shuffle. Equal ids, as after
    mixing, share a shard and take one slot each; which of such rows takes which slot is decided by text_crc32 and size, and
    rows equal in all these are alike. Ids of null share the shard of the word null. Other columns are ignored; an
    empty table gives an empty result."""
    key = F.col(id_col)
    text = F.col(text_col).cast("string")
    thin = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).cast("int").alias("shard"),
        (rendezvous(key, [*weights, grow_by]) if grow_by else F.lit(None)).cast("int").alias("grown_shard"),
        F.md5(F.concat(F.lit("slot:"), F.coalesce(key.cast("string"), F.lit("null")))).alias("_order"),
    )
    out = ranked(stash(thin, "shards"), ["shard"], ["_order", id_col, "text_crc32", "size"], "slot")
    return out.select(id_col, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
