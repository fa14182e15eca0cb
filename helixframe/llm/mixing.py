"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; each of its documents expects target / source size copies. The expected copies
are summed along the source's documents, shifted by one random offset per source, and a document is emitted once for each
whole number that the running sum crosses. Documents stand in the order of their sizes, so the words taken follow the
target far closer than independent draws would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hex_fraction, ranked, stash, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """sources: source, source_size. Adds target and expected (copies of each of the source's documents).

    The sources, by code point and null last, get the weights in turn, and share budget x the sum of all sizes by weight. A
    target stops at cap x its source's size; what is over is shared again by weight among the rest, until none is above.
    Without words anywhere every target is 0."""
    named = sources.withColumn("_null", F.col("source").isNull()).withColumn("_all", F.lit(0))
    at = ranked(named, ["_all"], ["_null", "source"], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    at = stash(at.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("limit")), "sources")
    total = (at.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level, full = 0.0, -1
    while True:  # each turn fills at least one more source to its limit, or ends
        over = F.col("limit") <= F.col("weight") * F.lit(level)
        n, held, rest = at.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, max(level, (total - (held or 0.0)) / rest)
    target = F.least(F.col("limit"), F.col("weight") * F.lit(level)) if rest else F.col("limit")
    expected = F.when(F.col("source_size") > 0, F.when(target >= F.col("limit"), F.lit(float(cap))).otherwise(target / F.col("source_size"))).otherwise(0.0)
    return at.select("source", "source_size", target.cast("double").alias("target"), expected.alias("expected"))


def mix(docs: DataFrame, weights: list[float], budget: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: id_col, size, source, source_size, target, copies and taken (copies x size).

    Sizes are words; a null or blank text has size 0 and is taken as often as its rank says, adding nothing. A null source is
    a source of its own. Copies of a document are at most ceil(cap). The order within a source is size, a hash of the id,
    the id and row_col, a column that numbers the rows and is handed through, if there is one; rows equal in these are alike.
    Reruns agree: the offset of a source comes from the seed and its name. Other columns are ignored; an empty table gives an
    empty result."""
    text_key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    extra = [row_col] if row_col else []
    thin = docs.select(F.col(id_col), *extra, word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), F.md5(F.concat(F.lit(f"{seed}:"), text_key)).alias("_order"))
    thin = stash(thin, "sizes")
    plan = stash(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap), "targets")
    at = ranked(thin, ["source"], ["size", "_order", id_col, *extra], "_place")
    plan = plan.withColumnRenamed("source", "_source")
    out = at.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    # an offset in 2**20 equal steps: whole numbers of copies stay exact
    shift = F.floor(hex_fraction(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string")))) * 2.0**20) / 2.0**20
    upto = lambda n: F.floor(n * F.col("expected") + shift)
    copies = (upto(F.col("_place") + 1) - upto(F.col("_place"))).cast("long")
    return out.withColumn("copies", copies).select(id_col, *extra, "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with each row repeated as the plan of mix() says. id_col must tell the rows apart, as a number of the rows does. The
    columns stay those of docs."""
    key, copies, copy = (unused(docs, c) for c in ("_mixed", "_copies", "_copy"))
    taken = stash(plan.select(F.col(id_col).alias(key), F.col("copies").cast("int").alias(copies)).where(F.col(copies) > 0), "plan")
    rows = docs.join(bounded(taken), F.col(id_col).eqNullSafe(F.col(key))).select(*docs.columns, copies)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
