"""What several operators need to stay whole at any size: checked broadcasts, ranks and running sums without a one-task sort, and
connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import stash, unstash

#: Tables are broadcast up to so many rows and written bytes; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if it has at most `rows` rows and BROADCAST_BYTES bytes. df should be a written table, since it
    is counted and its size is that of its files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df


def _laid(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """df written in the order of group and order, with each row's place (_at) and partition (_pid). A range sort deals the rows
    evenly, however many of them one group holds."""
    by = [*[F.col(c).asc() for c in group], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return stash(rows.withColumn("_at", F.monotonically_increasing_id()), "laid").withColumn("_pid", F.shiftright("_at", 33))


def _before(sizes: DataFrame, group: list[str], column: str) -> DataFrame:
    """What the partitions before hold of a group: sizes has a row for each partition and group."""
    upto = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(f"{column}_before", F.coalesce(F.sum(column).over(upto), F.lit(0)))


def _beside(rows: DataFrame, sizes: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    right = bounded(sizes).select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *columns)
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(right, on)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row in its group by `order`, whose last column should be unique. Null groups count as one
    group. The rows come back as a written table."""
    laid = _laid(df, group, [F.col(c).asc() for c in order])
    sizes = laid.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = stash(_before(stash(sizes, "sizes"), group, "_n"), "sizes")
    out = _beside(laid, sizes, group, ["_first", "_n_before"])
    return out.withColumn(name, F.col("_n_before") + F.col("_at") - F.col("_first")).select(*df.columns, name)


def running(df: DataFrame, order: list, sums: dict[str, str], group: tuple[str, ...] = ()) -> DataFrame:
    """df with running sums (new name -> column) in each group along `order`, columns with their direction. Only a partition's rows
    are summed in one task; the sums of the partitions before come from a small table."""
    group = list(group)
    laid = _laid(df, group, order)
    totals = stash(laid.groupBy("_pid", *group).agg(*[F.sum(c).alias(f"{n}_") for n, c in sums.items()]), "totals")
    for n in sums:
        totals = _before(totals, group, f"{n}_")
    within = Window.partitionBy("_pid", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = _beside(laid, stash(totals, "totals"), group, [f"{n}__before" for n in sums])
    return out.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"{n}__before")).alias(n) for n, c in sums.items()])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge (longs a, b): component is the smallest id that it is connected with. Large and
    small stars alternate: joins and minima on edge tables that are written between the rounds; two sums of each round reach the
    driver. The minima are broadcast up to BROADCAST_ROWS edges; beyond, a hub's edges meet a written table of minima, in
    joins that adaptive execution can split."""

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if last[0] <= BROADCAST_ROWS else stash(df, "low")

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stash(e.distinct(), "edges")
    last = digest(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if last[0] <= BROADCAST_ROWS else stash(large, "large")
        low = near(large.groupBy("u").agg(F.min("v").alias("m")))
        made = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(made).alias("p")).select("p.*").where("u <> v").distinct()
        before, e = e, stash(small.coalesce(1 + last[0] // 250_000) if last[0] <= BROADCAST_ROWS else small, "edges")
        unstash(before)
        if (now := digest(e)) == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("component")))
