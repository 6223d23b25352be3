"""Connected components of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import cut, small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), component being the smallest node of its component.

    Only nodes with an edge appear; loops and repeated edges do no harm, null ends are
    dropped. Each round hangs nodes on their smallest known neighbour, through
    aggregations with a partial step before each shuffle, so a node of very many edges
    isn't gathered anywhere. The number of rounds grows with the logarithm of a
    component's diameter. Each round is written to the shared checkpoint folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour goes to the smallest one
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # every node and its smaller neighbours go to the smallest one
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def islands(df: DataFrame, keys: list[str], value: str, gap: float, out: str, blocks: float) -> DataFrame:
    """Numbers runs of ``value`` whose neighbours are at most ``gap`` apart, for each of ``keys``.

    ``out`` is the smallest value of the run, which names it. Runs are found inside
    blocks of width ``blocks`` and stitched where a block's last and the next block's
    first value touch, with two rows for each block, so no order over all rows is needed.
    They are found over distinct values, so one value may be that of any number of rows.
    A null value belongs to no run.
    """
    values = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    b = values.withColumn("_b", F.floor(F.col(value) / blocks))
    w = Window.partitionBy(*keys, "_b").orderBy(value)
    started = b.withColumn("_new", F.when(F.col(value) - F.lag(value).over(w) <= gap, None).otherwise(F.col(value)))
    started = started.withColumn("_run", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = started.groupBy(*keys, "_b").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.min("_run").alias("_first"), F.max("_run").alias("_lastrun"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    # a block that is one run from end to end passes the name of the run before it on
    joined = F.col("_lo") - F.lag("_hi").over(wk) <= gap
    ends = ends.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    ends = ends.withColumn("_origin", F.when(~F.col("_joined") | (F.col("_lastrun") > F.col("_first")), F.col("_lastrun")))
    ends = ends.withColumn("_before", F.last("_origin", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)))
    name = ends.filter("_joined").select(*keys, "_b", F.col("_first"), "_before")
    named = started.alias("s").join(name.alias("n"), _same(keys) & (F.col("s._b") == F.col("n._b")) & (F.col("s._run") == F.col("n._first")), "left")
    named = named.select(*[F.col(f"s.{c}").alias(c) for c in (*keys, value)], F.coalesce("n._before", "s._run").alias(out))
    full = df.alias("s").join(named.alias("n"), _same(keys) & (F.col(f"s.{value}") == F.col(f"n.{value}")), "left")
    return full.select(*[F.col(f"s.{c}").alias(c) for c in df.columns], F.col(f"n.{out}").alias(out))


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    return cond


def positions(table: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    """Adds position: in the order of ``by``, from 0, how many rows (or how much of ``size``) come before each.

    Rows are sorted by range, and each partition's start is the sum of those before it,
    so that no task sees all rows.
    """
    amount = F.col(size) if size else F.lit(1)
    parts = cut(table.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("_n"))
    # a row for each partition
    start = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(small(cut(start)), "_part").withColumn("position", (F.col("_own") + F.col("_start")).cast("bigint")).drop("_part", "_own", "_start")
