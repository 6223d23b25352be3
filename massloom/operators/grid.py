"""Irregular readings onto a regular grid, by an as-of merge of grid and readings.

Every source gets one row for each period of its own step. A period that holds
readings takes their mean; one that holds none takes the neighbours on both sides,
the last reading before and the first one after it, and interpolates linearly in
time between them, unless they lie further apart than the gap limit: then it is
marked as missing.

Nothing is ever gathered by source. Readings are keyed by source and block of scans,
periods by source and block of periods, and what crosses a block's edge is carried by
one row for each block, so a source with a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import units

SCAN_BLOCK = 8192
PERIOD_BLOCK = 2048


def _factors(readings: DataFrame, trace: DataFrame) -> DataFrame:
    """(trace_id, _last, _factors): the last scan, and seconds by class or, where it holds several clocks, by its places."""
    parts = units.trace_parts(readings, trace).withColumn("_place", F.explode_outer("places")).withColumn("_key", F.concat_ws("|", "class", F.col("_place").cast("string")))
    return parts.groupBy("trace_id").agg(F.max("last_scan").alias("_last"), F.map_from_entries(F.collect_list(F.struct(F.col("_key"), units.factor(F.col("unit"))))).alias("_factors"))


def _block() -> Column:
    return F.coalesce(F.greatest(F.floor(F.col("scan") / SCAN_BLOCK), F.lit(-1).cast("long")), F.lit(-1).cast("long"))


def _by_block(about: DataFrame) -> DataFrame:
    """A row for each block of scans of a trace."""
    return about.withColumn("_block", F.explode(F.sequence(F.lit(-1).cast("long"), F.coalesce(F.floor(F.col("_last") / SCAN_BLOCK), F.lit(-1).cast("long")))))


def _seconds() -> Column:
    place = F.concat_ws("|", "_class", units.reading_place(F.col("scan"), F.col("time")).cast("string"))
    return F.round(F.col("time") * F.coalesce(F.try_element_at("_factors", F.col("_class")), F.try_element_at("_factors", place)), 6)


def times_in_seconds(readings: DataFrame, trace: DataFrame) -> DataFrame:
    """Every row of ``readings``: (trace_id, scan, time, time_sec), whatever its intensity and its trace's step.

    time_sec is NULL for a time that isn't a finite number.
    """
    r = readings.select("trace_id", "scan", "time", "time_unit").withColumn("_block", _block())
    r = r.join(_by_block(_factors(readings, trace)), ["trace_id", "_block"], "left").withColumn("_class", units.reading_class(F.col("time"), F.col("time_unit")))
    return r.select("trace_id", "scan", "time", F.when(units.is_number(F.col("time")), _seconds()).alias("time_sec"))


def readings_in_seconds(readings: DataFrame, trace: DataFrame) -> DataFrame:
    """Usable readings: (trace_id, _block, scan, grid_seconds, t, y), t in seconds.

    Usable are readings with a finite time and a finite intensity of at least 0; traces
    without a step above 0 have no grid. A reading without a scan number, or with one below 0, is in block -1.
    """
    unit = _factors(readings, trace)
    step = trace.groupBy("trace_id").agg(F.max("grid_seconds").cast("long").alias("grid_seconds")).filter("grid_seconds > 0")
    about = _by_block(unit.join(step, "trace_id"))
    r = readings.filter(units.is_number(F.col("time")) & units.is_number(F.col("spint")) & (F.col("spint") >= 0)).select("trace_id", "scan", "time", "time_unit", "spint")
    r = r.withColumn("_block", _block())
    return (
        r.join(about, ["trace_id", "_block"])
        .withColumn("_class", units.reading_class(F.col("time"), F.col("time_unit")))
        .withColumn("t", _seconds())
        .select("trace_id", "_block", "scan", "grid_seconds", "t", F.col("spint").alias("y"))
    )


def occupied(readings: DataFrame) -> DataFrame:
    """One row for each period with readings: n, sums and the outermost readings."""
    k = F.floor(F.col("t") / F.col("grid_seconds"))
    # a reading occurs once however often its row is repeated; all copies share block and scan
    once = readings.groupBy("trace_id", "_block", "scan", "t", "y").agg(F.first("grid_seconds").alias("grid_seconds"))
    return (
        once.withColumn("period_no", k)
        .groupBy("trace_id", "grid_seconds", "period_no")
        # the outermost readings are carried once each: that is most of what is shuffled here
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.min(F.struct("t", "y")).alias("_lo"), F.max(F.struct("t", "y")).alias("_hi"))
        .select("trace_id", "grid_seconds", "period_no", "n", "total", F.col("_lo.t").alias("t0"), F.col("_lo.y").alias("y0"), F.col("_hi.t").alias("t1"), F.col("_hi.y").alias("y1"))
    )


def with_next(periods: DataFrame) -> DataFrame:
    """Adds next_no, next_t and next_y, the first reading of the next occupied period of the source.

    Within a block by a window; the last row of each block takes them from the next
    block's first row, of which there is one for each block.
    """
    p = periods.withColumn("_block", F.floor(F.col("period_no") / PERIOD_BLOCK))
    w = Window.partitionBy("trace_id", "_block").orderBy("period_no")
    after = F.struct(F.col("period_no").alias("no"), F.col("t0").alias("t"), F.col("y0").alias("y"))
    inner = p.withColumn("_next", F.lead(after).over(w))
    heads = p.groupBy("trace_id", "_block").agg(F.min(after).alias("_head"))
    edge = heads.select("trace_id", "_block", F.lead("_head").over(Window.partitionBy("trace_id").orderBy("_block")).alias("_edge")).filter("_edge is not null")
    full = inner.join(edge, ["trace_id", "_block"], "left").withColumn("_next", F.coalesce("_next", "_edge"))
    return full.select(*periods.columns, F.col("_next.no").alias("next_no"), F.col("_next.t").alias("next_t"), F.col("_next.y").alias("next_y"))


def _runs(first: Column, last: Column) -> Column:
    """Numbers from first to last in runs of at most a block, so that no array grows with the gap."""
    return F.sequence(F.lit(0).cast("long"), F.floor((last - first) / PERIOD_BLOCK))


def regular(readings: DataFrame, trace: DataFrame, max_gap_periods: float = 5.0) -> DataFrame:
    """The regular series: (trace_id, period_no, t_sec, n_readings, value, state).

    state is 'observed', 'interpolated' or 'missing'; t_sec is the period's beginning.
    The series runs from the period of the source's first usable reading to that of its
    last. An empty period is interpolated at its middle if its neighbouring readings are
    at most ``max_gap_periods`` steps apart, else its value is null. Sources without a
    usable reading, and empty tables, give no rows. Two readings at one time count both.
    """
    p = with_next(occupied(readings_in_seconds(readings, trace)))
    g = F.col("grid_seconds")
    observed = p.select("trace_id", "period_no", (F.col("period_no") * g).cast("double").alias("t_sec"), F.col("n").alias("n_readings"), (F.col("total") / F.col("n")).alias("value"), F.lit("observed").alias("state"))
    gaps = p.filter(F.col("next_no") > F.col("period_no") + 1)
    runs = gaps.withColumn("_a", F.col("period_no") + 1).withColumn("_run", F.explode(_runs(F.col("_a"), F.col("next_no") - 1)))
    lo = F.col("_a") + F.col("_run") * PERIOD_BLOCK
    empty = runs.withColumn("_k", F.explode(F.sequence(lo, F.least(lo + PERIOD_BLOCK - 1, F.col("next_no") - 1))))
    mid = (F.col("_k") + 0.5) * g
    near = (F.col("next_t") - F.col("t1")) <= max_gap_periods * g
    line = F.col("y1") + (F.col("next_y") - F.col("y1")) * (mid - F.col("t1")) / (F.col("next_t") - F.col("t1"))
    filled = empty.select(
        "trace_id", F.col("_k").alias("period_no"), (F.col("_k") * g).cast("double").alias("t_sec"), F.lit(0).cast("long").alias("n_readings"), F.when(near, line).alias("value"), F.when(near, F.lit("interpolated")).otherwise(F.lit("missing")).alias("state")
    )
    return observed.unionByName(filled)


def found(series: DataFrame) -> DataFrame:
    """The empty periods: (trace_id, period_no)."""
    return series.filter(F.col("state") != "observed").select(F.col("trace_id").cast("bigint").alias("trace_id"), F.col("period_no").cast("bigint").alias("period_no"))
