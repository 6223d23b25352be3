import math

from pyspark.sql import functions as F

from massloom.operators import grid, units

FEATURES = "feature_id long, study string, rt double, rt_unit string, rt_start double, rt_end double, remark string"
STUDY = "study string, run_seconds int, note string"
READINGS = "trace_id long, scan int, time double, time_unit string, spint double"
TRACE = "trace_id long, sample string, grid_seconds int, note string"


def settle(spark, rows, study=(("A", 600, None),)):
    out = units.feature_units(spark.createDataFrame(rows, FEATURES), spark.createDataFrame(list(study), STUDY))
    return {r["feature_id"]: r for r in out.collect()}


def test_declared_text_and_physics(spark):
    rows = [
        (1, "A", 300.123, "sec", 295.111, 310.222, None),
        (2, "A", 5.12345, "MIN", 5.01234, 5.31234, None),
        (3, "A", 290123.0, None, 280456.0, 301789.0, None),
        (4, "A", 5.23456, None, None, None, "retention reported as min; dwell 20 ms"),
        (5, "A", 3.81415, None, 3.71234, 3.91234, "tR = 3.81 min (apex)"),
        (6, "A", None, "s", None, None, None),
        (7, "A", float("nan"), "s", None, None, None),
        (8, "A", 0.1234567, "hr", None, None, None),
    ]
    got = settle(spark, rows)
    assert [got[i]["unit"] for i in range(1, 9)] == ["s", "min", "ms", "min", "min", None, None, "h"]
    assert got[2]["rt_sec"] == 307.407 and got[3]["rt_sec"] == 290.123 and got[6]["rt_sec"] is None
    assert got[2]["rt_start_sec"] == round(5.01234 * 60, 6)


def test_a_wrong_declaration_is_overruled(spark):
    note = "Careful: the list says seconds, the software wrote minutes."
    rows = [(i, "A", 3.12345 + i / 10, "s", 3.01234 + i / 10, 3.31234 + i / 10, None) for i in range(5)]
    assert {r["unit"] for r in settle(spark, rows, [("A", 600, note)]).values()} == {"min"}


def test_text_about_other_quantities_says_nothing(spark):
    texts = ["washed 90 s before", "held 15 min at 60 C, fine", "dwell 20 ms", "Autosampler purge of 55 s between vials.", "restarted after 4 min pause", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(units.unit_of_text(F.col("t")).alias("u"))
    assert [r["u"] for r in df.collect()] == [None] * len(texts)
    said = {"RT axis: minutes (vendor default).": "min", "tR[ms] in the feature list.": "ms", "x = s since injection": "s", "t[sec]": "s", "clock counts min": "min", "timestamps are milliseconds after start": "ms", "Retention columns are minutes, not seconds.": "min", "vendor trace, t[min]": "min"}
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", units.unit_of_text(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == said


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], FEATURES).withColumn("unit", F.lit("x"))
    out = units.feature_units(empty, spark.createDataFrame([], STUDY))
    assert out.count() == 0 and out.columns.count("unit") == 1
    r = spark.createDataFrame([], READINGS)
    assert units.trace_units(r, spark.createDataFrame([], TRACE)).count() == 0
    assert grid.regular(r, spark.createDataFrame([], TRACE)).count() == 0


def readings(spark, rows, step=2, note=None):
    return spark.createDataFrame(rows, READINGS), spark.createDataFrame([(1, "S", step, note)], TRACE)


def brute(points, step):
    """{period: (n, mean)} with gaps filled between neighbours."""
    by = {}
    for t, y in points:
        by.setdefault(math.floor(t / step), []).append((t, y))
    out = {k: ("observed", sum(y for _, y in v) / len(v)) for k, v in by.items()}
    ks = sorted(by)
    for a, b in zip(ks, ks[1:]):
        t1, y1 = max(by[a])
        t2, y2 = min(by[b])
        for k in range(a + 1, b):
            mid = (k + 0.5) * step
            near = t2 - t1 <= 5 * step
            out[k] = ("interpolated", y1 + (y2 - y1) * (mid - t1) / (t2 - t1)) if near else ("missing", None)
    return out


def test_grid_equals_brute_force(spark):
    pts = [(10.105, 5.0), (11.353, 7.0), (12.807, 1.0), (19.311, 9.0), (20.119, 4.0), (50.421, 3.0), (51.733, 2.0)]
    rows = [(1, i, t, "s", y) for i, (t, y) in enumerate(pts)]
    rows += [rows[2], (1, 90, None, "s", 4.0), (1, 91, 30.111, "s", None), (1, 92, 32.111, "s", float("nan")), (1, 93, 33.111, "s", -1.0)]
    r, t = readings(spark, rows)
    got = {x["period_no"]: (x["state"], x["value"]) for x in grid.regular(r, t).collect()}
    want = brute(pts, 2)
    assert got.keys() == want.keys()
    for k, (state, value) in want.items():
        assert got[k][0] == state and (got[k][1] is None) == (value is None) and (value is None or abs(got[k][1] - value) < 1e-9)
    assert {x["period_no"] for x in grid.found(grid.regular(r, t)).collect()} == {k for k, v in want.items() if v[0] != "observed"}


def test_units_that_change_on_the_way(spark):
    secs = [(1, i, round(100.101 + i * 1.217, 3), "s", 1.0) for i in range(30)]
    mins = [(1, 30 + i, round((100.101 + (30 + i) * 1.217) / 60, 5), "min", 1.0) for i in range(30)]
    r, t = readings(spark, secs + mins)
    u = {x["class"]: x["unit"] for x in units.trace_units(r, t).collect()}
    assert u["s|3"] == "s" and u["min|5"] == "min"
    assert grid.found(grid.regular(r, t)).count() == 0


def test_long_gaps_cross_blocks(spark):
    last = 2 * grid.PERIOD_BLOCK * 3 + 1.5
    r, t = readings(spark, [(1, 0, 10.123, "s", 1.0), (1, 1, 11.432, "s", 1.0), (1, 2, last, "s", 1.0), (1, None, last + 0.125, "s", 1.0)])
    out = grid.regular(r, t)
    n = math.floor(last / 2) - 5 - 1
    assert grid.found(out).count() == n and out.filter("state = 'missing'").agg(F.countDistinct("period_no")).first()[0] == n


def test_few_readings_in_another_unit(spark):
    """A tenth of the readings, undeclared, in another unit; lost zeros stay with their trace's unit."""
    at = [20.017 + i * 1.213 for i in range(200)]
    rows = [(1, i, round(t, 3) if 90 <= i < 110 else round(t / 60, 5), None, 1.0) for i, t in enumerate(at)]
    r, t = readings(spark, rows)
    u = {x["class"]: (x["unit"], x["unit_unique"]) for x in units.trace_units(r, t).collect()}
    assert u["?|5"] == ("min", True) and u["?|3"][0] == "s"
    r, t = readings(spark, rows[:90] + rows[110:])
    u = {x["class"]: x["unit"] for x in units.trace_units(r, t).collect()}
    assert set(u.values()) == {"min"}


def test_declared_seconds_off_the_clock(spark):
    """Readings declared in seconds that lie on the clock of the others' minutes are minutes."""
    at = [30.017 + i * 1.213 for i in range(300)]
    r, t = readings(spark, [(1, i, round(x / 60, 5), "s" if 100 <= i < 120 else "min", 1.0) for i, x in enumerate(at)])
    assert {x["unit"] for x in units.trace_units(r, t).collect()} == {"min"}


def test_a_filter_on_seconds_leaves_the_costs_alone(spark):
    """What chose the unit isn't planned again for each use of the result (p1_found took too much of the driver's memory)."""
    out = units.feature_units(spark.createDataFrame([(1, "A", 5.12345, "MIN", 5.01234, 5.31234, None)], FEATURES), spark.createDataFrame([("A", 600, None)], STUDY))
    out = out.filter(units.is_number(F.col("rt_sec")) & (F.col("unit") != "s"))
    assert "_cost_" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["rt_sec"] for r in out.collect()] == [307.407]


def test_units_that_change_within_a_class(spark):
    """Undeclared and with as many decimals before and after, so that only the clock tells the units apart."""
    at = [20.017 + i * 1.213 for i in range(200)]
    write = {"s": lambda x: round(x, 3), "min": lambda x: round(x / 60, 3), "ms": lambda x: round(x * 1000, 3)}
    changes = [("s", "min", 100, 200), ("min", "s", 100, 200), ("s", "min", 90, 110), ("ms", "min", 30, 200), ("min", "ms", 5, 200), ("min", "s", 62, 200), ("min", "s", 63, 64), ("s", "min", 0, 30)]
    rows = [(k, i, write[b if lo <= i < hi else a](x), None, 1.0) for k, (a, b, lo, hi) in enumerate(changes) for i, x in enumerate(at)]
    r, t = spark.createDataFrame(rows, READINGS), spark.createDataFrame([(k, "S", 2, None) for k in range(len(changes))], TRACE)
    got = {}
    for x in units.trace_units(r, t).collect():
        got[x["trace_id"], x["unit"]] = got.get((x["trace_id"], x["unit"]), 0) + x["n"]
    assert got == {(k, u): n for k, (a, b, lo, hi) in enumerate(changes) for u, n in ((a, 200 - hi + lo), (b, hi - lo))}
    empty = spark.createDataFrame([], FEATURES)
    assert {x["record_id"] for x in units.found(units.feature_units(empty, spark.createDataFrame([], STUDY)), units.trace_units(r, t)).collect()} == set(range(len(changes)))
    off = {(x["trace_id"], x["scan"]): x["t"] for x in grid.readings_in_seconds(r, t).withColumnRenamed("_block", "b").collect()}
    assert len(off) == len(rows) and all(abs(off[k, i] - x) < 0.04 for k in range(len(changes)) for i, x in enumerate(at))


def test_gaps_are_no_other_clock(spark):
    """A trace that pauses for long, or starts at once, keeps its one unit; so do the few numbers with fewer decimals."""
    pause = lambda n, m: [1.017 + i * 1.213 for i in range(n)] + [1900.017 + i * 1.213 for i in range(m)]
    traces = [pause(20, 200), pause(2, 1), pause(5, 2), pause(200, 1)]
    rows = [(10 * k + f, i, round(x / f, 3), None, 1.0) for k, at in enumerate(traces) for f in (1, 60) for i, x in enumerate(at)]
    # whole numbers from 0 on, scans from -1 on
    rows += [(99, i - 1, i, None, 1.0) for i in range(300)]
    r, t = spark.createDataFrame([(a, b, float(c), d, e) for a, b, c, d, e in rows], READINGS), spark.createDataFrame([(k, "S", 2, None) for k in {x[0] for x in rows}], TRACE)
    assert {x["count"] for x in units.trace_units(r, t).groupBy("trace_id", "class").count().collect()} == {1}


def test_every_reading_comes_out_in_seconds(spark):
    """Also those without a usable intensity, of a trace without a step or without a row, and beyond one block of scans."""
    nan, at = float("nan"), [20.017 + i * 1.213 for i in range(100)]
    rows = [(k, i + 20000 * (k == 2), round(x / 60, 5), "min", (1.0, None, nan, -1.0)[i % 4]) for k in (1, 2, 3) for i, x in enumerate(at)] + [(1, 200, None, "min", 1.0), (1, 201, nan, "min", 1.0), (None, 1, 1.5, "min", 1.0), (4, None, 2.5, "min", 1.0)]
    out = grid.times_in_seconds(spark.createDataFrame(rows, READINGS), spark.createDataFrame([(1, "S", 2, None), (2, "S", None, None)], TRACE)).collect()
    assert len(out) == len(rows)
    got = {(x["trace_id"], x["scan"]): x["time_sec"] for x in out}
    assert all(abs(got[k, i + 20000 * (k == 2)] - x) < 0.001 for k in (1, 2, 3) for i, x in enumerate(at))
    assert got[1, 200] is None and got[1, 201] is None and got[None, 1] is None and got[4, None] == 150.0
