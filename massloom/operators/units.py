"""Quantities written in different units: bring retention and reading times to seconds.

Units of all columns are chosen together, among s, min, ms and h, as the combination with
the smallest sum of squared log residuals of physical identities between the columns:

* span:   value * unit lies between the dead time and the planned length of the run
* width:  (end - start) * unit = a chromatographic peak's width
* step:   (time per reading) * unit = the wanted grid's order of magnitude
* clock:  readings of one trace lie on one clock: time * unit of some of them = the time
  that the others' clock shows at their scan numbers
* text:   value * unit = number * unit quoted in free text
* claims: the unit field, a sentence about the axis in the row's own text and one in
  the text of its study each add a penalty to the units that they do not name

A declared unit is one claim among others, so one that breaks the identities is
overruled. The margin to the second best unit tells how firm the choice is; below
``UNIQUE_MARGIN`` the row is flagged as having no unique solution.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.session import cut

#: seconds of each candidate unit
UNITS = {"s": 1.0, "min": 60.0, "ms": 0.001, "h": 3600.0}
UNIQUE_MARGIN = 2.0
#: features chosen with this margin vote for the unit of their study's other features
FIRM_MARGIN = 8.0
DEAD_TIME_S = 5.0
PEAK_WIDTH_S = 20.0
#: readings off the clock of the others by this factor have a residual of one
CLOCK_FACTOR = 2.0
#: units are at least sixty apart: on one clock, no time falls by FALL as scans rise, or leaps by LEAP with steps as
#: many times as long, give or take the factor SLACK
FALL, LEAP, SLACK = 4.0, 50.0, 8.0

#: fixed values: spellings of the units
SPELLED = {
    "s": r"s|sec|secs|second|seconds|sek|sekunden",
    "min": r"min|mins|minute|minutes|minuten",
    "ms": r"ms|msec|msecs|millisec|millisecs|millisecond|milliseconds",
    "h": r"h|hr|hrs|hour|hours|std",
}
#: what free text says about the axis itself, before or after the unit
_AXIS_BEFORE = r"(?:axis|timestamps|clock|\bx\b|\bt\b|\btr\b|\brt\b|r\.\s?t\.|retention|software wrote)[^.;0-9]*?[\s\[(:=]"
_AXIS_AFTER = r"[\s\])]*(?:after (?:injection|start)|since injection)"
_QUOTED = r"(?:tr\s*=|\brt\s*=|eluted (?:after|at)|apex at)\s*([0-9]+(?:\.[0-9]+)?(?:e[0-9]+)?)\s*"


def unit_of_spelling(c: Column) -> Column:
    """Candidate unit named by a unit field; NULL for none or an unknown word."""
    word = F.regexp_replace(F.lower(F.trim(c)), r"[.\[\]() ]", "")
    out = F.lit(None).cast("string")
    for unit, names in SPELLED.items():
        out = F.when(word.rlike(f"^(?:{names})$"), F.lit(unit)).otherwise(out)
    return out


def unit_of_text(c: Column) -> Column:
    """Unit that free text states for the time axis; NULL when it states none.

    A unit after a number (a dwell of 20 ms, held 15 min) is a quantity of its own
    and says nothing about the axis. 'minutes, not seconds' and 'says seconds, the
    software wrote minutes' mean what they say.
    """
    text = F.lower(c)
    # the denied part says nothing, and a quantity is not a claim
    text = F.regexp_replace(text, r"not (?:in )?[a-z]+|the list says [a-z]+,?", " ")
    text = F.regexp_replace(text, r"[0-9.]+\s*(?:milliseconds?|msec|ms|seconds?|sec|s|minutes?|mins?|hours?|hr|h|c|ul|µl)\b", " ")
    out = F.lit(None).cast("string")
    for unit in ("s", "h", "min", "ms"):
        names = SPELLED[unit]
        says = rf"{_AXIS_BEFORE}(?:{names})(?![a-z])|(?<![a-z0-9])(?:{names}){_AXIS_AFTER}"
        out = F.when(text.rlike(says), F.lit(unit)).otherwise(out)
    return out


def is_number(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _sq_log(ratio: Column, sigma: float) -> Column:
    return F.when(ratio > 0, F.pow(F.log(ratio) / math.log(sigma), F.lit(2.0)))


def _claim(claimed: Column, unit: str, cost: float) -> Column:
    return F.when(claimed.isNotNull() & (claimed != unit), F.lit(cost))


def best_unit(df: DataFrame, costs: dict[str, list[Column]]) -> DataFrame:
    """Adds unit, unit_margin and unit_unique, and each unit's sum of costs as _cost_<unit>."""
    for u, cs in costs.items():
        df = df.withColumn(f"_cost_{u}", reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs]).cast("double"))
    # plain comparisons of numbers: a sort of structs would be run again for each use of the unit
    c = [F.col(f"_cost_{u}") for u in costs]
    pairs = [(F.least(x, y), F.greatest(x, y)) for x, y in zip(c[::2], c[1::2])]
    (lo, hi), (lo2, hi2) = pairs
    df = df.withColumn("_least", F.least(lo, lo2)).withColumn("_next", F.least(F.greatest(lo, lo2), hi, hi2))
    unit = F.lit(None).cast("string")
    for u in reversed(list(costs)):
        unit = F.when(F.col(f"_cost_{u}") == F.col("_least"), F.lit(u)).otherwise(unit)
    margin = F.col("_next") - F.col("_least")
    return df.withColumn("unit", unit).withColumn("unit_margin", margin).withColumn("unit_unique", margin >= UNIQUE_MARGIN).drop("_least", "_next")


def factor(unit: Column) -> Column:
    """Seconds of a unit's name."""
    out = F.lit(None).cast("double")
    for u, s in UNITS.items():
        out = F.when(unit == u, F.lit(s)).otherwise(out)
    return out


def to_seconds(value: Column, unit: Column) -> Column:
    """value * unit, rounded to a microsecond so that 0.1 min is 6 s exactly."""
    return F.round(value * factor(unit), 6)


def _written(c: Column) -> Column:
    """0, 3, 5 or 7: so many decimals are enough to write the value."""
    one = lambda k: F.abs(c * float(10**k) - F.rint(c * float(10**k))) <= 1e-5 + F.abs(c) * 10.0 ** (k - 12)
    return F.when(one(0), 0).when(one(3), 3).when(one(5), 5).otherwise(7)


def feature_units(features: DataFrame, study: DataFrame) -> DataFrame:
    """Retention of features in seconds.

    ``features`` has feature_id, study, rt, rt_unit, rt_start, rt_end and remark;
    ``study`` has study, run_seconds and note. Returns every row of ``features`` with
    rt_declared, unit, unit_margin, unit_unique, rt_sec, rt_start_sec and rt_end_sec.
    A feature with a null, NaN or infinite rt gets a null unit and null seconds. A
    study that is unknown, or lacks a length, sets no upper limit. Columns that the
    result would overwrite are dropped from the input first.
    """
    made = ["rt_declared", "unit", "unit_margin", "unit_unique", "rt_sec", "rt_start_sec", "rt_end_sec"]
    base = features.drop(*made)
    known = study.groupBy("study").agg(F.max("run_seconds").alias("_run"), F.max(unit_of_text(F.col("note"))).alias("_note")).filter(F.col("study").isNotNull())
    quoted = F.regexp_extract(F.lower("remark"), _QUOTED + r"(millisec[a-z]*|msec|ms|seconds?|sec|s|minutes?|mins?|hours?|h)\b", 1)
    quoted_unit = unit_of_spelling(F.regexp_extract(F.lower("remark"), _QUOTED + r"(millisec[a-z]*|msec|ms|seconds?|sec|s|minutes?|mins?|hours?|h)\b", 2))
    df = (
        base.join(known, "study", "left")
        .withColumn("rt_declared", unit_of_spelling(F.col("rt_unit")))
        .withColumn("_said", unit_of_text(F.col("remark")))
        .withColumn("_quoted_s", quoted.try_cast("double") * factor(quoted_unit))
        .withColumn("_rt", F.when(is_number(F.col("rt")) & (F.col("rt") > 0), F.col("rt")))
        .withColumn("_w", F.when(is_number(F.col("rt_start")) & is_number(F.col("rt_end")) & (F.col("rt_end") > F.col("rt_start")), F.col("rt_end") - F.col("rt_start")))
    )
    own = {
        u: [
            _claim(F.col("rt_declared"), u, 11.0),
            _claim(F.col("_said"), u, 12.0),
            _claim(F.col("_note"), u, 12.0),
            F.when(F.col("_quoted_s").isNotNull(), F.least(_sq_log(F.col("_rt") * s / F.col("_quoted_s"), 1.1), F.lit(16.0))),
            F.when(F.col("_rt") * s > F.col("_run") * 1.02, F.lit(30.0)),
            F.when(F.col("_rt") * s < DEAD_TIME_S, F.lit(20.0)),
            _sq_log(F.col("_w") * s / PEAK_WIDTH_S, 3.0),
        ]
        for u, s in UNITS.items()
    }
    # written once: the patterns run once, and no later filter drags these expressions along
    first = cut(best_unit(df, own))
    # what the firmly settled features of the same export were written in, those of as many decimals first
    firm = F.col("_rt").isNotNull() & (F.col("unit_margin") >= FIRM_MARGIN)
    counts = [F.sum(f"_n_{u}").alias(f"_n_{u}") for u in UNITS]
    alike = first.filter(firm).groupBy("study", _written(F.col("_rt")).alias("_dec")).agg(*[F.count_if(F.col("unit") == u).alias(f"_n_{u}") for u in UNITS])
    votes = alike.groupBy("study").agg(*counts)
    second = first.withColumn("_dec", _written(F.col("_rt"))).join(votes, "study", "left").join(alike.withColumnsRenamed({f"_n_{u}": f"_k_{u}" for u in UNITS}), ["study", "_dec"], "left")
    n, k = (reduce(lambda a, b: a + b, [F.coalesce(f"{c}_{u}", F.lit(0)) for u in UNITS]) for c in ("_n", "_k"))
    of_study = {u: (F.coalesce(f"_n_{u}", F.lit(0)) + 0.2) / (n + 0.8) for u in UNITS}
    share = {u: -2.0 * F.log((F.coalesce(f"_k_{u}", F.lit(0)) + 0.8 * of_study[u]) / (k + 0.8)) for u in UNITS}
    out = best_unit(second, {u: [F.col(f"_cost_{u}"), share[u]] for u in UNITS})
    has = is_number(F.col("rt"))
    out = out.withColumn("unit", F.when(has, F.col("unit"))).withColumn("unit_margin", F.when(has, F.col("unit_margin"))).withColumn("unit_unique", F.when(has, F.col("unit_unique")))
    for c in ("rt", "rt_start", "rt_end"):
        out = out.withColumn(f"{c}_sec", F.when(is_number(F.col(c)), to_seconds(F.col(c), F.col("unit"))))
    # written once: a filter on unit or seconds would be planned with all of the costs put in for each use of them
    return cut(out.select(*base.columns, *made))


def reading_class(time: Column, time_unit: Column) -> Column:
    """Readings of one trace with the same class share one unit, if they lie on one clock: declared unit and decimals.

    Traces may change their unit on the way, so a trace alone is too coarse a group. The
    decimals only tell readings apart; which unit they mean is left to the identities.
    """
    return F.concat_ws("|", F.coalesce(unit_of_spelling(time_unit), F.lit("?")), _written(time).cast("string"))


def reading_place(scan: Column, time: Column) -> Column:
    """Where a reading lies, to a factor of four in its scan and in its time; units are sixty apart."""
    fours = lambda c, none: F.coalesce(F.floor(F.log(c) / math.log(4.0)), F.lit(none)).cast("int")
    return (fours(scan.cast("double") + 1.0, -1) + 1) * 2000 + fours(time, -999) + 1000


def _mixed(places: Column) -> Column:
    """Whether one of a class's places, in the order of their scans, isn't on the clock of those before it; see ``clocks``."""

    def apart(b: Column, i: Column) -> Column:
        a, z = F.get(places, i - 1), F.get(places, i - 2)
        rate = lambda p: F.nullif((p["_t1"] - p["_t0"]) / F.nullif(p["_s1"] - p["_s0"], F.lit(0)), F.lit(0.0))
        to_a = F.coalesce(rate(a), (a["_mt"] - z["_mt"]) / F.nullif(a["_ms"] - z["_ms"], F.lit(0.0)))
        steps = lambda of: F.coalesce(rate(b) / F.nullif(of, F.lit(0.0)), F.lit(0.0))
        leap = lambda p: b["_t0"] / F.nullif(p["_t1"], F.lit(0.0))
        leaps = lambda p, of: (leap(p) > LEAP) & steps(of).between(leap(p) / SLACK, leap(p) * SLACK)
        known = lambda p: p["_ms"].isNotNull() & (p["_t0"] > 0) & (b["_t0"] > 0)
        falls = (b["_mt"] * FALL < a["_mt"]) & (steps(rate(a)) * FALL < 1.0)
        # a single reading has no step: that of the place before it counts
        return F.coalesce(known(a) & (falls | leaps(a, to_a)), F.lit(False)) | F.coalesce(rate(a).isNull() & known(z) & leaps(z, rate(z)), F.lit(False))

    return F.array_contains(F.transform(places, apart), True)


def clocks(places: list) -> list[int]:
    """Number of the clock that each of a class's places is on; places come in the order of their scans.

    A place belongs to the nearest clock that it neither falls nor leaps from, else it
    begins another one. A single reading far ahead may follow a pause or be in another
    unit, which the places around it tell. Places without a scan, or with times that
    aren't above 0, go with the first clock. The clock with the most readings is 0.
    """
    last: list[tuple] = []
    of: dict[int, int] = {}
    ahead = []
    for p in places:
        if p["_ms"] is None or p["_t0"] <= 0 or p["_place"] in of:
            continue
        rate = (p["_t1"] - p["_t0"]) / (p["_s1"] - p["_s0"]) if p["_s1"] > p["_s0"] else 0.0
        near = []
        for k, (q, of_clock) in enumerate(last):
            steps, leap = rate / of_clock if of_clock else 0.0, p["_t0"] / q["_t1"]
            falls = p["_mt"] * FALL < q["_mt"] and steps * FALL < 1.0
            if not falls and not (leap > LEAP and leap / SLACK <= steps <= leap * SLACK):
                near.append((abs(math.log(p["_mt"] / q["_mt"])), k))
        k = min(near)[1] if near else len(last)
        if near and not rate and p["_t0"] > LEAP * last[k][0]["_t1"]:
            ahead.append(p)
            continue
        if near and not rate and not last[k][1] and p["_ms"] > last[k][0]["_ms"]:
            rate = max(p["_mt"] - last[k][0]["_mt"], 0.0) / (p["_ms"] - last[k][0]["_ms"])
        last[k : k + 1] = [(p, rate or (last[k][1] if near else 0.0))]
        of[p["_place"]] = k
    for p in ahead:
        on: dict[int, list] = {}
        for q in places:
            if of.get(q["_place"], -1) in range(len(last)) and q["_ms"] is not None:
                on.setdefault(of[q["_place"]], []).append(q)
        # what comes after it on its clock doesn't fall
        ok = [k for k, qs in on.items() if not any(q["_s1"] > p["_s1"] and q["_t1"] * FALL < p["_t0"] for q in qs)]
        closest = lambda k, p=p, on=on: min(on[k], key=lambda q: abs(q["_ms"] - p["_ms"]))
        of[p["_place"]] = min(ok, key=lambda k, p=p: abs(math.log(p["_mt"] / closest(k)["_mt"])), default=len(last) + len(of))
    most = {k: -sum(p["n"] for p in places if of.get(p["_place"], 0) == k) for k in {0, *of.values()}}
    rank = {k: i for i, k in enumerate(sorted(most, key=lambda k: (most[k], k)))}
    return [rank[of.get(p["_place"], 0)] for p in places]


def trace_units(readings: DataFrame, trace: DataFrame) -> DataFrame:
    """Unit of each class of readings of each trace: (trace_id, class, n, last_scan, unit, unit_margin, unit_unique).

    A class whose times don't lie on one clock, since the trace went on in another unit
    with as many decimals, has a row for each of its clocks; behind that of the most
    readings, the class is numbered.

    ``readings`` has trace_id, scan, time and time_unit; ``trace`` has trace_id,
    grid_seconds and note. The planned length of the run sets no limit here: recorders are
    left on after it. Readings without a finite time take no part. One scan of the readings, aggregated
    before the shuffle to a row for each place of a class (``reading_place``), so a trace
    that holds a third of all rows costs hardly more than another.

    A trace's classes are solved together: for each unit of its largest class, the other
    classes take the units with the least residuals of their own and of the clock that
    it sets; the combination with the least sum stands, whatever the size of a class.
    The margin is that of the class within it or of the whole, whichever is less.
    """
    p = trace_parts(readings, trace)
    return p.withColumn("class", F.concat_ws("|", "class", F.when(F.col("clock") > 0, F.col("clock") + 1).cast("string"))).drop("places", "clock")


def trace_parts(readings: DataFrame, trace: DataFrame) -> DataFrame:
    """``trace_units`` with the clock's number apart from the class, and places: where its readings lie (``reading_place``), NULL for a whole class."""
    r = readings.filter(is_number(F.col("time"))).withColumn("_scan", F.col("scan").cast("double"))
    many = {"n": F.sum, "_t0": F.min, "_t1": F.max, "_s0": F.min, "_s1": F.max, "_t": F.sum, "_s": F.sum, "_scans": F.sum}
    sums = [f(c).alias(c) for c, f in many.items()]
    g = (
        r.groupBy("trace_id", F.coalesce(F.col("time_unit"), F.lit("?")).alias("_spelled"), _written(F.col("time")).alias("_dec"), reading_place(F.col("scan"), F.col("time")).alias("_place"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("_t0"), F.max("time").alias("_t1"), F.min("scan").alias("_s0"), F.max("scan").alias("_s1"), F.avg("time").alias("_mt"), F.avg("_scan").alias("_ms"), F.count("scan").alias("_scans"))
        .select("*", (F.col("n") * F.col("_mt")).alias("_t"), (F.col("_scans") * F.col("_ms")).alias("_s"), unit_of_spelling(F.col("_spelled")).alias("_declared"))
    )
    g = g.groupBy("trace_id", "_declared", "_dec").agg(*sums, F.sort_array(F.collect_list(F.struct("_ms", "_mt", "_place", *many))).alias("_places"))
    # written, so that the readings are scanned once; places only of classes that hold more than one clock
    g = cut(g.withColumn("_places", F.when(_mixed(F.col("_places")), F.col("_places"))))
    mixed = g.filter("_places is not null")
    g = g.filter("_places is null").withColumn("clock", F.lit(0)).withColumn("places", F.lit(None).cast("array<int>")).drop("_places")
    if mixed.take(1):
        each = mixed.select("trace_id", "_declared", "_dec", F.explode(F.arrays_zip("_places", F.udf(lambda p: clocks(p), "array<int>")("_places").alias("clock"))).alias("p")).select("trace_id", "_declared", "_dec", "p.clock", "p._places.*")
        g = g.unionByName(each.groupBy("trace_id", "_declared", "_dec", "clock").agg(*sums, F.collect_set("_place").alias("places")))
    about = trace.groupBy("trace_id").agg(F.max("grid_seconds").alias("_grid"), F.max(unit_of_text(F.col("note"))).alias("_note"))
    lead = g.groupBy("trace_id").agg(F.max(F.struct("n", "_dec", "_t0", "_t1", "_s0", "_s1")).alias("_lead"))
    # (a trace has a few classes, so that all this is small)
    df = g.join(lead, "trace_id").join(about, "trace_id", "left").withColumn("_step", (F.col("_t1") - F.col("_t0")) / F.nullif(F.col("_s1") - F.col("_s0"), F.lit(0)))
    slope = (F.col("_lead._t1") - F.col("_lead._t0")) / F.nullif(F.col("_lead._s1") - F.col("_lead._s0"), F.lit(0))
    shown = F.col("_lead._t0") + slope * (F.col("_s") / F.nullif(F.col("_scans"), F.lit(0)) - F.col("_lead._s0"))
    df = df.withColumn("_ratio", F.when((shown > 0) & (F.col("_t") > 0), F.col("_t") / F.col("n") / shown))
    own = {
        u: reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (
            _claim(F.col("_declared"), u, 10.0),
            _claim(F.col("_note"), u, 7.0) * F.when(F.col("_declared").isNull(), 1.0).otherwise(0.0),
            F.when(F.col("_t1") * s < DEAD_TIME_S, F.lit(12.0)),
            # gaps lengthen a step, nothing shortens it
            F.least(_sq_log(F.col("_step") * s / F.sqrt(F.col("_grid")), 5.0), F.when(F.col("_step") * s > F.sqrt(F.col("_grid")), 9.0).otherwise(16.0)),
        )])
        for u, s in UNITS.items()
    }
    df = df.select("trace_id", "_declared", "_dec", "clock", "places", "n", "_s1", "_ratio", *[c.alias(f"_own_{u}") for u, c in own.items()])
    cost = {(u, v): F.col(f"_own_{u}") + F.coalesce(F.least(_sq_log(F.col("_ratio") * s / t, CLOCK_FACTOR), F.lit(30.0)), F.lit(0.0)) for u, s in UNITS.items() for v, t in UNITS.items()}
    given = {v: F.sort_array(F.array(*[F.struct(cost[u, v].alias("cost"), F.lit(i).alias("rank"), F.lit(u).alias("unit")) for i, u in enumerate(UNITS)])) for v in UNITS}
    # written once: a few rows for each trace
    df = cut(df.select("trace_id", "_declared", "_dec", "clock", "places", "n", "_s1", *[g.alias(f"_given_{v}") for v, g in given.items()]))
    total = df.groupBy("trace_id").agg(*[F.sum(F.col(f"_given_{v}")[0]["cost"]).alias(f"_cost_{v}") for v in UNITS])
    total = total.select("trace_id", F.sort_array(F.array(*[F.struct(F.col(f"_cost_{v}").alias("cost"), F.lit(i).alias("rank"), F.lit(v).alias("unit")) for i, v in enumerate(UNITS)])).alias("_all"))
    best = reduce(lambda c, v: F.when(F.col("_all")[0]["unit"] == v, F.col(f"_given_{v}")).otherwise(c), UNITS, F.lit(None))
    second = reduce(lambda c, v: F.when(F.col("_all")[1]["unit"] == v, F.col(f"_given_{v}")).otherwise(c), UNITS, F.lit(None))
    out = df.join(total, "trace_id").withColumn("_best", best).withColumn("_second", second)
    whole = F.when(F.col("_best")[0]["unit"] != F.col("_second")[0]["unit"], F.col("_all")[1]["cost"] - F.col("_all")[0]["cost"])
    out = out.withColumn("unit_margin", F.least(F.col("_best")[1]["cost"] - F.col("_best")[0]["cost"], whole))
    return out.select(
        "trace_id", F.concat_ws("|", F.coalesce("_declared", F.lit("?")), F.col("_dec").cast("string")).alias("class"), "n", F.col("_s1").alias("last_scan"), F.col("_best")[0]["unit"].alias("unit"), "unit_margin", (F.col("unit_margin") >= UNIQUE_MARGIN).alias("unit_unique"), "clock", "places"
    )


def found(features: DataFrame, traces: DataFrame) -> DataFrame:
    """Records not written in seconds: (table_name, record_id)."""
    a = features.filter(F.col("unit").isNotNull() & (F.col("unit") != "s")).select(F.lit("feature_metadata").alias("table_name"), F.col("feature_id").cast("bigint").alias("record_id"))
    b = traces.filter(F.col("unit") != "s").select(F.lit("chromatogram").alias("table_name"), F.col("trace_id").cast("bigint").alias("record_id")).distinct()
    return a.unionByName(b)
