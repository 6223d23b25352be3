"""Operators on raw signals: spectra in long form (sample, scan, time, mz, spint).

Ranges in mass are joined on cells as wide as the window, so that a range join is an
equi-join with a residual predicate. Lists of targets are joined without a hint: the
planner broadcasts them when their size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.graph import islands
from massloom.operators.metrics import ratio
from massloom.operators.units import is_number


def scans(signals: DataFrame, ms_level: int | None = None, start: int = 0, end: int | None = None, start_time: float = 0.0, end_time: float | None = None) -> DataFrame:
    """Signals of scans [start, end) recorded in [start_time, end_time), of one MS level."""
    cond = (F.col("scan") >= start) & (F.col("time") >= start_time)
    if end is not None:
        cond &= F.col("scan") < end
    if end_time is not None:
        cond &= F.col("time") < end_time
    if ms_level is not None:
        cond &= F.col("ms_level") == ms_level
    return signals.filter(cond)


def chromatogram_total(signals: DataFrame, kind: str = "tic", keys: Sequence[str] = ("sample", "scan")) -> DataFrame:
    """Total ion (tic) or base peak (bpi) intensity of each scan; 0 for scans whose intensities are all missing."""
    if kind not in ("tic", "bpi"):
        raise ValueError("kind is tic or bpi")
    agg = F.sum("spint") if kind == "tic" else F.max("spint")
    return signals.groupBy(*keys).agg(F.coalesce(agg, F.lit(0.0)).alias(kind))


def window_join(signals: DataFrame, targets: DataFrame, tol: float, closed: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Each signal with each target (target, mz_target) of its own group within tol: [mz - tol, mz + tol), or closed on both ends."""
    t = targets.select(*by, "target", "mz_target", F.explode(F.sequence(F.floor((F.col("mz_target") - tol) / tol), F.floor((F.col("mz_target") + tol) / tol))).alias("_cell"))
    s = signals.withColumn("_cell", F.floor(F.col("mz") / tol))
    high = F.col("mz") <= F.col("mz_target") + tol if closed else F.col("mz") < F.col("mz_target") + tol
    return s.join(t, [*by, "_cell"]).filter((F.col("mz") >= F.col("mz_target") - tol) & high).drop("_cell")


def extracted_chromatograms(signals: DataFrame, targets: DataFrame, window: float, accumulator: str = "sum", fill_missing: bool = True) -> DataFrame:
    """(sample, scan, target, spint): intensity of each scan in each target's window; 0 (or NULL) where there is none."""
    agg = {"sum": F.sum, "mean": F.avg}[accumulator]
    hit = window_join(signals, targets, window).groupBy("sample", "scan", "target").agg(agg("spint").alias("spint"))
    grid = signals.select("sample", "scan").distinct().crossJoin(targets.select("target"))
    out = grid.join(hit, ["sample", "scan", "target"], "left")
    return out.withColumn("spint", F.coalesce("spint", F.lit(0.0))) if fill_missing else out


def nearest(signals: DataFrame, targets: DataFrame, tol: float, by: Sequence[str] = ("sample",)) -> DataFrame:
    """For each target the signal nearest in mass within tol, in each group; ties go to the higher mass."""
    j = window_join(signals, targets, tol, closed=True).withColumn("_d", F.abs(F.col("mz") - F.col("mz_target")))
    best = j.groupBy(*by, "target").agg(F.min(F.struct("_d", (-F.col("mz")).alias("_m"), "spint", "mz_target")).alias("b"))
    return best.select(*by, "target", F.col("b.mz_target").alias("mz_target"), (-F.col("b._m")).alias("mz"), F.col("b.spint").alias("spint"))


def most_abundant(signals: DataFrame, targets: DataFrame, tol: float, by: Sequence[str] = ("sample",)) -> DataFrame:
    """For each target the most intense signal within tol, in each group, with its deviation; ties go to the lower mass."""
    j = window_join(signals, targets, tol, closed=True)
    best = j.groupBy(*by, "target").agg(F.max(F.struct("spint", (-F.col("mz")).alias("_m"), "mz_target")).alias("b"))
    mz = -F.col("b._m")
    return best.select(*by, "target", mz.alias("mz"), F.col("b.spint").alias("spint"), (mz - F.col("b.mz_target")).alias("delta"), ((mz - F.col("b.mz_target")) / F.col("b.mz_target") * 1e6).alias("ppm"))


def match_targets(signals: DataFrame, targets: DataFrame, tol: float, mode: str = "reduce", by: Sequence[str] = ("sample",)) -> DataFrame:
    """Each signal goes to the nearest target within tol (ties: the first); several signals of one are reduced or the closest kept.

    reduce gives their mean mass and summed intensity.
    """
    j = window_join(signals, targets, tol, closed=True).withColumn("_d", F.abs(F.col("mz") - F.col("mz_target")))
    keys = [*by, "mz", "spint"]
    own = j.groupBy(*keys).agg(F.min(F.struct("_d", "mz_target", "target")).alias("b")).select(*keys, F.col("b._d").alias("_d"), F.col("b.target").alias("target"))
    if mode == "closest":
        return own.groupBy(*by, "target").agg(F.min(F.struct("_d", "mz", "spint")).alias("b")).select(*by, "target", F.col("b.mz").alias("mz"), F.col("b.spint").alias("spint"))
    if mode != "reduce":
        raise ValueError("mode is reduce or closest")
    return own.groupBy(*by, "target").agg(F.avg("mz").alias("mz"), F.sum("spint").alias("spint"))


def unmatched(signals: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """Signals near no target."""
    return _by_seed(signals, targets, tol, "left_anti")


def near_seeds(signals: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """Signals within tol of any seed."""
    return _by_seed(signals, targets, tol, "left_semi")


def _by_seed(signals: DataFrame, targets: DataFrame, tol: float, how: str) -> DataFrame:
    t = targets.select("mz_target", F.explode(F.sequence(F.floor((F.col("mz_target") - tol) / tol), F.floor((F.col("mz_target") + tol) / tol))).alias("_cell"))
    s = signals.withColumn("_cell", F.floor(F.col("mz") / tol))
    cond = (s["_cell"] == t["_cell"]) & (F.abs(s["mz"] - t["mz_target"]) <= tol)
    return s.join(t, cond, how).drop("_cell")


def closest_scan(signals: DataFrame, times: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """The scan nearest to each asked time (query, t); ties go to the last scan.

    As-of from both sides: the last scan before and the first one after each time, by a
    window over scans and times together.
    """
    s = signals.select(*by, F.col("time").alias("_t"), F.col("scan").alias("_scan")).distinct()
    q = s.select(*by).distinct().crossJoin(times.select("query", F.col("t").alias("_t")))
    u = s.withColumn("query", F.lit(None).cast(dict(times.dtypes)["query"])).unionByName(q.withColumn("_scan", F.lit(None).cast(dict(s.dtypes)["_scan"])))
    here = F.when(F.col("_scan").isNotNull(), F.struct("_t", "_scan"))
    w = Window.partitionBy(*by).orderBy(F.col("_t"), F.col("query").isNotNull(), F.col("_scan"))
    back = Window.partitionBy(*by).orderBy(F.col("_t"), F.col("query").isNull(), F.col("_scan"))
    u = u.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(here, ignorenulls=True).over(back.rowsBetween(0, Window.unboundedFollowing)))
    u = u.filter("query is not null")
    da, db = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    later = F.col("_a").isNull() | (db <= da)
    pick = F.when(F.col("_b").isNull() | ~later, F.col("_a")).otherwise(F.col("_b"))
    return u.withColumn("_p", pick).select(*by, "query", F.col("_p._scan").alias("scan"), (F.col("_p._t") - F.col("_t")).alias("delta"))


def accumulate(signals: DataFrame, width: float, start: float, end: float, left: float, right: float) -> DataFrame:
    """Summed spectrum over [start, end) minus its surroundings [left, right), by cells of mass; what is left above 0."""
    s = signals.filter((F.col("time") >= left) & (F.col("time") < right)).withColumn("cell", F.floor(F.col("mz") / width))
    sign = F.when((F.col("time") >= start) & (F.col("time") < end), 1.0).otherwise(-1.0)
    return s.groupBy("sample", "cell").agg(F.avg("mz").alias("mz"), F.sum(sign * F.col("spint")).alias("spint")).filter("spint > 0")


def accumulate_linked(signals: DataFrame, tol: float, start: float, end: float, left: float, right: float) -> DataFrame:
    """The same by linked masses: signals of a sample whose masses follow each other within ``tol`` are one ion.

    Returns (sample, ion, mz, spint): the ion's smallest and mean mass, and its sum, above 0.
    """
    from massloom.operators.graph import islands

    s = signals.filter((F.col("time") >= left) & (F.col("time") < right)).select("sample", "time", "mz", "spint")
    named = islands(s, ["sample"], "mz", tol, "ion", 16 * 1024 * tol)
    sign = F.when((F.col("time") >= start) & (F.col("time") < end), 1.0).otherwise(-1.0)
    return named.filter("ion is not null").groupBy("sample", "ion").agg(F.avg("mz").alias("mz"), F.sum(sign * F.col("spint")).alias("spint")).filter("spint > 0")


def above(signals: DataFrame, least: float = 0.0) -> DataFrame:
    return signals.filter(F.col("spint") > least)


def mass_range(signals: DataFrame, low: float, high: float) -> DataFrame:
    return signals.filter(F.col("mz").between(low, high))


def without_artefacts(signals: DataFrame, ranges: Sequence[tuple[float, float]], keep: bool = False) -> DataFrame:
    """Drops signals inside any of the ranges; ``keep`` keeps only those inside all of them instead."""
    for lo, hi in ranges:
        inside = F.col("mz").between(lo, hi)
        signals = signals.filter(inside if keep else ~inside)
    return signals


def mass_steps(signals: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean, deviation and quantiles of the steps between neighbouring masses, in ppm."""
    d = signals.select(*by, "mz").withColumn("_n", F.lead("mz").over(Window.partitionBy(*by).orderBy("mz")))
    d = d.filter("_n is not null").withColumn("_p", (F.col("_n") - F.col("mz")) / F.col("mz") * 1e6)
    q = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    return d.groupBy(*by).agg(F.avg("_p").alias("mean"), F.stddev_pop("_p").alias("std"), *[F.percentile("_p", F.lit(x)).alias(f"q{int(x * 100):02d}") for x in q])


def delete_scans(signals: DataFrame, which: DataFrame) -> DataFrame:
    """Without the scans of ``which`` (sample, scan); the rest are numbered anew from 0."""
    left = signals.join(which.select("sample", "scan").distinct(), ["sample", "scan"], "left_anti")
    number = left.select("sample", "scan").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("sample").orderBy("scan")) - 1)
    return left.join(number, ["sample", "scan"]).withColumn("scan", F.col("_n")).drop("_n")


def slice_scans(signals: DataFrame, first: int, last: int) -> DataFrame:
    """Scans first to last, both included, numbered from 0."""
    return signals.filter(F.col("scan").between(first, last)).withColumn("scan", F.col("scan") - first)


def neighbourhood(signals: DataFrame) -> DataFrame:
    """Distance in ppm and ratio of intensities to the signals before and after in the same scan (250 and 0 at the ends)."""
    w = Window.partitionBy("sample", "scan").orderBy("mz", "spint")
    gap = lambda o: F.coalesce(F.abs(F.col("mz") - o("mz").over(w)) / F.col("mz") * 1e6, F.lit(250.0))
    part = lambda o: F.coalesce(ratio(o("spint").over(w), F.col("spint")), F.lit(0.0))
    return signals.select("*", gap(F.lag).alias("ppm_before"), gap(F.lead).alias("ppm_after"), part(F.lag).alias("ratio_before"), part(F.lead).alias("ratio_after"))


# ---------------------------------------------------------------- regions of interest

class _Traces:
    """Traces that are open while the scans of a run pass by; a scan costs one sorted merge.

    Scans are given by their number among all scans of the run, so that scans without
    any signal here count as missing too.
    """

    def __init__(self, tol: float, max_missing: int, min_length: int, min_intensity: float, targets: np.ndarray | None):
        self.tol, self.max_missing, self.min_length, self.min_intensity = tol, max_missing, min_length, min_intensity
        self.targeted = targets is not None
        self.mean = np.sort(targets) if self.targeted else np.zeros(0)
        self.points: list[list[tuple[int, float, float]]] = [[] for _ in self.mean]
        self.done: list[list[tuple[int, float, float]]] = []

    def expire(self, before: int) -> None:
        """Closes what has been without a signal for more than max_missing scans."""
        late = [bool(p) and before - p[-1][0] > self.max_missing for p in self.points]
        if not any(late):
            return
        for p, x in zip(self.points, late):
            if x:
                self.close(p)
        if self.targeted:
            self.points = [[] if x else p for p, x in zip(self.points, late)]
        else:
            self.mean = self.mean[~np.array(late)]
            self.points = [p for p, x in zip(self.points, late) if not x]

    def add(self, scan: int, mz: np.ndarray, spint: np.ndarray) -> None:
        self.expire(scan - 1)
        hit = np.full(len(mz), -1)
        if len(self.mean) and len(mz):
            right = np.minimum(np.searchsorted(self.mean, mz), len(self.mean) - 1)
            left = np.maximum(right - 1, 0)
            near = np.where(np.abs(mz - self.mean[left]) < np.abs(self.mean[right] - mz), left, right)
            hit = np.where(np.abs(self.mean[near] - mz) <= self.tol, near, -1)
        for k in np.unique(hit[hit >= 0]):
            mine = hit == k
            self.points[k].append((scan, float(mz[mine].mean()), float(spint[mine].sum())))
            if not self.targeted:
                self.mean[k] += (self.points[k][-1][1] - self.mean[k]) / len(self.points[k])
        if not self.targeted and (hit < 0).any():
            new = hit < 0
            mean = np.concatenate([self.mean, mz[new]])
            points = self.points + [[(scan, float(m), float(y))] for m, y in zip(mz[new], spint[new])]
            rank = np.argsort(mean, kind="stable")
            self.mean, self.points = mean[rank], [points[i] for i in rank]

    def close(self, points: list[tuple[int, float, float]]) -> None:
        if len(points) >= self.min_length and max(p[2] for p in points) >= self.min_intensity:
            self.done.append(points)

    def end(self) -> list[list[tuple[int, float, float]]]:
        for p in self.points:
            if p:
                self.close(p)
        self.points = []
        return sorted(self.done, key=lambda p: (p[0][0], p[0][1]))


def regions(signals: DataFrame, tol: float = 0.01, max_missing: int = 1, min_length: int = 10, min_intensity: float = 0.0, targets: Sequence[float] | None = None, pad: int = 2) -> DataFrame:
    """Regions of interest: signals of consecutive scans linked by mass.

    A signal joins the nearest open trace within tol of its running mean mass; what joins
    none begins one; a trace ends after more than max_missing scans without a signal.
    Returns (sample, roi_index, scan, time, mz, spint), arrays over the scans of the region,
    with NULL in gaps and in ``pad`` scans on either side.

    Linking depends on the order of scans but never crosses a gap in mass wider than tol,
    so a run is divided at such gaps: the unit of work is one island of mass of one run,
    and a run of any size spreads over many tasks.
    """
    wanted = None if targets is None else np.array(list(targets), float)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        traces = _Traces(tol, max_missing, min_length, min_intensity, wanted)
        run = pdf.sort_values(["_no", "mz"], kind="stable")
        no, mz, spint = run["_no"].to_numpy(), run["mz"].to_numpy(float), run["spint"].to_numpy(float)
        for at in np.split(np.arange(len(run)), np.flatnonzero(np.diff(no)) + 1):
            traces.add(int(no[at[0]]), mz[at], spint[at])
        rows = [(run["sample"].iloc[0], [x[0] for x in p], [x[1] for x in p], [x[2] for x in p]) for p in traces.end()]
        return pd.DataFrame(rows, columns=["sample", "no", "mz", "spint"])

    s = signals.select(F.col("sample").cast("string").alias("sample"), F.col("scan").cast("int").alias("scan"), F.col("time").cast("double").alias("time"), F.col("mz").cast("double").alias("mz"), F.col("spint").cast("double").alias("spint"))
    # one row for each scan of each run
    axis = s.groupBy("sample", "scan").agg(F.min("time").alias("time"))
    axis = axis.withColumn("_no", F.row_number().over(Window.partitionBy("sample").orderBy("scan")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("sample")))
    ok = s.filter(is_number(F.col("mz")) & is_number(F.col("spint"))).drop("time").join(axis.select("sample", "scan", "_no"), ["sample", "scan"])
    parted = islands(ok, ["sample"], "mz", tol, "_island", max(1.0, 100 * tol))
    found = parted.select("sample", "_island", "_no", "mz", "spint").groupBy("sample", "_island").applyInPandas(build, "sample string, no array<int>, mz array<double>, spint array<double>")
    order = Window.partitionBy("sample").orderBy(F.col("no")[0], F.col("mz")[0], F.col("mz"))
    found = found.withColumn("roi_index", (F.row_number().over(order) - 1).cast("int"))
    size = axis.groupBy("sample").agg(F.max("_n").alias("_n"))
    span = found.join(size, "sample").select("sample", "roi_index", F.explode(F.sequence(F.greatest(F.element_at("no", 1) - pad, F.lit(0)), F.least(F.element_at("no", -1) + pad, F.col("_n").cast("int") - 1))).alias("_no"))
    points = found.select("sample", "roi_index", F.explode(F.arrays_zip("no", "mz", "spint")).alias("p")).select("sample", "roi_index", F.col("p.no").alias("_no"), "p.mz", "p.spint")
    full = span.join(axis.select("sample", "_no", "scan", "time"), ["sample", "_no"]).join(points, ["sample", "roi_index", "_no"], "left")
    rows = full.groupBy("sample", "roi_index").agg(F.array_sort(F.collect_list(F.struct("scan", "time", "mz", "spint"))).alias("p"))
    return rows.select("sample", "roi_index", *[F.col(f"p.{c}").alias(c) for c in ("scan", "time", "mz", "spint")])


def targeted_runs(signals: DataFrame, targets: DataFrame, tol: float, max_missing: int = 1, by: str = "sample") -> DataFrame:
    """Targeted regions without a state machine: islands of scans with gaps of at most max_missing.

    (by, target, first_scan, last_scan, n, spint): the islands of each target.
    """
    hit = window_join(signals, targets, tol, closed=True).groupBy(by, "target", "scan").agg(F.sum("spint").alias("spint"))
    w = Window.partitionBy(by, "target").orderBy("scan")
    new = F.coalesce((F.col("scan") - F.lag("scan").over(w) > max_missing + 1).cast("int"), F.lit(0))
    runs = hit.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(by, "target", "run").agg(F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.count(F.lit(1)).alias("n"), F.sum("spint").alias("spint"))


def as_signals(df: DataFrame, sample: str, scan: Column, time: Column, mz: str, spint: str) -> DataFrame:
    """Names the columns of raw signals."""
    return df.select(F.col(sample).alias("sample"), scan.alias("scan"), time.alias("time"), F.col(mz).alias("mz"), F.col(spint).alias("spint"))


def accumulate_profile(spectra: DataFrame, start: float, end: float, left: float, right: float) -> DataFrame:
    """Profile spectra (sample, time, mz, spint arrays) over [start, end) minus those around it in [left, right).

    Scans are summed on the union of their masses, at once for each sample: the window
    in time bounds the group.
    """
    from massloom.functions.kernels import profile_sum

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = [1.0 if start <= t < end else -1.0 for t in pdf["time"]]
        m, y = profile_sum([np.array(x, float) for x in pdf["mz"]], [np.array(x, float) for x in pdf["spint"]], signs)
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "mz": [m.tolist()], "spint": [y.tolist()]})

    s = spectra.filter((F.col("time") >= left) & (F.col("time") < right)).select(F.col("sample").cast("string").alias("sample"), "time", "mz", "spint")
    return s.groupBy("sample").applyInPandas(run, "sample string, mz array<double>, spint array<double>")
