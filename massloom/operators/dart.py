"""Direct-ionisation workflow: spots, consensus spectra, bracketing, and statistics of groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions import kernels
from massloom.operators import metrics, raw
from massloom.operators.metrics import ratio
from massloom.session import small


def spots(tic: DataFrame, threshold: float, start: float = 0.0, end: float = float("inf"), by: str = "sample") -> DataFrame:
    """Runs of scans whose total is at least the threshold: (by, spot, first_scan, last_scan, start_time, end_time, n)."""
    w = Window.partitionBy(by).orderBy("scan")
    t = tic.withColumn("_on", (F.col("tic") >= threshold) & (F.col("time") >= start) & (F.col("time") <= end))
    t = t.withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int")).withColumn("spot", F.sum("_new").over(w)).filter("_on")
    return t.groupBy(by, "spot").agg(F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n"))


def in_spots(signals: DataFrame, spot_table: DataFrame, bucket: float) -> DataFrame:
    """Signals of each spot (sample, spot, start_time, end_time), both limits included: an interval join on buckets of time."""
    s = spot_table.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    return signals.withColumn("_b", F.floor(F.col("time") / bucket)).join(s, ["sample", "_b"]).filter(F.col("time").between(F.col("start_time"), F.col("end_time"))).drop("_b")


def top_scans(signals: DataFrame, n: int | None, by: str = "sample") -> DataFrame:
    """Signals of the n scans with the highest total of each sample; ties go to the earlier scan."""
    if n is None:
        return signals
    t = raw.chromatogram_total(signals, "tic", (by, "scan")).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("tic"), "scan"))).filter(F.col("_r") <= n)
    return signals.join(t.select(by, "scan"), [by, "scan"], "left_semi")


def drop_lower(signals: DataFrame, rate: float, by: str = "sample") -> DataFrame:
    """Without the floor(n * rate) scans of the lowest total of each sample."""
    t = raw.chromatogram_total(signals, "tic", (by, "scan"))
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("tic", "scan"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return signals.join(t.filter(F.col("_r") > F.floor(F.col("_n") * rate)).select(by, "scan"), [by, "scan"], "left_semi")


def normalize_tic(signals: DataFrame, factor: float = 1.0, by: str = "sample") -> DataFrame:
    """Intensities over their sample's total; a sample with none stays as it is."""
    total = signals.groupBy(by).agg(F.sum("spint").alias("_t"))
    return signals.join(total, by).withColumn("spint", F.coalesce(ratio(F.col("spint"), F.col("_t")) * factor, F.col("spint"))).drop("_t")


def normalize_standard(signals: DataFrame, low: float, high: float, factor: float = 1.0, by: str = "sample") -> DataFrame:
    """Intensities over those of an internal standard between two masses; without it they stay as they are."""
    total = signals.groupBy(by).agg(F.sum(F.when(F.col("mz").between(low, high), F.col("spint"))).alias("_t"))
    return signals.join(total, by).withColumn("spint", F.coalesce(ratio(F.col("spint"), F.col("_t")) * factor, F.col("spint"))).drop("_t")


def mass_offsets(signals: DataFrame, references: DataFrame, tol: float, criterion: str = "most_abundant", by: Sequence[str] = ("sample", "scan")) -> DataFrame:
    """Deviation of each reference (target, mz_target) in each scan, absolute and in ppm."""
    if criterion == "most_abundant":
        return raw.most_abundant(signals, references, tol, by)
    n = raw.nearest(signals, references, tol, by)
    return n.withColumn("delta", F.col("mz") - F.col("mz_target")).withColumn("ppm", F.col("delta") / F.col("mz_target") * 1e6).drop("mz_target")


def correct_masses(signals: DataFrame, references: DataFrame, tol: float, use_ppm: bool = True, cutoff: float = 80.0, level: str = "sample", criterion: str = "most_abundant") -> DataFrame:
    """Shifts masses by their group's median deviation; original_mz and factor allow the way back."""
    keys = list(dict.fromkeys([level, "scan"]))
    o = mass_offsets(signals, references, tol, criterion, keys).filter(F.abs("ppm") <= cutoff)
    f = o.groupBy(level).agg(F.median("ppm" if use_ppm else "delta").alias("factor"))
    s = signals.join(f, level, "left").withColumn("factor", F.coalesce("factor", F.lit(0.0))).withColumn("original_mz", F.col("mz"))
    return s.withColumn("mz", F.col("mz") * (1 - F.col("factor") / 1e6) if use_ppm else F.col("mz") - F.col("factor"))


def crude_clusters(signals: DataFrame, gap_ppm: float, by: Sequence[str] = ("sample",), width: float = 0.05) -> DataFrame:
    """Adds crude, the number of the run of masses without a gap above gap_ppm (0, 1, ... in each group).

    The logarithm of the mass makes the relative gap absolute. Runs are found in blocks
    of it and stitched at the edges, so one group may hold any share of the rows; the
    numbers come from the runs alone, of which there are few.
    """
    from massloom.operators.graph import islands, positions

    x = F.log("mz")
    # mz2 / mz1 - 1 <= gap is log(mz2) - log(mz1) <= log(1 + gap)
    s = signals.withColumn("_x", x)
    named = islands(s, list(by), "_x", float(np.log1p(gap_ppm / 1e6)), "_run", width)
    runs = named.select(*by, "_run").distinct().withColumn("crude", F.dense_rank().over(Window.partitionBy(*by).orderBy("_run")) - 1) if by else positions(named.select("_run").distinct(), ["_run"]).withColumnRenamed("position", "crude")
    return named.join(runs, [*by, "_run"]).drop("_x", "_run")


def refine(signals: DataFrame, keys: Sequence[str], near_ppm: float = 20.0, width_ppm: float = 25.0, std_ppm: float | None = None) -> DataFrame:
    """Adds fine: parts of each crude cluster grown from its closest pair; -1 for what is left alone.

    A part takes the neighbour nearer to its centre, as long as it is near enough to the
    part's edge and the part stays narrow enough. The centre is the first mass, or, where
    the deviation is limited too, the mean by intensity. A signal is taken once. Growing is
    sequential; a group is one crude cluster of one sample, whose width is bounded by the
    gap, and the work is linear in its size.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*signals.schema.fields, T.StructField("fine", T.IntegerType())])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mz", kind="stable")
        m = pdf["mz"].to_numpy(float)
        w = pdf["spint"].to_numpy(float) if std_ppm is not None else np.ones(len(m))
        # sums of w, w m and w m m up to each place; masses from the first one, for their digits
        z = m - m[0]
        sums = np.concatenate([np.zeros((3, 1)), np.cumsum([w, w * z, w * z * z], axis=1)], axis=1)
        label = np.full(len(m), -1)
        free = np.ones(len(m), bool)
        number = 0
        for seed in np.argsort(np.diff(m), kind="stable"):
            if not (free[seed] and free[seed + 1]):
                continue
            lo = hi = seed
            centre = m[seed]
            while True:
                left = centre - m[lo - 1] if lo > 0 and free[lo - 1] else np.inf
                right = m[hi + 1] - centre if hi + 1 < len(m) and free[hi + 1] else np.inf
                if min(left, right) == np.inf:
                    break
                a, b = (lo - 1, hi) if left <= right else (lo, hi + 1)
                step = m[lo] - m[a] if a < lo else m[b] - m[hi]
                if max(step / near_ppm, (m[b] - m[a]) / width_ppm) / centre * 1e6 > 1:
                    break
                if std_ppm is not None:
                    n, one, two = sums[:, b + 1] - sums[:, a]
                    mean = one / n
                    if np.sqrt(max(two / n - mean * mean, 0)) / (mean + m[0]) * 1e6 > std_ppm:
                        break
                    centre = mean + m[0]
                lo, hi = a, b
            label[lo : hi + 1], free[lo : hi + 1] = number, False
            number += 1
        return pdf.assign(fine=label.astype("int32"))

    return signals.groupBy(*keys).applyInPandas(grow, schema)


def reindex(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Drops label -1 and numbers the rest 0, 1, ... in order."""
    d = df.filter(F.col(label) >= 0)
    names = d.select(*by, label).distinct().withColumn("_n", F.dense_rank().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(label)) - 1)
    return d.join(names, [*by, label]).withColumn(label, F.col("_n")).drop("_n")


def ppm_spread_ok(signals: DataFrame, keys: Sequence[str], most: float = 15.0) -> DataFrame:
    """Clusters whose intensity-weighted deviation is at most so many ppm."""
    s = metrics.weighted_stats(signals, keys, "mz", "spint")
    return s.filter(F.col("rsd") * 1e6 <= most).select(*keys)


def peak_form_ok(signals: DataFrame, keys: Sequence[str], least: float = 0.5, run: Sequence[str] = ("sample",), at: str = "scan", scans: DataFrame | None = None) -> DataFrame:
    """Clusters whose intensity over the scans of their run correlates with a gaussian of a sixth of the run.

    ``run`` names the runs, among ``keys``; ``scans`` has all scans (run, ``at``), if
    signals don't. A scan without a signal counts as 0, but isn't made: sums over the
    run and sums over the cluster's own scans give the correlation.
    """
    own = (signals if scans is None else scans).select(*run, at).distinct()
    middle = own.groupBy(*run).agg(F.avg(at).alias("_m"), ((F.max(at) - F.min(at)) / 6).alias("_s"))
    z = (F.col(at) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    shape = own.join(middle, list(run)).withColumn("_g", F.exp(-z * z / 2))
    total = shape.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), F.sum("_g").alias("_sg"), F.sum(F.col("_g") * F.col("_g")).alias("_sgg"))
    y = signals.groupBy(*dict.fromkeys([*run, *keys]), at).agg(F.sum("spint").alias("_y")).join(middle, list(run)).withColumn("_g", F.exp(-z * z / 2))
    c = y.groupBy(*dict.fromkeys([*run, *keys])).agg(F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"), F.sum(F.col("_y") * F.col("_g")).alias("_sgy")).join(total, list(run))
    spread = lambda xx, x: F.sqrt(F.greatest(F.col(xx) - F.col(x) * F.col(x) / F.col("_n"), F.lit(0.0)))
    r = ratio(F.col("_sgy") - F.col("_sg") * F.col("_sy") / F.col("_n"), spread("_sgg", "_sg") * spread("_syy", "_sy"))
    return c.filter(r >= least).select(*keys)


def collapse(signals: DataFrame, keys: Sequence[str], how: str = "average") -> DataFrame:
    """Consensus of each cluster: weighted mean mass, limits, width in ppm, number and intensity."""
    agg = {"average": F.avg, "sum": F.sum, "max": F.max}[how]
    c = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("mz").alias("mz_min"), F.max("mz").alias("mz_max"), (F.sum(F.col("mz") * F.col("spint")) / F.nullif(F.sum("spint"), F.lit(0.0))).alias("mz"), agg("spint").alias("spint"), F.sum("spint").alias("total"))
    return c.withColumn("ppm", (F.col("mz_max") - F.col("mz_min")) / F.col("mz_min") * 1e6)


def consensus(signals: DataFrame, gap_ppm: float = 30.0, near_ppm: float = 20.0, width_ppm: float = 20.0, least_signals: int = 10, least_intensity: float = 0.0, how: str = "average", most_spread: float | None = None) -> DataFrame:
    """Consensus spectrum of each sample: crude clusters, refined, counted, checked and collapsed."""
    s = crude_clusters(signals.filter(F.col("spint") > least_intensity), gap_ppm)
    enough = s.groupBy("sample", "crude").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_signals).select("sample", "crude")
    f = refine(s.join(enough, ["sample", "crude"], "left_semi"), ["sample", "crude"], near_ppm, width_ppm).filter("fine >= 0")
    keys = ["sample", "crude", "fine"]
    big = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_signals).select(*keys)
    f = f.join(big, keys, "left_semi")
    if most_spread is not None:
        f = f.join(ppm_spread_ok(f, keys, most_spread), keys, "left_semi")
    return collapse(f, keys, how)


def bracket(spectra: DataFrame, gap_ppm: float = 100.0, near_ppm: float = 20.0, width_ppm: float = 25.0, least: int = 2) -> DataFrame:
    """Features across samples: (feature, mz_min, mz_mean, mz_max, samples)."""
    s = crude_clusters(spectra.select("sample", "mz", "spint"), gap_ppm, by=())
    f = refine(s, ["crude"], near_ppm, width_ppm).filter("fine >= 0")
    b = f.groupBy("crude", "fine").agg(F.min("mz").alias("mz_min"), F.avg("mz").alias("mz_mean"), F.max("mz").alias("mz_max"), F.countDistinct("sample").alias("samples"), F.count(F.lit(1)).alias("n"))
    b = b.filter(F.col("n") >= least)
    return b.withColumn("feature", F.concat_ws("_", F.col("crude").cast("string"), F.col("fine").cast("string"))).select("feature", "mz_min", "mz_mean", "mz_max", "samples")


def bracket_matrix(brackets: DataFrame, signals: DataFrame, how: str = "sum", widen_ppm: float = 0.0) -> DataFrame:
    """Long matrix (sample, feature, value): signals within each bracket; NULL where there are none.

    An interval join on cells of the mass as wide as the widest bracket's own cells.
    """
    cell = 0.05
    lo, hi = F.col("mz_min") * (1 - widen_ppm / 1e6), F.col("mz_max") * (1 + widen_ppm / 1e6)
    b = brackets.select("feature", lo.alias("_lo"), hi.alias("_hi")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor(F.col("_hi") / cell))))
    agg = {"sum": F.sum, "average": F.avg, "max": F.max}[how]
    hit = signals.withColumn("_c", F.floor(F.col("mz") / cell)).join(b, "_c").filter(F.col("mz").between(F.col("_lo"), F.col("_hi"))).groupBy("sample", "feature").agg(agg("spint").alias("value"))
    grid = signals.select("sample").distinct().crossJoin(brackets.select("feature").distinct())
    return grid.join(hit, ["sample", "feature"], "left")


def blank_test(matrix: DataFrame, blanks: Sequence[str], study: Sequence[str], fold: float = 2.0, p_limit: float = 0.05, least: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Statistics and verdict of each feature against blanks: Welch's one-sided test and the fold of means."""
    s = metrics.welch(metrics.two_groups(matrix, study, blanks, by=by)).withColumn("fold", ratio(F.col("mean1"), F.col("mean2")))
    s = s.withColumn("p", student_p(F.col("t"), F.col("df")))
    absent = F.col("n2") == 0
    keep = (F.col("n1") >= least) & (absent | (F.coalesce(F.col("p"), F.lit(1.0)) <= p_limit) & (F.coalesce(F.col("fold"), F.lit(float("inf"))) >= fold))
    return s.withColumn("keep", keep)


def subtract_blanks(matrix: DataFrame, blanks: Sequence[str], groups: Sequence[str], fold: float = 2.0, p_limit: float = 0.05, least: int = 2) -> DataFrame:
    """Each feature in each group against the blanks: (feature, class, t, df, p, fold, keep).

    Welch's one-sided test of detected values; against a single blank value, the
    one-sample test. A group with fewer than ``least`` values isn't compared; a feature
    that no blank holds is kept. A feature stays if any of its groups keeps it.
    """
    stats = lambda classes, n, *keys: matrix.filter(F.col("class").isin(list(classes))).groupBy("feature", *keys).agg(F.count("value").alias(f"n{n}"), F.avg("value").alias(f"mean{n}"), F.var_samp("value").alias(f"var{n}"))
    s = metrics.welch(stats(groups, 1, "class").join(stats(blanks, 2), "feature", "left").withColumn("n2", F.coalesce("n2", F.lit(0))))
    single = ratio(F.col("mean1") - F.col("mean2"), F.sqrt(ratio(F.col("var1"), F.col("n1").cast("double"))))
    one, compared = F.col("n2") == 1, (F.col("n1") >= least) & (F.col("n2") > 0)
    s = s.withColumn("t", F.when(compared, F.when(one, single).otherwise(F.col("t")))).withColumn("df", F.when(compared, F.when(one, (F.col("n1") - 1).cast("double")).otherwise(F.col("df"))))
    s = s.withColumn("fold", F.when(compared, ratio(F.col("mean1"), F.col("mean2")))).withColumn("p", student_p(F.col("t"), F.col("df")))
    # (blanks that are all 0 are exceeded by any fold)
    high = F.coalesce(F.col("fold") >= fold, F.col("mean2") == 0)
    keep = (F.col("n1") >= least) & ((F.col("n2") == 0) | F.coalesce((F.col("p") <= p_limit) & high, F.lit(False)))
    return s.select("feature", "class", "t", "df", "p", "fold", keep.alias("keep"))


def student_p(t: Column, df: Column) -> Column:
    """One-sided tail of Student's distribution, of the normal one for infinite df; NULL where t or df is."""

    @F.pandas_udf("double")
    def tail(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series(kernels.student_tail(ts.to_numpy(float), ds.to_numpy(float)))

    p = tail(t, df)
    return F.when(~F.isnan(p), p)


def sister_ions(features: DataFrame, shifts: DataFrame, max_ppm: float, key: str = "feature", mz: str = "mz", by: Sequence[str] = ()) -> DataFrame:
    """For each feature and mass difference (ion, shift) the nearest other feature (of the same ``by``) at the sum, within max_ppm.

    ``shifts`` is a list of known ions, which is broadcast where its size is checked to be small.
    """
    t = features.select(*by, F.col(key).alias("parent"), F.col(mz).alias("_m")).crossJoin(small(shifts.select("ion", "shift"), 10_000)).withColumn("_q", F.col("_m") + F.col("shift"))
    cell = 0.1
    width = F.col("_q") * max_ppm / 1e6
    t = t.withColumn("_c", F.explode(F.sequence(F.floor((F.col("_q") - width) / cell), F.floor((F.col("_q") + width) / cell))))
    f = features.select(*by, F.col(key).alias("child"), F.col(mz).alias("_cm")).withColumn("_c", F.floor(F.col("_cm") / cell))
    j = t.join(f, [*by, "_c"]).filter((F.abs(F.col("_cm") - F.col("_q")) <= F.col("_q") * max_ppm / 1e6) & (F.col("parent") != F.col("child")))
    best = j.groupBy("parent", "ion").agg(F.min(F.struct(F.abs(F.col("_cm") - F.col("_q")).alias("d"), "child", "_q")).alias("b"))
    return best.select("parent", "ion", F.col("b.child").alias("child"), (F.col("b.d") / F.col("b._q") * 1e6).alias("ppm"))


def sister_ratios(matrix: DataFrame, pairs: DataFrame, least: int = 10, low: float = 2.0, high: float = 200.0, most_std: float = 50.0) -> DataFrame:
    """Pairs whose ratio of child to parent over the samples is steady enough to be an adduct or isotope."""
    p = pairs.join(matrix.select("sample", F.col("feature").alias("parent"), F.col("value").alias("_p")), "parent").join(matrix.select("sample", F.col("feature").alias("child"), F.col("value").alias("_c")), ["sample", "child"])
    r = p.withColumn("_r", ratio(F.col("_c"), F.col("_p")) * 100.0).groupBy("parent", "ion", "child").agg(F.count("_r").alias("n"), F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"))
    return r.withColumn("sister", (F.col("n") > least) & (F.col("mean") > low) & (F.col("mean") < high) & (F.col("std") < most_std))


def found_in_replicates(matrix: DataFrame, groups: Sequence[str], least: float, every: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Features detected in at least this share of any (or every) group's samples."""
    r = matrix.filter(F.col("class").isin(list(groups))).groupBy(*by, "feature", "class").agg((F.count("value") / F.count(F.lit(1)) >= least).alias("_ok"))
    return r.groupBy(*by, "feature").agg((F.bool_and if every else F.bool_or)("_ok").alias("_ok")).filter("_ok").select(*by, "feature")


def minimum_intensity(matrix: DataFrame, groups: Sequence[str], least: float, by: Sequence[str] = ()) -> DataFrame:
    """Features whose mean of detected values is above the limit in any group."""
    r = matrix.filter(F.col("class").isin(list(groups))).groupBy(*by, "feature", "class").agg(F.avg("value").alias("_m"))
    return r.groupBy(*by, "feature").agg(F.bool_or(F.coalesce(F.col("_m") > least, F.lit(False))).alias("_ok")).filter("_ok").select(*by, "feature")


def low_rsd(matrix: DataFrame, groups: Sequence[str], most: float, by: Sequence[str] = ()) -> DataFrame:
    """Features whose relative deviation, missing as 0, is at most the limit in every group; all zero passes."""
    v = F.coalesce("value", F.lit(0.0))
    r = matrix.filter(F.col("class").isin(list(groups))).groupBy(*by, "feature", "class").agg(ratio(F.stddev_pop(v), F.avg(v)).alias("_r"))
    return r.groupBy(*by, "feature").agg(F.bool_and(F.coalesce(F.col("_r") <= most, F.lit(True))).alias("_ok")).filter("_ok").select(*by, "feature")


def most_abundant_features(matrix: DataFrame, n: int) -> DataFrame:
    """The n features of the highest mean; ties go to the smaller name."""
    return matrix.groupBy("feature").agg(F.avg("value").alias("mean")).filter("mean is not null").orderBy(F.desc("mean"), "feature").limit(n)


def volcano(matrix: DataFrame, a: Sequence[str], b: Sequence[str], alpha: float = 0.05, min_fold: float = 2.0, found: float = 0.75, not_found: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Differential test of two groups, missing as 0: fold, Welch's t and p, rank sum z and its p, Cohen's d, verdict.

    A feature is tested if enough samples of both groups hold it (above 0), or enough
    of one and few of the other.
    """
    s = metrics.cohen_d(metrics.welch(metrics.two_groups(matrix, a, b, zero_missing=True, by=by)))
    m = matrix.filter(F.col("class").isin([*a, *b])).withColumn("_v", F.coalesce("value", F.lit(0.0)))
    m = m.withColumn("_rank", metrics.mean_rank("_v", [*by, "feature"]))
    in_a = F.col("class").isin(list(a))
    w = m.groupBy(*by, "feature").agg(F.sum(F.when(in_a, F.col("_rank"))).alias("rank_sum"), F.count_if(in_a & (F.col("_v") != 0)).alias("_h1"), F.count_if(~in_a & (F.col("_v") != 0)).alias("_h2"))
    s = s.join(w, [*by, "feature"])
    fold = F.when((F.col("mean2") == 0) & (F.col("mean1") > 0), F.lit(float("inf"))).otherwise(ratio(F.col("mean1"), F.col("mean2")))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = ratio(F.col("rank_sum") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    two = lambda t, df: F.least(2 * student_p(F.abs(t), df), F.lit(1.0))
    s = s.withColumn("fold", fold).withColumn("z", z)
    s = s.withColumn("p", F.when(F.col("t").isNotNull(), two(F.col("t"), F.col("df")))).withColumn("p_ranks", F.when(F.col("z").isNotNull(), two(F.col("z"), F.lit(float("inf")))))
    x, y = ratio(F.col("_h1").cast("double"), n1), ratio(F.col("_h2").cast("double"), n2)
    tested = F.greatest(x, y) >= found
    tested = tested & ((F.least(x, y) >= found) | (F.least(x, y) <= not_found)) & x.isNotNull() & y.isNotNull()
    big = (F.col("fold") >= min_fold) | (F.col("fold") <= 1 / min_fold)
    s = s.withColumn("tested", F.coalesce(tested, F.lit(False))).drop("_h1", "_h2")
    return s.withColumn("significant", F.coalesce(F.col("tested") & (F.col("p") <= alpha) & big, F.lit(False)))


def annotate_compounds(features: DataFrame, compounds: DataFrame, max_ppm: float = 15.0) -> DataFrame:
    """Compounds (name, mz) within max_ppm of each feature (feature, mz): one row with all of them."""
    cell = 0.1
    c = compounds.select("name", F.col("mz").alias("_q")).withColumn("_w", F.col("_q") * max_ppm / 1e6).withColumn("_c", F.explode(F.sequence(F.floor((F.col("_q") - F.col("_w")) / cell), F.floor((F.col("_q") + F.col("_w")) / cell))))
    hit = features.select("feature", "mz").withColumn("_c", F.floor(F.col("mz") / cell)).join(c, "_c").withColumn("ppm", (F.col("mz") - F.col("_q")) / F.col("_q") * 1e6).filter(F.abs("ppm") <= max_ppm)
    return hit.groupBy("feature").agg(F.array_sort(F.collect_set(F.struct("name", F.round("ppm", 4).alias("ppm")))).alias("annotations"))


def recovery(features: DataFrame, references: DataFrame, max_ppm: float) -> DataFrame:
    """For each reference mass (target, mz_target) the nearest feature within max_ppm, or none."""
    cell = 0.1
    t = references.withColumn("_w", F.col("mz_target") * max_ppm / 1e6).withColumn("_c", F.explode(F.sequence(F.floor((F.col("mz_target") - F.col("_w")) / cell), F.floor((F.col("mz_target") + F.col("_w")) / cell))))
    j = features.select("feature", "mz").withColumn("_c", F.floor(F.col("mz") / cell)).join(t, "_c").withColumn("_d", F.abs(F.col("mz") - F.col("mz_target"))).filter(F.col("_d") <= F.col("_w"))
    best = j.groupBy("target").agg(F.min(F.struct("_d", "feature", "mz")).alias("b"))
    return references.join(best, "target", "left").select("target", "mz_target", F.col("b.feature").alias("feature"), (F.col("b._d") / F.col("mz_target") * 1e6).alias("ppm"))


def embedding(matrix: DataFrame, components: int = 2, scaling: bool = True) -> DataFrame:
    """Scores (sample, component, score) of the principal components, missing as 0, features standardised."""
    m = matrix.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if scaling:
        s = m.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        m = m.join(s, "feature").withColumn("value", F.coalesce(ratio(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")
    return metrics.pca(m, components)[0]


def embedding_by(matrix: DataFrame, by: str = "study", components: int = 2, scaling: bool = True) -> DataFrame:
    """``embedding`` of each group: (by, sample, component, score)."""
    return metrics.pca_by(matrix, by, components, scaling)


def leaf_order_by(matrix: DataFrame, by: str = "study", axis: str = "sample") -> DataFrame:
    """``leaf_order`` of each group: (by, axis, position). A group goes to one task, with its rows' distances."""
    kinds = dict(matrix.dtypes)
    other = "feature" if axis == "sample" else "sample"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, z = metrics.dense(pdf, axis, other, True)
        dot = z @ z.T
        sq = np.diag(dot)
        order = kernels.ward_order(np.maximum(sq[:, None] + sq - 2 * dot, 0.0))
        return pd.DataFrame({by: pdf[by].iloc[0], axis: np.asarray(names)[order], "position": np.arange(len(order), dtype="int32")})

    m = matrix.filter(F.col(by).isNotNull() & F.col(axis).isNotNull() & F.col(other).isNotNull()).select(by, "sample", "feature", "value")
    return m.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {axis} {kinds[axis]}, position int")


def leaf_order(matrix: DataFrame, axis: str = "sample", most: int = 2000) -> DataFrame:
    """(axis, position): order of Ward's hierarchical clustering of standardised rows, missing as 0.

    A picture's order: refused for more than ``most`` rows, whose distances come to the driver.
    """
    spark = matrix.sparkSession
    other = "feature" if axis == "sample" else "sample"
    m = matrix.select(F.col(axis).alias("r"), F.col(other).alias("c"), F.coalesce("value", F.lit(0.0)).alias("v"))
    s = m.groupBy("c").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    z = m.join(s, "c").select("r", "c", F.coalesce(ratio(F.col("v") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("v"))
    names = [x[0] for x in z.select("r").distinct().orderBy("r").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} rows to order")
    at = {x: i for i, x in enumerate(names)}
    dot = np.zeros((len(names), len(names)))
    pairs = z.withColumnsRenamed({"r": "a", "v": "va"}).join(z.withColumnsRenamed({"r": "b", "v": "vb"}), "c").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    for r in pairs.collect():
        dot[at[r["a"]], at[r["b"]]] = dot[at[r["b"]], at[r["a"]]] = r["s"]
    sq = np.diag(dot)
    order = kernels.ward_order(np.maximum(sq[:, None] + sq - 2 * dot, 0.0))
    kind = dict(matrix.dtypes)[axis]
    return spark.createDataFrame([(names[i], k) for k, i in enumerate(order)], f"{axis} {kind}, position int")


def drill_down(signals: DataFrame, brackets: DataFrame, feature: object) -> DataFrame:
    """Signals of one bracketed feature with their deviation in ppm from its mean, and each sample's sum and mean."""
    b = brackets.filter(F.col("feature") == F.lit(feature)).select("feature", "mz_min", "mz_mean", "mz_max")
    hit = signals.join(b, F.col("mz").between(F.col("mz_min"), F.col("mz_max"))).withColumn("ppm", (F.col("mz") - F.col("mz_mean")) / F.col("mz_mean") * 1e6)
    w = Window.partitionBy("sample")
    return hit.withColumn("sample_sum", F.sum("spint").over(w)).withColumn("sample_mean", F.avg("spint").over(w))


def process(signals: DataFrame, samples: DataFrame, references: DataFrame | None = None, top_n: int | None = None, gap_ppm: float = 30.0, least_signals: int = 5, qc: Sequence[str] = (), blanks: Sequence[str] = (), study: Sequence[str] = ()) -> DataFrame:
    """The workflow end to end: scans chosen, masses shifted, consensus, brackets, matrix, batches, blanks.

    ``samples`` has sample, class and batch. Returns the long matrix with its metadata.
    """
    from massloom.operators.batch import median_ratio

    s = top_scans(signals, top_n)
    if references is not None:
        s = correct_masses(s, references, 0.05)
    s = cut_table(s)
    spectra = consensus(s, gap_ppm, least_signals=least_signals)
    m = bracket_matrix(bracket(spectra), s).join(samples, "sample", "left")
    if qc:
        m = median_ratio(m, qc)
    if blanks and study:
        keep = blank_test(m, blanks, study).filter("keep").select("feature")
        m = m.join(keep, "feature", "left_semi")
    return m


def cut_table(df: DataFrame) -> DataFrame:
    from massloom.session import cut

    return cut(df)


def sweep(run, settings: Sequence[dict]) -> list[dict]:
    """Runs a workflow for each set of parameters; a row with the number of features, or the error, of each."""
    out = []
    for s in settings:
        try:
            m = run(**s)
            r = m.agg(F.countDistinct("feature").alias("features"), F.countDistinct("sample").alias("samples"), F.count("value").alias("values")).first()
            out.append({**s, **r.asDict(), "error": None})
        except Exception as e:  # a failing set must not end the sweep
            out.append({**s, "features": None, "samples": None, "values": None, "error": str(e)[:200]})
    return out
