"""Queries of the engine's operators over the domain's tables, each with SQL for the same result.

Doubles that are sums or means are rounded alike on both sides, since the order of
summation differs. All queries run over their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators import batch, container, curation, dart, graph, matrix, metrics, peaks, raw
from massloom.operators.hotdeck import usable_area, usable_class
from massloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STUDY = ["healthy", "disease", "treated", "untreated", "none-dosed", "na-diet"]
QC, BLANK, DILUTION = ["qc"], ["blank"], ["dilution qc"]
#: masses that queries look for
TARGETS = [(1, 145.4306), (2, 380.5244), (3, 627.5297), (4, 742.2725), (5, 875.6767)]
SHIFTS = [("Na", 21.981944), ("NH4", 17.026549), ("13C1", 1.003355), ("13C2", 2.00671), ("CH3OH", 32.026215)]


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row for each injection, class in lower case or NULL."""
    s = usable_class(table(spark, d, "sample_metadata"), table(spark, d, "sample_class"))
    return s.groupBy(F.col("sample_id").alias("sample")).agg(F.max("study").alias("study"), F.lower(F.max("clean_class")).alias("class"), F.max("run_order").alias("ord"), F.max("batch").alias("batch"), F.max(matrix.null_if_nan(F.col("dilution"))).alias("dilution"), F.max("id").alias("subject"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The data matrix in long form: (sample, feature, value), each cell once."""
    return table(spark, d, "data_matrix").groupBy("cell_id").agg(F.max("sample_id").alias("sample"), F.max("feature_id").alias("feature"), F.max(usable_area(F.col("area"))).alias("value")).drop("cell_id")


def long_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The data matrix in long form with its samples' metadata."""
    return cells(spark, d).join(samples(spark, d), "sample", "left")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Readings as signals of the runs they were recorded in."""
    r = table(spark, d, "chromatogram").filter("time is not null").withColumn("spint", usable_area(F.col("spint"))).filter("spint is not null")
    t = table(spark, d, "trace")
    # a reading is a trace's scan, whose sample stands with the trace: four numbers are made distinct
    of_trace = ["sample"] if "sample" in t.columns else []
    own = r.select("trace_id", "scan", "time", "spint", *[c for c in ("sample",) if c not in of_trace]).distinct()
    return own.join(t.select("trace_id", "mz", *of_trace), "trace_id").select("trace_id", "sample", "scan", "time", "spint", "mz")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    """Spectrum of each injection: the masses of its features with their areas."""
    f = table(spark, d, "feature_metadata").select(F.col("feature_id").alias("feature"), matrix.null_if_nan(F.col("mz")).alias("mz")).filter("mz is not null")
    return long_matrix(spark, d).filter("value > 0").select("sample", "feature", "study", "class", "batch", F.col("value").alias("spint")).join(f, "feature")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Features with mass and retention as written."""
    f = table(spark, d, "feature_metadata").select("feature_id", "study", matrix.null_if_nan(F.col("mz")).alias("mz"), matrix.null_if_nan(F.col("rt")).alias("rt"), "rt_start", "rt_end", "polarity", "charge", "top_sample_id")
    return f.filter("mz is not null and rt is not null")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "target int, mz_target double")


_VALUES = ", ".join(f"({i}, CAST({m} AS DOUBLE))" for i, m in TARGETS)
BASE = f"""
    s AS (SELECT sample_id AS sample, max(study) AS study,
                 max(CASE WHEN lower(trim(class)) IN (SELECT lower(trim(class)) FROM sample_class) THEN lower(trim(class)) END) AS class,
                 max(run_order) AS ord, max(batch) AS batch, max(CASE WHEN NOT isnan(dilution) THEN dilution END) AS dilution, max(id) AS subject
          FROM sample_metadata GROUP BY 1),
    c AS (SELECT cell_id, max(sample_id) AS sample, max(feature_id) AS feature, max(CASE WHEN isfinite(area) AND area >= 0 THEN area END) AS value
          FROM data_matrix GROUP BY 1),
    m AS (SELECT c.sample, c.feature, c.value, s.study, s.class, s.ord, s.batch, s.dilution, s.subject FROM c LEFT JOIN s ON c.sample = s.sample),
    g AS (SELECT r.*, t.mz FROM (SELECT DISTINCT sample, trace_id, scan, time, spint FROM chromatogram
          WHERE time IS NOT NULL AND isfinite(spint) AND spint >= 0) r JOIN trace t ON r.trace_id = t.trace_id),
    f AS (SELECT feature_id, study, mz, rt, rt_start, rt_end, polarity, charge, top_sample_id FROM feature_metadata
          WHERE mz IS NOT NULL AND NOT isnan(mz) AND rt IS NOT NULL AND NOT isnan(rt)),
    sp AS (SELECT m.sample, m.feature, m.study, m.class, m.batch, m.value AS spint, x.mz FROM m JOIN feature_metadata x ON x.feature_id = m.feature
           WHERE m.value > 0 AND x.mz IS NOT NULL AND NOT isnan(x.mz)),
    q AS (SELECT * FROM (VALUES {_VALUES}) AS v(target, mz_target))"""
_STUDY = "('healthy', 'disease', 'treated', 'untreated', 'none-dosed', 'na-diet')"


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` follows the common tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            head = "WITH RECURSIVE" if text.startswith("WITH RECURSIVE") else "WITH"
            SQL[name] = f"{head} {BASE},\n{text[len(head):].strip()}" if text.upper().startswith("WITH") else f"WITH {BASE}\n{text}"
        return f

    return add


def r4(c, n: int = 4):
    """Rounded alike on both sides; infinite and NaN values pass."""
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- raw signals


@query("raw_tic", "SELECT sample, scan, round(sum(spint), 3) AS tic FROM g GROUP BY 1, 2")
def raw_tic(spark, d):
    return raw.chromatogram_total(signals(spark, d)).withColumn("tic", r4("tic", 3))


@query("raw_bpi", "SELECT sample, scan, max(spint) AS bpi FROM g GROUP BY 1, 2")
def raw_bpi(spark, d):
    return raw.chromatogram_total(signals(spark, d), "bpi")


@query("raw_scan_filter", "SELECT sample, count(*) AS n, round(sum(spint), 3) AS total FROM g WHERE scan >= 5 AND scan < 60 AND time >= 100 AND time < 900 GROUP BY 1")
def raw_scan_filter(spark, d):
    return raw.scans(signals(spark, d), None, 5, 60, 100.0, 900.0).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("spint"), 3).alias("total"))


for _acc in ("sum", "mean"):

    @query(
        f"raw_eic_{_acc}",
        f"""SELECT a.sample, a.target, coalesce(round({'sum' if _acc == 'sum' else 'avg'}(sp.spint), 4), 0) AS spint
            FROM (SELECT DISTINCT sample, target FROM sp CROSS JOIN q) a JOIN q ON q.target = a.target
            LEFT JOIN sp ON sp.sample = a.sample AND sp.mz >= q.mz_target - 0.05 AND sp.mz < q.mz_target + 0.05 GROUP BY 1, 2""",
    )
    def raw_eic(spark, d, acc=_acc):
        one = spectra(spark, d).withColumn("scan", F.lit(0))
        return raw.extracted_chromatograms(one, targets(spark), 0.05, acc).select("sample", "target", r4("spint").alias("spint"))


@query(
    "raw_nearest",
    """SELECT sample, target, mz_target, arg_min(mz, {'d': abs(mz - mz_target), 'm': -mz}) AS mz FROM sp JOIN q ON abs(mz - mz_target) <= 0.02 GROUP BY 1, 2, 3""",
)
def raw_nearest(spark, d):
    return raw.nearest(spectra(spark, d), targets(spark), 0.02).drop("spint")


@query(
    "raw_most_abundant",
    """SELECT sample, target, arg_max(mz, {'i': spint, 'm': -mz}) AS mz, max(spint) AS spint, round((arg_max(mz, {'i': spint, 'm': -mz}) - any_value(mz_target)) / any_value(mz_target) * 1e6, 3) AS ppm
       FROM sp JOIN q ON abs(mz - mz_target) <= 0.02 GROUP BY 1, 2""",
)
def raw_most_abundant(spark, d):
    return raw.most_abundant(spectra(spark, d), targets(spark), 0.02).select("sample", "target", "mz", "spint", r4("ppm", 3).alias("ppm"))


@query(
    "raw_match_reduce",
    """WITH own AS (SELECT sample, mz, spint, arg_min(target, {'d': abs(mz - mz_target), 't': mz_target}) AS target FROM sp JOIN q ON abs(mz - mz_target) <= 0.05 GROUP BY 1, 2, 3)
       SELECT sample, target, round(avg(mz), 5) AS mz, round(sum(spint), 3) AS spint FROM own GROUP BY 1, 2""",
)
def raw_match_reduce(spark, d):
    return raw.match_targets(spectra(spark, d), targets(spark), 0.05).select("sample", "target", r4("mz", 5).alias("mz"), r4("spint", 3).alias("spint"))


@query(
    "raw_match_closest",
    """WITH own AS (SELECT sample, mz, spint, min(abs(mz - mz_target)) AS dist, arg_min(target, {'d': abs(mz - mz_target), 't': mz_target}) AS target FROM sp JOIN q ON abs(mz - mz_target) <= 0.05 GROUP BY 1, 2, 3)
       SELECT sample, target, arg_min(mz, {'d': dist, 'm': mz}) AS mz FROM own GROUP BY 1, 2""",
)
def raw_match_closest(spark, d):
    return raw.match_targets(spectra(spark, d), targets(spark), 0.05, "closest").drop("spint")


@query("raw_seed_filter", "SELECT sample, count(*) AS n, round(sum(spint), 3) AS total FROM sp WHERE EXISTS (SELECT 1 FROM q WHERE abs(sp.mz - q.mz_target) <= 0.05) GROUP BY 1")
def raw_seed_filter(spark, d):
    return raw.near_seeds(spectra(spark, d), targets(spark), 0.05).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("spint"), 3).alias("total"))


@query(
    "raw_closest_scan",
    """WITH u AS (SELECT DISTINCT trace_id, scan, time FROM g), t AS (SELECT * FROM (VALUES (1, 200.0), (2, 600.0)) AS v(query, tq))
       SELECT trace_id, query, arg_min(scan, {'d': abs(time - CAST(tq AS DOUBLE)), 't': -time, 's': -scan}) AS scan FROM u CROSS JOIN t GROUP BY 1, 2""",
)
def raw_closest_scan(spark, d):
    times = spark.createDataFrame([(1, 200.0), (2, 600.0)], "query int, t double")
    return raw.closest_scan(signals(spark, d), times, ["trace_id"]).select("trace_id", "query", "scan")


@query(
    "raw_accumulate",
    """SELECT sample, CAST(floor(mz / 0.5) AS BIGINT) AS cell, round(avg(mz), 5) AS mz, round(sum(CASE WHEN time >= 300 AND time < 500 THEN spint ELSE -spint END), 3) AS spint
       FROM g WHERE time >= 200 AND time < 600 GROUP BY 1, 2 HAVING sum(CASE WHEN time >= 300 AND time < 500 THEN spint ELSE -spint END) > 0""",
)
def raw_accumulate(spark, d):
    return raw.accumulate(signals(spark, d), 0.5, 300.0, 500.0, 200.0, 600.0).select("sample", "cell", r4("mz", 5).alias("mz"), r4("spint", 3).alias("spint"))


@query(
    "raw_accumulate_linked",
    """WITH u AS (SELECT DISTINCT sample, mz FROM g WHERE time >= 200 AND time < 600), n AS (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY sample ORDER BY mz) <= 0.5 THEN NULL ELSE mz END AS b FROM u),
       l AS (SELECT sample, mz, last_value(b IGNORE NULLS) OVER (PARTITION BY sample ORDER BY mz ROWS UNBOUNDED PRECEDING) AS ion FROM n)
       SELECT g.sample, ion, round(avg(g.mz), 5) AS mz, round(sum(CASE WHEN time >= 300 AND time < 500 THEN spint ELSE -spint END), 3) AS spint FROM g JOIN l ON l.sample = g.sample AND l.mz = g.mz
       WHERE time >= 200 AND time < 600 GROUP BY 1, 2 HAVING sum(CASE WHEN time >= 300 AND time < 500 THEN spint ELSE -spint END) > 0""",
)
def raw_accumulate_linked(spark, d):
    return raw.accumulate_linked(signals(spark, d), 0.5, 300.0, 500.0, 200.0, 600.0).select("sample", "ion", r4("mz", 5).alias("mz"), r4("spint", 3).alias("spint"))


@query(
    "raw_mz_deltas",
    """WITH x AS (SELECT sample, (lead(mz) OVER (PARTITION BY sample ORDER BY mz) - mz) / mz * 1e6 AS p FROM sp)
       SELECT sample, round(avg(p), 2) AS mean, round(stddev_pop(p), 2) AS std, round(quantile_cont(p, 0.25), 2) AS q25, round(quantile_cont(p, 0.5), 2) AS q50, round(quantile_cont(p, 0.99), 2) AS q99
       FROM x WHERE p IS NOT NULL GROUP BY 1""",
)
def raw_mz_deltas(spark, d):
    return raw.mass_steps(spectra(spark, d)).select("sample", *[r4(c, 2).alias(c) for c in ("mean", "std", "q25", "q50", "q99")])


@query("raw_import_filters", "SELECT sample, count(*) AS n FROM sp WHERE mz BETWEEN 150 AND 900 AND spint > 50 AND NOT mz BETWEEN 380.5 AND 380.6 GROUP BY 1")
def raw_import_filters(spark, d):
    s = raw.without_artefacts(raw.above(raw.mass_range(spectra(spark, d), 150.0, 900.0), 50.0), [(380.5, 380.6)])
    return s.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query("raw_subset", "SELECT trace_id, scan - 10 AS scan, max(spint) AS spint FROM g WHERE scan BETWEEN 10 AND 30 GROUP BY 1, 2")
def raw_subset(spark, d):
    return raw.slice_scans(signals(spark, d), 10, 30).groupBy("trace_id", "scan").agg(F.max("spint").alias("spint"))


@query(
    "raw_delete_scans",
    """WITH k AS (SELECT DISTINCT sample, scan FROM g WHERE scan % 7 <> 0), n AS (SELECT sample, scan, row_number() OVER (PARTITION BY sample ORDER BY scan) - 1 AS k FROM k)
       SELECT sample, max(k) AS last, count(*) AS n FROM n GROUP BY 1""",
)
def raw_delete_scans(spark, d):
    s = signals(spark, d)
    left = raw.delete_scans(s, s.filter("scan % 7 = 0"))
    return left.groupBy("sample").agg(F.max("scan").cast("bigint").alias("last"), F.countDistinct("scan").alias("n"))


@query(
    "raw_neighbourhood",
    """WITH x AS (SELECT sample, mz, coalesce((mz - lag(mz) OVER w) / mz * 1e6, 250) AS a, coalesce((lead(mz) OVER w - mz) / mz * 1e6, 250) AS b FROM sp WINDOW w AS (PARTITION BY sample ORDER BY mz, spint))
       SELECT sample, round(avg(a), 2) AS before, round(avg(b), 2) AS after FROM x GROUP BY 1""",
)
def raw_neighbourhood(spark, d):
    n = raw.neighbourhood(spectra(spark, d).withColumn("scan", F.lit(0)))
    return n.groupBy("sample").agg(r4(F.avg("ppm_before"), 2).alias("before"), r4(F.avg("ppm_after"), 2).alias("after"))


@query(
    "raw_targeted_roi",
    """WITH h AS (SELECT DISTINCT trace_id, scan FROM g JOIN q ON abs(mz - mz_target) <= 0.05), n AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY trace_id ORDER BY scan) > 2 THEN 1 ELSE 0 END AS b FROM h),
            r AS (SELECT *, sum(b) OVER (PARTITION BY trace_id ORDER BY scan) AS run FROM n)
       SELECT trace_id, min(scan) AS first_scan, max(scan) AS last_scan, count(*) AS n FROM r GROUP BY trace_id, run""",
)
def raw_targeted_roi(spark, d):
    return raw.targeted_runs(signals(spark, d), targets(spark), 0.05, 1, "trace_id").select("trace_id", "first_scan", "last_scan", "n")


@query("raw_roi")
def raw_roi(spark, d):
    return raw.regions(signals(spark, d), 0.01, 1, 20).select("sample", "roi_index", F.size("scan").alias("length"), F.round(F.array_max("spint"), 3).alias("top"))


# ---------------------------------------------------------------- peaks


@query(
    "pk_local_maxima",
    """WITH x AS (SELECT trace_id, scan, spint, lag(spint) OVER w AS a, lead(spint) OVER w AS b FROM g WINDOW w AS (PARTITION BY trace_id ORDER BY scan))
       SELECT trace_id, scan, spint FROM x WHERE spint > a AND spint > b""",
)
def pk_local_maxima(spark, d):
    return peaks.local_maxima(signals(spark, d), ["trace_id"], "scan", "spint").select("trace_id", "scan", "spint")


@query(
    "pk_trapezoid",
    """WITH x AS (SELECT trace_id, (scan - lag(scan) OVER w) * (spint + lag(spint) OVER w) / 2.0 AS p FROM g WINDOW w AS (PARTITION BY trace_id ORDER BY scan))
       SELECT trace_id, coalesce(round(sum(p), 3), 0) AS area FROM x GROUP BY 1""",
)
def pk_trapezoid(spark, d):
    return peaks.trapezoid(signals(spark, d), ["trace_id"], "scan", "spint").withColumn("area", r4("area", 3))


@query("pk_weighted_position", "SELECT trace_id, round(sum(scan * spint) / nullif(sum(spint), 0), 4) AS position FROM g GROUP BY 1")
def pk_weighted_position(spark, d):
    return peaks.weighted_position(signals(spark, d), ["trace_id"], "scan", "spint").withColumn("position", r4("position"))


@query(
    "pk_width95",
    """WITH x AS (SELECT trace_id, scan, sum(CAST(round(spint * 10) AS BIGINT)) OVER (PARTITION BY trace_id ORDER BY scan) AS c, sum(CAST(round(spint * 10) AS BIGINT)) OVER (PARTITION BY trace_id) AS t FROM g)
       SELECT trace_id, min(scan) FILTER (c >= 0.975 * t) - min(scan) FILTER (c >= 0.025 * t) AS width FROM x GROUP BY 1""",
)
def pk_width95(spark, d):
    s = signals(spark, d).withColumn("y", F.round(F.col("spint") * 10).cast("bigint"))
    lo, hi = F.lit("0.025").cast("decimal(4,3)"), F.lit("0.975").cast("decimal(4,3)")
    from pyspark.sql import Window

    w = Window.partitionBy("trace_id")
    c = s.withColumn("_c", F.sum("y").over(w.orderBy("scan").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("y").over(w))
    return c.groupBy("trace_id").agg((F.min(F.when(F.col("_c") >= hi * F.col("_t"), F.col("scan"))) - F.min(F.when(F.col("_c") >= lo * F.col("_t"), F.col("scan")))).alias("width"))


@query(
    "pk_smooth",
    """SELECT trace_id, scan, round((coalesce(lag(spint) OVER w, 0) + 2 * spint + coalesce(lead(spint) OVER w, 0)) / (2 + CASE WHEN lag(spint) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(spint) OVER w IS NULL THEN 0 ELSE 1 END), 4) AS smooth
       FROM g WINDOW w AS (PARTITION BY trace_id ORDER BY scan)""",
)
def pk_smooth(spark, d):
    return peaks.smooth(signals(spark, d), ["trace_id"], "scan", "spint", [1.0, 2.0, 1.0]).select("trace_id", "scan", r4("smooth").alias("smooth"))


@query(
    "pk_fill_gaps",
    """WITH u AS (SELECT DISTINCT trace_id, scan, CASE WHEN isfinite(spint) AND spint >= 0 THEN spint END AS y FROM chromatogram),
       x AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN scan END IGNORE NULLS) OVER w AS xa, last_value(y IGNORE NULLS) OVER w AS ya,
                    first_value(CASE WHEN y IS NOT NULL THEN scan END IGNORE NULLS) OVER v AS xb, first_value(y IGNORE NULLS) OVER v AS yb
             FROM u WINDOW w AS (PARTITION BY trace_id ORDER BY scan ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY trace_id ORDER BY scan ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT trace_id, scan, round(CASE WHEN y IS NOT NULL THEN y WHEN xa IS NULL THEN yb WHEN xb IS NULL THEN ya ELSE ya + (yb - ya) * (scan - xa) / (xb - xa) END + 1e-7, 4) AS filled FROM x WHERE y IS NULL""",
)
def pk_fill_gaps(spark, d):
    u = table(spark, d, "chromatogram").select("trace_id", "scan", usable_area(F.col("spint")).alias("y")).distinct()
    return peaks.fill_missing_points(u, ["trace_id"], "scan", "y").filter("y is null").select("trace_id", "scan", r4(F.col("filled") + 1e-7).alias("filled"))


@query("pk_detect")
def pk_detect(spark, d):
    t = peaks.to_traces(signals(spark, d).withColumn("x", F.col("scan").cast("double")), ["trace_id"], "scan", ["x", "spint"]).withColumnRenamed("x", "time")
    return peaks.within(peaks.detect(t, ["trace_id"]), {"snr": (5.0, None)}).drop("mz", "mz_std")


@query(
    "pk_similarity",
    """WITH v AS (SELECT feature, sample, value FROM m WHERE value > 0 AND class = 'qc'), n AS (SELECT feature, sqrt(sum(value * value)) AS n, count(*) AS k FROM v GROUP BY 1),
       p AS (SELECT x.feature_id AS a, y.feature_id AS b FROM f x JOIN f y ON x.study = y.study AND x.polarity = y.polarity AND x.feature_id < y.feature_id AND abs(x.mz - y.mz) < 2.1),
       d AS (SELECT a, b, sum(v.value * w.value) AS dot, count(*) AS k FROM p JOIN v ON v.feature = a JOIN v w ON w.feature = b AND w.sample = v.sample GROUP BY 1, 2)
       SELECT p.a, p.b, round(CASE WHEN coalesce(d.k, 0) / least(na.k, nb.k) > 0.5 THEN coalesce(dot / nullif(na.n * nb.n, 0), 0) ELSE 0 END, 6) AS similarity
       FROM p JOIN n na ON na.feature = a JOIN n nb ON nb.feature = b LEFT JOIN d ON d.a = p.a AND d.b = p.b""",
)
def pk_similarity(spark, d):
    v = long_matrix(spark, d).filter("value > 0 and class = 'qc'")
    p = points(spark, d).withColumn("z", F.lit(0.0))
    pairs = matrix.range_pairs(p, "feature_id", "mz", "z", 2.1, 1.0, ["study", "polarity"])
    return peaks.similarity(v, "feature", ["sample"], "value", pairs).select("a", "b", r4("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- matrix


@query("mat_long", "SELECT sample, feature, value, class, batch FROM m")
def mat_long(spark, d):
    return long_matrix(spark, d).select("sample", "feature", "value", "class", "batch")


@query("mat_pivot", "SELECT feature, round(sum(value) FILTER (class = 'qc'), 3) AS qc, round(sum(value) FILTER (class = 'blank'), 3) AS blank, round(sum(value) FILTER (class = 'healthy'), 3) AS healthy FROM m GROUP BY 1")
def mat_pivot(spark, d):
    p = long_matrix(spark, d).groupBy("feature").pivot("class", ["qc", "blank", "healthy"]).agg(F.sum("value"))
    return p.select("feature", *[r4(c, 3).alias(c) for c in ("qc", "blank", "healthy")])


@query(
    "mat_feature_metadata",
    """SELECT CAST(floor(mz / 0.5) AS BIGINT) AS cluster, round(avg(mz) + 1e-9, 6) AS mz_mean, round(stddev_samp(mz), 6) AS mz_std, min(mz) AS mz_min, max(mz) AS mz_max, round(avg(rt) + 1e-7, 3) AS rt_mean, min(rt) AS rt_min, max(rt) AS rt_max FROM f GROUP BY 1""",
)
def mat_feature_metadata(spark, d):
    out = matrix.feature_metadata(points(spark, d).withColumn("cluster", F.floor(F.col("mz") / 0.5)))
    return out.select("cluster", r4(F.col("mz_mean") + 1e-9, 6).alias("mz_mean"), r4("mz_std", 6).alias("mz_std"), "mz_min", "mz_max", r4(F.col("rt_mean") + 1e-7, 3).alias("rt_mean"), "rt_min", "rt_max")


@query("mat_merge_candidates", "SELECT x.feature_id AS a, y.feature_id AS b FROM f x JOIN f y ON x.study = y.study AND x.feature_id < y.feature_id AND abs(x.mz - y.mz) < 0.02 AND abs(x.rt - y.rt) < 10")
def mat_merge_candidates(spark, d):
    return matrix.range_pairs(points(spark, d), "feature_id", "mz", "rt", 0.02, 10.0, ["study"]).select("a", "b")


@query(
    "mat_codetection",
    """WITH p AS (SELECT x.feature_id AS a, y.feature_id AS b FROM f x JOIN f y ON x.study = y.study AND x.feature_id < y.feature_id AND abs(x.mz - y.mz) < 2.1),
       e AS (SELECT sample, feature FROM m WHERE value IS NOT NULL), n AS (SELECT feature, count(*) AS k FROM e GROUP BY 1),
       d AS (SELECT a, b, count(*) AS k FROM p JOIN e ON e.feature = a JOIN e h ON h.feature = b AND h.sample = e.sample GROUP BY 1, 2)
       SELECT p.a, p.b, coalesce(d.k, 0) AS both, coalesce(na.k, 0) + coalesce(nb.k, 0) - coalesce(d.k, 0) AS any FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN n na ON na.feature = p.a LEFT JOIN n nb ON nb.feature = p.b""",
)
def mat_codetection(spark, d):
    pairs = matrix.range_pairs(points(spark, d).withColumn("z", F.lit(0.0)), "feature_id", "mz", "z", 2.1, 1.0, ["study"])
    return matrix.codetection(long_matrix(spark, d), pairs).select("a", "b", "both", "any")


@query(
    "mat_merge_close",
    """WITH RECURSIVE p AS (SELECT x.feature_id AS a, y.feature_id AS b FROM f x JOIN f y ON x.study = y.study AND x.feature_id < y.feature_id AND abs(x.mz - y.mz) < 0.02 AND abs(x.rt - y.rt) < 10),
       e AS (SELECT sample, feature FROM m WHERE value IS NOT NULL), n AS (SELECT feature, count(*) AS k FROM e GROUP BY 1), d AS (SELECT a, b, count(*) AS k FROM p JOIN e ON e.feature = a JOIN e h ON h.feature = b AND h.sample = e.sample GROUP BY 1, 2),
       o AS (SELECT p.a, p.b, coalesce(d.k, 0) AS n_both, coalesce(na.k, 0) + coalesce(nb.k, 0) - coalesce(d.k, 0) AS any_of FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN n na ON na.feature = p.a LEFT JOIN n nb ON nb.feature = p.b),
       l AS (SELECT a, b FROM o WHERE any_of > 0 AND n_both < 0.8 * any_of UNION SELECT b, a FROM o WHERE any_of > 0 AND n_both < 0.8 * any_of),
       r(k, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k), gr AS (SELECT k AS feature, min(root) AS component FROM r GROUP BY 1),
       i AS (SELECT component, arg_max(gr.feature, {'n': coalesce(n.k, 0), 'f': -gr.feature}) AS target FROM gr LEFT JOIN n ON n.feature = gr.feature WHERE gr.feature IN (SELECT feature FROM m) GROUP BY 1)
       SELECT sample, coalesce(target, m.feature) AS feature, round(sum(value), 4) AS value FROM m LEFT JOIN gr ON gr.feature = m.feature LEFT JOIN i ON i.component = gr.component GROUP BY 1, 2""",
)
def mat_merge_close(spark, d):
    pairs = matrix.range_pairs(points(spark, d), "feature_id", "mz", "rt", 0.02, 10.0, ["study"])
    return matrix.merge_close(long_matrix(spark, d), pairs).select("sample", "feature", r4("value", 4).alias("value"))


@query("mat_select_features", "SELECT feature_id, mz, rt FROM f WHERE abs(mz - 145.4306) < 0.05 AND abs(rt - 300.0) < 300")
def mat_select_features(spark, d):
    return matrix.select_features(points(spark, d), 145.4306, 300.0, 0.05, 300.0).select("feature_id", "mz", "rt")


@query("mat_remove", "SELECT feature, count(*) AS n FROM m WHERE sample NOT IN (SELECT sample FROM s WHERE class = 'blank') GROUP BY 1")
def mat_remove(spark, d):
    return matrix.remove(long_matrix(spark, d), samples(spark, d).filter("class = 'blank'"), "sample").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("mat_subset", "SELECT sample, feature, value FROM m WHERE class IN ('healthy', 'disease') AND batch = 1 AND (ord IS NULL OR ord NOT IN (3, 4))")
def mat_subset(spark, d):
    return matrix.subset(long_matrix(spark, d), {"class": ["healthy", "disease"], "batch": [1]}, {"ord": [3, 4]}).select("sample", "feature", "value")


@query(
    "mat_diagnose",
    f"""SELECT count(*) = 0 AS empty, bool_or(value IS NULL) AS missing, bool_or(coalesce(class = 'qc', false)) AS qc, bool_or(coalesce(class = 'blank', false)) AS blank,
        bool_or(coalesce(class IN {_STUDY}, false)) AS sample, bool_or(coalesce(class = 'dilution qc', false)) AS dqc, count(ord) > 0 AS "order", count(batch) > 0 AS batch FROM m""",
)
def mat_diagnose(spark, d):
    return matrix.diagnose(long_matrix(spark, d), QC, BLANK, STUDY, DILUTION)


@query(
    "mat_interbatch_order",
    """WITH b AS (SELECT study, batch, max(ord) AS x FROM s GROUP BY 1, 2), o AS (SELECT study, batch, coalesce(sum(x) OVER (PARTITION BY study ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b)
       SELECT sample, CAST(ord + off AS BIGINT) AS inter_order FROM s JOIN o ON s.study = o.study AND s.batch = o.batch""",
)
def mat_interbatch_order(spark, d):
    return matrix.interbatch_order(samples(spark, d), ["study"]).select("sample", F.col("inter_order").cast("bigint").alias("inter_order"))


@query("mat_default_order", "SELECT sample, CAST(row_number() OVER (PARTITION BY study ORDER BY sample) AS BIGINT) AS ord FROM s")
def mat_default_order(spark, d):
    return matrix.default_order(samples(spark, d), ["study"]).select("sample", F.col("ord").cast("bigint").alias("ord"))


@query(
    "mat_replicates",
    f"""WITH p AS (SELECT * FROM m WHERE class IN {_STUDY} AND subject IS NOT NULL), a AS (SELECT subject, min(sample) AS sample FROM p GROUP BY 1)
       SELECT a.sample, p.feature, round(avg(value), 4) AS value FROM p JOIN a ON a.subject = p.subject GROUP BY 1, 2
       UNION ALL SELECT sample, feature, round(value, 4) FROM m WHERE NOT coalesce(class IN {_STUDY} AND subject IS NOT NULL, false)""",
)
def mat_replicates(spark, d):
    return matrix.average_replicates(long_matrix(spark, d), "subject", STUDY).withColumn("value", r4("value"))


def study_tables(spark: SparkSession, d: str) -> container.Study:
    """All studies as one: cells of features with mass and retention, and of known injections."""
    f = points(spark, d).withColumnRenamed("feature_id", "feature")
    s = samples(spark, d)
    m = long_matrix(spark, d).select("sample", "feature", "value").join(f.select("feature"), "feature", "left_semi").join(s.select("sample"), "sample", "left_semi")
    return container.Study.of(m, f, s, {"qc": QC, "blank": BLANK, "dqc": DILUTION})


@query("mat_sorted", "SELECT feature_id AS feature, row_number() OVER (ORDER BY mz, feature_id) - 1 AS position FROM f")
def mat_sorted(spark, d):
    return study_tables(spark, d).sort("mz", "feature").ordered("feature").select("feature", "position")


@query("mat_groups", "SELECT class, count(*) AS samples FROM s GROUP BY 1")
def mat_groups(spark, d):
    return study_tables(spark, d).groups()


@query(
    "mat_annotations",
    """WITH a AS (SELECT CAST(floor(mz) AS BIGINT) AS l, feature_id, dense_rank() OVER (PARTITION BY CAST(floor(mz) AS BIGINT) ORDER BY mz) - 1 AS i, charge FROM f WHERE charge > 0)
       SELECT f.feature_id AS feature, mz, coalesce(l, -1) AS envelope_label, coalesce(i, -1) AS envelope_index, coalesce(a.charge, -1) AS charge FROM f LEFT JOIN a ON a.feature_id = f.feature_id""",
)
def mat_annotations(spark, d):
    from pyspark.sql import Window

    f = points(spark, d).withColumnRenamed("feature_id", "feature")
    place = F.dense_rank().over(Window.partitionBy(F.floor("mz")).orderBy("mz")) - 1
    a = f.filter("charge > 0").select("feature", F.floor("mz").alias("envelope_label"), place.cast("bigint").alias("envelope_index"), "charge")
    return container.attach_annotations(f.select("feature", "mz", "charge"), a).select("feature", "mz", "envelope_label", "envelope_index", "charge")


@query(
    "mat_flags",
    f"""WITH x AS (SELECT m.* FROM m JOIN f ON f.feature_id = m.feature JOIN s ON s.sample = m.sample),
       p AS (SELECT feature FROM (SELECT class, feature, count(*) FILTER (value > 0) / count(*) AS dr FROM x WHERE class IN ('qc', 'blank') GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(dr < 0.9 OR dr > 1)),
       v AS (SELECT feature FROM x WHERE class = 'qc' GROUP BY 1 HAVING NOT coalesce(stddev_samp(value) / nullif(avg(value), 0) BETWEEN 0 AND 0.25, false))
       SELECT feature_id AS feature, feature_id IN (SELECT feature FROM p) AS prevalence, feature_id IN (SELECT feature FROM v) AS variation FROM f""",
)
def mat_flags(spark, d):
    steps = [{"name": "prevalence", "classes": ["qc", "blank"], "low": 0.9}, {"name": "variation"}]
    return study_tables(spark, d).process(steps, mode="flag").features.select("feature", "prevalence", "variation")


@query("mat_islands", "WITH x AS (SELECT feature_id, polarity, mz, CASE WHEN mz - lag(mz) OVER (PARTITION BY polarity ORDER BY mz) <= 0.1 THEN NULL ELSE mz END AS n FROM f) SELECT feature_id, last_value(n IGNORE NULLS) OVER (PARTITION BY polarity ORDER BY mz ROWS UNBOUNDED PRECEDING) AS island FROM x")
def mat_islands(spark, d):
    return graph.islands(points(spark, d), ["polarity"], "mz", 0.1, "island", 25.0).select("feature_id", "island")


# ---------------------------------------------------------------- metrics

INF = "CAST('inf' AS DOUBLE)"


@query("met_cv", f"SELECT class, feature, coalesce(round(stddev_samp(value) / nullif(avg(value), 0), 6), {INF}) AS cv FROM m GROUP BY 1, 2")
def met_cv(spark, d):
    return metrics.cv(long_matrix(spark, d), ["class"], None).select("class", "feature", F.coalesce(r4("cv", 6), F.lit(float("inf"))).alias("cv"))


@query("met_cv_global", "SELECT feature, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv FROM m GROUP BY 1")
def met_cv_global(spark, d):
    return metrics.cv(long_matrix(spark, d), [], None).withColumn("cv", r4("cv", 6))


@query("met_cv_two_keys", "SELECT class, batch, feature, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv FROM m GROUP BY 1, 2, 3")
def met_cv_two_keys(spark, d):
    return metrics.cv(long_matrix(spark, d), ["class", "batch"], None).withColumn("cv", r4("cv", 6))


_MAD = "WITH a AS (SELECT class, feature, median(value) AS md, count(value) AS n FROM m GROUP BY 1, 2), b AS (SELECT m.class, m.feature, any_value(md) AS md, CASE WHEN any_value(n) > 1 THEN median(abs(value - md)) / 0.6744897501960817 END AS mad FROM m JOIN a ON a.feature = m.feature AND a.class = m.class GROUP BY 1, 2)"


@query("met_mad", _MAD + " SELECT class, feature, round(mad, 4) AS mad FROM b")
def met_mad(spark, d):
    return metrics.mad(long_matrix(spark, d).filter("class is not null")).select("class", "feature", r4("mad").alias("mad"))


@query("met_robust_cv", _MAD + " SELECT class, feature, round(mad / nullif(md, 0), 6) AS cv FROM b")
def met_robust_cv(spark, d):
    return metrics.robust_cv(long_matrix(spark, d).filter("class is not null"), fill=None).withColumn("cv", r4("cv", 6))


@query("met_dratio", f"SELECT feature, round(stddev_samp(value) FILTER (class = 'qc') / nullif(stddev_samp(value) FILTER (class IN {_STUDY}), 0), 6) AS dratio FROM m WHERE class = 'qc' OR class IN {_STUDY} GROUP BY 1")
def met_dratio(spark, d):
    x = metrics.dratio(long_matrix(spark, d), QC, STUDY)
    return x.select("feature", F.when(F.col("dratio") < float("inf"), r4("dratio", 6)).alias("dratio"))


@query(
    "met_dratio_robust",
    f"""WITH k AS (SELECT feature, CASE WHEN class = 'qc' THEN 'qc' ELSE 'sample' END AS kind, value FROM m WHERE class = 'qc' OR class IN {_STUDY}), a AS (SELECT kind, feature, median(value) AS md, count(value) AS n FROM k GROUP BY 1, 2),
       b AS (SELECT k.kind, k.feature, CASE WHEN any_value(n) > 1 THEN median(abs(value - md)) / 0.6744897501960817 END AS mad FROM k JOIN a ON a.feature = k.feature AND a.kind = k.kind GROUP BY 1, 2)
       SELECT feature, coalesce(round(max(mad) FILTER (kind = 'qc') / nullif(max(mad) FILTER (kind = 'sample'), 0), 5), {INF}) AS dratio FROM b GROUP BY 1""",
)
def met_dratio_robust(spark, d):
    return metrics.dratio(long_matrix(spark, d), QC, STUDY, robust=True).withColumn("dratio", r4("dratio", 5))


@query("met_detection_rate", "SELECT class, feature, round(count(*) FILTER (value > 0) / count(*), 6) AS dr FROM m GROUP BY 1, 2")
def met_detection_rate(spark, d):
    return metrics.detection_rate(long_matrix(spark, d)).withColumn("dr", r4("dr", 6))


@query(
    "met_ols",
    """WITH v AS (SELECT sample, feature, value, CAST(ord AS DOUBLE) AS x FROM m WHERE value IS NOT NULL AND ord IS NOT NULL AND class = 'qc'),
       l AS (SELECT feature, regr_slope(value, x) AS k, regr_intercept(value, x) AS b, regr_r2(value, x) AS r2, count(*) AS n FROM v GROUP BY 1),
       e AS (SELECT v.feature, v.x, v.sample, value - b - k * v.x AS e FROM v JOIN l ON l.feature = v.feature), w AS (SELECT *, e - lag(e) OVER (PARTITION BY feature ORDER BY x, sample) AS d FROM e),
       t AS (SELECT feature, sum(d * d) / nullif(sum(e * e), 0) AS dw FROM w GROUP BY 1)
       SELECT l.feature, n, CASE WHEN n > 2 THEN round(r2, 4) END AS r2, CASE WHEN n > 2 AND r2 < 0.9999 THEN round(dw, 3) END AS dw FROM l JOIN t ON t.feature = l.feature""",
)
def met_ols(spark, d):
    o = metrics.ols(long_matrix(spark, d).filter("class = 'qc'"), "ord")
    return o.select("feature", "n", F.when(F.col("n") > 2, r4("r2", 4)).alias("r2"), F.when((F.col("n") > 2) & (F.col("r2") < 0.9999), r4("dw", 3)).alias("dw"))


def _ols_sql(name: str, source: str) -> str:
    """Moments of the residuals of a linear fit of value on x."""
    return f"""{name}_l AS (SELECT feature, regr_slope(value, x) AS k, regr_intercept(value, x) AS b, regr_r2(value, x) AS r2, count(*) AS n FROM {source} GROUP BY 1),
       {name}_e AS (SELECT v.feature, avg(pow(value - b - k * x, 2)) AS m2, avg(pow(value - b - k * x, 3)) AS m3, avg(pow(value - b - k * x, 4)) AS m4 FROM {source} v JOIN {name}_l l ON l.feature = v.feature GROUP BY 1),
       {name} AS (SELECT l.feature, n, k, r2, n / 6.0 * (pow(m3 / nullif(pow(m2, 1.5), 0), 2) + pow(m4 / nullif(m2 * m2, 0) - 3, 2) / 4) AS jb FROM {name}_l l JOIN {name}_e e ON e.feature = l.feature)"""


@query(
    "met_jarque_bera",
    f"""WITH v AS (SELECT feature, value, CAST(ord AS DOUBLE) AS x FROM m WHERE value IS NOT NULL AND ord IS NOT NULL), {_ols_sql("t", "v")}
       SELECT feature, n, CASE WHEN n > 2 AND r2 < 0.9999 THEN round(jb, 3) END AS jb, CASE WHEN n > 2 AND r2 < 0.9999 THEN round(exp(-jb / 2), 4) END AS jb_p FROM t""",
)
def met_jarque_bera(spark, d):
    # the residuals of a perfect fit are rounding errors
    o, imperfect = metrics.ols(long_matrix(spark, d), "ord"), (F.col("n") > 2) & (F.col("r2") < 0.9999)
    return o.select("feature", "n", F.when(imperfect, r4("jb", 3)).alias("jb"), F.when(imperfect, r4("jb_p", 4)).alias("jb_p"))


@query("met_pearson", "SELECT feature, CASE WHEN stddev_pop(value) > 0 AND count(*) > 2 THEN round(corr(value, CAST(ord AS DOUBLE)), 5) END AS r FROM m WHERE value IS NOT NULL AND ord IS NOT NULL GROUP BY 1")
def met_pearson(spark, d):
    m = long_matrix(spark, d)
    ok = m.filter("value is not null and ord is not null").groupBy("feature").agg(((F.stddev_pop("value") > 0) & (F.count(F.lit(1)) > 2)).alias("ok"))
    return metrics.pearson(m, "ord").join(ok, "feature").select("feature", F.when(F.col("ok"), r4("r", 5)).alias("r"))


@query(
    "met_spearman",
    """WITH v AS (SELECT feature, sample, value, ord FROM m WHERE value IS NOT NULL AND ord IS NOT NULL),
       k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY ord) + (count(*) OVER (PARTITION BY feature, ord) - 1) / 2.0 AS b FROM v)
       SELECT feature, CASE WHEN stddev_pop(a) > 0 THEN round(corr(a, b), 5) + 0.0 END AS rho FROM k GROUP BY 1""",
)
def met_spearman(spark, d):
    return metrics.spearman(long_matrix(spark, d), "ord").withColumn("rho", r4("rho", 5) + 0.0)


@query(
    "met_pairwise",
    """SELECT x.feature AS a, y.feature AS b, CASE WHEN stddev_pop(x.value) > 0 AND stddev_pop(y.value) > 0 THEN round(corr(x.value, y.value), 4) END AS r, count(*) AS n
       FROM m x JOIN m y ON x.sample = y.sample AND x.study = y.study AND x.feature < y.feature WHERE x.class = 'qc' AND x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def met_pairwise(spark, d):
    m = long_matrix(spark, d).filter("class = 'qc'")
    return metrics.pairwise_correlation(m, "study", 5).withColumn("r", r4("r", 4))


@query("met_weighted", "SELECT feature, round(sum(spint * mz) / sum(spint), 6) AS mean, count(*) AS n FROM sp GROUP BY 1")
def met_weighted(spark, d):
    s = spectra(spark, d)
    return metrics.weighted_stats(s, ["feature"], "mz", "spint").join(s.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "feature").select("feature", r4("mean", 6).alias("mean"), "n")


_TWO = "WITH t AS (SELECT feature, count(value) FILTER (class = 'qc') AS n1, count(value) FILTER (class = 'blank') AS n2, avg(value) FILTER (class = 'qc') AS m1, avg(value) FILTER (class = 'blank') AS m2, var_samp(value) FILTER (class = 'qc') AS v1, var_samp(value) FILTER (class = 'blank') AS v2 FROM m WHERE class IN ('qc', 'blank') GROUP BY 1)"


@query("met_cohen_d", _TWO + " SELECT feature, CASE WHEN n1 + n2 > 2 THEN round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 4) END AS cohen_d FROM t")
def met_cohen_d(spark, d):
    return metrics.cohen_d(metrics.two_groups(long_matrix(spark, d), QC, BLANK)).select("feature", r4("cohen_d").alias("cohen_d"))


@query("met_overview", "WITH a AS (SELECT class, feature, count(value) AS detected FROM m GROUP BY 1, 2) SELECT class, detected, count(*) AS features FROM a GROUP BY 1, 2")
def met_overview(spark, d):
    return metrics.overview(long_matrix(spark, d))


@query("met_pipeline", "WITH a AS (SELECT class, feature, coalesce(stddev_samp(value) / nullif(avg(value), 0), 0) AS cv FROM m GROUP BY 1, 2), b AS (SELECT feature, median(cv) AS cv FROM a GROUP BY 1) SELECT (SELECT count(DISTINCT feature) FROM m) AS features, (SELECT count(DISTINCT sample) FROM m) AS samples, round(median(cv), 6) AS cv FROM b")
def met_pipeline(spark, d):
    return metrics.pipeline_metrics(long_matrix(spark, d)).withColumn("cv", r4("cv", 6))


@query("met_recovery", "SELECT q.target, q.mz_target, arg_min(feature_id, {'d': abs(mz - mz_target), 'f': feature_id}) AS feature FROM q LEFT JOIN f ON abs(mz - mz_target) <= mz_target * 20 / 1e6 GROUP BY 1, 2")
def met_recovery(spark, d):
    return dart.recovery(points(spark, d).withColumnRenamed("feature_id", "feature"), targets(spark), 20.0).select("target", "mz_target", "feature")


@query("met_pca")
def met_pca(spark, d):
    return metrics.pca_by(long_matrix(spark, d), "study")


# ---------------------------------------------------------------- curation

for _how, _by in (("sum", "sum(value)"), ("max", "max(value)"), ("euclidean", "sqrt(sum(value * value))")):

    @query(f"norm_{_how}", f"WITH t AS (SELECT sample, {_by} AS z FROM m GROUP BY 1) SELECT m.sample, feature, coalesce(round(value / nullif(z, 0), 8), 0) AS value FROM m JOIN t ON t.sample = m.sample")
    def norm(spark, d, how=_how):
        return curation.normalize(long_matrix(spark, d), how).select("sample", "feature", r4("value", 8).alias("value"))


@query("norm_feature", "WITH k AS (SELECT min(feature) AS k FROM m), t AS (SELECT sample, max(CASE WHEN feature = k THEN value END) AS z FROM m CROSS JOIN k GROUP BY 1) SELECT m.sample, feature, coalesce(round(value / nullif(z, 0), 6), 0) AS value FROM m JOIN t ON t.sample = m.sample")
def norm_feature(spark, d):
    m = long_matrix(spark, d)
    first = m.agg(F.min("feature")).first()[0]
    return curation.normalize(m, "feature", first).select("sample", "feature", r4("value", 6).alias("value"))


for _how, _top, _low in (("autoscaling", "value - a", "s"), ("rescaling", "value - lo", "hi - lo"), ("pareto", "value - a", "sqrt(s)")):

    @query(f"scale_{_how}", f"WITH t AS (SELECT feature, avg(value) AS a, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1) SELECT sample, m.feature, coalesce(round(({_top}) / nullif({_low}, 0), 4), 0) + 0.0 AS value FROM m JOIN t ON t.feature = m.feature")
    def scale(spark, d, how=_how):
        return curation.scale(long_matrix(spark, d), how).select("sample", "feature", (r4("value", 4) + 0.0).alias("value"))


@query("trans_log", "SELECT sample, feature, CASE WHEN value > 0 THEN round(log10(value), 6) END AS value FROM m WHERE value IS NULL OR value > 0")
def trans_log(spark, d):
    return curation.transform(long_matrix(spark, d).filter("value is null or value > 0"), "log").select("sample", "feature", r4("value", 6).alias("value"))


@query("trans_power", "SELECT sample, feature, round(sqrt(value), 6) AS value FROM m")
def trans_power(spark, d):
    return curation.transform(long_matrix(spark, d), "power").select("sample", "feature", r4("value", 6).alias("value"))


for _mode, _lvl in (("mean", "avg(value)"), ("lod", "avg(value) + 3 * coalesce(stddev_samp(value), 0)"), ("loq", "avg(value) + 10 * coalesce(stddev_samp(value), 0)"), ("max", "max(value)")):

    @query(
        f"cur_blank_{_mode}",
        f"""WITH b AS (SELECT feature, {_lvl} AS z FROM m WHERE class = 'blank' GROUP BY 1)
            SELECT sample, m.feature, CASE WHEN value < coalesce(z, 0) THEN 0.0 ELSE round(value - coalesce(z, 0), 4) END AS value FROM m LEFT JOIN b ON b.feature = m.feature""",
    )
    def cur_blank(spark, d, mode=_mode):
        return curation.correct_blanks(long_matrix(spark, d), BLANK, mode=mode, robust=False).select("sample", "feature", r4("value", 4).alias("value"))


@query(
    "cur_blank_robust",
    """WITH k AS (SELECT feature, median(value) AS md, count(value) AS n FROM m WHERE class = 'blank' GROUP BY 1),
       b AS (SELECT k.feature, any_value(md) + 3 * coalesce(CASE WHEN any_value(n) > 1 THEN median(abs(value - md)) / 0.6744897501960817 END, 0) AS z FROM m JOIN k ON k.feature = m.feature WHERE class = 'blank' GROUP BY 1)
       SELECT sample, m.feature, CASE WHEN value < coalesce(z, 0) THEN 0.0 ELSE round(value - coalesce(z, 0), 4) END AS value FROM m LEFT JOIN b ON b.feature = m.feature""",
)
def cur_blank_robust(spark, d):
    return curation.correct_blanks(long_matrix(spark, d), BLANK, mode="lod", robust=True).select("sample", "feature", r4("value", 4).alias("value"))


@query("cur_class_remover", "SELECT class, count(*) AS n FROM m WHERE class IS NULL OR class NOT IN ('qc', 'blank') GROUP BY 1")
def cur_class_remover(spark, d):
    return curation.remove_classes(long_matrix(spark, d), ["qc", "blank"]).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("cur_prevalence", f"WITH a AS (SELECT class, feature, count(*) FILTER (value > 0) / count(*) AS dr FROM m WHERE class IN {_STUDY} GROUP BY 1, 2) SELECT feature FROM a GROUP BY 1 HAVING bool_and(dr < 0.9 OR dr > 1)")
def cur_prevalence(spark, d):
    return curation.prevalence(long_matrix(spark, d), STUDY, 0.9)


@query("cur_prevalence_global", f"SELECT feature FROM m WHERE class IN {_STUDY} GROUP BY 1 HAVING count(*) FILTER (value > 0) / count(*) < 0.9")
def cur_prevalence_global(spark, d):
    return curation.prevalence(long_matrix(spark, d), STUDY, 0.9, intraclass=False)


@query("cur_variation", f"WITH a AS (SELECT class, feature, coalesce(stddev_samp(value) / nullif(avg(value), 0), {INF}) AS cv FROM m WHERE class = 'qc' GROUP BY 1, 2) SELECT feature FROM a GROUP BY 1 HAVING bool_and(cv < 0 OR cv > 0.25)")
def cur_variation(spark, d):
    return curation.variation(long_matrix(spark, d), QC)


@query("cur_dratio", f"SELECT feature FROM m WHERE class = 'qc' OR class IN {_STUDY} GROUP BY 1 HAVING coalesce(stddev_samp(value) FILTER (class = 'qc') / nullif(stddev_samp(value) FILTER (class IN {_STUDY}), 0), {INF}) > 0.5")
def cur_dratio(spark, d):
    return curation.dratio_filter(long_matrix(spark, d), QC, STUDY)


@query("cur_dilution", "WITH v AS (SELECT feature, value, dilution FROM m WHERE class = 'dilution qc'), o AS (SELECT feature FROM v WHERE value IS NOT NULL AND dilution IS NOT NULL GROUP BY 1 HAVING stddev_pop(value) > 0 AND stddev_pop(dilution) > 0 AND corr(value, dilution) >= 0.8) SELECT DISTINCT feature FROM v WHERE feature NOT IN (SELECT feature FROM o)")
def cur_dilution(spark, d):
    return curation.dilution_filter(long_matrix(spark, d), DILUTION, 0.8, mode="pearson")


@query(
    "cur_dilution_ols",
    f"""WITH v AS (SELECT feature, value, dilution AS x FROM m WHERE class = 'dilution qc' AND value IS NOT NULL AND dilution IS NOT NULL), {_ols_sql("t", "v")}
       SELECT DISTINCT feature FROM m WHERE class = 'dilution qc' AND feature NOT IN (SELECT feature FROM t WHERE r2 >= 0.8 AND (r2 > 1 - 1e-12 AND abs(k) > 1e-12 OR r2 <= 1 - 1e-12 AND exp(-jb / 2) >= 0.1))""",
)
def cur_dilution_ols(spark, d):
    return curation.dilution_filter(long_matrix(spark, d), DILUTION)


@query(
    "cur_pipeline",
    f"""WITH b AS (SELECT feature, avg(value) + 3 * coalesce(stddev_samp(value), 0) AS z FROM m WHERE class = 'blank' GROUP BY 1),
       m1 AS (SELECT sample, m.feature, class, CASE WHEN value - coalesce(z, 0) < 0 THEN 0.0 ELSE value - coalesce(z, 0) END AS value FROM m LEFT JOIN b ON b.feature = m.feature),
       p AS (SELECT feature FROM (SELECT feature, class, count(*) FILTER (value > 0) / count(*) AS dr FROM m1 WHERE class IN {_STUDY} GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(dr < 0.5 OR dr > 1)),
       m2 AS (SELECT * FROM m1 WHERE feature NOT IN (SELECT feature FROM p)),
       v AS (SELECT feature FROM m2 WHERE class = 'qc' GROUP BY 1 HAVING coalesce(stddev_samp(value) / nullif(avg(value), 0), {INF}) > 0.4 OR stddev_samp(value) / nullif(avg(value), 0) < 0),
       m3 AS (SELECT * FROM m2 WHERE feature NOT IN (SELECT feature FROM v)), t AS (SELECT sample, sum(value) AS z FROM m3 GROUP BY 1)
       SELECT m3.sample, feature, class, coalesce(round(value / nullif(z, 0), 7), 0) AS value FROM m3 JOIN t ON t.sample = m3.sample""",
)
def cur_pipeline(spark, d):
    steps = [{"name": "correct_blanks", "blanks": BLANK, "robust": False}, {"name": "prevalence", "classes": STUDY, "low": 0.5}, {"name": "variation", "classes": QC, "high": 0.4}, {"name": "normalize", "method": "sum"}]
    return curation.build_pipeline(steps)(long_matrix(spark, d)).select("sample", "feature", "class", r4("value", 7).alias("value"))


# ---------------------------------------------------------------- batches


@query(
    "bat_sample_blocks",
    f"""WITH t AS (SELECT study, sample, ord, CASE WHEN class = 'qc' THEN 0 WHEN class IN {_STUDY} THEN 1 ELSE 2 END AS k FROM s), n AS (SELECT *, CASE WHEN k <> lag(k) OVER (PARTITION BY study ORDER BY ord, sample) THEN 1 ELSE 0 END AS b FROM t)
       SELECT sample, k AS block_type, CAST(sum(b) OVER (PARTITION BY study ORDER BY ord, sample) AS BIGINT) AS block_number FROM n""",
)
def bat_sample_blocks(spark, d):
    return batch.sample_blocks(samples(spark, d), QC, STUDY, ["study"]).select("sample", "block_type", "block_number")


@query("bat_extremes", "SELECT study, batch, min(ord) AS first, max(ord) AS last FROM s WHERE class = 'qc' GROUP BY 1, 2")
def bat_extremes(spark, d):
    return batch.batch_extremes(samples(spark, d), QC, ["study"])


@query(
    "bat_invalid_samples",
    f"""WITH k AS (SELECT study, batch, count(*) FILTER (class = 'qc') AS n, min(ord) FILTER (class = 'qc') AS a, max(ord) FILTER (class = 'qc') AS b FROM s GROUP BY 1, 2)
       SELECT s.study, s.batch, sample FROM s JOIN k ON k.study = s.study AND k.batch = s.batch WHERE n < 4 OR (class IN {_STUDY} AND (ord < a OR ord > b))""",
)
def bat_invalid_samples(spark, d):
    return batch.invalid_samples(samples(spark, d), QC, STUDY, ["study"])


@query(
    "bat_invalid_features",
    f"""WITH k AS (SELECT study, batch, min(ord) AS a, max(ord) AS b FROM m WHERE class IN {_STUDY} GROUP BY 1, 2),
       t AS (SELECT m.study, m.batch, feature, count(*) FILTER (value > 0 AND ord < a) AS x, count(*) FILTER (value > 0 AND ord > a AND ord < b) AS y, count(*) FILTER (value > 0 AND ord > b) AS z, count(*) FILTER (value > 0) AS n, count(*) AS w
             FROM m JOIN k ON k.study = m.study AND k.batch = m.batch WHERE class = 'qc' GROUP BY 1, 2, 3)
       SELECT study, batch, feature FROM t WHERE NOT (x > 0 AND y > 0 AND z > 0 AND n >= 4 AND n >= 0.9 * w)""",
)
def bat_invalid_features(spark, d):
    return batch.invalid_features(long_matrix(spark, d), QC, STUDY, ["study"])


@query(
    "bat_interbatch_mean",
    """WITH a AS (SELECT study, feature, avg(value) AS x FROM m WHERE class = 'qc' GROUP BY 1, 2), b AS (SELECT study, batch, feature, avg(value) AS y FROM m WHERE class = 'qc' GROUP BY 1, 2, 3)
       SELECT m.sample, m.feature, round(value * coalesce(x / nullif(y, 0), 0), 3) AS value FROM m LEFT JOIN a ON a.study = m.study AND a.feature = m.feature LEFT JOIN b ON b.study = m.study AND b.feature = m.feature AND b.batch = m.batch""",
)
def bat_interbatch_mean(spark, d):
    return batch.interbatch_mean(long_matrix(spark, d), QC, ["study"]).select("sample", "feature", r4("value", 3).alias("value"))


@query(
    "bat_median_ratio",
    """WITH a AS (SELECT study, feature, avg(value) AS x FROM m WHERE class = 'qc' GROUP BY 1, 2), b AS (SELECT study, batch, feature, avg(value) AS y FROM m WHERE class = 'qc' GROUP BY 1, 2, 3),
       k AS (SELECT b.study, b.batch, median(x / nullif(y, 0)) AS z FROM b JOIN a ON a.study = b.study AND a.feature = b.feature GROUP BY 1, 2)
       SELECT m.sample, m.feature, round(value * coalesce(z, 1), 3) AS value FROM m LEFT JOIN k ON k.study = m.study AND k.batch = m.batch""",
)
def bat_median_ratio(spark, d):
    return batch.median_ratio(long_matrix(spark, d), QC, ["study"]).select("sample", "feature", r4("value", 3).alias("value"))


@query("bat_loess")
def bat_loess(spark, d):
    return batch.correct_drift(long_matrix(spark, d), QC, ["study"]).select("sample", "feature", "value")
