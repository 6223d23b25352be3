"""Queries of the direct-ionisation, correspondence, annotation and chemistry operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators import annotation, correspondence, dart, matrix, peaks, raw
from massloom.plans import catalog
from massloom.plans.catalog import QC, BLANK, SHIFTS, STUDY, long_matrix, points, r4, signals, spectra, targets
from massloom.session import cut, small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        catalog.query(name, sql)(f)
        QUERIES[name] = catalog.QUERIES.pop(name)
        if sql is not None:
            SQL[name] = catalog.SQL.pop(name)
        return f

    return add


def _scans(spark, d):
    """Spectra as scans: each injection is a scan of its study's run."""
    return spectra(spark, d).withColumnsRenamed({"sample": "scan", "study": "sample"})


_SC = "WITH x AS (SELECT study AS sample, sample AS scan, mz, spint FROM sp), t AS (SELECT sample, scan, sum(spint) AS tic FROM x GROUP BY 1, 2)"


@query(
    "dart_spots",
    """WITH t AS (SELECT trace_id, scan, spint >= 100 AS o FROM g), n AS (SELECT *, CASE WHEN o AND NOT coalesce(lag(o) OVER (PARTITION BY trace_id ORDER BY scan), false) THEN 1 ELSE 0 END AS b FROM t),
       r AS (SELECT *, sum(b) OVER (PARTITION BY trace_id ORDER BY scan) AS spot FROM n)
       SELECT trace_id, CAST(spot AS BIGINT) AS spot, min(scan) AS first_scan, max(scan) AS last_scan, count(*) AS n FROM r WHERE o GROUP BY 1, 2""",
)
def dart_spots(spark, d):
    t = signals(spark, d).withColumnRenamed("spint", "tic")
    return dart.spots(t, 100.0, by="trace_id").select("trace_id", "spot", "first_scan", "last_scan", "n")


@query("dart_interval_join", "WITH k AS (SELECT sample, min(time) + 100 AS a, min(time) + 400 AS b FROM g GROUP BY 1) SELECT g.sample, count(*) AS n, round(sum(spint), 3) AS total FROM g JOIN k ON k.sample = g.sample AND time BETWEEN a AND b GROUP BY 1")
def dart_interval_join(spark, d):
    s = signals(spark, d)
    spots = s.groupBy("sample").agg((F.min("time") + 100).alias("start_time"), (F.min("time") + 400).alias("end_time"))
    return dart.in_spots(s, spots, 250.0).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("spint"), 3).alias("total"))


@query("dart_topn_scans", _SC + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(tic, 3) DESC, scan) AS k FROM t) SELECT r.sample, r.scan, count(*) AS n FROM r JOIN x ON x.sample = r.sample AND x.scan = r.scan WHERE k <= 3 GROUP BY 1, 2")
def dart_topn_scans(spark, d):
    return dart.top_scans(_scans(spark, d), 3).groupBy("sample", "scan").agg(F.count(F.lit(1)).alias("n"))


@query("dart_drop_lower", _SC + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(tic, 3), scan) AS k, count(*) OVER (PARTITION BY sample) AS n FROM t) SELECT sample, scan FROM r WHERE k > floor(n * 0.3)")
def dart_drop_lower(spark, d):
    return dart.drop_lower(_scans(spark, d), 0.3).select("sample", "scan").distinct()


@query("dart_tic_norm", "SELECT sample, feature, round(spint / sum(spint) OVER (PARTITION BY sample) * 1000, 6) AS spint FROM sp")
def dart_tic_norm(spark, d):
    return dart.normalize_tic(spectra(spark, d), 1000.0).select("sample", "feature", r4("spint", 6).alias("spint"))


@query("dart_istd_norm", "WITH t AS (SELECT sample, sum(spint) FILTER (mz BETWEEN 380.4 AND 380.65) AS z FROM sp GROUP BY 1) SELECT sp.sample, feature, round(coalesce(spint / nullif(z, 0), spint), 5) AS spint FROM sp JOIN t ON t.sample = sp.sample")
def dart_istd_norm(spark, d):
    return dart.normalize_standard(spectra(spark, d), 380.4, 380.65).select("sample", "feature", r4("spint", 5).alias("spint"))


_HIT = "WITH h AS (SELECT sample, target, arg_max(mz, {'i': spint, 'm': -mz}) AS z, any_value(mz_target) AS t FROM sp JOIN q ON abs(mz - mz_target) <= 0.02 GROUP BY 1, 2), o AS (SELECT sample, target, (z - t) / t * 1e6 AS ppm FROM h), w AS (SELECT sample, median(ppm) AS f FROM o WHERE abs(ppm) <= 80 GROUP BY 1)"


@query("dart_mz_offsets", _HIT + " SELECT sample, target, round(ppm, 3) AS ppm FROM o")
def dart_mz_offsets(spark, d):
    return dart.mass_offsets(spectra(spark, d), targets(spark), 0.02, by=["sample"]).select("sample", "target", r4("ppm", 3).alias("ppm"))


@query("dart_mz_shift", _HIT + " SELECT sp.sample, feature, round(mz * (1 - coalesce(f, 0) / 1e6), 5) AS mz FROM sp LEFT JOIN w ON w.sample = sp.sample")
def dart_mz_shift(spark, d):
    s = spectra(spark, d).withColumn("scan", F.col("sample"))
    return dart.correct_masses(s, targets(spark), 0.02).select("sample", "feature", r4("mz", 5).alias("mz"))


@query(
    "dart_crude_cluster",
    """WITH x AS (SELECT study, feature, mz, CASE WHEN ln(mz) - lag(ln(mz)) OVER (PARTITION BY study ORDER BY mz, feature) <= ln(1 + 200 / 1e6) THEN 0 ELSE 1 END AS b FROM (SELECT DISTINCT study, feature, mz FROM sp))
       SELECT study, feature, CAST(sum(b) OVER (PARTITION BY study ORDER BY mz, feature) - 1 AS BIGINT) AS crude FROM x""",
)
def dart_crude_cluster(spark, d):
    s = spectra(spark, d).select("study", "feature", "mz").distinct()
    return dart.crude_clusters(s, 200.0, ["study"]).select("study", "feature", F.col("crude").cast("bigint").alias("crude"))


@query("dart_consensus")
def dart_consensus(spark, d):
    s = spectra(spark, d).withColumnsRenamed({"sample": "scan", "study": "sample"})
    return dart.consensus(s, 30.0, 20.0, 20.0, 5)


@query("dart_collapse", "SELECT study, feature, count(*) AS n, round(sum(mz * spint) / sum(spint), 5) AS mz, round(avg(spint) + 1e-6, 3) AS spint FROM sp GROUP BY 1, 2")
def dart_collapse(spark, d):
    return dart.collapse(spectra(spark, d), ["study", "feature"]).select("study", "feature", "n", r4("mz", 5).alias("mz"), r4(F.col("spint") + 1e-6, 3).alias("spint"))


@query("dart_ppm_check", "SELECT CAST(floor(mz) AS BIGINT) AS cell FROM sp GROUP BY 1 HAVING sqrt(greatest(sum(spint * mz * mz) / sum(spint) - pow(sum(spint * mz) / sum(spint), 2), 0)) / (sum(spint * mz) / sum(spint)) * 1e6 <= 100")
def dart_ppm_check(spark, d):
    return dart.ppm_spread_ok(spectra(spark, d).withColumn("cell", F.floor("mz")), ["cell"], 100.0)


@query(
    "dart_peak_form",
    """WITH o AS (SELECT DISTINCT sample, scan FROM g), w AS (SELECT sample, avg(scan) AS a, (max(scan) - min(scan)) / 6.0 AS s FROM o GROUP BY 1),
       h AS (SELECT o.sample, scan, exp(-pow((scan - a) / nullif(s, 0), 2) / 2) AS z FROM o JOIN w ON w.sample = o.sample), y AS (SELECT sample, trace_id, scan, sum(spint) AS y FROM g GROUP BY 1, 2, 3),
       k AS (SELECT DISTINCT sample, trace_id FROM g), cc AS (SELECT k.trace_id, corr(coalesce(y.y, 0), z) AS c FROM k JOIN h ON h.sample = k.sample LEFT JOIN y ON y.sample = k.sample AND y.trace_id = k.trace_id AND y.scan = h.scan GROUP BY k.sample, k.trace_id)
       SELECT trace_id FROM cc WHERE isfinite(c) AND c >= 0.3""",
)
def dart_peak_form(spark, d):
    return dart.peak_form_ok(signals(spark, d), ["trace_id"], 0.3)


def _tail_sql(t: str, df: str | None) -> str:
    """P(T > |t|) of Student's distribution, of the normal one without df, by Simpson's rule."""
    weight = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    if df is None:
        return f"(0.5 - abs({t}) / 1200 / sqrt(2 * pi()) * list_sum([{weight} * exp(-pow({t} * i / 400.0, 2) / 2) for i in range(0, 401)]))"
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"(0.5 - exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {angle} / 1200 * list_sum([{weight} * pow(cos({angle} * i / 400.0), {df} - 1) for i in range(0, 401)]))"


@query("dart_bracket")
def dart_bracket(spark, d):
    return dart.bracket(spectra(spark, d))


@query(
    "dart_matrix",
    """WITH b AS (SELECT target, mz_target - 0.02 AS lo, mz_target + 0.02 AS hi FROM q) SELECT a.sample, b.target AS feature, round(sum(sp.spint), 3) AS value FROM (SELECT DISTINCT sample FROM sp) a CROSS JOIN b LEFT JOIN sp ON sp.sample = a.sample AND sp.mz BETWEEN lo AND hi GROUP BY 1, 2""",
)
def dart_matrix(spark, d):
    b = targets(spark).select(F.col("target").alias("feature"), (F.col("mz_target") - 0.02).alias("mz_min"), (F.col("mz_target") + 0.02).alias("mz_max"))
    return dart.bracket_matrix(b, spectra(spark, d).drop("feature")).withColumn("value", r4("value", 3))


@query(
    "dart_blank_statistics",
    f"""WITH t AS (SELECT feature, count(value) FILTER (class IN {catalog._STUDY}) AS n1, count(value) FILTER (class = 'blank') AS n2, avg(value) FILTER (class IN {catalog._STUDY}) AS m1, avg(value) FILTER (class = 'blank') AS m2,
               var_samp(value) FILTER (class IN {catalog._STUDY}) AS v1, var_samp(value) FILTER (class = 'blank') AS v2 FROM m WHERE class = 'blank' OR class IN {catalog._STUDY} GROUP BY 1)
       SELECT feature, n1, n2, round(m1 / nullif(m2, 0), 3) AS fold, round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / nullif(n2, 0)), 0), 3) AS t FROM t""",
)
def dart_blank_statistics(spark, d):
    return dart.blank_test(long_matrix(spark, d), BLANK, STUDY).select("feature", "n1", "n2", r4("fold", 3).alias("fold"), r4("t", 3).alias("t"))


@query(
    "dart_blank_subtraction",
    f"""WITH x AS (SELECT feature, class, count(value) AS n1, avg(value) AS m1, var_samp(value) / count(value) AS q1 FROM m WHERE class IN {catalog._STUDY} GROUP BY 1, 2), y AS (SELECT feature, count(value) AS n2, avg(value) AS m2, var_samp(value) / nullif(count(value), 0) AS q2 FROM m WHERE class = 'blank' GROUP BY 1),
       j AS (SELECT x.feature, class, n1, m1, q1, coalesce(n2, 0) AS n2, m2, q2, n1 >= 2 AND coalesce(n2, 0) > 0 AS ok FROM x LEFT JOIN y ON y.feature = x.feature),
       t AS (SELECT *, CASE WHEN ok THEN (m1 - m2) / nullif(sqrt(CASE WHEN n2 = 1 THEN q1 ELSE q1 + q2 END), 0) END AS t, CASE WHEN NOT ok THEN NULL WHEN n2 = 1 THEN n1 - 1 ELSE pow(q1 + q2, 2) / nullif(q1 * q1 / nullif(n1 - 1, 0) + q2 * q2 / nullif(n2 - 1, 0), 0) END AS df, CASE WHEN ok THEN m1 / nullif(m2, 0) END AS fold FROM j),
       p AS (SELECT *, CASE WHEN t > 0 THEN {_tail_sql("t", "df")} ELSE 1 - {_tail_sql("t", "df")} END AS p FROM t)
       SELECT feature, class, round(t, 4) AS t, round(df, 4) AS df, round(p, 4) AS p, round(fold + 1e-9, 4) AS fold, n1 >= 2 AND (n2 = 0 OR coalesce(p <= 0.05 AND coalesce(fold >= 2, m2 = 0), false)) AS keep FROM p""",
)
def dart_blank_subtraction(spark, d):
    s = dart.subtract_blanks(long_matrix(spark, d), BLANK, STUDY)
    return s.select("feature", "class", *[r4(c).alias(c) for c in ("t", "df", "p")], r4(F.col("fold") + 1e-9).alias("fold"), "keep")


@query(
    "dart_sister_ions",
    """WITH h AS (SELECT * FROM (VALUES ('Na', 21.981944), ('NH4', 17.026549), ('13C1', 1.003355), ('13C2', 2.00671), ('CH3OH', 32.026215)) AS v(ion, shift)),
       p AS (SELECT x.feature_id AS parent, h.ion, y.feature_id AS child, abs(y.mz - (x.mz + CAST(shift AS DOUBLE))) AS e, x.mz + CAST(shift AS DOUBLE) AS z FROM f x CROSS JOIN h JOIN f y ON abs(y.mz - (x.mz + CAST(shift AS DOUBLE))) <= (x.mz + CAST(shift AS DOUBLE)) * 20 / 1e6 AND y.feature_id <> x.feature_id)
       SELECT parent, ion, arg_min(child, {'e': e, 'c': child}) AS child FROM p GROUP BY 1, 2""",
)
def dart_sister_ions(spark, d):
    shifts = spark.createDataFrame(SHIFTS, "ion string, shift double")
    return dart.sister_ions(points(spark, d).withColumnRenamed("feature_id", "feature"), shifts, 20.0).select("parent", "ion", "child")


@query(
    "dart_sister_ratios",
    """WITH h AS (SELECT * FROM (VALUES ('Na', 21.981944), ('NH4', 17.026549), ('13C1', 1.003355), ('13C2', 2.00671), ('CH3OH', 32.026215)) AS v(ion, shift)), u AS (SELECT study, feature_id, mz FROM f),
       p AS (SELECT x.feature_id AS parent, h.ion, y.feature_id AS child, abs(y.mz - (x.mz + CAST(shift AS DOUBLE))) AS e FROM u x CROSS JOIN h JOIN u y ON x.study = y.study AND abs(y.mz - (x.mz + CAST(shift AS DOUBLE))) <= (x.mz + CAST(shift AS DOUBLE)) * 2000 / 1e6 AND y.feature_id <> x.feature_id),
       b AS (SELECT parent, ion, arg_min(child, {'e': e, 'c': child}) AS child FROM p GROUP BY 1, 2),
       r AS (SELECT parent, ion, child, c.value / nullif(a.value, 0) * 100 AS r FROM b JOIN m a ON a.feature = parent JOIN m c ON c.feature = child AND c.sample = a.sample)
       SELECT parent, ion, child, count(r) AS n, round(avg(r), 3) AS mean, round(stddev_pop(r), 3) AS std, count(r) > 5 AND avg(r) > 2 AND avg(r) < 200 AND stddev_pop(r) < 50 AS sister FROM r GROUP BY 1, 2, 3""",
)
def dart_sister_ratios(spark, d):
    shifts = spark.createDataFrame(SHIFTS, "ion string, shift double")
    # features of one study share samples; the tables hold no true adducts, so the tolerance is wide
    pairs = dart.sister_ions(points(spark, d).withColumnRenamed("feature_id", "feature"), shifts, 2000.0, by=["study"])
    return dart.sister_ratios(long_matrix(spark, d), pairs, 5).select("parent", "ion", "child", "n", r4("mean", 3).alias("mean"), r4("std", 3).alias("std"), "sister")


@query("dart_replicates", f"WITH a AS (SELECT feature, class, count(value) / count(*) >= 0.98 AS o FROM m WHERE class IN {catalog._STUDY} GROUP BY 1, 2) SELECT feature FROM a GROUP BY 1 HAVING bool_and(o)")
def dart_replicates(spark, d):
    return dart.found_in_replicates(long_matrix(spark, d), STUDY, 0.98, every=True)


@query("dart_min_intensity", f"WITH a AS (SELECT feature, class, avg(value) AS v FROM m WHERE class IN {catalog._STUDY} GROUP BY 1, 2) SELECT feature FROM a GROUP BY 1 HAVING bool_or(coalesce(v > 1000, false))")
def dart_min_intensity(spark, d):
    return dart.minimum_intensity(long_matrix(spark, d), STUDY, 1000.0)


@query("dart_low_rsd", "WITH a AS (SELECT feature, class, stddev_pop(coalesce(value, 0)) / nullif(avg(coalesce(value, 0)), 0) AS v FROM m WHERE class IN ('qc') GROUP BY 1, 2) SELECT feature FROM a GROUP BY 1 HAVING bool_and(coalesce(v <= 0.3, true))")
def dart_low_rsd(spark, d):
    return dart.low_rsd(long_matrix(spark, d), QC, 0.3)


@query("dart_topn_features", "SELECT feature, round(avg(value), 3) AS mean FROM m GROUP BY 1 HAVING avg(value) IS NOT NULL ORDER BY avg(value) DESC, feature LIMIT 20")
def dart_topn_features(spark, d):
    return dart.most_abundant_features(long_matrix(spark, d), 20).withColumn("mean", r4("mean", 3))


_V = "WITH v AS (SELECT feature, class, coalesce(value, 0) AS v, value FROM m WHERE class IN ('qc', 'blank')), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM v), t AS (SELECT feature, count(*) FILTER (class = 'qc') AS n1, count(*) FILTER (class = 'blank') AS n2, avg(v) FILTER (class = 'qc') AS m1, avg(v) FILTER (class = 'blank') AS m2, var_samp(v) FILTER (class = 'qc') AS v1, var_samp(v) FILTER (class = 'blank') AS v2, sum(r) FILTER (class = 'qc') AS rank_sum FROM k GROUP BY 1)"


@query("dart_volcano_statistics", _V + " SELECT feature, n1, n2, round(m1 - m2, 3) AS diff, round((m1 - m2) / nullif(sqrt(v1 / nullif(n1, 0) + v2 / nullif(n2, 0)), 0), 3) AS t, CAST(rank_sum AS DOUBLE) AS rank_sum FROM t")
def dart_volcano_statistics(spark, d):
    return dart.volcano(long_matrix(spark, d), QC, BLANK).select("feature", "n1", "n2", r4(F.col("mean1") - F.col("mean2"), 3).alias("diff"), r4("t", 3).alias("t"), F.col("rank_sum").cast("double").alias("rank_sum"))


@query(
    "dart_volcano",
    f"""WITH v AS (SELECT feature, class = 'healthy' AS a, coalesce(value, 0) AS v FROM m WHERE class IN ('healthy', 'disease')), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM v),
       g2 AS (SELECT feature, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, avg(v) FILTER (a) AS m1, avg(v) FILTER (NOT a) AS m2, var_samp(v) FILTER (a) AS v1, var_samp(v) FILTER (NOT a) AS v2, sum(r) FILTER (a) AS w,
              count(*) FILTER (a AND v <> 0) AS h1, count(*) FILTER (NOT a AND v <> 0) AS h2 FROM k GROUP BY 1),
       q2 AS (SELECT *, v1 / nullif(n1, 0) AS q1, v2 / nullif(n2, 0) AS q2, h1 / nullif(n1, 0) AS x, h2 / nullif(n2, 0) AS y FROM g2),
       t AS (SELECT *, (m1 - m2) / nullif(sqrt(q1 + q2), 0) AS t, pow(q1 + q2, 2) / nullif(q1 * q1 / nullif(n1 - 1, 0) + q2 * q2 / nullif(n2 - 1, 0), 0) AS df, (w - n1 * (n1 + n2 + 1) / 2.0) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 0) AS z,
              CASE WHEN m2 = 0 AND m1 > 0 THEN {catalog.INF} ELSE m1 / nullif(m2, 0) END AS fold, (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)), 0) AS cohen_d,
              coalesce(greatest(x, y) >= 0.75 AND (least(x, y) >= 0.75 OR least(x, y) <= 0.25) AND x IS NOT NULL AND y IS NOT NULL, false) AS tested FROM q2),
       p AS (SELECT *, CASE WHEN t IS NOT NULL THEN least(2 * {_tail_sql("t", "df")}, 1) END AS p, CASE WHEN z IS NOT NULL THEN least(2 * {_tail_sql("z", None)}, 1) END AS p_ranks FROM t)
       SELECT feature, round(fold, 4) AS fold, round(t, 4) AS t, round(df, 4) AS df, round(p, 4) AS p, round(z, 4) AS z, round(p_ranks, 4) AS p_ranks, round(cohen_d, 4) AS cohen_d, tested, coalesce(tested AND p <= 0.05 AND (fold >= 2 OR fold <= 0.5), false) AS significant FROM p""",
)
def dart_volcano(spark, d):
    v = dart.volcano(long_matrix(spark, d), ["healthy"], ["disease"])
    return v.select("feature", *[r4(c).alias(c) for c in ("fold", "t", "df", "p", "z", "p_ranks", "cohen_d")], "tested", "significant")


@query(
    "dart_compounds",
    """WITH b AS (SELECT * FROM (VALUES ('compound A', 380.5244), ('compound B', 742.2725), ('compound C', 145.4306), ('compound A2', 380.5250)) AS v(name, z))
       SELECT feature_id AS feature, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM f JOIN b ON abs(mz - CAST(z AS DOUBLE)) / CAST(z AS DOUBLE) * 1e6 <= 15 GROUP BY 1""",
)
def dart_compounds(spark, d):
    db = spark.createDataFrame([("compound A", 380.5244), ("compound B", 742.2725), ("compound C", 145.4306), ("compound A2", 380.5250)], "name string, mz double")
    a = dart.annotate_compounds(points(spark, d).withColumnRenamed("feature_id", "feature"), db)
    return a.select("feature", F.size("annotations").cast("bigint").alias("n"), F.array_join("annotations.name", ",").alias("names"))


# ---------------------------------------------------------------- correspondence


def _labelled(spark, d):
    """Features as detected ones: sample is the study, class its polarity, clusters are islands of mass."""
    f = points(spark, d)
    return f.select("feature_id", F.col("study").alias("sample"), F.col("polarity").alias("class"), "mz", "rt", F.floor(F.col("mz") * 2).alias("cluster"))


@query(
    "cor_species_count",
    """WITH l AS (SELECT study AS sample, polarity AS class, CAST(floor(mz * 2) AS BIGINT) AS cluster FROM f), z AS (SELECT class, count(DISTINCT sample) AS n FROM l GROUP BY 1), k AS (SELECT cluster, class, sample, count(*) AS k FROM l GROUP BY 1, 2, 3),
       h AS (SELECT cluster, class, k, count(*) AS c FROM k GROUP BY 1, 2, 3)
       SELECT cluster, coalesce(max(CASE WHEN c >= greatest(round_even(n * 0.25, 0), 1) THEN k END), 0) AS species FROM h JOIN z ON z.class = h.class GROUP BY 1""",
)
def cor_species_count(spark, d):
    f = _labelled(spark, d)
    sizes = f.select("class", "sample").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return correspondence.species_count(f, sizes)


@query(
    "cor_unique_assignment",
    """WITH l AS (SELECT feature_id, study AS sample, mz, rt, CAST(floor(mz * 2) AS BIGINT) AS cluster FROM f), w AS (SELECT cluster, avg(mz) AS a, stddev_pop(mz) AS sa, avg(rt) AS b, stddev_pop(rt) AS sb FROM l GROUP BY 1),
       e AS (SELECT l.*, round(greatest(coalesce(abs(mz - a) / nullif(sa, 0), 0), coalesce(abs(rt - b) / nullif(sb, 0), 0)), 6) AS x FROM l JOIN w ON w.cluster = l.cluster)
       SELECT feature_id, CASE WHEN row_number() OVER (PARTITION BY cluster, sample ORDER BY x, mz, rt) = 1 AND x <= 3 THEN cluster ELSE -1 END AS label FROM e""",
)
def cor_unique_assignment(spark, d):
    return correspondence.unique_nearest(_labelled(spark, d)).select("feature_id", "label")


@query(
    "cor_dbscan",
    """WITH RECURSIVE nb AS (SELECT x.feature_id AS a, y.feature_id AS b FROM f x JOIN f y ON abs(x.mz - y.mz) <= 0.02 AND abs(x.rt - y.rt) <= 15), core AS (SELECT a FROM nb GROUP BY 1 HAVING count(*) >= 3),
       e AS (SELECT nb.a, nb.b FROM nb JOIN core c ON c.a = nb.a JOIN core k ON k.a = nb.b), r(k, root) AS (SELECT a, a FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k),
       l AS (SELECT k, min(root) AS cluster FROM r GROUP BY 1), o AS (SELECT nb.a AS k, min(l.cluster) AS cluster FROM nb JOIN l ON l.k = nb.b WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY 1)
       SELECT feature_id, coalesce(l.cluster, o.cluster, -1) AS cluster FROM f LEFT JOIN l ON l.k = feature_id LEFT JOIN o ON o.k = feature_id""",
)
def cor_dbscan(spark, d):
    return correspondence.dbscan(points(spark, d), "feature_id", "mz", "rt", 0.02, 15.0, 3)


@query("cor_match_features")
def cor_match_features(spark, d):
    f = table(spark, d, "feature_metadata")
    from massloom.operators.units import feature_units

    u = feature_units(f, table(spark, d, "study")).filter("mz is not null and not isnan(mz) and rt_sec is not null")
    return correspondence.match_features(u.select("feature_id", F.col("study").alias("sample"), F.col("polarity").alias("class"), "mz", F.col("rt_sec").alias("rt")), "feature_id", 0.01, 10.0, 0.1)


@query("fill_knn")
def fill_knn(spark, d):
    return correspondence.fill_by_neighbours(long_matrix(spark, d).filter("class is not null"), ["study", "class"])


@query("fill_integration")
def fill_integration(spark, d):
    from massloom.operators import grid, units

    names = table(spark, d, "sample_metadata").select(F.trim("sample").alias("name"), F.col("sample_id").alias("sample")).distinct()
    t = table(spark, d, "trace").select("trace_id", F.trim("sample").alias("name"), "mz").join(names, "name")
    f = units.feature_units(table(spark, d, "feature_metadata"), table(spark, d, "study")).filter("rt_sec is not null and mz is not null and not isnan(mz)")
    f = f.select(F.col("feature_id").alias("feature"), "mz", F.col("rt_sec").alias("rt"), F.lit(5.0).alias("rt_std"), F.coalesce("rt_start_sec", F.col("rt_sec") - 10).alias("rt_start"), F.coalesce("rt_end_sec", F.col("rt_sec") + 10).alias("rt_end"))
    m = cut(catalog.cells(spark, d).filter("value is null"))
    # a trace's unit is found from its own readings: those of traces in no missing cell's window stay where they are
    wanted = small(cut(correspondence.signals_to_fill(m, f, t, 0.02).select("trace_id").distinct()))
    own, trace = (table(spark, d, x).join(wanted, "trace_id", "left_semi") for x in ("chromatogram", "trace"))
    r = grid.readings_in_seconds(own, trace).select("trace_id", F.col("t").alias("time"), F.col("y").alias("spint")).distinct()
    return correspondence.fill_by_integration(m, f, r.join(t, "trace_id").select("sample", "mz", "time", "spint"), 0.02)


# ---------------------------------------------------------------- annotation and chemistry


@query(
    "ann_consensus_vote",
    """WITH RECURSIVE e AS (SELECT sample, feature AS cluster, CAST(floor(mz) AS INTEGER) AS l, CAST(dense_rank() OVER (PARTITION BY sample, CAST(floor(mz) AS INTEGER) ORDER BY mz) - 1 AS INTEGER) AS i FROM sp),
       k AS (SELECT cluster, i, count(*) AS n FROM e GROUP BY 1, 2), node AS (SELECT cluster, arg_max(i, {'n': n, 'i': -i}) AS i FROM k GROUP BY 1),
       x AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n FROM e a JOIN e b ON a.sample = b.sample AND a.l = b.l AND a.i = 0 AND b.i > 0 AND a.cluster <> b.cluster GROUP BY 1, 2),
       y AS (SELECT x.a, x.b, x.n, row_number() OVER (PARTITION BY x.a, node.i ORDER BY x.n DESC, x.b) AS r FROM x JOIN node ON node.cluster = x.b), z AS (SELECT a, b, n FROM y WHERE r = 1), u AS (SELECT a, b FROM z UNION SELECT b, a FROM z),
       walk(k, root) AS (SELECT a, a FROM u UNION SELECT u.b, walk.root FROM walk JOIN u ON u.a = walk.k), g2 AS (SELECT k AS cluster, min(root) AS envelope_label FROM walk GROUP BY 1), h AS (SELECT b AS cluster, max(n) AS n FROM z GROUP BY 1)
       SELECT g2.cluster, envelope_label, node.i AS envelope_index, 1 AS charge, coalesce(h.n, 0) AS count FROM g2 JOIN node ON node.cluster = g2.cluster LEFT JOIN h ON h.cluster = g2.cluster""",
)
def ann_consensus_vote(spark, d):
    s = spectra(spark, d).select("sample", F.col("feature").alias("cluster"), "mz", F.col("spint").alias("area"))
    e = s.withColumn("envelope_label", F.floor("mz").cast("int")).withColumn("envelope_index", (F.dense_rank().over(_by_mass()) - 1).cast("int")).withColumn("charge", F.lit(1))
    return annotation.vote(e)


def _by_mass():
    return Window.partitionBy("sample", "envelope_label").orderBy("mz")


@query("ann_isotopologue_report", "WITH z AS (SELECT CAST(floor(mz) AS BIGINT) AS envelope_label, mz, feature_id, charge FROM f WHERE charge > 0) SELECT envelope_label, arg_min(feature_id, {'m': mz, 'f': feature_id}) AS feature, count(*) AS n FROM z GROUP BY 1")
def ann_isotopologue_report(spark, d):
    f = points(spark, d).filter("charge > 0").select(F.col("feature_id").alias("feature"), "mz", F.lit(1.0).alias("abundance"), F.floor("mz").alias("envelope_label"), "charge", F.lit(1.0).alias("score"))
    f = f.withColumn("score", F.col("feature").cast("double"))
    return matrix.group_isotopologues(f).select("envelope_label", "feature", F.col("n").cast("bigint").alias("n"))


@query("ann_annotate")
def ann_annotate(spark, d):
    s = spectra(spark, d).select("sample", "feature", "mz", F.col("spint").alias("area"), F.lit(0).alias("group"))
    # up to 3324 Da: three charges at the highest mass of the tables
    bounds = {"C": (1, 150), "H": (2, 302), "O": (0, 50), "N": (0, 30)}
    return annotation.annotate(s, ["sample"], "group", bounds, tol=0.005)


FORMULAS = ["H2O", "CO2", "C6H12O6", "(13C)C5H12O6", "[C10H11O2]+", "C8H10N4O2", "[CO3]2-", "C24H46N(18O)2PS"]


#: fixed values: masses of the isotopes in FORMULAS, and of the electron
_ISOTOPES = "('H', 1.00782503223), ('C', 12.0), ('N', 14.00307400443), ('O', 15.99491461957), ('P', 30.97376199842), ('S', 31.9720711744), ('(13C)', 13.00335483507), ('(18O)', 17.99915961286)"
_WRITTEN = "('H2O', 'H2O'), ('CO2', 'CO2'), ('C6H12O6', 'C6H12O6'), ('(13C)C5H12O6', 'C5(13C)H12O6'), ('[C10H11O2]+', '[C10H11O2]+'), ('C8H10N4O2', 'C8H10N4O2'), ('[CO3]2-', '[CO3]2-'), ('C24H46N(18O)2PS', 'C24H46N(18O)2PS')"


@query(
    "chem_mass",
    rf"""WITH w AS (SELECT * FROM (VALUES {_WRITTEN}) AS v(formula, canonical)), i AS (SELECT * FROM (VALUES {_ISOTOPES}) AS v(isotope, mass)), z AS (SELECT formula, regexp_extract(formula, '\]([0-9]*)([+-])$', 1) AS n, regexp_extract(formula, '\]([0-9]*)([+-])$', 2) AS side FROM w),
       t AS (SELECT formula, unnest(regexp_extract_all(regexp_replace(formula, '\].*$', ''), '\([0-9]+[A-Z][a-z]?\)[0-9]*|[A-Z][a-z]?[0-9]*')) AS t FROM w), pc AS (SELECT formula, regexp_extract(t, '^(\(.*\)|[A-Z][a-z]?)', 1) AS isotope, coalesce(try_cast(regexp_extract(t, '([0-9]*)$', 1) AS INTEGER), 1) AS n FROM t),
       s2 AS (SELECT formula, sum(pc.n * CAST(mass AS DOUBLE)) AS mass FROM pc JOIN i ON i.isotope = pc.isotope GROUP BY 1)
       SELECT w.formula, canonical, round(mass - CASE side WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * coalesce(try_cast(n AS INTEGER), 1) * 0.000548579909, 5) AS mass FROM w JOIN z ON z.formula = w.formula JOIN s2 ON s2.formula = w.formula""",
)
def chem_mass(spark, d):
    f = spark.createDataFrame([(x,) for x in FORMULAS], "formula string")
    return f.select("formula", chem.canonical_column(F.col("formula")).alias("canonical"), F.round(chem.mass_column(F.col("formula")), 5).alias("mass"))


@query("chem_envelope")
def chem_envelope(spark, d):
    f = spark.createDataFrame([(x,) for x in FORMULAS], "formula string")
    return f.select("formula", F.posexplode(chem.envelope_column(F.col("formula"), 4)).alias("k", "e")).select("formula", "k", F.round("e.mass", 5).alias("mass"), F.round("e.p", 6).alias("p"))


@query("chem_formulas")
def chem_formulas(spark, d):
    m = points(spark, d).select(F.round("mz", 3).alias("mz")).filter("mz is not null and not isnan(mz)").distinct()
    # up to 1585 Da, above the highest mass of the tables
    return m.select("mz", chem.formulas_column(F.col("mz"), 0.003, {"C": (0, 100), "H": (0, 200), "N": (0, 4), "O": (0, 8)}, None).alias("formulas"))


@query("raw_centroids")
def raw_centroids(spark, d):
    t = peaks.to_traces(signals(spark, d).withColumn("x", F.col("scan").cast("double")), ["trace_id"], "scan", ["x", "spint"])
    return t.select("trace_id", peaks.centroid_column(F.col("x"), F.col("spint"), 5.0, 2.0).alias("c")).select("trace_id", F.size("c.mz").alias("n"))


@query("raw_unmatched", "SELECT sample, count(*) AS n FROM sp WHERE NOT EXISTS (SELECT 1 FROM q WHERE abs(sp.mz - q.mz_target) <= 0.05) GROUP BY 1")
def raw_unmatched(spark, d):
    return raw.unmatched(spectra(spark, d), targets(spark), 0.05).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query("dart_embedding")
def dart_embedding(spark, d):
    return dart.embedding_by(long_matrix(spark, d))


@query("dart_leaf_order")
def dart_leaf_order(spark, d):
    return dart.leaf_order_by(long_matrix(spark, d))


@query("dart_drill_down", "SELECT sample, feature, mz, round(sum(spint) OVER (PARTITION BY sample), 3) AS sample_sum FROM sp WHERE mz BETWEEN 145.3806 AND 145.4806")
def dart_drill_down(spark, d):
    b = spark.createDataFrame([("x", 145.3806, 145.4306, 145.4806)], "feature string, mz_min double, mz_mean double, mz_max double")
    s = spectra(spark, d).withColumnRenamed("feature", "own")
    return dart.drill_down(s, b, "x").select("sample", F.col("own").alias("feature"), "mz", r4("sample_sum", 3).alias("sample_sum"))


@query("dart_process")
def dart_process(spark, d):
    s = spectra(spark, d).select(F.col("sample").alias("scan"), F.col("study").alias("sample"), "mz", "spint")
    meta = s.select("sample").distinct().select("sample", F.lit("study").alias("class"), F.lit(1).alias("batch"))
    return dart.process(s, meta, targets(spark), 20)


@query("bat_template")
def bat_template(spark, d):
    from massloom.operators.batch import correct_by_template

    return correct_by_template(long_matrix(spark, d), QC, ["study"]).select("sample", "feature", "value")


@query(
    "dart_reindex",
    """WITH x AS (SELECT feature_id, study, CASE WHEN charge = -1 THEN -1 ELSE CAST(floor(mz / 10) AS BIGINT) END AS label FROM f)
       SELECT feature_id, CAST(dense_rank() OVER (PARTITION BY study ORDER BY label) - 1 AS BIGINT) AS label FROM x WHERE label >= 0""",
)
def dart_reindex(spark, d):
    f = points(spark, d).select("feature_id", "study", F.when(F.col("charge") == -1, F.lit(-1)).otherwise(F.floor(F.col("mz") / 10)).alias("label"))
    return dart.reindex(f, "label", ["study"]).select("feature_id", F.col("label").cast("bigint").alias("label"))


@query(
    "mat_build",
    """WITH x AS (SELECT study AS sample, CAST(floor(mz / 50) AS BIGINT) AS k, max(rt) AS value FROM f WHERE charge > 0 GROUP BY 1, 2)
       SELECT a.sample, 'FT-' || lpad(CAST(b.k AS VARCHAR), CAST(length(CAST((SELECT max(k) FROM x) AS VARCHAR)) AS INTEGER), '0') AS feature, x.value
       FROM (SELECT DISTINCT study AS sample FROM f) a CROSS JOIN (SELECT DISTINCT k FROM x) b LEFT JOIN x ON x.sample = a.sample AND x.k = b.k""",
)
def mat_build(spark, d):
    f = points(spark, d).withColumn("sample", F.col("study")).withColumn("cluster", F.when(F.col("charge") > 0, F.floor(F.col("mz") / 50)).otherwise(F.lit(-1)))
    return matrix.build_matrix(f, f.select("sample").distinct(), "rt")


@query(
    "pk_envelope",
    """WITH b AS (SELECT sample, trace_id, min(scan) AS a, max(scan) AS z FROM g GROUP BY 1, 2), w AS (SELECT sample, max(a) AS a, min(z) AS z FROM b GROUP BY 1),
       i AS (SELECT g.* FROM g JOIN w ON w.sample = g.sample AND scan BETWEEN a AND z), t AS (SELECT sample, trace_id, (scan - lag(scan) OVER v) * (spint + lag(spint) OVER v) / 2.0 AS p FROM i WINDOW v AS (PARTITION BY sample, trace_id ORDER BY scan)),
       r AS (SELECT sample, trace_id, coalesce(sum(p), 0) AS area FROM t GROUP BY 1, 2)
       SELECT sample, trace_id, round(area / nullif(sum(area) OVER (PARTITION BY sample), 0), 6) AS p FROM r""",
)
def pk_envelope(spark, d):
    return peaks.envelope(signals(spark, d), ["sample"], "trace_id", "scan", "scan", "spint").select("sample", "trace_id", r4("p", 6).alias("p"))


@query("str_daily_totals", "SELECT sample, CAST(CAST(date_trunc('day', received_at) AS DATE) AS VARCHAR) AS day, round(sum(spint), 3) AS tic, max(spint) AS bpi, count(*) AS n FROM (SELECT DISTINCT sample, trace_id, scan, time, spint, received_at FROM chromatogram WHERE isfinite(spint) AND spint >= 0) GROUP BY 1, 2")
def str_daily_totals(spark, d):
    from massloom.operators.hotdeck import usable_area
    from massloom.streaming.signals import running_totals

    r = table(spark, d, "chromatogram").withColumn("spint", usable_area(F.col("spint"))).filter("spint is not null").select("sample", "trace_id", "scan", "time", "spint", F.col("received_at").alias("at")).distinct()
    return running_totals(r, "1 day").select("sample", F.col("start").cast("date").cast("string").alias("day"), r4("tic", 3).alias("tic"), "bpi", "n")


@query("raw_profile_sum")
def raw_profile_sum(spark, d):
    s = peaks.to_traces(signals(spark, d), ["sample", "trace_id"], "scan", ["time", "spint"]).withColumnRenamed("time", "mz")
    # a trace's place among its sample's, from 0 to 1: the first half minus the second
    w = Window.partitionBy("sample")
    s = s.withColumn("time", (F.row_number().over(w.orderBy("trace_id")) - 1) / F.count(F.lit(1)).over(w))
    return raw.accumulate_profile(s, 0.0, 0.5, 0.0, 1.0).select("sample", F.size("mz").alias("n"))
