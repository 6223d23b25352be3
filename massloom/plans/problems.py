"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators import grid, hotdeck, units
from massloom.plans import unit_sql
from massloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.found(grid.regular(table(spark, d, "chromatogram"), table(spark, d, "trace")))


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    s = grid.regular(table(spark, d, "chromatogram"), table(spark, d, "trace"))
    # (a shift keeps the rounding of halves alike in SQL)
    return s.withColumn("value", F.round(F.col("value") + 1e-8, 5))


def p3_areas(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.fill_areas(table(spark, d, "data_matrix"), table(spark, d, "sample_metadata"), table(spark, d, "sample_class"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.fill_classes(table(spark, d, "sample_metadata"), table(spark, d, "sample_class"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.found(p3_areas(spark, d), p3_classes(spark, d))


def _feature_units(spark: SparkSession, d: str) -> DataFrame:
    return units.feature_units(table(spark, d, "feature_metadata"), table(spark, d, "study"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(_feature_units(spark, d), units.trace_units(table(spark, d, "chromatogram"), table(spark, d, "trace")))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    return _feature_units(spark, d).select("feature_id", "rt", "unit", "unit_unique", "rt_sec", "rt_start_sec", "rt_end_sec")


def p5_traces(spark: SparkSession, d: str) -> DataFrame:
    return units.trace_units(table(spark, d, "chromatogram"), table(spark, d, "trace")).withColumn("unit_margin", F.round("unit_margin", 4))


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    return grid.times_in_seconds(table(spark, d, "chromatogram"), table(spark, d, "trace"))


QUERIES = {"p2_found": p2_found, "p2_series": p2_series, "p3_found": p3_found, "p3_areas": p3_areas, "p3_classes": p3_classes, "p5_found": p5_found, "p5_features": p5_features, "p5_traces": p5_traces, "p5_readings": p5_readings}
#: every donor of the widest block by distance; the first five fill
_DONORS = """r AS ({records}),
    p AS (SELECT a.record, d.record AS donor, d.value, {apart} + coalesce(abs(a.run - d.run), 100) / (coalesce(abs(a.run - d.run), 100) + 10) AS distance
          FROM r a JOIN r d ON a.block = d.block WHERE a.value IS NULL AND d.value IS NOT NULL),
    n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY record ORDER BY distance, donor) <= 5),
    w AS (SELECT *, 1 / (1 + distance) AS w FROM n),
    l AS (SELECT record, CAST(count(*) AS INTEGER) AS n_donors, list(donor ORDER BY distance, donor) AS donors FROM n GROUP BY 1)"""
_RESULT = """SELECT r.record, coalesce(r.value, b.value) AS value, r.value IS NULL AS filled, CASE WHEN r.value IS NULL THEN coalesce(n_donors, 0) ELSE 0 END AS n_donors, CASE WHEN r.value IS NULL THEN coalesce(donors, []) END AS donors
    FROM r LEFT JOIN b ON b.record = r.record LEFT JOIN l ON l.record = r.record"""
_INJECTIONS = """k AS (SELECT lower(trim(class)) AS c, min(trim(class)) AS class FROM sample_class WHERE class IS NOT NULL GROUP BY 1),
    s AS (SELECT sample_id, max(k.class) AS class, max(study) AS study, max(id) AS subject, max(batch) AS batch, max(CAST(run_order AS DOUBLE)) AS run FROM sample_metadata m LEFT JOIN k ON k.c = lower(trim(m.class)) WHERE sample_id IS NOT NULL GROUP BY 1)"""


def _apart(*features: str) -> str:
    return " + ".join(f"CASE WHEN a.{f} = d.{f} THEN 0 ELSE 1 END" for f in features)


_CELLS = """SELECT cell_id AS record, value, feature_id AS block, s.class, subject, batch, run FROM
    (SELECT cell_id, feature_id, sample_id, max(CASE WHEN isfinite(area) AND area >= 0 THEN area END) AS value FROM data_matrix WHERE cell_id IS NOT NULL GROUP BY 1, 2, 3) c LEFT JOIN s ON s.sample_id = c.sample_id"""
SQL: dict[str, str] = {
    "p3_areas": f"""WITH {_INJECTIONS}, {_DONORS.format(records=_CELLS, apart=_apart("subject", "class", "batch"))},
        c AS (SELECT *, sum(w) OVER (PARTITION BY record ORDER BY value, w ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY record) AS total FROM w),
        b AS (SELECT record, min(value) AS value FROM c WHERE upto >= total / 2 - 1e-12 GROUP BY 1) {_RESULT}""",
    "p3_classes": f"""WITH {_INJECTIONS}, {_DONORS.format(records="SELECT sample_id AS record, class AS value, study AS block, subject, batch, run FROM s", apart=_apart("subject", "batch"))},
        v AS (SELECT record, value, round(sum(w), 12) AS votes FROM w GROUP BY 1, 2), b AS (SELECT record, value FROM v QUALIFY row_number() OVER (PARTITION BY record ORDER BY votes DESC, value) = 1) {_RESULT}""",
    "p3_found": """
        SELECT DISTINCT 'data_matrix' AS table_name, cell_id AS record_id FROM data_matrix
        WHERE area IS NULL OR isnan(area) OR isinf(area) OR area < 0
        UNION ALL
        SELECT DISTINCT 'sample_metadata', sample_id FROM sample_metadata
        WHERE class IS NULL OR lower(trim(class)) NOT IN (SELECT lower(trim(class)) FROM sample_class)""",
    **unit_sql.SQL,
}
