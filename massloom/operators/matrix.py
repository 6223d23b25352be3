"""The sample x feature matrix in long form, and the operators of its container.

A matrix is a DataFrame (sample, feature, value, ...) with NULL for not detected. It is
densified once (every sample of a study with each of its features), so that rates count
what was not detected. Metadata columns (class, batch, ord, ...) ride along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.graph import components


def null_if_nan(c: Column) -> Column:
    """Missing is NULL in this engine, never NaN."""
    return F.when(~F.isnan(c), c)


def densify(cells: DataFrame, samples: DataFrame, features: DataFrame, group: str | None = None) -> DataFrame:
    """Every sample with every feature (of the same ``group``), value NULL where no cell is.

    ``samples`` has sample and its metadata, ``features`` has feature. Without a group
    the grid is a product, which is what the result holds anyway.
    """
    on = [group] if group else []
    grid = samples.join(features.select("feature", *on).distinct(), on) if on else samples.crossJoin(features.select("feature").distinct())
    return grid.join(cells.select("sample", "feature", "value"), ["sample", "feature"], "left")


def to_wide(matrix: DataFrame, features: Sequence[object] | None = None) -> DataFrame:
    """Samples in rows, features in columns; naming the features saves a pass over them."""
    p = matrix.groupBy("sample").pivot("feature", list(features)) if features is not None else matrix.groupBy("sample").pivot("feature")
    return p.agg(F.first("value", ignorenulls=True))


def feature_code(label: Column, width: int) -> Column:
    """FT-0012 for label 12 and width 4."""
    return F.concat(F.lit("FT-"), F.lpad(label.cast("string"), width, "0"))


def build_matrix(features: DataFrame, samples: DataFrame, value: str = "area", label: str = "cluster") -> DataFrame:
    """Long matrix (sample, feature, value) of a table of labelled features; -1 is noise and dropped.

    Samples without features stay, with NULL values.
    """
    f = features.filter(F.col(label) >= 0)
    digits = f.agg(F.length(F.max(label).cast("string")).alias("_w"))
    cells = f.groupBy("sample", label).agg(F.max(value).alias("value")).crossJoin(F.broadcast(digits)).withColumn("feature", F.concat(F.lit("FT-"), F.lpad(F.col(label).cast("string"), F.col("_w"), F.lit("0"))))
    return densify(cells, samples.select("sample"), cells)


def feature_metadata(features: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum of mz and rt, and mean limits, for each label."""
    stats = [s(c).alias(f"{c}_{n}") for c in ("mz", "rt") for n, s in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return features.filter(F.col(label) >= 0).groupBy(label).agg(*stats, F.avg("rt_start").alias("rt_start"), F.avg("rt_end").alias("rt_end"))


def range_pairs(points: DataFrame, key: str, x: str, y: str, tol_x: float, tol_y: float, same: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b), a < b, of points nearer than both tolerances: an equi-join on cells.

    One side is spread over the four cells that its tolerance box can touch on one half,
    so that each pair meets once or twice and is made distinct by its order.
    """
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y, *same)
    left = p.select(*same, F.col(key).alias("a"), F.col(x).alias("xa"), F.col(y).alias("ya"), F.floor(F.col(x) / tol_x).alias("ci"), F.floor(F.col(y) / tol_y).alias("cj"))
    spread = F.array(*[F.struct((F.floor(F.col(x) / tol_x) + i).alias("ci"), (F.floor(F.col(y) / tol_y) + j).alias("cj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = p.select(*same, F.col(key).alias("b"), F.col(x).alias("xb"), F.col(y).alias("yb"), F.explode(spread).alias("c")).select("*", "c.ci", "c.cj").drop("c")
    on = [*same, "ci", "cj"]
    return left.join(right, on).filter((F.col("a") < F.col("b")) & (F.abs(F.col("xa") - F.col("xb")) < tol_x) & (F.abs(F.col("ya") - F.col("yb")) < tol_y)).drop("ci", "cj")


def codetection(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, any): samples in which both or any of two features are detected."""
    seen = matrix.filter("value is not null").select("sample", "feature")
    count = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select("a", "b").join(seen.withColumnRenamed("feature", "a"), "a").join(seen.select("sample", F.col("feature").alias("b")), ["sample", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    out = pairs.select("a", "b").join(both, ["a", "b"], "left").join(count.select(F.col("feature").alias("a"), F.col("n").alias("na")), "a", "left").join(count.select(F.col("feature").alias("b"), F.col("n").alias("nb")), "b", "left").na.fill(0, ["both", "na", "nb"])
    return out.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("any"), "na", "nb")


def merge_close(matrix: DataFrame, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Merges close features that are seldom detected together.

    Pairs whose share of common detections is below ``threshold`` are joined (also
    through others); the one detected most often, then the smallest, absorbs the rest,
    whose values are added with NULL as nothing. Returns (sample, feature, value).
    """
    c = codetection(matrix, pairs).filter((F.col("any") > 0) & (F.col("both") < threshold * F.col("any")))
    group = components(c)
    n = matrix.groupBy("feature").agg(F.count("value").alias("n"))
    named = group.withColumnRenamed("node", "feature").join(n, "feature")
    keep = named.groupBy("component").agg(F.max_by("feature", F.struct("n", -F.col("feature") if dict(named.dtypes)["feature"] != "string" else F.lit(0))).alias("into"))
    to = named.join(keep, "component").select("feature", "into")
    return matrix.join(to, "feature", "left").groupBy("sample", F.coalesce("into", "feature").alias("feature")).agg(F.sum("value").alias("value"))


def remove(matrix: DataFrame, names: DataFrame, axis: str) -> DataFrame:
    """Without the named samples or features (``names`` has the axis' column)."""
    return matrix.join(names.select(axis).distinct(), axis, "left_anti")


def keep(matrix: DataFrame, names: DataFrame, axis: str) -> DataFrame:
    """Only the named samples or features."""
    return matrix.join(names.select(axis).distinct(), axis, "left_semi")


def select_features(features: DataFrame, mz: float, rt: float, mz_tol: float = 0.01, rt_tol: float = 5.0) -> DataFrame:
    """Features strictly within both tolerances of a point."""
    return features.filter((F.abs(F.col("mz") - mz) < mz_tol) & (F.abs(F.col("rt") - rt) < rt_tol))


def subset(matrix: DataFrame, keep_by: dict[str, Sequence[object]] | None = None, remove_by: dict[str, Sequence[object]] | None = None) -> DataFrame:
    """Filters by lists for columns, what to keep before what to remove."""
    for c, xs in (keep_by or {}).items():
        matrix = matrix.filter(F.col(c).isin(list(xs)))
    for c, xs in (remove_by or {}).items():
        matrix = matrix.filter(F.col(c).isNull() | ~F.col(c).isin(list(xs)))
    return matrix


def diagnose(matrix: DataFrame, qc: Sequence[str], blank: Sequence[str], study: Sequence[str], dqc: Sequence[str] = ()) -> DataFrame:
    """One row of booleans: empty, missing, and which sample types and metadata there are."""
    has = lambda xs: F.coalesce(F.bool_or(F.col("class").isin(list(xs))), F.lit(False)) if xs else F.lit(False)
    return matrix.agg(
        (F.count(F.lit(1)) == 0).alias("empty"), F.coalesce(F.bool_or(F.col("value").isNull()), F.lit(False)).alias("missing"), has(qc).alias("qc"), has(blank).alias("blank"), has(study).alias("sample"), has(dqc).alias("dqc"),
        (F.count("ord") > 0).alias("order"), (F.count("batch") > 0).alias("batch"),
    )


def interbatch_order(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds inter_order: the order within a batch plus the longest orders of all batches before it."""
    per = samples.groupBy(*by, "batch").agg(F.max("ord").alias("_max"))
    w = Window.partitionBy(*by).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("_off", F.coalesce(F.sum("_max").over(w), F.lit(0))).drop("_max")
    return samples.join(offset, [*by, "batch"]).withColumn("inter_order", F.col("ord") + F.col("_off")).drop("_off")


def default_order(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order 1..n by the sample's name, one batch."""
    return samples.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("sample"))).withColumn("batch", F.lit(1))


def average_replicates(matrix: DataFrame, subject: str, process: Sequence[str]) -> DataFrame:
    """Means over injections of one subject for the process classes; other classes unchanged.

    The injection that comes first names the mean.
    """
    mine = F.col("class").isin(list(process)) & F.col(subject).isNotNull()
    first = matrix.filter(mine).groupBy(subject).agg(F.min("sample").alias("_first"))
    mean = matrix.filter(mine).groupBy(subject, "feature").agg(F.avg("value").alias("value")).join(first, subject).select(F.col("_first").alias("sample"), "feature", "value")
    return mean.unionByName(matrix.filter(F.coalesce(~mine, F.lit(True))).select("sample", "feature", "value"))


def group_isotopologues(features: DataFrame) -> DataFrame:
    """One row for each envelope: its lightest feature and a JSON report of its members.

    ``features`` has feature, mz, abundance, envelope_label, charge and score; label -1
    is no envelope. Abundances are divided by the first member's.
    """
    e = features.filter("envelope_label >= 0").groupBy("envelope_label").agg(F.sort_array(F.collect_list(F.struct("mz", "abundance", "score", "feature"))).alias("m"), F.max("charge").alias("charge"))
    relative = F.transform("m", lambda x: F.round(x["abundance"] / F.col("m")[0]["abundance"], 4))
    return e.select("envelope_label", F.col("m")[0]["feature"].alias("feature"), F.size("m").alias("n"), F.to_json(F.struct("charge", F.col("m.mz").alias("mz"), relative.alias("abundance"), F.col("m.score").alias("score"))).alias("report"))


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
