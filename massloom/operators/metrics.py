"""Quality metrics of a long matrix: aggregations that Catalyst plans with a partial step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: standard normal quantile at 3/4: scales a median deviation to a standard deviation
NORMAL_MAD = 0.6744897501960817


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.nullif(b, F.lit(0.0))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Linear correlation, NULL where one side is constant."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def cv(matrix: DataFrame, by: Sequence[str] = ("class",), fill: float | None = float("inf")) -> DataFrame:
    """Coefficient of variation for each group and feature; ``fill`` where it has none."""
    out = matrix.groupBy(*by, "feature").agg(ratio(F.stddev_samp("value"), F.avg("value")).alias("cv"))
    return out if fill is None else out.withColumn("cv", F.coalesce("cv", F.lit(fill)))


def mad(matrix: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Normal-scaled median absolute deviation and median; NULL deviation for one value."""
    keys = [*by, "feature"]
    mid = matrix.groupBy(*keys).agg(F.median("value").alias("median"), F.count("value").alias("_n"))
    dev = matrix.join(mid, keys).groupBy(*keys).agg((F.median(F.abs(F.col("value") - F.col("median"))) / NORMAL_MAD).alias("mad"), F.first("median").alias("median"), F.first("_n").alias("_n"))
    return dev.withColumn("mad", F.when(F.col("_n") > 1, F.col("mad"))).drop("_n")


def robust_cv(matrix: DataFrame, by: Sequence[str] = ("class",), fill: float | None = float("inf")) -> DataFrame:
    """Normal-scaled median deviation over the median."""
    out = mad(matrix, by).select(*by, "feature", ratio(F.col("mad"), F.col("median")).alias("cv"))
    return out if fill is None else out.withColumn("cv", F.coalesce("cv", F.lit(fill)))


def dratio(matrix: DataFrame, qc: Sequence[str], study: Sequence[str], robust: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Deviation of quality controls over that of study samples, infinite where it has none."""
    m = matrix.withColumn("_kind", F.when(F.col("class").isin(list(qc)), "qc").when(F.col("class").isin(list(study)), "sample")).filter("_kind is not null")
    if robust:
        d = mad(m, [*by, "_kind"]).withColumnRenamed("mad", "_s")
    else:
        d = m.groupBy(*by, "_kind", "feature").agg(F.stddev_samp("value").alias("_s"))
    one = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_s")))
    return d.groupBy(*by, "feature").agg(F.coalesce(ratio(one("qc"), one("sample")), F.lit(float("inf"))).alias("dratio"))


def detection_rate(matrix: DataFrame, by: Sequence[str] = ("class",), threshold: float = 0.0) -> DataFrame:
    """Share of samples above the threshold, among all samples of the densified matrix."""
    return matrix.groupBy(*by, "feature").agg((F.count_if(F.col("value") > threshold) / F.count(F.lit(1))).alias("dr"))


def ols(matrix: DataFrame, field: str) -> DataFrame:
    """Linear fit of each feature on a field: slope, intercept, r2, Durbin-Watson and Jarque-Bera p.

    Residuals are taken in the order of the field, then of the sample. Those of a perfect
    fit are rounding errors: it has no Jarque-Bera value.
    """
    m = matrix.filter(F.col("value").isNotNull() & F.col(field).isNotNull()).withColumn("_x", F.col(field).cast("double"))
    fit = m.groupBy("feature").agg(F.regr_slope("value", "_x").alias("slope"), F.regr_intercept("value", "_x").alias("intercept"), F.regr_r2("value", "_x").alias("r2"), F.count(F.lit(1)).alias("n"))
    e = m.join(fit, "feature").withColumn("_e", F.col("value") - F.col("intercept") - F.col("slope") * F.col("_x"))
    e = e.withColumn("_d", F.col("_e") - F.lag("_e").over(Window.partitionBy("feature").orderBy("_x", "sample")))
    t = e.groupBy("feature").agg(ratio(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("_e") * F.col("_e"))).alias("dw"), F.avg(F.pow("_e", F.lit(2))).alias("_m2"), F.avg(F.pow("_e", F.lit(3))).alias("_m3"), F.avg(F.pow("_e", F.lit(4))).alias("_m4"))
    skew = ratio(F.col("_m3"), F.pow("_m2", F.lit(1.5)))
    kurt = ratio(F.col("_m4"), F.col("_m2") * F.col("_m2"))
    jb = F.col("n") / 6.0 * (skew * skew + (kurt - 3.0) * (kurt - 3.0) / 4.0)
    jb = F.when(F.col("r2") <= 1 - 1e-12, jb)
    return fit.join(t, "feature").select("feature", "n", "slope", "intercept", "r2", "dw", jb.alias("jb"), F.exp(-jb / 2.0).alias("jb_p"))


def pearson(matrix: DataFrame, field: str) -> DataFrame:
    """Linear correlation of each feature with a field."""
    return matrix.filter(F.col("value").isNotNull() & F.col(field).isNotNull()).groupBy("feature").agg(correlation("value", F.col(field).cast("double")).alias("r"))


def mean_rank(value: str, by: Sequence[str]) -> Column:
    """Rank with ties at their mean."""
    w, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(matrix: DataFrame, field: str) -> DataFrame:
    """Rank correlation of each feature with a field."""
    m = matrix.filter(F.col("value").isNotNull() & F.col(field).isNotNull())
    r = m.withColumn("_a", mean_rank("value", ["feature"])).withColumn("_b", mean_rank(field, ["feature"]))
    return r.groupBy("feature").agg(correlation("_a", "_b").alias("rho"))


def pairwise_correlation(matrix: DataFrame, group: str | None = None, least: int = 3) -> DataFrame:
    """Correlation of every two features (of one ``group``) over the samples that have both.

    All pairs are what is asked for here; each sample's values meet by an equi-join.
    """
    on = ["sample", *([group] if group else [])]
    m = matrix.filter("value is not null").select(*on, "feature", "value")
    j = m.withColumnsRenamed({"feature": "a", "value": "va"}).join(m.withColumnsRenamed({"feature": "b", "value": "vb"}), on).filter("a < b")
    return j.groupBy("a", "b").agg(correlation("va", "vb").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def weighted_stats(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, population standard deviation and their ratio."""
    s = df.groupBy(*by).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(value)).alias("_wx"), F.sum(F.col(weight) * F.col(value) * F.col(value)).alias("_wxx"))
    mean = ratio(F.col("_wx"), F.col("_w"))
    std = F.sqrt(F.greatest(ratio(F.col("_wxx"), F.col("_w")) - mean * mean, F.lit(0.0)))
    return s.select(*by, mean.alias("mean"), std.alias("std"), ratio(std, mean).alias("rsd"))


def two_groups(matrix: DataFrame, a: Sequence[str], b: Sequence[str], zero_missing: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """For each feature the counts, means, variances and detections of two groups of classes."""
    v = F.coalesce("value", F.lit(0.0)) if zero_missing else F.col("value")
    m = matrix.withColumn("_v", v).withColumn("_g", F.when(F.col("class").isin(list(a)), 1).when(F.col("class").isin(list(b)), 2)).filter("_g is not null")
    x = lambda g: F.when(F.col("_g") == g, F.col("_v"))
    return m.groupBy(*by, "feature").agg(
        *[f.alias(f"{n}{g}") for g in (1, 2) for n, f in (("n", F.count(x(g))), ("mean", F.avg(x(g))), ("var", F.var_samp(x(g))), ("found", F.count(F.when(F.col("_g") == g, F.col("value")))), ("all", F.count_if(F.col("_g") == g)))]
    )


def cohen_d(stats: DataFrame) -> DataFrame:
    """Adds cohen_d to two_groups: difference of means over the pooled standard deviation."""
    pooled = F.sqrt(ratio((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), (F.col("n1") + F.col("n2") - 2).cast("double")))
    return stats.withColumn("cohen_d", ratio(F.col("mean1") - F.col("mean2"), pooled))


def welch(stats: DataFrame) -> DataFrame:
    """Adds Welch's t and its degrees of freedom to two_groups."""
    s1, s2 = ratio(F.col("var1"), F.col("n1").cast("double")), ratio(F.col("var2"), F.col("n2").cast("double"))
    df = ratio((s1 + s2) * (s1 + s2), ratio(s1 * s1, (F.col("n1") - 1).cast("double")) + ratio(s2 * s2, (F.col("n2") - 1).cast("double")))
    return stats.withColumn("t", ratio(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2))).withColumn("df", df)


def overview(matrix: DataFrame) -> DataFrame:
    """Number of features that so many samples of each class detect: (class, detected, features)."""
    n = matrix.groupBy("class", "feature").agg(F.count("value").alias("detected"))
    return n.groupBy("class", "detected").agg(F.count(F.lit(1)).alias("features"))


def pipeline_metrics(matrix: DataFrame) -> DataFrame:
    """Numbers of features and samples, and the median over features of the median CV over classes."""
    c = cv(matrix, fill=0.0).groupBy("feature").agg(F.median("cv").alias("cv"))
    return matrix.agg(F.countDistinct("feature").alias("features"), F.countDistinct("sample").alias("samples")).crossJoin(c.agg(F.median("cv").alias("cv")))


def dense(pdf, rows: str, columns: str, scaling: bool):
    """Names and matrix of a long group: values centred by column, or standardised; NULL as 0, what isn't there adds nothing."""
    import numpy as np

    v = pdf["value"].astype(float).fillna(0.0)
    g = v.groupby(pdf[columns])
    v = v - g.transform("mean")
    if scaling:
        s = g.transform("std", ddof=0).to_numpy()
        v = v / np.where(s == 0, np.inf, s)
    r, names = pdf[rows].factorize(sort=True)
    c, features = pdf[columns].factorize(sort=True)
    x = np.zeros((len(names), len(features)))
    np.add.at(x, (r, c), v.to_numpy())
    return names, x


def pca_by(matrix: DataFrame, by: str, components: int = 2, scaling: bool = False) -> DataFrame:
    """Scores (by, sample, component, score) of ``pca`` within each group, at once for all groups.

    A group's matrix of samples x features goes to one task. Rows without a group are left out.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(matrix.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = dense(pdf, "sample", "feature", scaling)
        values, vectors = np.linalg.eigh(x.T @ x / max(1, len(names) - 1))
        vectors = vectors[:, np.argsort(values)[::-1][:components]]
        k = vectors.shape[1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(k)])
        return pd.DataFrame({by: pdf[by].iloc[0], "sample": np.repeat(np.asarray(names), k), "component": np.tile(np.arange(k, dtype="int32"), len(names)), "score": (x @ vectors).ravel()})

    m = matrix.filter(F.col(by).isNotNull() & F.col("sample").isNotNull() & F.col("feature").isNotNull()).select(by, "sample", "feature", "value")
    return m.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, sample {kinds['sample']}, component int, score double")


def pca(matrix: DataFrame, components: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """Principal components of a matrix whose NULLs count as 0: scores, loadings, variances.

    The covariance of features is aggregated by Spark from the long form (pairs of
    features that share a sample); only that square matrix, bounded by the number of
    features squared, comes to the driver. Signs are fixed by the largest loading.
    """
    import numpy as np

    spark = matrix.sparkSession
    m = matrix.select("sample", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    mean = m.groupBy("feature").agg(F.avg("value").alias("_m"))
    c = m.join(mean, "feature").select("sample", "feature", (F.col("value") - F.col("_m")).alias("v"))
    names = [r[0] for r in mean.select("feature").orderBy("feature").collect()]
    at = {n: i for i, n in enumerate(names)}
    n = m.select("sample").distinct().count()
    pairs = c.withColumnsRenamed({"feature": "a", "v": "va"}).join(c.withColumnsRenamed({"feature": "b", "v": "vb"}), "sample").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    cov = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        cov[at[r["a"]], at[r["b"]]] = cov[at[r["b"]], at[r["a"]]] = r["s"] / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(len(order))])
    dtype = dict(mean.dtypes)["feature"]
    load = spark.createDataFrame([(names[i], int(k), float(vectors[i, k])) for i in range(len(names)) for k in range(len(order))], f"feature {dtype}, component int, loading double")
    scores = c.join(load, "feature").groupBy("sample", "component").agg(F.sum(F.col("v") * F.col("loading")).alias("score"))
    return scores, load, [float(v) for v in values[order]]
