"""Peak picking on traces, each a row of arrays: one row is one unit of work, whatever the sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions import kernels

DESCRIPTORS = ["height", "area", "rt", "width", "extension", "snr", "mz", "mz_std", "rt_start", "rt_end"]
#: default bounds by separation
BOUNDS = {"uplc": {"width": (4.0, 60.0), "snr": (5.0, None)}, "hplc": {"width": (10.0, 90.0), "snr": (5.0, None)}}


def to_traces(points: DataFrame, keys: Sequence[str], order: str = "time", columns: Sequence[str] = ("time", "spint")) -> DataFrame:
    """Long points to one row of arrays for each trace, in the given order."""
    p = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{c}") for c in columns])))
    return points.groupBy(*keys).agg(p.alias("_p")).select(*keys, *[F.col(f"_p._{c}").alias(c) for c in columns])


def detect(traces: DataFrame, keys: Sequence[str], smoothing: float = 1.0, times_noise: float = 3.0, custom: dict[str, Callable[..., float]] | None = None) -> DataFrame:
    """Peaks of each trace with their descriptors: keys, ft_index, start, apex, end, height, ...

    ``traces`` has time and spint arrays, and mz where there is one. ``custom`` adds
    descriptors, each a function of (time, spint, start, apex, end).
    """
    has_mz = "mz" in traces.columns
    fields = [f for f in traces.schema.fields if f.name in keys]
    extra = list(custom or {})
    schema = T.StructType([*fields, *[T.StructField(c, T.IntegerType()) for c in ("ft_index", "start", "apex", "end")], *[T.StructField(c, T.DoubleType()) for c in [*DESCRIPTORS, *extra]]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                t, y = np.array(r["time"], float), np.array(r["spint"], float)
                mz = np.array(r["mz"], float) if has_mz and r["mz"] is not None else None
                for i, p in enumerate(kernels.pick(t, y, mz, smoothing, times_noise)):
                    more = [float(f(t, y, p["start"], p["apex"], p["end"])) for f in (custom or {}).values()]
                    rows.append([*[r[k] for k in keys], i, p["start"], p["apex"], p["end"], *[p.get(c) for c in DESCRIPTORS], *more])
            yield pd.DataFrame(rows, columns=schema.names)

    return traces.select(*keys, "time", "spint", *(["mz"] if has_mz else [])).mapInPandas(run, schema)


def within(features: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Features whose descriptors lie within inclusive bounds; None is no bound. NULL or NaN fails."""
    for c, (lo, hi) in bounds.items():
        v = F.col(c)
        ok = v.isNotNull() & ~F.isnan(v)
        if lo is not None:
            ok &= v >= lo
        if hi is not None:
            ok &= v <= hi
        features = features.filter(ok)
    return features


def local_maxima(points: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Points strictly higher than the one before and the one after."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def trapezoid(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area under each trace."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("_part", part).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"))


def central_width(points: DataFrame, keys: Sequence[str], x: str, y: str, share: float = 0.95) -> DataFrame:
    """Span of x that holds the central share of the summed y."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    c = points.withColumn("_c", F.sum(y).over(w)).withColumn("_t", F.sum(y).over(Window.partitionBy(*keys)))
    tail = (1 - share) / 2
    lo = F.min(F.when(F.col("_c") >= tail * F.col("_t"), F.col(x)))
    hi = F.min(F.when(F.col("_c") >= (1 - tail) * F.col("_t"), F.col(x)))
    return c.groupBy(*keys).agg((hi - lo).alias("width"))


def weighted_position(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Intensity-weighted mean of x."""
    return points.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(y), F.lit(0.0))).alias("position"))


def smooth(points: DataFrame, keys: Sequence[str], order: str, value: str, weights: Sequence[float]) -> DataFrame:
    """Weighted moving mean, inside the JVM; the weights are renormalised at the ends."""
    r = len(weights) // 2
    w = Window.partitionBy(*keys).orderBy(order)
    shifted = [(k, F.lag(value, -k).over(w)) for k in range(-r, r + 1)]
    top, low = F.lit(0.0), F.lit(0.0)
    for (k, c), z in zip(shifted, weights):
        top, low = top + F.coalesce(c, F.lit(0.0)) * z, low + F.when(c.isNotNull(), F.lit(z)).otherwise(0.0)
    return points.withColumn("smooth", top / F.nullif(low, F.lit(0.0)))


def fill_missing_points(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Missing y from its neighbours on both sides, linearly in x; the nearest one at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    here = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    p = points.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    return p.withColumn("filled", F.when(F.col(y).isNotNull(), F.col(y)).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(line)).drop("_a", "_b")


def similarity(points: DataFrame, key: str, at: Sequence[str], value: str, pairs: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """Cosine of paired features (a, b) over the points they share; 0 if they overlap by no more than half the shorter one."""
    norm = points.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"), F.count(F.lit(1)).alias("_n"))
    p = pairs.select("a", "b")
    pa = p.join(points.select(F.col(key).alias("a"), *at, F.col(value).alias("_va")), "a")
    dot = pa.join(points.select(F.col(key).alias("b"), *at, F.col(value).alias("_vb")), ["b", *at]).groupBy("a", "b").agg(F.sum(F.col("_va") * F.col("_vb")).alias("_dot"), F.count(F.lit(1)).alias("_both"))
    out = p.join(dot, ["a", "b"], "left").join(norm.select(F.col(key).alias("a"), F.col("_norm").alias("_na"), F.col("_n").alias("_ca")), "a").join(norm.select(F.col(key).alias("b"), F.col("_norm").alias("_nb"), F.col("_n").alias("_cb")), "b")
    overlap = F.coalesce("_both", F.lit(0)) / F.least("_ca", "_cb")
    cosine = F.coalesce(F.col("_dot") / F.nullif(F.col("_na") * F.col("_nb"), F.lit(0.0)), F.lit(0.0))
    return out.select("a", "b", overlap.alias("overlap"), F.when(overlap > least_overlap, cosine).otherwise(0.0).alias("similarity"))


def envelope(points: DataFrame, keys: Sequence[str], feature: str, scan: str, x: str, y: str) -> DataFrame:
    """Shares of area of an envelope's features over the scans that all of them have, and their masses' order."""
    span = points.groupBy(*keys, feature).agg(F.min(scan).alias("_lo"), F.max(scan).alias("_hi")).groupBy(*keys).agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    inside = points.join(span, list(keys)).filter(F.col(scan).between(F.col("_lo"), F.col("_hi")))
    area = trapezoid(inside, [*keys, feature], x, y)
    return area.withColumn("p", F.col("area") / F.nullif(F.sum("area").over(Window.partitionBy(*keys)), F.lit(0.0)))


def centroid_column(mz: Column, spint: Column, min_snr: float = 10.0, min_distance: float = 0.01) -> Column:
    """Struct of mz and spint arrays: the peaks of a profile spectrum."""

    @F.pandas_udf(T.StructType([T.StructField("mz", T.ArrayType(T.DoubleType())), T.StructField("spint", T.ArrayType(T.DoubleType()))]))
    def run(m: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = [kernels.centroids(np.array(a, float), np.array(b, float), min_snr, min_distance) if a is not None and b is not None and len(a) else (np.zeros(0), np.zeros(0)) for a, b in zip(m, s)]
        return pd.DataFrame({"mz": [list(a) for a, _ in out], "spint": [list(b) for _, b in out]})

    return run(mz, spint)
