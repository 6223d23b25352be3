"""Features of many samples brought together: density clusters, species, unique assignment, and filling gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions import kernels
from massloom.operators.graph import components, positions
from massloom.operators.raw import window_join
from massloom.session import cut


def dbscan(points: DataFrame, key: str, x: str, y: str, eps_x: float, eps_y: float, least: int) -> DataFrame:
    """Density clusters under the maximum norm: (key, cluster), -1 for noise; clusters named by their smallest core key (keys are numbers from 0).

    Neighbours meet on grid cells. A cell of eps side whose points number ``least`` or
    more needs no pairs to know that they are all core; counting pairs is left to
    sparse cells. Core points of one cell are linked through one of them. A border point
    goes to the cluster with the smallest name.
    """
    half_x, half_y = eps_x / 2, eps_y / 2
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = cut(p.withColumn("i", F.floor(F.col("x") / half_x)).withColumn("j", F.floor(F.col("y") / half_y)))
    size = p.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("head"))
    sized = p.join(size, ["i", "j"])
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-2, 3) for b in range(-2, 3)]))
    sparse = sized.filter(F.col("n") < least).select(F.col("k").alias("k0"), F.col("x").alias("x0"), F.col("y").alias("y0"), around.alias("c")).select("k0", "x0", "y0", "c.*")
    near = (F.abs(F.col("x") - F.col("x0")) <= eps_x) & (F.abs(F.col("y") - F.col("y0")) <= eps_y)
    counted = sparse.join(p, ["i", "j"]).filter(near).groupBy("k0").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least).select(F.col("k0").alias("k"))
    core = cut(sized.filter(F.col("n") >= least).select("k", "x", "y", "i", "j").unionByName(sized.join(counted, "k", "left_semi").filter(F.col("n") < least).select("k", "x", "y", "i", "j")))
    heads = core.groupBy("i", "j").agg(F.min("k").alias("head"))
    # all core points of a cell are one; cells are linked where two of their core points are near
    box = core.groupBy("i", "j").agg(F.min("k").alias("head"), *[f(c).alias(n) for c, n, f in (("x", "x0", F.min), ("x", "x1", F.max), ("y", "y0", F.min), ("y", "y1", F.max))])
    ask = box.select(F.col("head").alias("a"), F.col("i").alias("ai"), F.col("j").alias("aj"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")], around.alias("c")).select("*", "c.*").drop("c")
    pairs = ask.join(box.withColumnRenamed("head", "b"), ["i", "j"]).filter("a < b")
    far = (F.greatest(F.col("ax1"), F.col("x1")) - F.least(F.col("ax0"), F.col("x0")) <= eps_x) & (F.greatest(F.col("ay1"), F.col("y1")) - F.least(F.col("ay0"), F.col("y0")) <= eps_y)
    apart = (F.greatest(F.col("ax0"), F.col("x0")) - F.least(F.col("ax1"), F.col("x1")) > eps_x) | (F.greatest(F.col("ay0"), F.col("y0")) - F.least(F.col("ay1"), F.col("y1")) > eps_y)
    sure = pairs.filter(far).select("a", "b")
    maybe = pairs.filter(~far & ~apart).select("a", "b", "ai", "aj", F.col("i").alias("bi"), F.col("j").alias("bj"))
    tested = maybe.join(core.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("x").alias("x0"), F.col("y").alias("y0")), ["ai", "aj"]).join(core.select(F.col("i").alias("bi"), F.col("j").alias("bj"), "x", "y"), ["bi", "bj"]).filter(near).select("a", "b").distinct()
    linked = components(cut(sure.unionByName(tested)))
    named = core.join(heads, ["i", "j"]).join(linked.withColumnRenamed("node", "head"), "head", "left").select("k", "x", "y", "i", "j", F.coalesce("component", "head").alias("cluster"))
    named = cut(named)
    rest = p.join(named, "k", "left_anti").select(F.col("k").alias("k0"), F.col("x").alias("x0"), F.col("y").alias("y0"), around.alias("c")).select("k0", "x0", "y0", "c.*")
    border = rest.join(named.select("i", "j", "x", "y", "cluster"), ["i", "j"]).filter(near).groupBy(F.col("k0").alias("k")).agg(F.min("cluster").alias("cluster"))
    all_named = named.select("k", "cluster").unionByName(border)
    return points.select(F.col(key).alias("k")).join(all_named, "k", "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def least_samples(sizes: dict[object, int], fraction: float) -> int:
    """Smallest number of samples of a cluster: the fraction (rounded to even) of the smallest class."""
    return max(1, min(round(n * fraction) for n in sizes.values()))


def species_count(features: DataFrame, sizes: DataFrame, fraction: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """(cluster, species): how many features a sample has in a cluster, in enough samples of some class.

    ``features`` has sample, class and cluster; ``sizes`` has class and n. For each class
    the largest number that at least round(n * fraction) samples show, the maximum over classes.
    """
    per = features.filter("cluster >= 0").groupBy(*by, "cluster", "class", "sample").agg(F.count(F.lit(1)).alias("k"))
    hist = per.groupBy(*by, "cluster", "class", "k").agg(F.count(F.lit(1)).alias("m")).join(sizes, [*by, "class"])
    ok = F.col("m") >= F.greatest(F.bround(F.col("n") * fraction), F.lit(1))
    return hist.groupBy(*by, "cluster").agg(F.coalesce(F.max(F.when(ok, F.col("k"))), F.lit(0)).alias("species"))


def unique_nearest(features: DataFrame, by: Sequence[str] = (), max_deviation: float = 3.0) -> DataFrame:
    """One species: the feature of each sample nearest to its cluster's mean, in standard deviations; others get -1.

    Adds deviation, to six decimals, and label. Ties go to the smaller mass.
    """
    s = features.groupBy(*by, "cluster").agg(F.avg("mz").alias("_m"), F.stddev_pop("mz").alias("_sm"), F.avg("rt").alias("_r"), F.stddev_pop("rt").alias("_sr"))
    d = lambda c, m, sd: F.coalesce(F.abs(F.col(c) - F.col(m)) / F.nullif(F.col(sd), F.lit(0.0)), F.lit(0.0))
    f = features.join(s, [*by, "cluster"]).withColumn("deviation", F.round(F.greatest(d("mz", "_m", "_sm"), d("rt", "_r", "_sr")), 6))
    w = Window.partitionBy(*by, "cluster", "sample").orderBy("deviation", "mz", "rt")
    f = f.withColumn("_k", F.row_number().over(w))
    return f.withColumn("label", F.when((F.col("_k") == 1) & (F.col("deviation") <= max_deviation), F.col("cluster")).otherwise(F.lit(-1))).drop("_m", "_sm", "_r", "_sr", "_k")


def assign_species(features: DataFrame, key: str, max_deviation: float = 3.0) -> DataFrame:
    """Several species: a diagonal mixture for each cluster, and each sample's features assigned with the least total deviation.

    ``features`` has key, sample, cluster, species, mz and rt. Returns (key, cluster,
    species_no), species_no -1 where the deviation is too large. A group is one density
    cluster: at most a few features of each sample.
    """
    kind = dict(features.dtypes)
    schema = f"{key} {kind[key]}, cluster bigint, species_no int, indecisive double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["species"].iloc[0])
        x = pdf[["mz", "rt"]].to_numpy(float)
        out = np.full(len(pdf), -1)
        doubt = 0
        if k > 0:
            mu, sd = kernels.diagonal_mixture(x, min(k, len(x)))
            dev = np.abs(x[:, None] - mu).__truediv__(np.maximum(sd, 1e-12)).max(2)
            samples = pdf["sample"].to_numpy()
            for s in pd.unique(samples):
                at = np.flatnonzero(samples == s)
                doubt += bool(((dev[at] <= max_deviation).sum(1) > 1).any())
                for r, c in kernels.assign(np.minimum(dev[at], 1e9)):
                    if dev[at[r], c] <= max_deviation:
                        out[at[r]] = c
            doubt /= len(pd.unique(samples))
        return pd.DataFrame({key: pdf[key], "cluster": pdf["cluster"].astype("int64"), "species_no": out.astype("int32"), "indecisive": float(doubt)})

    return features.filter("cluster >= 0").groupBy("cluster").applyInPandas(run, schema)


def match_features(features: DataFrame, key: str, mz_tol: float, rt_tol: float, fraction: float = 0.25, max_deviation: float = 3.0) -> DataFrame:
    """Correspondence end to end: (key, label), -1 for noise; labels count up over clusters and species."""
    features = cut(features.select(key, "sample", "class", "mz", "rt"))
    sizes = features.select("class", "sample").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min(F.bround(F.col("n") * fraction))).first()[0]
    c = dbscan(features, key, "mz", "rt", mz_tol, rt_tol, max(1, int(least or 1)))
    f = cut(features.join(c, key))
    species = species_count(f, sizes, fraction)
    got = assign_species(f.join(species, "cluster"), key, max_deviation)
    offset = positions(species, ["cluster"], "species").withColumnRenamed("position", "offset")
    labelled = got.join(offset, "cluster").select(key, F.when(F.col("species_no") >= 0, F.col("offset") + F.col("species_no")).otherwise(F.lit(-1)).alias("label"))
    return features.select(key).join(labelled, key, "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))


def _to_fill(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """Cells without a value, once each, with what is known of their feature."""
    return matrix.filter("value is null").select("sample", "feature").distinct().join(features.select("feature", "mz", "rt", "rt_std", "rt_start", "rt_end"), "feature")


def signals_to_fill(matrix: DataFrame, features: DataFrame, signals: DataFrame, mz_tol: float) -> DataFrame:
    """Each of ``signals`` (sample, mz, ...) with each feature that its own sample lacks and whose window it lies in."""
    targets = _to_fill(matrix, features).select("sample", F.col("feature").alias("target"), F.col("mz").alias("mz_target"))
    return window_join(signals, targets, mz_tol, by=["sample"]).withColumnRenamed("target", "feature")


def fill_by_integration(matrix: DataFrame, features: DataFrame, signals: DataFrame, mz_tol: float, n_dev: float = 3.0, estimate: bool = True) -> DataFrame:
    """Missing cells from the raw signals: (sample, feature, value, code): 0 observed, 1 peak found, 2 estimated.

    Chromatograms are extracted only for cells without a value: a signal meets no feature
    but those that its own sample lacks. A peak within n_dev
    deviations of the feature's retention gives its area, else the area between the
    feature's limits is the estimate, or 0.
    """
    need = _to_fill(matrix, features)
    eic = signals_to_fill(matrix, features, signals, mz_tol).groupBy("sample", "feature", "time").agg(F.sum("spint").alias("spint"))
    arrays = eic.groupBy("sample", "feature").agg(F.array_sort(F.collect_list(F.struct("time", "spint"))).alias("p")).join(need, ["sample", "feature"])
    schema = T.StructType([*[f for f in arrays.schema.fields if f.name in ("sample", "feature")], T.StructField("area", T.DoubleType()), T.StructField("code", T.IntegerType())])
    names = schema.names

    def integrate(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                t = np.array([q["time"] for q in r["p"]], float)
                y = np.array([q["spint"] for q in r["p"]], float)
                sd = r["rt_std"]
                peaks = [q for q in kernels.pick(t, y) if sd is not None and np.isfinite(sd) and abs(q["rt"] - r["rt"]) < n_dev * sd]
                if peaks:
                    value, code = min(peaks, key=lambda q: abs(q["rt"] - r["rt"]))["area"], 1
                else:
                    inside = (t >= r["rt_start"]) & (t < r["rt_end"]) if r["rt_start"] is not None and r["rt_end"] is not None else np.zeros(len(t), bool)
                    tt, yy = t[inside], y[inside]
                    value, code = (float(((yy[1:] + yy[:-1]) / 2 * np.diff(tt)).sum()) if estimate and len(tt) > 1 else 0.0), 2
                rows.append([r[n] for n in names[:2]] + [float(value), code])
            yield pd.DataFrame(rows, columns=names)

    got = arrays.mapInPandas(integrate, schema)
    out = matrix.select("sample", "feature", "value").join(got, ["sample", "feature"], "left")
    missing = F.col("value").isNull()
    return out.select("sample", "feature", F.when(missing, F.coalesce("area", F.lit(0.0))).otherwise(F.col("value")).alias("value"), F.when(missing, F.coalesce("code", F.lit(2))).otherwise(0).alias("code"))


def fill_by_neighbours(matrix: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """Missing values from the k samples nearest within each group (study and class): (sample, feature, value).

    A group is one class of one study, which is what bounds it. A feature that no sample
    of the group has becomes 0.
    """
    fields = {f.name: f.dataType.simpleString() for f in matrix.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="sample", columns="feature", values="value", aggfunc="first", dropna=False)
        filled = kernels.knn_fill(wide.to_numpy(float), k)
        out = pd.DataFrame(filled, index=wide.index, columns=wide.columns).stack().rename("value").reset_index()
        return out[["sample", "feature", "value"]]

    return matrix.select(*by, "sample", "feature", "value").groupBy(*by).applyInPandas(run, f"sample {fields['sample']}, feature {fields['feature']}, value double")
