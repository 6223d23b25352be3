"""Run order: blocks of samples, drift within batches and levels between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions import kernels
from massloom.operators.matrix import null_if_nan
from massloom.operators.metrics import ratio

#: rows of a task that are corrected together
GATHER_ROWS = 50_000


def sample_blocks(samples: DataFrame, correctors: Sequence[str], process: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds block_type (0 corrector, 1 process, 2 other) and block_number along the run order."""
    kind = F.when(F.col("class").isin(list(correctors)), 0).when(F.col("class").isin(list(process)), 1).otherwise(2)
    w = Window.partitionBy(*by).orderBy("ord", "sample")
    s = samples.withColumn("block_type", kind)
    s = s.withColumn("_new", F.coalesce((F.col("block_type") != F.lag("block_type").over(w)).cast("int"), F.lit(0)))
    return s.withColumn("block_number", F.sum("_new").over(w)).drop("_new")


def batch_extremes(samples: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First and last order of some classes in each batch."""
    return samples.filter(F.col("class").isin(list(classes))).groupBy(*by, "batch").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def invalid_samples(samples: DataFrame, qc: Sequence[str], study: Sequence[str], by: Sequence[str] = (), least: int = 4) -> DataFrame:
    """Samples that no controls bracket: of batches with too few, or before the first or after the last one."""
    is_qc = F.col("class").isin(list(qc))
    q = samples.groupBy(*by, "batch").agg(F.count_if(is_qc).alias("_n"), F.min(F.when(is_qc, F.col("ord"))).alias("_a"), F.max(F.when(is_qc, F.col("ord"))).alias("_b"))
    s = samples.join(q, [*by, "batch"])
    out = (F.col("_n") < least) | (F.col("class").isin(list(study)) & ((F.col("ord") < F.col("_a")) | (F.col("ord") > F.col("_b"))))
    return s.filter(out).select(*by, "batch", "sample")


def invalid_features(matrix: DataFrame, qc: Sequence[str], study: Sequence[str], by: Sequence[str] = (), threshold: float = 0.0, min_rate: float = 0.9, least: int = 4) -> DataFrame:
    """(batch, feature) that controls don't cover: detected before the first, between, and after the last study sample."""
    is_qc, is_s = F.col("class").isin(list(qc)), F.col("class").isin(list(study))
    edge = matrix.filter(is_s).groupBy(*by, "batch").agg(F.min("ord").alias("_a"), F.max("ord").alias("_b"))
    m = matrix.filter(is_qc).join(edge, [*by, "batch"])
    seen = F.col("value") > threshold
    c = m.groupBy(*by, "batch", "feature").agg(
        F.count_if(seen & (F.col("ord") < F.col("_a"))).alias("before"), F.count_if(seen & (F.col("ord") > F.col("_a")) & (F.col("ord") < F.col("_b"))).alias("inside"), F.count_if(seen & (F.col("ord") > F.col("_b"))).alias("after"), F.count_if(seen).alias("seen"), F.count(F.lit(1)).alias("n")
    )
    ok = (F.col("before") > 0) & (F.col("inside") > 0) & (F.col("after") > 0) & (F.col("seen") >= least) & (F.col("seen") >= min_rate * F.col("n"))
    return c.filter(~ok).select(*by, "batch", "feature")


def correct_drift(matrix: DataFrame, qc: Sequence[str], by: Sequence[str] = (), threshold: float = 0.0, frac: float | None = None, first_n: int | None = None) -> DataFrame:
    """LOWESS drift correction of each feature within each batch, fitted on its quality controls.

    A group is one feature in one batch: its size is bounded by the injections of a
    batch, never by the number of rows. Fewer than four usable controls, or predictions
    that aren't positive, leave or zero the values as documented for the factor.
    """
    keys = [*by, "batch", "feature"]
    m = matrix.select(*keys, "sample", F.col("ord").cast("double").alias("ord"), "value", F.coalesce(F.col("class").isin(list(qc)), F.lit(False)).alias("is_qc"))
    schema = m.drop("is_qc").schema

    def correct(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "sample"])
        y = pdf["value"].to_numpy(float)
        x = pdf["ord"].to_numpy(float)
        use = pdf["is_qc"].to_numpy(bool) & np.isfinite(y) & (y >= threshold) & np.isfinite(x)
        if use.sum() >= 4:
            f = frac or kernels.best_frac(x[use], y[use])
            fit = kernels.lowess_predict(x[use], y[use], x, f)
            level = y[use][:first_n].mean() if first_n else y[use].mean()
            pdf["value"] = y * np.divide(level, fit, out=np.zeros_like(fit), where=fit > 0)
        return pdf.drop(columns="is_qc")

    return m.groupBy(*keys).applyInPandas(correct, schema)


def interbatch_mean(matrix: DataFrame, qc: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Brings each batch to the common mean of controls; an undefined factor gives 0."""
    q = matrix.filter(F.col("class").isin(list(qc)))
    all_, each = q.groupBy(*by, "feature").agg(F.avg("value").alias("_all")), q.groupBy(*by, "feature", "batch").agg(F.avg("value").alias("_batch"))
    m = matrix.join(all_, [*by, "feature"], "left").join(each, [*by, "feature", "batch"], "left")
    return m.withColumn("value", F.col("value") * F.coalesce(ratio(F.col("_all"), F.col("_batch")), F.lit(0.0))).drop("_all", "_batch")


def median_ratio(matrix: DataFrame, qc: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One factor for each batch: the median over features of their controls' common mean over the batch's mean."""
    q = matrix.filter(F.col("class").isin(list(qc)))
    all_, each = q.groupBy(*by, "feature").agg(F.avg("value").alias("_all")), q.groupBy(*by, "feature", "batch").agg(F.avg("value").alias("_batch"))
    factor = each.join(all_, [*by, "feature"]).groupBy(*by, "batch").agg(F.median(ratio(F.col("_all"), F.col("_batch"))).alias("factor"))
    return matrix.join(factor, [*by, "batch"], "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0)))


def correct_by_template(matrix: DataFrame, qc: Sequence[str], by: Sequence[str] = (), how: str = "linear", method: str = "multiplicative", first_n: int | None = None, frac: float | None = None) -> DataFrame:
    """Correction by the level between smoothed controls: multiplied or shifted to their mean (of the first ones).

    A group is one feature in one batch, as in correct_drift. Groups come in their order
    and many at a time, and those with as many usable controls are smoothed together;
    the rows of groups with fewer than four pass through as they are.
    """
    if method not in ("multiplicative", "additive") or how not in ("linear", "splines"):
        raise ValueError("method is multiplicative or additive, how is linear or splines")
    # numbers first: most rows are ordered by them alone
    keys = ["feature", "batch", *by]
    m = matrix.select(*by, "batch", "feature", "sample", null_if_nan(F.col("ord").cast("double")).alias("ord"), "value", F.coalesce(F.col("class").isin(list(qc)), F.lit(False)).alias("is_qc"))
    schema = m.drop("is_qc").schema

    def correct(t: pa.Table, start: np.ndarray) -> pa.Table:
        x, y, is_qc = (t[c].to_numpy() for c in ("ord", "value", "is_qc"))
        x, y = x.astype(float), y.astype(float)
        use = is_qc.astype(bool) & np.isfinite(y) & np.isfinite(x)
        controls = np.flatnonzero(use)
        first, end = np.searchsorted(controls, start), np.searchsorted(controls, [*start[1:], len(y)])
        number = end - first
        for n in np.unique(number[number >= 4]):
            groups = np.flatnonzero(number == n)
            at = controls[first[groups][:, None] + np.arange(n)]
            qx, qy = x[at], y[at]
            span = np.full(len(groups), frac) if frac else kernels.best_frac_rows(qx, qy)
            smooth = np.empty_like(qy)
            for f in np.unique(span):
                smooth[span == f] = kernels.lowess_rows(qx[span == f], qy[span == f], f)
            means = (smooth[:, :first_n] if first_n else smooth).mean(1)
            for g, gx, gy, mean in zip(groups, qx, smooth, means):
                own = slice(start[g], start[g + 1] if g + 1 < len(start) else len(y))
                level = kernels.interpolated_level(gx, gy, x[own], how)
                y[own] = np.maximum(y[own] * np.divide(mean, level, out=np.zeros_like(level), where=level > 0) if method == "multiplicative" else y[own] + mean - level, 0)
        at = t.schema.get_field_index("value")
        return t.set_column(at, t.schema.field(at), pa.array(y, from_pandas=True).cast(t.schema.field(at).type, safe=False)).drop_columns("is_qc")

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            code = t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def run(batches):
        held, rows, limit = [], 0, GATHER_ROWS
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                t = pa.Table.from_batches(held)
                start = starts(t)
                # the last group may go on
                if start[-1] > 0:
                    yield from correct(t.slice(0, start[-1]), start[:-1]).to_batches()
                    held = t.slice(start[-1]).to_batches()
                    rows = t.num_rows - start[-1]
                limit = max(GATHER_ROWS, 2 * rows)
        if rows:
            t = pa.Table.from_batches(held)
            yield from correct(t, starts(t)).to_batches()

    ordered = m.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("ord"), F.asc_nulls_last("sample"))
    return ordered.mapInArrow(run, schema)
