"""Work grows with what is asked for, not with all pairs or groups."""

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest

from massloom.functions import kernels
from massloom.operators import batch, correspondence


@contextmanager
def shuffled(spark, group):
    """Rows written to shuffles by the jobs inside, in a list."""
    sc, out = spark.sparkContext, []
    sc.setJobGroup(group, group)
    # as with tables too large to broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield out
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        out.append(sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc.setLocalProperty("spark.jobGroup.id", None)


def _lacking(spark, n):
    """n samples with n features of one mass, of which each lacks its own; a feature's peak is at 10 s in all samples."""
    m = spark.createDataFrame([(s, f, None if s == f else 1.0) for s in range(n) for f in range(n)], "sample long, feature long, value double")
    f = spark.createDataFrame([(k, 100.0, 10.0, 1.0, 5.0, 15.0) for k in range(n)], "feature long, mz double, rt double, rt_std double, rt_start double, rt_end double")
    return m, f, spark.createDataFrame([(s, 100.001, float(t), 2.0 + s) for s in range(n) for t in range(20)], "sample long, mz double, time double, spint double")


def test_signals_meet_only_the_features_their_sample_lacks(spark):
    n = 40
    m, f, signals = _lacking(spark, n)
    with shuffled(spark, "fill") as rows:
        got = correspondence.fill_by_integration(m, f, signals, 0.02).filter("code > 0").collect()
    # 9 steps from 5 to 14 s at a level of 2 + s
    assert {(r["sample"], r["feature"], r["value"], r["code"]) for r in got} == {(k, k, 9.0 * (2 + k), 2) for k in range(n)}
    # each signal with each feature of its mass would be n * n * 20 rows
    assert rows[0] < n * n * 20 / 2


def test_cells_named_twice_are_filled_once_each(spark):
    m, f, signals = _lacking(spark, 2)
    got = correspondence.fill_by_integration(m.union(m), f, signals, 0.02).filter("code > 0").collect()
    assert sorted((r["sample"], r["value"]) for r in got) == [(0, 18.0), (0, 18.0), (1, 27.0), (1, 27.0)]


def test_kernels_over_rows_give_what_each_row_gives_alone(monkeypatch):
    rng = np.random.default_rng(3)
    for n, numbers in ((3, 1 << 20), (4, 1 << 20), (5, 1 << 20), (9, 1 << 20), (9, 300), (9, 50)):
        monkeypatch.setattr(kernels, "ROW_NUMBERS", numbers)
        # with places named twice, a level row, a line and an outlier
        x = np.sort(rng.integers(0, 2 * n, (30, n)).astype(float), axis=1)
        y = rng.lognormal(5, 1, (30, n))
        x[0], y[1], y[2], y[3, 0] = 5, 7, 2 * x[2] + 1, 1e9
        for f in (0.4, 2 / 3, 1.0):
            assert np.allclose(kernels.lowess_rows(x, y, f), [kernels.lowess(a, b, f) for a, b in zip(x, y)], rtol=1e-12)
        assert kernels.best_frac_rows(x, y).tolist() == [kernels.best_frac(a, b) for a, b in zip(x, y)]
    assert kernels.lowess_rows(np.empty((0, 5)), np.empty((0, 5))).shape == (0, 5) and kernels.best_frac_rows(np.empty((0, 5)), np.empty((0, 5))).shape == (0,)


def _alone(g, how, method):
    """Template correction of one group."""
    g = g.sort_values(["ord", "sample"])
    x, y = g["ord"].to_numpy(float), g["value"].to_numpy(float)
    use = (g["class"] == "qc").to_numpy(bool) & np.isfinite(y) & np.isfinite(x)
    if use.sum() >= 4:
        smooth = kernels.lowess(x[use], y[use], kernels.best_frac(x[use], y[use]))
        level = kernels.interpolated_level(x[use], smooth, x, how)
        y = np.maximum(y * np.divide(smooth.mean(), level, out=np.zeros_like(level), where=level > 0) if method == "multiplicative" else y + smooth.mean() - level, 0)
    return dict(zip(g["sample"], y))


@pytest.mark.parametrize(("how", "method"), [("linear", "multiplicative"), ("splines", "additive")])
def test_template_takes_many_groups_at_a_time_and_none_apart(spark, how, method):
    rng = np.random.default_rng(7)
    rows = []
    # more rows than a task gathers; one group in forty has enough controls; batch and class may be unknown
    for g in range(5500):
        study, b, feature = f"s{g % 3}", None if g % 7 == 0 else g % 5, g // 15
        controls = int(rng.integers(4, 8)) if g % 40 == 0 else 3
        for k in range(10 + g % 3):
            value = None if rng.random() < 0.05 else float(rng.lognormal(5, 1))
            rows.append((study, b, feature, len(rows), int(rng.integers(0, 20)), value, "qc" if k < controls else None if k == 9 else "healthy"))
    assert len(rows) > batch.GATHER_ROWS
    m = spark.createDataFrame(rows, "study string, batch int, feature long, sample long, ord int, value double, class string").coalesce(1)
    out = batch.correct_by_template(m, ["qc"], ["study"], how, method)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["sample"]: r["value"] for r in batch.correct_by_template(m, ["qc"], ["study"], how, method).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    want = {}
    for _, g in pd.DataFrame(rows, columns=m.columns).groupby(["study", "batch", "feature"], dropna=False):
        want |= _alone(g, how, method)
    assert len(got) == len(rows) and sum(v is not None and v != r[5] for r in rows for v in [got[r[3]]]) > 500
    assert {k: np.nan if v is None else v for k, v in got.items()} == pytest.approx(want, nan_ok=True)


def test_template_gives_null_for_orders_that_are_no_numbers(spark):
    rows = [("f", 1, k, o, 5.0, "qc") for k, o in enumerate([1.0, 2.0, 3.0, 4.0, float("nan"), None])]
    m = spark.createDataFrame(rows, "feature string, batch int, sample long, ord double, value double, class string")
    got = {r["sample"]: (r["ord"], r["value"]) for r in batch.correct_by_template(m, ["qc"]).collect()}
    assert {k: o for k, (o, _) in got.items()} == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0, 4: None, 5: None}
    assert {k: v for k, (_, v) in got.items()} == pytest.approx({0: 5.0, 1: 5.0, 2: 5.0, 3: 5.0, 4: 0.0, 5: 0.0})
    assert batch.correct_by_template(m.limit(0), ["qc"]).collect() == []
