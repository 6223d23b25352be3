import numpy as np

from massloom.llm import matching

F_SCHEMA = "feature_id long, study string, mz double, rt_sec double, polarity int, top_sample_id long, name string"
S_SCHEMA = "sample_id long, sample string"
R_SCHEMA = "partner_id long, lab string, mz double, rt_sec double, polarity string, sample_label string, study string"
SAMPLES = [(1, " ZESTABA000018.run0002.b1"), (2, "KEVO000047-B2-S013"), (3, "KEVO000047-B1-S002"), (4, "KEKE000059_011_batch02"), (5, "BAKE000176_b02_inj013")]


def parts(spark, labels):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    return {r["i"]: (r["number"], r["letters"], r["batch"], r["injection"]) for r in matching.with_name_parts(df, "label").collect()}


def test_labels(spark):
    labels = ["kevo47-b2-s13", "B02 S013 KEVO000047", "/data/runs/KEVO000047/B2/S13.raw", "copy of keke59_11_batch2", "011 Batch02 KEKE000059", "D:\\export\\zestaba18.RUN2.B1.d", "47.b2.s13 (2)", "batch 2, injection 13", "b2_s13.mzML", "59_11_batch2", "", None, "unknown", "n/a", "?", "not given", "smp:BAKE176_b2_inj13_rerun"]
    got = parts(spark, labels)
    full = (47, "kevo", 2, 13)
    assert [got[i] for i in range(3)] == [full] * 3
    assert got[3] == got[4] == (59, "keke", 2, 11) and got[5] == (18, "zestaba", 1, 2)
    assert got[6] == (47, None, 2, 13) and got[7] == got[8] == (None, None, 2, 13) and got[9] == (59, None, 2, 11)
    assert [got[i] for i in range(10, 16)] == [(None,) * 4] * 6 and got[16] == (176, "bake", 2, 13)


def run(spark, features, reports):
    f = spark.createDataFrame(features, F_SCHEMA)
    r = spark.createDataFrame(reports, R_SCHEMA)
    out = matching.match(f, spark.createDataFrame(SAMPLES, S_SCHEMA), r).collect()
    assert all(0 <= x["confidence"] <= 1 for x in out)
    return {(x["feature_id"], x["partner_id"]) for x in out}


def test_rules(spark):
    nan = float("nan")
    features = [
        (1, "K", 300.100, 100.0, 1, 2, "x"), (2, "K", 300.101, 101.0, 1, 2, "x"), (3, "K", 300.100, 100.0, 1, 3, "x"), (4, "B", 300.102, 99.0, 1, 5, "x"),
        (5, "K", 500.0, 200.0, -1, 2, "x"), (6, "K", None, 200.0, -1, 2, "x"), (7, "K", 500.0, nan, -1, 2, "x"), (8, "Z", 700.0, 50.0, 1, None, "x"), (1, "K", 300.100, 100.0, 1, 2, "x"),
    ]
    reports = [
        (11, "l", 300.105, 110.0, "ESI+", "kveo47-b2-s13", "x"),  # a full label with a typing error: both exports
        (12, "l", 300.105, 110.0, "neg", "kevo47-b2-s13", "x"),  # the other polarity
        (13, "l", 300.105, 110.0, None, "b2_s13", "x"),  # part of a name: two injections agree
        (14, "l", 500.005, 210.0, None, "b2_s13", "x"),  # part of a name: one injection
        (15, "l", 300.105, 110.0, "+", None, "x"),  # no name, two studies
        (16, "l", 500.005, 215.0, "-", "unknown", "x"),  # no name, one study, at the limit
        (17, "l", 500.020, 200.0, "-", "kevo47-b2-s13", "x"),  # just too far
        (18, "l", None, 200.0, "-", "kevo47-b2-s13", "x"), (19, "l", 700.0, 50.0, "+", "", "x"), (None, "l", 500.0, 200.0, "-", "", "x"),
        (20, "l", 300.105, 110.0, "+", "47_b1_s2", "x"), (14, "l", 500.005, 210.0, None, "b2_s13", "x"),
    ]
    assert run(spark, features, reports) == {(1, 11), (2, 11), (5, 14), (5, 16), (8, 19), (3, 20)}


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, "K", 300.1, 100.0, 1, 2, "x")], []) == set()


def test_digits_for_letters(spark):
    got = parts(spark, ["s1mi000189-b2-s015", "S1GO48.b3.inj20", "b1ke176_b2_inj13"])
    assert [g[0] for g in got.values()] == [189, 48, 176] and [g[2:] for g in got.values()] == [(2, 15), (3, 20), (2, 13)]


def test_curve_follows_the_bins():
    gap = np.arange(20) / 4 + 0.125
    n = np.full(20, 200.0)
    true = 1 / (1 + np.exp(1.5 - 2.0 * gap))
    z = np.stack([np.ones(20), gap], 1)
    a = matching.fit_logistic(np.concatenate([z, z]), np.repeat([1.0, 0.0], 20), np.concatenate([n * true, n * (1 - true)]))
    assert np.abs(1 / (1 + np.exp(-z @ a)) - true).max() < 0.01
    # bins that a step separates leave the curve finite
    b = matching.fit_logistic(np.concatenate([z, z]), np.repeat([1.0, 0.0], 20), np.concatenate([n * (gap > 2), n * (gap <= 2)]))
    assert np.isfinite(b).all() and 1 / (1 + np.exp(-z @ b))[-1] > 0.99


def test_ranking_decides(spark):
    """Letters of two studies are near the label's: the nearer one is taken; a tie takes none."""
    names = [(1, "KEVO000047-B1-S001"), (2, "KEVA000048-B1-S001"), (3, "XYLO000049-B1-S001")]
    f = [(i, f"s{i}", 300.1, 100.0, 1, i, "x") for i in (1, 2, 3)]
    r = [(11, "l", 300.1, 100.0, "+", "kevo-b1-s1", "x"), (12, "l", 300.1, 100.0, "+", "b1-s1", "x"), (13, "m", 300.1, 101.0, "+", "KEVO47 b1 s1", "x"), (14, "m", 300.1, 103.0, "+", "KEVO47 b1 s1", "x")]
    docs, queries, pairs = matching.accepted(spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(names, S_SCHEMA), spark.createDataFrame(r, R_SCHEMA))
    got = {(x["feature_id"], x["partner_id"]): (x["gap"] > 0, x["mutual"]) for x in pairs.collect()}
    # 13 and 14 are of one laboratory: both match, the nearer one mutually
    assert got == {(1, 11): (True, True), (1, 13): (True, True), (1, 14): (True, False)}
    bins = matching.calibration_bins(docs, queries)
    assert sum(b[3] for b in bins) > 0 and all(b[4] <= b[3] for b in bins)
    conf = [x["confidence"] for x in pairs.select(matching.confidence_of(matching.calibrate(docs, queries), pairs.gap, pairs.mutual).alias("confidence")).collect()]
    assert all(0 < c < 1 for c in conf)


def test_calibration_error(spark, small):
    """Confidence follows what masked reports got right, to 0.05 on average."""
    from massloom.llm import queries as q
    from massloom.session import table

    docs, queries, _ = matching.accepted(q._features(spark, small), table(spark, small, "sample_metadata"), table(spark, small, "partner_features"))
    bins = matching.calibration_bins(docs, queries)
    a, b, tie, both = matching.calibrate(docs, queries)
    error = sum(abs(n / (1 + np.exp(-(a + b * g + tie * t + both * m))) - right) for g, t, m, n, right in bins)
    assert error / sum(x[3] for x in bins) < 0.05
