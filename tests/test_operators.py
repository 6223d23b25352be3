import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import annotation, batch, correspondence, curation, dart, graph, matrix, metrics, peaks, raw


def signals(spark, mz, y=None, sample="A"):
    y = y or [100.0] * len(mz)
    return spark.createDataFrame([(sample, 0, 0.0, float(m), float(i)) for m, i in zip(mz, y)], "sample string, scan int, time double, mz double, spint double")


def seeds(spark, mz):
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(mz)], "target int, mz_target double")


def test_match_reduce_and_unmatched(spark):
    s, t = signals(spark, [49, 51, 78, 99, 100, 101, 126, 150, 151]), seeds(spark, [50, 75, 100, 125, 150])
    got = {r["target"]: (r["mz"], r["spint"]) for r in raw.match_targets(s, t, 2.0).collect()}
    assert got == {0: (50.0, 200.0), 2: (100.0, 300.0), 3: (126.0, 100.0), 4: (150.5, 200.0)}
    assert [r["mz"] for r in raw.unmatched(s, t, 2.0).collect()] == [78.0]


def test_closest_scan_ties_go_last(spark):
    s = spark.createDataFrame([("A", i, float(t), 1.0, 1.0) for i, t in enumerate([0, 10, 20])], "sample string, scan int, time double, mz double, spint double")
    q = spark.createDataFrame([(1, -3.0), (2, 5.0), (3, 99.0), (4, 11.0)], "query int, t double")
    assert {r["query"]: r["scan"] for r in raw.closest_scan(s, q).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_islands_across_blocks(spark):
    xs = [0.1, 0.5, 0.9, 1.05, 1.9, 2.05, 5.0, 5.3, 9.9]
    got = {r["x"]: r["r"] for r in graph.islands(spark.createDataFrame([("k", x) for x in xs], "k string, x double"), ["k"], "x", 0.45, "r", 1.0).collect()}
    assert got == {0.1: 0.1, 0.5: 0.1, 0.9: 0.1, 1.05: 0.1, 1.9: 1.9, 2.05: 1.9, 5.0: 5.0, 5.3: 5.0, 9.9: 9.9}


def test_dbscan_equals_brute_force(spark):
    rng = random.Random(8)
    pts = [(i, rng.gauss(0, 1) + 8 * (i % 3), rng.gauss(0, 1)) for i in range(240)]
    eps, least = 0.9, 6
    near = {i: [j for j, u, v in pts if abs(u - x) <= eps and abs(v - y) <= eps] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += [j for j in near[k] if j in core]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in near}
    out = correspondence.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", "x", "y", eps, eps, least)
    assert {r["id"]: r["cluster"] for r in out.collect()} == want


def test_species_count(spark):
    f = spark.createDataFrame([(s, 0, c) for s in range(5) for c in (0, 0, 1, 1)], "sample int, class int, cluster int")
    n = spark.createDataFrame([(0, 5)], "class int, n int")
    assert {r["cluster"]: r["species"] for r in correspondence.species_count(f, n).collect()} == {0: 2, 1: 2}


def test_match_features(spark):
    rng = random.Random(2)
    rows = [(s, s, "c", 100 + rng.gauss(0, 0.001), 50 + rng.gauss(0, 0.3)) for s in range(40)] + [(100 + s, s, "c", 100.5 + rng.gauss(0, 0.001), 50 + rng.gauss(0, 0.3)) for s in range(40)] + [(900, 3, "c", 300.0, 9.0)]
    out = correspondence.match_features(spark.createDataFrame(rows, "id long, sample int, class string, mz double, rt double"), "id", 0.01, 5.0, 0.25, 4.0)
    got = {r["id"]: r["label"] for r in out.collect()}
    assert got[900] == -1 and len({got[i] for i in range(40)} - {-1}) == 1 and len(set(got.values())) == 3


def test_merge_close(spark):
    rows = [(s, f, v) for s in range(20) for f, v in (("ft1", 1.0), ("ft2", 1.0 if s >= 10 else None))]
    m = spark.createDataFrame(rows, "sample int, feature string, value double")
    pairs = spark.createDataFrame([("ft1", "ft2")], "a string, b string")
    got = {r["sample"]: r["value"] for r in matrix.merge_close(m, pairs).collect()}
    assert got == {s: 1.0 if s < 10 else 2.0 for s in range(20)}


def long(spark, rows):
    return spark.createDataFrame(rows, "sample int, feature string, class string, value double")


def test_metrics_edges(spark):
    m = long(spark, [(1, "a", "qc", 0.0), (2, "a", "qc", 0.0), (1, "b", "qc", 2.0), (2, "b", "qc", 4.0)])
    cv = {r["feature"]: r["cv"] for r in metrics.cv(m).collect()}
    assert cv["a"] == float("inf") and abs(cv["b"] - 2**0.5 / 3) < 1e-12
    two = long(spark, [(i, "a", c, x * k) for c, k in (("qc", 1.0), ("s", 2.0)) for i, x in enumerate([1.0, 2.0, 4.0])])
    assert abs(metrics.dratio(two, ["qc"], ["s"]).first()["dratio"] - 0.5) < 1e-12


def test_scaling_identities(spark):
    m = long(spark, [(i, "a", "s", float(i * i + 1)) for i in range(9)])
    a = curation.scale(m, "autoscaling").agg(F.avg("value"), F.var_samp("value")).first()
    assert abs(a[0]) < 1e-12 and abs(a[1] - 1) < 1e-12
    r = curation.scale(m, "rescaling").agg(F.min("value"), F.max("value")).first()
    assert tuple(r) == (0.0, 1.0)
    with pytest.raises(ValueError):
        curation.scale(m, "none")
    with pytest.raises(ValueError):
        curation.build_pipeline([{"name": "none"}])


def test_drift_correction_flattens(spark):
    rows = [(i, "f", "qc" if i % 3 == 0 else "s", 100.0 + 2 * i, float(i), 1) for i in range(31)]
    m = spark.createDataFrame(rows, "sample int, feature string, class string, value double, ord double, batch int")
    out = [r["value"] for r in batch.correct_drift(m, ["qc"]).collect()]
    assert max(out) - min(out) < 1e-6


def test_invalid_samples(spark):
    rows = [(f"s{i}", c, i, 1) for i, c in enumerate(["s", "qc", "qc", "s", "qc", "qc", "s"])]
    s = spark.createDataFrame(rows, "sample string, class string, ord int, batch int")
    assert sorted(r["sample"] for r in batch.invalid_samples(s, ["qc"], ["s"]).collect()) == ["s0", "s6"]


def test_vote(spark):
    rows = [(s, -1, -1, -1, -1) for s in range(3)] + [(s, c, 0, c, 1) for s in range(5) for c in range(3)]
    f = spark.createDataFrame(rows, "sample int, cluster int, envelope_label int, envelope_index int, charge int")
    got = {r["cluster"]: (r["envelope_label"], r["charge"], r["envelope_index"], r["count"]) for r in annotation.vote(f).collect()}
    assert got == {0: (0, 1, 0, 0), 1: (0, 1, 1, 5), 2: (0, 1, 2, 5)}
    with pytest.raises(NotImplementedError):
        annotation.annotate_adducts()


def test_annotate_finds_an_envelope(spark):
    from massloom.functions import chem

    m, p = chem.Formula.parse("C10H10O2").envelope(3)
    rows = [("A", float(x) - chem.ELECTRON, float(y) * 1e4, 0) for x, y in zip(m, p)] + [("A", 150.5, 5e3, 0)]
    f = spark.createDataFrame(rows, "sample string, mz double, area double, g int")
    out = annotation.annotate(f, ["sample"], "g", {"C": (0, 12), "H": (0, 20), "O": (0, 4)}, max_charge=1, tol=0.005)
    assert sorted(r["envelope_index"] for r in out.collect()) == [-1, 0, 1, 2]


def test_regions_link_and_split(spark):
    rows = [("A", i, float(i), 200.0 + 0.001 * (i % 3), 10.0) for i in range(30)] + [("A", i, float(i), 300.0, 5.0) for i in range(0, 30) if i not in (10, 11, 12)]
    s = spark.createDataFrame(rows, "sample string, scan int, time double, mz double, spint double")
    got = sorted(sum(y is not None for y in r["spint"]) for r in raw.regions(s, 0.01, 1, 5).collect())
    assert got == [10, 17, 30]


def test_refine_and_reindex(spark):
    s = spark.createDataFrame([("A", m) for m in (100.0, 100.0005, 100.001, 100.01, 100.0105)], "sample string, mz double")
    c = dart.crude_clusters(s, 200.0)
    assert {r["crude"] for r in c.collect()} == {0}
    f = {r["mz"]: r["fine"] for r in dart.refine(c, ["sample", "crude"], 20.0, 25.0).collect()}
    assert f[100.0] == f[100.001] != f[100.01] == f[100.0105]


def test_peak_detection_on_arrays(spark):
    import math

    rows = [(1, float(t), 100 * math.exp(-0.5 * ((t - 50) / 3) ** 2) + (t % 7) * 0.05) for t in range(100)]
    tr = peaks.to_traces(spark.createDataFrame(rows, "k int, time double, spint double"), ["k"])
    got = [r for r in peaks.detect(tr, ["k"], custom={"points": lambda t, y, a, b, c: c - a}).collect() if r["snr"] > 20]
    assert len(got) == 1 and abs(got[0]["rt"] - 50) < 1 and got[0]["points"] > 5
