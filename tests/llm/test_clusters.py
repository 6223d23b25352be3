import random

from pyspark.sql import functions as F

from massloom.llm import clusters

SCHEMA = "feature_id long, polarity int, mz double, rt double, cell string"


def brute(points, tx, ty):
    parent = {i: i for i, *_ in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p, x, y in points:
        for j, q, u, v in points:
            if i < j and p == q and abs(x - u) <= tx + 1e-9 and abs(y - v) <= ty + 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in parent:
        groups.setdefault(find(i), set()).add(i)
    return {min(g): g for g in groups.values() if len(g) > 1}


def run(spark, points, **more):
    df = spark.createDataFrame([(i, p, x, y, "extra") for i, p, x, y in points], SCHEMA)
    out = {}
    for r in clusters.cluster(df, "feature_id", "polarity", "mz", "rt", 0.015, 15.0, **more).collect():
        out.setdefault(r["cluster_id"], set()).add(r["key"])
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pts = []
    for k in range(60):
        p, m, t = rng.choice([1, -1]), 200 + rng.random() * 20, rng.random() * 600
        pts += [(len(pts) + 1, p, m + rng.gauss(0, 0.002), t + rng.gauss(0, 2)) for _ in range(rng.choice([1, 1, 2, 5, 12]))]
        pts = [(i + 1, *x[1:]) for i, x in enumerate(pts)]
    assert run(spark, pts) == brute(pts, 0.015, 15.0)


def test_pairs_at_the_limit_and_odd_rows(spark):
    nan = float("nan")
    pts = [(1, 1, 100.0, 50.0), (2, 1, 100.0149, 64.9), (3, 1, 200.0, 50.0), (4, 1, 200.0151, 50.0), (5, -1, 100.0, 50.0), (6, 1, None, 5.0), (7, 1, nan, 5.0), (8, 1, 300.0, None), (9, None, 100.0, 50.0), (10, 1, 400.0, 7.0), (10, 1, 400.0, 7.0)]
    assert run(spark, pts) == {1: {1, 2}}


def test_a_loose_chain_is_split(spark):
    pts = [(i + 1, 1, 500.0 + 0.012 * i, 100.0) for i in range(12)]
    got = run(spark, pts)
    assert len(got) > 1 and sorted(x for g in got.values() for x in g) == sorted({x for g in got.values() for x in g})
    for g in got.values():
        xs = [500.0 + 0.012 * (i - 1) for i in g]
        assert max(xs) - min(xs) <= 0.03 + 1e-9


def test_description_and_empty(spark):
    df = spark.createDataFrame([(i, 1, 100.0 + 0.0001 * i, 50.0, "x") for i in range(1, 10)], SCHEMA)
    c = clusters.cluster(df, "feature_id", "polarity", "mz", "rt", 0.015, 15.0)
    d = clusters.describe(c).first()
    assert d["size"] == 9 and d["typical"][0] == 5 and len(d["typical"]) == 3
    empty = clusters.cluster(df.filter(F.lit(False)), "feature_id", "polarity", "mz", "rt", 0.015, 15.0)
    assert empty.count() == 0 and clusters.describe(empty).count() == 0


def test_corners_of_cells(spark):
    """Links between diagonal cells, found from the facing corners, equal all pairs of points."""
    rng = random.Random(11)
    rows = [(k, rng.choice([1, 2]), rng.choice([1.0, 1.4, 2.2, 2.6]) + rng.uniform(0, 0.3), rng.choice([1.0, 1.5, 2.1]) + rng.uniform(0, 0.3)) for k in range(500)]
    p = clusters.cells(spark.createDataFrame(rows, "key int, kind int, x double, y double"), "kind", "x", "y", 0.6, 0.6).cache()
    c = {r["cell"]: r for r in p.select("cell", "kind", "i", "j").distinct().collect()}
    pairs = [(a, b) for a in c for b in c if a < b and c[a]["kind"] == c[b]["kind"]]
    pts = {}
    for r in p.collect():
        pts.setdefault(r["cell"], []).append((r["x"], r["y"]))
    want = {(a, b) for a, b in pairs if any(abs(x - u) <= 0.6 and abs(y - v) <= 0.6 for x, y in pts[a] for u, v in pts[b])}
    got = {(r["a"], r["b"]) for r in clusters._touching(spark.createDataFrame(pairs, "a long, b long"), p, 0.6, 0.6).collect()}
    assert got == want and 0 < len(want) < len(pairs)
