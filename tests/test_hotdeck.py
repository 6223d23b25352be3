import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import hotdeck

CELLS = "cell_id long, sample_id long, feature_id long, area double, extra string"
SAMPLES = "sample_id long, sample string, study string, id string, class string, run_order int, batch int"
CLASSES = "sample_type string, class string"


def tables(spark):
    classes = spark.createDataFrame([("sample", "treated"), ("qc", "QC")], CLASSES)
    s = [(i, f"S{i}", "A", f"P{i // 2}", c, i, 1) for i, c in enumerate(["QC", " treated", "TREATED", None, "treated", "n/a", "QC", ""])]
    samples = spark.createDataFrame([*s, s[0]], SAMPLES)
    nan = float("nan")
    c = [(i, i, 1, a, "x") for i, a in enumerate([1.0, 2.0, 3.0, None, 5.0, nan, float("inf"), -1.0])] + [(10 + i, i, 2, None, "x") for i in range(3)] + [(20, 99, 1, None, None)]
    return spark.createDataFrame([*c, c[1]], CELLS), samples, classes


def test_found_rows_and_marks(spark):
    cells, samples, classes = tables(spark)
    areas, cls = hotdeck.fill_areas(cells, samples, classes), hotdeck.fill_classes(samples, classes)
    got = {(r["table_name"], r["record_id"]) for r in hotdeck.found(areas, cls).collect()}
    assert got == {("data_matrix", i) for i in (3, 5, 6, 7, 10, 11, 12, 20)} | {("sample_metadata", i) for i in (3, 5, 7)}
    a = {r["record"]: r for r in areas.collect()}
    assert a[1]["value"] == 2.0 and not a[1]["filled"] and a[1]["donors"] is None
    assert a[3]["filled"] and 2.0 <= a[3]["value"] <= 5.0 and a[3]["n_donors"] > 0
    assert a[10]["filled"] and a[10]["value"] is None and a[10]["n_donors"] == 0 and a[10]["donors"] == []
    c = {r["record"]: r for r in cls.collect()}
    # 3 shares its subject with 2
    assert c[3]["value"] == "treated" and c[1]["value"] == "treated" and c[0]["value"] == "QC"


def test_nearest_donors_are_the_nearest(spark):
    rows = [(i, float(i * i) if i % 3 else None, "g", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "record long, value double, g string, run double")
    near = hotdeck.donors(df, [["g"]], "run", [])
    got = {}
    for r in near.collect():
        got.setdefault(r["record"], set()).add(r["donor"])
    for i in (3, 300, 1023, 1026, 2049, 2997):
        assert got[i] == {j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < 3000 and j % 3}


@pytest.mark.parametrize("gather", [0, 150, hotdeck.GATHER, 10_000])
def test_donors_are_the_closest_of_all(spark, gather):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick(None, float(i), float(i)), pick(1, 2, 2), pick(None, "p", "q", "r", "s"), pick("a", "a", "b", None), pick(1, 2, 3), pick(None, *[float(x) for x in (*range(0, 40), 150, 1020, 1024, 1030, 2500)])) for i in range(600)]
    df = spark.createDataFrame(rows, "record long, value double, feature_id long, subject string, class string, batch int, run double")
    features = ["subject", "class", "batch"]
    got = {r["record"]: r["donors"] for r in hotdeck.fill(df, hotdeck.combined(["feature_id"], features), "run", features, numeric=True, gather=gather).filter("filled").collect()}

    def distance(a, b):
        gap = 100.0 if a[6] is None or b[6] is None else abs(a[6] - b[6])
        return sum(0.0 if a[k] is not None and a[k] == b[k] else 1.0 for k in (3, 4, 5)) + gap / (gap + 10.0)

    missing = [r for r in rows if r[1] is None]
    assert len(missing) > 100 and set(got) == {r[0] for r in missing}
    for r in missing:
        near = sorted((distance(r, x), x[0]) for x in rows if x[1] is not None and x[2] == r[2])
        assert got[r[0]] == [x[1] for x in near[: hotdeck.DONORS]]


def test_empty(spark):
    cells, samples, classes = tables(spark)
    assert hotdeck.fill_areas(cells.limit(0), samples.limit(0), classes).count() == 0
    assert hotdeck.fill_classes(samples.limit(0), classes.limit(0)).count() == 0


def test_found_comes_from_the_fill(spark):
    cells, samples, classes = tables(spark)
    areas, cls = hotdeck.fill_areas(cells, samples, classes), hotdeck.fill_classes(samples, classes)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        seen.add(1)
        return x

    hotdeck.found(areas.withColumn("n_donors", count("n_donors")), cls).count()
    assert seen.value == areas.count()


def test_cells_without_a_key_or_an_injection(spark):
    _, samples, classes = tables(spark)
    cells = spark.createDataFrame([(1, 1, None, None, "x"), (2, 1, None, 4.0, "x"), (3, None, 7, None, "x"), (4, 99, 7, 2.5, "x"), (4, 99, 7, 2.5, "x"), (None, 1, 7, 3.0, "x")], CELLS)
    for gather in (0, 256):
        got = {r["record"]: (r["value"], r["filled"], r["n_donors"]) for r in hotdeck.fill_areas(cells, samples, classes, gather).collect()}
        assert got == {1: (None, True, 0), 2: (4.0, False, 0), 3: (2.5, True, 1), 4: (2.5, False, 0)}
