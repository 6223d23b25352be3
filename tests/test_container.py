import pytest
from pyspark.sql import functions as F

from massloom import settings
from massloom.operators import annotation, container
from massloom.operators.container import InvalidMapping, MissingMetadata, Study
from massloom.plans.assay import Run, RunCache

M = "sample string, feature string, value double"
FEATURES = "feature string, mz double, rt double, class string"
S = "sample string, class string, dilution double"


def tables(spark, value=1.0, mz=100.0):
    m = [(s, f, value * (i + 1)) for i, s in enumerate(["a", "b", "c", "q1", "q2"]) for f in ("x", "y")] + [("d", "x", float("nan"))]
    f = [("y", mz, 10.0, "k"), ("x", 200.0, 5.0, None), ("z", 50.0, 1.0, None)]
    s = [("a", "one", 1.0), ("b", "one", None), ("c", "two", 2.0), ("d", "two", 2.0), ("q1", "control", 1.0), ("q2", "control", 1.0)]
    return spark.createDataFrame(m, M), spark.createDataFrame(f, FEATURES), spark.createDataFrame(s, S)


def test_checks(spark):
    m, f, s = tables(spark)
    with pytest.raises(ValueError, match="at least 0"):
        Study.of(*tables(spark, value=-1.0))
    with pytest.raises(ValueError, match="mz and rt"):
        Study.of(*tables(spark, mz=-1.0))
    with pytest.raises(MissingMetadata, match="samples lacks class"):
        Study.of(m, f, s.drop("class"))
    with pytest.raises(MissingMetadata, match="no metadata of feature"):
        Study.of(m, f.filter("feature = 'y'"), s)
    for bad in ({"control": ["one"]}, {"qc": ["none"]}, {"qc": ["one"], "blank": ["one"]}):
        with pytest.raises(InvalidMapping):
            Study.of(m, f, s, bad)
    empty = Study.of(m.limit(0), f.limit(0), s.limit(0))
    assert empty.groups().count() == 0 and empty.ordered("feature").count() == 0


def test_columns_sort_remove_reset(spark):
    d = Study.of(*tables(spark), {"qc": ["control"]})
    assert d.matrix.filter("sample = 'd'").first()["value"] is None
    assert [r["feature"] for r in d.sort("mz", "feature").ordered("feature").orderBy("position").collect()] == ["z", "y", "x"]
    assert [r["sample"] for r in d.ordered().orderBy("position").collect()] == ["a", "b", "c", "d", "q1", "q2"]
    assert {r["sample"]: r["value"] for r in d.column("dilution").collect()}["c"] == 2.0
    with pytest.raises(MissingMetadata):
        d.column("operator")
    with pytest.raises(MissingMetadata):
        d.sort("colour")
    with pytest.raises(KeyError):
        d.remove(["nobody"])
    less = d.remove(["a", "b"]).remove(["y"], "feature").mapped({"blank": ["two"]})
    assert less.matrix.count() == 4 and less.features.count() == 2 and less.classes_of("blank") == ["two"]
    assert less.reset().matrix.count() == 11 and less.reset().mapping == {"qc": ["control"]} and less.reset(mapping=False).mapping == {"blank": ["two"]}
    assert d.of_sample("q1")["class"] == "control" and {r["class"]: r["samples"] for r in d.groups().collect()} == {"one": 2, "two": 2, "control": 2}
    new = d.with_column("dilution", d.samples.select("sample", F.lit(3.0).alias("value")))
    assert new.column("dilution").filter("value = 3").count() == 6


def test_modes_and_needs(spark):
    d = Study.of(*tables(spark), {"qc": ["control"]})
    flagged = d.process([{"name": "variation", "high": 0.01}], mode="flag")
    assert {r["feature"]: r["variation"] for r in flagged.features.collect()} == {"x": True, "y": True, "z": False}
    assert flagged.matrix.count() == 11 and d.process([{"name": "variation", "high": 0.01}]).matrix.count() == 0
    with pytest.raises(ValueError, match="needs classes of blank"):
        d.process([{"name": "correct_blanks"}])
    with pytest.raises(ValueError, match="needs a matrix"):
        d.process([{"name": "variation", "high": 0.01}, {"name": "normalize"}])


def test_annotations(spark):
    _, f, _ = tables(spark)
    a = spark.createDataFrame([("x", 3, 1, 2), ("x", 3, 1, 2)], "feature string, envelope_label int, envelope_index int, charge int")
    got = {r["feature"]: (r["envelope_label"], r["charge"]) for r in container.attach_annotations(f, a).collect()}
    assert got == {"x": (3, 2), "y": (-1, -1), "z": (-1, -1)}


def test_lighter_first_members():
    assert annotation.telling_elements(list("CHNOPS")) == ["O", "S", "C"]
    assert set(annotation.telling_elements(["C", "H", "B", "Li", "P"])) == {"C", "B", "Li"}
    rules = annotation.lighter_rules({"C": (1, 120), "H": (2, 40)}, 2000.0, 4)
    # the second member of carbon alone overtakes the first near 93 atoms
    assert min(rules) == 10 and all(abs(r[0] - 1.00335) < 1e-4 and r[2] >= 0.9 for r in rules[10])
    assert annotation.lighter_rules({"C": (1, 10)}, 500.0, 4) == {}


def test_runs_cache_and_settings(spark, tmp_path):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sample string, scan int")
    run = Run(s).replace(lambda x: x.filter("scan > 1"))
    assert run.current.count() == 2 and run.original.count() == 3 and run.reset().current.count() == 3
    cache = RunCache(s, most=1)
    first = cache.get("a")
    assert cache.get("a") is first and first.count() == 2 and cache.get("b").count() == 1 and not first.is_cached
    cache.put("v", s.limit(1))
    cache.clear()
    path = str(tmp_path / "own" / "settings.json")
    settings.save({**settings.DEFAULTS, "gather": 8}, path)
    spark.conf.set("massloom.separation", "hplc")
    got = settings.load(spark, path)
    spark.conf.unset("massloom.separation")
    assert got["gather"] == 8 and got["separation"] == "hplc" and got["instrument"] == "qtof" and not settings.in_notebook()
