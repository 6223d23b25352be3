import json
import math

import pytest
from pyspark.sql import functions as F

from massloom.plans.assay import Assay, Parameters
from massloom.sources import mzml, simulated, sinks, tables


@pytest.mark.parametrize("compress,minutes", [(True, False), (False, True)])
def test_mzml_round_trip(spark, tmp_path, compress, minutes):
    rows = [{"time": 1.5 * k, "ms_level": 1 + k % 2, "polarity": -1 if k % 2 else 1, "mz": [100.5, 200.25][: k], "spint": [1.0, 2.0][: k]} for k in range(3)]
    mzml.write_mzml(str(tmp_path / "a.mzML"), rows, compress, minutes)
    got = mzml.read_mzml(spark, str(tmp_path)).orderBy("scan").collect()
    assert [(r["sample"], r["scan"], r["ms_level"], r["polarity"], round(r["time"], 9), r["mz"], r["spint"]) for r in got] == [("a", k, x["ms_level"], x["polarity"], x["time"], x["mz"], x["spint"]) for k, x in enumerate(rows)]
    assert mzml.signals_of(mzml.read_mzml(spark, str(tmp_path))).count() == 3


def test_xcms_and_mzmine(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("name\tS1\tS2\nF1\t1.5\tNA\nF2\t2\t3\n")
    (tmp_path / "f.tsv").write_text("name\tmzmed\trtmed\nF1\t100.1\t50\nF2\t200.2\t60\n")
    (tmp_path / "s.tsv").write_text("name\tgroup\nS1\tqc\nS2\tblank\n")
    c = tables.read_xcms(spark, *[str(tmp_path / x) for x in ("m.tsv", "f.tsv", "s.tsv")], class_column="group")
    assert {(r["sample"], r["feature"]): r["value"] for r in c.matrix.collect()} == {("S1", "F1"): 1.5, ("S2", "F1"): None, ("S1", "F2"): 2.0, ("S2", "F2"): 3.0}
    assert {r["sample"]: r["class"] for r in c.samples.collect()} == {"S1": "qc", "S2": "blank"}
    (tmp_path / "z.csv").write_text("row ID,row m/z,row retention time,a.mzML Peak area,b.mzML Peak area\n1,100.1,1.5,10,\n2,200.2,2.5,20,\n")
    (tmp_path / "zs.csv").write_text("sample,class\na.mzML,qc\n")
    z = tables.read_mzmine(spark, str(tmp_path / "z.csv"), str(tmp_path / "zs.csv"))
    assert {(r["sample"], r["feature"]): r["value"] for r in z.matrix.collect()} == {("a", "FT-1"): 10.0, ("a", "FT-2"): 20.0}
    assert z.features.filter("feature = 'FT-1'").first()["rt"] == 90.0
    with pytest.raises(ValueError):
        tables.read_data_matrix(spark, "x", "none")


def test_progenesis(spark, tmp_path):
    (tmp_path / "p.csv").write_text(',,,Normalised abundance,,Raw abundance,\n,,,qc,blank,qc,blank\nCompound,m/z,Retention time (min),S1,S2,S1,S2\nC1,100.1,1.5,9,9,1,2\n')
    c = tables.read_progenesis(spark, str(tmp_path / "p.csv"))
    assert {r["sample"]: r["value"] for r in c.matrix.collect()} == {"S1": 1.0, "S2": 2.0}
    assert c.features.first()["rt"] == 90.0 and {r["sample"]: r["class"] for r in c.samples.collect()} == {"S1": "qc", "S2": "blank"}


def test_save_load_export(spark, tmp_path):
    m, f, s = simulated.simulate_study({"healthy": 4, "disease": 6}, {"healthy": [50, 100], "disease": [150, 200]}, {"healthy": [1, 1], "disease": [2, 2]}, [100, 200], [50, 60], [3, 5])
    c = tables.Container(spark.createDataFrame(m), spark.createDataFrame(f), spark.createDataFrame(s))
    sinks.save(c, str(tmp_path / "c"))
    again = tables.read_data_matrix(spark, str(tmp_path / "c"), "parquet")
    assert again.matrix.exceptAll(c.matrix).count() == 0
    sinks.to_csv(c, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == len(s)
    sinks.export_matrix(c.matrix, c.features.withColumn("note", F.lit("a\tb")), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), header=True, sep="\t").first()["note"] == "a--SEP--b"
    b = spark.createDataFrame([("f1", 1.0, 1.5, 2.0, 3)], "feature string, mz_min double, mz_mean double, mz_max double, samples int")
    xml = "".join(r["value"] for r in sinks.feature_ml(b).collect())
    assert xml.count("<feature ") == 1 and xml.endswith("</featureMap>")
    assert json.loads(sinks.annotations_json(b).first()["value"])["feature"] == "f1"
    h = sinks.History(spark, str(tmp_path / "h"))
    h.add("a", "text", {"x": 1})
    assert h.read().first()["data"] == '{"x": 1}'


def test_sample_metadata_checks(spark):
    names = spark.createDataFrame([("a",), ("b",)], "sample string")
    good = tables.sample_metadata(names, names)
    assert {tuple(r) for r in good.select("sample", "class", "order", "batch").collect()} == {("a", "0", 1, 1), ("b", "0", 2, 1)}
    for bad in (names.limit(1), names.union(spark.createDataFrame([("c",)], "sample string")), names.withColumn("order", F.lit(1)), names.withColumn("batch", F.lit(0))):
        with pytest.raises(ValueError):
            tables.sample_metadata(bad, names)


def test_spots_and_compounds(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("msData_ID\tspotInd\tinclude\tname\tgroup\tclass\tbatch\tstartRT_seconds\tendRT_seconds\tcomment\nf\t0\tTrue\tx\tg\tc\t1\t1.5\t9\t\nf\t1\tFalse\ty\tg\tc\t1\t1\t2\t\n")
    assert [r["name"] for r in tables.read_spots(spark, str(tmp_path / "s.tsv")).collect()] == ["x"]
    (tmp_path / "c.tsv").write_text(sinks.compound_template())
    got = {r["name"]: r["mz"] for r in tables.read_compounds(spark, str(tmp_path / "c.tsv"), {"[M+H]+": (1.007276, 1)}).collect()}
    assert abs(got["caffeine [M+H]+"] - 195.0877) < 1e-3 and got["by mass alone"] == 195.0877
    with pytest.raises(KeyError):
        tables.read_compounds(spark, str(tmp_path / "c.tsv"), {"[M+Na]+": (22.98, 1)})


def test_assay_runs_once(spark, tmp_path):
    frames = []
    for k in range(4):
        frames.append(simulated.simulate_run(spark, [200.0, 300.0], [3000.0, 5000.0], [30.0, 60.0], [2.0, 3.0], [float(x) for x in range(100)], 2.0, k, f"S{k}"))
    s = frames[0]
    for f in frames[1:]:
        s = s.unionByName(f)
    samples = spark.createDataFrame([(f"S{k}", "a") for k in range(4)], "sample string, class string")
    a = Assay(spark, s, samples, str(tmp_path), Parameters(min_fraction=0.5, min_snr=100.0))
    m = a.data_matrix()
    assert m.filter("value > 0").count() == 8 and a.ran == ["detect", "describe", "match", "matrix"]
    a.data_matrix()
    assert len(a.ran) == 4
    assert Assay(spark, s, samples, str(tmp_path), Parameters(min_fraction=0.5, min_snr=100.0)).data_matrix().count() == 8
    with pytest.raises(ValueError):
        Parameters(instrument="none")
    assert math.isclose(Parameters(instrument="orbitrap").mz_tol, 0.005)
