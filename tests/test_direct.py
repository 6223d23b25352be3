import numpy as np
from pyspark.sql import functions as F

from massloom.operators import dart


def test_parts_grow_towards_the_centre(spark):
    # from 300.0000 and 300.0010: the centre is the first mass, so the left neighbour comes first
    mz = [299.9965, 300.0000, 300.0010, 300.0050, 300.0110]
    s = spark.createDataFrame([("a", 0, m, 1.0) for m in mz], "sample string, crude int, mz double, spint double")
    got = {r["mz"]: r["fine"] for r in dart.refine(s, ["sample", "crude"], 20.0, 25.0).collect()}
    assert got == {299.9965: 0, 300.0: 0, 300.001: 0, 300.005: 1, 300.011: 1}
    # the mean by intensity leans to the heavy right side
    s = s.withColumn("spint", F.when(F.col("mz") > 300.004, 1000.0).otherwise(1.0))
    wide = {r["mz"]: r["fine"] for r in dart.refine(s, ["sample", "crude"], 20.0, 40.0, 10.0).collect()}
    assert wide[300.0] == wide[300.001] == 0


def test_form_over_the_run(spark):
    """A cluster at the run's edge is no spot, though it looks like one over its own scans."""
    scans = np.arange(60)
    spot = np.exp(-0.5 * ((scans - 29.5) / 10) ** 2) * 100
    edge = np.where(scans < 9, np.exp(-0.5 * ((scans - 4) / 1.5) ** 2) * 100, 0)
    rows = [("a", c, int(k), float(y[k])) for c, y in (("spot", spot), ("edge", edge)) for k in scans if y[k] > 1e-3]
    s = spark.createDataFrame(rows, "sample string, cluster string, scan int, spint double")
    assert [r["cluster"] for r in dart.peak_form_ok(s, ["sample", "cluster"], 0.5).select("cluster").collect()] == ["spot"]


M = "sample int, feature string, class string, value double"


def test_one_blank_value(spark):
    rows = [(i, "x", "a", v) for i, v in enumerate([10.0, 12.0, 11.0])] + [(9, "x", "blank", 1.0), (8, "x", "blank", None)]
    rows += [(i, "y", "a", v) for i, v in enumerate([10.0, 12.0])] + [(9, "y", "blank", None), (0, "z", "a", 5.0), (9, "z", "blank", 1.0)]
    got = {r["feature"]: r for r in dart.subtract_blanks(spark.createDataFrame(rows, M), ["blank"], ["a"]).collect()}
    assert got["x"]["keep"] and abs(got["x"]["t"] - 10 / (1 / 3**0.5)) < 1e-9 and got["x"]["df"] == 2
    assert got["y"]["keep"] and got["y"]["p"] is None and not got["z"]["keep"]


def test_volcano_gates(spark):
    rows = []
    for f, na, nb in (("both", 4, 4), ("one", 4, 1), ("between", 4, 2), ("none", 1, 1)):
        rows += [(i, f, "a", 100.0 + i if i < na else None) for i in range(4)] + [(10 + i, f, "b", 10.0 + i if i < nb else 0.0) for i in range(4)]
    got = {r["feature"]: r for r in dart.volcano(spark.createDataFrame(rows, M), ["a"], ["b"]).collect()}
    assert [got[f]["tested"] for f in ("both", "one", "between", "none")] == [True, True, False, False]
    assert got["both"]["significant"] and not got["between"]["significant"] and 0 < got["both"]["p_ranks"] < 0.05
