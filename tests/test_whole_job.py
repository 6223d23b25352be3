"""Queries take part in the whole of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators import annotation, dart, metrics
from massloom.plans import catalog, catalog_dart


def test_profile_sum_takes_every_trace(spark, tmp_path):
    # traces 1000 to 1002 of a, 2000 of b; each rises above 0 at times of its own
    r = [(s, t, k, float(10 * (t % 10) + k), 1.0 + k) for s, t in (("a", 1000), ("a", 1001), ("a", 1002), ("b", 2000)) for k in range(3)]
    spark.createDataFrame(r, "sample string, trace_id long, scan int, time double, spint double").write.parquet(f"{tmp_path}/chromatogram.parquet")
    spark.createDataFrame([(t, 100.0) for t in (1000, 1001, 1002, 2000)], "trace_id long, mz double").write.parquet(f"{tmp_path}/trace.parquet")
    got = {x["sample"]: x["n"] for x in catalog_dart.QUERIES["raw_profile_sum"](spark, str(tmp_path)).collect()}
    # 1000 and 1001 count for, 1002 (at 2/3) against
    assert got == {"a": 6, "b": 3}


def _matrix(spark):
    rng = np.random.default_rng(4)
    rows = [(g, 10 * k + i, 100 * k + f, None if rng.random() < 0.1 else float(rng.random())) for k, g in enumerate("abc") for i in range(6) for f in range(5) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "study string, sample long, feature long, value double").cache()


def test_embedding_and_order_of_each_study_are_those_of_the_study_alone(spark):
    m = _matrix(spark)
    scores = {(r["study"], r["sample"], r["component"]): r["score"] for r in dart.embedding_by(m).collect()}
    order = {(r["study"], r["sample"]): r["position"] for r in dart.leaf_order_by(m).collect()}
    assert {k[0] for k in scores} == {k[0] for k in order} == set("abc")
    for g in "abc":
        one = m.filter(F.col("study") == g).drop("study")
        want = {(g, r["sample"], r["component"]): r["score"] for r in dart.embedding(one).collect()}
        assert {k: v for k, v in scores.items() if k[0] == g} == pytest.approx(want)
        assert {k[1]: v for k, v in order.items() if k[0] == g} == {r["sample"]: r["position"] for r in dart.leaf_order(one).collect()}


def test_embedding_and_order_queries_return_all_studies(spark, small):
    want = {r["sample"] for r in catalog.long_matrix(spark, small).filter("study is not null and sample is not null").select("sample").distinct().collect()}
    for name in ("dart_embedding", "dart_leaf_order"):
        assert {r["sample"] for r in catalog_dart.QUERIES[name](spark, small).select("sample").distinct().collect()} == want, name


def test_pca_of_each_study(spark, small):
    m = _matrix(spark)
    got = {(r["study"], r["sample"], r["component"]): r["score"] for r in metrics.pca_by(m, "study").collect()}
    want = {(g, r["sample"], r["component"]): r["score"] for g in "abc" for r in metrics.pca(m.filter(F.col("study") == g))[0].collect()}
    assert got == pytest.approx(want)
    q = catalog.QUERIES["met_pca"](spark, small).select("study", "sample").distinct()
    assert q.count() == catalog.long_matrix(spark, small).filter("study is not null and sample is not null").select("study", "sample").distinct().count()


def test_envelopes_whose_first_member_is_not_the_most_intense():
    # C95H190: the second member is the most intense
    bounds = {"C": (1, 100), "H": (2, 202)}
    mass, p = chem.Formula.parse("C95H190").envelope(4)
    assert np.argmax(p) == 1
    mz = np.array(mass) - chem.ELECTRON
    out = annotation.annotate_sample(mz, np.array(p) * 1e4, np.zeros(4), bounds, 1, 0.005)
    assert out.tolist() == [[0, k, 1] for k in range(4)]


def test_annotation_takes_all_injections(spark, small):
    got = {r["sample"] for r in catalog_dart.QUERIES["ann_annotate"](spark, small).select("sample").distinct().collect()}
    assert got == {r["sample"] for r in catalog.spectra(spark, small).select("sample").distinct().collect()}


def test_formulas_of_all_masses_within_tolerance(spark, small):
    got = {r["mz"]: r["formulas"] for r in catalog_dart.QUERIES["chem_formulas"](spark, small).collect()}
    want = {r["mz"] for r in catalog.points(spark, small).select(F.round("mz", 3).alias("mz")).filter("mz is not null and not isnan(mz)").distinct().collect()}
    assert set(got) == want and max(want) > 260
    heavy = max(want)
    weight = {e: chem.isotope(e)[1] for e in "CHNO"}
    count = 0
    for c in range(101):
        for n in range(5):
            for o in range(9):
                left = heavy - c * weight["C"] - n * weight["N"] - o * weight["O"]
                h = round(left / weight["H"])
                count += 0 <= h <= 200 and abs(left - h * weight["H"]) <= 0.003
    assert len(got[heavy]) == len(set(got[heavy])) == count
