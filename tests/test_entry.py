import os
import re

import __spark_entry__ as entry
from massloom.plans import catalog, catalog_dart, problems


def test_names_and_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(s) <= set(q)
    parts = [m.QUERIES for m in (catalog, catalog_dart, problems)]
    assert sum(map(len, parts)) == len({k for p in parts for k in p})


def test_core_stands_without_the_subpackage():
    root = os.path.dirname(os.path.abspath(problems.__file__)).rsplit(os.sep, 1)[0]
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(from|import) massloom\.llm", open(os.path.join(folder, f), encoding="utf-8").read(), re.M), f


def test_entry_runs(spark, small):
    assert entry.entry(spark).limit(5).count() > 0


def test_problem_queries_equal_sql(spark, small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    for name in ("p3_found", "raw_eic_sum", "met_cv", "mat_islands", "dart_crude_cluster"):
        df = entry.queries()[name](spark, small)
        want = c.sql(entry.oracle_sql()[name]).df()
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        key = lambda r: tuple((v is None, v or "") for v in r)
        assert sorted(norm_rows(df.toPandas(), cols), key=key) == sorted(norm_rows(want, cols), key=key), name


def norm_rows(pdf, cols):
    out = []
    for r in pdf[cols].astype(object).itertuples(index=False):
        out.append(tuple(None if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v) for v in r))
    return out
