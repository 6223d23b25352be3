"""Readers of processed data from other programs, all to the long matrix and its metadata."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Container:
    """Long matrix (sample, feature, value), features (feature, mz, rt, ...) and samples (sample, class, ...)."""

    matrix: DataFrame
    features: DataFrame
    samples: DataFrame


def _head(spark: SparkSession, path: str, n: int, sep: str) -> list[list[str]]:
    """The first rows of a file, on the driver: the header is a few lines whatever the file's size."""
    lines = [r["value"] for r in spark.read.text(path).limit(n).collect()]
    return list(csv.reader(lines, delimiter=sep))


def _numbers(c: str):
    return F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None))


def _unpivot(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    typed = df.select(*ids, *[_numbers(c).alias(c) for c in names])
    return typed.unpivot(list(ids), list(names), "sample", "value")


def read_progenesis(spark: SparkSession, path: str) -> Container:
    """CSV with two rows of groups above the header; raw abundances are read, retention in minutes becomes seconds."""
    top, classes, header = _head(spark, path, 3, ",")
    begin = next((i for i, x in enumerate(top) if x.strip() == "Raw abundance"), None)
    if begin is None:
        raise ValueError("no block of raw abundances")
    end = next((i for i in range(begin + 1, len(header)) if i < len(top) and top[i].strip()), len(header))
    names = [f"c{i}" for i in range(len(header))]
    df = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    at = {h: f"c{i}" for i, h in reversed(list(enumerate(header)))}
    body = df.filter(F.expr(f"try_cast(`{at['m/z']}` AS double)").isNotNull()).withColumnRenamed(at["Compound"], "feature")
    rt = next(at[h] for h in header if h.startswith("Retention time"))
    features = body.select("feature", _numbers(at["m/z"]).alias("mz"), (_numbers(rt) * 60).alias("rt"))
    sample, group, current = {}, {}, ""
    for i in range(begin, end):
        current = classes[i].strip() if i < len(classes) and classes[i].strip() else current
        sample[f"c{i}"], group[header[i]] = header[i], current
    long = _unpivot(body, ["feature"], list(sample))
    named = F.create_map(*[F.lit(x) for k, v in sample.items() for x in (k, v)])
    matrix = long.withColumn("sample", F.element_at(named, F.col("sample"))).select("sample", "feature", "value")
    return Container(matrix, features, spark.createDataFrame(list(group.items()), "sample string, class string"))


def read_mzmine(spark: SparkSession, path: str, sample_metadata: str) -> Container:
    """CSV of peak areas and a CSV of samples; features become FT-1, FT-2, ... in the order of their row ID."""
    df = spark.read.csv(path, header=True)
    ids = {c: c.removeprefix("row ").strip() for c in df.columns if c.startswith("row ")}
    areas = [c for c in df.columns if c.endswith("Peak area")]
    n = df.count()
    w = Window.orderBy(F.expr("try_cast(`row ID` AS bigint)"))
    order = df.select("row ID").withColumn("_k", F.row_number().over(w)).withColumn("feature", F.concat(F.lit("FT-"), F.lpad(F.col("_k").cast("string"), len(str(n)), "0"))).drop("_k")
    body = df.join(order, "row ID")
    features = body.select("feature", _numbers("row m/z").alias("mz"), (_numbers("row retention time") * 60).alias("rt"), *[F.col(c).alias(v) for c, v in ids.items() if v not in ("ID", "m/z", "retention time")])
    short = {c: c.removesuffix("Peak area").strip() for c in areas}
    short = {c: v.rpartition(".")[0] or v for c, v in short.items()}
    body = body.select("feature", *[F.col(f"`{c}`").alias(v) for c, v in short.items()])
    long = _unpivot(body, ["feature"], list(short.values()))
    seen = long.groupBy("sample").agg(F.count("value").alias("_n")).filter("_n > 0").select("sample")
    return Container(long.join(seen, "sample", "left_semi").select("sample", "feature", "value"), features, spark.read.csv(sample_metadata, header=True).withColumn("sample", F.regexp_replace("sample", r"\.[^.]+$", "")))


def read_xcms(spark: SparkSession, data_matrix: str, feature_metadata: str, sample_metadata: str, class_column: str = "class", sep: str = "\t") -> Container:
    """Three tables: features in rows, mzmed and rtmed, and the samples with a column for the class."""
    m = spark.read.csv(data_matrix, header=True, sep=sep)
    m = m.withColumnRenamed(m.columns[0], "feature")
    f = spark.read.csv(feature_metadata, header=True, sep=sep)
    f = f.withColumnRenamed(f.columns[0], "feature").withColumn("mz", _numbers("mzmed")).withColumn("rt", _numbers("rtmed")).drop("mzmed", "rtmed")
    s = spark.read.csv(sample_metadata, header=True, sep=sep)
    s = s.withColumnRenamed(s.columns[0], "sample").withColumnRenamed(class_column, "class")
    return Container(_unpivot(m, ["feature"], m.columns[1:]).select("sample", "feature", "value"), f, s)


def read_data_matrix(spark: SparkSession, path: str, kind: str, **more: str) -> Container:
    """Dispatch by format: progenesis, mzmine, xcms or parquet."""
    from massloom.sources.sinks import load

    readers = {"progenesis": read_progenesis, "mzmine": read_mzmine, "xcms": read_xcms, "parquet": load}
    if kind not in readers:
        raise ValueError(f"unknown format {kind!r}")
    return readers[kind](spark, path, **more)


def sample_metadata(meta: DataFrame, names: DataFrame) -> DataFrame:
    """Checks and completes the samples' metadata.

    Needs sample; its names and those of ``names`` must be the same. Missing class is 0,
    missing order counts up by name, missing batch is 1. Orders must be unique and above
    0, batches above 0.
    """
    if "sample" not in meta.columns:
        raise ValueError("the metadata have no column sample")
    if meta.join(names, "sample", "left_anti").limit(1).count():
        raise ValueError("the metadata name samples without data")
    if names.join(meta, "sample", "left_anti").limit(1).count():
        raise ValueError("samples are missing in the metadata")
    out = meta
    if "class" not in out.columns:
        out = out.withColumn("class", F.lit("0"))
    if "order" not in out.columns:
        out = out.withColumn("order", F.row_number().over(Window.orderBy("sample")))
    if "batch" not in out.columns:
        out = out.withColumn("batch", F.lit(1))
    out = out.withColumn("order", F.col("order").cast("int")).withColumn("batch", F.col("batch").cast("int"))
    bad = out.agg(F.count("order").alias("n"), F.countDistinct("order").alias("u"), F.min("order").alias("o"), F.min("batch").alias("b"), F.count(F.lit(1)).alias("all")).first()
    if bad["all"] and (bad["u"] != bad["all"] or bad["o"] < 1):
        raise ValueError("orders must be unique and above 0")
    if bad["all"] and (bad["b"] is None or bad["b"] < 1):
        raise ValueError("batches must be above 0")
    return out


def add_order(samples: DataFrame, path: str, interbatch: bool = True) -> DataFrame:
    """Order and batch from a CSV with sample, order and batch."""
    from massloom.operators.matrix import interbatch_order

    o = samples.sparkSession.read.csv(path, header=True).select("sample", F.col("order").cast("int").alias("ord"), F.col("batch").cast("int").alias("batch"))
    out = samples.drop("ord", "batch").join(o, "sample")
    return interbatch_order(out).drop("ord").withColumnRenamed("inter_order", "ord") if interbatch else out


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """TSV of spots; only those to include, with times in seconds."""
    s = spark.read.csv(path, header=True, sep="\t", comment="#")
    out = s.filter(F.lower("include").isin("true", "1", "yes"))
    return out.select(F.col("msData_ID").alias("sample"), F.col("spotInd").cast("int").alias("spot"), "name", "group", "class", F.expr("try_cast(batch AS int)").alias("batch"), _numbers("startRT_seconds").alias("start_time"), _numbers("endRT_seconds").alias("end_time"), "comment")


def read_compounds(spark: SparkSession, path: str, adducts: dict[str, tuple[float, int]], sep: str = "\t") -> DataFrame:
    """Compounds (name, mz) of a TSV: its mass-to-charge, or that of each adduct (mass, charge) of the formula."""
    from massloom.functions.chem import mass_column

    c = spark.read.csv(path, header=True, sep=sep, comment="#")
    direct = c.filter("try_cast(MZ AS double) IS NOT NULL").select(F.col("CompoundName").alias("name"), F.expr("try_cast(MZ AS double)").alias("mz"))
    a = spark.createDataFrame([(k, m, z) for k, (m, z) in adducts.items()], "adduct string, add double, z int")
    by = c.filter("try_cast(MZ AS double) IS NULL AND ChemicalFormula IS NOT NULL").withColumn("adduct", F.explode(F.split("Adducts", r"\s*[,;]\s*"))).withColumn("_m", mass_column(F.col("ChemicalFormula")))
    unknown = by.join(a, "adduct", "left_anti").select("adduct").distinct().limit(3).collect()
    if unknown:
        raise KeyError(f"unknown adduct {unknown[0][0]}")
    return direct.unionByName(by.join(a, "adduct").select(F.concat_ws(" ", "CompoundName", "adduct").alias("name"), ((F.col("_m") + F.col("add")) / F.abs("z")).alias("mz")))
