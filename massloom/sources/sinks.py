"""Writing containers, matrices and annotations. Parquet is the primary form."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.matrix import to_wide
from massloom.sources.tables import Container


def save(c: Container, path: str) -> None:
    """Three Parquet tables in a folder."""
    for name in ("matrix", "features", "samples"):
        getattr(c, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Container:
    """What save() wrote."""
    return Container(*[spark.read.parquet(f"{path}/{name}") for name in ("matrix", "features", "samples")])


def to_csv(c: Container, path: str) -> None:
    """Samples in rows: metadata at the left, a column for each feature."""
    wide = to_wide(c.matrix)
    c.samples.join(wide, "sample", "left").orderBy("sample").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_matrix(matrix: DataFrame, features: DataFrame, path: str, sep: str = "\t") -> None:
    """Features in rows with their masses and annotations, a column for each sample; separators inside values become --SEP--."""
    wide = matrix.groupBy("feature").pivot("sample").agg(F.first("value", ignorenulls=True))
    names = [x for x, t in features.dtypes if t == "string"]
    clean = features.select(*[F.regexp_replace(F.col(c), sep, "--SEP--").alias(c) if c in names else F.col(c) for c in features.columns])
    clean.join(wide, "feature", "left").orderBy("feature").coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def annotations_json(annotations: DataFrame) -> DataFrame:
    """One line of JSON for each feature with annotations."""
    return annotations.select(F.to_json(F.struct(*annotations.columns)).alias("value"))


def feature_ml(brackets: DataFrame, rt_start: float = 0.0, rt_end: float = 1400.0) -> DataFrame:
    """featureMap XML as lines (part, value): head, one feature a line, tail; write with .text after sorting by part."""
    spark = brackets.sparkSession
    hull = F.format_string(
        '<convexhull nr="0"><pt x="%s" y="%s"/><pt x="%s" y="%s"/><pt x="%s" y="%s"/><pt x="%s" y="%s"/></convexhull>',
        *[x for a, b in ((rt_start, "mz_min"), (rt_start, "mz_max"), (rt_end, "mz_max"), (rt_end, "mz_min")) for x in (F.lit(a).cast("string"), F.col(b).cast("string"))],
    )
    line = F.concat(F.format_string('<feature id="%s"><position dim="0">%s</position><position dim="1">%s</position><intensity>%s</intensity>', F.col("feature").cast("string"), F.lit((rt_start + rt_end) / 2).cast("string"), F.col("mz_mean").cast("string"), F.col("samples").cast("string")), hull, F.lit("</feature>"))
    ends = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><featureMap version="1.4"><featureList>'), (2, "</featureList></featureMap>")], "part int, value string")
    return ends.unionByName(brackets.select(F.lit(1).alias("part"), line.alias("value"))).orderBy("part", "value")


def r_script(matrix_path: str) -> str:
    """R code that reads an exported matrix."""
    return f'data <- read.delim("{matrix_path}", check.names = FALSE)\nrownames(data) <- data$feature\n'


def compound_template() -> str:
    """Head and two example rows of a compound table."""
    head = ["_ID", "CompoundName", "InChi", "SMILES", "ChemicalFormula", "Adducts", "MZ", "IonMode"]
    rows = [["1", "caffeine", "", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C8H10N4O2", "[M+H]+", "", "+"], ["2", "by mass alone", "", "", "", "", "195.0877", "+"]]
    return "# one compound a line; give MZ, or ChemicalFormula and Adducts\n" + "\n".join("\t".join(r) for r in [head, *rows]) + "\n"


class History:
    """Append-only steps of a processing, kept as JSON lines in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, step: str, text: str, data: object = None) -> None:
        row = (step, text, json.dumps(data, default=str, sort_keys=True), datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([row], "step string, text string, data string, at timestamp_ntz").coalesce(1).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema("step string, text string, data string, at timestamp_ntz").json(self.path)
