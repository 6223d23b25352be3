"""Normalisation, scaling and the filters that curate a long matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import metrics
from massloom.operators.metrics import ratio


def normalize(matrix: DataFrame, method: str, feature: object = None) -> DataFrame:
    """Divides each sample by its sum, maximum, euclidean norm, or one feature; undefined becomes 0."""
    v = F.col("value")
    by = {"sum": F.sum(v), "max": F.max(v), "euclidean": F.sqrt(F.sum(v * v)), "feature": F.max(F.when(F.col("feature") == F.lit(feature), v))}
    if method not in by:
        raise ValueError(f"unknown normalisation {method!r}")
    scale = matrix.groupBy("sample").agg(by[method].alias("_by"))
    return matrix.join(scale, "sample").withColumn("value", F.coalesce(ratio(v, F.col("_by")), F.lit(0.0))).drop("_by")


def scale(matrix: DataFrame, method: str) -> DataFrame:
    """Autoscaling, rescaling to [0, 1], or pareto scaling of each feature; undefined becomes 0."""
    v = F.col("value")
    s = matrix.groupBy("feature").agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    out = {"autoscaling": ratio(v - F.col("_m"), F.col("_s")), "rescaling": ratio(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), "pareto": ratio(v - F.col("_m"), F.sqrt("_s"))}
    if method not in out:
        raise ValueError(f"unknown scaling {method!r}")
    return matrix.join(s, "feature").withColumn("value", F.coalesce(out[method], F.lit(0.0))).drop("_m", "_s", "_lo", "_hi")


def transform(matrix: DataFrame, method: str) -> DataFrame:
    """Decimal logarithm (of 0: minus infinity) or square root."""
    v = F.col("value")
    if method == "log":
        return matrix.withColumn("value", F.when(v > 0, F.log10(v)).when(v == 0, F.lit(float("-inf"))))
    if method == "power":
        return matrix.withColumn("value", F.when(v >= 0, F.sqrt(v)))
    raise ValueError(f"unknown transformation {method!r}")


def remove_classes(matrix: DataFrame, classes: Sequence[str]) -> DataFrame:
    return matrix.filter(F.col("class").isNull() | ~F.col("class").isin(list(classes)))


def blank_level(matrix: DataFrame, blanks: Sequence[str], mode: str = "lod", robust: bool = True) -> DataFrame:
    """(feature, level): what blanks hold of each feature: max, mean, lod (3 deviations above) or loq (10)."""
    b = matrix.filter(F.col("class").isin(list(blanks)))
    if mode == "max":
        return b.groupBy("feature").agg(F.max("value").alias("level"))
    k = {"mean": 0.0, "lod": 3.0, "loq": 10.0}[mode]
    if robust:
        # an undefined deviation of a single blank counts as none
        return metrics.mad(b, []).select("feature", (F.col("median") + k * F.coalesce("mad", F.lit(0.0))).alias("level"))
    return b.groupBy("feature").agg((F.avg("value") + k * F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("level"))


def correct_blanks(matrix: DataFrame, blanks: Sequence[str], process: Sequence[str] | None = None, mode: str = "lod", factor: float = 1.0, robust: bool = True, process_blanks: bool = True) -> DataFrame:
    """Subtracts the blank level; 0 where the value is below ``factor`` times it."""
    level = blank_level(matrix, blanks, mode, robust)
    v, c = F.col("value"), F.coalesce(F.col("level"), F.lit(0.0))
    touched = F.lit(True) if process is None else F.col("class").isin([*process, *(blanks if process_blanks else [])])
    if not process_blanks and process is None:
        touched = F.coalesce(~F.col("class").isin(list(blanks)), F.lit(True))
    new = F.when(v - factor * c < 0, F.lit(0.0)).otherwise(v - c)
    return matrix.join(level, "feature", "left").withColumn("value", F.when(touched & v.isNotNull(), new).otherwise(v)).drop("level")


def outside(c: Column, low: float, high: float) -> Column:
    return (c < low) | (c > high)


def prevalence(matrix: DataFrame, classes: Sequence[str], low: float = 0.5, high: float = 1.0, intraclass: bool = True, threshold: float = 0.0) -> DataFrame:
    """Features to remove: their detection rate lies outside the bounds in every class (or over all of them)."""
    m = matrix.filter(F.col("class").isin(list(classes)))
    dr = metrics.detection_rate(m, ["class"] if intraclass else [], threshold)
    return dr.groupBy("feature").agg(F.bool_and(outside(F.col("dr"), low, high)).alias("_out")).filter("_out").select("feature")


def variation(matrix: DataFrame, classes: Sequence[str], low: float = 0.0, high: float = 0.25, robust: bool = False, intraclass: bool = True) -> DataFrame:
    """Features to remove: their CV lies outside the bounds in every class."""
    m = matrix.filter(F.col("class").isin(list(classes)))
    c = (metrics.robust_cv if robust else metrics.cv)(m, ["class"] if intraclass else [])
    return c.groupBy("feature").agg(F.bool_and(outside(F.col("cv"), low, high)).alias("_out")).filter("_out").select("feature")


def dratio_filter(matrix: DataFrame, qc: Sequence[str], study: Sequence[str], low: float = 0.0, high: float = 0.5, robust: bool = False) -> DataFrame:
    """Features to remove by their D-ratio."""
    return metrics.dratio(matrix, qc, study, robust).filter(outside(F.col("dratio"), low, high)).select("feature")


def dilution_filter(matrix: DataFrame, dqc: Sequence[str], min_corr: float = 0.8, p_limit: float = 0.1, mode: str = "ols", dilution: str = "dilution") -> DataFrame:
    """Features to remove: they don't follow the dilution (signed coefficient for pearson and spearman)."""
    m = matrix.filter(F.col("class").isin(list(dqc)))
    if mode == "ols":
        fit = metrics.ols(m, dilution)
        # a perfect fit that isn't level has no residuals to be judged
        perfect = (F.col("r2") > 1 - 1e-12) & (F.abs("slope") > 1e-12)
        ok = fit.filter((F.col("r2") >= min_corr) & (perfect | (F.col("jb_p") >= p_limit)))
    elif mode == "pearson":
        ok = metrics.pearson(m, dilution).filter(F.col("r") >= min_corr)
    elif mode == "spearman":
        ok = metrics.spearman(m, dilution).filter(F.col("rho") >= min_corr)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return m.select("feature").distinct().join(ok, "feature", "left_anti")


@dataclass
class Step:
    """A step of a pipeline: a filter returns features to remove, a transform a new matrix."""

    name: str
    run: Callable[..., DataFrame]
    kind: str = "transform"
    parameters: dict = field(default_factory=dict)
    needs: Sequence[str] = ()

    def __call__(self, matrix: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in matrix.columns]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        out = self.run(matrix, **self.parameters)
        return matrix.join(out.select("feature"), "feature", "left_anti") if self.kind == "filter" else out


STEPS: dict[str, tuple[Callable[..., DataFrame], str, tuple[str, ...]]] = {
    "normalize": (normalize, "transform", ()),
    "scale": (scale, "transform", ()),
    "transform": (transform, "transform", ()),
    "remove_classes": (remove_classes, "transform", ("class",)),
    "correct_blanks": (correct_blanks, "transform", ("class",)),
    "prevalence": (prevalence, "filter", ("class",)),
    "variation": (variation, "filter", ("class",)),
    "dratio": (dratio_filter, "filter", ("class",)),
    "dilution": (dilution_filter, "filter", ("class", "dilution")),
}


#: sample types whose mapped classes are a parameter's default, and types that must be mapped for it
DEFAULTS: dict[str, dict[str, str]] = {
    "correct_blanks": {"blanks": "blank"},
    "prevalence": {"classes": "sample"},
    "variation": {"classes": "qc"},
    "dratio": {"qc": "qc", "study": "sample"},
    "dilution": {"dqc": "dqc"},
}


def step_of(step: dict, mapping: dict[str, list[str]] | None = None) -> Step:
    """A step from {"name": ..., parameters}; classes that aren't given come from the mapping."""
    p = dict(step)
    name = p.pop("name", None)
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}")
    for parameter, kind in DEFAULTS.get(name, {}).items():
        if parameter not in p and mapping and mapping.get(kind):
            p[parameter] = mapping[kind]
    run, kind, needs = STEPS[name]
    return Step(name, run, kind, p, needs)


def check_needs(step: Step, matrix: DataFrame, mapping: dict[str, list[str]] | None = None) -> None:
    """ValueError for an empty matrix, or for columns or sample types that the step needs and that are missing."""
    if lacks := [c for c in step.needs if c not in matrix.columns]:
        raise ValueError(f"{step.name} needs {', '.join(lacks)}")
    if lacks := [kind for parameter, kind in DEFAULTS.get(step.name, {}).items() if not step.parameters.get(parameter)]:
        raise ValueError(f"{step.name} needs classes of {', '.join(lacks)}")
    if not matrix.take(1):
        raise ValueError(f"{step.name} needs a matrix with values")


def build_pipeline(steps: Sequence[dict], mapping: dict[str, list[str]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """One lazy function of a list of {"name": ..., parameters}; unknown names are refused."""
    chain = [step_of(s, mapping) for s in steps]

    def pipeline(matrix: DataFrame) -> DataFrame:
        for s in chain:
            matrix = s(matrix)
        return matrix

    return pipeline


def rank_within(by: Sequence[str], order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))
