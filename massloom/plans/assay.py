"""An assay end to end: raw signals to a data matrix, step by step, each step kept in Parquet.

A step runs again only if its parameters, or those of a step before it, changed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from massloom.operators import correspondence, matrix, peaks, raw

STEPS = ["detect", "describe", "match", "matrix", "fill"]


@dataclass
class Parameters:
    """Checked parameters; what is None is set by instrument and separation."""

    instrument: str = "qtof"
    separation: str = "uplc"
    mz_tol: float | None = None
    rt_tol: float | None = None
    max_missing: int = 1
    min_length: int | None = None
    min_intensity: float = 0.0
    smoothing: float = 1.0
    min_snr: float = 5.0
    min_fraction: float = 0.25
    max_deviation: float = 3.0

    def __post_init__(self) -> None:
        if self.instrument not in ("qtof", "orbitrap"):
            raise ValueError("instrument is qtof or orbitrap")
        if self.separation not in ("uplc", "hplc"):
            raise ValueError("separation is uplc or hplc")
        fast = self.separation == "uplc"
        self.mz_tol = self.mz_tol if self.mz_tol is not None else 0.01 if self.instrument == "qtof" else 0.005
        self.rt_tol = self.rt_tol if self.rt_tol is not None else 5.0 if fast else 10.0
        self.min_length = self.min_length if self.min_length is not None else 10 if fast else 20
        for name in ("mz_tol", "rt_tol", "max_deviation"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if not 0 <= self.min_fraction <= 1:
            raise ValueError("min_fraction lies between 0 and 1")


class Run:
    """A run whose signals a step may swap for others, the first ones staying at hand."""

    def __init__(self, signals: DataFrame):
        self.original = self.current = signals

    def replace(self, step: Callable[[DataFrame], DataFrame]) -> Run:
        """Puts the step's result in place of the current signals."""
        self.current = step(self.current)
        return self

    def reset(self) -> Run:
        """Back to the signals as they were first."""
        self.current = self.original
        return self


class RunCache:
    """Signals of single samples, kept by name in executors' memory and disk until cleared."""

    def __init__(self, signals: DataFrame, most: int = 32):
        self.signals, self.most = signals, most
        self._kept: dict[str, DataFrame] = {}

    def get(self, sample: str) -> DataFrame:
        """Signals of a sample, read once; the one kept longest makes way when there are too many."""
        if sample not in self._kept:
            if len(self._kept) >= self.most:
                self._kept.pop(next(iter(self._kept))).unpersist()
            self._kept[sample] = self.signals.filter(F.col("sample") == sample).persist()
        return self._kept[sample]

    def put(self, sample: str, signals: DataFrame) -> None:
        """Keeps signals under a name, such as those of a virtual sample."""
        if sample in self._kept:
            self._kept.pop(sample).unpersist()
        self._kept[sample] = signals.persist()

    def clear(self) -> None:
        for kept in self._kept.values():
            kept.unpersist()
        self._kept.clear()


class Assay:
    """Runs the steps over signals (sample, scan, time, mz, spint) and samples (sample, class)."""

    def __init__(self, spark: SparkSession, signals: DataFrame, samples: DataFrame, path: str, parameters: Parameters | None = None, detect: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.signals, self.samples, self.path = spark, signals, samples, path
        self.p = parameters or Parameters()
        self._detect = detect or (lambda s: raw.regions(s, self.p.mz_tol, self.p.max_missing, self.p.min_length, self.p.min_intensity))
        self._detector = f"{detect.__module__}.{detect.__qualname__}" if detect else "regions"
        self.ran: list[str] = []

    def _key(self, step: str) -> str:
        # the plans of the inputs and the detector's name stand for what is read and how
        inputs = [self.signals.semanticHash(), self.samples.semanticHash(), self._detector]
        return json.dumps({"steps": STEPS[: STEPS.index(step) + 1], "inputs": inputs, **asdict(self.p)}, sort_keys=True)

    def _kept(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The step's table, made anew unless it was made with the same parameters."""
        out, mark = os.path.join(self.path, step), os.path.join(self.path, f"{step}-key")
        try:
            same = self.spark.read.text(mark).first()[0] == self._key(step)
        except AnalysisException:
            # never made
            same = False
        if not same:
            make().write.mode("overwrite").parquet(out)
            self.spark.createDataFrame([(self._key(step),)], "value string").coalesce(1).write.mode("overwrite").text(mark)
            self.ran.append(step)
        return self.spark.read.parquet(out)

    def regions(self) -> DataFrame:
        return self._kept("detect", lambda: self._detect(self.signals))

    def features(self) -> DataFrame:
        bounds = {**peaks.BOUNDS[self.p.separation], "snr": (self.p.min_snr, None)}
        make = lambda: peaks.within(peaks.detect(self.regions(), ["sample", "roi_index"], self.p.smoothing), bounds).join(self.samples.select("sample", "class"), "sample").withColumn("id", F.xxhash64("sample", "roi_index", "ft_index").bitwiseAND(F.lit((1 << 63) - 1)))
        return self._kept("describe", make)

    def matched(self) -> DataFrame:
        def make() -> DataFrame:
            f = self.features()
            label = correspondence.match_features(f, "id", self.p.mz_tol, self.p.rt_tol, self.p.min_fraction, self.p.max_deviation)
            return f.join(label.withColumnRenamed("label", "cluster"), "id")

        return self._kept("match", make)

    def data_matrix(self) -> DataFrame:
        return self._kept("matrix", lambda: matrix.build_matrix(self.matched(), self.samples))

    def feature_metadata(self) -> DataFrame:
        return matrix.feature_metadata(self.matched())

    def filled(self) -> DataFrame:
        def make() -> DataFrame:
            m = self.data_matrix()
            meta = self.feature_metadata()
            width = m.agg(F.max(F.length("feature"))).first()[0] - 3
            f = meta.select(matrix.feature_code(F.col("cluster"), width).alias("feature"), F.col("mz_mean").alias("mz"), F.col("rt_mean").alias("rt"), "rt_std", "rt_start", "rt_end")
            return correspondence.fill_by_integration(m, f, self.signals, self.p.mz_tol)

        return self._kept("fill", make)
