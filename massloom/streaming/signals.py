"""Structured Streaming over signals as they are recorded: totals, spots and running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(signals: DataFrame, width: str = "1 minute", late: str = "2 minutes", time: str = "at") -> DataFrame:
    """Total and base peak intensity of each sample and window; signals later than ``late`` are left out."""
    return signals.withWatermark(time, late).groupBy(F.window(time, width), "sample").agg(F.sum("spint").alias("tic"), F.max("spint").alias("bpi"), F.count(F.lit(1)).alias("n")).select("sample", F.col("window.start").alias("start"), "tic", "bpi", "n")


def spots(signals: DataFrame, threshold: float, gap: str = "5 seconds", late: str = "10 seconds", time: str = "at") -> DataFrame:
    """Spots as sessions of signals at or above the threshold."""
    s = signals.filter(F.col("spint") >= threshold).withWatermark(time, late)
    return s.groupBy("sample", F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("spint").alias("total")).select("sample", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


TRACES = "sample string, trace int, first double, last double, n int, top double"


def linked_traces(signals: DataFrame, tol: float = 0.01, idle: float = 5.0, silent_ms: int = 60_000) -> DataFrame:
    """Traces linked by mass as scans arrive, given out when ``idle`` seconds pass without a signal.

    The state of a sample is its open traces: running mean mass, limits, count and top.
    A sample from which nothing comes for ``silent_ms`` of processing time gives out all
    its open traces; what comes later opens new ones, whose numbers go on.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_ = [list(x) for x in zip(*state.get[:6])] if state.exists else []
        number = state.get[6] if state.exists else 0
        done = []
        if state.hasTimedOut:
            done, open_, frames = open_, [], iter(())
        for pdf in frames:
            for time, mz, y in pdf.sort_values(["time", "mz"])[["time", "mz", "spint"]].itertuples(index=False):
                keep = []
                for t in open_:
                    (done if time - t[2] > idle else keep).append(t)
                open_ = keep
                near = min(open_, key=lambda t: abs(t[0] - mz), default=None)
                if near is not None and abs(near[0] - mz) <= tol:
                    near[3] += 1
                    near[0] += (mz - near[0]) / near[3]
                    near[2], near[4] = time, max(near[4], y)
                else:
                    open_.append([float(mz), float(time), float(time), 1, float(y), number])
                    number += 1
        cols = [list(x) for x in zip(*open_)] if open_ else [[], [], [], [], [], []]
        state.update((*cols, number))
        if open_:
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame([(key[0], t[5], t[1], t[2], t[3], t[4]) for t in done], columns=["sample", "trace", "first", "last", "n", "top"])

    held = "mean array<double>, first array<double>, last array<double>, n array<int>, top array<double>, trace array<int>, next int"
    return signals.groupBy("sample").applyInPandasWithState(update, TRACES, held, "append", "ProcessingTimeTimeout")
