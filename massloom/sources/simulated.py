"""Simulated runs and studies, made by Spark from a seed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate_run(spark: SparkSession, mz: Sequence[float], amplitude: Sequence[float], rt: Sequence[float], sigma: Sequence[float], times: Sequence[float], noise: float = 0.0, seed: int = 1, sample: str = "simulated") -> DataFrame:
    """Centroid signals (sample, scan, time, mz, spint) of gaussian peaks over the given times."""
    t = spark.createDataFrame([(i, float(x)) for i, x in enumerate(times)], "scan int, time double")
    p = spark.createDataFrame([(i, float(a), float(b), float(c), float(s)) for i, (a, b, c, s) in enumerate(zip(mz, amplitude, rt, sigma))], "k int, mz double, amplitude double, rt double, sigma double")
    z = (F.col("time") - F.col("rt")) / F.col("sigma")
    # a normal deviate that depends on the seed and the place only
    u = [(F.pmod(F.xxhash64("scan", "k", F.lit(seed), F.lit(i)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for i in (1, 2)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
    y = F.col("amplitude") * F.exp(-z * z / 2) + noise * F.abs(normal)
    return t.crossJoin(p).select(F.lit(sample).alias("sample"), "scan", "time", "mz", y.alias("spint"))


def simulate_study(population: dict[str, int], means: dict[str, Sequence[float]], variances: dict[str, Sequence[float]], mz: Sequence[float], rt: Sequence[float], blank: Sequence[float] | None = None, qc_every: int = 5, triple: bool = True, batch_size: int = 25, seed: int = 1) -> tuple[list[dict], list[dict], list[dict]]:
    """(matrix, features, samples) rows of a small study with controls, blanks and batches."""
    rng = np.random.default_rng(seed)
    order = rng.permutation([c for c, n in population.items() for _ in range(n)])
    total = sum(population.values())
    level = {**{c: np.array(m, float) for c, m in means.items()}, "QC": sum(np.array(means[c], float) * n / total for c, n in population.items())}
    spread = {**{c: np.array(v, float) for c, v in variances.items()}, "QC": np.zeros(len(mz))}
    plan: list[tuple[str, int]] = []
    for b in range(0, len(order), batch_size):
        number, part = b // batch_size + 1, order[b : b + batch_size]
        plan += [("blank", number)] * (blank is not None) + [("QC", number)] * (3 if triple else 1)
        for i, c in enumerate(part):
            plan.append((str(c), number))
            if (i + 1) % qc_every == 0 and i + 1 < len(part):
                plan.append(("QC", number))
        plan += [("QC", number)] * (3 if triple else 1) + [("blank", number)] * (blank is not None)
    matrix, samples = [], []
    for k, (c, b) in enumerate(plan, 1):
        name = f"S{k:04d}"
        samples.append({"sample": name, "class": c, "ord": k, "batch": b})
        base = np.array(blank, float) if c == "blank" else level[c] + rng.normal(size=len(mz)) * np.sqrt(spread[c])
        for j, v in enumerate(np.maximum(base, 0)):
            matrix.append({"sample": name, "feature": f"FT-{j + 1}", "value": float(v)})
    return matrix, [{"feature": f"FT-{j + 1}", "mz": float(a), "rt": float(b)} for j, (a, b) in enumerate(zip(mz, rt))], samples
