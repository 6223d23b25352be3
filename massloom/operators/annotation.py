"""Isotopologues: envelopes within a sample, and the vote over samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions import chem
from massloom.operators.graph import components

ENVELOPE = T.StructType([T.StructField("envelope_label", T.IntegerType()), T.StructField("envelope_index", T.IntegerType()), T.StructField("charge", T.IntegerType())])


def isotope_steps(elements: Sequence[str]) -> list[tuple[float, float]]:
    """Lowest and highest mass difference to the k-th heavier nominal mass, over the elements' isotopes."""
    steps: dict[int, list[float]] = {}
    for e in elements:
        rows = chem.ISOTOPES[e]
        for a, m, _ in rows[1:]:
            steps.setdefault(a - rows[0][0], []).append(m - rows[0][1])
    one = steps.get(1, [1.00335])
    out = []
    for k in range(1, 11):
        ways = [k * min(one), k * max(one)] + [d + (k - j) * x for j, ds in steps.items() if j <= k for d in ds for x in (min(one), max(one))]
        out.append((min(ways), max(ways)))
    return out


def candidate_envelopes(mz: np.ndarray, first: int, charge: int, steps: list[tuple[float, float]], tol: float, longest: int, allowed: np.ndarray) -> list[list[int]]:
    """Chains of features at successive isotopic distances from the first; only those that can't be longer."""
    chains, done = [[first]], []
    while chains:
        grown = []
        for c in chains:
            k = len(c)
            lo, hi = steps[k - 1] if k <= len(steps) else (np.inf, -np.inf)
            a, b = np.searchsorted(mz, [mz[first] + lo / charge - tol, mz[first] + hi / charge + tol])
            more = [j for j in range(a, b) if allowed[j] and j > c[-1]] if k < longest else []
            if more:
                grown += [[*c, j] for j in more]
            elif k > 1:
                done.append(c)
        chains = grown
    return done


def telling_elements(elements: Sequence[str]) -> list[str]:
    """Elements that shape where an envelope has its maximum.

    Those with more than two isotopes; of those with two, a nominal mass apart or two,
    the ones whose heavier isotope prevails, and the one with the most of it otherwise.
    """
    out = [e for e in elements if len(chem.ISOTOPES[e]) > 2]
    for apart in (1, 2):
        two = [(e, chem.ISOTOPES[e]) for e in elements if len(chem.ISOTOPES[e]) == 2 and chem.ISOTOPES[e][1][0] - chem.ISOTOPES[e][0][0] == apart]
        out += [e for e, x in two if x[1][2] > x[0][2]]
        minor = [(x[1][2], e) for e, x in two if x[1][2] <= x[0][2]]
        out += [max(minor)[1]] if minor else []
    return out


def lighter_rules(bounds: dict[str, tuple[int, int]], max_mass: float, longest: int, p_tol: float = 0.1, bin_size: float = 100.0) -> dict[int, list[tuple[float, float, float, float]]]:
    """For each bin of mass the rules by which a strong member finds its envelope's lightest one.

    A rule (least and greatest mass difference, least and greatest ratio of abundances to
    the lightest) sums up the k-th members of all compositions in the bin that are about
    as abundant as the lightest member or more so.
    """
    offset = np.arange(longest)
    mass, p, excess = np.zeros(1), np.eye(1, longest), np.zeros((1, longest))
    for e in telling_elements(list(bounds)):
        lo, hi = bounds[e]
        light = chem.ISOTOPES[e][0][1]
        hi = min(hi, int(max_mass // light))
        if hi < lo:
            return {}
        own = [chem.Formula.parse(f"{e}{n}").envelope(longest) if n else (np.zeros(longest), np.eye(1, longest)[0]) for n in range(lo, hi + 1)]
        q = np.array([x[1] for x in own])
        # masses above the lightest member, weighed by abundance
        dq = q * np.array([np.where(x[0] > 0, x[0] - light * n, 0.0) for n, x in zip(range(lo, hi + 1), own)])
        mass = (mass[:, None] + light * np.arange(lo, hi + 1)).ravel()
        fits = mass <= max_mass
        left, right = np.divmod(np.flatnonzero(fits), hi - lo + 1)
        mass, new_p, new_excess = mass[fits], np.zeros((fits.sum(), longest)), np.zeros((fits.sum(), longest))
        for k in offset:
            for j in range(k + 1):
                new_p[:, k] += p[left, j] * q[right, k - j]
                new_excess[:, k] += excess[left, j] * q[right, k - j] + p[left, j] * dq[right, k - j]
        p, excess = new_p, new_excess
    rules: dict[int, list[tuple[float, float, float, float]]] = {}
    number = (mass // bin_size).astype(int)
    ratio = p / p[:, :1]
    step = excess / np.where(p > 0, p, 1.0)
    for k in offset[1:]:
        strong = ratio[:, k] >= 1.0 - p_tol
        for b in np.unique(number[strong]):
            at = strong & (number == b)
            rules.setdefault(int(b), []).append((step[at, k].min(), step[at, k].max(), ratio[at, k].min(), ratio[at, k].max()))
    return rules


def first_members(mz: np.ndarray, area: np.ndarray, i: int, charge: int, rules: dict[int, list[tuple[float, float, float, float]]], tol: float, p_tol: float, allowed: np.ndarray, bin_size: float = 100.0) -> list[int]:
    """The feature itself, then lighter ones of whose envelope it may be the strongest member by a rule."""
    out = [i]
    for lo, hi, low, high in rules.get(int((mz[i] + chem.ELECTRON) * charge // bin_size), []):
        a, b = np.searchsorted(mz, [mz[i] - hi / charge - tol, mz[i] - lo / charge + tol])
        out += [j for j in range(a, b) if allowed[j] and j < i and j not in out and low - p_tol <= area[i] / area[j] <= high + p_tol]
    return out


@lru_cache(maxsize=8)
def lighter_rules_of(bounds: tuple[tuple[str, int, int], ...], longest: int, p_tol: float) -> dict[int, list[tuple[float, float, float, float]]]:
    """The rules up to the mass that the bounds reach, made once in a process."""
    own = {e: (lo, hi) for e, lo, hi in bounds}
    return lighter_rules(own, sum(chem.ISOTOPES[e][0][1] * hi for e, (_, hi) in own.items()), longest, p_tol)


def annotate_sample(mz: np.ndarray, area: np.ndarray, group: np.ndarray, bounds: dict[str, tuple[int, int]], max_charge: int = 3, tol: float = 0.01, p_tol: float = 0.1, longest: int = 5) -> np.ndarray:
    """(label, index, charge) of each feature: the most intense free feature takes the longest valid envelope that it is a member of.

    ``group`` tells which features elute together. Features are sorted by mass.
    """
    steps = isotope_steps(list(bounds))
    rules = lighter_rules_of(tuple(sorted((e, *b) for e, b in bounds.items())), longest, p_tol)
    out = np.full((len(mz), 3), -1)
    free = np.ones(len(mz), bool)
    label = 0
    for i in np.argsort(-area, kind="stable"):
        if not free[i]:
            continue
        best: tuple[int, list[int]] | None = None
        for z in range(1, max_charge + 1):
            allowed = free & (group == group[i])
            for c in (c for j in first_members(mz, area, i, z, rules, tol, p_tol, allowed) for c in candidate_envelopes(mz, j, z, steps, tol, longest, allowed) if i in c):
                n = chem.validate_envelope(list((mz[c] + chem.ELECTRON) * z), list(area[c] / area[c].sum()), bounds, tol * z, p_tol, tol * z)
                if n > max(1, c.index(i)) and (best is None or n > len(best[1])):
                    best = (z, c[:n])
        if best:
            z, c = best
            out[c] = [[label, k, z] for k in range(len(c))]
            free[c] = False
            label += 1
    return out


def annotate(features: DataFrame, keys: Sequence[str], group: str, bounds: dict[str, tuple[int, int]], **options: object) -> DataFrame:
    """Adds envelope_label, envelope_index and charge within each sample (``keys``); -1 is none.

    ``features`` has mz, area and the elution group. Annotation is greedy over a
    sample's features, so one sample is one group.
    """
    base = [f for f in features.schema.fields if f.name not in ENVELOPE.names]
    schema = T.StructType([*base, *ENVELOPE.fields])
    names = [f.name for f in base]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mz", kind="stable")[names].reset_index(drop=True)
        got = annotate_sample(pdf["mz"].to_numpy(float), pdf["area"].to_numpy(float), pdf[group].to_numpy(), bounds, **options)
        for k, c in enumerate(ENVELOPE.names):
            pdf[c] = got[:, k].astype("int32")
        return pdf

    return features.select(*names).groupBy(*keys).applyInPandas(run, schema)


def vote(features: DataFrame) -> DataFrame:
    """Consensus over samples of (sample, cluster, envelope_label, envelope_index, charge).

    A cluster takes its most frequent charge and index (ties: the smaller); first members
    are linked to other members of one sample's envelope by how often that happens,
    links between different charges are dropped, of several at one index the most
    frequent stays, and what is linked is one envelope, named by its smallest cluster.
    Returns (cluster, envelope_label, envelope_index, charge, count).
    """
    f = features.filter("cluster >= 0 and envelope_label >= 0")
    mode = lambda c: F.max_by(c, F.struct("n", -F.col(c)))
    counted = lambda c: f.groupBy("cluster", c).agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(mode(c).alias(c))
    node = counted("charge").join(counted("envelope_index"), "cluster")
    first = f.filter("envelope_index = 0").select("sample", "envelope_label", F.col("cluster").alias("a"))
    rest = f.filter("envelope_index > 0").select("sample", "envelope_label", F.col("cluster").alias("b"))
    edge = first.join(rest, ["sample", "envelope_label"]).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    na = node.select(F.col("cluster").alias("a"), F.col("charge").alias("ca"))
    nb = node.select(F.col("cluster").alias("b"), F.col("charge").alias("cb"), "envelope_index")
    edge = edge.join(na, "a").join(nb, "b").filter("ca = cb")
    w = Window.partitionBy("a", "envelope_index").orderBy(F.desc("count"), "b")
    kept = edge.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("a", "b", "count")
    label = components(kept).withColumnsRenamed({"node": "cluster", "component": "envelope_label"})
    count = kept.groupBy(F.col("b").alias("cluster")).agg(F.max("count").alias("count"))
    return label.join(node, "cluster").join(count, "cluster", "left").select("cluster", "envelope_label", "envelope_index", "charge", F.coalesce("count", F.lit(0)).alias("count"))


def annotate_adducts(*_: object, **__: object) -> DataFrame:
    """Adducts of neutral masses aren't annotated; sister ions are (see dart.sister_ions)."""
    raise NotImplementedError("adduct annotation is not available")
