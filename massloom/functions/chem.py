"""Chemical formulas: parsing, masses, isotopic envelopes, and formulas for a mass."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELECTRON = 0.00054858

#: fixed values: mass number, mass and abundance of the isotopes of each element
ISOTOPES: dict[str, list[tuple[int, float, float]]] = {
    "H": [(1, 1.00782503223, 0.999885), (2, 2.01410177812, 0.000115)],
    "Li": [(6, 6.0151228874, 0.0759), (7, 7.0160034366, 0.9241)],
    "B": [(10, 10.01293695, 0.199), (11, 11.00930536, 0.801)],
    "C": [(12, 12.0, 0.9893), (13, 13.00335483507, 0.0107)],
    "N": [(14, 14.00307400443, 0.99636), (15, 15.00010889888, 0.00364)],
    "O": [(16, 15.99491461957, 0.99757), (17, 16.9991317565, 0.00038), (18, 17.99915961286, 0.00205)],
    "F": [(19, 18.99840316273, 1.0)],
    "Na": [(23, 22.989769282, 1.0)],
    "Mg": [(24, 23.985041697, 0.7899), (25, 24.985836976, 0.1), (26, 25.982592968, 0.1101)],
    "Al": [(27, 26.98153853, 1.0)],
    "Si": [(28, 27.97692653465, 0.92223), (29, 28.9764946649, 0.04685), (30, 29.973770136, 0.03092)],
    "P": [(31, 30.97376199842, 1.0)],
    "S": [(32, 31.9720711744, 0.9499), (33, 32.9714589098, 0.0075), (34, 33.967867004, 0.0425), (36, 35.96708071, 0.0001)],
    "Cl": [(35, 34.968852682, 0.7576), (37, 36.965902602, 0.2424)],
    "K": [(39, 38.9637064864, 0.932581), (40, 39.963998166, 0.000117), (41, 40.9618252579, 0.067302)],
    "Ca": [(40, 39.962590863, 0.96941), (42, 41.95861783, 0.00647), (43, 42.95876644, 0.00135), (44, 43.95548156, 0.02086), (46, 45.953689, 0.00004), (48, 47.95252276, 0.00187)],
    "Cr": [(50, 49.94604183, 0.04345), (52, 51.94050623, 0.83789), (53, 52.94064815, 0.09501), (54, 53.93887916, 0.02365)],
    "Mn": [(55, 54.93804391, 1.0)],
    "Fe": [(54, 53.93960899, 0.05845), (56, 55.93493633, 0.91754), (57, 56.93539284, 0.02119), (58, 57.93327443, 0.00282)],
    "Co": [(59, 58.93319429, 1.0)],
    "Ni": [(58, 57.93534241, 0.68077), (60, 59.93078588, 0.26223), (61, 60.93105557, 0.011399), (62, 61.92834537, 0.036346), (64, 63.92796682, 0.009255)],
    "Cu": [(63, 62.92959772, 0.6915), (65, 64.9277897, 0.3085)],
    "Zn": [(64, 63.92914201, 0.4917), (66, 65.92603381, 0.2773), (67, 66.92712775, 0.0404), (68, 67.92484455, 0.1845), (70, 69.9253192, 0.0061)],
    "As": [(75, 74.92159457, 1.0)],
    "Se": [(74, 73.922475934, 0.0089), (76, 75.919213704, 0.0937), (77, 76.919914154, 0.0763), (78, 77.91730928, 0.2377), (80, 79.9165218, 0.4961), (82, 81.9166995, 0.0873)],
    "Br": [(79, 78.9183376, 0.5069), (81, 80.9162897, 0.4931)],
    "I": [(127, 126.9044719, 1.0)],
}


class InvalidFormula(ValueError):
    """The text is no formula."""


class InvalidIsotope(ValueError):
    """The formula names an element or isotope that isn't in the table."""


def load_isotopes(path: str) -> None:
    """Adds elements from a JSON file {symbol: [[mass number, mass, abundance], ...]}."""
    with open(path, encoding="utf-8") as f:
        for symbol, rows in json.load(f).items():
            ISOTOPES[symbol] = [(int(a), float(m), float(p)) for a, m, p in rows]
    _envelope_of.cache_clear()


def isotope(symbol: str, number: int | None = None) -> tuple[int, float, float]:
    """(mass number, mass, abundance); the most abundant one without a number."""
    if symbol not in ISOTOPES:
        raise InvalidIsotope(symbol)
    if number is None:
        return max(ISOTOPES[symbol], key=lambda x: x[2])
    for x in ISOTOPES[symbol]:
        if x[0] == number:
            return x
    raise InvalidIsotope(f"{number}{symbol}")


def lightest(symbol: str) -> tuple[int, float, float]:
    """The isotope with the smallest mass number."""
    isotope(symbol)
    return min(ISOTOPES[symbol])


_PART = re.compile(r"\((\d+)([A-Z][a-z]?)\)(\d*)|([A-Z][a-z]?)(\d*)|([(\[])|([)\]])(\d*)")
_CHARGE = re.compile(r"^(?:\[(?P<inner>.*)\](?P<n>\d*)(?P<sign>[+-])|(?P<plain>[^+\-]*?)(?P<sign2>[+-]))$")


@dataclass(frozen=True)
class Formula:
    """Counts of isotopes {(symbol, mass number): n} and a charge."""

    counts: dict[tuple[str, int], int] = field(default_factory=dict)
    charge: int = 0

    @classmethod
    def parse(cls, text: str) -> Formula:
        """Elements, (13C) isotopes, nested groups with multipliers, and a charge as in [CO3]2- or CO-."""
        body, charge = text.strip(), 0
        m = _CHARGE.match(body)
        if m:
            sign = m["sign"] or m["sign2"]
            charge = int(m["n"] or 1) * (1 if sign == "+" else -1)
            body = m["inner"] if m["inner"] is not None else m["plain"]
            # 42- could be four of the atom and two charges: such a charge needs brackets
            if m["inner"] is None and re.search(r"\d\d$", body):
                raise InvalidFormula(text)
        stack: list[Counter] = [Counter()]
        opened: list[str] = []
        at = 0
        while at < len(body):
            p = _PART.match(body, at)
            if not p:
                raise InvalidFormula(text)
            at = p.end()
            if p[1]:
                stack[-1][p[2], isotope(p[2], int(p[1]))[0]] += int(p[3] or 1)
            elif p[4]:
                stack[-1][p[4], isotope(p[4])[0]] += int(p[5] or 1)
            elif p[6]:
                stack.append(Counter())
                opened.append(p[6])
            else:
                if not opened or {"(": ")", "[": "]"}[opened.pop()] != p[7]:
                    raise InvalidFormula(text)
                inner = stack.pop()
                for k, n in inner.items():
                    stack[-1][k] += n * int(p[8] or 1)
        if opened or not body:
            raise InvalidFormula(text)
        return cls({k: n for k, n in stack[0].items() if n}, charge)

    def __add__(self, other: Formula) -> Formula:
        return Formula(dict(Counter(self.counts) + Counter(other.counts)), self.charge + other.charge)

    def __sub__(self, other: Formula) -> Formula:
        left = Counter(self.counts)
        left.subtract(other.counts)
        if any(n < 0 for n in left.values()):
            raise ValueError("the difference has negative counts")
        return Formula({k: n for k, n in left.items() if n}, self.charge - other.charge)

    def __hash__(self) -> int:
        return hash((frozenset(self.counts.items()), self.charge))

    @property
    def mass(self) -> float:
        """Exact mass, electrons counted."""
        return sum(n * isotope(s, a)[1] for (s, a), n in self.counts.items()) - ELECTRON * self.charge

    @property
    def nominal_mass(self) -> int:
        return sum(n * a for (_, a), n in self.counts.items())

    def __str__(self) -> str:
        """C, 13C, H, 2H first, then by symbol; a charge in brackets."""
        rank = {"C": 0, "H": 1}
        parts = []
        for (s, a), n in sorted(self.counts.items(), key=lambda x: (rank.get(x[0][0], 2), x[0][0], x[0][1] != isotope(x[0][0])[0], x[0][1])):
            name = s if a == isotope(s)[0] else f"({a}{s})"
            parts.append(name + (str(n) if n > 1 else ""))
        text = "".join(parts)
        if not self.charge:
            return text
        size = abs(self.charge)
        return f"[{text}]{size if size > 1 else ''}{'+' if self.charge > 0 else '-'}"

    def envelope(self, length: int = 10, abundances: dict[str, Sequence[float]] | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Mean exact mass and probability of each nominal mass from the lightest; probabilities sum to one.

        Atoms of a named isotope have only that one. ``abundances`` overrides the
        natural ones of an element.
        """
        mass, p = np.zeros(1), np.ones(1)
        for (s, a), n in self.counts.items():
            if a != isotope(s)[0]:
                mass, p = _combine(mass, p, np.array([n * isotope(s, a)[1]]), np.array([1.0]), length)
            else:
                own = tuple(abundances[s]) if abundances and s in abundances else None
                mass, p = _combine(mass, p, *_envelope_of(s, n, length, own), length)
        size = min(length, len(p))
        mass, p = np.resize(mass[:size], size), p[:size]
        out_m, out_p = np.zeros(length), np.zeros(length)
        out_m[:size], out_p[:size] = mass - ELECTRON * self.charge * (p > 0), p
        out_p[out_p < least] = 0.0
        out_m[out_p == 0] = 0.0
        return out_m, out_p / out_p.sum()


def _combine(m1: np.ndarray, p1: np.ndarray, m2: np.ndarray, p2: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Convolution of two envelopes; masses are means weighted by probability."""
    p = np.convolve(p1, p2)[:length]
    weighted = (np.convolve(m1 * p1, p2) + np.convolve(p1, m2 * p2))[:length]
    return np.divide(weighted, p, out=np.zeros_like(p), where=p > 0), p


@lru_cache(maxsize=20_000)
def _envelope_of(symbol: str, n: int, length: int, own: tuple[float, ...] | None) -> tuple[np.ndarray, np.ndarray]:
    """Envelope of n atoms of an element, by repeated doubling."""
    rows = ISOTOPES[symbol]
    first = rows[0][0]
    size = rows[-1][0] - first + 1
    m, p = np.zeros(size), np.zeros(size)
    for k, (a, mass, share) in enumerate(rows):
        m[a - first], p[a - first] = mass, own[k] if own else share
    if n == 0:
        return np.zeros(1), np.ones(1)
    if n == 1:
        return m[:length], p[:length]
    half = _envelope_of(symbol, n // 2, length, own)
    both = _combine(*half, *half, length)
    return _combine(*both, m, p, length) if n % 2 else both


def formulas(mass: float, tol: float, bounds: dict[str, tuple[int, int]], most: int | None = None) -> list[tuple[float, dict[str, int]]]:
    """Element counts within bounds whose mass lies within tol, nearest first.

    The two elements with the widest bounds are solved last: all counts of the others are
    enumerated as one grid, and for each of its points and each count of the first of
    the two, the second has at most one count.
    """
    order = sorted(bounds, key=lambda e: bounds[e][1] - bounds[e][0])
    if not order:
        return []
    weight = {e: isotope(e)[1] for e in order}
    *outer, last = order
    grid = np.array([[]]).reshape(1, 0)
    total = np.zeros(1)
    for e in outer:
        lo, hi = bounds[e]
        k = np.arange(lo, hi + 1)
        new = (total[:, None] + k * weight[e]).ravel()
        grid = np.concatenate([np.repeat(grid, len(k), 0), np.tile(k, len(grid))[:, None]], 1)
        ok = new <= mass + tol - bounds[last][0] * weight[last]
        grid, total = grid[ok], new[ok]
    count = np.rint((mass - total) / weight[last]).astype(int)
    error = total + count * weight[last] - mass
    ok = (count >= bounds[last][0]) & (count <= bounds[last][1]) & (np.abs(error) <= tol)
    rows = [(float(e), dict(zip([*outer, last], [*map(int, g), int(c)]))) for g, c, e in zip(grid[ok], count[ok], error[ok])]
    rows.sort(key=lambda r: (abs(r[0]), sorted(r[1].items())))
    return rows[:most]


def score_envelope(mass: Sequence[float], p: Sequence[float], counts: dict[str, int], mass_sigma: float = 0.01, p_sigma: float = 0.05) -> float:
    """Likeness of a measured envelope to a formula's: product of two-sided normal tails."""
    f = Formula({(e, isotope(e)[0]): n for e, n in counts.items() if n})
    tm, tp = f.envelope(len(mass))
    tp = tp[: len(p)] / max(tp[: len(p)].sum(), 1e-12)
    out = 1.0
    for a, b, c, e in zip(mass, p, tm, tp):
        out *= math.erfc(abs(a - c) / (math.sqrt(2) * mass_sigma)) * math.erfc(abs(b - e) / (math.sqrt(2) * p_sigma))
    return out


def best_formulas(mass: Sequence[float], p: Sequence[float], bounds: dict[str, tuple[int, int]], tol: float = 0.01, n: int = 10) -> list[tuple[float, dict[str, int]]]:
    """The n formulas with the highest score for a measured envelope, best first."""
    found = [(score_envelope(mass, p, c, tol), c) for _, c in formulas(mass[0], tol, bounds)]
    return sorted(found, key=lambda r: (-r[0], sorted(r[1].items())))[:n]


def validate_envelope(mass: Sequence[float], p: Sequence[float], bounds: dict[str, tuple[int, int]], tol: float = 0.01, p_tol: float = 0.05, step_tol: float = 0.01) -> int:
    """How many members, from the first, some formula explains within tolerances; 0 if none does."""
    for length in range(len(mass), 0, -1):
        share = np.array(p[:length]) / max(sum(p[:length]), 1e-12)
        for _, counts in formulas(mass[0], tol, bounds):
            f = Formula({(e, isotope(e)[0]): k for e, k in counts.items() if k})
            tm, tp = f.envelope(length)
            if (np.abs(np.array(mass[:length]) - tm) <= step_tol).all() and (np.abs(share - tp) <= p_tol).all():
                return length
    return 0


# ---------------------------------------------------------------- columns


def _or_none(f, x):
    try:
        return f(x) if x is not None else None
    except (InvalidFormula, InvalidIsotope, ValueError):
        return None


@F.pandas_udf(T.DoubleType())
def _mass(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _or_none(lambda v: Formula.parse(v).mass, x)).astype("float64")


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _or_none(lambda v: str(Formula.parse(v)), x))


def mass_column(formula: Column) -> Column:
    """Exact mass of a formula; NULL for what is none."""
    return _mass(formula)


def canonical_column(formula: Column) -> Column:
    """Regular writing of a formula; NULL for what is none."""
    return _canonical(formula)


def envelope_column(formula: Column, length: int = 5) -> Column:
    """Array of (mass, p) of a formula's isotopic envelope."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mass", T.DoubleType()), T.StructField("p", T.DoubleType())])))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: _or_none(lambda v: [{"mass": float(m), "p": float(q)} for m, q in zip(*Formula.parse(v).envelope(length))], x))

    return run(formula)


def formulas_column(mass: Column, tol: float, bounds: dict[str, tuple[int, int]], most: int | None = 20) -> Column:
    """Array of formulas for each mass, nearest first; all of them if ``most`` is None."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else [str(Formula({(e, isotope(e)[0]): n for e, n in c.items() if n})) for _, c in formulas(x, tol, bounds, most)])

    return run(mass)
