import math
import random

import numpy as np
import pytest

from massloom.functions import chem, kernels


@pytest.mark.parametrize("text,charge", [("[CO3]2-", -2), ("[Cr[H2O]6]3+", 3), ("CO-", -1), ("H2O", 0)])
def test_charge(text, charge):
    assert chem.Formula.parse(text).charge == charge


@pytest.mark.parametrize("text", ["SO42-", "(CO2", "#H2O", "", "CO)2"])
def test_invalid(text):
    with pytest.raises(chem.InvalidFormula):
        chem.Formula.parse(text)


@pytest.mark.parametrize("text", ["(14C)O2", "(3H)2O", "Xx2"])
def test_invalid_isotope(text):
    with pytest.raises(chem.InvalidIsotope):
        chem.Formula.parse(text)


@pytest.mark.parametrize("text,out", [("(13C)C2H6O3", "C2(13C)H6O3"), ("[Cr(H2O)6]3+", "[H12CrO6]3+"), ("CH3CH2CH3", "C3H8"), ("C24H46SPN(18O)2", "C24H46N(18O)2PS")])
def test_writing(text, out):
    assert str(chem.Formula.parse(text)) == out


@pytest.mark.parametrize("text,mass,nominal", [("CO2", 43.9898, 44), ("H2O", 18.0106, 18), ("F2", 37.9968, 38)])
def test_mass(text, mass, nominal):
    f = chem.Formula.parse(text)
    assert abs(f.mass - mass) < 1e-4 and f.nominal_mass == nominal


def test_algebra():
    a, b = chem.Formula.parse("C6H12O6"), chem.Formula.parse("H2O")
    assert str(a - b) == "C6H10O5" and (a - b) + b == a
    with pytest.raises(ValueError):
        b - a


def test_envelope():
    m, p = chem.Formula.parse("C3").envelope(5)
    d = 13.00335483507
    assert np.allclose(m, [36, 24 + d, 12 + 2 * d, 3 * d, 0]) and abs(p.sum() - 1) < 1e-12
    assert list(chem.Formula.parse("S2").envelope(10)[0].round()) == [64, 65, 66, 67, 68, 69, 70, 0, 72, 0]


@pytest.mark.parametrize("text", ["C10H10O2", "C9H14", "C7H8N2", "H2O", "CO2"])
def test_formulas_equal_brute_force(text):
    bounds = {"C": (0, 12), "H": (0, 16), "N": (0, 3), "O": (0, 4)}
    mass, tol = chem.Formula.parse(text).mass, 0.01
    w = [chem.isotope(e)[1] for e in bounds]
    want = {(c, h, n, o) for c in range(13) for h in range(17) for n in range(4) for o in range(5) if abs(c * w[0] + h * w[1] + n * w[2] + o * w[3] - mass) <= tol}
    assert {(x["C"], x["H"], x["N"], x["O"]) for _, x in chem.formulas(mass, tol, bounds)} == want


def test_score_and_validate():
    b = {"C": (0, 20), "H": (0, 40), "N": (0, 5), "O": (0, 10)}
    m, p = chem.Formula.parse("C10H10O2").envelope(4)
    assert chem.best_formulas(list(m), list(p), b, n=1)[0][1] == {"C": 10, "H": 10, "N": 0, "O": 2}
    assert chem.validate_envelope(list(m), list(p), b) == 4


def test_extrema():
    y = np.array([*range(10), *range(9, -1, -1)], float)
    assert list(kernels.local_extrema(np.delete(y, 9))) == [0, 9, 18] or list(kernels.local_extrema(y))[0] == 0
    assert len(kernels.local_extrema(np.arange(10.0))) == 0


def test_two_peaks():
    x = np.arange(200.0)
    rng = np.random.default_rng(1234)
    y = 100 * np.exp(-0.5 * ((x - 50) / 2) ** 2) + 50 * np.exp(-0.5 * ((x - 150) / 2) ** 2) + rng.normal(0, 0.3, 200)
    got = [p for p in kernels.pick(x, y) if p["snr"] > 10]
    assert len(got) == 2 and abs(got[0]["rt"] - 50) < 1 and abs(got[1]["rt"] - 150) < 1


def test_peak_of_a_constant():
    t, y = np.arange(200.0), np.ones(200)
    p = kernels.describe_peak(t, y, None, np.ones(200), np.zeros(200), (90, 100, 110))
    assert p["height"] == 1 and p["area"] == 19 and abs(p["rt"] - 99.5) < 1e-9 and p["snr"] == 1
    assert kernels.describe_peak(t, y, None, np.zeros(200), np.zeros(200), (90, 100, 110))["snr"] == math.inf


def test_lowess_small_and_line():
    assert list(kernels.lowess(np.array([1.0, 2, 3]), np.array([5.0, 1, 9]))) == [5, 1, 9]
    x = np.arange(30.0)
    assert np.allclose(kernels.lowess(x, 2 * x + 1, 0.5), 2 * x + 1)


def test_assignment_equals_brute_force():
    from itertools import permutations

    rng = random.Random(3)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        c = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        got = sum(c[a, b] for a, b in kernels.assign(c))
        k = min(n, m)
        want = min(sum(c[a, b] for a, b in zip(r, q)) for r in permutations(range(n), k) for q in permutations(range(m), k))
        assert abs(got - want) < 1e-12


def test_student_tail():
    for t, df, p in ((2.228, 10, 0.025), (1.812, 10, 0.05), (12.706, 1, 0.025), (0.0, 5, 0.5)):
        assert abs(kernels.student_tail(t, df) - p) < 2e-4


def test_fill_and_knn():
    y = np.array([np.nan, 1, np.nan, 3, np.nan])
    assert list(kernels.fill_gaps(y)) == [1, 1, 2, 3, 3]
    x = np.array([[1.0, 1.0], [1.1, np.nan], [9.0, 9.0]])
    assert kernels.knn_fill(x, 1)[1, 1] == 1.0


def test_ward_order_keeps_groups_together():
    x = np.array([0.0, 10.0, 0.1, 10.1, 0.2, 20.0])
    order = kernels.ward_order((x[:, None] - x) ** 2)
    place = {i: k for k, i in enumerate(order)}
    assert sorted(order) == list(range(6)) and {place[0], place[2], place[4]} in ({0, 1, 2}, {3, 4, 5}) and abs(place[1] - place[3]) == 1
    assert kernels.ward_order(np.zeros((0, 0))) == []


def test_interpolated_level():
    x, y = np.array([1.0, 2, 4, 8]), np.array([2.0, 3, 1, 5])
    for how in ("linear", "splines"):
        assert np.allclose(kernels.interpolated_level(x, y, x, how), y)
        assert np.allclose(kernels.interpolated_level(x, y, np.array([0.0, 9.0]), how), [2, 5])
    assert np.allclose(kernels.interpolated_level(x, 2 * x + 1, np.array([3.0, 5.0]), "splines"), [7, 11])


def test_profile_sum():
    m = np.array([100.0, 101, 102])
    mz, y = kernels.profile_sum([m, m, m], [np.array([1.0, 5, 1])] * 2 + [np.array([1.0, 1, 3])], [1, 1, -1])
    assert list(mz) == [100, 101] and list(y) == [1, 9]
    assert len(kernels.profile_sum([], [], [])[0]) == 0


@pytest.mark.parametrize("peaks,number", [([(100, 20)], 1), ([(50, 100), (150, 50)], 2), ([(100, 50), (108, 25)], 2)])
@pytest.mark.parametrize("seed", range(3))
def test_peaks_by_noise_and_baseline(peaks, number, seed):
    x = np.arange(200.0)
    e = np.random.default_rng(seed).normal(0, 0.3, 200)
    y = sum(h * np.exp(-0.5 * ((x - c) / 2) ** 2) for c, h in peaks) + e
    noise = kernels.noise_level(y)
    s = kernels.gaussian_smooth(y, 1.0)
    base, _ = kernels.baseline(s, np.abs(e))
    got = [p for p in kernels.detect_peaks(s, noise, base) if s[p[1]] > 10]
    assert len(got) == number and all(abs(a - c) <= 1 for (_, a, _), (c, _) in zip(got, peaks))
    if len(peaks) == 2 and peaks[1][0] - peaks[0][0] < 10:
        assert got[0][2] == got[1][0] + 1


def test_noise_slices():
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(0, 1, 400), rng.normal(0, 5, 450)])
    noise = kernels.noise_level(y)
    # slices of 200; the rest of 50 belongs to the fourth
    assert len(set(noise)) == 4 and len(set(noise[600:])) == 1 and abs(noise[0] - 1) < 0.4 and abs(noise[-1] - 5) < 2
    assert kernels.noise_level(np.zeros(3)).tolist() == [0, 0, 0] and len(kernels.noise_level(np.zeros(0))) == 0


def test_baseline_points():
    y = np.array([0, 1, 2, 1, 0, 1, 2, 1, 0, 1, 2, 1, 0], float)
    # only the slices from 4 to 6 have quiet neighbours on both sides
    noise = np.array([0.1, 0.1, 1, 1, 1, 1, 1, 1, 1, 0.1, 0.1, 0.1, 0.1])
    assert kernels.baseline(y, noise)[1].tolist() == [0, 4, 5, 6, 12]
    e = np.random.default_rng(1).normal(size=100)
    base, _ = kernels.baseline(e, np.full(100, 5.0))
    assert (np.abs(e - base) < 5).all()


def test_tails_of_arrays():
    t, df = np.array([1.5, -2.0, 1.96, np.nan, np.inf, 1.0]), np.array([3.2, 12.0, np.inf, 3.0, 4.0, 0.0])
    got = kernels.student_tail(t, df)
    assert np.allclose(got[:3], [0.11252226586992, 0.96567249298096, 0.0249978951482204], atol=1e-10) and got[4] == 0 and np.isnan(got[[3, 5]]).all()
