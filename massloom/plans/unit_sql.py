"""SQL for the queries that depend on units: the same residuals, summed over a table of the units."""

from __future__ import annotations

import math

from massloom.operators import units

_UNITS = ", ".join(f"('{u}', CAST({s} AS DOUBLE), {i})" for i, (u, s) in enumerate(units.UNITS.items()))
_QUOTED = units._QUOTED + r"(millisec[a-z]*|msec|ms|seconds?|sec|s|minutes?|mins?|hours?|h)\b"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def spelled(c: str) -> str:
    word = f"regexp_replace(lower(trim({c})), {_q(r'[.\[\]() ]')}, '', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_full_match({word}, {_q(names)}) THEN '{u}'" for u, names in units.SPELLED.items()) + " END"


def said(c: str) -> str:
    """Unit that a text states for the axis; a letter or digit beside the unit's name is excluded by what may stand there."""
    text = f"regexp_replace(lower({c}), {_q(r'not (?:in )?[a-z]+|the list says [a-z]+,?')}, ' ', 'g')"
    text = f"regexp_replace({text}, {_q(r'[0-9.]+\s*(?:milliseconds?|msec|ms|seconds?|sec|s|minutes?|mins?|hours?|hr|h|c|ul|µl)\b')}, ' ', 'g')"
    whens = []
    for u in ("ms", "min", "h", "s"):
        n = units.SPELLED[u]
        pattern = rf"{units._AXIS_BEFORE}(?:{n})(?:[^a-z]|$)|(?:^|[^a-z0-9])(?:{n}){units._AXIS_AFTER}"
        whens.append(f"WHEN regexp_matches({text}, {_q(pattern)}) THEN '{u}'")
    return "CASE " + " ".join(whens) + " END"


def _sq(ratio: str, sigma: float) -> str:
    return f"CASE WHEN {ratio} > 0 THEN pow(ln({ratio}) / {math.log(sigma)!r}, 2) END"


def _claim(c: str, cost: float) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {c} <> unit THEN {cost} ELSE 0 END"


def _written(c: str) -> str:
    one = lambda k: f"abs({c} * 1e{k} - round({c} * 1e{k})) <= 1e-5 + abs({c}) * 1e{k - 12}"
    return f"CASE WHEN {one(0)} THEN 0 WHEN {one(3)} THEN 3 WHEN {one(5)} THEN 5 ELSE 7 END"


FEATURES = f"""un AS (SELECT * FROM (VALUES {_UNITS}) AS v(unit, sec, i)),
    st AS (SELECT study, max(run_seconds) AS run, max({said("note")}) AS note FROM study WHERE study IS NOT NULL GROUP BY 1),
    fa AS (SELECT f.*, st.run, st.note, {spelled("rt_unit")} AS declared, {said("remark")} AS said, try_cast(regexp_extract(lower(remark), {_q(_QUOTED)}, 1) AS DOUBLE) AS quoted, {spelled(f"regexp_extract(lower(remark), {_q(_QUOTED)}, 2)")} AS quoted_unit,
           CASE WHEN isfinite(rt) AND rt > 0 THEN rt END AS r, CASE WHEN isfinite(rt_start) AND isfinite(rt_end) AND rt_end > rt_start THEN rt_end - rt_start END AS w FROM feature_metadata f LEFT JOIN st ON st.study = f.study),
    fb AS (SELECT fa.*, quoted * q.sec AS quoted_s, {_written("r")} AS dec FROM fa LEFT JOIN un q ON q.unit = quoted_unit),
    fc AS (SELECT feature_id, study, r, dec, unit, i, {_claim("declared", 11.0)} + {_claim("said", 12.0)} + {_claim("note", 12.0)} + CASE WHEN quoted_s IS NOT NULL THEN coalesce(least({_sq("r * sec / quoted_s", 1.1)}, 16), 16) ELSE 0 END
           + CASE WHEN r * sec > run * 1.02 THEN 30 ELSE 0 END + CASE WHEN r * sec < {units.DEAD_TIME_S} THEN 20 ELSE 0 END + coalesce({_sq(f"w * sec / {units.PEAK_WIDTH_S}", 3.0)}, 0) AS cost FROM fb CROSS JOIN un),
    fd AS (SELECT *, row_number() OVER b AS k, lead(cost) OVER b - cost AS margin FROM fc WINDOW b AS (PARTITION BY feature_id ORDER BY cost, i)),
    alike AS (SELECT study, dec, unit, count(*) AS n FROM fd WHERE k = 1 AND r IS NOT NULL AND margin >= {units.FIRM_MARGIN} GROUP BY 1, 2, 3),
    ofd AS (SELECT study, dec, sum(n) AS n FROM alike GROUP BY 1, 2), ofu AS (SELECT study, unit, sum(n) AS n FROM alike GROUP BY 1, 2), ofs AS (SELECT study, sum(n) AS n FROM alike GROUP BY 1),
    fe AS (SELECT c.feature_id, c.unit, c.i, c.cost - 2 * ln((coalesce(a.n, 0) + 0.8 * (coalesce(u.n, 0) + 0.2) / (coalesce(s.n, 0) + 0.8)) / (coalesce(d.n, 0) + 0.8)) AS cost FROM fc c
           LEFT JOIN alike a ON a.study = c.study AND a.dec = c.dec AND a.unit = c.unit LEFT JOIN ofu u ON u.study = c.study AND u.unit = c.unit LEFT JOIN ofs s ON s.study = c.study LEFT JOIN ofd d ON d.study = c.study AND d.dec = c.dec),
    ff AS (SELECT feature_id, unit, row_number() OVER b AS k, lead(cost) OVER b - cost AS margin FROM fe WINDOW b AS (PARTITION BY feature_id ORDER BY cost, i)),
    fu AS (SELECT f.feature_id, f.polarity, f.mz, f.rt, CASE WHEN isfinite(rt) THEN ff.unit END AS unit, CASE WHEN isfinite(rt) THEN margin >= {units.UNIQUE_MARGIN} END AS unit_unique, CASE WHEN isfinite(rt) THEN round(rt * un.sec, 6) END AS rt_sec,
           CASE WHEN isfinite(rt_start) AND isfinite(rt) THEN round(rt_start * un.sec, 6) END AS rt_start_sec, CASE WHEN isfinite(rt_end) AND isfinite(rt) THEN round(rt_end * un.sec, 6) END AS rt_end_sec
           FROM feature_metadata f JOIN ff ON ff.feature_id = f.feature_id AND ff.k = 1 JOIN un ON un.unit = ff.unit)"""
_CLOCK = _sq("ratio * a.sec / b.sec", units.CLOCK_FACTOR)
_STEP = _sq("step * sec / sqrt(grid)", 5.0)
TRACES = f"""un AS (SELECT * FROM (VALUES {_UNITS}) AS v(unit, sec, i)),
    rd AS (SELECT trace_id, scan, time, spint, {spelled("time_unit")} AS declared, {_written("time")} AS dec FROM chromatogram WHERE isfinite(time)),
    ga AS (SELECT trace_id, declared, dec, count(*) AS n, min(time) AS t0, max(time) AS t1, min(scan) AS s0, max(scan) AS s1, avg(time) AS mt, avg(scan) AS ms FROM rd GROUP BY 1, 2, 3),
    gl AS (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, dec DESC, t0 DESC, t1 DESC) = 1),
    tr AS (SELECT trace_id, max(grid_seconds) AS grid, max({said("note")}) AS note FROM trace GROUP BY 1),
    gb AS (SELECT ga.*, grid, note, (ga.t1 - ga.t0) / nullif(ga.s1 - ga.s0, 0) AS step, gl.t0 + (gl.t1 - gl.t0) / nullif(gl.s1 - gl.s0, 0) * (ga.ms - gl.s0) AS shown FROM ga JOIN gl ON gl.trace_id = ga.trace_id LEFT JOIN tr ON tr.trace_id = ga.trace_id),
    gc AS (SELECT *, CASE WHEN shown > 0 AND mt > 0 THEN mt / shown END AS ratio FROM gb),
    gd AS (SELECT gc.*, unit, sec, i, {_claim("declared", 10.0)} + CASE WHEN declared IS NULL THEN {_claim("note", 7.0)} ELSE 0 END + CASE WHEN t1 * sec < {units.DEAD_TIME_S} THEN 12 ELSE 0 END
           + coalesce(least({_STEP}, CASE WHEN step * sec > sqrt(grid) THEN 9 ELSE 16 END), CASE WHEN step * sec > sqrt(grid) THEN 9 ELSE 16 END) AS own FROM gc CROSS JOIN un),
    ge AS (SELECT a.trace_id, a.declared, a.dec, a.n, a.s1, a.unit, a.i, b.unit AS lead, b.i AS j, own + coalesce(least({_CLOCK}, 30), 30) AS cost FROM gd a CROSS JOIN un b),
    gf AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w - cost AS margin FROM ge WINDOW w AS (PARTITION BY trace_id, declared, dec, j ORDER BY cost, i)),
    gt AS (SELECT trace_id, j, sum(cost) AS total FROM gf WHERE k = 1 GROUP BY 1, 2), gr AS (SELECT trace_id, j, row_number() OVER w AS place, lead(total) OVER w - total AS whole FROM gt WINDOW w AS (PARTITION BY trace_id ORDER BY total, j)),
    gu AS (SELECT x.trace_id, x.declared, x.dec, x.n, x.s1, x.unit, least(x.margin, CASE WHEN x.unit <> y.unit THEN p.whole END) AS margin FROM gf x JOIN gr p ON p.trace_id = x.trace_id AND p.j = x.j AND p.place = 1
           JOIN gr q ON q.trace_id = x.trace_id AND q.place = 2 JOIN gf y ON y.trace_id = x.trace_id AND y.declared IS NOT DISTINCT FROM x.declared AND y.dec = x.dec AND y.j = q.j AND y.k = 1 WHERE x.k = 1)"""
_PERIODS = f"""{TRACES},
    ra AS (SELECT DISTINCT rd.trace_id, scan, round(time * un.sec, 6) AS t, spint AS y, grid FROM rd JOIN gu ON gu.trace_id = rd.trace_id AND gu.declared IS NOT DISTINCT FROM rd.declared AND gu.dec = rd.dec JOIN un ON un.unit = gu.unit JOIN tr ON tr.trace_id = rd.trace_id
           WHERE isfinite(spint) AND spint >= 0 AND grid > 0),
    pa AS (SELECT trace_id, grid, CAST(floor(t / grid) AS BIGINT) AS k, count(*) AS n, sum(y) AS total, min({{'t': t, 'y': y}}) AS lo, max({{'t': t, 'y': y}}) AS hi FROM ra GROUP BY 1, 2, 3),
    pb AS (SELECT *, lead(k) OVER w AS nk, lead(lo) OVER w AS nlo FROM pa WINDOW w AS (PARTITION BY trace_id ORDER BY k)),
    pe AS (SELECT trace_id, grid, unnest(range(k + 1, nk)) AS k, hi.t AS ta, hi.y AS ya, nlo.t AS tb, nlo.y AS yb FROM pb WHERE nk > k + 1)"""
SQL: dict[str, str] = {
    "p5_features": f"WITH {FEATURES} SELECT feature_id, rt, unit, unit_unique, rt_sec, rt_start_sec, rt_end_sec FROM fu",
    "p5_traces": f"WITH {TRACES} SELECT trace_id, coalesce(declared, '?') || '|' || dec AS class, n, s1 AS last_scan, unit, round(margin, 4) AS unit_margin, margin >= {units.UNIQUE_MARGIN} AS unit_unique FROM gu",
    "p5_found": f"WITH {FEATURES}, {TRACES[TRACES.index('rd AS'):]} SELECT 'feature_metadata' AS table_name, feature_id AS record_id FROM fu WHERE unit <> 's' UNION ALL SELECT DISTINCT 'chromatogram', trace_id FROM gu WHERE unit <> 's'",
    "p5_readings": f"""WITH {TRACES} SELECT c.trace_id, c.scan, c.time, CASE WHEN isfinite(c.time) THEN round(c.time * un.sec, 6) END AS time_sec FROM chromatogram c
        LEFT JOIN gu ON gu.trace_id = c.trace_id AND gu.declared IS NOT DISTINCT FROM {spelled("c.time_unit")} AND gu.dec = {_written("c.time")} LEFT JOIN un ON un.unit = gu.unit""",
    "p2_found": f"WITH {_PERIODS} SELECT trace_id, k AS period_no FROM pe",
    "p2_series": f"""WITH {_PERIODS} SELECT trace_id, k AS period_no, CAST(k * grid AS DOUBLE) AS t_sec, n AS n_readings, round(total / n + 1e-8, 5) AS value, 'observed' AS state FROM pa
        UNION ALL SELECT trace_id, k, CAST(k * grid AS DOUBLE), 0, CASE WHEN tb - ta <= 5 * grid THEN round(ya + (yb - ya) * ((k + 0.5) * grid - ta) / (tb - ta) + 1e-8, 5) END, CASE WHEN tb - ta <= 5 * grid THEN 'interpolated' ELSE 'missing' END FROM pe""",
}
#: clusters by plain components: right as long as none is so wide that it has to be split
IONS = f"""WITH RECURSIVE {FEATURES}, pt AS (SELECT feature_id AS k, polarity, mz, rt_sec FROM fu WHERE isfinite(mz) AND rt_sec IS NOT NULL AND polarity IS NOT NULL),
    ed AS (SELECT x.k AS a, y.k AS b FROM pt x JOIN pt y ON x.polarity = y.polarity AND abs(x.mz - y.mz) <= 0.015 + 1e-9 AND abs(x.rt_sec - y.rt_sec) <= 15 + 1e-9),
    walk(k, root) AS (SELECT k, k FROM pt UNION SELECT ed.b, walk.root FROM walk JOIN ed ON ed.a = walk.k), cl AS (SELECT k, min(root) AS cluster_id FROM walk GROUP BY 1)"""
