"""SQL for results of this subpackage: the rule that matches must obey, and clusters as plain components."""

from __future__ import annotations

from massloom.llm import matching
from massloom.plans import unit_sql


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _bare(c: str) -> str:
    return f"trim(regexp_replace({c}, {_q(matching._AROUND)}, '', 'g'))"


_END = "(?:[^a-z0-9]|$)"
_NAMED = r"^([a-z0-9]*[a-z]{2}[a-z0-9]*?)0*(\d{1,6})$"


def _parts(name: str, source: str, label: str, *keep: str) -> str:
    """number, letters, batch and injection of a label; nothing may follow a number but what isn't a letter or digit."""
    k = ", ".join(keep)
    return f"""{name}_a AS (SELECT {k}, {_bare(_bare(f"lower(trim({label}))"))} AS t0 FROM {source}),
    {name}_b AS (SELECT {k}, CASE WHEN NOT regexp_matches(t0, {_q(matching._NO_NAME)}) THEN t0 END AS t FROM {name}_a),
    {name}_c AS (SELECT *, regexp_extract(t, {_q(r"(?:^|[^a-z0-9])b(?:atch)?[\s_]*0*(\d{1,3})" + _END)}, 1) AS b, regexp_extract(t, {_q(r"(?:^|[^a-z])(?:injection|inj|run|s)[\s_]*0*(\d{1,5})" + _END)}, 1) AS i,
           regexp_extract(t, {_q(r"(?:^|[\s_.\-/,])0*(\d{1,3})[\s_.\-/,]+batch[\s_]*\d")}, 1) AS bare, regexp_replace(t, {_q(r"(?:^|[^a-z0-9])b(?:atch)?[\s_]*\d{1,3}([^a-z0-9]|$)")}, ' \\1', 'g') AS r0 FROM {name}_b),
    {name}_d AS (SELECT *, trim(regexp_replace(r0, {_q(r"(^|[^a-z])(?:injection|inj|run|s)[\s_]*\d{1,5}([^a-z0-9]|$)")}, '\\1 \\2', 'g')) AS rest FROM {name}_c),
    {name}_e AS (SELECT *, regexp_extract(rest, {_q(r"([a-z0-9]*[a-z]{2}[a-z0-9]*?0*\d{1,6})" + _END)}, 1) AS m, regexp_extract(rest, {_q(r"^0*(\d{1,6})" + _END)}, 1) AS lone, len(regexp_extract_all(rest, '[0-9]+')) AS runs FROM {name}_d),
    {name}_f AS (SELECT *, regexp_extract(m, {_q(_NAMED)}, 1) AS l0, regexp_extract(m, {_q(_NAMED)}, 2) AS n0 FROM {name}_e),
    {name}_g AS (SELECT *, CASE WHEN l0 <> '' THEN l0 ELSE regexp_extract(rest, {_q(r"^[^a-z0-9]*([a-z]{4,})[^a-z0-9]*$")}, 1) END AS l1 FROM {name}_f),
    {name} AS (SELECT {k}, try_cast(CASE WHEN n0 <> '' THEN n0 WHEN lone <> '' AND runs > CASE WHEN bare <> '' THEN 1 ELSE 0 END THEN lone END AS BIGINT) AS number,
           CASE WHEN l1 <> '' AND l1 NOT IN ('batch', 'inj', 'injection', 'run', 'sample') THEN l1 END AS letters, try_cast(b AS BIGINT) AS batch, coalesce(try_cast(i AS BIGINT), try_cast(bare AS BIGINT)) AS injection FROM {name}_g)"""


def _polarity(c: str) -> str:
    t = f"lower(trim(CAST({c} AS VARCHAR)))"
    return f"CASE WHEN regexp_full_match({t}, {_q('[+]|1|[+]1|pos.*|esi ?[(]?[+][)]?|p')}) THEN 1 WHEN regexp_full_match({t}, {_q('-|-1|neg.*|esi ?[(]?-[)]?|n')}) THEN -1 END"


#: no ranking: a pair is a match if it fits, its label agrees, and no other injection (study) does so
MATCHES = f"""WITH {unit_sql.FEATURES}, smp AS (SELECT sample_id, min(trim(sample)) AS sample FROM sample_metadata WHERE sample_id IS NOT NULL GROUP BY 1), {_parts("nm", "smp", "sample", "sample_id")},
    dc AS (SELECT DISTINCT f.feature_id, f.study, f.top_sample_id, {_polarity("f.polarity")} AS pol, f.mz, fu.rt_sec, nm.number, nm.letters, nm.batch, nm.injection FROM feature_metadata f JOIN fu ON fu.feature_id = f.feature_id LEFT JOIN nm ON nm.sample_id = f.top_sample_id
           WHERE isfinite(f.mz) AND fu.rt_sec IS NOT NULL),
    {_parts("lb", "partner_features", "sample_label", "partner_id", "mz", "rt_sec", "polarity")},
    rp AS (SELECT DISTINCT partner_id, mz, rt_sec, {_polarity("polarity")} AS pol, number, letters, batch, injection, (number IS NOT NULL)::INT + (letters IS NOT NULL)::INT + (batch IS NOT NULL)::INT + (injection IS NOT NULL)::INT AS given FROM lb WHERE partner_id IS NOT NULL AND isfinite(mz) AND isfinite(rt_sec)),
    pr AS (SELECT r.partner_id, d.feature_id, d.study, d.top_sample_id, r.given, coalesce(r.number = d.number, r.number IS NULL) AND coalesce(r.batch = d.batch, r.batch IS NULL) AND coalesce(r.injection = d.injection, r.injection IS NULL)
           AND (r.letters IS NULL OR levenshtein(translate(r.letters, '01', 'oi'), coalesce(d.letters, '')) <= {matching.LETTER_EDITS}) AS agrees
           FROM rp r JOIN dc d ON round(abs(d.mz - r.mz), 9) < {matching.MZ_TOL} AND round(abs(d.rt_sec - r.rt_sec), 9) <= {matching.RT_TOL} AND (r.pol IS NULL OR d.pol IS NULL OR r.pol = d.pol)),
    sd AS (SELECT partner_id, count(DISTINCT coalesce(study, '')) AS studies, count(DISTINCT CASE WHEN agrees THEN top_sample_id END) AS injections FROM pr GROUP BY 1)"""
SQL = {
    "p1_found": f"{MATCHES} SELECT pr.feature_id, pr.partner_id FROM pr JOIN sd ON sd.partner_id = pr.partner_id WHERE CASE WHEN given = 0 THEN studies = 1 ELSE agrees AND injections = 1 END",
    "p4_found": f"{unit_sql.IONS} SELECT cluster_id, k AS feature_id FROM cl QUALIFY count(*) OVER (PARTITION BY cluster_id) > 1",
    "p4_clusters": f"""{unit_sql.IONS}, me AS (SELECT cluster_id, cl.k, mz AS x, rt_sec AS y, avg(mz) OVER w AS cx, avg(rt_sec) OVER w AS cy, stddev_pop(mz) OVER w AS sx, stddev_pop(rt_sec) OVER w AS sy, count(*) OVER w AS n FROM cl JOIN pt ON pt.k = cl.k WINDOW w AS (PARTITION BY cluster_id)),
        ds AS (SELECT *, round(coalesce(pow((x - cx) / nullif(sx, 0), 2), 0) + coalesce(pow((y - cy) / nullif(sy, 0), 2), 0), 6) AS d FROM me WHERE n > 1)
        SELECT cluster_id, count(*) AS size, round(avg(x) + 1e-9, 6) AS x, round(avg(y) + 1e-7, 4) AS y, list(k ORDER BY d, k)[:3] AS typical FROM ds GROUP BY 1""",
}
