"""Matching records across sources without a common key.

Reports of ions (a mass, a retention, a polarity and a label in the reporter's own
writing) are matched with features by retrieval. Features are the documents of an
inverted index over all their attributes: cells of mass and retention, polarity, and
the parts of the injection's name (study, batch, injection). A report is the query, and
BM25 ranks the injections whose features fit it (studies, if its label names nothing).

Only the posting list of a query's rarest part is read, cell by cell. A document
outside of it lacks that part, so its score has an upper bound, the floor; the best of
the list is the best of all as soon as it exceeds the floor, which prunes exactly. What
a report is matched with is the best injection, if it is better than the runner-up and
the floor; the gap to them, and whether the feature's best report of that laboratory is
this one in turn, give a confidence by a logistic curve. The curve is calibrated on
reports with complete labels of which parts are hidden. An exact check of the label ends it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.units import is_number
from massloom.session import cut

MZ_TOL = 0.02
RT_TOL = 15.0
#: saturation and length parameters of BM25
K1, B = 1.2, 0.75
#: letters of a name may differ by so many edits, where the number agrees or is absent
LETTER_EDITS = 3
#: reports with complete labels on which confidence is calibrated, at most
CALIBRATION_REPORTS = 2000

#: fixed values: what is written around a name
_AROUND = r"copy of |smp:|sample:|^[a-z]:\\(?:[a-z]+\\)*|^/(?:[a-z]+/)+|\.(?:mzxml|mzml|raw|wiff|d)$|_rerun$|_reinj$|\s*\(\d+\)$"
_NO_NAME = r"^(?:|unknown|not given|n/?a|none|null|nan|\?+|-+|\.)$"


def polarity_of(c: Column) -> Column:
    """1, -1 or NULL from any writing."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.rlike(r"^(?:\+|1|\+1|pos.*|esi ?\(?\+\)?|p)$"), 1).when(t.rlike(r"^(?:-|-1|neg.*|esi ?\(?-\)?|n)$"), -1)


PARTS = ("number", "letters", "batch", "injection")


def with_name_parts(df: DataFrame, label: str, prefix: str = "") -> DataFrame:
    """Adds number, letters, batch and injection of a label; all NULL if it names nothing.

    Order, separators, case, leading zeros, folders and endings don't matter. Each step
    is a column of its own, so that no pattern is planned or run more than once.
    """
    blank = lambda c: F.when(c != "", c)
    d = df.withColumn("_t", F.lower(F.trim(F.col(label).cast("string"))))
    for _ in range(2):
        d = d.withColumn("_t", F.trim(F.regexp_replace("_t", _AROUND, "")))
    d = d.withColumn("_t", F.when(F.col("_t").rlike(_NO_NAME), F.lit(None)).otherwise(F.col("_t")))
    d = d.withColumn("_batch", F.regexp_extract("_t", r"(?:^|[^a-z0-9])b(?:atch)?[\s_]*0*(\d{1,3})(?![a-z0-9])", 1))
    d = d.withColumn("_inj", F.regexp_extract("_t", r"(?:^|[^a-z])(?:injection|inj|run|s)[\s_]*0*(\d{1,5})(?![a-z0-9])", 1))
    # a bare number right before the batch is the injection
    d = d.withColumn("_bare", F.regexp_extract("_t", r"(?:^|[\s_.\-/,])0*(\d{1,3})[\s_.\-/,]+batch[\s_]*\d", 1))
    d = d.withColumn("_rest", F.regexp_replace("_t", r"(?:^|[^a-z0-9])b(?:atch)?[\s_]*\d{1,3}(?![a-z0-9])", " "))
    d = d.withColumn("_rest", F.trim(F.regexp_replace("_rest", r"(?:^|(?<=[^a-z]))(?:injection|inj|run|s)[\s_]*\d{1,5}(?![a-z0-9])", " ")))
    d = d.withColumn("_m", F.regexp_extract("_rest", r"([a-z0-9]*[a-z]{2}[a-z0-9]*?)0*(\d{1,6})(?![a-z0-9])", 0))
    d = d.withColumn("_letters", F.regexp_extract("_m", r"^([a-z0-9]*[a-z]{2}[a-z0-9]*?)0*(\d{1,6})$", 1)).withColumn("_number", F.regexp_extract("_m", r"^([a-z0-9]*[a-z]{2}[a-z0-9]*?)0*(\d{1,6})$", 2))
    # without letters, the first number is the study's unless it is the bare injection
    d = d.withColumn("_lone", F.regexp_extract("_rest", r"^0*(\d{1,6})(?![a-z0-9])", 1)).withColumn("_count", F.size(F.regexp_extract_all("_rest", F.lit(r"(\d+)"))))
    # a single word is letters without a number
    d = d.withColumn("_letters", F.when(F.col("_letters") != "", F.col("_letters")).otherwise(F.regexp_extract("_rest", r"^[^a-z0-9]*([a-z]{4,})[^a-z0-9]*$", 1)))
    own = F.when(F.col("_number") != "", F.col("_number")).when((F.col("_lone") != "") & (F.col("_count") > F.when(F.col("_bare") != "", 1).otherwise(0)), F.col("_lone"))
    made = {
        "number": own.cast("long"),
        "letters": blank(F.when(F.col("_letters").rlike("^(?:batch|inj|injection|run|sample)$"), F.lit("")).otherwise(F.col("_letters"))),
        "batch": blank(F.col("_batch")).cast("long"),
        "injection": F.when(F.col("_inj") != "", F.col("_inj")).otherwise(blank(F.col("_bare"))).cast("long"),
    }
    keep = [c for c in df.columns if c not in {prefix + x for x in PARTS}]
    return d.select(*keep, *[made[x].alias(prefix + x) for x in PARTS])


def feature_documents(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Features with mass, retention in seconds, polarity and the parts of their injection's name.

    ``features`` comes with rt_sec. A feature without an id, a mass or a retention is no
    document; repeated rows are one.
    """
    named = samples.filter("sample_id is not null").groupBy(F.col("sample_id").alias("top_sample_id")).agg(F.min(F.trim("sample")).alias("_name"))
    names = with_name_parts(named, "_name").drop("_name")
    f = features.filter(F.col("feature_id").isNotNull() & is_number(F.col("mz")) & is_number(F.col("rt_sec")))
    f = f.select(F.col("feature_id").cast("bigint").alias("feature_id"), "study", F.col("mz").alias("f_mz"), F.col("rt_sec").alias("f_rt"), polarity_of(F.col("polarity")).alias("f_pol"), F.col("top_sample_id")).distinct()
    f = f.join(names, "top_sample_id", "left")
    return f.withColumn("ci", F.floor(F.col("f_mz") / MZ_TOL)).withColumn("cj", F.floor(F.col("f_rt") / RT_TOL))


def report_queries(reports: DataFrame) -> DataFrame:
    """Reports with mass, retention, polarity, label parts and what the label gives: full, part or none."""
    r = reports.filter(F.col("partner_id").isNotNull() & is_number(F.col("mz")) & is_number(F.col("rt_sec")))
    r = r.select(F.col("partner_id").cast("bigint").alias("partner_id"), F.col("mz").alias("r_mz"), F.col("rt_sec").alias("r_rt"), polarity_of(F.col("polarity")).alias("r_pol"), "lab", "sample_label").distinct()
    r = with_name_parts(r, "sample_label", "q_").drop("sample_label")
    given = [F.col(f"q_{x}").isNotNull() for x in PARTS]
    kind = F.when(reduce(lambda a, b: a & b, given), "full").when(reduce(lambda a, b: a | b, given), "part").otherwise("none")
    return r.withColumn("kind", kind)


def _around() -> Column:
    """The cells around a report's own one that hold all within tolerance."""
    side = lambda v, tol: F.sequence(F.floor((F.col(v) - tol) / tol), F.floor((F.col(v) + tol) / tol))
    return F.flatten(F.transform(side("r_mz", MZ_TOL), lambda a: F.transform(side("r_rt", RT_TOL), lambda b: F.struct(a.alias("ci"), b.alias("cj")))))


def _fits() -> Column:
    """Within tolerance in all attributes but the label; masses and retentions to a billionth."""
    mz = F.round(F.abs(F.col("f_mz") - F.col("r_mz")), 9) < MZ_TOL
    rt = F.round(F.abs(F.col("f_rt") - F.col("r_rt")), 9) <= RT_TOL
    return mz & rt & (F.col("r_pol").isNull() | F.col("f_pol").isNull() | (F.col("r_pol") == F.col("f_pol")))


def _edits() -> Column:
    """Edits between the label's letters and the name's, up to LETTER_EDITS; else -1. NULL if the label has none."""
    return F.when(F.col("q_letters").isNotNull(), F.levenshtein(F.translate(F.col("q_letters"), "01", "oi"), F.coalesce(F.col("letters"), F.lit("")), LETTER_EDITS))


def _has(part: str) -> Column:
    return F.coalesce(F.col(f"q_{part}") == F.col(part), F.lit(False))


def _agrees() -> Column:
    """Every part that the label gives is the injection's."""
    same = [F.col(f"q_{x}").isNull() | _has(x) for x in ("number", "batch", "injection")]
    return reduce(lambda a, b: a & b, same) & (F.col("q_letters").isNull() | (_edits() >= 0))


FEATURE = ["feature_id", "study", "f_mz", "f_rt", "f_pol", "top_sample_id", "number", "letters", "batch", "injection"]
#: the part of a label by whose posting list it is looked up, rarest first
LISTS = {"study": "q_number is not null", "place": "q_batch is not null and q_injection is not null", "letters": "q_letters is not null", "batch": "q_batch is not null", "injection": "q_injection is not null", "cell": "true"}


def _idf(df: Column) -> Column:
    return F.log(1.0 + (F.col("_docs") - df + 0.5) / (df + 0.5))


def with_weights(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Queries with the list they read, the weights (idf) of their terms and the bound for what isn't read.

    Counts are over all documents. The cells around a report are one term, so that all
    documents that fit have it alike; so is a polarity that one side doesn't know.
    """
    parts = [F.col(x).isNotNull().cast("int") for x in PARTS]
    n = documents.select(reduce(lambda a, b: a + b, parts).alias("_len")).agg(F.count(F.lit(1)).cast("double").alias("_docs"), F.avg(F.nullif("_len", F.lit(0))).alias("_avg"), F.min(F.nullif("_len", F.lit(0))).alias("_short"))
    q = queries.withColumn("list", reduce(lambda a, k: a.when(F.expr(LISTS[k]), k), list(LISTS)[1:], F.when(F.expr(LISTS["study"]), "study")))
    # one row, not a table that grows
    q = q.join(F.broadcast(n))
    for part, name in (("number", "study"), ("letters", "letters"), ("batch", "batch"), ("injection", "injection")):
        df = documents.groupBy(F.col(part).alias(f"q_{part}")).agg(F.count(F.lit(1)).alias("_df"))
        q = q.join(df, f"q_{part}", "left").withColumn(f"w_{name}", F.when(F.col(f"q_{part}").isNotNull(), _idf(F.coalesce("_df", F.lit(0)))).otherwise(0.0)).drop("_df")
    # the number, where there is one, stands for the letters as well
    q = q.withColumn("w_study", F.when(F.col("q_number").isNotNull(), F.col("w_study")).otherwise(F.col("w_letters"))).drop("w_letters")
    cell = documents.groupBy(F.col("ci").alias("_ci"), F.col("cj").alias("_cj")).agg(F.count(F.lit(1)).alias("_df"))
    q = q.withColumn("_ci", F.floor(F.col("r_mz") / MZ_TOL)).withColumn("_cj", F.floor(F.col("r_rt") / RT_TOL)).join(cell, ["_ci", "_cj"], "left")
    q = q.withColumn("w_cell", _idf(F.coalesce("_df", F.lit(0)))).drop("_df", "_ci", "_cj")
    most = _length_norm(F.col("_short"))
    lacks = {"study": F.col("w_batch") + F.col("w_injection"), "place": F.greatest("w_batch", "w_injection")}
    floor = F.when(F.col("kind") == "none", 0.0)
    for k in LISTS:
        floor = floor.when(F.col("list") == k, F.col("w_cell") + most * lacks.get(k, F.lit(0.0)))
    return q.withColumn("floor", F.coalesce(floor, F.lit(0.0)))


def _length_norm(length: Column) -> Column:
    """Weight of a term that occurs once in a name of so many parts."""
    return (K1 + 1.0) / (1.0 + K1 * (1.0 - B + B * F.coalesce(length / F.col("_avg"), F.lit(1.0))))


def _token(kind: Column, of: dict[str, list[str]], prefix: str = "") -> Column:
    out = F.lit("")
    for k, parts in of.items():
        out = F.when(kind == k, F.concat_ws("|", *[F.col(prefix + p).cast("string") for p in parts])).otherwise(out)
    return out


#: what a posting list is keyed by, beside the cell
KEYED = {"study": ["number"], "place": ["batch", "injection"], "batch": ["batch"], "injection": ["injection"]}


def _crowded(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Queries without those whose best is known to be tied.

    Every point of a report's own half cell is within tolerance. If two injections (or,
    for a label that names nothing, two studies) with the parts of the label are there,
    they tie at the highest score there is, so nothing can match.
    """
    half = lambda mz, rt: [F.floor(F.col(mz) / (MZ_TOL / 2)).alias("hi"), F.floor(F.col(rt) / (RT_TOL / 2)).alias("hj")]
    tied = lambda c: [(F.min(F.when(w, F.col(c))) != F.max(F.when(w, F.col(c)))).alias(n) for n, w in (("_any", F.lit(True)), ("_pos", F.coalesce(F.col("f_pol") == 1, F.lit(True))), ("_neg", F.coalesce(F.col("f_pol") == -1, F.lit(True))))]
    d = documents.select("study", "top_sample_id", "f_pol", "number", "batch", "injection", *half("f_mz", "f_rt"))
    none = d.groupBy("hi", "hj").agg(*tied("study")).withColumn("list", F.lit("cell")).withColumn("token", F.lit(""))
    lists = d.withColumn("list", F.explode(F.array(*[F.lit(x) for x in ("place", "batch", "injection")]))).withColumn("token", _token(F.col("list"), KEYED))
    some = lists.groupBy("hi", "hj", "list", "token").agg(*tied("top_sample_id"))
    q = queries.select("*", *half("r_mz", "r_rt")).withColumn("token", _token(F.col("list"), KEYED, "q_")).join(none.unionByName(some.select(none.columns)), ["hi", "hj", "list", "token"], "left")
    tie = F.coalesce(F.when(F.col("r_pol").isNull(), F.col("_any")).when(F.col("r_pol") == 1, F.col("_pos")).otherwise(F.col("_neg")), F.lit(False))
    # (letters given beside another part may still tell the two apart)
    return q.filter(~(tie & F.col("q_letters").isNull())).drop("hi", "hj", "token", "_any", "_pos", "_neg")


def retrieve(documents: DataFrame, queries: DataFrame, crowded: bool = False) -> DataFrame:
    """Pairs of a report and a feature that fits it, of the posting list that it reads, with bm25 and agrees.

    Queries come from ``with_weights``. A list is one part of a name within one cell:
    the study's number; batch and injection; either of these; letters (by two
    neighbouring ones, which letters within LETTER_EDITS are asked to share); or the
    cell alone. Queries that are known to end in a tie are left out before any list is
    read, unless ``crowded``: so the lists of ions that very many studies measure are
    not run through by reports that can't match.
    """
    if not crowded:
        queries = _crowded(queries, documents)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, 2)))
    asked = F.when(F.col("list") == "letters", grams(F.translate("q_letters", "01", "oi"))).otherwise(F.array(_token(F.col("list"), KEYED, "q_")))
    q = queries.withColumn("cell", F.explode(_around())).select("*", "cell.*").drop("cell").withColumn("token", F.explode(asked))
    wanted = queries.select("list").distinct()
    d = documents.select(*FEATURE, "ci", "cj").join(F.broadcast(wanted))
    d = d.withColumn("token", F.explode(F.when(F.col("list") == "letters", grams(F.coalesce("letters", F.lit("")))).otherwise(F.array(_token(F.col("list"), KEYED)))))
    pairs = q.join(d, ["ci", "cj", "list", "token"]).filter(_fits()).drop("ci", "cj", "token")
    length = reduce(lambda a, b: a + b, [F.col(x).isNotNull().cast("int") for x in PARTS])
    near = F.when(F.col("q_letters").isNull(), 1.0).when(_edits() >= 0, 1.0 - _edits() / 8.0).otherwise(0.0)
    study = F.when(F.col("q_number").isNotNull() & ~_has("number"), 0.0).when(F.col("q_number").isNull() & F.col("q_letters").isNull(), 0.0).otherwise(near)
    name = study * F.col("w_study") + F.when(_has("batch"), F.col("w_batch")).otherwise(0.0) + F.when(_has("injection"), F.col("w_injection")).otherwise(0.0)
    scored = pairs.withColumn("agrees", _agrees()).withColumn("bm25", F.col("w_cell") + _length_norm(F.nullif(length, F.lit(0))) * name)
    # letters share several pairs of neighbours: the feature is one candidate
    return scored.distinct().drop("list", "w_study", "w_cell", "w_batch", "w_injection", "_docs", "_avg", "_short")


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs of each report's best injection (study, for a label that names nothing) with gap and mutual.

    gap is to the runner-up or the floor, whichever is higher; 0 for a tie. mutual says
    that no other report of the same laboratory fits the feature better, by score, then
    by distance. All by maxima, with a partial step before each shuffle.
    """
    rank = F.coalesce(F.when(F.col("kind") == "none", F.col("study")).otherwise(F.col("top_sample_id").cast("string")), F.lit(""))
    off = F.pow((F.col("f_mz") - F.col("r_mz")) / MZ_TOL, F.lit(2.0)) + F.pow((F.col("f_rt") - F.col("r_rt")) / RT_TOL, F.lit(2.0))
    p = pairs.withColumn("_group", rank).withColumn("_fit", F.struct("bm25", (-off).alias("near"), (-F.col("partner_id")).alias("id")))
    per = p.groupBy("partner_id", "_group").agg(F.max("bm25").alias("s"), F.max("floor").alias("floor"))
    top = per.groupBy("partner_id").agg(F.max(F.struct("s", F.col("_group").alias("g"))).alias("b"))
    rest = per.join(top, "partner_id").filter(F.col("_group") != F.col("b.g")).groupBy("partner_id").agg(F.max("s").alias("second"))
    best = p.join(top.join(rest, "partner_id", "left"), "partner_id").filter(F.col("_group") == F.col("b.g"))
    gap = F.col("bm25") - F.greatest(F.coalesce("second", F.lit(0.0)), F.col("floor"))
    fits = best.groupBy("feature_id", "lab").agg(F.max("_fit").alias("_most")).withColumnsRenamed({"feature_id": "_f", "lab": "_l"})
    back = best.join(fits, (F.col("feature_id") == F.col("_f")) & F.col("lab").eqNullSafe(F.col("_l")))
    return back.withColumn("gap", F.when(F.abs(gap) < 1e-9, 0.0).otherwise(gap)).withColumn("mutual", F.col("_fit") == F.col("_most")).drop("_group", "_fit", "_most", "_f", "_l", "b", "second", "floor")


#: bins of the gap on which the curve is fitted, at most, and their width
BINS, BIN = 60, 0.25


def fit_logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Coefficients of columns ``z`` by Newton steps, halved until the loss falls."""

    def loss(a: np.ndarray) -> float:
        t = z @ a
        return float((w * (np.logaddexp(0.0, t) - y * t)).sum() + ridge / 2 * (a @ a))

    a = np.zeros(z.shape[1])
    now = loss(a)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ a, -500, 500)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(a)), z.T @ (w * (y - p)) - ridge * a)
        size = 1.0
        while size > 1e-6 and loss(a + size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        a, before = a + size * step, now
        now = loss(a)
        if before - now < 1e-9 * max(1.0, now):
            break
    return a


def calibration_bins(documents: DataFrame, queries: DataFrame) -> list[tuple[float, bool, bool, int, int]]:
    """(gap, tied, mutual, n, right) of masked reports: whether their best is what was hidden.

    At most CALIBRATION_REPORTS reports with full labels, chosen by a hash. Each is asked
    three times: without its study, without batch and injection, and without any label.
    Only the histogram is collected.
    """
    full = queries.filter("kind = 'full'")
    total = full.count()
    if not total:
        return []
    share = min(1.0, CALIBRATION_REPORTS / total)
    some = full.filter(F.pmod(F.xxhash64("partner_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    truth = [F.col(f"q_{x}").alias(f"_t_{x}") for x in ("number", "batch", "injection")]
    hidden = some.select("*", *truth, F.explode(F.array(F.lit("study"), F.lit("place"), F.lit("all"))).alias("hide"))
    for x, where in (("number", ["study", "all"]), ("letters", ["study", "all"]), ("batch", ["place", "all"]), ("injection", ["place", "all"])):
        hidden = hidden.withColumn(f"q_{x}", F.when(~F.col("hide").isin(*where), F.col(f"q_{x}")))
    # three questions are three reports, and rivals of their own kind only
    hidden = hidden.withColumn("lab", F.concat_ws("|", "lab", "hide")).withColumn("kind", F.when(F.col("hide") == "all", "none").otherwise("part")).withColumn("partner_id", F.struct("partner_id", "hide")).withColumn("partner_id", F.xxhash64("partner_id"))
    best = ranked(retrieve(documents, with_weights(hidden, documents), crowded=True).filter((F.col("kind") == "none") | F.col("agrees")))
    at = F.least(F.floor(F.col("gap") / BIN), F.lit(BINS))
    same = F.coalesce(F.col("number") == F.col("_t_number"), F.lit(False)) & ((F.col("hide") == "all") | (F.coalesce(F.col("batch") == F.col("_t_batch"), F.lit(False)) & F.coalesce(F.col("injection") == F.col("_t_injection"), F.lit(False))))
    once = best.groupBy("partner_id").agg(F.max(at).alias("bin"), F.max(F.col("gap") <= 0).alias("tied"), F.max("mutual").alias("mutual"), F.max(same).alias("right"))
    rows = once.groupBy("bin", "tied", "mutual").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right")).collect()
    return sorted((BIN * (r["bin"] + 0.5) if not r["tied"] else 0.0, r["tied"], r["mutual"], r["n"], r["right"]) for r in rows)


def calibrate(documents: DataFrame, queries: DataFrame) -> tuple[float, ...]:
    """Logistic curve: intercept, and what gap, tie and mutual add to the log odds."""
    bins = calibration_bins(documents, queries)
    if not bins:
        return 0.0, 1.0, -4.0, 0.0
    gap, tied, mutual, n, right = (np.array([float(b[i]) for b in bins]) for i in range(5))
    z = np.stack([np.ones_like(gap), gap, tied, mutual], 1)
    return tuple(float(x) for x in fit_logistic(np.concatenate([z, z]), np.concatenate([np.ones_like(gap), np.zeros_like(gap)]), np.concatenate([right, n - right])))


def confidence_of(curve: tuple[float, ...], gap: Column, mutual: Column) -> Column:
    """Confidence from the curve, at the middle of the gap's bin as when it was fitted."""
    a, b, tie, both = (F.lit(x) for x in curve)
    odds = a + b * F.least(gap, F.lit(BIN * (BINS + 0.5))) + F.when(gap <= 0, tie).otherwise(0.0) + F.when(mutual, both).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def accepted(features: DataFrame, samples: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries, and the accepted pairs with bm25, gap and mutual; see ``match``."""
    docs = cut(feature_documents(features, samples))
    queries = cut(report_queries(reports))
    best = ranked(cut(retrieve(docs, with_weights(queries, docs))))
    return docs, queries, best.filter((F.col("gap") > 0) & ((F.col("kind") == "none") | F.col("agrees")))


def match(features: DataFrame, samples: DataFrame, reports: DataFrame, curve: tuple[float, ...] | None = None) -> DataFrame:
    """(feature_id, partner_id, kind, bm25, gap, mutual, confidence) of every accepted pair.

    A pair is accepted if the feature is of the report's best injection by BM25, which
    must stand alone (gap above 0), and if every part that the label gives is that
    injection's. Where a label names nothing, studies are ranked in place of injections.
    So a label that gives only part of a name is matched if a single injection of those
    that fit agrees with it. A report may match several features of the injection (one
    exported twice). Rows with null ids, masses or retentions match nothing; empty
    tables give no rows.
    """
    docs, queries, pairs = accepted(features, samples, reports)
    curve = curve if curve is not None else calibrate(docs, queries)
    return pairs.select("feature_id", "partner_id", "kind", "bm25", "gap", "mutual", confidence_of(curve, F.col("gap"), F.col("mutual")).alias("confidence"))
