"""Mixing sources to target weights: Pareto order sampling of whole documents.

Every source gets the same share of documents' weight in expectation: a document whose
expected number of copies is m is taken floor(m) times for certain, and the fraction
left over is its inclusion odds. Pareto sampling ranks documents by random odds divided
by inclusion odds, u/(1-u) / (p/(1-p)), and takes them in that order until the source's
tokens are reached, so its size is fixed up to one document. Order and sums are taken
over buckets of the rank first, then inside the one bucket where the target falls, so no
source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import cut

#: rank buckets of a source
BUCKETS = 4096


def source_key(c: Column) -> Column:
    """Regular spelling of a source: trimmed, lower case; NULL for blank ones."""
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def plan(sizes: DataFrame, target: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row for each source wanted or present, with its token budget.

    (source, weight, max_repeat, docs, tokens, budget). ``sizes`` has source and tokens of
    every document. Without ``total_tokens`` the mix is as large as it can be with every
    wanted source that has tokens at its weight exactly: the least of
    max_repeat * tokens / weight. With it, a source that cannot fill its share even when
    repeated as often as allowed gives all it can. Sources without documents, and
    sources not wanted, get no tokens.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    want = target.select(source_key(F.col("source")).alias("source"), "weight", "max_repeat").filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    p = want.join(have, "source", "full").select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    most = F.when((F.col("weight") > 0) & (F.col("tokens") > 0) & (F.col("max_repeat") > 0), F.col("max_repeat") * F.col("tokens") / F.nullif(F.col("weight"), F.lit(0.0)))
    if total_tokens is None:
        p = p.crossJoin(F.broadcast(p.agg(F.coalesce(F.min(most), F.lit(0.0)).alias("_total"))))
    else:
        p = p.withColumn("_total", F.lit(float(total_tokens)))
    return p.withColumn("budget", F.least(F.col("weight") * F.col("_total"), (F.col("max_repeat") * F.col("tokens")).cast("double"))).drop("_total")


def draw(documents: DataFrame, target: DataFrame, total_tokens: float | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken at least once.

    ``documents`` has doc_id, source, votes and tokens. Documents without an id, with no
    tokens or without a source take no part; a null vote is no vote. Documents with more
    votes are likelier to be among the taken, by log(e + votes). The same input and seed
    give the same mix. A source reaches its budget to within the last document taken.
    """
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), F.log(F.lit(2.718281828459045) + F.greatest(F.coalesce("votes", F.lit(0)), F.lit(0))).alias("w"))
    d = cut(d.filter("doc_id is not null and source is not null and tokens > 0").distinct())
    p = plan(d, target, total_tokens)
    sums = d.groupBy("source").agg(F.sum(F.col("w") * F.col("tokens")).alias("_ws"))
    # few rows, one for each source that is wanted
    of = p.filter("budget > 0").join(sums, "source").select("source", "budget", "max_repeat", (F.col("budget") / F.nullif(F.col("_ws"), F.lit(0.0))).alias("rate"), (F.col("budget") / F.nullif(F.col("tokens"), F.lit(0))).alias("mean"))
    m = F.col("rate") * F.col("w")
    # no document over its cap, and the mean copies of the source stay apart by one at most
    base = F.floor(F.col("mean"))
    m = F.greatest(F.least(m, base + 0.999, F.col("max_repeat").cast("double")), base.cast("double"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double")
    u = (h + 0.5) / float(1 << 52)
    odds = d.join(of, "source").withColumn("whole", F.least(base, F.col("max_repeat"))).withColumn("frac", F.greatest(F.lit(1e-6), F.least(m - base, F.lit(0.999)))).withColumn("q", (u / (1 - u)) / (F.col("frac") / (1 - F.col("frac"))))
    odds = odds.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
    left = odds.groupBy("source").agg((F.first("budget") - F.sum(F.col("whole") * F.col("tokens"))).alias("left"))
    hist = odds.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(left, "source")
    edge = odds.join(hist.select("source", "bucket", "before", "n", "left"), ["source", "bucket"])
    sure = edge.filter(F.col("before") + F.col("n") <= F.col("left")).withColumn("more", F.lit(1))
    # the bucket in which the budget ends is ordered by the rank itself
    part = edge.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
    inner = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("_sum", F.col("before") + F.sum("tokens").over(inner))
    # the document across the budget is taken if that comes nearer to it
    part = part.withColumn("more", F.when(F.col("_sum") - F.col("left") <= F.col("tokens") / 2, 1).otherwise(0)).drop("_sum")
    none = edge.filter(F.col("before") >= F.col("left")).withColumn("more", F.lit(0))
    out = sure.unionByName(part).unionByName(none).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.col("max_repeat")).cast("int"))
    return out.filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(mix: DataFrame, sizes: DataFrame, target: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, weight, share, docs, tokens, taken_docs, taken_tokens, max_copies, max_repeat), wanted beside reached."""
    p = plan(sizes, target, total_tokens)
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("taken_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("max_copies"))
    all_tokens = F.sum("taken_tokens").over(Window.partitionBy())
    out = p.join(got, "source", "left").na.fill(0, ["taken_docs", "taken_tokens", "max_copies"])
    return out.withColumn("share", F.coalesce(F.col("taken_tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0))).select("source", "weight", "share", "docs", "tokens", "taken_docs", "taken_tokens", "max_copies", "max_repeat")
