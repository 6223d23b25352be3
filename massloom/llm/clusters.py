"""Clusters of mutually similar records: MinHash banding, exact Jaccard, components, medoids.

A record is a point of two measured quantities. Space is cut into cells of a third of
the tolerance, and a cell's set is the SIDE x SIDE cells that begin at it, so two points
are alike when their cells' sets overlap enough. Cells, not points, are banded: all
points of one cell are alike without looking at pairs, and a bucket holds at most
SIDE * SIDE cells however many points lie in them, so no ion that is measured in very
many studies makes a group that has to be paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.graph import components
from massloom.operators.units import is_number
from massloom.session import cut

SIDE = 4
BANDS = 24
#: cells at most two apart share two of six steps of a coordinate: if they do so in both
#: coordinates, every pair of their points is alike
ALIKE = 2.0 / 6.0


def _tokens() -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda b: F.xxhash64("kind", F.col("i") + a, F.col("j") + b))))


def cells(points: DataFrame, kind: str, x: str, y: str, tol_x: float, tol_y: float) -> DataFrame:
    """Adds kind, i, j and cell to points with both coordinates; the rest is dropped."""
    ok = is_number(F.col(x)) & is_number(F.col(y)) & F.col(kind).isNotNull()
    p = points.filter(ok).withColumn("kind", F.col(kind)).withColumn("i", F.floor(F.col(x) / (tol_x / 3))).withColumn("j", F.floor(F.col(y) / (tol_y / 3)))
    return p.withColumn("cell", F.xxhash64("kind", "i", "j"))


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of cells (a, b, jaccard) that share a band and whose sets overlap by ALIKE at least in each coordinate.

    jaccard is that of the whole sets.
    """
    # plain expressions of 16 columns, which are compiled; in as many tasks as shuffles have, since there is little to read and much to hash
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    names = [f"t{a}_{b}" for a in range(SIDE) for b in range(SIDE)]
    hashed = nodes.select("cell", "kind", "i", "j", *[F.xxhash64("kind", F.col("i") + a, F.col("j") + b).alias(f"t{a}_{b}") for a in range(SIDE) for b in range(SIDE)])
    least = [F.least(*[F.xxhash64(t, F.lit(band)) for t in names]) for band in range(BANDS)]
    banded = hashed.select("cell", "kind", "i", "j", F.posexplode(F.array(*least)).alias("band", "least"))
    bucket = banded.groupBy("band", "least").agg(F.collect_set(F.struct("cell", "kind", "i", "j")).alias("c")).filter(F.size("c") > 1)
    pairs = bucket.select(F.explode("c").alias("p"), "c").select("p", F.explode("c").alias("q")).filter(F.col("p.cell") < F.col("q.cell")).distinct()
    over = [F.greatest(F.lit(0), SIDE - F.abs(F.col(f"p.{d}") - F.col(f"q.{d}"))) for d in ("i", "j")]
    both = over[0] * over[1]
    alike = (F.col("p.kind") == F.col("q.kind")) & (over[0] / (2 * SIDE - over[0]) >= ALIKE - 1e-9) & (over[1] / (2 * SIDE - over[1]) >= ALIKE - 1e-9)
    return pairs.filter(alike).select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), (both / (2 * SIDE * SIDE - both)).alias("jaccard"))


def _unlinked(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of cells that may hold alike points, at most three apart, in different components."""
    spread = nodes.join(member, "cell").withColumn("token", F.explode(_tokens()))
    bucket = spread.groupBy("token").agg(F.collect_set(F.struct("component", "cell")).alias("c"), F.min("component").alias("_c0"), F.max("component").alias("_c1")).filter("_c0 <> _c1")
    return bucket.select(F.explode("c").alias("p"), "c").select("p", F.explode("c").alias("q")).filter((F.col("p.cell") < F.col("q.cell")) & (F.col("p.component") != F.col("q.component"))).select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b")).distinct()


def _edge_points(points: DataFrame, right: bool, up: bool, salts: int = 64) -> DataFrame:
    """Points of each cell that no other one of it exceeds in both directions (of several at one place one).

    Found in salted parts first, so that a cell with any share of the rows is spread.
    """
    x, y = F.col("x") if right else -F.col("x"), F.col("y") if up else -F.col("y")

    def outermost(d: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(x.desc(), y.desc())
        return d.withColumn("_most", F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_most").isNull() | (y > F.col("_most"))).drop("_most")

    d = points.select("cell", "x", "y").withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    return outermost(outermost(d, "cell", "_salt").drop("_salt"), "cell")


def _touching(apart: DataFrame, points: DataFrame, tol_x: float, tol_y: float) -> DataFrame:
    """Those pairs of cells (a, b) that hold two points within tolerance, one in each.

    The cells' boxes decide most: cells in one row or column are near in that coordinate
    anyway. Of diagonal neighbours only the points at the facing corners can be nearest.
    """
    eps = 1e-9
    box = points.groupBy("cell", "i", "j").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda n: box.select(F.col("cell").alias(n), *[F.col(c).alias(f"{n}{c}") for c in ("i", "j", "x0", "x1", "y0", "y1")])
    q = apart.join(side("a"), "a").join(side("b"), "b")
    gap = lambda c: F.greatest(F.col(f"a{c}0"), F.col(f"b{c}0")) - F.least(F.col(f"a{c}1"), F.col(f"b{c}1"))
    span = lambda c: F.greatest(F.col(f"a{c}1"), F.col(f"b{c}1")) - F.least(F.col(f"a{c}0"), F.col(f"b{c}0"))
    q = q.filter((gap("x") <= tol_x + eps) & (gap("y") <= tol_y + eps))
    sure = (F.col("ai") == F.col("bi")) | (F.col("aj") == F.col("bj")) | ((span("x") <= tol_x + eps) & (span("y") <= tol_y + eps))
    q = cut(q.select("a", "b", sure.alias("sure"), (F.col("ai") < F.col("bi")).alias("right"), (F.col("aj") < F.col("bj")).alias("up")))
    found = q.filter("sure").select("a", "b")
    open_ = q.filter(~F.col("sure"))
    # (with nothing left to decide, none of the rest is planned)
    for right, up in ((True, True), (True, False)) if open_.take(1) else ():
        # a is left of b, or both are taken the other way round
        ahead = open_.filter(F.col("right") & (F.col("up") == F.lit(up))).select("a", "b", F.col("a").alias("l"), F.col("b").alias("r"))
        back = open_.filter(~F.col("right") & (F.col("up") == F.lit(not up))).select("a", "b", F.col("b").alias("l"), F.col("a").alias("r"))
        both = ahead.unionByName(back)
        own = lambda n, of_right, of_up, both=both: _edge_points(points.join(both.select(F.col(n).alias("cell")).distinct(), "cell", "left_semi"), of_right, of_up).select(F.col("cell").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
        near = (F.abs(F.col("xl") - F.col("xr")) <= tol_x + eps) & (F.abs(F.col("yl") - F.col("yr")) <= tol_y + eps)
        found = found.unionByName(both.join(own("l", right, up), "l").join(own("r", not right, not up), "r").filter(near).select("a", "b"))
    return found.distinct()


def split_loose(nodes: DataFrame, member: DataFrame, edges: DataFrame, loose: DataFrame) -> DataFrame:
    """(cell, component) of loose components, split around their highest-degree medoids.

    In each round every free cell whose degree no free neighbour exceeds becomes a
    medoid and takes its free neighbours; ties go to the smaller cell number.
    """
    own = member.join(loose, "component", "left_semi")
    both = edges.select("a", "b").union(edges.select("b", "a")).join(own.select(F.col("cell").alias("a")), "a", "left_semi")
    degree = own.join(both.groupBy(F.col("a").alias("cell")).agg(F.count(F.lit(1)).alias("d")), "cell", "left").select("cell", F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("cell")).alias("n")).alias("rank"))
    free, done = cut(degree), None
    while free.take(1):
        near = both.join(free.select(F.col("cell").alias("b"), F.col("rank").alias("r")), "b").join(free.select(F.col("cell").alias("a")), "a", "left_semi")
        best = free.join(near.groupBy(F.col("a").alias("cell")).agg(F.max("r").alias("r")), "cell", "left")
        medoid = best.filter(F.col("r").isNull() | (F.col("rank") > F.col("r"))).select("cell", "rank")
        taken = near.select("a", F.col("b").alias("m")).join(medoid.select(F.col("cell").alias("m"), F.col("rank").alias("r")), "m").groupBy(F.col("a").alias("cell")).agg(F.max_by("m", "r").alias("component"))
        step = cut(medoid.select("cell", F.col("cell").alias("component")).union(taken.join(medoid, "cell", "left_anti")))
        done = step if done is None else done.union(step)
        free = cut(free.join(step, "cell", "left_anti"))
    return done if done is not None else member.limit(0).select("cell", "component")


def cluster(points: DataFrame, key: str, kind: str, x: str, y: str, tol_x: float, tol_y: float, loose_factor: float = 2.0) -> DataFrame:
    """(cluster_id, key, x, y) of every point in a cluster of two or more points.

    Points belong together if they have the same kind and differ by at most ``tol_x``
    and ``tol_y``, or are linked through such points. A component wider than
    ``loose_factor`` tolerances is loose and is split around medoids. The cluster's id
    is its smallest key. Null, NaN or infinite coordinates, null kinds and null keys
    belong to no cluster; a repeated row counts once. Empty tables give no rows.
    """
    p = cells(points.filter(F.col(key).isNotNull()), kind, x, y, tol_x, tol_y)
    p = cut(p.select(F.col(key).alias("key"), "kind", "cell", "i", "j", F.col(x).alias("x"), F.col(y).alias("y")).distinct())
    nodes = p.groupBy("cell", "kind", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    edges = cut(candidate_pairs(nodes))
    linked = components(edges)
    member = cut(nodes.select("cell").join(linked.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("component", "cell").alias("component")))
    # exact check: what banding left apart is joined where two points really are within tolerance
    apart = _unlinked(nodes, member)
    extra = cut(_touching(apart, p, tol_x, tol_y))
    if extra.take(1):
        ends = extra.join(member.select(F.col("cell").alias("a"), F.col("component").alias("ca")), "a").join(member.select(F.col("cell").alias("b"), F.col("component").alias("cb")), "b")
        renamed = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        member = cut(member.join(renamed.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left").select("cell", F.coalesce("_new", "component").alias("component")))
    boxes = p.join(member, "cell").groupBy("component").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    loose = cut(boxes.filter((F.col("dx") > loose_factor * tol_x) | (F.col("dy") > loose_factor * tol_y)).select("component"))
    if loose.take(1):
        parts = split_loose(nodes, member, edges.select("a", "b").union(extra), loose)
        member = member.join(loose, "component", "left_anti").select("cell", "component").union(parts)
    named = p.join(member, "cell")
    ids = named.groupBy("component").agg(F.min("key").alias("cluster_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return named.join(ids, "component").select("cluster_id", "key", "x", "y")


def describe(clusters: DataFrame, typical: int = 3, salts: int = 32) -> DataFrame:
    """(cluster_id, size, x, y, typical): mean position and the keys nearest to it, nearest first.

    Distances are in the cluster's own spread; what differs by less than a millionth is a
    tie, which goes to the smaller key. The nearest are picked in salted parts
    first, so a cluster of any size is never sorted as one.
    """
    mid = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    parts = [F.coalesce(F.pow((F.col(a) - F.col(f"c{a}")) / F.nullif(F.col(f"s{a}"), F.lit(0.0)), F.lit(2.0)), F.lit(0.0)) for a in ("x", "y")]
    far = clusters.join(mid, "cluster_id").withColumn("_d", F.round(reduce(lambda a, b: a + b, parts), 6)).withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    far = far.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "_salt").orderBy("_d", "key"))).filter(F.col("_r") <= typical)
    top = far.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "key"))), 1, typical).alias("_t")).select("cluster_id", F.col("_t.key").alias("typical"))
    return mid.join(top, "cluster_id").select("cluster_id", "size", F.col("cx").alias("x"), F.col("cy").alias("y"), "typical")
