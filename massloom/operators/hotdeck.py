"""Missing values filled from similar records: nearest-neighbour hot deck.

The mixed distance counts each feature that isn't known to be equal, and the gap in one
order (the run order). Records are hash-blocked on each combination of those features.
Inside a block the distance of the features is at most the block's, so the donors nearest
in the order are the nearest of the block; over all blocks they hold the closest donors
there are. Each donor's place is its number among the block's donors, counted in chunks
with carried totals, so the nearest donors are found by an equi-join on (block, number),
never by comparing all records of a block. The closest ones give the weighted median of a
number, or the weighted majority of a category.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import cut, small

#: donors taken on each side in each block, unless said otherwise, and donors that a value is made of
SIDE = 2
DONORS = 5
#: records of a block are counted in chunks of the order of this width
CHUNK = 1024
#: a group of at most so many rows is gathered in one place; larger ones go by numbered blocks
GATHER = 256
#: gap in the order to a record without one
UNKNOWN_GAP = 100.0


def combined(base: Sequence[str], features: Sequence[str]) -> list[list[str]]:
    """A block for each combination of the features, all within ``base``."""
    return [[*base, *c] for n in range(len(features), -1, -1) for c in combinations(features, n)]


def _blocked(records: DataFrame, blocks: Sequence[Sequence[str]], features: Sequence[str], base: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each record once for each block it has the keys of: _block, names (NULL where not a key), _apart.

    A donor is left out of blocks whose keys no missing record has singly: nobody asks there.
    """
    kinds = dict(records.dtypes)
    for k in names:
        if k not in base:
            wanted = records.filter(F.col("value").isNull() & F.col(k).isNotNull()).select(*base, k).distinct().withColumn(f"_want_{k}", F.lit(True))
            records = records.join(wanted, [*base, k], "left")
    whole = lambda b: reduce(lambda x, y: x & y, [F.col(k).isNotNull() if k in base else F.coalesce(F.col(f"_want_{k}"), F.lit(False)) for k in b])
    # what the block doesn't hold counts as different; a donor alike in more is nearer in another block
    key = lambda i, b: F.struct(F.lit(i).alias("_block"), *[(F.col(k) if k in b else F.lit(None).cast(kinds[k])).alias(k) for k in names], F.lit(float(len(set(features) - set(b)))).alias("_apart"))
    keys = F.array_compact(F.array(*[F.when(whole(b), key(i, b)) for i, b in enumerate(blocks)]))
    rest = [c for c in records.columns if c not in names and not c.startswith("_want_")]
    return records.select(*rest, F.explode(keys).alias("_k")).select(*rest, "_k.*").withColumn("_give", F.col("value").isNotNull())


def _equal(left: DataFrame, right: DataFrame, names: Sequence[str], same: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``same`` and on ``names``, of which those that a block lacks are NULL."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in [*same, *names]})
    cond = [left[c] == r[f"_r_{c}"] for c in same] + [left[c].eqNullSafe(r[f"_r_{c}"]) for c in names]
    return left.join(r, reduce(lambda x, y: x & y, cond), how).drop(*[f"_r_{c}" for c in [*same, *names]])


def _number(df: DataFrame, names: Sequence[str], order: str, side: int, carried: DataFrame) -> DataFrame:
    """Of records with an order, numbers the donors of each block by (order, record).

    Of donors at one place only the first ``side`` count. Adds _upto: donors at or before
    the record's place; for donors also _no, and _back, the number if those at one place
    are taken the other way round.
    """
    keys = ["_block", *names, "_chunk"]
    place = Window.partitionBy(*keys, order)
    rank = F.sum(F.col("_give").cast("long")).over(place.orderBy("record").rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_rank", rank).withColumn("_give", F.col("_give") & (F.col("_rank") <= side)).filter("_give or value is null")
    one = F.col("_give").cast("long")
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_same", F.sum(one).over(place)).withColumn("_upto", F.sum(one).over(upto))
    d = _equal(d, carried, names, ["_block", "_chunk"], "left").withColumn("_upto", F.col("_upto") + F.coalesce("_carry", F.lit(0)))
    return d.withColumn("_no", F.col("_upto") - F.col("_same") + F.col("_rank")).withColumn("_back", F.col("_upto") + 1 - F.col("_rank")).drop("_rank", "_same", "_carry", "_chunk")


def donors(records: DataFrame, blocks: Sequence[Sequence[str]], order: str, features: Sequence[str], side: int = SIDE) -> DataFrame:
    """(record, donor, value, distance) of the donors around each record that lacks a value.

    ``records`` has record, value (NULL where missing), ``order`` and ``features``.
    A record takes no part in a block of which it lacks a key. In each block the
    ``side`` nearest on each side are taken, at one place those of the smallest record
    first, and the first ``side`` of those without an order; a record without an order
    takes the first ``side`` of all. A donor of several blocks comes with the distance
    in each; the least is its own.
    """
    names = list(dict.fromkeys(k for b in blocks for k in b))
    base = [k for k in names if all(k in b for b in blocks)]
    r = records.select("record", "value", order, *names)
    lacks, placed = F.col("value").isNull(), F.col(order).isNotNull()
    at = ["_block", *names]
    chunk = F.floor(F.col(order) / CHUNK)

    # only what spans several chunks needs carried totals
    long = r.filter(placed).groupBy(*base).agg(F.min(chunk).alias("_a"), F.max(chunk).alias("_z")).filter("_a < _z").select(*base)
    # (a chunk may hold records that ask, and no donor)
    spread = _blocked(r.join(long, base, "left_semi"), blocks, features, base, names).filter(placed).withColumn("_chunk", chunk)
    totals = spread.groupBy(*at, "_chunk", order).agg(F.least(F.sum(F.col("_give").cast("long")), F.lit(side)).alias("_n")).groupBy(*at, "_chunk").agg(F.sum("_n").alias("_n"))
    carried = totals.select(*at, "_chunk", F.sum("_n").over(Window.partitionBy(*at).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))

    d = _blocked(r, blocks, features, base, names)
    numbered = _number(d.filter(placed).withColumn("_chunk", chunk), names, order, side, carried)
    given = lambda df, *more: df.select(*at, *more, F.col("record").alias("_donor"), F.col("value").alias("_value"), F.col(order).alias("_place"))
    asks = lambda df, *more: df.filter(lacks).select(*at, "record", order, "_apart", *more)
    first = lambda df: given(df.filter("_give").withColumn("_r", F.row_number().over(Window.partitionBy(*at).orderBy("record"))).filter(F.col("_r") <= side))
    # those before may be taken the other way round within a place, hence the wider reach
    asked = asks(numbered, "_upto", F.explode(F.sequence(F.col("_upto") - (2 * side - 2), F.col("_upto") + side)).alias("_no"))
    near = _equal(asked, given(numbered.filter("_give"), "_no", "_back"), names, ["_block", "_no"]).filter(f"_no > _upto or _back > _upto - {side}").drop("_no", "_back", "_upto")
    unplaced = _equal(asks(d.filter(placed)), first(d.filter(~placed)), names, ["_block"])
    lost = r.filter(lacks & ~placed).select(*base).distinct()
    among = _blocked(r.join(lost, base, "left_semi"), blocks, features, base, names)
    anywhere = _equal(asks(among.filter(~placed)), first(among), names, ["_block"])
    gap = F.coalesce(F.abs(F.col(order) - F.col("_place")), F.lit(UNKNOWN_GAP))
    return near.unionByName(unplaced).unionByName(anywhere).select("record", F.col("_donor").alias("donor"), F.col("_value").alias("value"), (F.col("_apart") + gap / (gap + 10.0)).alias("distance"))


def _whole_groups(records: DataFrame, base: Sequence[str], order: str, features: Sequence[str]) -> DataFrame:
    """(record, value, d) of groups of a bounded size; d has the closest donors of a record without a value.

    One shuffle by ``base``: a group's records are gathered as two short arrays, and each
    record that asks ranks the donors of its own array.
    """
    kinds = dict(records.dtypes)
    once = records.repartition(*base).groupBy(*base, "record", order, *features).agg(F.max("value").alias("value"))
    item = F.struct("record", "value", F.col(order).alias("_place"), *features)
    groups = once.groupBy(*base).agg(F.collect_list(F.when(F.col("value").isNotNull(), item)).alias("_givers"), F.collect_list(F.when(F.col("value").isNull(), item)).alias("_askers"))

    def ranked(x: Column, g: Column) -> Column:
        apart = reduce(lambda a, c: a + c, [F.when(x[k] == g[k], 0.0).otherwise(1.0) for k in features], F.lit(0.0))
        gap = F.coalesce(F.abs(x["_place"] - g["_place"]), F.lit(UNKNOWN_GAP))
        return F.struct((apart + gap / (gap + 10.0)).alias("distance"), g["record"].alias("donor"), g["value"].alias("value"))

    asked = F.transform("_askers", lambda x: F.struct(x["record"].alias("record"), x["value"].alias("value"), F.slice(F.array_sort(F.transform("_givers", lambda g: ranked(x, g))), 1, DONORS).alias("d")))
    none = F.lit(None).cast(f"array<struct<distance:double,donor:{kinds['record']},value:{kinds['value']}>>")
    given = F.transform("_givers", lambda g: F.struct(g["record"].alias("record"), g["value"].alias("value"), none.alias("d")))
    return groups.select(F.explode(F.concat(given, asked)).alias("x")).select("x.record", "x.value", "x.d")


def _large_groups(records: DataFrame, blocks: Sequence[Sequence[str]], base: Sequence[str], order: str, features: Sequence[str]) -> DataFrame:
    """The same of groups of any size, which nothing gathers."""
    records = cut(records.groupBy(*base, "record", order, *features).agg(F.max("value").alias("value")))
    near = donors(records, blocks, order, features, DONORS)
    once = near.groupBy("record", "donor").agg(F.min(F.struct("distance", "value")).alias("x"))
    # at most 3 * DONORS donors for each kind of block
    best = once.groupBy("record").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("x.distance").alias("distance"), F.col("donor"), F.col("x.value").alias("value")))), 1, DONORS).alias("d"))
    return records.select("record", "value").join(best, "record", "left")


def fill(records: DataFrame, blocks: Sequence[Sequence[str]], order: str, features: Sequence[str], numeric: bool, gather: int = GATHER) -> DataFrame:
    """(record, value, filled, n_donors, donors) for every record.

    filled is true where the value was missing; such a value is the donors' weighted
    median, or their weighted majority (ties go to the smaller value), weights falling
    with the distance. A missing value without any donor stays NULL with filled true
    and no donors; so does one that lacks a key all blocks share. With a block for each
    combination of the features (``combined``) the donors are the closest of the widest
    block; ties go to the smaller record. Copies of a record in one group count once,
    with the largest of their values.

    Groups of at most ``gather`` rows rank their donors in one array, larger ones find
    them by numbered blocks; the donors are the same either way.
    """
    base = [k for k in blocks[0] if all(k in b for b in blocks)]
    records = records.select("record", "value", order, *base, *[k for k in features if k not in base])
    keyed = reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in base])
    large = cut(records.filter(keyed).groupBy(*base).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > gather).select(*base))
    if large.take(1):
        large = small(large)
        parts = [_whole_groups(records.filter(keyed).join(large, base, "left_anti"), base, order, features), _large_groups(records.join(large, base, "left_semi"), blocks, base, order, features)]
    else:
        parts = [_whole_groups(records.filter(keyed), base, order, features)]
    ranked = reduce(DataFrame.unionByName, parts)
    loose = records.filter(~keyed).groupBy("record").agg(F.max("value").alias("value")).withColumn("d", F.lit(None).cast(ranked.schema["d"].dataType))
    ranked = ranked.unionByName(loose).withColumn("v", F.array_sort(F.transform("d", lambda x: F.struct(x["value"].alias("value"), (1.0 / (1.0 + x["distance"])).alias("w")))))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"])
    if numeric:
        # the first value at which the weights reach half of their sum
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m"))
        step = F.aggregate("v", start, lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["m"].isNull() & (a["s"] + x["w"] >= F.col("half")), x["value"].cast("double")).otherwise(a["m"]).alias("m")))
        ranked = ranked.withColumn("half", total / 2 - 1e-12).withColumn("_fill", step["m"])
    else:
        names = F.array_distinct(F.transform("v", lambda x: x["value"]))
        votes = F.transform(names, lambda n: F.struct((-F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(x["value"] == n, x["w"]).otherwise(0.0))).alias("w"), n.alias("n")))
        ranked = ranked.withColumn("_fill", F.get(F.array_sort(votes), F.lit(0))["n"])
    missing = F.col("value").isNull()
    took = F.coalesce(F.col("d.donor"), F.array().cast("array<bigint>"))
    return ranked.select("record", F.when(missing, F.col("_fill")).otherwise(F.col("value")).alias("value"), missing.alias("filled"), F.when(missing, F.size(took)).otherwise(F.lit(0)).alias("n_donors"), F.when(missing, took).alias("donors"))


def usable_area(c: Column) -> Column:
    """The area if it is a finite number of at least 0, else NULL."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c >= 0), c)


def usable_class(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """``samples`` with clean_class: the valid class in its regular spelling, else NULL."""
    valid = classes.filter("class is not null").groupBy(F.lower(F.trim("class")).alias("_norm")).agg(F.min(F.trim("class")).alias("clean_class"))
    return samples.drop("clean_class").withColumn("_norm", F.lower(F.trim("class"))).join(valid, "_norm", "left").drop("_norm")


def sample_records(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """Injections once each: record, value (class), study, subject, batch, run."""
    s = usable_class(samples, classes).filter("sample_id is not null")
    return s.groupBy(F.col("sample_id").cast("bigint").alias("record")).agg(
        F.max("clean_class").alias("value"), F.max("study").alias("study"), F.max("id").alias("subject"), F.max("batch").alias("batch"), F.max(F.col("run_order").cast("double")).alias("run")
    )


def fill_classes(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of injections, from those of the same subject, batch and study nearest in the run."""
    r = sample_records(samples, classes)
    return fill(r, combined(["study"], ["subject", "batch"]), "run", ["subject", "batch"], numeric=False)


def fill_areas(cells: DataFrame, samples: DataFrame, classes: DataFrame, gather: int = GATHER) -> DataFrame:
    """Areas of cells, from cells of the same feature in like injections.

    A cell repeated as a whole row counts once. Of two different rows with one cell_id,
    feature and injection the usable, larger area stands. Cells whose injection is
    unknown are filled from their feature's cells alone, cells without a feature not at all.
    """
    c = cells.filter("cell_id is not null").select(F.col("cell_id").cast("bigint").alias("record"), usable_area(F.col("area")).alias("value"), "feature_id", "sample_id")
    s = cut(sample_records(samples, classes).select(F.col("record").alias("sample_id"), F.col("value").alias("class"), "subject", "batch", "run"))
    return fill(c.join(small(s), "sample_id", "left"), combined(["feature_id"], ["subject", "class", "batch"]), "run", ["subject", "class", "batch"], numeric=True, gather=gather)


def found(areas: DataFrame, classes: DataFrame) -> DataFrame:
    """The filled records, each with a value or without any donor: (table_name, record_id)."""
    # read off the outcome of the fill and not off its mark alone, so that no plan can leave the donors out
    # (of records that weren't missing both sides differ)
    done = F.col("filled") == ((F.col("n_donors") == 0) | F.col("value").isNotNull())
    rows = [t.filter(done).select(F.lit(n).alias("table_name"), F.col("record").alias("record_id")) for n, t in (("data_matrix", areas), ("sample_metadata", classes))]
    return rows[0].unionByName(rows[1])
