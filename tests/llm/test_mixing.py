import random

from massloom.llm import mixing

D = "doc_id long, source string, votes int, tokens int, copies string"
T = "source string, weight double, max_repeat int"


def test_shares_caps_and_repeats(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big ", "big", "BIG"]), rng.randrange(-2, 9), rng.randrange(1, 400), "x") for i in range(3000)]
    docs += [(5000 + i, "small", None, rng.randrange(1, 400), "x") for i in range(100)] + [(9000, None, 1, 50, "x"), (9001, "other", 1, 50, "x"), (9002, "small", 1, 0, "x"), docs[0]]
    target = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("ghost", 0.1, 2)], T)
    df = spark.createDataFrame(docs, D)
    mix = mixing.draw(df, target).cache()
    rows = mix.collect()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["tokens"] * r["copies"]
    assert set(size) == {"big", "small"} and abs(size["big"] / size["small"] - 3.5) < 0.05
    assert max(r["copies"] for r in rows if r["source"] == "big") == 1 and max(r["copies"] for r in rows if r["source"] == "small") <= 3
    assert len({r["doc_id"] for r in rows}) == len(rows)
    again = mixing.draw(df.repartition(7), target).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    sizes = df.select(mixing.source_key(df["source"]).alias("source"), "tokens").filter("source is not null and tokens > 0").distinct()
    report = {r["source"]: r for r in mixing.shares(mix, sizes, target).collect()}
    assert report["ghost"]["share"] == 0 and report["other"]["taken_docs"] == 0 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-9


def test_votes_matter_and_totals(spark):
    docs = [(i, "a", 50 if i % 2 else 0, 100, "x") for i in range(4000)]
    mix = mixing.draw(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 1.0, 1)], T), total_tokens=100_000).collect()
    liked = sum(r["doc_id"] % 2 for r in mix)
    assert abs(sum(r["tokens"] for r in mix) - 100_000) <= 100 and liked > 0.65 * len(mix)


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], T)
    e = spark.createDataFrame([], D)
    assert mixing.draw(e, t).count() == 0
    assert mixing.draw(spark.createDataFrame([(1, "a", 1, 5, "x")], D), t.limit(0)).count() == 0
