from pyspark.sql import functions as F

from massloom.streaming import signals


def test_totals_and_spots_equal_batch(spark, tmp_path):
    rows = [("A", i, 100.0, 10.0 if i % 40 < 20 else 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "sample string, sec int, mz double, spint double").withColumn("at", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, plain in (("t", signals.running_totals(stream), signals.running_totals(df)), ("s", signals.spots(stream, 5.0), signals.spots(df, 5.0))):
        q = out.writeStream.outputMode("complete").format("memory").queryName(name).start() if name == "t" else out.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in plain.collect()}
        assert got <= want and got
        if name == "t":
            assert got == want


def test_silent_samples_give_out_their_traces(spark, tmp_path):
    rows = [("A", float(t), 100.0 + (t % 2) * 0.001, 5.0 + t) for t in range(10)]
    df = spark.createDataFrame(rows, "sample string, time double, mz double, spint double")
    df.repartition(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    q = signals.linked_traces(stream, silent_ms=500).writeStream.outputMode("append").format("memory").queryName("silent").trigger(processingTime="1 second").start()
    for _ in range(60):
        q.awaitTermination(1)
        if spark.table("silent").count():
            break
    q.stop()
    got = spark.table("silent").collect()
    assert [(r["sample"], r["first"], r["last"], r["n"], r["top"]) for r in got] == [("A", 0.0, 9.0, 10, 14.0)]
