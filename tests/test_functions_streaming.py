from pyspark.sql import functions as F

from kgspark.functions import scalar as s
from kgspark.streaming import events


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_scalars(spark):
    assert [one(spark, s.percent(F.lit(p), F.lit(w))) for p, w in ((5, 8), (7, 8), (1, 0))] == [62.0, 88.0, None]
    assert one(spark, s.either(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert one(spark, s.host(F.lit("https://a.org/b%20c?d"))) == "a.org" and one(spark, s.path(F.lit("https://a.org/b%20c?d"))) == "/b c"
    assert one(spark, s.route(F.lit("/api/x/${id}/"))) == "api/x/:id"
    assert 0 <= one(spark, s.bucket(F.lit("a"), 7)) < 7
    assert [one(spark, s.whole_or_real(F.lit(v))) for v in (2.0, 2.5)] == ["2", "2.5"] and one(spark, s.clamp(F.lit(3.0), 0, 1)) == 1.0
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert df.select(s.canonical_digest("b", "a")).first()[0] == df.select(s.canonical_digest("a", "b")).first()[0]


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    rows.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    rows.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # repeats arrive again
    q = events.counts(events.read(spark, f"{tmp_path}/in", 10), "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in want}
