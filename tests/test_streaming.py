from sigloom.streaming.windows import windowed_stats


def test_windowed_stats(spark, tmp_path):
    data = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(data).selectExpr("cast(ts as timestamp) ts", "user_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_stats(stream, "1 day").writeStream.outputMode("append").format("memory").queryName("stats").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select sum(n) from stats").first()[0]
    assert 0 < got <= events.count()
