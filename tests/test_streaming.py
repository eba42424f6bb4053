from tracewright.streaming import windows


def test_streams(spark, tmp_path, data):
    source = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("minutes", windows.minute_counts(stream(), "ts")), ("sessions", windows.sessions(stream(), "user_id", "ts"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0
    seen = []
    windows.serve(windows.without_repeats(stream(), ["event_id"], "ts"), lambda batch, i: seen.append(batch.count()), str(tmp_path / "serve")).awaitTermination()
    assert sum(seen) == source.select("event_id").distinct().count()
