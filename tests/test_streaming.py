from tallyfold import streaming


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = streaming.stage_timings(streaming.read_events(spark, src, events.schema).drop("ts"))
    q = stream.writeStream.format("memory").queryName("timings").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["stage"]: (r["runs"], r["ok"]) for r in spark.table("timings").collect()}
    assert got == {r["stage"]: (r["runs"], r["ok"]) for r in streaming.stage_timings(events).collect()}
