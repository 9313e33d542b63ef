from datetime import UTC, datetime

from callweave.streaming import live

at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)


def test_late_rows_are_kept_apart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "frame long, event_time timestamp"
    for k, rows in enumerate([[(2, at(300)), (3, at(290)), (4, None)], [(1, at(0)), (5, at(301))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.write_with_late_rows(stream, f"{tmp_path}/out", f"{tmp_path}/late", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.frame for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 3, 4, 5]
    assert [r.frame for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [1]


def test_unanswered_requests_on_a_stream(spark, tmp_path):
    requests = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, at(6)), (9, at(5000))], "id long, at timestamp")
    answers = spark.createDataFrame([(1, at(3)), (2, at(30)), (9, at(5001))], "id long, answered_at timestamp")
    requests.coalesce(1).write.parquet(f"{tmp_path}/r")
    answers.coalesce(1).write.parquet(f"{tmp_path}/a")
    r = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/r")
    a = spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/a")
    q = live.unanswered(r, a, "id").writeStream.format("memory").queryName("open_requests").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x.id for x in spark.table("open_requests").collect()) == [2, 3]
