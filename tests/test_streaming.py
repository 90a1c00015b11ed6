from pyspark.sql import functions as F

from assayer.streaming.rules import broken_per_window, split_stream


def test_rules_on_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    rules = {"small": F.col("value") < 10, "view": F.col("event_type") == "view"}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    clean, bad = split_stream(stream, rules)
    queries = [
        clean.writeStream.format("memory").queryName("clean_rows").trigger(availableNow=True).start(),
        bad.writeStream.format("memory").queryName("bad_rows").trigger(availableNow=True).start(),
        broken_per_window(stream, "ts", rules, "1 day", "400 days").writeStream.format("memory").queryName("broken").outputMode("complete").trigger(availableNow=True).start(),
    ]
    for q in queries:
        q.awaitTermination(120)
    want_clean, want_bad = split_stream(batch, rules)
    assert spark.table("clean_rows").count() == want_clean.count()
    assert sorted(map(tuple, spark.table("bad_rows").select("event_id", F.array_join("_reasons", ",")).collect())) == sorted(map(tuple, want_bad.select("event_id", F.array_join("_reasons", ",")).collect()))
    want = want_bad.select(F.window("ts", "1 day").start.alias("start"), F.explode("_reasons").alias("rule")).groupBy("start", "rule").count()
    assert sorted(map(tuple, spark.table("broken").collect())) == sorted(map(tuple, want.collect()))
