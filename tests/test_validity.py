"""Requests of a stream, asked once for as long as their answer holds."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleaner.streaming import validity

BEGIN = datetime(2024, 1, 1)
SCHEMA = "request_key string, request string, seen timestamp"


def _run(spark, folder, rows, **settings):
    """One run of the stream over new rows (key, seconds); all that has been asked so far."""
    made = [(k, f"GET /{k}" if k else None, BEGIN + timedelta(seconds=s) if s is not None else None) for k, s in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    asked = validity.asks(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "seen", **settings)
    writer = asked.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(asked.schema).parquet(f"{folder}/out")
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
    return sorted((r["request_key"], (r["asked_at"] - BEGIN).total_seconds()) for r in done.collect()), kept


def test_keys_are_asked_once_for_each_window_of_validity(spark, tmp_path):
    folder = str(tmp_path)
    first, _ = _run(spark, folder, [("a", 100), ("a", 0), ("a", 1199), ("b", 50), ("a", 1200), ("a", 2399), ("b", 50), (None, 5), ("c", None)])
    assert first == [("a", 0), ("a", 1200), ("b", 50)]
    # state goes on where the run before ended; a late row is answered by the newest answer
    second, _ = _run(spark, folder, [("a", 2390), ("a", 600), ("a", 2400), ("b", 1249), ("b", 1250)])
    assert second == [("a", 0), ("a", 1200), ("a", 2400), ("b", 50), ("b", 1250)]


def test_state_ends_with_validity(spark, tmp_path):
    folder, settings = str(tmp_path), {"ttl": 10, "lateness": "0 seconds"}
    _run(spark, folder, [(f"k{i}", i % 5) for i in range(40)], **settings)
    _run(spark, folder, [("z", 10_000)], **settings)
    asked, kept = _run(spark, folder, [("z", 10_001), ("k1", 10_002)], **settings)
    assert [s for k, s in asked if k == "k1"] == [1, 10_002] and [s for k, s in asked if k == "z"] == [10_000]
    assert kept is None or kept <= 4


def test_answers_are_written_once_for_each_batch(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"k{i % 3}", f'{{"url": "https://api.invalid/{i % 3}"}}', BEGIN + timedelta(seconds=i)) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    asked = validity.asks(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "seen", ttl=10)
    validity.send_stream(asked, lambda r: (200, {"X": "y"}, r["url"][-1]), f"{folder}/answers", f"{folder}/state", once=True).awaitTermination()
    done = spark.read.parquet(f"{folder}/answers")
    assert done.count() == 9 and done.where("status = 200 and body = substring(request_key, 2, 1)").count() == 9
    assert done.groupBy("request_key").agg(F.min("asked_at").alias("t")).where(F.col("t") < F.lit(BEGIN + timedelta(seconds=3))).count() == 3
