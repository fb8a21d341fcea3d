"""Job events by window: a stream gives what the batch gives, and late events up to the watermark count."""

from datetime import datetime, timedelta

from quarry.streaming import jobs

SCHEMA = "ts timestamp, event_type string"
START = datetime(2024, 1, 1)


def rows(*minutes):
    return [(START + timedelta(minutes=m), "queued" if m % 2 else "failed") for m in minutes]


def test_a_stream_counts_as_the_batch_does(spark, tmp_path):
    source, at = tmp_path / "in", str(tmp_path / "checkpoint")
    parts = [rows(1, 2, 3, 61, 62), rows(5, 130), rows(59, 131, 200), rows(500)]
    query = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"p{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        counted = jobs.status_counts(stream)
        query = counted.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the window of 500 is still open; all others have passed the watermark
    want = {(r.window_start, r.event_type): r.n for r in jobs.status_counts(spark.createDataFrame([r for p in parts[:3] for r in p], SCHEMA)).collect()}
    assert got == want


def test_batch_of_nothing(spark):
    assert jobs.status_counts(spark.createDataFrame([], SCHEMA)).count() == 0
