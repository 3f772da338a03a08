"""The trail as a stream equals the batch on closed windows; late and repeated events are left out."""

import datetime as dt

from pyspark.sql import functions as F

from evidentia.streaming import trail


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in stream.sparkSession.table(name).collect()}


def events(spark, path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    first = [(1, "a", at(1)), (2, "a", at(2)), (2, "a", at(2)), (3, "b", at(30)), (4, "a", at(31))]
    # A batch drops what is later than the watermark that the batch before it ran with.
    second, third = [(7, "b", at(30.5))], [(5, "a", at(3)), (6, "b", at(200))]
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, "event_id long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    schema = "event_id long, kind string, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_daily_stream_equals_batch_on_closed_days(spark, tmp_path):
    stream = events(spark, tmp_path)
    found = run(trail.daily_counts(trail.watermarked(stream, "ts", "event_id"), "ts", "kind"), "daily")
    batch = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path)).filter("event_id <> 5").dropDuplicates(["event_id"])
    closed = {tuple(r) for r in trail.daily_counts(batch, "ts", "kind").filter("day < timestamp'2024-01-09'").collect()}
    assert found == closed and found


def test_session_stream(spark, tmp_path):
    stream = events(spark, tmp_path)
    found = run(trail.session_windows(trail.watermarked(stream, "ts", "event_id"), "kind", "ts", "2 hours"), "sessions")
    assert {(k, n) for k, _, _, n in found} == {("a", 2), ("a", 1), ("b", 2)}


def test_gap_at_the_limit_stays(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(60)), (3, "u", at(121))], "id int, u string, ts timestamp")
    assert [r["session_no"] for r in trail.sessions(rows, "u", "ts", 60, "id").orderBy("id").collect()] == [1, 1, 2]


def test_states(spark):
    assert spark.range(1).select(trail.event_state(F.lit("x"), {"x": "open"}).alias("s")).first()["s"] == "open"
