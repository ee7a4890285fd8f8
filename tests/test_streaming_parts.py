from pyspark.sql import functions as F

from driftlog.streaming.topologies import event_stream, keyed_sum, run_in_turns, run_to_end, tumbling


def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    rows = spark.range(6).selectExpr("id AS user_id", "1.5D AS value", "TIMESTAMP_NTZ'2026-01-01 00:00:00' AS ts")
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = run_to_end(keyed_sum(event_stream(spark, str(tmp_path), "events.parquet", rows.schema)), "complete").collect()
    assert sorted((r.user_id, r.cents) for r in got) == [(i, 150) for i in range(6)]


def test_rows_behind_the_watermark_of_earlier_turns_are_late(spark):
    """The watermark is the latest time of earlier turns less an hour: 04:00, then 08:00. 00:20 is late, 04:30 isn't, 09:00 stays open."""
    turn = lambda *hours: spark.createDataFrame([(1, f"2026-01-01 {h}:00") for h in hours], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("at"))
    got = run_in_turns([turn("00:10", "05:00"), turn("00:20", "04:30", "09:00")], lambda s: tumbling(s, grace="1 hour"))
    hours = {(r.start_us // 3600000000 % 24, r.n) for r in got.collect()}
    assert hours == {(0, 1), (4, 1), (5, 1)}
    assert run_in_turns([turn("00:10")], lambda s: tumbling(s, grace="1 hour")).count() == 0
