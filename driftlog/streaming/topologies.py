"""Structured Streaming forms of the event-time queries. Each runs over what is there and then ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The table of that name in a folder, one file or a folder of part files, as a stream with `at`, the event time as a timestamp."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    read = spark.readStream.schema(schema)
    rows = read.parquet(f"{folder}/{name}") if parts else read.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def _drain(df: DataFrame, mode: str, base: str) -> None:
    """Run a streaming query over what is there. Batches go to the shared folder under their number, so a batch that is run again replaces itself."""

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'last' if mode == 'complete' else f'batch={n}'}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all there is; its last complete result, or all that it appended."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _drain(df, mode, base)
    return spark.read.schema(df.schema).parquet(f"{base}/out/{'last' if mode == 'complete' else '*'}")


def run_in_turns(arrivals: list[DataFrame], make) -> DataFrame:
    """All that make(stream) appends while its input arrives in turns. Each turn is a run of its own, which goes on from the checkpoint
    of the one before: state and watermark outlive the restart, and a row behind the watermark of earlier turns is late."""
    spark = arrivals[0].sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{base}/in")
        out = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        _drain(out, "append", base)
    return spark.read.schema(out.schema).parquet(f"{base}/out/*")


def keyed_sum(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def tumbling(events: DataFrame, size: str = "1 hour", grace: str = "0 seconds") -> DataFrame:
    return events.withWatermark("at", grace).groupBy("user_id", F.window("at", size).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def session_counts(events: DataFrame, gap_s: int = 7200) -> DataFrame:
    w = F.session_window("at", f"{gap_s} seconds").alias("w")
    return events.withWatermark("at", "0 seconds").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), (F.unix_micros("w.end") - gap_s * 1_000_000).alias("end_us"), "n")


def joined(events: DataFrame, within_s: int = 600) -> DataFrame:
    """Clicks and purchases of a user at most so far apart."""
    side = lambda kind, p: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_user"), F.col("event_id").alias(f"{p}_id"), F.col("at").alias(f"{p}_at")).withWatermark(f"{p}_at", "0 seconds")
    near = F.expr(f"c_user = p_user AND p_at BETWEEN c_at - INTERVAL {within_s} SECONDS AND c_at + INTERVAL {within_s} SECONDS")
    return side("click", "c").join(side("purchase", "p"), near).select(F.col("c_user").alias("user_id"), "c_id", "p_id")
