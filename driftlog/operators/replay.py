"""Log replay: resume points, staged transactions with known and unknown outcomes, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from .ordered import running


def after_watermark(log: DataFrame, marks: DataFrame, by="part", offset="seq") -> DataFrame:
    """Rows after their partition's watermark, which is exclusive; all rows where it has none. marks: by, mark."""
    return log.join(marks, by, "left").filter(F.col("mark").isNull() | (F.col(offset) > F.col("mark"))).drop("mark")


def committed(staged: DataFrame, txns: DataFrame, txn="txn_id") -> DataFrame:
    """Mutations of transactions known to have committed."""
    return staged.join(txns.filter("outcome = 'committed'").select(txn), txn, "left_semi")


def behind(txns: DataFrame, by="part") -> DataFrame:
    """Partitions that a transaction of unknown outcome touches: they must be repaired before they answer."""
    return txns.filter("outcome = 'unknown'").groupBy(by).agg(F.count("*").alias("unknown"))


def positions(log: DataFrame, by="part", offset="seq") -> DataFrame:
    return log.groupBy(by).agg(F.max(offset).alias("position"))


def permitted(at: DataFrame, bounds: DataFrame, by="part") -> DataFrame:
    """Whether each bounded partition has come as far as asked for."""
    return bounds.join(at, by, "left").select(by, F.coalesce(F.col("position") >= F.col("bound"), F.lit(False)).alias("permitted"))


def going_back(log: DataFrame, by="part", offset="seq", arrival="arrival") -> DataFrame:
    """Rows whose offset isn't above the one before in arrival order: a restore that goes backwards. arrival: distinct within `by`.

    The row before is the last one up to the arrival just below, so a running value over (arrival, offset) pairs shifted by one finds it."""
    parts = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = saved(log.repartitionByRange(parts, by, arrival).withColumn("driftlog_p", F.spark_partition_id()), "arrival")
    inside = Window.partitionBy("driftlog_p", by).orderBy(arrival)
    earlier = Window.partitionBy(by).orderBy("driftlog_p")  # a row per partition
    ends = placed.groupBy(by, "driftlog_p").agg(F.max_by(offset, arrival).alias("top")).select(by, "driftlog_p", F.lag("top").over(earlier).alias("carry"))
    rows = placed.withColumn("before", F.lag(offset).over(inside)).join(ends, [by, "driftlog_p"])
    return rows.withColumn("before", F.coalesce("before", "carry")).filter(F.col(offset) <= F.col("before")).drop("carry", "driftlog_p")


def refused_watermarks(marks: DataFrame, by="part", seq="seq", mark="mark") -> DataFrame:
    """Watermarks below one that was set before: those are refused. Of marks with the same seq the lower ones come first."""
    return running(marks, [by], [seq, mark], F.col(mark), "highest").filter(F.col(mark) < F.col("highest"))


#: What a failed commit leaves. Anything else is not known to have failed.
OUTCOMES = {None: "committed", "AbortableNotCommitted": "aborted", "OutcomeUnknown": "unknown", "ProducerDead": "unknown", "ApplyFailed": "committed"}


def outcome_of(error: str | None) -> str:
    return OUTCOMES.get(error, "unknown")


def commit(action) -> str:
    """Run a commit and say its outcome: unclassified failures leave it unknown."""
    try:
        action()
    except Exception as e:
        return outcome_of(type(e).__name__)
    return outcome_of(None)


def leftover(staged: DataFrame, txns: DataFrame, by="part", txn="txn_id") -> DataFrame:
    """Staged rows that have no outcome although a later transaction of their partition began: begin() discards them, and their partition is behind."""
    latest = txns.groupBy(by).agg(F.max(txn).alias("latest"))
    open_ones = txns.filter(F.col("outcome").isNull() | (F.col("outcome") == "unknown")).join(latest, by).filter(F.col(txn) < F.col("latest")).select(txn, by)
    return staged.join(open_ones, txn)


def guarded_get(state: DataFrame, keys: DataFrame, behind_parts: DataFrame, key="key", by="part") -> DataFrame:
    """keys (key, part) -> (key, part, refused, value): a partition that is behind refuses, one that isn't gives the value, null where there is none."""
    asked = keys.select(key, by).distinct().join(behind_parts.select(by, F.lit(True).alias("late")), by, "left")
    got = asked.join(state.select(key, "value"), key, "left")
    return got.select(key, by, F.coalesce("late", F.lit(False)).alias("refused"), F.when(F.col("late").isNull(), F.col("value")).alias("value"))
