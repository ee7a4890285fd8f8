"""Running values in an order that spans partitions: a range sort, one value a partition, and windows that see one partition each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def running(rows: DataFrame, by, order: list, value: Column | list[Column], name: str | list[str], how: str = "max") -> DataFrame:
    """rows with `name`: of all rows of the same `by` up to each in order, the greatest value ("max"), the sum ("sum", 0 of nothing) or the
    last that isn't null ("last"). "max" and "sum" take lists of values and names too.

    A store's rows need not fit one task: they are range-partitioned by (by, order) and written, so that both passes see the same
    partitions; each partition then takes up what those before it end with."""
    by = list(by)
    names, values = ([name], [value]) if isinstance(name, str) else (name, value)
    if how == "last" and len(names) > 1:
        raise ValueError("one value at a time where the last is asked for")
    held = [f"driftlog_v{i}" for i in range(len(names))]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.withColumns(dict(zip(held, values))).repartitionByRange(parts, *by, *order).withColumn("driftlog_p", F.spark_partition_id())
    placed = saved(placed, "ordered")
    up_to = Window.partitionBy("driftlog_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("driftlog_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    if how == "last":
        known = placed.filter("driftlog_v0 IS NOT NULL")
        found = known.groupBy(*by, "driftlog_p").agg(F.max_by("driftlog_v0", F.struct(*order)).alias("top0"))
        ends = placed.select(*by, "driftlog_p").distinct().join(found, [*by, "driftlog_p"], "left")
        total = lambda c, w: F.last(c, ignorenulls=True).over(w)
        out = lambda here, carry: F.coalesce(here, carry)
    else:
        agg = {"max": F.max, "sum": F.sum}[how]
        ends = placed.groupBy(*by, "driftlog_p").agg(*(agg(v).alias(f"top{i}") for i, v in enumerate(held)))
        total = lambda c, w: agg(c).over(w)
        out = F.greatest if how == "max" else lambda here, carry: F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
    ends = ends.select(*by, "driftlog_p", *(total(f"top{i}", earlier).alias(f"driftlog_carry{i}") for i in range(len(names))))
    both = placed.withColumns({f"driftlog_here{i}": total(v, up_to) for i, v in enumerate(held)}).join(ends, [*by, "driftlog_p"])
    found = [out(F.col(f"driftlog_here{i}"), F.col(f"driftlog_carry{i}")).alias(n) for i, n in enumerate(names)]
    return both.select(*rows.columns, *found)
