"""Mutation logs and the state that they leave: last writer wins, deletes of points and ranges, floors, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import in_range
from ..sources.tables import saved
from .ordered import running

#: Parts of the key space in which range deletes are made disjoint.
BUCKETS = 256


def _order(seq) -> Column:
    return F.struct(*seq) if isinstance(seq, (list, tuple)) else F.col(seq)


def newest(log: DataFrame, key, seq) -> DataFrame:
    """The row of each key with the greatest seq (a column, or several in order). Combines before its one shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), _order(seq)).alias("w")).select(*keys, "w.*")


def live_state(log: DataFrame, key="key", seq="seq", op="op") -> DataFrame:
    """Keys whose newest mutation is a put."""
    return newest(log, key, seq).filter(F.col(op) == "put")


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (lower, upper, range_seq) -> disjoint ones with the greatest seq that covers each. Empty and inverted ones do nothing.

    The key space is cut into BUCKETS parts with about as many lower bounds each; a range goes, clipped, to every part that it meets, and each part
    is swept once in key order. Rows are range deletes, not data: a wide range costs BUCKETS of them at most."""
    ranges = saved(ranges.filter("lower < upper").select("lower", "upper", "range_seq"), "ranges")
    cuts = [r.lower for r in ranges.select("lower").distinct().sort("lower").collect()] if ranges.count() <= BUCKETS else ranges.select(F.percentile_approx("lower", [i / BUCKETS for i in range(1, BUCKETS)]).alias("c")).first().c
    bounds = sorted(set(cuts))
    if not bounds:
        return ranges
    array = F.array(*(F.lit(c) for c in bounds))
    part = F.size(F.filter(array, lambda b: b <= F.col("lower")))
    last = F.size(F.filter(array, lambda b: b < F.col("upper")))
    dealt = ranges.withColumn("part", F.explode(F.sequence(part, F.greatest(part, last))))
    lo, hi = F.try_element_at(array, F.when(F.col("part") > 0, F.col("part"))), F.try_element_at(array, F.col("part") + 1)
    dealt = dealt.withColumns({"lower": F.greatest("lower", lo), "upper": F.least("upper", hi)}).filter("lower < upper")

    def sweep(rows):
        import heapq

        import pandas as pd

        rows = rows.sort_values("lower")
        edges = sorted({*rows.lower, *rows.upper})
        todo, heap, out = list(zip(rows.lower, rows.upper, rows.range_seq)), [], []
        at = 0
        for a, b in zip(edges, edges[1:]):
            while at < len(todo) and todo[at][0] <= a:
                heapq.heappush(heap, (-todo[at][2], todo[at][1]))
                at += 1
            while heap and heap[0][1] <= a:
                heapq.heappop(heap)
            if heap:
                if out and out[-1][1] == a and out[-1][2] == -heap[0][0]:
                    out[-1][1] = b
                else:
                    out.append([a, b, -heap[0][0]])
        return pd.DataFrame(out, columns=["lower", "upper", "range_seq"])

    return dealt.groupBy("part").applyInPandas(sweep, ranges.schema)


def delete_ranges(entries: DataFrame, ranges: DataFrame, key="key", seq="seq") -> DataFrame:
    """Entries that no later range delete covers. ranges: lower, upper (exclusive), range_seq; empty and inverted ones do nothing.

    Disjoint ranges and entries go through one range sort by key: the last range that begins up to a key decides. No pairs are made, and a
    hot key or a wide range falls into no single task."""
    cuts = disjoint_ranges(ranges)
    rest = [c for c in entries.columns if c != key]
    e = entries.select(F.col(key).alias("k"), F.lit(1).alias("side"), F.struct(F.lit(0), *rest).alias("e"), F.lit(None).alias("r"))
    r = cuts.select(F.col("lower").alias("k"), F.lit(0).alias("side"), F.lit(None).alias("e"), F.struct("upper", "range_seq").alias("r"))
    both = running(e.unionByName(r).withColumn("one", F.lit(0)), ["one"], ["k", "side"], F.col("r"), "last_r", how="last")
    gone = (F.col("k") < F.col("last_r.upper")) & (F.col("last_r.range_seq") > F.col(f"e.{seq}"))
    return both.filter((F.col("side") == 1) & ~F.coalesce(gone, F.lit(False))).select(F.col("k").alias(key), *(f"e.{c}" for c in rest)).select(entries.columns)


def floor_of(log: DataFrame, key="key", op="op") -> DataFrame:
    """One row: the truncation floor, the greatest key of all truncations."""
    return log.filter(F.col(op) == "truncate").agg(F.max(key).alias("floor"))


def above_floor(state: DataFrame, floor: DataFrame, key="key") -> DataFrame:
    """Entries not below the floor (one row; null: no floor)."""
    return state.join(F.broadcast(floor), F.col("floor").isNull() | (F.col(key) >= F.col("floor")), "left_semi")


def accepted_batches(log: DataFrame, bad: Column, batch="batch") -> DataFrame:
    """Mutations of batches without a bad one: a batch lands as a whole or not at all."""
    spoilt = log.filter(bad).select(batch).distinct()
    return log.join(spoilt, batch, "left_anti")


def put_if_absent(candidates: DataFrame, state: DataFrame, key="key", seq="seq") -> DataFrame:
    """What putIfAbsent writes: the earliest candidate of each key that the state lacks."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.join(state.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), _order(seq)).alias("w"))
    return first.select(key, "w.*")


def deletes_with_old(log: DataFrame, key="key", seq="seq", op="op", value="value") -> DataFrame:
    """Every point delete with the value that it removes, null where there was none."""
    w = Window.partitionBy(key).orderBy(seq)
    old = log.withColumn("old_value", F.when(F.lag(op).over(w) == "put", F.lag(value).over(w)))
    return old.filter(F.col(op) == "delete").select(key, seq, "old_value")


def changelog(log: DataFrame, key="key", seq="seq", op="op", value="value") -> DataFrame:
    """What a keyed running sum emits, an update a mutation: (key, seq, total). A delete emits null and the next put starts anew."""
    gone = (F.col(op) == "delete").cast("int")
    lives = log.withColumn("life", F.sum(gone).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(F.when(F.col(op) == "put", F.col(value))).over(Window.partitionBy(key, "life").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return lives.select(key, seq, F.when(F.col(op) == "put", total).alias("total"))


def write_batch(spark, ops: list[tuple], batch: int) -> DataFrame:
    """A batch of ("put", key, value), ("delete", key) and ("delete_range", lower, upper) as log rows, in order."""
    rows = [(batch, i, o[0], o[1], o[2] if o[0] == "delete_range" else None, o[2] if o[0] == "put" else None) for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, "batch long, op_idx int, op string, key binary, upper binary, value binary")


def interval_union(intervals: DataFrame, lower="lower", upper="upper", by: tuple = ()) -> DataFrame:
    """Disjoint intervals that cover the same points; touching ones merge, empty ones go. Give `by`, as one group is one task."""
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(lower, upper)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.filter(F.col(lower) < F.col(upper)).withColumn("new", F.coalesce((F.col(lower) > F.max(upper).over(before)).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper)).drop("island")


def clip(intervals: DataFrame, lo, hi, lower="lower", upper="upper") -> DataFrame:
    """Intervals cut to [lo, hi); what lies outside goes."""
    cut = intervals.withColumns({lower: F.greatest(F.col(lower), F.lit(lo)), upper: F.least(F.col(upper), F.lit(hi))})
    return cut.filter(F.col(lower) < F.col(upper))


def scan(state: DataFrame, key="key", lower=None, upper=None, reverse=False) -> DataFrame:
    """Entries of [lower, upper) in key order."""
    return state.filter(in_range(F.col(key), lower, upper)).orderBy(F.desc(key) if reverse else F.asc(key))


def next_batch(state: DataFrame, n: int, key="key", after=None, reverse=False) -> DataFrame:
    """The iterator's next n entries beyond a key, in order: what a batched iterator copies at a time."""
    cond = F.lit(True) if after is None else (F.col(key) < F.lit(after) if reverse else F.col(key) > F.lit(after))
    return state.filter(cond).orderBy(F.desc(key) if reverse else F.asc(key)).limit(n)


def keep_duplicates(log: DataFrame, op="op") -> DataFrame:
    """A window store that retains duplicates: every put is an entry of its own, told by its sequence number; deletes do nothing."""
    return log.filter(F.col(op) == "put")


def refused_below_floor(log: DataFrame, key="key", seq="seq", cut="cut") -> DataFrame:
    """Writes below the floor that truncations (rows with a cut) before them have set; they are refused. The floor is one for the whole store."""
    rows = running(log.withColumn("one", F.lit(0)), ["one"], [seq], F.col(cut), "floor")
    return rows.filter(F.col(cut).isNull() & (F.col(key) < F.col("floor"))).drop("one")


def null_mutations(staged: DataFrame, value="value") -> DataFrame:
    """Staged rows that are refused: a mutation without a value says neither put nor delete."""
    return staged.filter(F.col(value).isNull())


def multi_get(state: DataFrame, keys: DataFrame, key="key") -> DataFrame:
    """Entries of a set of keys; absent keys have no row. Spark broadcasts the keys where they are few."""
    return state.join(keys.select(key).distinct(), key, "left_semi")


def union_logs(*logs: DataFrame) -> DataFrame:
    """Sources of a merge as one log: recency is in seq, not in the order of sources."""
    return reduce(DataFrame.unionByName, logs)
