"""Event-time state: windowed, session and versioned stores, and joins over them. Stream time is the greatest event time that a store has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def _micros(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def in_time(log: DataFrame, retention_s: int, ts="ts", seq="seq", by=("part",), closed: bool = False) -> DataFrame:
    """Rows that a window store keeps on arrival: ts > stream time - retention, stream time including the row itself.

    Session stores ask it of the session's end. Versioned stores also take a row exactly at the bound: closed.

    A store's rows may span many tasks: see running()."""
    order = [seq] if isinstance(seq, str) else list(seq)
    rows = running(log, by, order, _micros(ts), "stream_us")
    bound = F.col("stream_us") - retention_s * 1_000_000
    return rows.filter(_micros(ts) >= bound if closed else _micros(ts) > bound).drop("stream_us")


def live_segments(rows: DataFrame, retention_s: int, segment_s: int, ts="ts", by=("part",)) -> DataFrame:
    """Rows in segments not yet expired: whole segments go, once stream time less the retention has left them."""
    times = rows.groupBy(*by).agg(F.max(_micros(ts)).alias("top"))
    segment = lambda us: F.floor(us / (segment_s * 1_000_000))
    kept = rows.join(times, list(by)).filter(segment(_micros(ts)) >= segment(F.col("top") - retention_s * 1_000_000))
    return kept.drop("top")


def faulty_windows(stores: DataFrame) -> DataFrame:
    """stores (name, retention_ms, window_ms, segment_ms) -> (name, fault): times that aren't positive, and windows wider than the retention,
    which could never be read whole. A null segment stands for half the retention, a minute at least."""
    segment = F.coalesce("segment_ms", F.greatest(F.expr("retention_ms div 2"), F.lit(60_000)))
    fault = F.when(~F.coalesce(F.col("retention_ms") > 0, F.lit(False)), "retention").when(~F.coalesce(F.col("window_ms") > 0, F.lit(False)), "window").when(segment < 1, "segment").when(F.col("window_ms") > F.col("retention_ms"), "too wide")
    return stores.select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def fetch(store: DataFrame, key="key", start=None, end=None, lower=None, upper=None, ts="ts") -> DataFrame:
    """Rows with lower <= key <= upper and start <= ts <= end; all bounds inclusive, None unbounded."""
    cond = F.lit(True)
    for c, lo, hi in ((F.col(key), lower, upper), (F.col(ts), start, end)):
        cond = cond if lo is None else cond & (c >= F.lit(lo))
        cond = cond if hi is None else cond & (c <= F.lit(hi))
    return store.filter(cond)


def in_store_order(rows: DataFrame, segment_s: int, ts="us", key="key", seq="seq", backward: bool = False) -> DataFrame:
    """As a window store's iterator goes: by segment, key, time and sequence number; backward is the exact reverse. ts in microseconds."""
    order = [F.floor(F.col(ts) / (segment_s * 1_000_000)), F.col(key), F.col(ts), F.col(seq)]
    return rows.orderBy(*(c.desc() if backward else c.asc() for c in order))


def restored(changelog: DataFrame, key: list[str], seq="seq", value="value") -> DataFrame:
    """A store as its changelog leaves it: the last record of each key, null values being deletes. Replaying a record twice changes nothing."""
    rest = [c for c in changelog.columns if c not in key]
    last = changelog.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("w"))
    return last.filter(F.col(f"w.{value}").isNotNull()).select(*key, "w.*")


def restored_versions(changelog: DataFrame, key="key", ts="us", seq="seq", value="value", by=("part",)) -> DataFrame:
    """A versioned store's changelog as log rows: a tombstone has no time of its own and takes the stream time at its place."""
    rows = running(changelog, by, [seq], F.col(ts), "stream")
    return rows.withColumn(ts, F.when(F.col(value).isNull(), F.col("stream")).otherwise(F.col(ts))).drop("stream")


def tumbling_count(rows: DataFrame, size: str, key="key", ts="ts", slide: str | None = None) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), size, slide) if slide else F.window(F.col(ts).cast("timestamp"), size)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def sessions(rows: DataFrame, gap_s: int, key="key", ts="ts") -> DataFrame:
    """Sessions with their first and last event's time; events exactly a gap apart share one."""
    # Not session_window: a filter on its bounds would be pushed below the merging of sessions.
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((_micros(ts) - F.lag(_micros(ts)).over(w) > gap_s * 1_000_000).cast("int"), F.lit(1))
    rows = rows.select(key, F.col(ts), new.alias("new")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).cast("timestamp").alias("session_start"), F.max(ts).cast("timestamp").alias("session_end"), F.count("*").alias("n")).drop("session")


def remove_sessions(store: DataFrame, removed: DataFrame, key="key") -> DataFrame:
    """The store without sessions of exactly that key, start and end."""
    return store.join(removed.select(key, "session_start", "session_end").distinct(), [key, "session_start", "session_end"], "left_anti")


def covered(points: DataFrame, intervals: DataFrame, key="key", at="at", lower="lower", upper="upper") -> DataFrame:
    """Points within an interval of their key, both ends inclusive, with that interval. A key's intervals are disjoint.

    The last lower bound up to a point decides, so one pass over both sides in order finds it: no pairs are made."""
    rest = [c for c in points.columns if c not in (key, at)]
    p = points.select(key, at, F.lit(1).alias("side"), F.struct(F.lit(0), *rest).alias("p"), F.lit(None).alias("i"))
    i = intervals.select(key, F.col(lower).alias(at), F.lit(0).alias("side"), F.lit(None).alias("p"), F.struct(lower, upper).alias("i"))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(i).withColumn("i", F.last("i", ignorenulls=True).over(w))
    return both.filter((F.col("side") == 1) & (F.col(f"i.{upper}") >= F.col(at))).select(key, at, *(f"p.{c}" for c in rest), "i.*")


def find_sessions(store: DataFrame, earliest_end, latest_start) -> DataFrame:
    return store.filter((F.col("session_end") >= F.lit(earliest_end)) & (F.col("session_start") <= F.lit(latest_start)))


def interval_join(left: DataFrame, right: DataFrame, within_s: int, key="key", lts="l_ts", rts="r_ts") -> DataFrame:
    """Pairs of a key at most so far apart. Time is cut into cells of that length, so a hot key's rows spread over cells: each left row meets three."""
    width = within_s * 1_000_000
    cell = lambda c: F.floor(_micros(c) / width)
    l = left.withColumn("cell", F.explode(F.sequence(cell(lts) - 1, cell(lts) + 1)))
    r = right.withColumn("cell", cell(rts))
    return l.join(r, [key, "cell"]).filter(F.abs(_micros(lts) - _micros(rts)) <= width).drop("cell")


def versions(log: DataFrame, key="key", ts="ts", seq="seq", value="value") -> DataFrame:
    """(key, valid_from, value, valid_to): the last write of each (key, ts), valid until the next; null values are tombstones."""
    one = log.groupBy(key, F.col(ts).alias("valid_from")).agg(F.max_by(F.struct(value), seq).alias("v")).select(key, "valid_from", f"v.{value}")
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def current(vers: DataFrame, value="value") -> DataFrame:
    return vers.filter(F.col("valid_to").isNull() & F.col(value).isNotNull())


def as_of(vers: DataFrame, at, value="value") -> DataFrame:
    at = F.lit(at)
    return vers.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)) & F.col(value).isNotNull())


def in_force(vers: DataFrame, start, end, value="value") -> DataFrame:
    """Versions in force at some time of [start, end]; one that ends exactly at start isn't; tombstones aren't returned."""
    return vers.filter((F.col("valid_from") <= F.lit(end)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(start))) & F.col(value).isNotNull())


def keep_history(vers: DataFrame, top: DataFrame, retention_s: int, segment_s: int) -> DataFrame:
    """The latest version of each key, and history in live segments. top: one row, the stream time `top`."""
    segment = lambda us: F.floor(us / (segment_s * 1_000_000))
    live = segment(_micros("valid_from")) >= segment(_micros("top") - retention_s * 1_000_000)
    return vers.join(F.broadcast(top), F.lit(True)).filter(F.col("valid_to").isNull() | live).drop("top")


def asof_join(left: DataFrame, vers: DataFrame, key="key", ts="ts", value="value") -> DataFrame:
    """Each left row with the version valid at its time; none before the first version or under a tombstone.

    One shuffle of both sides by key and one pass in time order: no pairs are made."""
    cols = [c for c in left.columns if c not in (key, ts)]
    l = left.select(key, ts, F.lit(1).alias("side"), F.struct(*cols).alias("l"), F.lit(None).alias("v"))
    r = vers.select(key, F.col("valid_from").alias(ts), F.lit(0).alias("side"), F.lit(None).alias("l"), F.struct(F.col(value).alias("as_of_value")).alias("v"))
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("v", F.last("v", ignorenulls=True).over(w))
    return both.filter((F.col("side") == 1) & F.col("v.as_of_value").isNotNull()).select(key, ts, "l.*", "v.as_of_value")
