
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import has_prefix
from ..operators import layout as L
from ..operators import log as M
from ..operators import replay as R
from ..operators import temporal as S
from ..sources.tables import StateTable, saved, shared_dir, table
from ..streaming import topologies as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3600
#: A key range, a time range and a time, in microseconds, that several queries ask for.
LOW, HIGH = 10, 50
T0, T1 = 1704412800000000, 1705017600000000  # 2024-01-05 and 2024-01-12


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def log(spark, sf_dir):
    """Events as a mutation log: user_id is the key, errors delete, event_id is the order; four partitions; arrival is out of order by up to 50."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "event_type", "value", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.pmod("user_id", F.lit(4)).alias("part"), (F.col("event_id") + (F.col("event_id") * 7919) % 50).alias("arrival"))


LOG = """log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type, value, ts,
  epoch_us(ts) AS us, user_id % 4 AS part, event_id + (event_id * 7919) % 50 AS arrival FROM events)"""
STATE = f"""{LOG}, state AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put')"""


def state(spark, sf_dir):
    return M.live_state(log(spark, sf_dir)).select("key", "value", "seq")


@query("lww_state", f"WITH {STATE} SELECT * FROM state")  # W1 W2 F1 F2
def lww_state(spark, d):
    return state(spark, d)


def _scan(name, where, **bounds):
    query(name, f"WITH {STATE} SELECT * FROM state WHERE {where}")(lambda spark, d: M.scan(state(spark, d), **bounds))


query("point_get", f"WITH {STATE} SELECT * FROM state WHERE key = 7")(lambda spark, d: state(spark, d).filter("key = 7"))  # R1 R2 R15
_scan("full_scan", "true")  # R4
_scan("lower_bound_scan", "key >= 50", lower=50)  # R5
_scan("range_scan", "key >= 10 AND key < 50", lower=LOW, upper=HIGH)  # R6 R16
_scan("reverse_range_scan", "key >= 10 AND key < 50", lower=LOW, upper=HIGH, reverse=True)  # R8 R11
query("kv_range_inclusive", f"WITH {STATE} SELECT * FROM state WHERE key BETWEEN 10 AND 50")(lambda spark, d: S.fetch(state(spark, d).withColumn("ts", F.lit(0)), lower=LOW, upper=HIGH).drop("ts"))  # R10


@query("prefix_scan", "SELECT url, page_id FROM pages WHERE starts_with(url, 'https://')")  # R7
def prefix_scan(spark, d):
    return table(spark, d, "pages").filter(has_prefix(F.col("url"), "https://")).select("url", "page_id")


@query("composite_prefix_scan", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")  # R7 over (conv_id, turn)
def composite_prefix_scan(spark, d):
    return table(spark, d, "conversations").filter("conv_id = 3").select("conv_id", "turn", "role").orderBy("turn")


@query("multi_get", f"WITH {STATE} SELECT * FROM state WHERE key IN (SELECT s_suppkey FROM supplier)")  # R3 P9
def multi_get(spark, d):
    return M.multi_get(state(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query("entry_count_bound", f"WITH {STATE} SELECT (SELECT count(*) FROM log) AS bound, (SELECT count(*) FROM state) AS exact")  # R12
def entry_count_bound(spark, d):
    return M.newest(log(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op")), "key", "n").agg(F.sum("n").alias("bound"), F.count_if(F.col("op") == "put").alias("exact"))


RANGES = [(10, 20, 500), (15, 40, 9000), (0, 5, 9900), (60, 60, 99999), (90, 70, 99999), (100, 110, 100)]


@query("range_delete", f"WITH {STATE}, r(lower, upper, range_seq) AS (VALUES {', '.join(map(str, RANGES))}) SELECT * FROM state s WHERE NOT EXISTS (SELECT 1 FROM r WHERE lower <= s.key AND s.key < upper AND range_seq > s.seq)")  # W3
def range_delete(spark, d):
    return M.delete_ranges(state(spark, d), spark.createDataFrame(RANGES, "lower long, upper long, range_seq long"))


@query("interval_union", """WITH i AS (SELECT l_suppkey, epoch_us(l_shipdate) AS lower, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS upper FROM lineitem),
 n AS (SELECT *, coalesce(CAST(lower > max(upper) OVER (PARTITION BY l_suppkey ORDER BY lower, upper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 1) AS new FROM i WHERE lower < upper),
 g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lower, upper ROWS UNBOUNDED PRECEDING) AS island FROM n)
 SELECT l_suppkey, min(lower) AS lower, max(upper) AS upper FROM g GROUP BY l_suppkey, island""")  # F5
def interval_union(spark, d):
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    i = table(spark, d, "lineitem").select("l_suppkey", us.alias("lower"), (us + F.col("l_quantity").cast("long") * 86400000000).alias("upper"))
    return M.interval_union(i, by=("l_suppkey",))


@query("truncate_below", f"WITH {STATE}, f AS (SELECT max(key // 3) AS floor FROM log WHERE event_type = 'signup') SELECT s.* FROM state s, f WHERE floor IS NULL OR key >= floor")  # W6 F3
def truncate_below(spark, d):
    cuts = log(spark, d).filter("event_type = 'signup'").select(F.expr("key div 3").alias("key"), F.lit("truncate").alias("op"))
    return M.above_floor(state(spark, d), M.floor_of(cuts))


BATCH = "((event_id // 8) * 7919) % 1000003"


@query("batch_order", f"""SELECT user_id AS key, value, batch, op_idx FROM (SELECT *, {BATCH} AS batch, event_id % 8 AS op_idx, row_number() OVER (PARTITION BY user_id ORDER BY {BATCH} DESC, event_id % 8 DESC) AS rn FROM events)
 WHERE rn = 1 AND event_type <> 'error'""")  # W4 W5 W15
def batch_order(spark, d):
    rows = log(spark, d).select("key", "value", "op", (F.expr("seq div 8") * 7919 % 1000003).alias("batch"), (F.col("seq") % 8).alias("op_idx"))
    return M.live_state(rows, seq=["batch", "op_idx"]).select("key", "value", "batch", "op_idx")


@query("batch_atomicity", f"""WITH {LOG}, ok AS (SELECT * FROM log WHERE seq // 8 NOT IN (SELECT seq // 8 FROM log WHERE op = 'put' AND key < 3))
 SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ok) WHERE rn = 1 AND op = 'put'""")  # W4: a put below the floor spoils its batch
def batch_atomicity(spark, d):
    rows = log(spark, d).withColumn("batch", F.expr("seq div 8"))
    return M.live_state(M.accepted_batches(rows, (F.col("op") == "put") & (F.col("key") < 3))).select("key", "value", "seq")


@query("put_if_absent", f"""WITH {STATE}, c AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT key FROM state))
 SELECT c_custkey AS key, o_orderkey AS seq, o_totalprice AS value FROM c WHERE rn = 1""")  # W14
def put_if_absent(spark, d):
    new = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return M.put_if_absent(new, state(spark, d))


@query("delete_returning_old", f"""WITH {LOG}, w AS (SELECT *, lag(op) OVER k AS po, lag(value) OVER k AS pv FROM log WINDOW k AS (PARTITION BY key ORDER BY seq))
 SELECT key, seq, CASE WHEN po = 'put' THEN pv END AS old_value FROM w WHERE op = 'delete'""")  # W16
def delete_returning_old(spark, d):
    return M.deletes_with_old(log(spark, d))


SUM = "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id"
TUMBLE = "SELECT user_id, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL"
GAPS = """s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, epoch_us(ts) AS us,
 coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 7200000000 AS INT), 1) AS new FROM events)),
 sessions AS (SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, g)"""
JOIN = """SELECT c.user_id, c.event_id AS c_id, p.event_id AS p_id FROM events c JOIN events p ON c.user_id = p.user_id AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 600000000
 WHERE c.event_type = 'click' AND p.event_type = 'purchase'"""


@query("running_sum", SUM)  # T1
def running_sum(spark, d):
    return ST.keyed_sum(table(spark, d, "events"))


@query("tumbling_count", TUMBLE)  # T2
def tumbling_count(spark, d):
    return S.tumbling_count(table(spark, d, "events"), "1 hour", "user_id").select("user_id", F.unix_micros("window_start").alias("start_us"), "n")


@query("session_count", f"WITH {GAPS} SELECT * FROM sessions")  # T3
def session_count(spark, d):
    return S.sessions(table(spark, d, "events"), 2 * HOUR, "user_id").select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("find_sessions", f"WITH {GAPS} SELECT * FROM sessions WHERE end_us >= {T0} AND start_us <= {T1}")  # SS5 SS6
def find_sessions(spark, d):
    s = session_count(spark, d).withColumnsRenamed({"start_us": "session_start", "end_us": "session_end"})
    return S.find_sessions(s, T0, T1).withColumnsRenamed({"session_start": "start_us", "session_end": "end_us"})


@query("fetch_session", f"WITH {GAPS} SELECT * FROM sessions WHERE user_id = 7")  # SS3 SS4 SS8
def fetch_session(spark, d):
    return session_count(spark, d).filter("user_id = 7")


@query("interval_join", JOIN)  # T4
def interval_join(spark, d):
    e = table(spark, d, "events")
    side = lambda kind, p: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    return S.interval_join(side("click", "c"), side("purchase", "p"), 600, "user_id", "c_ts", "p_ts").select("user_id", "c_id", "p_id")


query("stream_running_sum", SUM)(lambda spark, d: ST.run_to_end(ST.keyed_sum(_stream(spark, d)), "complete"))
query("stream_tumbling_count", TUMBLE)(lambda spark, d: ST.run_to_end(ST.tumbling(_stream(spark, d)), "complete"))
query("stream_session_count", f"WITH {GAPS} SELECT * FROM sessions")(lambda spark, d: ST.run_to_end(ST.session_counts(_stream(spark, d)), "complete"))
query("stream_interval_join", JOIN)(lambda spark, d: ST.run_to_end(ST.joined(_stream(spark, d)), "append").select("user_id", "c_id", "p_id"))


GRACE_DAYS = 5


@query("stream_late_count", f"""WITH b AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_id * 3 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS turn FROM events),
 top AS (SELECT turn, max(us) // 1000 * 1000 - {GRACE_DAYS * 86400000000} AS mark FROM b GROUP BY turn), m AS (SELECT turn, coalesce(max(mark) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM top)
 SELECT user_id, start_us, count(*) AS n FROM b JOIN m USING (turn) WHERE start_us + 3600000000 > before AND start_us + 3600000000 <= (SELECT max(mark) FROM top) GROUP BY ALL""")  # 2.11 grace, late data: every seventh event comes a turn late
def stream_late_count(spark, d):
    """Windows closed by the last turn, without what came after their close."""
    e = table(spark, d, "events")
    end = F.broadcast(e.agg((F.max("event_id") + 1).alias("end")))  # one row
    e = e.join(end).withColumn("turn", F.expr("event_id * 3 div end + if(event_id % 7 = 0, 1, 0)"))
    e = e.select("user_id", F.col("ts").cast("timestamp").alias("at"), "turn")
    return ST.run_in_turns([e.filter(F.col("turn") == n) for n in range(4)], lambda s: ST.tumbling(s, grace=f"{GRACE_DAYS} days"))


def _stream(spark, d):
    return ST.event_stream(spark, d, "events.parquet", table(spark, d, "events").schema)


LATE = f"""{LOG}, st AS (SELECT *, max(us) OVER (PARTITION BY part ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS stream FROM log),
 kept AS (SELECT * FROM st WHERE us > stream - 3600000000)"""


@query("late_drop", f"WITH {LATE} SELECT key, seq FROM kept")  # WS1
def late_drop(spark, d):
    return _in_time(spark, d).select("key", "seq")


def _in_time(spark, d):
    return S.in_time(log(spark, d).withColumn("arrival", F.struct("arrival", "seq")), HOUR, seq="arrival")


@query("window_retention", f"WITH {LATE}, top AS (SELECT part, max(us) AS top FROM kept GROUP BY part) SELECT key, seq FROM kept JOIN top USING (part) WHERE us // 43200000000 >= (top - 86400000000) // 43200000000")  # WS7
def window_retention(spark, d):
    return S.live_segments(_in_time(spark, d), 24 * HOUR, 12 * HOUR).select("key", "seq")


def _fetch(name, where, **bounds):
    query(name, f"WITH {LOG} SELECT key, us, seq, value FROM log WHERE op = 'put' AND {where}")(lambda spark, d: S.fetch(log(spark, d).filter("op = 'put'"), ts="us", **bounds).select("key", "us", "seq", "value"))


_fetch("window_fetch", f"key = 7 AND us BETWEEN {T0} AND {T1}", lower=7, upper=7, start=T0, end=T1)  # WS2 WS3 WS11
_fetch("window_key_range", f"key BETWEEN 10 AND 50 AND us BETWEEN {T0} AND {T1}", lower=LOW, upper=HIGH, start=T0, end=T1)  # WS4
_fetch("window_fetch_all", f"us BETWEEN {T0} AND {T1}", start=T0, end=T1)  # WS5 WS6 WS12

VERS = f"""{LOG}, vers AS (SELECT key, us AS valid_from, CASE WHEN event_type = 'view' THEN value END AS value, lead(us) OVER (PARTITION BY key ORDER BY us) AS valid_to FROM log WHERE event_type IN ('view', 'signup'))"""


def _versions(spark, d):
    rows = log(spark, d).filter("event_type IN ('view', 'signup')").withColumn("value", F.when(F.col("event_type") == "view", F.col("value")))
    return S.versions(rows, ts="us")


def _open_end(vers):
    """-1 for an open end: a column of longs without nulls."""
    return vers.withColumn("valid_to", F.coalesce("valid_to", F.lit(-1)))


query("version_intervals", f"WITH {VERS} SELECT * REPLACE (coalesce(valid_to, -1) AS valid_to) FROM vers")(lambda s, d: _open_end(_versions(s, d)))  # VS1 VS2 VS5 VS8
query("versioned_current", f"WITH {VERS} SELECT * EXCLUDE (valid_to) FROM vers WHERE valid_to IS NULL AND value IS NOT NULL")(lambda s, d: S.current(_versions(s, d)).drop("valid_to"))  # VS3 VS7
query("versioned_as_of", f"WITH {VERS} SELECT * REPLACE (coalesce(valid_to, -1) AS valid_to) FROM vers WHERE value IS NOT NULL AND valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T1})")(lambda s, d: _open_end(S.as_of(_versions(s, d), T1)))  # VS4 VS9 T6
query("multi_version_query", f"WITH {VERS} SELECT * REPLACE (coalesce(valid_to, -1) AS valid_to) FROM vers WHERE value IS NOT NULL AND valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T0})")(lambda s, d: _open_end(S.in_force(_versions(s, d), T0, T1)))  # VS10


@query("versioned_retention", f"WITH {VERS}, t AS (SELECT max(valid_from) AS top FROM vers) SELECT key, valid_from, value, coalesce(valid_to, -1) AS valid_to FROM vers, t WHERE valid_to IS NULL OR valid_from // 86400000000 >= (top - 604800000000) // 86400000000")  # VS6
def versioned_retention(spark, d):
    v = _versions(spark, d).withColumn("valid_from", F.timestamp_micros("valid_from"))
    return S.keep_history(v, v.agg(F.max("valid_from").alias("top")), 7 * 24 * HOUR, 24 * HOUR).withColumn("valid_from", F.unix_micros("valid_from")).transform(_open_end)


@query("asof_join", f"WITH {VERS} SELECT l.key, l.us, l.seq, v.value AS as_of_value FROM log l JOIN vers v ON l.key = v.key AND v.valid_from <= l.us AND (v.valid_to IS NULL OR v.valid_to > l.us) WHERE l.event_type = 'purchase' AND v.value IS NOT NULL")  # T5
def asof_join(spark, d):
    left = log(spark, d).filter("event_type = 'purchase'").select("key", "us", "seq")
    return S.asof_join(left, _versions(spark, d), ts="us")


MARKS = f"{LOG}, marks AS (SELECT part, max(seq) AS mark FROM log WHERE event_type = 'signup' GROUP BY part)"


@query("replay_after_watermark", f"WITH {MARKS} SELECT log.part, seq, key FROM log LEFT JOIN marks USING (part) WHERE mark IS NULL OR seq > mark")  # W10 P1 P8
def replay_after_watermark(spark, d):
    rows = log(spark, d)
    marks = rows.filter("event_type = 'signup'").groupBy("part").agg(F.max("seq").alias("mark"))
    return R.after_watermark(rows, marks).select("part", "seq", "key")


def _txns(spark, d):
    o = table(spark, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "P", "aborted").otherwise("unknown")
    return o.select(F.col("o_orderkey").alias("txn_id"), (F.col("o_custkey") % 8).alias("part"), outcome.alias("outcome"))


@query("committed_state", """SELECT key, txn_id, line, value FROM (SELECT l_partkey AS key, l_orderkey AS txn_id, l_linenumber AS line, l_quantity AS value,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE rn = 1""")  # P3 P5 P7
def committed_state(spark, d):
    staged = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("txn_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"))
    return M.newest(R.committed(staged, _txns(spark, d)), "key", ["txn_id", "line"]).select("key", "txn_id", "line", "value")


query("behind_partitions", "SELECT o_custkey % 8 AS part, count(*) AS unknown FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1")(lambda s, d: R.behind(_txns(s, d)))  # P7 P10
query("positions", f"WITH {LOG} SELECT part, max(seq) AS position FROM log GROUP BY part")(lambda s, d: R.positions(log(s, d)))  # T8
BOUNDS = [(0, 5000), (1, 10**9), (2, 0), (9, 1)]


@query("position_bound", f"WITH {LOG}, b(part, bound) AS (VALUES {', '.join(map(str, BOUNDS))}) SELECT b.part, coalesce(max(seq) >= any_value(bound), false) AS permitted FROM b LEFT JOIN log USING (part) GROUP BY b.part")  # R17
def position_bound(spark, d):
    return R.permitted(R.positions(log(spark, d)), spark.createDataFrame(BOUNDS, "part long, bound long"))


@query("replay_going_back", f"WITH {LOG}, w AS (SELECT part, seq, lag(seq) OVER (PARTITION BY part ORDER BY arrival, seq) AS before FROM log) SELECT * FROM w WHERE seq <= before")  # P11
def replay_going_back(spark, d):
    return R.going_back(log(spark, d).withColumn("arrival", F.struct("arrival", "seq"))).select("part", "seq", "before")


FILES = f"""{LOG}, files AS (SELECT seq % 3 AS level, seq // 100 * 3 + seq % 3 AS file_number, min(key) AS smallest_key, max(key) AS largest_key, CAST(sum(length(event_type) + 16) AS BIGINT) AS file_bytes,
  count(*) AS num_entries, count(*) FILTER (op = 'delete') AS num_tombstones, count(*) FILTER (event_type = 'signup' AND value > 99) AS num_range_tombstones, min(us) AS min_write_us, max(us) AS max_write_us,
  min(seq) AS watermark_high0, max(seq) AS watermark_high, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN min(seq) END AS watermark_low,
  min(key - 80) FILTER (event_type = 'signup' AND value > 99) AS smallest_range_key, max(key + 160) FILTER (event_type = 'signup' AND value > 99) AS largest_range_key, seq // 100 % 3 AS place FROM log GROUP BY 1, 2, seq // 100 % 3)"""


def files(spark, d):
    """The log as the files of a store: a hundred mutations a file, three levels."""
    rows = log(spark, d).withColumns({"level": F.col("seq") % 3, "file_number": F.expr("seq div 100") * 3 + F.col("seq") % 3})
    cut = F.when((F.col("event_type") == "signup") & (F.col("value") > 99), F.col("key"))
    return rows.groupBy("level", "file_number", (F.expr("seq div 100") % 3).alias("place")).agg(
        F.min(cut - 80).alias("smallest_range_key"), F.max(cut + 160).alias("largest_range_key"),
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.sum(F.length("event_type") + 16).alias("file_bytes"), F.count("*").alias("num_entries"), F.count_if(F.col("op") == "delete").alias("num_tombstones"),
        F.count_if((F.col("event_type") == "signup") & (F.col("value") > 99)).alias("num_range_tombstones"), F.min("us").alias("min_write_us"), F.max("us").alias("max_write_us"),
        F.max("seq").alias("watermark_high"), F.when(F.count_if(F.col("event_type") == "signup") > 0, F.min("seq")).alias("watermark_low"),
    )


query("level_stats", f"WITH {FILES} SELECT level, count(*) AS files, CAST(sum(file_bytes) AS BIGINT) AS bytes, CAST(sum(num_entries) AS BIGINT) AS entries, CAST(sum(num_tombstones) AS BIGINT) AS tombstones, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key FROM files GROUP BY level")(lambda s, d: L.level_stats(files(s, d)))  # M12 M16 M17
LEVELS = [(0, 4, 50000), (1, 40, 200000), (2, 400, 1000000)]


@query("level_score", f"WITH {FILES}, levels(level, max_files, max_bytes) AS (VALUES {', '.join(map(str, LEVELS))}) SELECT level, greatest(count(*) / any_value(max_files), sum(file_bytes) / any_value(max_bytes), coalesce(max(CASE WHEN num_entries >= 34 THEN num_tombstones / num_entries END), 0) / 0.5::DOUBLE) AS score FROM files JOIN levels USING (level) GROUP BY level")  # M1 M20
def level_score(spark, d):
    return L.level_scores(files(spark, d), spark.createDataFrame(LEVELS, "level long, max_files long, max_bytes long"), 0.5, 34)


@query("level_to_compact", ORACLES["level_score"].replace("SELECT level, greatest", "SELECT level FROM (SELECT level, greatest") + ") WHERE score > 1 ORDER BY score DESC, level LIMIT 1")  # M1: the pick
def level_to_compact(spark, d):
    return L.level_to_compact(level_score(spark, d)).select("level")


TIERS = [(0, 86400000000), (1, 864000000000), (2, None)]
NOW = 1706745600000000  # 2024-02-01


@query("tier_placement", f"WITH {FILES} SELECT file_number, CASE WHEN {NOW} - min_write_us <= 86400000000 THEN 0 WHEN {NOW} - min_write_us <= 864000000000 THEN 1 ELSE 2 END AS tier FROM files")  # M5
def tier_placement(spark, d):
    return L.placement(files(spark, d), spark.createDataFrame(TIERS, "tier int, max_age_us long"), NOW)


@query("compaction_overlap", f"WITH {FILES} SELECT a.file_number, count(*) AS overlapped, CAST(sum(b.file_bytes) AS BIGINT) AS bytes FROM files a JOIN files b ON b.level = a.level + 1 AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key GROUP BY 1")  # M3 M11
def compaction_overlap(spark, d):
    return L.overlapped(files(spark, d))


@query("compaction_inputs", f"""WITH RECURSIVE {FILES}, z AS (SELECT * FROM files WHERE level = 0), g AS (SELECT * FROM (SELECT smallest_key AS lo, largest_key AS hi FROM z ORDER BY file_number LIMIT 1)
 UNION SELECT least(lo, smallest_key), greatest(hi, largest_key) FROM g JOIN z ON smallest_key <= hi AND largest_key >= lo)
 SELECT file_number FROM z, (SELECT min(lo) AS lo, max(hi) AS hi FROM g) WHERE smallest_key <= hi AND largest_key >= lo""")  # M2
def compaction_inputs(spark, d):
    return L.compaction_inputs(files(spark, d).filter("level = 0")).select("file_number")


WIDTH = "CASE seq % 3 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 8 END"
TREE = f"""{LOG}, tree AS (SELECT 1 + seq % 3 AS level, (1 + seq % 3) * 100000 + key // ({WIDTH}) AS file_number, min(key) AS smallest_key, max(key) AS largest_key, count(*) * 16 AS file_bytes,
 count(*) FILTER (op = 'delete') AS num_tombstones, count(*) FILTER (event_type = 'signup' AND value > 99) AS num_range_tombstones, min(key) FILTER (event_type = 'signup' AND value > 99) AS smallest_range_key, max(key + seq % 3) FILTER (event_type = 'signup' AND value > 99) AS largest_range_key
 FROM log WHERE seq % 3 <> 1 OR key >= 30 GROUP BY 1, 2)"""


def tree_files(spark, d):
    """The log as the sorted levels of a store: files of 4, 16 and 8 keys; the second level has no keys below 30."""
    rows = log(spark, d).filter("seq % 3 <> 1 OR key >= 30").withColumns({"level": F.expr("1 + seq % 3"), "file_number": F.expr(f"(1 + seq % 3) * 100000 + key div ({WIDTH})")})
    cut = F.when((F.col("event_type") == "signup") & (F.col("value") > 99), F.col("key"))
    f = rows.groupBy("level", "file_number").agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), (F.count("*") * 16).alias("file_bytes"), F.count_if(F.col("op") == "delete").alias("num_tombstones"),
        F.count(cut).alias("num_range_tombstones"), F.min(cut).alias("smallest_range_key"), F.max(cut + F.col("seq") % 3).alias("largest_range_key"))
    return saved(f, "files")


def _plan(name, pointer, budget, limit):
    meets = lambda a, b: f"{a}.lo <= {b}.hi AND {a}.hi >= {b}.lo"
    sql = f"""WITH {TREE}, f AS (SELECT *, least(smallest_key, smallest_range_key) AS lo, greatest(largest_key, largest_range_key) AS hi FROM tree),
 seed AS (SELECT * FROM f WHERE level = 1 ORDER BY largest_key > {pointer} DESC, lo, file_number LIMIT 1),
 o AS (SELECT f.* FROM f, seed WHERE f.level = 2 AND {meets('f', 'seed')}),
 wide AS (SELECT least(lo, (SELECT min(lo) FROM o)) AS lo, greatest(hi, (SELECT max(hi) FROM o)) AS hi FROM seed),
 more AS (SELECT f.* FROM f, wide WHERE f.level = 1 AND {meets('f', 'wide')}),
 wider AS (SELECT least(lo, (SELECT min(lo) FROM more)) AS lo, greatest(hi, (SELECT max(hi) FROM more)) AS hi FROM wide),
 ok AS (SELECT (SELECT count(*) FROM o) > 0 AND (SELECT count(*) FROM more) > 1 AND (SELECT sum(file_bytes) FROM more) + (SELECT sum(file_bytes) FROM o) <= {budget} AND (SELECT count(*) FROM f, wider WHERE f.level = 2 AND {meets('f', 'wider')}) = (SELECT count(*) FROM o) AS grown),
 i AS (SELECT more.* FROM more, ok WHERE grown UNION ALL SELECT seed.* FROM seed, ok WHERE NOT grown),
 span AS (SELECT CASE WHEN grown THEN wider.lo ELSE seed.lo END AS lo, CASE WHEN grown THEN wider.hi ELSE seed.hi END AS hi FROM ok, wider, seed),
 g AS (SELECT f.* FROM f, span WHERE f.level = 3 AND {meets('f', 'span')}),
 flags AS (SELECT NOT EXISTS (FROM g) AS bottommost),
 move AS (SELECT bottommost, (SELECT count(*) FROM i) = 1 AND NOT EXISTS (FROM o) AND (NOT bottommost OR (SELECT num_tombstones + num_range_tombstones FROM seed) = 0) AND coalesce((SELECT sum(file_bytes) FROM g), 0) < {limit} AS trivial_move FROM flags)
 SELECT file_number, role, bottommost, trivial_move FROM move, (SELECT file_number, 'input' AS role FROM i UNION ALL SELECT file_number, 'overlap' FROM o UNION ALL SELECT file_number, 'grandparent' FROM g)"""
    query(name, sql)(lambda s, d: L.compaction_plan(tree_files(s, d), 1, pointer, budget, limit))


_plan("compaction_plan", 40, 10**9, 10**9)  # M2 M3: more inputs come along where they touch no further overlap
_plan("compaction_plan_budget", 40, 1000, 10**9)  # M3: no room for more
_plan("compaction_plan_touching", 60, 10**9, 10**9)  # M3: more inputs would touch a further overlap
_plan("compaction_plan_wraps", 10**9, 10**9, 10**9)  # M2 M3: past the last file, the first one; it may move


@query("tombstone_gc", f"WITH {LOG} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put' AND key >= 20")  # M4 W13
def tombstone_gc(spark, d):
    """What a compaction into the last level writes above a floor of 20: no tombstones, nothing shadowed."""
    return M.live_state(log(spark, d).filter("key >= 20")).select("key", "seq", "value")


CUT = 1705276800000000  # 2024-01-15
query("ttl_expired_files", f"WITH {FILES} SELECT file_number FROM files f WHERE max_write_us > 0 AND max_write_us <= {CUT} AND num_range_tombstones = 0 AND level = 2 AND NOT EXISTS (SELECT 1 FROM files o WHERE o.level = 2 AND o.num_range_tombstones = 0 AND (o.level > f.level OR (o.level = f.level AND o.file_number < f.file_number)) AND o.smallest_key <= f.largest_key AND f.smallest_key <= o.largest_key)")(lambda s, d: L.expired(files(s, d).filter("level = 2 AND num_range_tombstones = 0"), CUT).select("file_number"))  # M8: of the last level, as shallower files always have an older one below them here
query("truncated_files", f"WITH {FILES} SELECT file_number FROM files WHERE greatest(largest_key, largest_range_key) < (SELECT max(largest_key) FROM files)")(lambda s, d: _truncated(s, d).select("file_number"))  # M9


def _truncated(spark, d):
    f = files(spark, d)
    return L.truncated(f, f.agg(F.max("largest_key")).first()[0])


query("range_is_erased", f"WITH {FILES} SELECT count(*) = 0 AS erased FROM files WHERE num_entries > 0 AND smallest_key < 30 AND largest_key >= 20")(lambda s, d: files(s, d).filter("num_entries > 0 AND smallest_key < 30 AND largest_key >= 20").agg((F.count("*") == 0).alias("erased")))  # R13


query("range_drop_files", f"""WITH {FILES} SELECT f.file_number, bool_or(c.num_range_tombstones = 1) AS exact FROM files f JOIN files c ON c.num_range_tombstones > 0 AND (c.level < f.level OR (c.level = f.level AND c.file_number > f.file_number))
 AND c.smallest_range_key <= f.smallest_key AND f.largest_key < c.largest_range_key WHERE f.num_range_tombstones = 0 AND f.num_entries > 0 GROUP BY 1""")(lambda s, d: L.range_dropped(files(s, d)))  # M10
ROOM = [(0, 86400000000, 4000, False), (1, 864000000000, None, True), (2, None, None, False)]


def _migration(name, rooms):
    tiers = ", ".join(f"({t}, {'NULL' if a is None else a}::BIGINT, {'NULL' if b is None else b}::BIGINT, {x})" for t, a, b, x in rooms)
    query(name, f"""WITH {FILES}, tiers(tier, max_age_us, max_bytes, transient) AS (VALUES {tiers}),
 p AS (SELECT f.*, (SELECT min(tier) FROM tiers WHERE max_age_us IS NULL OR greatest({NOW} - f.min_write_us, 0) <= max_age_us) AS target, sum(file_bytes) OVER (PARTITION BY place) AS held FROM files f WHERE level > 0),
 j AS (SELECT p.*, max_bytes, transient, target > place AS past, coalesce(held > max_bytes, false) AND place < (SELECT max(tier) FROM tiers) AS over_room FROM p JOIN tiers ON tier = place),
 m AS (SELECT *, 1 AS step, 0 AS room, min_write_us AS age FROM j WHERE transient AND past UNION ALL SELECT *, 1, 1, min_write_us FROM j WHERE transient AND over_room
  UNION ALL SELECT *, 2, 1, min_write_us FROM j WHERE over_room UNION ALL SELECT *, 3, 0, 0 FROM j WHERE past)
 SELECT file_number, place AS from_tier, CASE WHEN room = 1 THEN place + 1 ELSE target END AS to_tier, step = 1 AS leaves_transient, room = 1 AS capacity_eviction FROM m ORDER BY step, place, room, age, level, smallest_key, file_number LIMIT 1""")(
        lambda s, d: L.pick_migration(files(s, d), s.createDataFrame(rooms, "tier long, max_age_us long, max_bytes long, transient boolean"), NOW))


_migration("migration_pick", ROOM)  # M6: off a transient tier first
_migration("migration_for_room", [(0, None, 4000, False), (1, None, None, False)])  # M6: a tier has no room
_migration("migration_by_age", [(0, 86400000000, None, False), (1, 864000000000, None, False), (2, None, None, False)])  # M6: by age alone


@query("recovery_watermark", f"WITH {FILES}, l AS (SELECT level AS part, largest_key > 95 AND level > 0 AS lost, watermark_low, watermark_high FROM files) SELECT part, coalesce(CASE WHEN NOT bool_or(lost) THEN max(watermark_high) WHEN bool_or(lost AND watermark_low IS NULL) THEN NULL ELSE min(watermark_low) FILTER (lost) END, -1) AS resume FROM l GROUP BY part")  # W11 M7
def recovery_watermark(spark, d):
    return L.recovery_watermark(files(spark, d).select(F.col("level").alias("part"), ((F.col("largest_key") > 95) & (F.col("level") > 0)).alias("lost"), "watermark_low", "watermark_high")).withColumn("resume", F.coalesce("resume", F.lit(-1)))  # -1: none


@query("orphan_objects", f"WITH {FILES} SELECT file_number + 1000000 AS object FROM files WHERE file_number % 4 = 0 AND {NOW} - max_write_us >= 1728000000000")  # M13: the listing has all files and, from interrupted writes, others
def orphan_objects(spark, d):
    f = files(spark, d)
    listing = f.select(F.col("file_number").alias("object"), F.col("max_write_us").alias("first_seen_us")).unionByName(f.filter("file_number % 4 = 0").select((F.col("file_number") + 1000000).alias("object"), F.col("max_write_us").alias("first_seen_us")))
    return L.orphans(listing, f, NOW, 1728000000000)


query("store_totals", f"WITH {FILES} SELECT count(*) AS files, CAST(sum(file_bytes) AS BIGINT) AS bytes, CAST(sum(num_entries) AS BIGINT) AS entries, CAST(sum(num_tombstones) AS BIGINT) AS tombstones, CAST(sum(num_range_tombstones) AS BIGINT) AS range_tombstones, min(min_write_us) AS oldest_us, max(watermark_high) AS position FROM files")(lambda s, d: L.store_totals(files(s, d)))  # M12 M16 M17


@query("manifest_counters", f"WITH {FILES} SELECT max(smallest_key) AS floor, max(file_number) + 1 AS next_file FROM files")  # M18: a snapshot of level 2, then edits; both counters only rise
def manifest_counters(spark, d):
    f = files(spark, d).select("level", F.col("smallest_key").alias("floor"), (F.col("file_number") + 1).alias("next_file"))
    return L.manifest_counters(f.filter("level = 2"), f.filter("level < 2"))


@query("manifest_replay", """WITH e AS (SELECT event_id + 1 AS seq, user_id AS file_number, CASE WHEN event_type IN ('view', 'click') THEN 'add' ELSE 'delete' END AS action FROM events WHERE event_id <> (SELECT max(event_id) * 3 // 4 FROM events)),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM e) WHERE seq = rn)
 SELECT file_number FROM (SELECT *, row_number() OVER (PARTITION BY file_number ORDER BY seq DESC) AS last FROM k) WHERE last = 1 AND action = 'add'""")  # M18: one edit is torn
def manifest_replay(spark, d):
    e = table(spark, d, "events")
    torn = F.broadcast(e.agg((F.max("event_id") * 3).alias("m")).select(F.expr("m div 4").alias("torn")))
    edits = e.join(torn, F.col("event_id") == F.col("torn"), "left_anti").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("file_number"), F.when(F.col("event_type").isin("view", "click"), "add").otherwise("delete").alias("action"))
    return L.manifest_replay(edits)


query("log_events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))  # M21
query("level_config", "SELECT CAST(i AS INT) AS level, CAST(1048576 * pow(10, i) AS BIGINT) AS max_bytes FROM range(5) t(i)")(lambda s, d: L.geometric_levels(s, 1048576, 10, 5))  # M19
query("entry_limits", "SELECT doc_id, octet_length(encode(text)) <= 1048576 AS fits FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", (F.octet_length("text") <= 1048576).alias("fits")))  # ingest limits


@query("hopping_count", "SELECT user_id, w * 1800000000 AS start_us, count(*) AS n FROM (SELECT user_id, unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS w FROM events) GROUP BY ALL")  # T2, windows that overlap
def hopping_count(spark, d):
    return S.tumbling_count(table(spark, d, "events"), "1 hour", "user_id", slide="30 minutes").select("user_id", F.unix_micros("window_start").alias("start_us"), "n")


@query("session_retention", f"WITH {LATE}, top AS (SELECT part, max(us) AS top FROM kept GROUP BY part) SELECT key, seq, us - 600000000 AS start_us, us AS end_us FROM kept JOIN top USING (part) WHERE us // 43200000000 >= (top - 172800000000) // 43200000000")  # SS1 SS7
def session_retention(spark, d):
    """Each event as a put of the session of the ten minutes before it."""
    puts = log(spark, d).withColumns({"arrival": F.struct("arrival", "seq"), "session_end": F.timestamp_micros("us")})
    kept = S.in_time(puts, HOUR, ts="session_end", seq="arrival")
    return S.live_segments(kept, 48 * HOUR, 12 * HOUR, ts="session_end").select("key", "seq", (F.col("us") - 600_000_000).alias("start_us"), F.col("us").alias("end_us"))


@query("remove_sessions", f"WITH {GAPS} SELECT * FROM sessions WHERE n % 3 <> 0")  # SS2: every session of three, six, ... events is removed
def remove_sessions(spark, d):
    s = S.sessions(table(spark, d, "events"), 2 * HOUR, "user_id")
    left = S.remove_sessions(s, s.filter("n % 3 = 0"), "user_id")
    return left.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


CLICKS = GAPS.replace("FROM events", "FROM events WHERE event_type = 'click'").replace("7200000000", "172800000000")


@query("interval_lookup", f"WITH {CLICKS} SELECT e.user_id, e.event_id, epoch_us(e.ts) AS us, start_us, end_us FROM events e JOIN sessions s ON e.user_id = s.user_id AND epoch_us(e.ts) BETWEEN start_us AND end_us WHERE event_type = 'purchase'")  # F7
def interval_lookup(spark, d):
    e = table(spark, d, "events")
    s = S.sessions(e.filter("event_type = 'click'"), 48 * HOUR, "user_id").select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"))
    points = e.filter("event_type = 'purchase'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return S.covered(points, s, "user_id", "us", "start_us", "end_us")


@query("range_clip", f"WITH i AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS lower, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS upper FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, greatest(lower, 820454400000000) AS lower, least(upper, 852076800000000) AS upper FROM i) SELECT * FROM c WHERE lower < upper")  # 1996
def range_clip(spark, d):
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", us.alias("lower"), (us + F.col("l_quantity").cast("long") * 86400000000).alias("upper"))
    return M.clip(i, 820454400000000, 852076800000000)


query("key_only_scan", f"WITH {STATE} SELECT key FROM state")(lambda s, d: M.scan(state(s, d)).select("key"))  # F8


@query("running_changelog", f"""WITH {LOG}, l AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM log)
 SELECT key, seq, coalesce(CASE WHEN op = 'put' THEN CAST(sum(CASE WHEN op = 'put' THEN cents END) OVER (PARTITION BY key, life ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END, -1) AS total FROM l""")  # T7: -1 for a tombstone
def running_changelog(spark, d):
    rows = log(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return M.changelog(rows, value="cents").withColumn("total", F.coalesce("total", F.lit(-1)))


@query("window_overwrite", f"WITH {LOG} SELECT key, hour_us, value, seq FROM (SELECT key, us // 3600000000 * 3600000000 AS hour_us, value, seq, op, row_number() OVER (PARTITION BY key, us // 3600000000 ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put'")  # WS1 WS13: without duplicates, a window's last write stands
def window_overwrite(spark, d):
    rows = log(spark, d).withColumn("hour_us", F.expr("us div 3600000000 * 3600000000"))
    return M.live_state(rows, key=["key", "hour_us"]).select("key", "hour_us", "value", "seq")


@query("versioned_put_in_time", f"WITH {LOG}, st AS (SELECT *, max(us) OVER (PARTITION BY part ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS stream FROM log) SELECT key, seq FROM st WHERE us >= stream - 3600000000")  # VS1: older ones are refused
def versioned_put_in_time(spark, d):
    return S.in_time(log(spark, d).withColumn("arrival", F.struct("arrival", "seq")), HOUR, seq="arrival", closed=True).select("key", "seq")


@query("tier_stats", f"WITH {FILES}, t AS (SELECT *, CASE WHEN {NOW} - min_write_us <= 86400000000 THEN 0 WHEN {NOW} - min_write_us <= 864000000000 THEN 1 ELSE 2 END AS tier FROM files) SELECT tier, count(*) AS files, CAST(sum(file_bytes) AS BIGINT) AS bytes, CAST(sum(num_entries) AS BIGINT) AS entries, min(min_write_us) AS oldest_us FROM t GROUP BY tier")  # M12 M16 M17
def tier_stats(spark, d):
    return L.tier_stats(files(spark, d), spark.createDataFrame(TIERS, "tier int, max_age_us long"), NOW)


JITTERED = "1 - ((file_number * 2654435761) % 4294967296) / 4294967296.0::DOUBLE * 0.2"


@query("tier_placement_jitter", f"WITH {FILES} SELECT file_number, CASE WHEN {NOW} - min_write_us <= 86400000000 * ({JITTERED}) THEN 0 WHEN {NOW} - min_write_us <= 864000000000 * ({JITTERED}) THEN 1 ELSE 2 END AS tier FROM files")  # M5: limits shorter by up to a fifth
def tier_placement_jitter(spark, d):
    return L.placement(files(spark, d), spark.createDataFrame(TIERS, "tier int, max_age_us long"), NOW, jitter_percent=20)


WINDOWS = [("a", 100, 10, None), ("b", 0, 10, None), ("c", 100, 0, 5), ("d", 100, 101, None), ("e", 100, 100, 0), ("f", 100, 100, 1), ("g", None, 1, 1)]


@query("faulty_windows", f"""SELECT * FROM (SELECT name, CASE WHEN NOT coalesce(r > 0, false) THEN 'retention' WHEN NOT coalesce(w > 0, false) THEN 'window' WHEN coalesce(s, greatest(r // 2, 60000)) < 1 THEN 'segment' WHEN w > r THEN 'too wide' END AS fault
 FROM (VALUES {', '.join(str(x).replace('None', 'NULL') for x in WINDOWS)}) t(name, r, w, s)) WHERE fault IS NOT NULL""")  # WS14
def faulty_windows(spark, d):
    return S.faulty_windows(spark.createDataFrame(WINDOWS, "name string, retention_ms long, window_ms long, segment_ms long"))


BAD_TIERS = [(0, 10), (1, 20), (2, 20), (3, None), (4, 50)]


@query("faulty_tiers", "SELECT unnest([2, 4]) AS tier")  # M22
def faulty_tiers(spark, d):
    return L.faulty_tiers(spark.createDataFrame(BAD_TIERS, "tier int, max_age_us long"))


PRESSURE = [(0, 1, 3), (1, 2, 10**9), (2, 10**8, 10**9), (3, 1, 2)]


@query("backpressure", f"WITH {FILES}, l(level, slowdown, stop) AS (VALUES {', '.join(map(str, PRESSURE))}) SELECT l.level, CASE WHEN count(file_number) >= any_value(stop) THEN 'stop' WHEN count(file_number) >= any_value(slowdown) THEN 'slowdown' ELSE 'go' END AS writes FROM l LEFT JOIN files USING (level) GROUP BY l.level")  # M20
def backpressure(spark, d):
    return L.backpressure(files(spark, d), spark.createDataFrame(PRESSURE, "level long, slowdown long, stop long"))


@query("compaction_budget", f"WITH {FILES}, r AS (SELECT file_number, row_number() OVER w AS n, sum(file_bytes) OVER w AS run FROM files WHERE level = 0 WINDOW w AS (ORDER BY file_number ROWS UNBOUNDED PRECEDING)) SELECT file_number FROM r WHERE run <= 8000 OR n = 1")  # M2
def compaction_budget(spark, d):
    return L.trim_to_budget(files(spark, d).filter("level = 0"), 8000).select("file_number")


@query("surviving_stores", f"WITH {FILES}, f AS (SELECT file_number, file_number // 40 AS store FROM files) SELECT file_number, store FROM f WHERE store NOT IN (SELECT store FROM f WHERE file_number NOT IN (SELECT s_suppkey FROM supplier))")  # M14: supplier stands for a listing
def surviving_stores(spark, d):
    f = files(spark, d).select("file_number", F.expr("file_number div 40").alias("store"))
    return L.surviving_stores(f, table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_number"))).select("file_number", "store")


@query("reencryption_pending", f"WITH {FILES} SELECT level, count(*) FILTER (file_number % 5 <> 0) AS pending FROM files GROUP BY level")  # M15: the provider of a file's key stands in its number
def reencryption_pending(spark, d):
    return files(spark, d).groupBy("level").agg(F.count_if(F.col("file_number") % 5 != 0).alias("pending"))


def _stored(spark, d):
    """The state as a reader finds it: one version, sorted by key."""
    store = StateTable(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    store.flush(state(spark, d))
    return store.read()


def _stored_scan(name, where, make):
    query(name, f"WITH {STATE} SELECT * FROM state WHERE {where}")(lambda spark, d: make(_stored(spark, d)).select("key", "value", "seq"))


_stored_scan("stored_get", "key = 7", lambda s: s.filter("key = 7"))  # W7 R1 R2 R15
_stored_scan("stored_range", "key >= 10 AND key < 50", lambda s: M.scan(s, lower=LOW, upper=HIGH))  # W7 R6
_stored_scan("stored_lower_bound", "key >= 50", lambda s: M.scan(s, lower=50))  # W7 R5
_stored_scan("stored_reverse_all", "true", lambda s: M.scan(s, reverse=True))  # W7 R8 R11
query("next_batch", f"WITH {STATE} SELECT * FROM state WHERE key > 20 ORDER BY key LIMIT 10")(lambda s, d: M.next_batch(_stored(s, d), 10, after=20).select("key", "value", "seq"))  # R9
query("next_batch_back", f"WITH {STATE} SELECT * FROM state WHERE key < 90 ORDER BY key DESC LIMIT 10")(lambda s, d: M.next_batch(_stored(s, d), 10, after=90, reverse=True).select("key", "value", "seq"))  # R8 R9
query("reverse_prefix_batch", "SELECT url, page_id FROM pages WHERE starts_with(url, 'https://') ORDER BY url DESC, page_id DESC LIMIT 20")(lambda s, d: table(s, d, "pages").filter(has_prefix(F.col("url"), "https://")).select("url", "page_id").orderBy(F.desc("url"), F.desc("page_id")).limit(20))  # R11


@query("read_only_refresh", f"""WITH {LOG}, early AS (SELECT * FROM log WHERE seq % 10 < 5), a AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM early) WHERE rn = 1 AND op = 'put'),
 b AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put')
 SELECT 'pinned' AS view, key FROM a UNION ALL SELECT 'refreshed', key FROM b""")  # R14
def read_only_refresh(spark, d):
    """A reader keeps the version it opened while the next is written, and sees that one once refreshed."""
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    writer, reader = StateTable(spark, path), StateTable(spark, path)
    writer.flush(M.live_state(log(spark, d).filter("seq % 10 < 5")).select("key", "value", "seq"))
    reader.read()
    writer.flush(state(spark, d))
    pinned = reader.read()
    reader.refresh()
    return pinned.select(F.lit("pinned").alias("view"), "key").unionByName(reader.read().select(F.lit("refreshed").alias("view"), "key"))


def _backward(name, where, by, **bounds):
    order = "us // 43200000000, key, us, seq"
    back = ", ".join(f"{c} DESC" for c in order.split(", "))
    rows = f"WITH {LOG} SELECT key, us, seq, value FROM log WHERE op = 'put' AND {where}"
    fetch = lambda s, d: S.fetch(log(s, d).filter("op = 'put'"), ts="us", **bounds).select("key", "us", "seq", "value")
    query(f"{name}_first", f"{rows} ORDER BY {order} LIMIT {by}")(lambda s, d: S.in_store_order(fetch(s, d), 12 * HOUR).limit(by))
    query(f"{name}_backward", f"{rows} ORDER BY {back} LIMIT {by}")(lambda s, d: S.in_store_order(fetch(s, d), 12 * HOUR, backward=True).limit(by))


_backward("window_key", f"key = 7 AND us BETWEEN {T0} AND {T1}", 5, lower=7, upper=7, start=T0, end=T1)  # WS3
_backward("window_keys", f"key BETWEEN 10 AND 50 AND us BETWEEN {T0} AND {T1}", 20, lower=LOW, upper=HIGH, start=T0, end=T1)  # WS4
_backward("window_all", "true", 30)  # WS5 WS6


@query("fetch_session_exact", f"WITH {GAPS}, one AS (SELECT min(start_us) AS s FROM sessions WHERE user_id = 7) SELECT sessions.* FROM sessions, one WHERE user_id = 7 AND start_us = s")  # SS3: key, start and end
def fetch_session_exact(spark, d):
    s = session_count(spark, d)
    one = s.filter("user_id = 7").orderBy("start_us").limit(1).select("user_id", "start_us", "end_us")
    return s.join(F.broadcast(one), ["user_id", "start_us", "end_us"], "left_semi")


query("sessions_backward", f"WITH {GAPS} SELECT * FROM sessions WHERE user_id BETWEEN 10 AND 50 ORDER BY end_us // 43200000000 DESC, user_id DESC, end_us DESC, start_us DESC LIMIT 20")(lambda s, d: S.in_store_order(session_count(s, d).filter("user_id BETWEEN 10 AND 50"), 12 * HOUR, ts="end_us", key="user_id", seq="start_us", backward=True).limit(20))  # SS4
query("multi_version_descending", f"WITH {VERS} SELECT key, valid_from, value FROM vers WHERE value IS NOT NULL AND valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T0}) ORDER BY key DESC, valid_from DESC LIMIT 20")(lambda s, d: S.in_force(_versions(s, d), T0, T1).select("key", "valid_from", "value").orderBy(F.desc("key"), F.desc("valid_from")).limit(20))  # VS10
query("version_entries", f"WITH {VERS} SELECT count(*) AS entries FROM vers")(lambda s, d: _versions(s, d).agg(F.count("*").alias("entries")))  # VS8


@query("version_delete_returning", f"WITH {VERS} SELECT t.key, t.valid_from, p.value AS old_value FROM vers t JOIN vers p ON p.key = t.key AND p.valid_to = t.valid_from WHERE t.value IS NULL AND p.value IS NOT NULL")  # VS5
def version_delete_returning(spark, d):
    w = Window.partitionBy("key").orderBy("valid_from")
    rows = _versions(spark, d).withColumn("old_value", F.lag("value").over(w))
    return rows.filter("value IS NULL AND old_value IS NOT NULL").select("key", "valid_from", "old_value")


query("window_duplicates", f"WITH {LOG} SELECT key, us // 3600000000 * 3600000000 AS hour_us, seq, value FROM log WHERE op = 'put'")(lambda s, d: M.keep_duplicates(log(s, d).withColumn("hour_us", F.expr("us div 3600000000 * 3600000000"))).select("key", "hour_us", "seq", "value"))  # WS13

CHANGES = f"{LOG}, ch AS (SELECT *, CASE WHEN op = 'put' THEN value END AS v, us // 3600000000 * 3600000000 AS hour_us FROM log)"


def _changes(spark, d):
    return log(spark, d).select("part", "key", "seq", "us", "ts", F.when(F.col("op") == "put", F.col("value")).alias("value"), F.expr("us div 3600000000 * 3600000000").alias("hour_us"))


query("kv_restore", f"WITH {STATE} SELECT key, value, seq FROM state")(lambda s, d: S.restored(_changes(s, d).unionByName(_changes(s, d).filter("seq % 3 = 0")), ["key"]).select("key", "value", "seq"))  # Kafka restore; a third of the records come twice


@query("window_restore", f"WITH {CHANGES}, top AS (SELECT max(us) AS top FROM ch) SELECT key, hour_us, v AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, hour_us ORDER BY seq DESC) AS rn FROM ch), top WHERE rn = 1 AND v IS NOT NULL AND us // 43200000000 >= (top - 604800000000) // 43200000000")  # WS9 WS10
def window_restore(spark, d):
    """Deletes move stream time as well; what has expired by the end of the replay isn't there."""
    rows = _changes(spark, d).withColumn("one", F.lit(0))
    tops = rows.groupBy("one").agg(F.max("us").alias("top"))
    kept = S.restored(rows, ["key", "hour_us"]).join(F.broadcast(tops), "one")
    return kept.filter(F.expr("us div 43200000000 >= (top - 604800000000) div 43200000000")).select("key", "hour_us", "value", "seq")


query("session_restore", f"WITH {CHANGES} SELECT key, us - 600000000 AS start_us, us AS end_us, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, us ORDER BY seq DESC) AS rn FROM ch) WHERE rn = 1 AND v IS NOT NULL")(lambda s, d: S.restored(_changes(s, d).withColumns({"start_us": F.col("us") - 600000000, "end_us": F.col("us")}), ["key", "start_us", "end_us"]).select("key", "start_us", "end_us", "seq"))  # SS9


@query("version_restore", f"""WITH {CHANGES}, st AS (SELECT *, max(us) OVER (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stream FROM ch), r AS (SELECT key, seq, v, CASE WHEN v IS NULL THEN stream ELSE us END AS t0 FROM st)
 SELECT key, t0 AS valid_from, v AS value, coalesce(lead(t0) OVER (PARTITION BY key ORDER BY t0), -1) AS valid_to FROM (SELECT *, row_number() OVER (PARTITION BY key, t0 ORDER BY seq DESC) AS rn FROM r) WHERE rn = 1""")  # VS11
def version_restore(spark, d):
    return _open_end(S.versions(S.restored_versions(_changes(spark, d)), ts="us")).select("key", "valid_from", "value", "valid_to")


query("refused_watermarks", f"WITH {LOG}, w AS (SELECT part, seq, arrival, max(seq) OVER (PARTITION BY part ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS highest FROM log) SELECT part, seq FROM w WHERE seq < highest")(lambda s, d: R.refused_watermarks(log(s, d).withColumn("mark", F.col("seq")), seq="arrival").select("part", "seq"))  # W10
query("refused_below_floor", f"WITH {LOG}, f AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN key // 3 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM log) SELECT key, seq FROM f WHERE event_type <> 'signup' AND key < floor")(lambda s, d: M.refused_below_floor(log(s, d).withColumn("cut", F.when(F.col("event_type") == "signup", F.expr("key div 3")))).select("key", "seq"))  # W6


@query("guarded_get", f"""WITH {STATE}, late AS (SELECT DISTINCT o_custkey % 4 AS part FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 4 < 2)
 SELECT s_suppkey AS key, s_suppkey % 4 AS part, s_suppkey % 4 IN (SELECT part FROM late) AS refused, coalesce(CASE WHEN s_suppkey % 4 NOT IN (SELECT part FROM late) THEN value END, -1) AS value FROM supplier LEFT JOIN state ON key = s_suppkey""")  # P9
def guarded_get(spark, d):
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 4).alias("part"))
    late = table(spark, d, "orders").filter("o_orderstatus = 'O' AND o_custkey % 4 < 2").select((F.col("o_custkey") % 4).alias("part")).distinct()
    return R.guarded_get(state(spark, d), keys, late).withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("leftover_stage", """WITH t AS (SELECT o_orderkey AS txn_id, o_custkey % 8 AS part, o_orderstatus FROM orders), latest AS (SELECT part, max(txn_id) AS latest FROM t GROUP BY part)
 SELECT part, txn_id, l_linenumber AS line FROM t JOIN latest USING (part) JOIN lineitem ON l_orderkey = txn_id WHERE o_orderstatus NOT IN ('F', 'P') AND txn_id < latest""")  # P4
def leftover_stage(spark, d):
    staged = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_linenumber").alias("line"))
    return R.leftover(staged, _txns(spark, d)).select("part", "txn_id", "line")


query("null_mutations", "SELECT l_orderkey AS txn_id, l_linenumber AS line FROM lineitem WHERE l_discount = 0")(lambda s, d: M.null_mutations(table(s, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("value"))).select("txn_id", "line"))  # P3: refused when staged
