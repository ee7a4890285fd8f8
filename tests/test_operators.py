import random

import pytest
from pyspark.sql import functions as F

from driftlog.functions import keys
from driftlog.operators import layout, replay, temporal
from driftlog.operators import log as M
from driftlog.operators.ordered import running
from driftlog.plans import registry
from driftlog.sources.tables import Stale, StateTable


def test_prefix_bounds():
    assert keys.successor(b"a\xff") == b"b" and keys.successor(b"\xff") is None and keys.successor(b"") is None
    assert keys.successor("az") == "a{"


def test_binary_keys_keep_number_order(spark):
    nums = [-(2**63), -5, 0, 7, 2**62]
    rows = spark.createDataFrame([(n,) for n in nums], "n long").select("n", keys.encode_long(F.col("n")).alias("k")).orderBy("k").collect()
    assert [r.n for r in rows] == nums


@pytest.mark.parametrize("seed", range(3))
def test_log_against_a_dict(spark, seed):
    """A random op stream, replayed into a dict and as a log; the last check must fail without the seq clause."""
    rng, model, puts, ranges = random.Random(seed), {}, [], []
    for seq in range(300):
        k, draw = rng.randrange(40), rng.random()
        if draw < 0.7:
            model[k] = seq
            puts.append((k, seq, "put", seq))
        elif draw < 0.9:
            model.pop(k, None)
            puts.append((k, seq, "delete", None))
        else:
            hi = k + rng.randrange(-2, 8)
            ranges.append((k, hi, seq))
            for x in [x for x in model if k <= x < hi]:
                del model[x]
    state = M.live_state(spark.createDataFrame(puts, "key long, seq long, op string, value long"))
    cuts = spark.createDataFrame(ranges, "lower long, upper long, range_seq long")
    few = {r.key: r.value for r in M.delete_ranges(state, cuts).collect()}
    assert few == model
    careless = {r.key for r in state.join(cuts, F.expr("lower <= key AND key < upper"), "left_anti").collect()}
    assert careless != set(model)


@pytest.mark.parametrize("buckets", [2, 5, 256])
def test_ranges_against_all_pairs(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    rng = random.Random(buckets)
    entries = [(rng.randrange(200), rng.randrange(400)) for _ in range(300)]
    cuts = [(lo, lo + rng.choice([-3, 0, 1, 5, 40, 500]), rng.randrange(400)) for lo in (rng.randrange(200) for _ in range(60))]
    got = M.delete_ranges(spark.createDataFrame(entries, "key long, seq long"), spark.createDataFrame(cuts, "lower long, upper long, range_seq long"))
    want = [(k, s) for k, s in entries if not any(lo <= k < hi and n > s for lo, hi, n in cuts)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    none = M.delete_ranges(spark.createDataFrame(entries, "key long, seq long"), spark.createDataFrame([(5, 5, 1)], "lower long, upper long, range_seq long"))
    assert none.count() == len(entries)


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_running_values_over_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(int(parts))
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.randrange(50)])) for i in range(200)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "part string, n long, v long")
        most = {r.n: r.x for r in running(df, ["part"], ["n"], F.col("v"), "x").collect()}
        last = {r.n: r.x for r in running(df, ["part"], ["n"], F.col("v"), "x", how="last").collect()}
        back = {(r.n, r.before) for r in replay.going_back(df.withColumn("arrival", (F.col("n") * 37) % 211).withColumn("seq", F.col("n"))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for p, n, _ in rows:
        seen = [v for q, m, v in rows if q == p and m <= n and v is not None]
        assert most[n] == max(seen, default=None) and last[n] == (seen[-1] if seen else None)
    want = set()
    for p in "ab":
        order = sorted((n * 37 % 211, n) for q, n, _ in rows if q == p)
        want |= {(n, b) for (_, b), (_, n) in zip(order, order[1:]) if n <= b}
    assert back == want


def test_marks_that_arrive_together(spark):
    """Whatever order the rows are read in, of marks with the same seq the lower one comes first, so neither refuses the other."""
    rows = [(0, 1, 5), (0, 2, 9), (0, 2, 7), (0, 2, 4), (0, 3, 8), (1, 2, 1)]
    for given in (rows, rows[::-1]):
        refused = replay.refused_watermarks(spark.createDataFrame(given, "part long, seq long, mark long").coalesce(1))
        assert sorted((r.part, r.seq, r.mark) for r in refused.collect()) == [(0, 2, 4), (0, 3, 8)]


FILE = "level long, file_number long, smallest_key long, largest_key long, num_entries long, num_tombstones long, num_range_tombstones long, smallest_range_key long, largest_range_key long, min_write_us long, max_write_us long, file_bytes long, place long"


def store(spark, **rows):
    base = {"level": 1, "smallest_key": 0, "largest_key": 9, "num_entries": 10, "num_tombstones": 0, "num_range_tombstones": 0, "smallest_range_key": None, "largest_range_key": None, "min_write_us": 1, "max_write_us": 1, "file_bytes": 10, "place": 0}
    made = [base | {"file_number": int(k[1:])} | v for k, v in rows.items()]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in FILE.split(", ")) for r in made], FILE)


def test_golden_file_rules(spark):
    numbers = lambda df: {r.file_number for r in df.collect()}
    # Older is deeper, or lower in number: an overlapping older file keeps an expired one alive, whenever it was written.
    f = store(spark, f1={"level": 2, "max_write_us": 900}, f2={"level": 1, "max_write_us": 100}, f3={"level": 1, "smallest_key": 20, "largest_key": 29, "max_write_us": 100}, f4={"level": 2, "smallest_key": 40, "largest_key": 49, "max_write_us": 0}, f5={"level": 1, "smallest_key": 60, "largest_key": 69, "max_write_us": 100, "num_range_tombstones": 1})
    assert numbers(layout.expired(f, 500)) == {3} and numbers(layout.expired(f, 900)) == {1, 3}
    # A newer file's range must hold the whole file; its upper bound is exclusive.
    f = store(spark, f1={"level": 2}, f2={"level": 2, "largest_key": 10, "smallest_key": 3}, f3={"level": 0, "num_range_tombstones": 2, "smallest_range_key": 0, "largest_range_key": 10}, f4={"level": 0, "num_entries": 5}, f5={"level": 0}, f6={"level": 2, "num_entries": 0}, f7={"level": 1})
    assert {(r.file_number, r.exact) for r in layout.range_dropped(f).collect()} == {(1, False), (7, False)}
    assert numbers(layout.truncated(store(spark, f1={}, f2={"largest_range_key": 50}, f3={"largest_key": 30}), 10)) == {1}
    # Density is asked of files with enough entries only.
    f = store(spark, f1={"num_entries": 2, "num_tombstones": 2}, f2={"num_entries": 100, "num_tombstones": 25})
    levels = spark.createDataFrame([(1, 100, 10**9)], "level long, max_files long, max_bytes long")
    assert layout.level_scores(f, levels, 0.5, 10).first().score == 0.5 and layout.level_scores(f, levels, 0.5).first().score == 2.0


@pytest.mark.parametrize("parts", ["1", "3"])
def test_spans_that_meet_against_all_pairs(spark, parts):
    rng, rows, before = random.Random(int(parts)), {}, spark.conf.get("spark.sql.shuffle.partitions")
    for n in rng.sample(range(500), 60):
        lo, cut = rng.randrange(60), rng.randrange(60)
        span = {"smallest_key": lo, "largest_key": lo + rng.randrange(12)} if rng.random() < 0.9 else {"smallest_key": None, "largest_key": None}
        ranges = rng.choice([0, 0, 1, 2])
        hull = {"smallest_range_key": cut, "largest_range_key": cut + rng.randrange(30)} if ranges else {}
        rows[f"f{n}"] = {"level": rng.randrange(4), "file_bytes": rng.randrange(100), "max_write_us": rng.randrange(10), "num_range_tombstones": ranges, "num_entries": rng.randrange(4)} | span | hull
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        f = store(spark, **rows)
        below = {r.file_number: (r.overlapped, r.bytes) for r in layout.overlapped(f).collect()}
        gone = {r.file_number for r in layout.expired(f, 7).collect()}
        dropped = {r.file_number: r.exact for r in layout.range_dropped(f).collect()}
        for n in (0, 1):
            few = f.limit(n)
            assert layout.overlapped(few).count() == layout.range_dropped(few).count() == 0 and layout.expired(few, 7).count() <= n
        all_files = f.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known = [r for r in all_files if r.smallest_key is not None]
    meet = lambda a, b: a.smallest_key is not None and a.smallest_key <= b.largest_key and b.smallest_key <= a.largest_key
    age = lambda r: (r.level, -r.file_number)
    want = {a.file_number: [b.file_bytes for b in known if b.level == a.level + 1 and meet(a, b)] for a in known}
    assert below == {k: (len(v), sum(v)) for k, v in want.items() if v} and below
    old = [a for a in all_files if 0 < a.max_write_us <= 7 and not a.num_range_tombstones]
    assert gone == {a.file_number for a in old if not any(age(b) > age(a) and meet(a, b) for b in known)} and gone
    covers = {a.file_number: [c.num_range_tombstones == 1 for c in all_files if c.num_range_tombstones and age(c) < age(a) and c.smallest_range_key <= a.smallest_key and a.largest_key < c.largest_range_key] for a in known if not a.num_range_tombstones and a.num_entries}
    assert dropped == {k: any(v) for k, v in covers.items() if v} and {True, False} == set(dropped.values())


@pytest.mark.parametrize("name", ["compaction_overlap", "ttl_expired_files", "range_drop_files"])
def test_no_join_compares_spans(spark, name):
    """A join on a comparison of keys alone, or in a level, tries all pairs of files. Here comparisons stand only with an equal partition, of which a
    running value has one row."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not [j for j in joins if "driftlog_p" not in j and ("<" in j or ">" in j)]


def test_golden_migrations(spark):
    schema = "tier long, max_age_us long, max_bytes long, transient boolean"
    pick = lambda f, t: [tuple(r) for r in layout.pick_migration(f, spark.createDataFrame(t, schema), 1000).collect()]
    two = lambda **x: [(0, x.get("age", 100), x.get("room"), x.get("transient", False)), (1, None, None, False)]
    f = store(spark, f1={"min_write_us": 950}, f2={"min_write_us": 10}, f3={"min_write_us": 5, "level": 0}, f4={"min_write_us": 20, "level": 2})
    assert pick(f, two()) == [(2, 0, 1, False, False)]  # by age, in store order; level 0 stays
    assert pick(f, two(transient=True)) == [(2, 0, 1, True, False)]
    assert pick(f, two(age=10**6, room=25)) == [(2, 0, 1, False, True)]  # three files of ten bytes: the oldest goes
    assert pick(f, two(age=10**6, room=30)) == [] and pick(f, [(0, None, 5, True)]) == []
    # The newest write does not make a file young.
    assert layout.placement(store(spark, f1={"min_write_us": 10, "max_write_us": 999}), spark.createDataFrame(two(), schema), 1000).first().tier == 1


def test_a_reader_keeps_its_version(spark, tmp_path):
    writer, reader = StateTable(spark, f"file://{tmp_path}/s"), StateTable(spark, f"file://{tmp_path}/s")
    with pytest.raises(Stale):
        reader.read()
    writer.flush(spark.range(5).withColumnRenamed("id", "key"))
    assert reader.read().count() == 5
    writer.flush(spark.range(9).withColumnRenamed("id", "key"))
    assert reader.read().count() == 5 and reader.refresh() == 2 and reader.read().count() == 9
    writer.flush(spark.range(3).withColumnRenamed("id", "key"))
    writer.expire()
    with pytest.raises(Stale):
        reader.read()


def test_a_selective_read_does_not_grow_with_the_state(spark, tmp_path):
    """Rows that the scan gives for a range of 100 keys, in a state of 20,000 and one of 200,000."""
    seen = []
    for n in (20_000, 200_000):
        store = StateTable(spark, f"file://{tmp_path}/{n}")
        store.flush(spark.range(n).select(F.col("id").alias("key"), F.rand(1).alias("value")), parts=n // 2_000)
        df = M.scan(store.read(), lower=5_000, upper=5_100)
        assert [r.key for r in df.collect()] == list(range(5_000, 5_100))
        leaf = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in leaf
        files = store.read().filter("key >= 5000 AND key < 5100").select(F.input_file_name()).distinct().count()
        seen.append(files)
    assert seen[0] == seen[1] == 1


def test_scans_keep_order(spark):
    state = spark.range(50).select(((F.col("id") * 17) % 50).alias("key"), F.col("id").alias("seq")).repartition(4)
    assert [r.key for r in M.scan(state, lower=10, upper=30).collect()] == list(range(10, 30))
    assert [r.key for r in M.scan(state, reverse=True).collect()] == list(range(49, -1, -1))
    assert [r.key for r in M.next_batch(state, 4, after=20).collect()] == [21, 22, 23, 24] and [r.key for r in M.next_batch(state, 3, after=2, reverse=True).collect()] == [1, 0]
    rows = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate([("a", 1), ("b", 0), ("a", 12), ("b", 11), ("a", 1)])], "key string, us long, seq long").withColumn("us", F.col("us") * 1_000_000)
    order = [(r.key, r.us // 1_000_000, r.seq) for r in temporal.in_store_order(rows, 10).collect()]
    assert order == [("a", 1, 0), ("a", 1, 4), ("b", 0, 1), ("a", 12, 2), ("b", 11, 3)]
    assert [(r.key, r.us // 1_000_000, r.seq) for r in temporal.in_store_order(rows, 10, backward=True).collect()] == order[::-1]


def test_commit_outcomes():
    class ProducerDead(Exception): ...

    class AbortableNotCommitted(Exception): ...

    def fails(e):
        raise e("x")

    assert [replay.commit(lambda: None), replay.commit(lambda: fails(ProducerDead)), replay.commit(lambda: fails(AbortableNotCommitted)), replay.commit(lambda: fails(KeyError))] == ["committed", "unknown", "aborted", "unknown"]


def test_golden_sessions_and_versions(spark):
    at = lambda rows: spark.createDataFrame(rows, "k string, s long, seq long, value long").withColumn("ts", F.timestamp_seconds("s"))
    got = temporal.sessions(at([("a", 0, 1, 1), ("a", 60, 2, 1), ("a", 30, 3, 1)]), 30, "k").select(F.unix_seconds("session_start").alias("a"), F.unix_seconds("session_end").alias("b"), "n").collect()
    assert [tuple(r) for r in got] == [(0, 60, 3)]
    v = temporal.versions(at([("w", 1, 1, 10), ("w", 5, 2, None)]), "k", "s")
    assert temporal.current(v).count() == 0 and temporal.as_of(v, 3).first().value == 10
    orders = spark.createDataFrame([("w", 3, "o1"), ("w", 9, "o2"), ("w", 0, "o3")], "k string, s long, o string")
    assert [r.o for r in temporal.asof_join(orders, v, "k", "s").collect()] == ["o1"]


def test_manifest_stops_at_the_first_gap(spark):
    for seqs, want in (([1, 2, 4], {1, 2}), ([2, 3], set()), (list(range(1, 4101)) + [4102], set(range(1, 4101))), ([], set())):
        edits = spark.createDataFrame([(s, s, "add") for s in seqs], "seq long, file_number long, action string")
        assert {r.file_number for r in layout.manifest_replay(edits).collect()} == want


def test_tiers_are_checked():
    layout.check_tiers([{"max_age_us": 1}, {"max_age_us": None}])
    with pytest.raises(ValueError):
        layout.check_tiers([{"max_age_us": None}, {"max_age_us": 3}])


def test_points_within_disjoint_intervals(spark):
    rng = random.Random(4)
    spans = [(k, lo, lo + rng.randrange(0, 6)) for k in range(3) for lo in range(0, 60, 7)]
    points = [(k, rng.randrange(-3, 70), n) for n, k in enumerate([0, 1, 2, 3] * 30)]
    got = temporal.covered(spark.createDataFrame(points, "key long, at long, n long"), spark.createDataFrame(spans, "key long, lower long, upper long")).collect()
    want = [(k, at, n, lo, hi) for k, at, n in points for j, lo, hi in spans if j == k and lo <= at <= hi]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_changelog_starts_anew_after_a_delete(spark):
    rows = [("a", 1, "put", 5), ("a", 2, "put", 6), ("b", 3, "delete", None), ("a", 4, "delete", 9), ("a", 5, "put", 1)]
    got = M.changelog(spark.createDataFrame(rows, "key string, seq long, op string, value long")).collect()
    assert sorted(tuple(r) for r in got if r.key == "a") == [("a", 1, 5), ("a", 2, 11), ("a", 4, None), ("a", 5, 1)] and [r.total for r in got if r.key == "b"] == [None]


def test_the_retention_bound_of_windows_and_versions(spark):
    rows = spark.createDataFrame([(0, 1, 100), (0, 2, 90), (0, 3, 89), (0, 4, 91)], "part long, seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.seq for r in temporal.in_time(rows, 10).collect()} == {1, 4}
    assert {r.seq for r in temporal.in_time(rows, 10, closed=True).collect()} == {1, 2, 4}


def test_store_layout(spark):
    tiers = spark.createDataFrame([(0, 10), (1, 10), (2, None), (3, 99)], "tier int, max_age_us long")
    assert {r.tier for r in layout.faulty_tiers(tiers).collect()} == {1, 3}
    files = spark.createDataFrame([(1, 0, 500, 10), (2, 0, 30, 20), (3, 1, 30, 5), (4, 1, 1, 6)], "file_number long, store long, file_bytes long, max_write_us long")
    assert {r.file_number for r in layout.trim_to_budget(files.filter("store = 0"), 100).collect()} == {1}
    assert {r.file_number for r in layout.trim_to_budget(files.filter("store = 1"), 30).collect()} == {3}
    assert {r.file_number for r in layout.surviving_stores(files, files.filter("file_number <> 2")).collect()} == {3, 4}


def test_compaction_plan(spark):
    """By hand. Level 1: 1 [0, 3], 2 [4, 7], 3 [8, 11]; level 2: 11 [5, 10]; level 3: 21 [0, 20]."""
    span = lambda level, lo, hi, **more: {"level": level, "smallest_key": lo, "largest_key": hi} | more
    tree = {"f1": span(1, 0, 3), "f2": span(1, 4, 7), "f3": span(1, 8, 11), "f11": span(2, 5, 10), "f21": span(3, 0, 20, file_bytes=500)}

    def plan(pointer, budget=10**9, limit=10**9, **change):
        rows = layout.compaction_plan(store(spark, **(tree | change)), 1, pointer, budget, limit).collect()
        flags = {(r.bottommost, r.trivial_move) for r in rows}
        return sorted((r.role, r.file_number) for r in rows), flags.pop() if flags else None

    alone, both = [("grandparent", 21), ("input", 1)], [("grandparent", 21), ("input", 2), ("input", 3), ("overlap", 11)]
    assert plan(None) == (alone, (False, True)) and plan(11) == (alone, (False, True))  # past the last file, the first again
    assert plan(None, limit=500)[1] == (False, False)
    assert plan(3) == (both, (False, False)) and plan(4) == plan(3)
    assert plan(3, budget=30)[0] == both and plan(3, budget=29)[0] == [x for x in both if x != ("input", 3)]
    touching = plan(3, f12=span(2, 11, 15))[0]  # file 3 would bring in 12
    assert ("input", 3) not in touching and ("overlap", 12) not in touching
    bottom = {"f21": span(3, 15, 20)}
    assert plan(None, **bottom) == ([("input", 1)], (True, True))
    assert plan(None, f1=span(1, 0, 3, num_tombstones=1), **bottom)[1] == (True, False)
    reach = plan(None, f1=span(1, 0, 3, num_range_tombstones=1, smallest_range_key=0, largest_range_key=5))[0]
    assert ("overlap", 11) in reach  # range tombstones count to the span
    assert layout.compaction_plan(store(spark, **tree), 7, None, 1, 1).count() == 0


def test_jitter_only_shortens(spark):
    tiers = spark.createDataFrame([(0, 100), (1, None)], "tier int, max_age_us long")
    f = store(spark, **{f"f{n}": {"min_write_us": 1000 - 90} for n in range(1, 41)}, f90={"min_write_us": 1000 - 79}, f91={"min_write_us": 1000 - 101})
    placed = lambda **more: {r.file_number: r.tier for r in layout.placement(f, tiers, 1000, **more).collect()}
    assert {n for n, t in placed().items() if t} == {91}
    late = placed(jitter_percent=20)
    assert late == placed(jitter_percent=20) and late[90] == 0 and late[91] == 1 and 5 < sum(late.values()) < 36


def test_window_stores_that_cannot_be(spark):
    rows = [("ok", 100, 100, None), ("wide", 100, 101, None), ("none", 0, 1, None), ("cut", 100, 1, 0)]
    got = temporal.faulty_windows(spark.createDataFrame(rows, "name string, retention_ms long, window_ms long, segment_ms long"))
    assert sorted(map(tuple, got.collect())) == [("cut", "segment"), ("none", "retention"), ("wide", "too wide")]


def test_compaction_ages_by_file_number(spark):
    f = store(spark, f1={"max_write_us": 900, "largest_key": 4}, f2={"max_write_us": 100, "smallest_key": 4}, f3={"smallest_key": 50, "largest_key": 60})
    numbers = lambda df: {r.file_number for r in df.collect()}
    assert numbers(layout.trim_to_budget(f, 10)) == {1} and numbers(layout.trim_to_budget(f, 20)) == {1, 2}
    assert numbers(layout.compaction_inputs(f)) == {1, 2} and numbers(layout.compaction_inputs(f.filter("file_number > 2"))) == {3}
