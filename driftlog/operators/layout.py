"""Storage layout as tables: files, levels, tiers, what to compact, expire, drop or move, and resume points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def overlapped(files: DataFrame, depth: int = 1) -> DataFrame:
    """(file_number, overlapped, bytes) of files whose key spans meet files `depth` levels deeper: how many, and their bytes.

    No pairs are made: of the deeper level's files, those that begin up to a file's end meet it unless they end before its start, and
    running sums in key order count both. A file gives four rows, and those of one key spread over tasks by file number."""
    row = lambda level, key, edge, side, n, size: F.struct(level.alias("at"), key.alias("pos"), F.lit(edge).alias("edge"), F.lit(side).alias("side"), F.lit(n).alias("one"), size.alias("size"))
    level, lo, hi, size = F.col("level"), F.col("smallest_key"), F.col("largest_key"), F.col("file_bytes")
    rows = files.filter("level IS NOT NULL AND smallest_key IS NOT NULL AND largest_key IS NOT NULL").select("file_number", F.explode(F.array(
        row(level, lo, 1, 1, 1, size), row(level + depth, hi, 1, 2, 0, size * 0),  # starts, and who asks for those up to its end
        row(level, hi, -1, 1, 1, size), row(level + depth, lo, -1, 0, 0, size * 0),  # ends, and who asks for those before its start
    )).alias("r")).select("file_number", "r.*")
    sums = running(rows, ["at", "edge"], ["pos", "side", "file_number"], [F.col("one"), F.col("size")], ["n", "total"], how="sum")
    found = sums.filter("side <> 1").groupBy("file_number").agg(F.sum(F.col("edge") * F.col("n")).alias("overlapped"), F.sum(F.col("edge") * F.col("total")).alias("bytes"))
    return found.filter("overlapped > 0")


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(
        F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"), F.sum("num_entries").alias("entries"), F.sum("num_tombstones").alias("tombstones"),
        F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"),
    )


def level_scores(files: DataFrame, levels: DataFrame, tombstone_trigger: float, min_entries: int = 1) -> DataFrame:
    """The worst of files and bytes against their limits, and of the densest file's tombstones against the trigger; over 1 wants compaction.
    Files with fewer than min_entries entries say nothing about density."""
    dense = F.when(F.col("num_entries") >= max(min_entries, 1), F.col("num_tombstones") / F.col("num_entries"))
    s = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_bytes").alias("b"), F.coalesce(F.max(dense), F.lit(0.0)).alias("t")).join(levels, "level")
    return s.select("level", F.greatest(F.col("n") / F.col("max_files"), F.col("b") / F.col("max_bytes"), F.col("t") / tombstone_trigger).alias("score"))


def level_to_compact(scores: DataFrame) -> DataFrame:
    """The level with the worst score, if that is over 1; the shallowest of equals."""
    return scores.filter("score > 1").orderBy(F.desc("score"), "level").limit(1)


def placement(files: DataFrame, tiers: DataFrame, now_us, jitter_percent: int = 0) -> DataFrame:
    """The first tier whose greatest age the file's oldest write hasn't passed; null max_age_us is no limit, a write ahead of now is new.

    With jitter each file's limits are shorter by up to that share, always the same for a file, so that files written together don't move together."""
    age = F.greatest(F.lit(now_us) - F.col("min_write_us"), F.lit(0))
    part = F.pmod(F.col("file_number") * 2654435761, F.lit(1 << 32)) / (1 << 32) * (jitter_percent / 100)
    fit = files.join(F.broadcast(tiers.select("tier", "max_age_us")), F.col("max_age_us").isNull() | (age <= F.col("max_age_us") * (1 - part)))  # a row per tier: a few
    return fit.groupBy("file_number").agg(F.min(fit["tier"]).alias("tier"))


def pick_migration(files: DataFrame, tiers: DataFrame, now_us) -> DataFrame:
    """The one file to move next, with its tiers. files have `place`, the tier that they are in; tiers: tier, max_age_us, max_bytes, transient.

    First what must leave a transient tier, by age and then by room, then what a durable tier has no room for, oldest first; last what is
    past its tier's age, in store order. Level 0 never moves, nor does what is in the last tier for lack of room."""
    f = files.filter("level > 0").join(placement(files, tiers, now_us).withColumnRenamed("tier", "target"), "file_number")
    t = tiers.select(F.col("tier").alias("place"), "max_bytes", "transient").join(tiers.agg(F.max("tier").alias("last")))
    full = f.groupBy("place").agg(F.sum("file_bytes").alias("held"))
    f = f.join(F.broadcast(t), "place").join(F.broadcast(full), "place").withColumn("over", F.coalesce(F.col("held") > F.col("max_bytes"), F.lit(False)) & (F.col("place") < F.col("last")))
    past = F.col("target") > F.col("place")
    moves = F.array(
        F.when(F.col("transient") & past, F.struct(F.lit(1).alias("step"), "place", F.lit(0).alias("room"), F.col("min_write_us").alias("age"))),
        F.when(F.col("transient") & F.col("over"), F.struct(F.lit(1).alias("step"), "place", F.lit(1).alias("room"), F.col("min_write_us").alias("age"))),
        F.when(F.col("over"), F.struct(F.lit(2).alias("step"), "place", F.lit(1).alias("room"), F.col("min_write_us").alias("age"))),
        F.when(past, F.struct(F.lit(3).alias("step"), "place", F.lit(0).alias("room"), F.lit(0).cast("long").alias("age"))),
    )
    found = f.withColumn("move", F.explode(F.array_compact(moves)))
    found = found.orderBy("move", "level", "smallest_key", "file_number").limit(1)
    return found.select("file_number", F.col("place").alias("from_tier"), F.when(F.col("move.room") == 1, F.col("place") + 1).otherwise(F.col("target")).alias("to_tier"), (F.col("move.step") == 1).alias("leaves_transient"), (F.col("move.room") == 1).alias("capacity_eviction"))


def tier_stats(files: DataFrame, tiers: DataFrame, now_us) -> DataFrame:
    """Files, bytes, entries and the oldest write of each tier that holds any, by where files belong now."""
    return files.join(placement(files, tiers, now_us), "file_number").groupBy("tier").agg(F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"), F.sum("num_entries").alias("entries"), F.min("min_write_us").alias("oldest_us"))


def faulty_tiers(tiers: DataFrame) -> DataFrame:
    """Tiers whose greatest age doesn't exceed that of the tier before, or that follow one without limit."""
    w = Window.orderBy("tier")
    age = F.col("max_age_us")
    rows = tiers.withColumns({"n": F.row_number().over(w), "before": F.lag(age).over(w)})
    return rows.filter((F.col("n") > 1) & (F.col("before").isNull() | F.coalesce(age <= F.col("before"), F.lit(False)))).select("tier")


def backpressure(files: DataFrame, levels: DataFrame) -> DataFrame:
    """Whether each level's number of files slows writes down or stops them. levels: level, slowdown, stop."""
    n = F.coalesce(F.col("n"), F.lit(0))
    rows = levels.join(files.groupBy("level").agg(F.count("*").alias("n")), "level", "left")
    return rows.select("level", F.when(n >= F.col("stop"), "stop").when(n >= F.col("slowdown"), "slowdown").otherwise("go").alias("writes"))


def trim_to_budget(inputs: DataFrame, budget_bytes: int) -> DataFrame:
    """The oldest inputs of a compaction, by file number, that fit into a budget together; the first one always goes. One row a file of one level."""
    w = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = inputs.withColumns({"run": F.sum("file_bytes").over(w), "n": F.row_number().over(w)})
    return rows.filter((F.col("run") <= budget_bytes) | (F.col("n") == 1)).drop("run", "n")


def surviving_stores(files: DataFrame, listing: DataFrame, store="store") -> DataFrame:
    """Files of stores that have lost none: one missing object discards its whole store."""
    lost = files.join(listing.select("file_number").distinct(), "file_number", "left_anti").select(store).distinct()
    return files.join(lost, store, "left_anti")


def _reach(files: DataFrame, asked, given, pos, start, ends: dict, older: bool) -> DataFrame:
    """Rows of asked files, several a file, with the furthest of each of `ends` among the given files that begin up to `pos` and are older than the
    file, or newer if not `older`; null where a row finds none. A file's furthest is the greatest over its rows.

    Recency is by place: a deeper level is older, and so is a lower file number of the same level. No pairs are made. Files are ranked by age; for each bit of the ranks, the files whose ranks agree above that bit are a block, and its
    older half meets its newer one. Any two files are in different halves of one block, once. In a block a running maximum in key order answers
    all that ask, so n files give n rows a bit, and no block need fit one task."""
    known = files.filter("level IS NOT NULL AND file_number IS NOT NULL").select("*", F.lit(0).alias("one"), (-F.col("file_number")).alias("late"))
    ranked = running(known, ["one"], ["level", "late"], F.lit(1), "rank", how="sum").withColumn("rank", F.col("rank") - 1)
    bits = int(ranked.agg(F.max("rank")).first()[0] or 0).bit_length()
    rows = ranked.withColumn("bit", F.explode(F.sequence(F.lit(1), F.lit(bits)))) if bits else ranked.withColumn("bit", F.lit(1)).limit(0)
    rows = rows.withColumns({"block": F.expr("shiftright(rank, bit)"), "asks": (F.expr("shiftright(rank, bit - 1)") % 2 == (0 if older else 1))})
    rows = rows.filter(F.when(F.col("asks"), asked).otherwise(given & start.isNotNull()))
    rows = rows.withColumns({"pos": F.when(F.col("asks"), pos).otherwise(start), "side": F.col("asks").cast("int")})
    found = running(rows, ["bit", "block"], ["pos", "side", "rank"], [F.when(~F.col("asks"), e) for e in ends.values()], list(ends), how="max")
    return found.filter("asks").select(*files.columns, *ends)


def expired(files: DataFrame, cutoff_us) -> DataFrame:
    """Files wholly past their time, without range tombstones and without an overlapping older file that they would uncover. A file whose
    newest write isn't known (0 or null) never expires."""
    past = F.coalesce((F.col("max_write_us") > 0) & (F.col("max_write_us") <= F.lit(cutoff_us)) & (F.col("num_range_tombstones") == 0), F.lit(False))
    found = _reach(files, past, F.lit(True), F.col("largest_key"), F.col("smallest_key"), {"reach": F.col("largest_key")}, older=True)
    hides = found.filter(F.col("reach") >= F.col("smallest_key")).select("file_number").distinct()
    return files.filter(past).join(hides, "file_number", "left_anti")


def truncated(files: DataFrame, floor) -> DataFrame:
    """Files of which all lies below the floor, range tombstones too."""
    return files.filter(F.coalesce(F.greatest("largest_key", "largest_range_key"), F.lit(floor)) < F.lit(floor))


def range_dropped(files: DataFrame) -> DataFrame:
    """(file_number, exact) of files that a newer file's range tombstones cover as a whole. Files with range tombstones of their own, and
    files without entries, stay. exact: some cover has a single tombstone, so the hull that the manifest knows has no gaps."""
    covers, own = F.coalesce(F.col("num_range_tombstones") > 0, F.lit(False)), F.coalesce((F.col("num_range_tombstones") == 0) & (F.col("num_entries") > 0), F.lit(False))
    end = F.col("largest_range_key")
    found = _reach(files, own, covers, F.col("smallest_key"), F.col("smallest_range_key"), {"any": end, "single": F.when(F.col("num_range_tombstones") == 1, end)}, older=False)
    inside = found.filter(F.col("largest_key") < F.col("any"))
    return inside.groupBy("file_number").agg(F.bool_or(F.coalesce(F.col("largest_key") < F.col("single"), F.lit(False))).alias("exact"))


def orphans(listing: DataFrame, files: DataFrame, now_us, retention_us) -> DataFrame:
    """Objects (object, first_seen_us) that no file refers to and that have been so for the retention."""
    gone = listing.join(files.select(F.col("file_number").alias("object")), "object", "left_anti")
    return gone.filter(F.lit(now_us) - F.col("first_seen_us") >= F.lit(retention_us)).select("object")


def store_totals(files: DataFrame) -> DataFrame:
    """One row for the whole store."""
    return files.agg(F.count("*").alias("files"), F.sum("file_bytes").alias("bytes"), F.sum("num_entries").alias("entries"), F.sum("num_tombstones").alias("tombstones"), F.sum("num_range_tombstones").alias("range_tombstones"), F.min("min_write_us").alias("oldest_us"), F.max("watermark_high").alias("position"))


def recovery_watermark(files: DataFrame) -> DataFrame:
    """files (part, lost, watermark_low, watermark_high) -> (part, resume): the greatest high where nothing is lost; else the least low of lost
    files, or none if one has no low. Replay goes on after it."""
    lost = F.col("lost")
    return files.groupBy("part").agg(F.max("watermark_high").alias("high"), F.min(F.when(lost, F.col("watermark_low"))).alias("low"), F.bool_or(lost).alias("any"), F.bool_or(lost & F.col("watermark_low").isNull()).alias("blind")).select(
        "part", F.when(~F.col("any"), F.col("high")).when(F.col("blind"), F.lit(None)).otherwise(F.col("low")).alias("resume"))


def compaction_inputs(files: DataFrame) -> DataFrame:
    """The oldest file, the one of lowest number, and all that it overlaps, directly or through others: the key span grows until no more files meet it."""
    first = files.orderBy("file_number").limit(1).select("smallest_key", "largest_key").first()
    if first is None:
        return files
    lo, hi = first
    while True:
        span = files.filter((F.col("smallest_key") <= F.lit(hi)) & (F.col("largest_key") >= F.lit(lo))).agg(F.min("smallest_key"), F.max("largest_key")).first()
        if (span[0], span[1]) == (lo, hi):
            return files.filter((F.col("smallest_key") <= F.lit(hi)) & (F.col("largest_key") >= F.lit(lo)))
        lo, hi = span


def _spans(files: DataFrame) -> DataFrame:
    """With lo and hi, the keys that a file's entries and range tombstones reach together."""
    return files.withColumns({"lo": F.least("smallest_key", "smallest_range_key"), "hi": F.greatest("largest_key", "largest_range_key")})


def next_input(files: DataFrame, level: int, pointer=None) -> DataFrame:
    """The first file of a sorted level that ends after the compaction pointer; past the last one, the first of the level again."""
    follows = F.lit(True) if pointer is None else F.coalesce(F.col("largest_key") > F.lit(pointer), F.lit(False))
    return _spans(files.filter(F.col("level") == level)).orderBy(follows.desc(), "lo", "file_number").limit(1)


def compaction_plan(files: DataFrame, level: int, pointer, budget_bytes: int, grandparent_bytes: int) -> DataFrame:
    """(file_number, role, bottommost, trivial_move) of the next compaction of a sorted level; no rows where the level is empty.

    The input is next_input() and its overlaps are those of the level below. Where the span of both holds more inputs, they come along
    if all fit into the budget and touch no further overlap. Grandparents lie two levels down. bottommost: nothing deeper than the output
    meets the span, so tombstones can go. trivial_move: a lone input can change its level unwritten, as it overlaps nothing, no tombstone
    would be stuck at the bottom, and the grandparents' bytes stay below a limit. Rows are a store's files; the driver sees four numbers a step."""
    f = _spans(files)
    meets = lambda span: (F.col("lo") <= F.lit(span[1])) & (F.col("hi") >= F.lit(span[0]))
    below = lambda n, span: f.filter((F.col("level") == level + n) & meets(span))
    size = lambda rows: rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    around = lambda span, s: (min(span[0], s.lo), max(span[1], s.hi))
    seed = next_input(files, level, pointer).first()
    if seed is None:
        return f.select("file_number", F.lit("input").alias("role"), F.lit(True).alias("bottommost"), F.lit(False).alias("trivial_move")).limit(0)
    span, grown = (seed.lo, seed.hi), False
    overlaps = below(1, span)
    beneath = size(overlaps)
    if beneath.n:
        wide = around(span, beneath)
        more = size(below(0, wide))
        wider = around(wide, more)
        grown = more.n > 1 and more.bytes + beneath.bytes <= budget_bytes and size(below(1, wider)).n == beneath.n
    inputs = below(0, wide) if grown else f.filter((F.col("level") == level) & (F.col("file_number") == seed.file_number))
    span = wider if grown else span
    grandparents = below(2, span)
    bottommost = f.filter((F.col("level") > level + 1) & meets(span)).isEmpty()
    stuck = bottommost and bool(seed.num_tombstones or seed.num_range_tombstones)
    trivial = not grown and not beneath.n and not stuck and size(grandparents).bytes < grandparent_bytes
    role = lambda rows, name: rows.select("file_number", F.lit(name).alias("role"))
    plan = role(inputs, "input").unionByName(role(overlaps, "overlap")).unionByName(role(grandparents, "grandparent"))
    return plan.withColumns({"bottommost": F.lit(bottommost), "trivial_move": F.lit(trivial)})


def manifest_replay(edits: DataFrame) -> DataFrame:
    """edits (seq, file_number, action) -> live files: those of the contiguous run of seqs from 1, the last action deciding.

    Distinct seqs are ranked by the count of those before in their block of 4096 plus a count of blocks, so no task sees all."""
    seqs = edits.select("seq").distinct().withColumn("block", F.floor((F.col("seq") - 1) / 4096))
    full = seqs.groupBy("block").agg(F.count("*").alias("n"), F.max(F.col("seq") - F.col("block") * 4096).alias("m"))
    gap = full.filter((F.col("n") < 4096) | (F.col("m") > 4096)).agg(F.coalesce(F.min("block"), F.lit(2**40)).alias("first"))
    inside = Window.partitionBy("block").orderBy("seq")
    last = seqs.join(F.broadcast(gap), F.col("block") == F.col("first")).withColumn("k", F.row_number().over(inside)).filter(F.col("seq") == F.col("block") * 4096 + F.col("k")).agg(F.max("seq").alias("top"))
    bound = gap.join(last, F.lit(True)).select(F.coalesce("top", F.col("first") * 4096).alias("top"))
    kept = edits.join(F.broadcast(bound), F.col("seq") <= F.col("top"), "left_semi")
    return kept.groupBy("file_number").agg(F.max_by("action", "seq").alias("action")).filter("action = 'add'").select("file_number")


def manifest_counters(snapshot: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: the floor and the next file number after a snapshot (floor, next_file) and the edits (floor, next_file) that follow; both only rise."""
    both = snapshot.select("floor", "next_file").unionByName(edits.select("floor", "next_file"))
    return both.agg(F.max("floor").alias("floor"), F.max("next_file").alias("next_file"))


def geometric_levels(spark, base_bytes: int, ratio: int, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("level"), (F.lit(base_bytes) * F.pow(F.lit(ratio), F.col("id"))).cast("long").alias("max_bytes"))


def check_tiers(tiers: list[dict]) -> None:
    """Ages must grow from tier to tier and only the last may be without limit."""
    ages = [t.get("max_age_us") for t in tiers]
    if not tiers or any(a is None for a in ages[:-1]) or any(b is not None and b <= a for a, b in zip(ages, ages[1:])):
        raise ValueError("tiers need growing greatest ages, and a limit on all but the last")
