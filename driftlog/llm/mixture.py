"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], piecewise linear. Its integral is the source's
weight; weights share out all words, and a source is repeated at most MOST times, the excess going to the others. A
source's documents stand in a fixed hashed order and are read round and round: a document of the source has a
cumulative token demand, and inverting the integrated schedule at that demand gives the time at which it
is trained on. Documents are range-sorted by that position. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, reserved

MOST = 3
#: (time, weight) knots; sources in code point order take them in turn. Their integrals are 1, 2 and 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
#: Rows of a source that one window takes, about; at most 16 ** 5 windows a source.
GROUP = 200


def integral(knots) -> list[float]:
    """The schedule's integral up to each knot."""
    out = [0.0]
    for (t, a), (u, b) in zip(knots, knots[1:]):
        out.append(out[-1] + (u - t) * (a + b) / 2)
    return out


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(NOT_SPACE)).cast("long")


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, rows), a row per source -> with rank, weight and target.

    target = least(most * size, level * weight) for the level at which targets sum to all sizes: what resharing the
    excess again and again ends at. The windows run over one row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    whole = [integral(k)[-1] for k in schedules]
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.array(*map(F.lit, whole))[F.pmod("rank", F.lit(len(whole))).cast("int")])
    all_of = Window.partitionBy(F.lit(0))
    filling = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.withColumn("pos", F.row_number().over(filling))
    left = F.sum("source_size").over(all_of) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    free = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = capped.withColumn("level", left / free)
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most * (1 + 1e-12)
    level = F.coalesce(F.min(F.when(fits, F.struct("pos", "level"))).over(all_of)["level"], F.lit(0.0))
    return capped.withColumn("target", F.least(F.col("source_size") * float(most), level * F.col("weight"))).drop("pos", "level")


def _position(done: Column, schedule: Column) -> Column:
    """The time at which a share `done` (0 to 1) of a source's demand is reached."""
    cum, time, rate = schedule["cum"], schedule["time"], schedule["rate"]
    j = F.least(F.size(F.filter(cum, lambda c: c <= done)), F.size(cum) - 1)  # 1-based start of the segment
    at = lambda a, k: F.element_at(a, k)
    slope = (at(rate, j + 1) - at(rate, j)) / (at(time, j + 1) - at(time, j))
    rest = done - at(cum, j)
    root = F.sqrt(F.greatest(at(rate, j) * at(rate, j) + 2 * slope * rest, F.lit(0.0)))
    return at(time, j) + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (at(rate, j) + root))


def mix(docs: DataFrame, schedules=SCHEDULES, most: int = MOST, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, digest (md5 of the text), size, source_size, target, taken, positions, range-sorted by first position.

    taken: the words the mix takes of the document, repeats counted; a source's sum is its target, rounded to a word.
    positions: the training time of each pass over the document, empty where nothing is taken. Null texts have size
    0; null is a source of its own, the last. Rows that repeat an id count each; their order ends with
    size and digest, so equal rows are interchangeable. Empty tables give empty results; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _digest(text_col).alias("digest"), words(F.col(text_col)).alias("size"))
    rows = scratch.save(rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    sizes = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")

    def literal(knots):
        cum = integral(knots)
        each = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
        return F.struct(each(t for t, _ in knots).alias("time"), each(w / cum[-1] for _, w in knots).alias("rate"), each(c / cum[-1] for c in cum).alias("cum"))

    mixed = source_targets(sizes, schedules, most)
    digits = F.least(F.greatest(F.ceil(F.log(16.0, F.greatest(F.col("rows"), F.lit(1)) / GROUP)), F.lit(0)), F.lit(5)).cast("int")
    mixed = mixed.select("source", "source_size", "target", F.pmod("rank", F.lit(len(schedules))).cast("int").alias("kind"), F.round("target").cast("long").alias("quota"), digits.alias("digits"))
    mixed = scratch.save(mixed, "targets")
    same = rows["source"].eqNullSafe(mixed["source"])
    dealt = rows.join(mixed, same).select("doc_id", "digest", rows["source"], "size", "h", "source_size", "target", "kind", "quota", F.expr("substring(h, 1, digits)").alias("bucket"))
    dealt = scratch.save(dealt, "dealt")
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.save(sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("c", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(sums.withColumnsRenamed({"source": "s2", "bucket": "b2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    c = F.col("ahead") + F.col("c")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    run = run.withColumn("c", c).withColumn("full", full)
    extra = F.greatest(F.least(F.col("quota") - F.col("full") * F.col("source_size") - F.col("c"), F.col("size")), F.lit(0)).cast("long")
    run = run.withColumn("extra", extra).withColumn("passes", F.when(F.col("size") == 0, 0).otherwise(F.col("full") + (F.col("extra") > 0).cast("long")))
    schedule = F.element_at(F.array(*map(literal, schedules)), F.col("kind") + 1)
    share = lambda k: (k * F.col("source_size") + F.col("c")) / F.greatest(F.col("quota"), F.lit(1)).cast("double")
    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), lambda k: _position(F.least(share(k), F.lit(1.0)), schedule))).otherwise(F.expr("array()").cast("array<double>"))
    out = run.select("doc_id", "digest", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).alias("taken"), positions.alias("positions"))
    out = scratch.save(out, "mixed")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    first = F.try_element_at("positions", F.lit(1))
    return out.repartitionByRange(parts, first.asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(first.asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs as the mix trains on them: a row per pass, range-sorted by position; documents of which nothing is taken go.

    Documents stay whole: a last pass that the target cuts short counts if at least half of it is taken.
    Different texts with the same id have passes of their own; rows that repeat both are read as often as the one with most passes. Null
    and empty texts have no words and go; a null source is one of its own; no rows give none. Columns named driftlog_... are not allowed."""
    reserved(docs)
    plan = mix(docs, id_col=id_col, text_col=text_col, **how)
    whole = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.greatest("size", F.lit(1))).cast("int")
    plan = plan.withColumn("positions", F.slice("positions", 1, F.least(whole, F.size("positions"))))
    plan = plan.filter(F.size("positions") > 0).groupBy(F.col("doc_id").alias("driftlog_id"), F.col("digest").alias("driftlog_md5")).agg(F.max("positions").alias("driftlog_at"))
    plan = Scratch(docs.sparkSession, "plan").save(plan)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("driftlog_id")) & (_digest(text_col) == F.col("driftlog_md5"))
    rows = docs.join(plan, same).select(*docs.columns, F.explode("driftlog_at").alias("driftlog_at"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(parts, "driftlog_at", id_col).sortWithinPartitions("driftlog_at", id_col).drop("driftlog_at")
