"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of BLOCK characters. The distinct blocks are sorted, by their first HEAD
characters and then by digest (so that the sort's samples stay small, and many blocks that begin alike still fall into
several parts), and each gets its rank as an integer name; then adjacent names are paired, the distinct pairs sorted and named by rank, until each text
has one name. Two texts have the same (level, name) if and only if they are equal: names stand for contents, not for
hashes, and they are the same however the data lie in partitions. A digest only carries a block's name back to its
documents; that no digest stands for two contents is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, reserved

#: Characters of a block: a page is some blocks, a text of 1 GB takes 21 levels.
BLOCK = 512
HEAD = 24


def _normal(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, "")


def _blocks(text):
    """The text's blocks; one empty block for the empty text."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def named(distinct: DataFrame, keys: list[str], carried: list, scratch: Scratch) -> DataFrame:
    """The rows with `name`, their rank from 0 in the order of keys, in place of the keys; `carried` are the columns to keep.

    A range sort and one count a partition give the ranks, so no task sees all rows."""
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = distinct.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*carried, F.monotonically_increasing_id().alias("m"))
    kept = [c for c in placed.columns if c != "m"]
    placed = scratch.save(placed.select(*kept, F.shiftrightunsigned("m", 33).alias("p"), F.col("m").bitwiseAND((1 << 33) - 1).alias("k")), "placed")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    base = placed.groupBy("p").agg(F.count("*").alias("rows")).select("p", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), "p").select(*kept, (F.col("base") + F.col("k")).alias("name"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, level, name.

    Null texts count as empty; empty texts are equal to one another. Of equal texts the row with the most code
    points in the original stays, then the smallest doc_id (null after all others); of repeated rows that tie in
    both, one. A very long text only has more blocks, a level for each doubling. An empty table gives an empty result.
    Other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "exact")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"), _normal(text_col).alias("t"))
    digest = lambda b: F.unhex(F.sha2(b, 256))
    cut = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("t", 256).alias("sha"), F.transform(_blocks(F.col("t")), digest).alias("d"))
    cut = scratch.save(cut, "blocks")

    contents = base.select(F.explode(_blocks(F.col("t"))).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
    contents = contents.select(F.substring("block", 1, HEAD).alias("head"), digest(F.col("block")).alias("digest"))
    names = scratch.save(named(contents, ["head", "digest"], ["digest"], scratch), "names")
    if not names.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two different blocks share a SHA-256 digest")

    now = cut.select("row", F.size("d").alias("left"), F.posexplode("d").alias("pos", "digest")).join(names, "digest").select("row", "left", "pos", "name")
    done, level = None, 0
    most = cut.agg(F.max(F.size("d"))).first()[0] or 1
    while True:
        ended = now.filter("left = 1").select("row", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if most == 1:
            break
        # Neighbours meet by their text and place: a key has two rows.
        pairs = now.filter("left > 1").groupBy("row", "left", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = scratch.save(pairs, f"pairs{level}")
        names = scratch.save(named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], scratch), f"names{level + 1}")
        now = pairs.join(names, ["a", "b"]).select("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name")
        level, most = level + 1, -(-most // 2)
    done = scratch.save(done.join(cut.drop("d"), "row"), "identity")

    rank = F.struct("n_chars", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id").alias("i"), F.bitwise_not("row").alias("r"), "doc_id", "row")
    groups = scratch.save(done.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(rank).alias("best")).select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    return done.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", "level", "name")


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    Null and empty texts are one group; ties go to the least id, null last; of rows that repeat both id and text one stays; no rows give
    none. Columns named driftlog_id, driftlog_sha, driftlog_n or driftlog_odd are not allowed."""
    reserved(docs)
    kept = exact_dedup(docs, text_col, id_col).filter("kept").select(F.col("doc_id").alias("driftlog_id"), F.col("text_sha256").alias("driftlog_sha"), F.col("n_chars").alias("driftlog_n"))
    kept = Scratch(docs.sparkSession, "kept").save(kept)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("driftlog_id")) & (F.sha2(_normal(text_col), 256) == F.col("driftlog_sha")) & (F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("driftlog_n"))
    stay = docs.join(kept, same, "left_semi")
    seen = docs.groupBy(id_col).count().filter("count > 1")
    if seen.isEmpty():
        return stay
    # Rows that repeat an id: one of those with the same text stays.
    odd = F.col(id_col).eqNullSafe(F.col("driftlog_odd"))
    seen = seen.select(F.col(id_col).alias("driftlog_odd"))
    once = stay.join(seen, odd, "left_semi").withColumn("driftlog_sha", F.sha2(_normal(text_col), 256)).dropDuplicates([id_col, "driftlog_sha"]).drop("driftlog_sha")
    return stay.join(seen, odd, "left_anti").unionByName(once)
