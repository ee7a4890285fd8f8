"""I-Match fingerprints with randomised lexicons, DataFrame functions only.

The lexicon holds the terms whose document frequency is within a band (so whose inverse document frequency is). Each of
64 randomised sub-lexicons keeps a term of it by chance, 1 of 4, of 16, of 64 and so on, each independent of the
others, as bits of seeded hashes of the term say. A document's distinct terms within the lexicon are sorted, and a
64-bit hash of the whole and of what each sub-lexicon keeps makes the fingerprint. Dense ones tell short texts apart,
sparse ones survive changes to long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let

#: The band, as shares of all documents. A document with d distinct terms adds d to the sum of all frequencies, so at
#: most (mean of d) / low terms lie above low: the lower edge rises where that would be more than MOST terms.
LOW, HIGH = 0.002, 0.1
MOST = 50_000
#: Bits of a mask, a sub-lexicon each: the first and the last of every density 1/4, 1/16, 1/64, ...
GROUPS = ((0, 7), (8, 21), (22, 35), (36, 49), (50, 63))
NOT_TERM = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's distinct lower-cased terms."""
    terms = F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms within the band, over all documents; at most MOST. A term needs two documents, and `high` is at least three of them."""
    hashes = docs.select(term_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t"))
    n, terms = hashes.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    low = max(low, terms / max(n, 1) / MOST)
    counts = hashes.select(F.explode("t").alias("h")).groupBy("h").count()
    return [r.h for r in counts.filter(F.col("count").between(max(2, low * n), max(3, high * n))).select("h").collect()]


def _mask(h: Column) -> Column:
    """Which sub-lexicons keep a term: the bits of each group by a chance of 1/4 of the group before."""
    draws = [F.xxhash64(h, F.lit(k).cast("long")) for k in range(2 * len(GROUPS))]
    kept = F.lit(-1).cast("long")
    for d, (first, _) in enumerate(GROUPS):
        past = F.lit((1 << first) - 1).cast("long")  # the denser ones are drawn already
        kept = kept.bitwiseAND(draws[2 * d].bitwiseAND(draws[2 * d + 1]).bitwiseOR(past))
    return kept


def _signatures(sorted_hashes: Column) -> Column:
    """The signature of all sorted hashes and of those that each sub-lexicon keeps; null for none."""
    sign = lambda a: F.when(F.size(a) > 0, F.xxhash64(a))
    bits = lambda x, at, n: F.shiftrightunsigned(x["mask"], at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    def group(terms: Column, first: int, last: int) -> Column:
        """Of one density; terms that none of its sub-lexicons keeps are let go first."""
        some = F.filter(terms, lambda x: bits(x, first, last - first + 1) != 0)
        each = lambda a: F.array(*(sign(F.filter(a, lambda x: bits(x, k, 1) == 1)) for k in range(first, last + 1)))
        return let(some, each)

    terms = F.transform(sorted_hashes, lambda h: F.struct(h.alias("h"), _mask(h).alias("mask")))
    return let(terms, lambda t: F.concat(F.array(sign(t)), *(group(t, first, last) for first, last in GROUPS)))


def with_signatures(df: DataFrame, text_col: str, name: str, known: list[int]) -> DataFrame:
    """df with a column of signatures of its texts. A text without any term in the band is told by all its terms, so that short texts are not all alike.

    The lexicon is one literal set of at most MOST numbers, parsed once: a hash set lookup for each term."""
    numbers = ",".join(f"{h}L" for h in known if h != -(2**63)) or "NULL"
    df = df.withColumn("driftlog_terms", term_hashes(F.col(text_col)))
    df = df.withColumn("driftlog_inside", F.expr(f"filter(driftlog_terms, h -> coalesce(h IN ({numbers}), false))"))
    own = F.array_sort(F.when(F.size("driftlog_inside") > 0, F.col("driftlog_inside")).otherwise(F.col("driftlog_terms")))
    return df.withColumn(name, let(own, _signatures)).drop("driftlog_terms", "driftlog_inside")


def likeness(a: Column, b: Column) -> Column:
    """The share of sub-lexicons with equal signatures, of those in which either has a term; 1 where neither has any."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce((x == y).cast("int"), F.lit(0))))
    told = F.filter(both, lambda x: x.isNotNull())
    hits = F.aggregate(told, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(told) > 0, hits / F.size(told)).otherwise(F.lit(1.0)).cast("double")


def as_text(signs: Column) -> Column:
    """The fingerprint as text: 16 hex digits of each signature, - for none."""
    return F.concat_ws("", F.transform(signs, lambda s: F.coalesce(F.lpad(F.lower(F.hex(s)), 16, "0"), F.lit("-"))))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", known: list[int] | None = None) -> DataFrame:
    """(doc_id, text, signs): the signatures of every whole text; equal texts have equal ones. Null texts count as empty."""
    known = lexicon(docs, text_col) if known is None else known
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signs", known)


def successors(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """ids (doc_id, n; distinct ids) -> (doc_id, next_id, before_id, before_n): the next in descending order of doc_id, null last, and
    the one before; the last goes on with the first. Ranks come from a range sort and one count a partition; the rest are joins on rank."""
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = ids.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last()).withColumn("m", F.monotonically_increasing_id())
    placed = scratch.save(placed.select("doc_id", "n", F.shiftrightunsigned("m", 33).alias("p"), F.col("m").bitwiseAND((1 << 33) - 1).alias("k")), "placed")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    base = placed.groupBy("p").agg(F.count("*").alias("rows")).select("p", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    ranked = scratch.save(placed.join(base, "p").select("doc_id", "n", (F.col("base") + F.col("k")).alias("rank")), "ranked")
    total = max(ranked.count(), 1)
    nxt = ranked.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("rank") - 1, F.lit(total)).alias("rank"))
    prev = ranked.select(F.col("doc_id").alias("before_id"), F.col("n").alias("before_n"), F.pmod(F.col("rank") + 1, F.lit(total)).alias("rank"))
    return scratch.save(ranked.join(nxt, "rank").join(prev, "rank").select("doc_id", "next_id", "before_id", "before_n"), "successors")


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the start of the next document's: its last floor(n_chars / 3) code points are replaced by as many,
    or all, of the next. Null texts count as empty; very long texts are signed whole. Rows that repeat an id have the same next document,
    and the least of their texts (and of their fingerprints) is what the document before meets. An empty table gives an empty result;
    other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "imatch")
    known = lexicon(docs, text_col)
    rows = fingerprints(docs, text_col, id_col, known)
    links = successors(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")), scratch)
    # Both branches below read the same columns of this join's left side, so its shuffle of the texts is made once.
    linked = rows.join(links.withColumnRenamed("doc_id", "l_id"), F.col("doc_id").eqNullSafe(F.col("l_id"))).drop("l_id")
    gifts = linked.select(F.col("before_id").alias("g_id"), F.expr("substring(text, 1, CAST(before_n div 3 AS INT))").alias("gift"), F.col("signs").alias("next_signs"))
    if links.count() < docs.count():  # ids repeat
        gifts = gifts.groupBy("g_id").agg(F.min("gift").alias("gift"), F.min("next_signs").alias("next_signs"))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = linked.join(gifts, F.col("doc_id").eqNullSafe(F.col("g_id")))
    edited = edited.select("doc_id", "signs", "next_signs", F.length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("gift", F.lit(1), cut)).alias("edited"))
    edited = with_signatures(edited, "edited", "edited_signs", known)
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("signs")).alias("fingerprint"), as_text(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
