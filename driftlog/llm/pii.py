"""Information-theoretic sanitisation of personal data, DataFrame functions only.

The base finds e-mail and IP addresses, card and phone numbers. Terms of the same document may give them away still
when they are gone: for each kind of entity k and term t the corpus gives the pointwise mutual information
log2(p(k | t) / p(k)), once for k near t and once for k anywhere in t's document, entities themselves left out. A term
that tells more than ALPHA of the entity's own information, -log2 p(k), and that stands with at least SUPPORT different
entities (copies of one count once), exceeds the threshold: all its occurrences in documents with k are spans too.
Over whole documents so many terms are asked that some stand with k by chance, so p(k | t) is there the lower
bound of Wilson's interval at SURE standard deviations. The same is asked of each single entity, for terms that stand beside it in most
of its documents and in several surroundings, as a name beside its address does. Surroundings are the near terms on both
sides, so a copied passage is one of them however often it is copied, and tells nothing. Entities are generalised to their kind,
disclosing terms to their broader class - the terms that begin alike - if that class stays below the threshold; if not they are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, replaced, reserved, running_sums

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no match backtracks: runs are possessive, and a match starts where a run does (or a match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match holds.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
#: Terms on either side of an entity, within so many characters, that count as near.
NEAR, REACH = 3, 60
SUPPORT, ALPHA = 10, 0.6
#: For single entities: the least documents and surroundings, and the least share of the entity's documents that have the term near.
OWN_SUPPORT, OWN_SHARE = 3, 0.5
SURE = 4.0
#: Asked terms up to this number are broadcast (8 bytes each).
FEW_ASKED = 1_000_000


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # a part's leading zeros don't count
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 3) | F.forall(F.split(m, r"\."), lambda p: F.lpad(F.right(F.regexp_replace(p, "^0+", ""), F.lit(4)), 4, "0") <= "0255")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)

    def luhn(d: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(d))
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda i: F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
        each = F.transform(at, lambda i: F.when((F.length(d) - i) % 2 == 1, twice(i)).otherwise(digit(i)))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0

    return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits)).otherwise(False)


def _placed(m: Column, p: Column) -> Column:
    """Structs (at, end) of matches m, with p what lies between them: running sums of the lengths, in blocks."""
    ends = running_sums(F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))
    return F.zip_with(m, ends, lambda x, e: F.struct((e - F.length(x)).alias("at"), e.alias("end")))


def _found(kind: str) -> Column:
    """Structs (start, n, kind, end, value, before, after) of the valid matches in `text`; matches in m_kind, what lies between in p_kind."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    rows = let(_placed(m, p), lambda e: F.arrays_zip(m.alias("m"), e.alias("e"), F.slice(p, 1, F.size(m)).alias("before"), F.slice(p, 2, F.size(m)).alias("after")))
    rows = F.filter(rows, lambda x: _valid(kind, x["m"]))
    made = F.transform(rows, lambda x: F.struct(x["e"]["at"].alias("start"), F.lit(KINDS.index(kind)).alias("n"), F.lit(kind).alias("kind"), x["e"]["end"].alias("end"), x["m"].alias("value"), F.right(x["before"], F.lit(REACH)).alias("before"), F.substring(x["after"], 1, REACH).alias("after")))
    return F.when(F.size(m) > 0, made).otherwise(F.slice(made, 1, 0))


def base_matches(rows: DataFrame) -> DataFrame:
    """rows (..., text) with `found`: all base matches by start and then kind."""
    text = F.col("text")
    none = F.expr("CAST(array() AS array<string>)")
    for k, p in PATTERNS.items():
        hint = F.contains(text, F.lit(HINT[k])) if HINT[k] else F.lit(True)
        rows = rows.withColumn(f"m_{k}", F.when(hint, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none))
    for k, p in PATTERNS.items():
        rows = rows.withColumn(f"p_{k}", F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).otherwise(none))
    for k in KINDS:
        rows = rows.withColumn(f"f_{k}", _found(k))
    rows = rows.withColumn("found", F.array_sort(F.concat(*(f"f_{k}" for k in KINDS))))
    return rows.drop(*(f"{x}_{k}" for x in "mpf" for k in KINDS))


def _near_terms(found: DataFrame) -> DataFrame:
    """(row, kind, value, context, term, start, end): the nearest whole terms on both sides of each entity."""
    one = found.select("row", F.explode("found").alias("f")).select("row", "f.*")

    def whole_terms(text: str, first: bool) -> tuple[Column, Column]:
        whole = F.regexp_replace(text, f"^{TERM}", "") if first else F.regexp_replace(text, f"{TERM}$", "")
        return whole, F.when(F.length(text) < REACH, F.col(text)).otherwise(whole)  # a term that the reach cuts

    terms = lambda text, first: F.regexp_extract_all(F.lower(whole_terms(text, first)[1]), F.lit(TERM), F.lit(0))
    nearest = F.slice(F.reverse(terms("before", True)), 1, NEAR), F.slice(terms("after", False), 1, NEAR)
    one = one.withColumn("context", F.xxhash64(*(F.array_join(t, " ") for t in nearest)))

    def side(text: str, first: bool) -> DataFrame:
        whole, cut = whole_terms(text, first)
        lost = F.when(F.length(text) < REACH, F.lit(0)).otherwise(F.length(text) - F.length(whole)) if first else F.lit(0)
        origin = F.col("start") - F.length(text) + lost if first else F.col("end")
        rows = one.select("row", "kind", "value", "context", origin.alias("origin"), F.regexp_extract_all(cut, F.lit(TERM), F.lit(0)).alias("t"), F.split(cut, TERM, -1).alias("g"))
        rows = rows.select("*", F.posexplode("t").alias("i", "term"))
        rows = rows.filter(F.col("i") >= F.size("t") - NEAR) if first else rows.filter(F.col("i") < NEAR)
        ahead = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
        start = F.col("origin") + ahead(F.col("g"), F.col("i") + 1) + ahead(F.col("t"), F.col("i"))
        return rows.select("row", "kind", "value", "context", F.lower("term").alias("term"), start.alias("start"), (start + F.length("term")).alias("end"))

    return side("before", True).unionByName(side("after", False))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _outside(text: Column) -> Column:
    """The text with a blank for each match of `found`."""
    return replaced(text, F.col("found"), lambda s: F.lit(" "))


def whole_counts(terms: DataFrame, near: DataFrame, held: DataFrame, entities: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Counts over whole documents: (kind, h, docs) of terms with enough different entities, (kind, value, h, docs, of) with single ones.

    terms (row, term) are distinct, without the entities' own; held (row, kind, value) is distinct. Equal sets of entities count once."""
    hashed = terms.select("row", F.xxhash64("term").alias("h"))
    sets = held.groupBy("row", "kind").agg(F.xxhash64(F.array_sort(F.collect_list("value"))).alias("entities"))
    kind = hashed.join(sets, "row").groupBy("kind", "h").agg(F.count("*").alias("docs"), F.count_distinct("entities").alias("values")).filter(F.col("values") >= support).select("kind", "h", "docs")
    often = entities.filter(F.col("of") >= OWN_SUPPORT)
    around = near.select("row", "kind", "value", "context").distinct().join(often, ["kind", "value"])
    own = hashed.join(around, "row").groupBy("kind", "value", "of", "h").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("docs"))
    enough = (F.col("docs") >= OWN_SUPPORT) & (F.col("contexts") >= OWN_SUPPORT) & (F.col("docs") >= OWN_SHARE * F.col("of"))
    return kind, own.filter(enough).select("kind", "value", "h", "docs", "of")


def own_terms(near: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, value, term, docs, of): terms near most occurrences of one entity. entities (kind, value, of) counts its documents."""
    counts = near.groupBy("kind", "value", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("docs"))
    strong = counts.join(entities.filter(F.col("of") >= OWN_SUPPORT), ["kind", "value"]).filter(F.col("docs") >= OWN_SHARE * F.col("of"))
    enough = (F.col("docs") >= OWN_SUPPORT) & (F.col("contexts") >= OWN_SUPPORT)
    return strong.filter(enough).select("kind", "value", "term", "docs", "of")


def disclosing_terms(rows: DataFrame, near: DataFrame, kinds: DataFrame, entities: DataFrame, whole: tuple[DataFrame, DataFrame], n_docs: int, support: int, alpha: float, scratch: Scratch) -> DataFrame:
    """(kind, value, h) over the threshold, h a term's hash; value is null where the term reveals the kind. rows has every text, kinds
    (kind, of) and entities (kind, value, of) the documents with each kind and each entity, whole what whole_counts gives."""
    null = F.lit(None).cast("string").alias("value")
    columns = ["kind", "value", "h", "docs", "of", "sure"]
    counts = near.groupBy("kind", "term").agg(F.count_distinct("value").alias("values"), F.count_distinct("row").alias("docs")).filter(F.col("values") >= support)
    of_kind = counts.join(kinds, "kind").select("kind", null, F.xxhash64("term").alias("h"), "docs", "of", F.lit(0.0).alias("sure"))
    own = own_terms(near, entities).select("kind", "value", F.xxhash64("term").alias("h"), "docs", "of", F.lit(0.0).alias("sure"))
    anywhere = whole[0].join(kinds, "kind").select("kind", null, "h", "docs", "of", F.lit(SURE).alias("sure"))
    asked = of_kind.unionByName(own).unionByName(anywhere).unionByName(whole[1].withColumn("sure", F.lit(0.0)).select(columns))
    asked = scratch.save(asked.distinct(), "asked")
    df = frequencies(rows, lambda t: F.transform(t, lambda x: F.xxhash64(x)), asked.select("h").distinct())
    p, z = F.col("docs") / F.col("df"), F.col("sure") * F.col("sure") / F.col("df")
    low = (p + z / 2 - F.sqrt(F.greatest(z * (p * (1 - p) + z / 4), F.lit(0.0)))) / (1 + z)
    return asked.join(df, "h").filter(_discloses(low, n_docs, alpha)).select("kind", "value", "h").distinct()


def _discloses(p: Column, n_docs: int, alpha: float) -> Column:
    """Whether log2(p(k | t) / p(k)) reaches the share alpha of the entity's own information; p(k) is of / n_docs."""
    own_bits = -F.log2(F.col("of") / F.lit(float(max(n_docs, 1))))
    return (F.log2(p * n_docs / F.col("of")) >= alpha * own_bits) & (own_bits > 0)


def frequencies(rows: DataFrame, keys, asked: DataFrame) -> DataFrame:
    """(h, df): in how many of all texts each asked key stands; keys(terms) gives a text's keys. asked: h, distinct. Few asked ones are
    sent to the texts, so that only their rows are counted; many are joined once the texts' keys are counted."""
    every = rows.select(F.explode(F.array_distinct(keys(_terms(F.col("text"))))).alias("h"))
    if asked.count() <= FEW_ASKED:
        every = every.join(F.broadcast(asked), "h", "left_semi")
    return every.groupBy("h").agg(F.count("*").alias("df"))


def broader(term: Column) -> Column:
    """A term's broader class, its first half; null for terms too short to have one."""
    return F.when(F.length(term) >= 4, F.concat(F.substring(term, F.lit(1), F.floor(F.length(term) / 2).cast("int")), F.lit("*")))


def generalised(rows: DataFrame, terms: DataFrame, held: DataFrame, told: DataFrame, of: DataFrame, n_docs: int, alpha: float, scratch: Scratch) -> DataFrame:
    """told (kind, value, term) -> with `label`: the term's broader class where that doesn't disclose too, null where the term must go.
    of (kind, value, of) are the documents with each entity, or each kind where value is null."""
    asked = scratch.save(told.withColumn("label", broader(F.col("term"))).filter("label IS NOT NULL"), "classes")
    classes = terms.select("row", broader(F.col("term")).alias("label")).filter("label IS NOT NULL")
    # A single entity's classes are looked for in its own documents only; those of a kind, few, in all of the kind's.
    single = held.join(asked.filter("value IS NOT NULL").select("kind", "value", "label").distinct(), ["kind", "value"]).join(classes, ["row", "label"], "left_semi")
    whole = asked.filter("value IS NULL").select("kind", "label").distinct()
    whole = classes.join(whole.select("label").distinct(), "label", "left_semi").distinct().join(held.select("row", "kind").distinct(), "row").join(whole, ["kind", "label"])
    here = single.select("row", "kind", "value", "label").unionByName(whole.select("row", "kind", F.lit(None).cast("string").alias("value"), "label"))
    docs = here.groupBy("kind", "value", "label").agg(F.count_distinct("row").alias("docs"))
    hashed = lambda c: F.xxhash64(c)
    df = frequencies(rows, lambda t: F.transform(F.filter(t, lambda x: F.length(x) >= 4), lambda x: hashed(broader(x))), asked.select(hashed("label").alias("h")).distinct())
    entity = of.withColumnsRenamed({"kind": "k", "value": "v"})
    quiet = docs.join(entity, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).join(df, hashed("label") == F.col("h"))
    quiet = quiet.filter(~_discloses(F.col("docs") / F.col("df"), n_docs, alpha)).select(F.col("kind").alias("k"), F.col("value").alias("v"), F.col("label").alias("c"))
    out = told.withColumn("label", broader(F.col("term"))).join(quiet, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")) & (F.col("label") == F.col("c")), "left")
    return out.select("kind", "value", "term", F.col("c").alias("label"))


def _occurrences(texts: DataFrame) -> DataFrame:
    """texts (row, text, told: array of (term, label)) -> (row, added): every occurrence of the terms as whole terms, as spans."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("told", lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    texts = texts.withColumn("pattern", pattern)
    texts = texts.withColumn("m", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).withColumn("p", F.split("text", F.col("pattern"), -1))
    label = lambda x: F.try_element_at(F.filter("told", lambda t: t["term"] == F.lower(x)), F.lit(1))["label"]
    span = lambda e, x: F.struct(e["at"].alias("start"), F.lit(len(KINDS)).alias("n"), F.lit("term").alias("kind"), e["end"].alias("end"), label(x).alias("label"))
    return texts.select("row", F.zip_with(_placed(F.col("m"), F.col("p")), F.col("m"), span).alias("added"))


def pii_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: doc_id, digest (md5 of the text), base and spans (arrays of start, n, kind, end, label, by start and then kind).

    spans has the base and the disclosing terms (kind "term"); a term's label is its broader class, null where it must go. Null texts
    count as empty and have no spans; very long texts, and texts with very many matches, take about linear time; repeated rows and
    null ids stay, each repeated row a document of the counts; an empty table gives an empty result; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = base_matches(rows.withColumn("row", F.monotonically_increasing_id()))
    every = scratch.save(every.select("doc_id", "row", F.md5("text").alias("digest"), "found", F.when(F.size("found") > 0, F.col("text")).alias("text")), "base")
    some = every.filter(F.size("found") > 0).select("row", "found", "text")
    near = scratch.save(_near_terms(some), "near")
    kinds = some.select("row", F.explode(F.array_distinct(F.transform("found", lambda f: f["kind"]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("of"))
    held = some.select("row", F.explode("found").alias("f")).select("row", "f.kind", "f.value").distinct()
    entities = held.groupBy("kind", "value").agg(F.count("*").alias("of"))
    terms = some.select("row", F.explode(_terms(_outside(F.col("text")))).alias("term"))
    whole = whole_counts(terms, near, held, entities, support)
    n_docs = every.count()
    told = scratch.save(disclosing_terms(rows, near, kinds, entities, whole, n_docs, support, alpha, scratch), "told")
    # Terms by document, then every occurrence of them in it.
    here = terms.withColumn("h", F.xxhash64("term")).join(told, "h").join(held.withColumnsRenamed({"row": "r", "kind": "k", "value": "v"}), (F.col("row") == F.col("r")) & (F.col("kind") == F.col("k")) & (F.col("value").isNull() | (F.col("value") == F.col("v"))))
    here = scratch.save(here.select("row", "kind", "value", "term").distinct(), "here")
    of = kinds.select("kind", F.lit(None).cast("string").alias("value"), "of").unionByName(entities)
    if here.isEmpty():
        labels = here.select("kind", "value", "term", F.lit(None).cast("string").alias("label"))
    else:
        labels = scratch.save(generalised(rows, terms, held, here.select("kind", "value", "term").distinct(), of, n_docs, alpha, scratch), "labels")
    same = (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")) & (F.col("term") == F.col("t"))
    here = here.join(labels.withColumnsRenamed({"kind": "k", "value": "v", "term": "t"}), same)
    # A term that must go for one entity goes, whatever it may become for another.
    here = here.groupBy("row", "term").agg(F.max("label").alias("label"), F.count_if(F.col("label").isNull()).alias("gone"))
    here = here.groupBy("row").agg(F.collect_list(F.struct("term", F.when(F.col("gone") == 0, F.col("label")).alias("label"))).alias("told"))
    # The entities' places are blank, so no term meets an entity.
    blanks = replaced(F.col("text"), F.col("found"), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]), lambda s, pos: F.repeat(F.lit(" "), F.greatest(s["end"] - pos, F.lit(0))))
    added = _occurrences(here.join(some.select("row", blanks.alias("text")), "row"))
    plain = lambda f: F.struct(f["start"].alias("start"), f["n"].alias("n"), f["kind"].alias("kind"), f["end"].alias("end"), F.lit(None).cast("string").alias("label"))
    out = every.join(scratch.save(added, "added"), "row", "left").withColumn("base", F.transform("found", plain))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return out.select("doc_id", "digest", "base", spans.alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """docs with every entity generalised to its kind, as [EMAIL], and every disclosing term in its document to its broader class, as
    Zor*, or removed where that discloses too. Null texts stay null; rows that repeat both id and text are treated alike."""
    reserved(docs)
    spans = pii_spans(docs, text_col, id_col, **how).filter(F.size("spans") > 0).select(F.col("doc_id").alias("driftlog_id"), F.col("digest").alias("driftlog_md5"), "spans").withColumnRenamed("spans", "driftlog_spans").dropDuplicates(["driftlog_id", "driftlog_md5"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("driftlog_id")) & (F.md5(text) == F.col("driftlog_md5"))
    label = lambda s: F.when(s["kind"] == "term", F.coalesce(s["label"], F.lit(""))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    built = replaced(text, F.col("driftlog_spans"), label)  # overlapping matches of several kinds become one label, the first's
    return docs.join(spans, same, "left").withColumn(text_col, F.when(F.col("driftlog_spans").isNull(), F.col(text_col)).otherwise(built)).select(*docs.columns)
