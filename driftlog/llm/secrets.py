"""Secret scans with multipart credential linking.

Strong patterns are reported alone (the base). Weak candidates - identifiers, secret-looking strings and
endpoints, each common in harmless text - are reported only when complementary parts lie near each other in one scope:
an interval join of the parts by document, scope and cell of CELL characters finds those at most REACH apart, and scopes
end at blank lines. An identifier or an endpoint needs a secret, a weak secret an identifier, an access id or an endpoint."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

REACH = 300
#: The interval join's cell; a part reaches into few of them.
CELL = 1024
BASE = ("assign", "access", "hex")
ADDED = ("ident", "secret", "endpoint")
_A = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 and more: what is left of [0-9a-f]+
IDENT = re.compile(r"""(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", _A)
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]{4,}|(?:host|server|endpoint|hostname)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""", _A)
SCOPE = re.compile(r"\n[\x20\t]*\n")


def _looks_random(s: str) -> bool:
    """Two of upper case, lower case and digits, and at least 3.5 bits a character; the linking rejects the rest."""
    if sum(bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
        return False
    return -sum(k / len(s) * math.log2(k / len(s)) for k in map(s.count, set(s))) >= 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that cover the same characters."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(cover: tuple[list[int], list[int]], s: int, e: int) -> bool:
    starts, ends = cover
    k = bisect_left(starts, e)
    return k > 0 and ends[k - 1] > s


def parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, bool, int, int, int]]:
    """(role, weak, scope, start, end) of all parts that a link may need; none where one side is missing. Weak ones don't meet the base."""
    if not base and "=" not in text and ":" not in text:
        return []  # no identifier, no endpoint
    taken = _disjoint([(s, e) for _, s, e in base])
    apart = lambda pattern: [m.span() for m in pattern.finditer(text) if not _meets(taken, *m.span())]
    ends = apart(ENDPOINT)
    partners = [("ident", True, *x) for x in apart(IDENT)] + [("endpoint", True, *x) for x in ends] + [("access", False, s, e) for k, s, e in base if k == "access"]
    if not partners:
        return []
    within = _disjoint(ends)
    secrets = [("secret", True, *m.span()) for m in LOOSE.finditer(text) if not _meets(taken, *m.span()) and not _meets(within, m.start(), m.start() + 1) and _looks_random(m[0])]
    secrets += [("secret", False, s, e) for k, s, e in base if k != "access"]
    if not secrets:
        return []
    breaks = [m.start() for m in SCOPE.finditer(text)]
    return [(k, w, bisect_left(breaks, s), s, e) for k, w, s, e in partners + secrets]


def linked(found: DataFrame) -> DataFrame:
    """found (row, parts) -> (row, kind, start, end): weak parts with a complementary part apart from them, at most REACH away, in their scope."""
    one = found.select("row", F.explode("parts").alias("p")).select("row", "p.*").withColumn("secret", F.col("kind") == "secret")
    cell = lambda c: F.floor(c / CELL)
    weak = one.filter("weak").drop("weak").withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.col("end") - 1)))))
    other = one.select("row", "scope", (~F.col("secret")).alias("secret"), F.col("start").alias("s"), F.col("end").alias("e"))
    other = other.withColumn("cell", F.explode(F.sequence(cell(F.col("s") - REACH - 1), cell(F.col("e") + REACH))))
    near = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e")).between(0, REACH)
    keys = ["row", "scope", "secret", "cell"]
    same = reduce(lambda a, b: a & b, (weak[k] == other[k] for k in keys))
    return weak.join(other, same & near, "left_semi").select("row", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end in code points, base), by start and then kind.

    Null texts count as empty and have no spans. Very long texts are read in linear time. Repeated rows and null ids stay, each with its own
    spans; spans that start together go by kind; an empty table gives an empty result; other columns are ignored."""
    order = {k: n for n, k in enumerate(BASE + ADDED)}
    span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))
    part = pa.list_(pa.struct([("kind", pa.string()), ("weak", pa.bool_()), ("scope", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            spans, links = [], []
            for text in b.column(2):
                text = text.as_py()
                base = base_spans(text)
                spans.append(sorted((s, order[k], k, e, True) for k, s, e in base))
                links.append(parts(text, base))
            names = lambda kind, rows: [[dict(zip((f.name for f in kind.value_type), x, strict=True)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names(span, spans), span), pa.array(names(part, links), part)], ["row", "doc_id", "spans", "parts"])

    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "spans array<struct<start int, n int, kind string, end int, base boolean>>, parts array<struct<kind string, weak boolean, scope int, start int, end int>>"
    found = scratch.save(rows.mapInArrow(run, f"row long, doc_id long, {kinds}"), "found")
    number = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("kind"))
    added = linked(found.filter(F.size("parts") > 0)).groupBy("row").agg(F.collect_list(F.struct("start", number.alias("n"), "kind", "end", F.lit(False).alias("base"))).alias("added"))
    all_of = found.drop("parts").join(scratch.save(added, "added"), "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "added")))
    return all_of.select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
