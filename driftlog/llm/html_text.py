"""HTML main text by consensus host paths.

Each page's containers are scored by the text that their paragraphs hold, less links. The best container
votes for its generalised tag-class path; votes are counted per host in Spark, and the pages are extracted again
from the container at their host's winning path, a page without it from its own best."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Hosts up to this number are broadcast (under 100 bytes each); more are joined by a shuffle.
FEW_HOSTS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text.
DROP = frozenset("nav footer aside form menu button select dialog template svg head object audio video canvas".split()) | RAW
CONTAINER = frozenset("article main section div td body center".split())
#: Elements whose names may say that they hold no main text.
GROUP = frozenset("div section ul ol dl p span table td tr center header article details figure".split())
#: Words of a class, id or role that mark what isn't main text,
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: words that leave such a name what it is,
PLAIN = frozenset("area bar block bottom box btn button buttons container content global group icons inner item items left link links list main outer overlay page panel reader right row section signup site slot sticky top unit user wrap wrapper".split())
#: and those of readers' remarks, whatever stands beside them.
REMARKS = frozenset("comment comments disqus replies".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?)?""")
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.A | re.I) for t in RAW}
#: Levels above a text that it still speaks for.
LEVELS = 40


class Node:
    """An open element. container: the nearest container, itself or above; path: of containers only, generalised."""

    __slots__ = ("tag", "path", "drop", "link", "score", "article", "weak", "inside", "container", "parent")

    def __init__(self, tag, path, drop, link, article, weak, inside, parent):
        self.tag, self.path, self.drop, self.link, self.article, self.weak, self.inside, self.parent = tag, path, drop, link, article, weak, inside, parent
        self.score = 0.0
        self.container = self if tag in CONTAINER else parent.container if parent else None


def named(tag: str, attrs: dict[str, str]) -> tuple[str, str]:
    """An element's generalised name, and what its class, id or role says: "no" main text, "weak" (a mark among other words) or ""."""
    if not attrs:
        return tag, ""
    classes = sorted({_DIGITS.sub("#", c.lower()) for c in attrs.get("class", "").split()})
    says = ""
    if tag in GROUP:
        for token in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
            words = {w.lower() for w in _WORD.findall(token)}
            if words & MARKS:
                if words & REMARKS or words <= MARKS | PLAIN:
                    says = "no"
                    break
                says = "weak"
    return ".".join([tag, *classes]), says


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag whose name ends at `at`, whether it ends in a slash, and the place after its >, as the HTML standard reads
    them: a stray quote is a name, an unquoted value runs to white space or >."""
    found: dict[str, str] = {}
    while True:
        m = _ATTR.match(page, at)
        if m[1] is None:
            slash = page[m.end() - 1 : m.end()] == "/"
            return found, slash, m.end() + 1
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def walk(page: str, path: str | None = None, dropped: frozenset[int] = frozenset()):
    """The page's pieces in order: (node, number of its nearest weak element or -1, text, or None at a block's border).

    path: nodes below a container at that path are `inside`. dropped: numbers of weak elements that hold no main text."""
    root = Node("", "", False, False, False, -1, path == "", None)
    stack, opened, count, at, size = [root], {}, 0, 0, len(page)

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield stack[-1], page[at:]
            return
        after = page[lt + 1 : lt + 2]
        end_tag = after == "/"
        m = _NAME.match(page, lt + 1 + end_tag)
        if m is None:
            if after not in ("/", "!", "?"):  # no markup
                yield stack[-1], page[at : lt + 1]
                at = lt + 1
                continue
            if lt > at:
                yield stack[-1], page[at:lt]
            far = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            at = size if far < 0 else far + (3 if page[far] == "-" else 1)
            continue
        if lt > at:
            yield stack[-1], page[at:lt]
        tag = m[0].lower()
        attrs, slash, at = attributes(page, m.end())
        if at > size:  # the page ends within a tag
            return
        if end_tag:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            if tag in BLOCK:
                yield stack[-1], None
            continue
        if tag in BLOCK:
            yield stack[-1], None
            closed = ("p",) if tag not in ("li", "dd", "dt", "td", "th", "tr") else ("p", tag)
            if any(opened.get(t) for t in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closed:
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
        if tag == "br":
            yield stack[-1], " "
        if tag in VOID:
            continue
        if tag in RAW:
            far = _CLOSE[tag].search(page, at)
            if far is None:
                return
            at = attributes(page, far.end())[2]
            continue
        top = stack[-1]
        name, says = named(tag, attrs)
        article = top.article or tag in ("article", "main")
        drop = top.drop or tag in DROP or "hidden" in attrs or (says == "no" and tag not in ("article", "main") and not (tag == "header" and top.article)) or (tag == "header" and not top.article)
        weak = top.weak
        if says == "weak" and not drop:
            weak, count = count, count + 1
            drop = weak in dropped
        here = top.path
        if tag in CONTAINER:
            here = f"{top.path}/{name}" if len(top.path) < 2000 else f"{hash_of(top.path)}/{name}"
        if slash and tag not in BLOCK:
            continue
        stack.append(Node(tag, here, drop, top.link or tag == "a", article, weak, top.inside or (tag in CONTAINER and here == path), top))
        opened[tag] = opened.get(tag, 0) + 1


def hash_of(path: str) -> str:
    import hashlib

    return hashlib.md5(path.encode("utf-8", "replace")).hexdigest()


def survey(page: str) -> tuple[list[tuple[str, float]], frozenset[int]]:
    """(path, score) of the page's containers in page order, and the numbers of the weak elements that hold more links than text."""
    seen: dict[int, Node] = {}
    share: dict[int, list[int]] = {}
    for node, text in walk(page):
        if text is None or node.drop or not (n := len(text) - text.count(" ") - text.count("\n")):
            continue
        if node.weak >= 0:
            share.setdefault(node.weak, [0, 0])[node.link] += n
        gain, at, left = float(n) * (-0.5 if node.link else 1.0), node.container, LEVELS
        while at is not None and left:
            at.score += gain
            seen.setdefault(id(at), at)
            gain *= 0.25 if at.tag in ("article", "main") else 0.5
            at, left = at.parent.container if at.parent else None, left - 1
    return [(n.path, n.score) for n in seen.values()], frozenset(k for k, (plain, link) in share.items() if link > plain)


def best_path(page: str) -> tuple[str, float]:
    found = survey(page)[0]
    return max(found, key=lambda x: x[1]) if found else ("", 0.0)


def extract(page: str, path: str) -> str | None:
    """The main text below the containers at a path: blocks in page order, one a line. None where the page has no such container."""
    blocks, line, met = [], [], path == ""

    def close():
        if line:
            if text := " ".join("".join(line).split()):
                blocks.append(text)
            line.clear()

    for node, text in walk(page, path, survey(page)[1]):
        if text is None:
            close()
        elif node.inside:
            met = True
            if not node.drop:
                line.append(html.unescape(text))
    close()
    return "\n".join(blocks) if met else None


def host_of(url: Column) -> Column:
    """The host of an absolute URL, without user and port; empty for all others."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1), F.lit("")))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per input row: page_id, url, text, path (the container that it comes from), consensus (whether it is the host's).

    Null html counts as empty and has an empty text; a null or odd url has the empty host. Of a host's paths with as many votes the one with
    the higher score wins, then the greater path; of a page's containers with equal scores the first. Very long or deep pages take linear
    time. Repeated rows and null ids stay; an empty table gives an empty result; other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "html")

    def vote(batches):
        for b in batches:
            got = [best_path(p.as_py() or "") for p in b.column(1)]
            path, score = (list(x) for x in zip(*got)) if got else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(path, pa.string()), pa.array(score, pa.float64())], ["host", "path", "score"])

    cols = [F.col(c).cast("string").alias(n) for c, n in ((url_col, "url"), (html_col, "html"))]
    votes = pages.select(*cols).select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, score double").filter("path <> ''")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.floor("score")).alias("score"))
    winners = scratch.save(counts.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path")), "winners")

    def again(batches):
        for b in batches:
            rows = [x.to_pylist() for x in b.columns]
            texts, paths, whether = [], [], []
            for page, path in zip(rows[2], rows[3], strict=True):
                page = page or ""
                text = extract(page, path) if path else None
                whether.append(text is not None)
                if text is None:
                    path = best_path(page)[0]
                    text = (extract(page, path) or "") if path else ""
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(paths, pa.string()), pa.array(whether)], ["page_id", "url", "text", "path", "consensus"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), *cols).withColumn("host", host_of(F.col("url")))
    small = F.broadcast(winners) if winners.count() <= FEW_HOSTS else winners
    joined = rows.join(small, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(again, "page_id long, url string, text string, path string, consensus boolean")
