"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Learning: of labelled documents (a bounded sample) every term and every term's stem gets a log-odds weight, shrunk
towards harmless; the toxic ones that occur in several different contexts are the lexicon. Matching: the lexicon is a trie; its
intersection with the Levenshtein automata, of distance one or for long terms two, is made deterministic as words run
through it, and dies after a few characters for most words. Words that harmless labelled documents hold are no
misspellings. Scoring: a hit counts less in quotation - between quotation marks, after a verb of saying - than in
abuse, more where a window holds several; a logistic regression on the densest window, the hits' weight per word
and the number of different terms found gives the score."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, reserved

#: The most labelled documents that are learned from; chosen by a hash of the id.
SAMPLE = 30_000
#: The least shrunk log-odds of an entry, and the least toxic documents and different contexts that it takes.
WEIGHT, DOCS, CONTEXTS = 2.0, 3, 3
#: Pseudo-count of harmless documents that hold any term.
PRIOR = 2.0
STEMS = (4, 5, 6, 7)
#: Terms of this length may have one edit, of that length two; what a misspelling's weight is multiplied by for each.
FUZZY, FUZZY2, MISSPELT = 5, 12, 0.7
#: States of the automata and words with their weights that a worker keeps.
STATES = 50_000
WINDOW = 80
QUOTED, REPORTED = 0.4, 0.6
KEPT = 400_000
THRESHOLD = 0.7

WORD = re.compile(r"\w+")
LEET = str.maketrans("013457", "oieast")
OPEN, CLOSE = "“«‹„", "”»›"
#: Verbs of saying, in the four languages of the data.
SAYS = frozenset("said says say saying wrote writes called calling quote quoted quoting dijo dice escribió llamó dit écrit appelé sagte sagt schrieb nannte".split())


def edits(word: str) -> int:
    """How many edits a term of that length may have."""
    return 0 if len(word) < FUZZY else 1 if len(word) < FUZZY2 else 2


class FuzzyTrie:
    """Finds the nearest entry within its allowed edits of a word: trie and Levenshtein automata, intersected and determinised lazily.

    A state is a set of trie nodes, each with the fewest edits so far; a node takes as many as the longest term below it allows."""

    def __init__(self, words):
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]
        self.ends: dict[int, str] = {}
        for w in words:
            at, k = 0, edits(w)
            self.most[0] = max(self.most[0], k)
            for c in w:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at] = w
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.best: list[tuple[int, str] | None] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.step: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, nodes -> edits so far, closed under letters left out; -1 for the dead one."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            e = nodes[n] + 1
            for m in self.child[n].values():
                if e <= self.most[m] and e < nodes.get(m, 9):
                    nodes[m] = e
                    todo.append(m)
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            hits = [(e, self.ends[n]) for n, e in key if n in self.ends and e <= edits(self.ends[n])]
            self.best.append(min(hits) if hits else None)
        return found

    def _next(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e <= self.most[n] and e < out.get(n, 9):
                out[n] = e

        for n, e in self.states[state]:
            if (m := self.child[n].get(c)) is not None:
                reach(m, e)
            if e < self.most[n]:
                reach(n, e + 1)  # a letter too many
                for m in self.child[n].values():
                    reach(m, e + 1)  # another letter
        found = self.step[state, c] = self._state(out)
        return found

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, entry) of the nearest entry, the least of equals."""
        if len(self.states) > STATES:  # between words, so that no number is in use
            self._forget()
        state, step = self.start, self.step
        for c in word:
            after = step.get((state, c))
            state = self._next(state, c) if after is None else after
            if state < 0:
                return None
        return self.best[state]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    bias: float = -4.0
    coef: tuple[float, ...] = (1.0, 1.0, 1.0)


class Scorer:
    """Features and scores of texts under a model; keeps the weights of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.trie = FuzzyTrie(w for w in model.terms if len(w) >= FUZZY)
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        m = self.model
        best = m.terms.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, m.stems.get(word[:n], 0.0))
        if not best and word not in m.harmless:
            plain = word.translate(LEET) if not word.isalpha() and not word.isdigit() else word
            if plain != word:
                best = m.terms.get(plain, 0.0) * 0.9
            if not best and len(plain) >= FUZZY - 1 and (near := self.trie.nearest(plain)):
                best = m.terms[near[1]] * MISSPELT ** near[0]
        if len(self.known) > KEPT:
            self.known.clear()
        self.known[word] = best
        return best

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight in context) of every term found in the lower-cased text."""
        known, slow = self.known, self.weight
        bad = set()
        for w in set(WORD.findall(text)):
            v = known.get(w)
            if (slow(w) if v is None else v) > 0:
                bad.add(w)
        if not bad:
            return []
        out, before = [], []
        for m in WORD.finditer(text):
            w = m[0]
            if w in bad:
                v = known.get(w) or slow(w)
                ahead, behind = text[max(0, m.start() - WINDOW) : m.start()], text[m.end() : m.end() + WINDOW]
                if (ahead.count('"') % 2 and '"' in behind) or (max(map(ahead.rfind, OPEN)) > max(map(ahead.rfind, CLOSE)) and any(c in behind for c in CLOSE)):
                    v *= QUOTED
                if SAYS.intersection(before):
                    v *= REPORTED
                out.append((m.start(), m.end(), v))
            before = [*before[-4:], w]
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """The sum of the densest window of hits, and the logarithms of the weight per hundred words and of the number of different hits."""
        text = text.lower()
        found = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        most, run, first = 0.0, 0.0, 0
        for s, _, v in found:
            run += v
            while found[first][0] < s - WINDOW:
                run -= found[first][2]
                first += 1
            most = max(most, run)
        return most, math.log1p(100 * sum(v for _, _, v in found) / max(len(text.split()), 1)), math.log1p(len({text[s:e] for s, e, _ in found}))

    def score(self, text: str) -> float:
        z = self.model.bias + sum(c * x for c, x in zip(self.model.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method; the weights of features can't be negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3] + [1.0] * (len(w) - 1))
        g = x.T @ (p - y) + ridge * np.array([1e-3] + [1.0] * (len(w) - 1)) * w
        w = w - np.linalg.solve(h, g)
    return np.maximum(w, [-np.inf] + [0.0] * (len(w) - 1))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that aren't held out, at most `sample` of them. With one class only, or none, it finds nothing toxic."""
    scratch = Scratch(docs.sparkSession, "toxic")
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = scratch.save(marked.filter(F.coalesce(~held_out("l_id"), F.lit(False))), "labels")
    n = marked.count()
    if n > sample:
        marked = marked.filter(F.pmod(F.xxhash64("l_id"), F.lit(n)) < sample)
    # at most about `sample` rows: the bound of the broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = scratch.save(rows.join(F.broadcast(marked), F.col("doc_id") == F.col("l_id")).select("text", "toxic"), "train")
    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        return Model()

    def count(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                met = {}
                for i, w in enumerate(words):
                    if w not in met:
                        met[w] = i
                        if not w.isdigit():
                            for k in STEMS:
                                if len(w) > k:
                                    met.setdefault("^" + w[:k], i)
                for w, i in met.items():
                    got = seen.setdefault(w, [0, 0, 0])
                    got[toxic] += 1
                    if toxic:
                        around = " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])
                        got[2] |= 1 << zlib.crc32(around.encode()) % 62
            bits = [list(x) for x in zip(*seen.values())] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(x, pa.int64()) for x in bits)], ["term", "good", "bad", "contexts"])

    counts = train.mapInArrow(count, "term string, good long, bad long, contexts long").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bit_or("contexts").alias("contexts"))
    counts = scratch.save(counts, "counts")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + PRIOR) / (good + 1))
    chosen = counts.filter((F.col("bad") >= DOCS) & (F.bit_count("contexts") >= CONTEXTS)).withColumn("weight", odds).filter(F.col("weight") >= WEIGHT)
    best = chosen.collect()  # at most the terms of three toxic documents of the sample: a bound that does not grow with the corpus
    model = Model({r.term: r.weight for r in best if r.term[0] != "^"}, {r.term[1:]: r.weight for r in best if r.term[0] == "^"})

    def like(batches):
        trie = FuzzyTrie(w for w in model.terms if len(w) >= FUZZY)
        for b in batches:
            keep = [w for w in b.column(0).to_pylist() if w not in model.terms and trie.nearest(w)]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["term"])

    harmless = counts.filter("good > 0").select("term").mapInArrow(like, "term string")
    model.harmless = frozenset(r.term for r in harmless.collect())  # at most what the sample's documents hold near the lexicon

    def measure(batches):
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([x[k] for x in got], pa.float64()) for k in range(3))], ["toxic", "a", "b", "c"])

    rows = train.mapInArrow(measure, "toxic int, a double, b double, c double").toPandas()
    w = _fit(rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy().astype(float))
    model.bias, model.coef = float(w[0]), tuple(map(float, w[1:]))
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every row, no shuffle. Null and empty texts get the score of a text without hits."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            scores = pa.array([scorer.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null id is held out as false. Null and empty texts score as a text without hits; very long texts are scored whole, in linear time.
    Repeated rows stay, equal texts have equal scores; an empty table gives an empty result; other columns are ignored. A document with
    several labels is toxic if one says so; labels other than 0 and 1 count as 1 if positive, else 0."""
    model = learn(docs, labels, text_col, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_scores(rows, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Null and empty texts stay, equal texts stay or go together,
    repeated rows too; no rows give none, and without labels of both classes all stay. Columns named driftlog_... are not allowed."""
    reserved(docs)
    model = learn(docs, labels, text_col, id_col)
    return with_scores(docs, model, text_col, "driftlog_score").filter(F.col("driftlog_score") < THRESHOLD).drop("driftlog_score")
