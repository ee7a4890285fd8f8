import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import Row

from driftlog.llm import similar, simhash
from driftlog.llm.common import Scratch
from driftlog.llm.components import connected_components
from driftlog.llm.exact_dedup import HEAD, drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, block string, fp long"


def docs(spark, texts):
    return spark.createDataFrame([Row(i, t, "en", "s", None, "x", "y", 1) for i, t in texts], SCHEMA)


def brute_exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_dedup_against_brute_force(spark):
    long = "".join(random.Random(1).choice("abcdé ") for _ in range(90_000))
    texts = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, long), (8, long.replace(" ", "\n")), (9, long + "!"), (10, "!" + long), (11, "a b"), (12, "ba")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs(spark, texts)).collect()}
    assert got == brute_exact(texts)


def test_exact_dedup_repeated_rows_null_ids_and_nothing(spark):
    rows = exact_dedup(docs(spark, [(1, "x"), (1, "x"), (None, "x"), (None, "y")])).collect()
    assert sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows} == {1, None}
    assert exact_dedup(docs(spark, [])).count() == 0
    left = drop_copies(docs(spark, [(1, "x"), (1, "x"), (2, "x "), (None, "y")]))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "y"), (2, "x ")]
    assert len(drop_copies(docs(spark, [(1, "x"), (1, "x")])).collect()) == 1


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(50)] + ["Ä", "É b"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts = [None, "", "A", "a b", "A  B\n", "x" * 5000]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 10))
    want = {i: brute_print(t) for i, t in rows}
    parts = brute_components(want)
    for most in (4096, 4):  # the second deals every key out as pairs of parts
        monkeypatch.setattr(simhash, "MOST", most)
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs(spark, rows)).collect()}
        assert got == {i: (want[i], parts[i]) for i in want}
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    kept = simhash.drop_near_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))


def test_bit_sliced_links_are_all_links():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for c in centre for _ in range(60)], np.uint64)
    n = len(fps)
    i, j = simhash.near_lanes(fps, np.arange(n) + 1, np.full(n, n), step=100)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "u long, v long"), Scratch(spark, "cc")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def brute_similar(texts):
    """The least id of each group joined by pairs whose five-word sets have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return set(root.values())


def test_similar_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    texts = ["", " ", "a b", "A  B\n", "a c"]
    for _ in range(8):
        base = rng.choices(words, k=rng.choice((60, 120, 300)))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 10))
    want = brute_similar(rows)
    few = {r.component_id for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert len(few) > len(want), "three bits leave near copies"
    for part in (256, 3):  # the second deals the components out as pairs of parts
        monkeypatch.setattr(similar, "PART", part)
        assert {r.doc_id for r in similar.drop_similar(docs(spark, rows)).collect()} == want
    odd = docs(spark, [(1, "one two"), (1, "three four"), (None, "ONE two"), (2, "three  four"), (None, None)])
    assert sorted((r.doc_id or 0, r.text or "") for r in similar.drop_similar(odd).collect()) == [(0, ""), (1, "one two"), (1, "three four")]
    assert similar.drop_similar(docs(spark, [])).count() == 0


def test_block_names_are_ranks_however_the_data_lie(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.choice([3, 700, 1500, 5000])))) for i in range(60)]
    texts += [(i + 100, t) for i, t in texts[::3]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: (r.level, r.name) for r in exact_dedup(docs(spark, texts).repartition(int(parts))).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    normal = {i: t.replace(" ", "") for i, t in texts}
    short = [((normal[i][:HEAD], hashlib.sha256(normal[i].encode()).digest()), name) for i, (level, name) in got[0].items() if level == 0]
    assert [n for _, n in sorted(short)] == sorted(n for _, n in short)
    assert all((got[0][i] == got[0][j]) == (normal[i] == normal[j]) for i in normal for j in normal)
