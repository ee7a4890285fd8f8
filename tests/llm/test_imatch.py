"""Fingerprints against a plain version in Python."""

import hashlib
import random

import regex
import xxhash

from driftlog.llm import imatch


def fold(numbers, seed=42):
    for x in numbers:
        seed = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hashes(text):
    return {signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in regex.split(imatch.NOT_TERM, text.lower()) if t}


def depth(b):
    return next(d for d, (first, last) in enumerate(imatch.GROUPS) if first <= b <= last)


def mask(h):
    draws = [fold([h, k]) for k in range(2 * len(imatch.GROUPS))]
    return sum(1 << b for b in range(64) if all(draws[k] >> b & 1 for k in range(2 * depth(b) + 2)))


def signs(text, known):
    own = hashes(text)
    own = sorted(own & known or own)
    masks = {h: mask(h) for h in own}
    kept = [own] + [[h for h in own if masks[h] >> b & 1] for b in range(64)]
    return [fold(x for h in k for x in (h, masks[h])) if k else None for k in kept]


def like(a, b):
    told = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(told) / len(told) if told else 1.0


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(4)
    texts = {i * 3: " ".join(rng.choice(["naïve", "Word", "é1", "漢字"]) + str(rng.randrange(90)) for _ in range(rng.randrange(0, 120))) for i in range(80)}
    texts |= {500: "", 501: "single", 502: "single", 503: "a, b\n a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    df, n = {}, len(texts)
    for t in texts.values():
        for h in hashes(t):
            df[h] = df.get(h, 0) + 1
    low = max(imatch.LOW, sum(df.values()) / n / imatch.MOST)
    known = {h for h, k in df.items() if max(2, low * n) <= k <= max(3, imatch.HIGH * n)}
    assert set(imatch.lexicon(docs)) == known and len(known) > 20
    got = {r.doc_id: r for r in imatch.edited_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    show = lambda s: "".join("-" if x is None else f"{x:016x}" for x in s)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % n]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new = signs(text, known), signs(edited, known)
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].fingerprint == show(own) and got[d].edited_fingerprint == show(new)
        assert abs(got[d].near_edited - like(own, new)) < 1e-12 and abs(got[d].near_next - like(own, signs(after, known))) < 1e-12


def test_sub_lexicons_keep_their_share():
    masks = [mask(signed(fold([k]))) for k in range(20_000)]
    for b in range(64):
        share, want = sum(m >> b & 1 for m in masks) / len(masks), 4.0 ** -(depth(b) + 1)
        assert abs(share - want) < 5 * (want / len(masks)) ** 0.5


def test_the_lexicon_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST", 40)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 300}" for k in range(40))) for i in range(200)], "doc_id long, text string")
    assert len(imatch.lexicon(docs, low=0.0, high=1.0)) <= 40
