import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftlog.llm import token_files as tf
from driftlog.llm.common import Scratch
from driftlog.llm.sentencepiece_codec import Codec, encode_and_decode

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", " a  b\n\nc ▁d ", "ﬁ ＡＢ ½ é é", "日本語のテキスト", "a\x00b", "<s> </s> <0x0A>", "😀😀 x😀", "\t\ttab", " nbsp 　", "a" * 300, "         deep", "xy" * 4000, "don't stop", "it's '' 'steal x''s", "<|endoftext|>a <|startoftext|>b", "≠ áb", "ΟΔΟΣ Σ", "İstanbul", "a,́b", "½²x 1st 2nd_3", "== ...,,, (x)"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids long, part string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choices("abcdefgh .,▁é\n'0", k=rng.randint(1, 200))) for _ in range(300)]


def test_backtracking_is_the_library(texts):
    codec = Codec(PIECES)
    assert [codec.encode(t).tolist() for t in texts] == codec.lib.encode(texts)
    assert codec.merge("x" * 60 + "abc") == codec._merge_short(list("x" * 60 + "abc"))


def test_encode_and_decode(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(texts)) + [(7777, None), (3, ODD[3]), (None, "x")]
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.ids, r.decoded) for r in encode_and_decode(docs(spark, rows), PIECES).collect()), key=lambda r: r[:2])
    want = sorted(((-1 if i is None else i, lib.encode(t or "") + [2], lib.decode(lib.encode(t or ""))) for i, t in rows), key=lambda r: r[:2])
    assert got == want
    assert encode_and_decode(docs(spark, []), PIECES).count() == 0


def held_by_workers(spark):
    """For each codec of the Python workers that served last: bytes its chunks may take, bytes they take."""

    def probe(batches):
        import gc
        import sys

        import pyarrow as pa

        list(batches)
        size = lambda d: sys.getsizeof(d) + sum(map(sys.getsizeof, d)) + sum(map(sys.getsizeof, d.values()))
        found = [(2 * x.known.most, size(x.known) + size(x.known.before)) for x in gc.get_objects() if type(x).__name__ == "Codec"]
        yield pa.RecordBatch.from_pylist([{"most": m, "held": h} for m, h in found], pa.schema([("most", pa.int64()), ("held", pa.int64())]))

    return [tuple(r) for r in spark.range(0, 8, 1, 4).mapInArrow(probe, "most long, held long").collect()]


def test_kept_bytes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcdeghilmnorstu", k=9)) for _ in range(300))) for i in range(80)]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.ids for r in encode_and_decode(docs(spark, rows), PIECES, kept_bytes=1 << 20).collect()}
    assert got == {i: lib.encode(t) + [2] for i, t in rows}
    held = [h for m, h in held_by_workers(spark) if m == 1 << 20]
    assert held and max(held) < 3 << 19


def test_neighbour_checks_share_the_vocabulary(texts):
    codec = Codec(PIECES)
    for t in texts:
        codec.encode(t)
    assert codec.fits and all(codec.name[p] is p for pair in codec.fits for p in pair if p in codec.name)


@pytest.mark.parametrize("bits", [False, True])
def test_shard_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 64, 1000):
        ids = rng.integers(0, 70_000, n).astype("<u4")
        data = tf.write_shard(ids, [1, None], [n, 0], bits, block=64)
        index = tf.read_index(data)
        assert (tf.read_ids(data, index) == ids).all() and index["docs"] == [[1, n], [None, 0]]
        for lo, hi in ((0, 3), (63, 65), (5, 5), (n // 2, n + 9)):
            assert (tf.read_ids(data, index, lo, hi) == ids[lo:hi]).all()


def test_token_files(spark, texts, monkeypatch, tmp_path):
    lib = Tokenizer.from_file(WORDS)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (3, ODD[1])]
    ids = [(i, lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    want, at = [], 0
    for i, x in ids:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    got = tf.token_files(docs(spark, rows), WORDS)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert tf.token_files(docs(spark, []), WORDS).count() == 0
    shards = tf.write_token_shards(docs(spark, rows), WORDS, 1, Scratch(spark, "x"))
    assert tf.export_shards(shards, str(tmp_path / "out")) == shards.count()
    first = min((tmp_path / "out").iterdir()).read_bytes()
    assert tf.read_ids(first, tf.read_index(first)).tolist()[: len(ids[0][1])] == ids[0][1]
    assert hashlib.sha256(first).hexdigest()
