"""Token ids in files of shuffled planes.

A shard holds the ids of whole documents. Its ids are cut into fixed-size blocks; a block is transposed into
planes, of one bit or one byte of every id, and each plane is compressed by zstandard, planes of zeros left out. A chunk
index gives each block's place, so a range of ids is read without the rest. Shards are rows of a table that
Spark writes to the shared folder (any store that Spark reaches, committed as a whole); export_shards() gives
each shard as a file of its own.

Layout: magic, then blocks, then one zstandard frame with the index, its length (4 bytes) and the magic again."""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ByteBounded, Scratch, slices

MAGIC = b"DLPLANE1"
BLOCK_IDS = 16384
SHARD_IDS = 1 << 20
LEVEL = 3
#: Bytes of words and their ids that a worker keeps.
KEPT_BYTES = 192 << 20
#: Runs of letters or marks, and the digit that parts them.
PROBES = ("1", "a", "the", "anderswo", "éàüßñ", "ɏįıħ", "zzzqqqxxjk" * 9, ".", "...", ",;:!?", "?!.")


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    if bits:
        table = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(table[:, p], bitorder="little").tobytes() for p in range(32)]
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [table[:, p].tobytes() for p in range(4)]


def _unplane(planes: dict[int, bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        table = np.zeros((n, 32), np.uint8)
        for p, x in planes.items():
            table[:, p] = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n]
        return np.packbits(table, axis=1, bitorder="little").reshape(-1).view("<u4")
    table = np.zeros((n, 4), np.uint8)
    for p, x in planes.items():
        table[:, p] = np.frombuffer(x, np.uint8)
    return table.reshape(-1).view("<u4")


def write_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """A shard's bytes: ids of all its documents, one after the other."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    body, index = [MAGIC], []
    at = len(MAGIC)
    for k in range(0, len(ids), block):
        sizes = {}
        for p, plane in enumerate(_planes(ids[k : k + block], bits)):
            if plane.strip(b"\0"):
                body.append(press.compress(plane))
                sizes[p] = len(body[-1])
        index.append([at, min(block, len(ids) - k), [[p, n] for p, n in sizes.items()]])
        at += sum(sizes.values())
    head = json.dumps({"bits": bits, "block": block, "n": len(ids), "chunks": index, "docs": [[d, n] for d, n in zip(doc_ids, lengths, strict=True)]})
    foot = press.compress(head.encode())
    return b"".join([*body, foot, struct.pack("<I", len(foot)), MAGIC])


def read_index(data: bytes) -> dict:
    import zstandard

    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a shard of planes")
    end = len(data) - len(MAGIC) - 4
    (n,) = struct.unpack("<I", data[end : end + 4])
    return json.loads(zstandard.ZstdDecompressor().decompress(data[end - n : end]))


def read_ids(data: bytes, index: dict, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids from lo to hi of a shard; only blocks that hold some are unpacked."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    hi = index["n"] if hi is None else min(hi, index["n"])
    block, out = index["block"], []
    if hi <= lo:
        return np.zeros(0, "<u4")
    for k in range(lo // block, -(-hi // block)):
        at, n, sizes = index["chunks"][k]
        planes = {}
        for p, size in sizes:
            planes[p] = unpress.decompress(data[at : at + size])
            at += size
        out.append(_unplane(planes, n, index["bits"]))
    first = lo // block * block
    return np.concatenate(out)[lo - first : hi - first]


_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|[0-9]")
_WHITE = re.compile("[ \t\r\n]+")
#: Letters, then marks that can't start a special token; the empty word too.
_SIMPLE = f"^(?P<head>[{_LETTERS}]*)(?P<tail>[.,;:!?]*)$"


class WordTokenizer:
    """Ids as the tokenizers library gives them for a whole text, with equal words encoded once.

    Its pre-tokenizer drops white space, so a text falls apart at blanks, tabs and line ends. A word of Latin letters, ASCII
    marks (no apostrophe) and ASCII digits falls apart further, into runs of letters, runs of marks and single digits, as
    the pre-tokenizer cuts it. All other words, and those that may hold a special token, go to the library whole.

    What it keeps, ids by part, is bounded in bytes."""

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = self.bare = Tokenizer.from_file(path)
        # The same merges without normaliser and pattern, for what is one run already; not used where some word says otherwise.
        with open(path, encoding="utf-8") as f:
            bare = json.load(f) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        bare = Tokenizer.from_str(json.dumps(bare))
        if all(self.lib.encode(w, add_special_tokens=False).ids == bare.encode(w, add_special_tokens=False).ids for w in PROBES):
            self.bare = bare
        self.known = ByteBounded(kept)

    def _parts(self, word: str) -> list[str]:
        out = []
        for w in _WHITE.split(word) if _WHITE.search(word) else (word,):
            if not w:
                continue
            if _PLAIN.fullmatch(w) and "<|" not in w:
                out += [r.lower() for r in _RUNS.findall(w)]
            else:
                out.append(w)
        return out

    def _learn(self, new: list[str], found: dict[str, bytes], encode) -> None:
        older = self.known.older
        new = [p for p in new if (b := older(p)) is None or found.update({p: b})]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for p, ids in zip(some, encode(some), strict=True):
                found[p] = self.known.put(p, ids)

    def _encode_each(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_joined(self, parts: list[str]) -> list[bytes]:
        """Parts of letters or marks, one run of the pre-tokenizer each: as one text, a digit between them, which is a token of its own."""
        mark = self.lib.encode("1", add_special_tokens=False).ids
        (got,) = self.bare.encode_batch_fast([" 1 ".join(parts)], add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == mark[0]), len(ids))
        if len(mark) != 1 or len(ends) != len(parts):
            return self._encode_each(parts)
        flat, ends = ids.tobytes(), ends * 4
        return [flat[s:e] for s, e in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        words = pc.split_pattern(texts, " ")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(words))
        names, known = coded.dictionary, self.known
        # Most words are letters, or letters and then marks: those fall apart in Arrow, one or two parts each.
        cut = pc.extract_regex(names, _SIMPLE)
        simple = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        cut = cut.filter(pc.is_valid(cut))
        heads, tails = pc.utf8_lower(pc.struct_field(cut, "head")).to_pylist(), pc.struct_field(cut, "tail").to_pylist()
        odd = [self._parts(w) for w in names.filter(pa.array(~simple)).to_pylist()]
        single = dict.fromkeys(heads) | dict.fromkeys(tails)
        single.pop("", None)
        several = dict.fromkeys(p for ps in odd for p in ps if p not in single)
        found = dict(zip(single, map(known.get, single), strict=True)) | dict(zip(several, map(known.get, several), strict=True))
        self._learn([p for p in single if found[p] is None], found, self._encode_joined)
        self._learn([p for p in several if found[p] is None], found, self._encode_each)
        found[""] = b""
        blobs = np.empty(len(names), object)
        blobs[simple] = [found[h] + found[t] if t else found[h] for h, t in zip(heads, tails, strict=True)]
        blobs[~simple] = [b"".join([found[p] for p in ps]) for ps in odd]
        blobs = blobs.tolist()
        flat = np.frombuffer(b"".join(blobs), "<u4")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
        start = np.cumsum(size) - size
        use = coded.indices.to_numpy(zero_copy_only=False)
        each = size[use]
        total = np.concatenate([[0], np.cumsum(each)])
        narrow = np.int32 if max(len(flat), total[-1]) < 1 << 30 else np.int64
        at = np.repeat((start[use] - total[:-1]).astype(narrow), each)
        at += np.arange(total[-1], dtype=narrow)
        ids = flat.take(at)
        return ids, np.diff(total[ends])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer: later tasks of the worker find the words that earlier ones encoded."""
    return WordTokenizer(path)


def write_token_shards(docs: DataFrame, tokenizer_file: str, end_id: int, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", bits: bool = False) -> DataFrame:
    """Tokenise, order by doc_id (null first, ties by text), write shards and give them as (part, shard, n_ids, payload)."""
    def run(batches):
        from pyspark import TaskContext

        words = tokenizer(tokenizer_file)
        part, shard = TaskContext.get().partitionId(), 0
        held, names, lengths, n = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([write_shard(np.concatenate(held), names, lengths, bits)], pa.binary())})

        for b in batches:
            for piece in slices(b, 1, 16 << 20):
                ids, each = words.encode(piece.column(1).cast(pa.large_string()))
                end = 0
                for d, k in zip(piece.column(0).to_pylist(), each.tolist(), strict=True):
                    held += [ids[end : end + k], np.array([end_id], "<u4")]
                    names.append(d)
                    lengths.append(k + 1)
                    end, n = end + k, n + k + 1
                    if n >= SHARD_IDS:
                        yield close()
                        held, names, lengths, n, shard = [], [], [], 0, shard + 1
        if names:
            yield close()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(rows.mapInArrow(run, "part int, shard int, n_ids long, payload binary"), "shards")


def read_token_shards(shards: DataFrame, scratch: Scratch) -> DataFrame:
    """Read shards back: one row per document with doc_id, start, ids (array of long), in file order."""
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the writer
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead")).join(parts, "part").select("part", "shard", (F.col("base") + F.col("ahead")).alias("first"))
    starts = scratch.save(starts, "starts")

    def run(batches):
        for b in batches:
            for part, shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = data.as_py()
                index = read_index(data)
                ids = read_ids(data, index)
                names, lengths = [d for d, _ in index["docs"]], np.array([n for _, n in index["docs"]], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * k, pa.int32()), "shard": pa.array([shard] * k, pa.int32()), "doc_id": pa.array(names, pa.int64()), "ahead": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64())})

    found = shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, ahead long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", bits: bool = False) -> DataFrame:
    """Write all documents as shards and read them back: doc_id, start, n_tokens (the end id too), ids_crc32.

    A null text counts as empty and has the end id alone. Null ids come first in the files; rows that repeat stay, one
    after the other. An empty table gives an empty result. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_token_shards(write_token_shards(docs, tokenizer_file, end_id, scratch, text_col, id_col, bits), scratch)


def export_shards(shards: DataFrame, folder: str) -> int:
    """Each shard as a file part-shard.planes in a local folder; the driver takes one shard at a time. Returns their number."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in shards.select("part", "shard", "payload").toLocalIterator():
        with open(f"{folder}/{row.part:05d}-{row.shard:05d}.planes", "wb") as f:
            f.write(row.payload)
        n += 1
    return n
