"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder does not run the merges over a text. An Aho-Corasick automaton gives every vocabulary piece that
starts at a position; the longest goes first. A piece may follow another if re-merging the two keeps them
apart; a sequence in which all neighbours are compatible is the merge result, and there is one for each prefix. So
a position from which no piece fits is dead for good: a bitfield keeps those. No piece has a space mark after
another character, so a text falls apart before its runs of space marks; where no piece mixes letters with other characters, also between those. Equal
chunks are encoded once a worker."""

from __future__ import annotations

import functools
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteBounded, give_back, slices

SPACE_MARK = "▁"
LETTERS = r"[^\W\d_]"
#: Bytes of chunks with their ids that a worker keeps, and how many neighbour checks (some 170 bytes each, as they share the vocabulary's strings).
KEPT_BYTES, KEPT_CHECKS = 288 << 20, 250_000
#: Bytes of text that a worker holds as Python objects at a time.
SLICE = 1 << 20
#: What a normaliser that changes nothing leaves as it is: ligatures, wide letters, marks that combine, runs and ends of blanks, controls.
PROBES = ("a", "ﬁ①ｱＡ", "e\u0301é", " a  b ", "\ta\nb\r", "\u00a0\u3000\u200b", "İßΣς", "\x01\x7f", "漢字🙂")


class Codec:
    """encode() gives the library's ids, decode() is the library's."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in ids}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.name = {p: p for p in self.ids}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece goes over a word's end")
        if any(lib.normalize(t) != SPACE_MARK + t.replace(" ", SPACE_MARK) for t in PROBES):
            raise ValueError("the model's normaliser changes texts")
        if lib.unk_id() in lib.encode("\x00\U0010fffd"):
            raise ValueError("the model needs byte pieces for what its vocabulary lacks")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        chunks = f"{SPACE_MARK}*{LETTERS}+|{SPACE_MARK}*[^\\w{SPACE_MARK}\n]+|{SPACE_MARK}*[\\d_]+|{SPACE_MARK}+|\n"
        self.chunk = re.compile(chunks)
        if any(self.chunk.match(p).end() < len(p) for p in self.ids):  # some piece goes over these borders
            self.chunk = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.known = ByteBounded(KEPT_BYTES)
        if any(self.encode(t).tolist() != lib.encode(t) for t in PROBES):
            raise ValueError("the model doesn't merge by its scores alone")

    def merge(self, text: str) -> list[str]:
        """Plain BPE: the adjacent pair whose piece scores highest merges first, the leftmost of equals."""
        if len(text) <= 48:
            return self._merge_short(list(text))
        part: list[str | None] = list(text)
        left, right = [i - 1 for i in range(len(part))], [i + 1 for i in range(len(part))]
        score, heap = self.score, []

        def offer(i: int, j: int) -> None:
            if (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i], j, part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, j, b = heapq.heappop(heap)
            if part[i] != a or part[j] != b or right[i] != j:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[i] < len(part):
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in part if p is not None]

    def _merge_short(self, part: list[str]) -> list[str]:
        get, none = self.score.get, -1e30
        score = [get(a + b, none) for a, b in zip(part, part[1:])]
        while score:
            best = max(score)
            if best == none:
                break
            i = score.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del score[i]
            if i:
                score[i - 1] = get(part[i - 1] + part[i], none)
            if i < len(score):
                score[i] = get(part[i] + part[i + 1], none)
        return part

    def compatible(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > KEPT_CHECKS:
                self.fits.clear()
            found = self.fits[self.name.get(a, a), self.name.get(b, b)] = self.merge(a + b) == [a, b]
        return found

    def reachable(self, a: str) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[self.name.get(a, a)] = self.merge(a) == [a]
        return found

    def pieces(self, chunk: str) -> list[str]:
        """The merge result of a chunk, by backtracking. Characters in no piece are tokens of their own."""
        starts = [2] * len(chunk)  # bit n: a piece of n characters starts here
        for end, n in self.automaton.iter(chunk):
            starts[end - n + 1] |= 1 << n
        out: list[str] = []
        left = [starts[0]]  # what is still to be tried at each open position
        at, dead, size, last = 0, 0, len(chunk), None
        fits, whole = self.fits, self.whole
        while at < size:
            options = left[-1]
            while options:
                n = options.bit_length() - 1
                options ^= 1 << n
                if dead and dead >> (at + n) & 1:
                    continue
                piece = chunk[at : at + n]
                if n > 1:
                    ok = whole.get(piece)
                    if not (self.reachable(piece) if ok is None else ok):
                        continue
                if last is None:
                    break
                ok = fits.get((last, piece))
                if self.compatible(last, piece) if ok is None else ok:
                    break
            else:
                dead |= 1 << at
                left.pop()
                at -= len(out.pop())
                last = out[-1] if out else None
                continue
            left[-1] = options
            out.append(piece)
            last = piece
            at += n
            left.append(starts[at] if at < size else 0)
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit integers."""
        found = self.known.older(chunk)
        if found is None:
            found = self.pieces(chunk)
            ids = list(map(self.ids.get, found))
            if None in ids:
                ids = [j for p, i in zip(found, ids, strict=True) for j in ([i] if i is not None else [self.bytes[b] for b in p.encode()])]
            found = array("i", ids).tobytes()
            if len(chunk) <= 64:
                self.known.put(chunk, found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, without the end id."""
        if not text:
            return np.zeros(0, "<i4")
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        known, slow = self.known, self.chunk_ids
        return np.frombuffer(b"".join([known.get(c) or slow(c) for c in self.chunk.findall(marked)]), "<i4")

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@functools.lru_cache(maxsize=2)
def worker_codec(model_file: str) -> Codec:
    """The worker's codec: later tasks of the worker find the chunks that earlier ones encoded."""
    return Codec(model_file)


def encode_and_decode(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id", kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """One row per input row: doc_id, ids (array of int, the end id last), decoded (the text that decode(ids) gives).

    A null text counts as empty: its ids are the end id alone, its decoded text is empty. Rows that repeat and null ids
    are kept; an empty table gives an empty result. Other columns are ignored. model_file must be readable on every executor. kept_bytes
    bounds the chunks that a worker keeps: with less it encodes more of them again."""

    def coded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([codec.end], "<i4")
        ids = [np.concatenate([codec.encode(t), end]) for t in part.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        decoded = [codec.decode(x.tolist()) for x in ids]
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def run(batches):
        give_back()  # the worker may have served other operators
        codec = worker_codec(model_file)
        codec.known.limit(kept_bytes)
        for b in batches:
            for part in slices(b, 1, SLICE):
                yield coded(codec, part)
                give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
