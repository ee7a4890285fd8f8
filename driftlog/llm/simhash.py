"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64-bit majority over the XXH64 of word shingles. Equal fingerprints collapse to one row first.
Candidates: 64 bits in five bands; at most three differing bits leave two bands equal, so ten band pairs
give ten keys and no link is lost. Within a key, rows are sorted and stored vertically: a block is 64
fingerprints as 64 planes of 64 bits. A fingerprint meets a block by adding one mismatch plane after the other
into two carry-save counter planes and a plane of lanes past the radius; blocks whose lanes are all past it are
abandoned. Each task gives a spanning forest of its links, which the components step joins."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

SEED = 42
RADIUS = 3  # what two carry-save counters hold
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits)
#: Rows of one key that one task compares; keys with more are dealt out as pairs of parts.
MOST = 4096
_CHUNK = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text, signed; 0 where there is no word."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1]
    ends = ends[k - 1 :]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints, stored vertically: (blocks, 64), word t of a block has bit t of its 64 rows."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # block, row, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, 0 <= n <= 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def near_lanes(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with lo[i] <= j < hi[i] and at most RADIUS differing bits, by carry-save counting over planes."""
    blocks = planes(fps)
    first, last = lo >> 6, np.where(hi > lo, (hi - 1) >> 6, (lo >> 6) - 1)
    each = last - first + 1
    total = np.cumsum(each)
    found_i, found_j = [], []
    for at in range(0, int(total[-1]) if len(total) else 0, step):
        k = np.arange(at, min(at + step, int(total[-1])))
        q = np.searchsorted(total, k, side="right")
        b = first[q] + (k - (total[q] - each[q]))
        inside = _below(hi[q] - (b << 6)) & ~_below(lo[q] - (b << 6))
        c0, c1, over = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), ~inside
        for t in range(64):
            wanted = (np.uint64(0) - ((fps[q] >> np.uint64(t)) & np.uint64(1))).astype(np.uint64)
            m = blocks[b, t] ^ wanted
            carry = c0 & m
            c0 ^= m
            over |= c1 & carry
            c1 ^= carry
            if t % 8 == 7:  # abandon the blocks whose lanes are all past the radius
                live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    q, b, c0, c1, over = q[live], b[live], c0[live], c1[live], over[live]
                if not len(q):
                    break
        if len(q):
            bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            found_i.append(q[row])
            found_j.append((b[row] << 6) + lane)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _links(batches):
    """Sorted rows (key, left, right, part, fp) -> a spanning forest (u, v) of the links of each key."""
    import pyarrow.compute as pc

    def edges(rows: pa.Table):
        fps = rows["fp"].to_numpy().view(np.uint64)
        ids = [rows[c].to_numpy() for c in ("key", "left", "right")]
        new = np.ones(len(fps), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fps))[group]
        at = np.arange(len(fps))
        part, left, right = rows["part"].to_numpy(), ids[1], ids[2]
        split = left != right  # then rows of the left part meet those of the right part only
        rights = np.add.reduceat((split & (part == right)).astype(np.int64), starts)[group]
        lo = np.where(split, np.where(part == left, ends - rights, ends), at + 1)
        i, j = near_lanes(fps, lo, ends)
        root = forest(len(fps), i, j)
        moved = np.flatnonzero(root != at)
        signed = fps.view(np.int64)
        u, v = signed[moved], signed[root[moved]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    kept: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows < 4 * MOST:
            continue
        t = pa.Table.from_batches(kept)
        same = np.logical_and.reduce([pc.equal(t[c], t[c][-1]).to_numpy() for c in ("key", "left", "right")])
        cut = int(np.argmax(same))  # the last group may go on
        if cut:
            yield edges(t.slice(0, cut))
        kept, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield edges(pa.Table.from_batches(kept))


def near_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """fps (fp, distinct) -> (u, v): links whose components are those of all pairs within the radius."""

    def band(k):
        low, bits = BANDS[k]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 13).bitwiseOR(band(a)), 13).bitwiseOR(band(b)) for n, (a, b) in enumerate(combinations(range(5), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    zero = F.lit(0)
    hot = scratch.save(rows.groupBy("key").count().filter(F.col("count") > MOST).select("key", F.ceil(F.col("count") / (MOST // 2)).cast("int").alias("k")), "hot")
    if hot.isEmpty():
        dealt = rows.select("key", zero.alias("left"), zero.alias("right"), zero.alias("part"), "fp")
    else:
        cold = rows.join(hot, "key", "left_anti").select("key", zero.alias("left"), zero.alias("right"), zero.alias("part"), "fp")
        salted = rows.join(hot, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        other = salted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        dealt = cold.unionByName(other.select("key", F.least("part", "o").alias("left"), F.greatest("part", "o").alias("right"), "part", "fp"))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["key", "left", "right"]
    return dealt.repartition(n, *order).sortWithinPartitions(*order, "part", "fp").mapInArrow(_links, "u long, v long")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their
    own; null ids never become a component_id unless nothing else is in the component. An empty table gives
    an empty result. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, text_col, id_col), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = scratch.save(near_links(nodes.select("fp"), scratch), "links")
    member = connected_components(links, scratch)
    member = scratch.save(nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "member")
    least = scratch.save(member.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = scratch.save(member.join(least, "root").select("fp", "component_id"), "of")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is their component's: one of each group. Rows that repeat an id stay together."""
    found = simhash_components(docs, text_col, id_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("driftlog_id"))
    found = Scratch(docs.sparkSession, "near").save(found)
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("driftlog_id")), "left_semi")
