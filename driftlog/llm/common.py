"""What several training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one where all run in one process, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftlog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The scratch folders that each open tidy() has to remove.
_TIDY: list[list[str]] = []


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables of all operators begun within, at the end: their results must be written by then. Operators give lazy
    results that read their scratch tables, so outside of tidy() those stay until the shared folder is emptied."""
    _TIDY.append([])
    try:
        yield
    finally:
        for folder in _TIDY.pop():
            remove(spark, folder)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no recomputation from the start."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _TIDY:
            _TIDY[-1].append(self.base)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it back."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that save() gave, once nothing reads it any more."""
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if self.base.rpartition("/")[2] not in folder:
                raise ValueError(f"{folder} is not of this scratch")
            remove(self.spark, folder)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def blocks_of(array: Column) -> Column:
    """An array cut into about as many pieces as each has entries, so that what is quadratic in a piece stays far below the square of all."""
    wide = lambda a: F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    last = lambda a, w: F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / w).cast("int")
    return let(array, lambda a: let(wide(a), lambda w: F.transform(F.sequence(F.lit(0), last(a, w)), lambda j: F.slice(a, j * w + 1, w))))


def scanned(array: Column, start: Column, step, kind: str) -> Column:
    """start, step(start, x1), step(step(start, x1), x2), ...: one entry more than the array. kind: the type of the state. For short arrays."""
    state = F.struct(start.alias("now"), F.array(start).cast(f"array<{kind}>").alias("out"))
    return F.aggregate(array, state, lambda s, x: let(step(s["now"], x), lambda v: F.struct(v.alias("now"), F.concat(s["out"], F.array(v)).alias("out"))), lambda s: s["out"])


def running_sums(array: Column) -> Column:
    """The sums of an array of integers up to each entry, in blocks."""
    add = lambda s, x: s + x

    def of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add))
        return F.flatten(F.zip_with(blocks, scanned(sums, F.lit(0), add, "int"), lambda b, at: F.when(b.isNotNull(), F.slice(scanned(b, at, add, "int"), F.lit(2), F.size(b))).otherwise(F.expr("CAST(array() AS array<int>)"))))

    return let(blocks_of(array), of)


def replaced(text: Column, spans: Column, label, tail=lambda s, pos: F.lit("")) -> Column:
    """text with label(span) for each of the spans (start, end, ...; by start); a span that begins within one before, which ends at pos, only
    adds tail(span, pos). In blocks."""
    far = lambda b: F.coalesce(F.array_max(F.transform(b, lambda s: s["end"])), F.lit(0))

    def of(blocks: Column) -> Column:
        ends = scanned(F.transform(blocks, far), F.lit(0), lambda s, x: F.greatest(s, x), "int")

        def block(b: Column, lo: Column) -> Column:
            piece = F.substring(text, lo + 1, F.greatest(far(b) - lo, F.lit(0)))
            state = F.struct(F.lit("").alias("out"), lo.alias("pos"))
            return let(piece, lambda p: F.aggregate(
                b, state,
                lambda a, s: F.struct(
                    F.when(s["start"] < a["pos"], F.concat(a["out"], tail(s, a["pos"]))).otherwise(F.concat(a["out"], F.substring(p, a["pos"] - lo + 1, s["start"] - a["pos"]), label(s))).alias("out"),
                    F.greatest(a["pos"], s["end"]).alias("pos")),
                lambda a: a["out"]))

        made = F.zip_with(blocks, ends, lambda b, lo: F.when(b.isNotNull(), block(b, lo)).otherwise(F.substring(text, lo + 1, F.length(text))))
        return F.array_join(made, "")

    return let(blocks_of(spans), of)


def reserved(docs: DataFrame) -> None:
    """Operators that give back a table's own columns join with columns of this prefix."""
    if clash := [c for c in docs.columns if c.lower().startswith("driftlog_")]:
        raise ValueError(f"columns {clash} have a reserved prefix")


class ByteBounded(dict):
    """What a worker keeps between batches, str -> bytes, in two generations of `most` / 2 bytes: a full one becomes the older, which is
    let go when the next is full. get() looks at the younger; older() at the older, and makes what it finds young again."""

    ENTRY = 220  # the objects' heads and the table's slot

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.before = most // 2, 0, {}

    def limit(self, most: int) -> None:
        """Keep `most` bytes from now on. Less than before: start anew."""
        if most // 2 < self.most:
            self.clear()
            self.held, self.before = 0, {}
        self.most = most // 2

    def older(self, key: str) -> bytes | None:
        found = self.before.pop(key, None)
        return None if found is None else self.put(key, found)

    def put(self, key: str, value: bytes) -> bytes:
        size = self.ENTRY + 2 * len(key) + len(value)
        if size > self.most // 64:  # odd giants would push all others out
            return value
        if self.held + size > self.most:
            self.before = {}  # first, so that three generations never stand at once
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size
        return value


def give_back() -> None:
    """Return to the system what a worker's allocators hold but no object uses; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of a text column, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
