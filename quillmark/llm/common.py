"""What the operators share: written tables, text kernels and components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Tables written to the folder that driver and executors share
# --------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none and its executors are threads of this process
    (tests, local runs) a temporary folder of this machine is set; on a cluster
    the setting has to exist.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call.

    ``write`` stores a DataFrame and reads it back, which cuts the lineage: a
    lost executor re-reads files and repeats nothing.  ``drop`` deletes a table
    once nothing reads it; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # tables that a result reads have to last as long as the session may read them
        atexit.register(self.close)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(table))
        return self.read(table, df.schema)

    def read(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(table))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        if jvm is None:
            return
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def close(self) -> None:
        try:
            if self.spark._jsc.sc().isStopped():
                return
            self._delete(self.root)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass


# --------------------------------------------------------------------------
# What a Python worker keeps between tasks
# --------------------------------------------------------------------------

_MEMORY: dict = {}


def worker_memory(key: tuple, make):
    """The object that ``make`` gives, kept for later tasks of this worker.

    A worker outlives its stage; it keeps one object, and asking for another one
    frees the first.
    """
    if key not in _MEMORY:
        forget()
        _MEMORY[key] = make()
    return _MEMORY[key]


def forget() -> None:
    """Frees what earlier stages left in this worker."""
    _MEMORY.clear()
    trim()


def trim() -> None:
    """Gives the system back what is free, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


# --------------------------------------------------------------------------
# Text kernels: whole Arrow columns as byte arrays
# --------------------------------------------------------------------------

U64 = np.uint64
_rng = np.random.default_rng(20240517)
#: An odd 64-bit value for each byte.
BYTE_VALUE = _rng.integers(1, 2**62, 256, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[0x41:0x5B] += 0x20
EXACT_VALUE = np.where(IS_SPACE, U64(0), BYTE_VALUE)
LOWER_VALUE = np.where(IS_SPACE, U64(0), BYTE_VALUE[LOWER])
_POWERS = 1 << 12
POWER = np.ones(_POWERS, np.uint64)
np.cumprod(np.full(_POWERS - 1, 0x9E3779B97F4A7C15, np.uint64), out=POWER[1:])
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def doc_slices(offsets: np.ndarray, target: int = SLICE_BYTES):
    """Ranges of whole documents with about ``target`` bytes, so that the
    kernels' temporary arrays stay in the CPU's caches."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + target, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes; ``value`` maps a byte to its weight."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    if total > 8 * SLICE_BYTES and len(starts) > 1:  # bounded temporary arrays for very long texts
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(4 * SLICE_BYTES, total, 4 * SLICE_BYTES))
        cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
        return np.concatenate([span_hashes(data, starts[a:b], ends[a:b], value) for a, b in zip(cuts[:-1], cuts[1:])])
    inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = value[data[inner + np.repeat(starts, lengths)]]
    if lengths.max() > _POWERS:  # positions in blocks, the later blocks' numbers mixed in
        far = np.flatnonzero(inner >= _POWERS)
        weight[far] = mix(weight[far] + (inner[far] // _POWERS).astype(np.uint64)) | U64(1)
        inner = inner % _POWERS
    weight *= POWER[inner]
    sums = np.add.reduceat(weight, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a document, and where each begins."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = mix(words[:m])
    for j in range(1, size):
        value = mix(value * U64(0x9FB21C651E98DF25) + words[j : m + j])
    at = np.flatnonzero(doc[:m] == doc[size - 1 :])
    return value[at], at


# --------------------------------------------------------------------------
# Connected components
# --------------------------------------------------------------------------


def star_edges(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, centres): a star for each component of the pairs (i, j) of ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        down = label.copy()
        np.minimum.at(down, i, low)
        np.minimum.at(down, j, low)
        np.minimum.at(down, label[i], low)
        np.minimum.at(down, label[j], low)
        down = down[down]
        if (down == label).all():
            break
        label = down
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each
    written to the shared folder; the driver sees only counts.  A hub's edges
    meet its minimum through a join that AQE may split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, f"{name}_0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = e.groupBy("a").agg(F.min("b").alias("m"))
            out = e.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
            out = out.select(F.col("s.b").alias("a"), F.col("s.m").alias("b"))
        return out.where("a <> b").distinct()

    seen, step = None, 0
    while True:
        step += 1
        edges = scratch.write(star(star(edges, True), False), f"{name}_{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_{step - 1}")
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # every edge now is (id, smallest id of its component)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
