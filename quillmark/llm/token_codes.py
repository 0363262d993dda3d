"""Token-id files of directly addressable codes (DAC).

A segment holds the ids of consecutive documents.  Each id is cut into 8-bit
chunks; level *l* keeps chunk *l* of the ids that have one, beside a bitmap
(bit set: the id goes on at the next level) and a rank directory (set bits
before each block of 512).  An id's place at the next level is the rank of its
bit, so any id is read on its own, without decoding a block
(Brisaboa, Ladra and Navarro 2013).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import tokenizing
from quillmark.llm.common import Scratch

MAGIC = b"DAC1"
_BLOCK = 512
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_codes(ids: np.ndarray) -> bytes:
    """Levels of ``ids`` (any unsigned 32-bit values)."""
    out, rest, levels = [], np.asarray(ids, "<u4"), 0
    while len(rest) or not levels:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        blocks = -(-len(bitmap) // (_BLOCK // 8))
        counts = np.zeros(blocks * (_BLOCK // 8), np.uint8)
        counts[: len(bitmap)] = _BITS[bitmap]
        ranks = np.zeros(blocks + 1, "<u4")
        np.cumsum(counts.reshape(blocks, _BLOCK // 8).sum(1, dtype=np.int64), out=ranks[1:], dtype="<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
        if not len(rest):
            break
    return struct.pack("<4sB", MAGIC, levels) + b"".join(out)


class Codes:
    """Random access to packed ids."""

    def __init__(self, blob: bytes):
        magic, count = struct.unpack_from("<4sB", blob)
        if magic != MAGIC:
            raise ValueError("not a token code block")
        at, self.levels = 5, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            size, blocks = -(-n // 8), -(-(-(-n // 8)) // (_BLOCK // 8))
            chunk = np.frombuffer(blob, np.uint8, n, at)
            bitmap = np.frombuffer(blob, np.uint8, size, at + n)
            ranks = np.frombuffer(blob, "<u4", blocks + 1, at + n + size)
            at += n + size + 4 * (blocks + 1)
            self.levels.append((chunk, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunk, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            whole = bitmap[block * (_BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(_BITS[whole].sum()) + int(_BITS[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last``; at every level they are consecutive."""
        out, at = np.zeros(last - first, "<u4"), np.arange(last - first)
        for level, (chunk, bitmap, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunk[first:last].astype("<u4") << (8 * level)
            bits = np.unpackbits(bitmap[first >> 3 : -(-last // 8)], bitorder="little")[first & 7 :][: last - first].view(bool)
            block = first // _BLOCK
            before = int(ranks[block]) + int(_BITS[bitmap[block * (_BLOCK // 8) : first >> 3]].sum())
            if first & 7:
                before += int(_BITS[bitmap[first >> 3] & ((1 << (first & 7)) - 1)])
            at, first = at[bits], before
            last = before + len(at)
        return out


_SEGMENT = "part long, seq long, n_docs long, n_ids long, first_id long, last_id long, doc_ids binary, doc_nulls binary, lengths binary, codes binary"


def write_token_codes(docs: DataFrame, path: str, tokenizer: str, kind: str = tokenizing.BYTE_LEVEL, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", segment_ids: int = 1 << 18) -> None:
    """Encodes every text, appends ``end_id`` and writes segments to ``path``.

    Rows are dealt into ranges of the document id and sorted there (repeated
    ids by text; null ids come first), so segments in order of (part, seq) hold
    the documents in ascending order.  Null and empty texts are the end id
    alone.  A segment closes at ``segment_ids`` ids; a longer document ends its
    segment.  The files are not compressed, so that a code's bytes lie in them
    as they are addressed; ``first_id`` and ``last_id`` (of the ids that are not
    null) let a reader skip segments.  Columns besides the id and the text are
    not read; an empty table gives a path without segments.
    """

    def encode(batches):
        encoder = tokenizing.unit_encoder(tokenizer, kind)
        part, seq = TaskContext.get().partitionId(), 0
        held, ids, size = [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def segment():
            nonlocal seq, held, ids, size
            lengths = np.array([len(x) // 4 for x in ids], "<u4")
            row = {
                "part": part, "seq": seq, "n_docs": len(held), "n_ids": int(lengths.sum()),
                "first_id": min((x for x in held if x is not None), default=None), "last_id": max((x for x in held if x is not None), default=None),
                "doc_ids": np.array([0 if x is None else x for x in held], "<i8").tobytes(),
                "doc_nulls": np.packbits([x is None for x in held]).tobytes(),
                "lengths": lengths.tobytes(), "codes": pack_codes(np.frombuffer(b"".join(ids), "<u4")),
            }
            seq, held, ids, size = seq + 1, [], [], 0
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=schema)

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                held.append(doc)
                ids.append(found + end)
                size += len(ids[-1]) // 4
                if size >= segment_ids:
                    yield segment()
        if held:
            yield segment()

    schema = pa.schema([(n, pa.int64()) for n in ("part", "seq", "n_docs", "n_ids", "first_id", "last_id")] + [(n, pa.binary()) for n in ("doc_ids", "doc_nulls", "lengths", "codes")])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, _SEGMENT).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def token_at(spark: SparkSession, path: str, doc_id: int, i: int) -> int | None:
    """Id ``i`` of a document (of repeated ids the first one); None if there is none.

    Only segments whose range of ids holds ``doc_id`` are read, one at a time;
    in its segment the id is found through ranks alone.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for row in segments.orderBy("part", "seq").select("n_docs", "doc_ids", "doc_nulls", "lengths", "codes").toLocalIterator():
        nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[: row["n_docs"]].astype(bool)
        place = np.flatnonzero((np.frombuffer(row["doc_ids"], "<i8") == doc_id) & ~nulls)
        if len(place):
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            return Codes(row["codes"])[int(lengths[: place[0]].sum()) + i] if 0 <= i < lengths[place[0]] else None
    return None


def read_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in ``path``.

    start counts the ids of all documents before; the sums run over one row
    for each part, then within a part.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    sums = segments.select("part", "seq", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = sums.join(parts, "part").select("part", "seq", (F.col("before") + F.col("part_start")).alias("seg_start"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                n = row["n_docs"]
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[:n].astype(bool)
                ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))
                first, group = 0, max(1, int(n * (1 << 20) / max(1, row["n_ids"])))
                for a in range(0, n, group):
                    b = min(n, a + group)
                    cut = codes.slice(first, int(ends[b - 1]))
                    lengths = np.diff(ends[a:b], prepend=first)
                    begins = ends[a:b] - lengths
                    ids = [cut[x - first : x - first + m].tobytes() for x, m in zip(begins, lengths)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:b], pa.int64(), mask=nulls[a:b]), pa.array([row["part"]] * (b - a), pa.int64()), pa.array([row["seq"]] * (b - a), pa.int64()), pa.array(begins), pa.array(lengths), pa.array(ids, pa.binary())],
                        names=["doc_id", "part", "seq", "begin", "n_tokens", "ids"],
                    )
                    first = int(ends[b - 1])

    found = segments.select("part", "seq", "n_docs", "n_ids", "doc_ids", "doc_nulls", "lengths", "codes").mapInArrow(decode, "doc_id long, part long, seq long, begin long, n_tokens long, ids binary")
    found = found.select("doc_id", "part", "seq", "begin", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("seg_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32, read back from the files."""
    scratch = Scratch(spark, "token-codes")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_codes(docs, scratch.path("codes"), tokenizing.tokenizer_path("byte_bpe_50k.json"))
    return read_token_codes(spark, scratch.path("codes")).select("doc_id", "start", "n_tokens", "ids_crc32")
