"""Packing documents into training sequences by estimated attention cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import tokenizing

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CostBalancer:
    """Fills ``count`` sequences of ``capacity`` tokens exactly.

    A piece of n tokens costs ``linear * n + quadratic * n * n``.  Pieces come
    in descending length; each goes to the cheapest sequence with room for it.
    A piece for which none has room is cut over the cheapest sequences that
    have some left, which makes every sequence full.
    """

    def __init__(self, count: int, capacity: int, linear: float, quadratic: float):
        self.room = np.full(count, capacity, np.int64)
        self.cost = np.zeros(count)
        self.linear, self.quadratic = linear, quadratic
        self.placed: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def _put(self, bin_: int, item: int, first: int, n: int) -> None:
        self.placed[bin_].append((item, first, n))
        self.room[bin_] -= n
        self.cost[bin_] += self.linear * n + self.quadratic * n * n

    def fill(self, items: list[tuple[int, int, int]]) -> None:
        """items: (document, first token, length), their lengths summing up to the room."""
        late = []
        for item, first, n in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
            best = int(np.argmin(np.where(self.room >= n, self.cost, np.inf)))
            if self.room[best] >= n:
                self._put(best, item, first, n)
            else:
                late.append((item, first, n))
        for item, first, n in late:
            while n:
                best = int(np.argmin(np.where(self.room > 0, self.cost, np.inf)))
                take = int(min(n, self.room[best]))
                self._put(best, item, first, take)
                first, n = first + take, n - take


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048, window: int = 128, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each task packs the documents of its own input split, ``window`` sequences
    at a time, so nothing is shuffled and a task that runs again packs alike.
    Documents of more than ``capacity`` tokens give whole sequences first.
    What is left over from a window joins the next one; a task's last tokens
    fill sequences whose lengths are powers of two, which need no padding.
    Null and empty texts are the end id alone; repeated or null document ids
    are packed row by row.  sequence_id is task number * 2**32 + place.
    """

    def run(batches):
        encoder = tokenizing.unit_encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        state = {"next": TaskContext.get().partitionId() << 32}
        held: list[tuple] = []  # (doc_id, ids, first token not yet packed, tokens)
        size = 0

        def emit(sequences):
            rows = []
            for pieces in sequences:
                offset = 0
                for item, first, n in pieces:
                    doc, ids, _, total = held[item]
                    rows.append((doc, first, n, ids[4 * first : 4 * (first + n)], total, state["next"], offset))
                    offset += n
                state["next"] += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def pack(total: int):
            """Packs the first ``total`` tokens held, a multiple of the capacity."""
            whole, items, left = [], [], total
            for i, (_, _, first, tokens) in enumerate(held):
                n = min(tokens - first, left)
                left -= n
                while n >= capacity:
                    whole.append([(i, first, capacity)])
                    first, n = first + capacity, n - capacity
                if n:
                    items.append((i, first, n))
                if not left:
                    break
            balancer = CostBalancer(total // capacity - len(whole), capacity, linear, quadratic)
            if items:
                balancer.fill(items)
            return emit(whole + balancer.placed)

        def drop(total: int):
            nonlocal held, size
            size -= total
            rest = []
            for doc, ids, first, tokens in held:
                n = min(tokens - first, total)
                total -= n
                if first + n < tokens:
                    rest.append((doc, ids, first + n, tokens))
            held = rest

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                held.append((doc, found + end, 0, len(found) // 4 + 1))
                size += held[-1][3]
                if size >= window * capacity:
                    total = size // capacity * capacity
                    yield pack(total)
                    drop(total)
        if total := size // capacity * capacity:
            yield pack(total)
            drop(total)
        sequences, i, at = [], 0, held[0][2] if held else 0
        for length in powers_of_two(size):
            pieces = []
            while length:
                take = min(length, held[i][3] - at)
                pieces.append((i, at, take))
                length, at = length - take, at + take
                if at == held[i][3]:
                    i += 1
                    at = held[i][2] if i < len(held) else 0
            sequences.append(pieces)
        if sequences:
            yield emit(sequences)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, PIECES)


def packed_digest(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, tokenizing.tokenizer_path("word_bpe_49k.json"), tokenizing.WORD_LEVEL, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
