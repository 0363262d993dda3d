"""Byte-level BPE by the tiktoken library: encoding whole texts, decoding ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import tokenizing

#: Texts beyond this many characters are cut at safe places and encoded part by part.
LONG_TEXT = 1 << 16


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids of every whole text.

    A null text is an empty one and has no ids.  One pass, no shuffle; rows
    keep their ids as they are, repeated or null.
    """

    def run(batches):
        encoding = tokenizing.rank_encoding(ranks, pattern)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts = tokenizing.safe_parts(text or "", long_text)
                out.append(b"".join(np.asarray(encoding.encode_ordinary(p), "<u4").tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes that the ids stand for."""

    def run(batches):
        encoding = tokenizing.rank_encoding(ranks, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            out = [encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    ranks, pattern = tokenizing.tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizing.split_pattern()
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern)
    both = decode_ids(encoded, ranks, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
