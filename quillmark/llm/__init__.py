"""Operators of a training-data pipeline: tokenizing, packing, near-duplicate
detection, quality, toxicity, licence and URL rules over whole tables.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; what has to be materialised in between is written as
Parquet below ``spark.checkpoint.dir`` (see :mod:`quillmark.llm.common`).
"""
