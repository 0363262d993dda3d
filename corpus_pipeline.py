"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch
from quillmark.llm.line_dedup import dedup_lines
from quillmark.llm.ngram_join import ngram_components
from quillmark.llm.packing import packed_digest
from quillmark.llm.quality_rules import fit_quality, keep_good
from quillmark.llm.toxicity import fit_toxicity, keep_harmless

#: The name of the row key that the stage of near copies adds and takes away.
ROW = "__row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_harmless(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or whose posterior quality is low."""
    return keep_good(docs, fit_quality(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated blocks of lines out of later documents; a document of
    which nothing is left goes, n_chars follows the text."""
    done = dedup_lines(docs)
    left = done.where(~((F.col("lines_deleted") > 0) & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest id
    (null ids last), of equal ids that with the smallest row key.

    Rows are told apart by where they lie in their files, so rows that share an
    id or have none are documents of their own, and of equal rows one stays.
    Rows without words stay.
    """
    scratch = Scratch(spark, "near-copies")
    place = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("_metadata.file_path")), 16, "0"), F.lpad(F.hex(F.col("_metadata.row_index")), 16, "0")))
    try:
        keyed = docs.select("*", place.alias(ROW))
    except AnalysisException:  # not read from files
        keyed = scratch.write(docs, "rows").select("*", place.alias(ROW))
    found = ngram_components(keyed, size=5, threshold=80, row_column=ROW)
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), F.col("doc_id"), F.col(ROW))).alias("first"))
    stay = first.select(F.col(f"first.{ROW}").alias(ROW)).unionByName(found.where("component IS NULL").select(ROW))
    return keyed.join(stay.hint("merge"), ROW, "left_semi").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return packed_digest(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("line dedup", lines), ("n-gram join", near_copies), ("packing", packing)]
#: Learned verdicts and tokenizers: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
