"""The document store over the driver's tables: documents, paragraphs, units, vectors.

The ids that documents get repeat after 38,304 of them; later rounds are numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.sources.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_starts(sizes: DataFrame, bucket, key: str = "date_id", size: str = "n", name: str = "start", sized: bool = False) -> DataFrame:
    """(key, start, with ``sized`` the size too): how many rows stand before each document in the order of ``key``.

    ``bucket`` is a prefix of the order.  Documents are summed up within their
    bucket in parallel; only one row for each bucket meets in a single window.
    """
    sizes = sizes.select(key, size, bucket.alias("__b"))
    totals = sizes.groupBy("__b").agg(F.sum(size).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    within = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__w", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return sizes.join(starts, "__b").select(key, *[size] * sized, (F.col("__s") + F.col("__w")).alias(name))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, date_id, title, source, language, text."""
    d = table(spark, sf_dir, "documents")
    two = lambda c: F.lpad(F.expr(c).cast("string"), 2, "0")
    date_id = F.concat(F.expr("cast(47 + doc_id % 19 as string)"), F.lit("-"), two("1 + (doc_id div 19) % 12"), two("1 + (doc_id div 228) % 28"), F.expr("substr('SMABEX', cast(1 + (doc_id div 6384) % 6 as int), 1)"), F.expr("if(doc_id >= 38304, concat('.', cast(doc_id div 38304 as string)), '')"))
    title = F.substring(F.split("text", "\n")[0], 1, 60)
    return d.select("doc_id", date_id.alias("date_id"), title.alias("title"), "source", F.coalesce("lang", F.lit("en")).alias("language"), "text")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date_id, paragraph_no from 1, sub_id, text: a row for each line."""
    rows = papers(spark, sf_dir).select("date_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select("date_id", (F.col("pos") + 1).alias("paragraph_no"), F.lit("").alias("sub_id"), "text")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line units: date_id, chunk_index, chunk_id, text, ord."""
    p = papers(spark, sf_dir)
    starts = document_starts(p.select("date_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n")), F.substring("date_id", 1, 5))
    rows = paragraphs(spark, sf_dir).select("date_id", (F.col("paragraph_no") - 1).alias("chunk_index"), "text").join(starts, "date_id")
    return rows.select("date_id", "chunk_index", "text", F.concat("date_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), (F.col("start") + F.col("chunk_index")).alias("ord"))


def unnumbered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line units without their numbers, so without a shuffle: date_id, chunk_index, chunk_id, text."""
    rows = paragraphs(spark, sf_dir).select("date_id", (F.col("paragraph_no") - 1).alias("chunk_index"), "text")
    return rows.select("date_id", "chunk_index", F.concat("date_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")


def unit_starts(spark: SparkSession, sf_dir: str, work: Workspace) -> DataFrame:
    """(date_id, n, start): each document's units and how many stand before them, written to ``work``."""
    sizes = papers(spark, sf_dir).select("date_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"))
    sizes = work.write(sizes, "sizes")
    return work.write(document_starts(sizes, F.substring("date_id", 1, 5), sized=True), "starts")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
