"""Sources and sinks: JSON lines, text, HTML pages, id maps, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_postings(postings: DataFrame, path: str, buckets: int = 16) -> None:
    """Postings by a hash of the term, so that a query's terms prune folders."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 16) -> DataFrame:
    """Only the folders of these terms are listed and read."""
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
    return spark.read.parquet(path).where(F.col("bucket").isin([r["b"] for r in rows])).where(F.col("term").isin(terms))


def links(html: Column) -> Column:
    """Targets of all href attributes, in order."""
    return F.regexp_extract_all(html, F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
