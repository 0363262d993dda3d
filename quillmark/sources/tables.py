"""Keyed tables in folders: upserts, replacement by document, evolution, copies, index files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows whose key is not among the new ones, and of each new key the last row by
    ``order``; without one, the largest by its other columns' JSON."""
    own = F.col(order) if order else F.to_json(F.struct(*[c for c in new.columns if c not in keys]))
    window = Window.partitionBy(*keys).orderBy(own.desc_nulls_last())
    new = new.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(spark: SparkSession, rows: DataFrame, path: str, key: str = "date_id") -> None:
    """Overwrites only the partitions of the documents that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def evolve(rows: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Rows under ``schema``: missing columns are added with their default or null."""
    defaults = defaults or {}
    cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*[c.alias(f.name) for c, f in zip(cols, schema)])


def subset(tables: dict[str, DataFrame], ids: DataFrame, key: str = "date_id") -> dict[str, DataFrame]:
    """Each table's rows of the given documents."""
    return {name: df.join(ids.select(key).distinct(), key, "left_semi") for name, df in tables.items()}


def changed(rows: DataFrame, column: str, cleaned) -> DataFrame:
    """Rows whose cleaned text differs, with the new one beside the old."""
    return rows.withColumn("new", cleaned).where(~F.col("new").eqNullSafe(F.col(column)))


def backfill_title(rows: DataFrame, papers: DataFrame, column: str = "title") -> DataFrame:
    """Missing or empty titles from the documents' table."""
    own = papers.select("date_id", F.col("title").alias("__t"))
    return rows.join(own, "date_id", "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), "__t")).drop("__t")


def not_yet_fetched(wanted: DataFrame, manifest: DataFrame, key: str = "date_id") -> DataFrame:
    return wanted.join(manifest.select(key), key, "left_anti")


def append_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines with a digest of each row's content."""
    rows.withColumn("sha256", F.sha2("content", 256)).drop("content").write.mode("append").json(path)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, stem, content) of all files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"), "content")


def corpus_text(units: DataFrame, with_metadata: bool = False, limit: int | None = None) -> DataFrame:
    """(chunk_id, text) in the order of documents and units: the metadata text where asked for and present."""
    own = F.coalesce(F.nullif("text_with_metadata", F.lit("")), "text") if with_metadata and "text_with_metadata" in units.columns else F.col("text")
    rows = units.orderBy("date_id", "chunk_index")
    return (rows if limit is None else rows.limit(limit)).select("chunk_id", own.alias("text"))


def save_vectors(vectors: DataFrame, path: str, meta: dict) -> None:
    """Vectors, their id map as JSON lines, and one JSON object of facts."""
    spark = vectors.sparkSession
    vectors.select("vec_id", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    if "chunk_id" in vectors.columns:
        vectors.select("vec_id", "chunk_id").write.mode("overwrite").json(f"{path}/ids")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return spark.read.parquet(f"{path}/vectors"), meta


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, chunk_id) as ``save_vectors`` wrote them."""
    return spark.read.schema("vec_id long, chunk_id string").json(f"{path}/ids")


def export_training(units: DataFrame, papers: DataFrame, path: str, instruction: str = "Continue in the manner of this document.") -> None:
    """Texts for continued training and instructions as JSON lines, documents as CSV, and a manifest with counts."""
    units.select("text").write.mode("overwrite").json(f"{path}/continued_pretrain")
    titled = units.join(papers.select("date_id", "title"), "date_id", "left")
    titled.select(F.lit(instruction).alias("instruction"), F.col("title").alias("input"), F.col("text").alias("output")).write.mode("overwrite").json(f"{path}/instruction_tune")
    counts = units.groupBy("date_id").agg(F.count(F.lit(1)).alias("units"))
    papers.select("date_id", "title", "language").join(counts, "date_id", "left").write.mode("overwrite").option("header", True).csv(f"{path}/documents")
    units.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("date_id").alias("documents")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
