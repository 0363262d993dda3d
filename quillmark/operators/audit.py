"""Integrity audits of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T


def orphans(papers: DataFrame, paragraphs: DataFrame, units: DataFrame) -> DataFrame:
    """(metric, n): rows of one table without their counterpart in another."""
    count = lambda l, r, name: l.join(r.select("date_id").distinct(), "date_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [
        count(papers, paragraphs, "documents_without_paragraphs"), count(papers, units, "documents_without_units"),
        count(paragraphs, papers, "paragraphs_without_document"), count(units, papers, "units_without_document"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def gaps(paragraphs: DataFrame) -> DataFrame:
    """Documents whose paragraph numbers have holes, largest first."""
    g = paragraphs.groupBy("date_id").agg(F.min("paragraph_no").alias("min_no"), F.max("paragraph_no").alias("max_no"), F.count_distinct("paragraph_no").alias("numbers"))
    g = g.where("numbers <> max_no - min_no + 1")
    return g.withColumn("missing", F.col("max_no") - F.col("min_no") + 1 - F.col("numbers"))


def missing_numbers(paragraphs: DataFrame) -> DataFrame:
    """(date_id, missing): each number of [min, max] without a paragraph."""
    g = paragraphs.groupBy("date_id").agg(F.collect_set("paragraph_no").alias("nos"))
    return g.select("date_id", F.explode(F.array_except(F.sequence(F.array_min("nos"), F.array_max("nos")), "nos")).alias("missing"))


def runs(paragraphs: DataFrame) -> DataFrame:
    """Islands of consecutive numbers: (date_id, first, last, length)."""
    w = Window.partitionBy("date_id").orderBy("paragraph_no")
    rows = paragraphs.select("date_id", "paragraph_no").distinct().withColumn("island", F.col("paragraph_no") - F.row_number().over(w))
    return rows.groupBy("date_id", "island").agg(F.min("paragraph_no").alias("first"), F.max("paragraph_no").alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def best_run(paragraphs: DataFrame) -> DataFrame:
    """The longest run of each document; of equal ones the first."""
    w = Window.partitionBy("date_id").orderBy(F.desc("length"), "first")
    return runs(paragraphs).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def longest_paragraph(paragraphs: DataFrame) -> DataFrame:
    rows = paragraphs.withColumn("words", T.word_count(F.col("text")))
    return rows.orderBy(F.desc("words"), "date_id", "paragraph_no").limit(1).select("date_id", "paragraph_no", "words")


def tail_flags(units: DataFrame) -> DataFrame:
    return units.withColumn("is_tail", F.col("chunk_index") == F.max("chunk_index").over(Window.partitionBy("date_id")))


def word_stats(units: DataFrame, least: int = 260, most: int = 380) -> DataFrame:
    """Extremes and mean of word counts, and how many break the limits."""
    w = tail_flags(units).withColumn("words", T.word_count(F.col("text")))
    return w.agg(
        F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.round(F.avg("words"), 6).alias("avg_words"), F.count_if(F.col("words") > most).alias("over_max"),
        F.count_if((F.col("words") < least) & ~F.col("is_tail")).alias("under_min"), F.count_if((F.col("words") < least) & F.col("is_tail")).alias("tail_under_min"),
    )


def suffix_stats(chunks: DataFrame) -> DataFrame:
    """Start and end references with a letter, and the highest letters."""
    refs = chunks.select(F.explode(F.array("ref_start", "ref_end")).alias("ref")).withColumn("suffix", F.regexp_extract("ref", "^[0-9]+([a-z]*)$", 1))
    return refs.agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("suffix") != "").alias("lettered"), F.max(F.struct(F.length("suffix").alias("n"), "suffix"))["suffix"].alias("highest"))
