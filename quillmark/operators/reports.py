"""Reports over tables, runs and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import audit


def table_counts(tables: dict[str, DataFrame], key: str = "date_id") -> DataFrame:
    """(metric, n): rows of each table and distinct documents in it."""
    parts = []
    for name, rows in tables.items():
        both = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("documents"))
        parts.append(both.select(F.explode(F.array(F.struct(F.lit(f"{name}_rows").alias("metric"), F.col("rows").alias("n")), F.struct(F.lit(f"{name}_documents").alias("metric"), F.col("documents").alias("n")))).alias("m")).select("m.*"))
    return reduce(DataFrame.unionByName, parts)


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def has_column(rows: DataFrame, name: str) -> bool:
    return name in rows.columns


def missing_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): nulls and empty texts of each column, in one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("m")).select("m.*")


def throughput(rows: DataFrame, seconds: str, by: str) -> DataFrame:
    """Rows for each second of work, by a column."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(seconds).alias("seconds"))
    return g.withColumn("rows_per_second", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))


def extremes(rows: DataFrame, by: str, values: list[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """Least, largest and mean of each value, and the rate of each check, by a column."""
    own = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    rates = [F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"{n}_rate") for n, c in (checks or {}).items()]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *own, *rates)


def language_report(decisions: DataFrame, signals: DataFrame) -> DataFrame:
    """(lang, queries, refused, mean signals)."""
    rows = decisions.join(signals.select("query_id", "dense_std", "dense_top", "overlap", "bm25_top"), "query_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("queries"), F.count_if("should_refuse").alias("refused"), *[F.avg(c).alias(f"mean_{c}") for c in ("dense_std", "dense_top", "overlap", "bm25_top")])


def call_counts(calls: DataFrame) -> DataFrame:
    """(request, iteration, offered, requested): tools offered and asked for in each round of a request."""
    return calls.groupBy("request", "iteration").agg(F.count_if(F.col("kind") == "offered").alias("offered"), F.count_if(F.col("kind") == "requested").alias("requested"))


def rule_audit(cases: DataFrame, rules: dict[str, Column], key: str = "case_id") -> DataFrame:
    """(key, issues, passed): the names of the rules that a case breaks."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return cases.select(key, names.alias("issues")).withColumn("passed", F.size("issues") == 0)


def latest_run(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """The cases of the last folder below ``path``, with their files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file")).withColumn("run", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    last = rows.agg(F.max("run")).first()[0]
    return rows.where(F.col("run") == last)


def store_report(papers: DataFrame, paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(metric, value): counts, orphans, holes, the longest paragraph and the limits of chunks, as text."""
    text = lambda rows, metric, value: rows.select(metric, F.col(value).cast("string").alias("value"))
    wide = lambda rows, prefix: rows.select(F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("string").alias("value")) for c in rows.columns])).alias("m")).select("m.*")
    gaps = audit.gaps(paragraphs).agg(F.count(F.lit(1)).alias("documents_with_holes"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_paragraphs"))
    parts = [
        text(table_counts({"documents": papers, "paragraphs": paragraphs, "chunks": chunks}), "metric", "n"), text(audit.orphans(papers, paragraphs, chunks), "metric", "n"),
        wide(gaps, ""), wide(audit.longest_paragraph(paragraphs), "longest_paragraph_"), wide(audit.word_stats(chunks), "chunk_words_"),
    ]
    return reduce(DataFrame.unionByName, parts)
