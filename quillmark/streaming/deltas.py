"""Ordered deltas of streamed calls, call budgets, and an index fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators import lexical


def fold_deltas(rows: DataFrame) -> DataFrame:
    """(request, index) -> last id and name, arguments appended in order of seq."""
    parts = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("args"), F.lit("")) != "", F.struct("seq", "args"))))
    g = rows.groupBy("request", "index").agg(
        F.max_by("id", F.when(F.col("id") != "", F.col("seq"))).alias("id"), F.max_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("name"), parts.alias("parts")
    )
    return g.select("request", "index", "id", "name", F.array_join(F.transform("parts", lambda p: p["args"]), "").alias("args"))


def call_budget(calls: DataFrame, most: int, per_name: dict[str, int]) -> DataFrame:
    """Marks calls beyond a request's total or a name's own limit."""
    n = F.row_number().over(Window.partitionBy("request").orderBy("seq"))
    own = F.row_number().over(Window.partitionBy("request", "name").orderBy("seq"))
    limit = F.coalesce(*[F.when(F.col("name") == k, v) for k, v in per_name.items()], F.lit(most))
    out = calls.withColumn("n", n).withColumn("n_own", own)
    return out.withColumn("allowed", (F.col("n") <= most) & (F.col("n_own") <= limit))


def history_window(turns: DataFrame, last: int = 6) -> DataFrame:
    """The last turns of each conversation, numbered from 1."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.withColumn("back", back).where(F.col("back") <= last)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def index_stream(documents: DataFrame, target: str, checkpoint: str):
    """Appends each micro-batch's postings to ``target``, a folder for each batch,
    which a repeated batch overwrites; returns the started query."""

    def write(batch: DataFrame, number: int) -> None:
        lexical.term_counts(batch, "doc_id").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
