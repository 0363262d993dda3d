"""Rendering of retrieved units and of message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraph_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("¶"), start.cast("string"))).otherwise(F.concat(F.lit("¶"), start.cast("string"), F.lit("-"), end.cast("string")))


def render_groups(expanded: DataFrame, papers: DataFrame, only_retrieved: bool = False) -> DataFrame:
    """(query_id, date_id, block): a header and the units in document order.

    With ``only_retrieved`` neighbours are left out, unless that leaves nothing.
    """
    mark = F.when(F.col("is_retrieved"), F.lit(" *")).otherwise(F.lit(""))
    line = F.concat(paragraph_range(F.col("chunk_index") + 1, F.col("chunk_index") + 1), mark, F.lit(" "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "is_retrieved", line.alias("line"))))
    g = expanded.groupBy("query_id", "date_id").agg(rows.alias("rows"))
    if only_retrieved:
        kept = F.filter("rows", lambda r: r["is_retrieved"])
        g = g.withColumn("rows", F.when(F.size(kept) > 0, kept).otherwise(F.col("rows")))
    g = g.join(papers.select("date_id", "title"), "date_id", "left")
    header = F.concat(F.lit("### "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown")), F.lit(" ("), "date_id", F.lit(")\n"))
    return g.select("query_id", "date_id", F.concat(header, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("block"))


def messages(system: str, history: Column, query: Column) -> Column:
    """System text, the history's turns, then the question."""
    role = lambda r, t: F.struct(r.alias("role"), t.alias("content"))
    return F.concat(F.array(role(F.lit("system"), F.lit(system))), F.transform(history, lambda h: role(h["role"], h["text"])), F.array(role(F.lit("user"), query)))
