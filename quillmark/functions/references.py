"""Paragraph references, years, addresses and attributes of documents, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference(number: Column, sub_id: Column) -> Column:
    """``12`` and ``a`` as ``12a``."""
    return F.concat(number.cast("string"), F.coalesce(sub_id, F.lit("")))


def parse_reference(ref: Column) -> Column:
    """struct(number, suffix) of ``12ab``; null for any other form."""
    number, suffix = F.regexp_extract(ref, r"^(\d+)([a-z]*)$", 1), F.regexp_extract(ref, r"^(\d+)([a-z]*)$", 2)
    return F.when(number != "", F.struct(number.cast("int").alias("number"), suffix.alias("suffix")))


def suffix_rank(suffix: Column) -> Column:
    """a, b, ... z, aa as 1, 2, ... 26, 27; the empty suffix is 0, other characters give null."""
    letters = F.filter(F.split(suffix, ""), lambda c: c != "")
    rank = F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 96)
    return F.when(suffix.rlike("^[a-z]*$"), rank)


def full_year(two_digits: Column) -> Column:
    return F.when(two_digits.rlike("^[0-9]{2}$"), F.concat(F.lit("19"), two_digits))


def file_path(root: str, date_id: Column, extension: str = "pdf") -> Column:
    """``root/19YY/id.extension``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), full_year(F.substring(date_id, 1, 2)), F.lit("/"), date_id, F.lit("." + extension))


def page_address(base: str, date_id: Column) -> Column:
    return F.concat(F.lit(base), date_id)


def slug(text: Column, longest: int = 60) -> Column:
    """Letters and digits in lower case, dashes between."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, longest)


def required_attribute(rows: DataFrame, documents: DataFrame, column: str, key: str = "date_id") -> DataFrame:
    """Rows with a document's attribute; a row without its document is an error when it is read."""
    own = documents.select(key, F.struct(F.col(column).alias("value")).alias("__own"))
    missing = F.raise_error(F.concat(F.lit("no document "), F.coalesce(F.col(key), F.lit("null"))))
    return rows.join(own, key, "left").withColumn(column, F.when(F.col("__own").isNull(), missing.cast("string")).otherwise(F.col("__own.value"))).drop("__own")


def with_attribute(rows: DataFrame, documents: DataFrame, column: str, key: str = "date_id", default: str | None = None) -> DataFrame:
    """Rows with a document's attribute, or the default."""
    own = documents.select(key, F.col(column).alias("__own"))
    return rows.join(own, key, "left").withColumn(column, F.coalesce("__own", F.lit(default))).drop("__own")


def to_json(column: Column) -> Column:
    return F.to_json(column)


def without_code_fence(text: Column) -> Column:
    """A text that begins with a fence, without the fence's lines."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).startswith("```"))
    return F.when(text.startswith("```"), F.trim(F.array_join(lines, "\n"))).otherwise(text)


def tolerant_json(text: Column, schema: str) -> Column:
    """The object that a text holds; of a text that holds none, one of nulls."""
    fields = F.from_json(F.coalesce(F.trim(without_code_fence(F.trim(text))), F.lit("{}")), schema, {"mode": "PERMISSIVE"})
    return F.coalesce(fields, F.from_json(F.lit("{}"), schema))


def external_sources(calls: DataFrame, name: str, disclaimer: str) -> DataFrame:
    """(request, disclaimer, sources) of each request's first call of an external search.

    ``calls``: request, seq, name, sources (structs with url); sources without
    an address are left out.
    """
    first = calls.where(F.col("name") == name).groupBy("request").agg(F.min_by("sources", "seq").alias("sources"))
    kept = F.filter(F.coalesce("sources", F.array()), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return first.select("request", F.lit(disclaimer).alias("disclaimer"), kept.alias("sources"))
