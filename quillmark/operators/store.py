"""Reads and searches over the paragraph store; batched where requests come in batches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T

#: So many bits at most go to every task of ``near_keys``.
BITS = 1 << 28


def clamp(n: int, most: int) -> int:
    return max(1, min(n, most))


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def batch_lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; keys without a row are left out."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def near_keys(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` are in ``wanted``, and a few others: a join has to follow.

    A table of bits, set at the wanted keys' hashes, goes to every task, so that
    a join of many rows with a few keys shuffles the rows it meets and not all.
    More keys than the bits hold let more rows through and lose none.
    """
    key = F.xxhash64(*[F.col(k).cast("string") for k in keys]).alias("h")  # as strings: an int and a long have other hashes
    hashes = wanted.select(key).distinct().toArrow().column("h").to_numpy()
    size = min(BITS, 1 << (16 * len(hashes) | 1 << 10).bit_length())
    bits, at = np.zeros(size // 8, np.uint8), hashes & (size - 1)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    @F.pandas_udf("boolean")
    def near(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (size - 1)
        return pd.Series(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return rows.where(near(key))


def paragraph_order(*before: str) -> list[Column]:
    """Paragraphs in reading order: a plain one before its lettered parts."""
    return [*map(F.col, before), F.col("paragraph_no"), F.when(F.col("sub_id") == "", 0).otherwise(1), F.col("sub_id")]


def units_at(rows: DataFrame, number: str, starts: DataFrame, width: int = 100) -> DataFrame:
    """``rows`` with date_id and chunk_index of the unit whose number is in ``number``; a row whose number no unit has goes.

    ``starts`` (date_id, n, start): documents and numbers meet by equality on
    the blocks of ``width`` numbers, not by a range join.
    """
    block = lambda c: F.floor(c / width)
    first, last = F.col("start"), F.col("start") + F.col("n") - 1
    spans = starts.where("n > 0").select("date_id", "start", last.alias("__last"), F.explode(F.sequence(block(first), block(last))).alias("__block"))
    found = rows.withColumn("__block", block(F.col(number))).join(spans, "__block").where(F.col(number).between(F.col("start"), F.col("__last")))
    return found.withColumn("chunk_index", (F.col(number) - F.col("start")).cast("int")).drop("__block", "__last", "start")


def range_read(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """Paragraphs of (request_id, date_id, a, b); reversed bounds are swapped."""
    r = requests.select("request_id", "date_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return paragraphs.join(r, "date_id").where(F.col("paragraph_no").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def like_search(rows: DataFrame, user_text: str, limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Case-insensitive containment; % and _ of the user act as wildcards."""
    if ids is not None:
        rows = rows.join(ids.select("date_id").distinct(), "date_id", "left_semi")
    found = rows.where(F.col("text").ilike(T.like_pattern(user_text)))
    return found if limit is None else found.orderBy(*paragraph_order("date_id")).limit(limit)


def all_tokens_search(rows: DataFrame, words: list[str], limit: int = 40) -> DataFrame:
    if not words:
        return rows.limit(0)
    every = reduce(lambda a, b: a & b, [F.col("text").ilike(T.like_pattern(w)) for w in words])
    return rows.where(every).orderBy(*paragraph_order("date_id")).limit(clamp(limit, 500))


def token_match_counts(rows: DataFrame, words: list[str]) -> DataFrame:
    """How many of the words each row holds, rows without one left out."""
    n = reduce(lambda a, b: a + b, [F.col("text").ilike(T.like_pattern(w)).cast("int") for w in words])
    return rows.withColumn("matches", n).where("matches > 0")


def rarest_tokens(rows: DataFrame, words: list[str], keep: int = 3) -> DataFrame:
    """(word, n): fewest rows first, then longer, then by text; one pass for all words."""
    counts = rows.agg(*[F.count_if(F.col("text").ilike(T.like_pattern(w))).alias(f"w{i}") for i, w in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)])
    return counts.select(F.explode(pairs).alias("p")).select("p.word", "p.n").orderBy("n", F.length("word").desc(), "word").limit(keep)


def title_search(papers: DataFrame, query: str, year: str | None = None, limit: int = 10) -> DataFrame:
    words = [w for w in query.split() if w]
    found = papers.where(F.col("title").ilike("%" + "%".join(words) + "%"))
    if year:
        found = found.where(F.col("date_id").startswith(year[-2:]))
    return found.orderBy("date_id").limit(clamp(limit, 50))


def prefix_search(papers: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return papers.where(F.col("date_id").startswith(prefix.upper())).orderBy("date_id").limit(clamp(limit, 50))


def bounds(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("date_id").agg(F.min("paragraph_no").alias("min_no"), F.max("paragraph_no").alias("max_no"))


def context_window(paragraphs: DataFrame, requests: DataFrame, delta: int = 2) -> DataFrame:
    """(request_id, date_id, lo, hi) around a paragraph, inside the document's bounds."""
    delta = max(0, min(delta, 10))
    r = requests.join(bounds(paragraphs), "date_id")
    return r.select("request_id", "date_id", F.greatest(F.lit(1), F.col("at") - delta, F.col("min_no")).alias("lo"), F.least(F.col("at") + delta, F.col("max_no")).alias("hi"))


def range_info(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """What of each requested range exists, and the parts before and behind."""
    r = requests.select("request_id", "date_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).join(bounds(paragraphs), "date_id")
    inside = (F.col("lo") <= F.col("max_no")) & (F.col("hi") >= F.col("min_no"))
    return r.select(
        "request_id", "date_id", F.when(inside, F.greatest("lo", "min_no")).alias("valid_from"), F.when(inside, F.least("hi", "max_no")).alias("valid_to"),
        F.when(F.col("lo") < F.col("min_no"), F.col("lo")).alias("before_from"), F.when(F.col("lo") < F.col("min_no"), F.least(F.col("hi"), F.col("min_no") - 1)).alias("before_to"),
        F.when(F.col("hi") > F.col("max_no"), F.greatest(F.col("lo"), F.col("max_no") + 1)).alias("after_from"), F.when(F.col("hi") > F.col("max_no"), F.col("hi")).alias("after_to"), F.col("max_no").alias("last_no"),
    )


def _by_prefix(requests: DataFrame, documents: DataFrame, prefix: str, longest: int = 16) -> DataFrame:
    """Requests with the documents whose id begins so: an equality of prefixes,
    of which a document has one for each length; longer ones cannot fit an id."""
    own = documents.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("date_id"), F.lit(longest))), lambda n: F.substring("date_id", F.lit(1), n))))
    return own.join(requests.where(F.length(prefix).between(1, longest)), F.col("__p") == F.col(prefix)).drop("__p")


def head_split(paragraphs: DataFrame, prefixes: DataFrame, head: int) -> DataFrame:
    """A head of paragraphs for each prefix, split evenly over the documents it names."""
    docs = _by_prefix(prefixes.select("request_id", "prefix"), paragraphs.select("date_id").distinct(), "prefix")
    share = Window.partitionBy("request_id")
    docs = docs.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(head) / F.count(F.lit(1)).over(share))))
    order = Window.partitionBy("request_id", "date_id").orderBy(*paragraph_order())
    return paragraphs.join(docs, "date_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("quota")).select("request_id", "date_id", "paragraph_no", "sub_id", "text")


def running_cap(rows: DataFrame, partition: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each request over all its groups."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def overlapping(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks whose paragraph range overlaps a requested one, by numbers."""
    c, r = chunks.alias("c"), requests.alias("r")
    return c.join(r, (F.col("c.date_id") == F.col("r.date_id")) & (F.col("c.paragraph_end") >= F.col("r.a")) & (F.col("c.paragraph_start") <= F.col("r.b"))).select("r.request_id", "c.*")


def resolve(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, date_id): exact id, else ids with that prefix, else title; the first that finds anything."""
    r, p = requests.select("request_id", "ask"), papers.select("date_id", "title")
    exact = r.join(p, F.upper("ask") == F.col("date_id")).select("request_id", "date_id", F.lit(1).alias("priority"))
    prefix = _by_prefix(r.select("request_id", F.upper("ask").alias("ask")), p, "ask").select("request_id", "date_id", F.lit(2).alias("priority"))
    title = r.join(p, F.contains(F.lower("title"), F.lower("ask"))).select("request_id", "date_id", F.lit(3).alias("priority"))
    every = exact.unionByName(prefix).unionByName(title)
    first = Window.partitionBy("request_id").orderBy("priority")
    return every.withColumn("r", F.rank().over(first)).where("r = 1").select("request_id", "date_id", "priority").distinct()


def merge_sub_rows(paragraphs: DataFrame) -> DataFrame:
    """One text for each paragraph: its parts in order, blanks skipped, single spaces between."""
    parts = F.array_sort(F.collect_list(F.struct("sub_id", F.trim("text").alias("t"))))
    rows = paragraphs.where(F.trim("text") != "").groupBy("date_id", "paragraph_no").agg(parts.alias("parts"))
    return rows.select("date_id", "paragraph_no", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))
