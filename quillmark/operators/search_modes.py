"""The search tool: a dispatcher over reads, quotations and mixed batches.

A call is one small request, so its ladder runs on the driver; each step is a
distributed query whose result is limited before it is looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import store

#: The most paragraphs that one call returns.
MOST = 80
#: Words that do not choose a paragraph.
COMMON = ("the", "and", "for", "with", "that", "this", "from", "into", "your", "you", "are", "was", "were", "have", "has", "had", "his", "her", "she", "him", "they", "them", "not", "but")


@dataclass
class Store:
    """The tables that the modes read; ``semantic`` maps (text, ids or None, limit) to ranked (chunk_id, rank)."""

    papers: DataFrame
    paragraphs: DataFrame
    chunks: DataFrame | None = None
    semantic: object = None


def quoted_phrases(query: str) -> list[str]:
    return re.findall(r'"([^"]{1,80})"', query)


def longest_first(phrases: list[str], keep: int = 3) -> list[str]:
    """The longest phrases, of equal ones by their lowered text."""
    return sorted(phrases, key=lambda p: (-len(p), p.casefold()))[:keep]


def title_candidates(papers: DataFrame, title: str, year: str | None = None, hint: str | None = None, limit: int = 10) -> DataFrame:
    """Documents whose title holds the words in order; of a year, else of ids that begin with a hint."""
    found = store.title_search(papers, title, year, 50) if year else papers.where(F.col("title").ilike("%" + "%".join(title.split()) + "%"))
    if hint and not year:
        found = found.where(F.col("date_id").startswith(hint))
    return found.orderBy("date_id").limit(store.clamp(limit, 50))


def pick_title(papers: DataFrame, title: str, year: str | None = None, hint: str | None = None) -> str | None:
    """One document: the only candidate, else the only one of exactly this title, else the latest."""
    found = title_candidates(papers, title, year, hint).select("date_id", "title").collect()
    same = [r["date_id"] for r in found if (r["title"] or "").casefold().strip() == title.casefold().strip()]
    if len(found) > 1 and len(same) == 1:
        return same[0]
    return max((r["date_id"] for r in found), default=None)


def resolve_documents(papers: DataFrame, date_id: str = "", title: str = "", year: str | None = None, hint: str | None = None) -> tuple[list[str], str]:
    """(ids, how): the exact id, else up to ten ids that begin so, else by title."""
    if date_id:
        if not papers.where(F.col("date_id") == date_id).isEmpty():
            return [date_id], "date_id"
        found = [r["date_id"] for r in store.prefix_search(papers, date_id, 10).collect()]
        if found:
            return found, "prefix"
    if title:
        picked = pick_title(papers, title, year, hint)
        return ([picked] if picked else []), "title" if not date_id else "title_fallback"
    return [], "none"


def _of(rows: DataFrame, ids: list[str] | None) -> DataFrame:
    return rows if not ids else rows.where(F.col("date_id").isin(ids))


def chunk_search(chunks: DataFrame, text: str, date_id: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks that hold a text, in order."""
    rows = chunks.where(F.col("text").ilike(T.like_pattern(text)))
    rows = rows if date_id is None else rows.where(F.col("date_id") == date_id)
    return rows.orderBy("date_id", "chunk_index").limit(store.clamp(limit, 200))


def covering_paragraphs(hits: DataFrame, chunks: DataFrame, paragraphs: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, rank, date_id, paragraph_no, text): the paragraphs of ranked chunks, ``most`` for each query."""
    c = hits.join(chunks.select("chunk_id", "date_id", "paragraph_start", "paragraph_end"), "chunk_id")
    c = c.select("query_id", "rank", "date_id", F.explode(F.sequence("paragraph_start", "paragraph_end")).alias("paragraph_no"))
    rows = c.join(paragraphs, ["date_id", "paragraph_no"])
    return store.running_cap(rows, ["query_id"], ["rank", *store.paragraph_order()], most).select("query_id", "rank", "date_id", "paragraph_no", "sub_id", "text")


def token_search(paragraphs: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Paragraphs with the most of the words; two at least where two are asked."""
    least = min(2, len(words))
    return store.token_match_counts(paragraphs, words).where(F.col("matches") >= least).orderBy(F.desc("matches"), *store.paragraph_order("date_id")).limit(limit)


def grouped(rows: DataFrame, limit: int) -> DataFrame:
    """(date_id, place, first, last, paragraphs): by document as first met, ``limit`` paragraphs of each."""
    order = Window.partitionBy("date_id").orderBy(*store.paragraph_order())
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    one = F.struct("paragraph_no", "sub_id", "text")
    out = kept.groupBy("date_id").agg(F.min("paragraph_no").alias("first"), F.max("paragraph_no").alias("last"), F.array_sort(F.collect_list(one)).alias("paragraphs"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("date_id")))


def search_quote(tables: Store, query: str, ids: list[str] | None = None, limit: int = 10) -> tuple[str, DataFrame]:
    """(step that found something, paragraphs).

    The longest quoted phrases, one after the other; with three or more of them
    the three that stand in the fewest paragraphs together, then as many of
    them as possible; the text as it is; and for long texts the meaning.
    """
    limit = store.clamp(limit, MOST)
    rows, phrases = _of(tables.paragraphs, ids), [p.strip() for p in quoted_phrases(query)]
    for phrase in longest_first([p for p in phrases if len(p) >= 3]):
        found = store.like_search(rows, phrase, 3 * limit)
        if not found.isEmpty():
            return "phrase", found
    if len(phrases) >= 3:
        words = [p for p in phrases if len(p) >= 3 and p.casefold() not in COMMON][:12]
        if words:
            rare = [r["word"] for r in store.rarest_tokens(rows, words, 3).collect()]
            found = store.all_tokens_search(rows, rare, 3 * limit)
            if not found.isEmpty():
                return "all", found
        found = token_search(rows, phrases, 3 * limit)
        if not found.isEmpty():
            return "some", found.drop("matches")
    plain = query.replace('"', "").strip() or query
    found = store.like_search(rows, plain, 3 * limit)
    if not found.isEmpty() or len(query) < 40 or tables.semantic is None:
        return "literal", found
    hits = tables.semantic(query, ids, limit).withColumn("query_id", F.lit(0))
    return "semantic", covering_paragraphs(hits, tables.chunks, tables.paragraphs).select("date_id", "paragraph_no", "sub_id", "text")


#: The arguments of each mode: name, type, whether it has to be there.
MODES = {
    "search_quote": (("query", str, True), ("date_id", str, False), ("title", str, False), ("limit", int, False)),
    "read_paragraph": (("date_id", str, True), ("paragraph_no", int, True), ("context", int, False)),
    "read_range": (("date_id", str, True), ("start", int, True), ("end", int, True)),
    "read_head": (("date_id", str, True), ("limit", int, False)),
    "search_titles": (("title", str, True), ("year", str, False), ("limit", int, False)),
    "batch_read": (("requests", list, True),),
    "batch_mixed": (("ops", list, True),),
}


def check_arguments(mode: str, arguments: dict) -> str | None:
    """What is wrong with a call; null if nothing."""
    if mode not in MODES:
        return f"unknown mode {mode}"
    for name, kind, required in MODES[mode]:
        value = arguments.get(name)
        if value in (None, "", []):
            if required:
                return f"{name} is required"
        elif not isinstance(value, kind):
            return f"{name} has to be {kind.__name__}"
    return None


def db_search(tables: Store, mode: str, **arguments) -> dict:
    """{ok, mode, rows} or {ok, mode, error}; rows is a DataFrame, for ``batch_mixed`` a list of results.

    Documents may be named in full, by the begin of their id, or by title.
    """
    error = check_arguments(mode, arguments)
    if error:
        return {"ok": False, "mode": mode, "error": error}
    done = lambda rows, **more: {"ok": True, "mode": mode, "rows": rows, **more}
    if mode == "batch_mixed":
        return done([{"ok": False, "mode": op.get("mode"), "error": "a batch within a batch"} if op.get("mode") == "batch_mixed" else db_search(tables, **op) for op in arguments["ops"]])
    if mode == "search_titles":
        return done(title_candidates(tables.papers, arguments["title"], arguments.get("year"), None, arguments.get("limit", 10)).select("date_id", "title"))
    if mode == "batch_read":
        parts = [db_search(tables, "read_range", **r) for r in arguments["requests"]]
        rows = [p["rows"].withColumn("request", F.lit(i)) for i, p in enumerate(parts) if p["ok"]]
        if not rows:
            return {"ok": False, "mode": mode, "error": "no request names a document"}
        return done(reduce(DataFrame.unionByName, rows).orderBy("request", *store.paragraph_order("date_id")).limit(MOST))
    ids, how = resolve_documents(tables.papers, arguments.get("date_id", ""), arguments.get("title", ""), arguments.get("year"))
    if not ids and (mode != "search_quote" or arguments.get("date_id") or arguments.get("title")):
        return {"ok": False, "mode": mode, "error": "no such document"}
    if mode == "search_quote":
        step, rows = search_quote(tables, arguments["query"], ids, arguments.get("limit", 10))
        return done(rows, match=step, resolved=how, ids=ids)
    rows = _of(tables.paragraphs, ids)
    if mode == "read_paragraph":
        at, delta = arguments["paragraph_no"], max(0, min(arguments.get("context", 0), 10))
        rows = rows.where(F.col("paragraph_no").between(max(1, at - delta), at + delta))
    elif mode == "read_range":
        a, b = sorted((arguments["start"], arguments["end"]))
        rows = rows.where(F.col("paragraph_no").between(a, b))
    else:
        quota = max(1, store.clamp(arguments.get("limit", 10), MOST) // len(ids))
        order = Window.partitionBy("date_id").orderBy(*store.paragraph_order())
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= quota).drop("n")
    return done(rows.orderBy(*store.paragraph_order("date_id")).limit(MOST), resolved=how, ids=ids)
