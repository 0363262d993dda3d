"""Pages, sectioned texts, event streams and configuration."""

from __future__ import annotations

import os
import re
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_ids(pages: DataFrame, year: str | None = None) -> DataFrame:
    """Distinct ids named on pages, in order; only of one year if asked."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"\b([0-9]{2}-[0-9]{4}[A-Z]?)\b"), F.lit(1))).alias("date_id")).distinct()
    return (found.where(F.col("date_id").startswith(year[-2:] + "-")) if year else found).orderBy("date_id")


def pdf_link(html: Column, host: str = r"[\\w.-]*cdn[\\w.-]*") -> Column:
    """An anchor that says PDF, else any link to one, else an address on a host that
    delivers files, else any address of one."""
    first = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    return F.coalesce(first(r"(?is)<a[^>]*href=[\"']([^\"']+\.pdf)[\"'][^>]*>[^<]*pdf[^<]*</a>"), first(r"(?i)href=[\"']([^\"']+\.pdf)[\"']"), first(rf"(?i)(https?://{host}/[^\s\"'<>]+\.pdf)"), first(r"(?i)(https?://[^\s\"'<>]+\.pdf)"))


def sections(texts: DataFrame) -> DataFrame:
    """(section, text) of texts with ``=== SECTION: id ===`` lines."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^=== SECTION: (.+?) ===\s*$", 1)
    lines = lines.withColumn("mark", F.nullif(mark, F.lit(""))).withColumn("n", F.sum(F.col("mark").isNotNull().cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    rows = lines.where("n > 0").groupBy("path", "n").agg(F.max("mark").alias("section"), F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), F.struct("pos", "line")))).alias("rows"))
    return rows.select("path", "n", "section", F.trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def section(rows: DataFrame, name: str | None, clip: int = 12_000) -> DataFrame:
    """The named section, or the first where there is none of that name; long ones are clipped."""
    order = Window.orderBy(F.when(F.col("section") == F.lit(name), 0).otherwise(1), "path", "n")
    found = rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return found.withColumn("text", F.when(F.length("text") > clip, F.concat(F.substring("text", 1, clip), F.lit("..."))).otherwise(F.col("text")))


def parse_events(raw: DataFrame) -> DataFrame:
    """(request, seq, event, data) of texts in server-sent-event form."""
    blocks = raw.select("request", F.posexplode(F.split("raw", r"\n\n+")).alias("seq", "block"))
    rows = blocks.select("request", "seq", F.regexp_extract("block", r"(?m)^event:\s*(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data:\s?(.*)$"), F.lit(1)), "\n").alias("data"))
    return rows.where("event <> '' OR data <> ''")


def format_events(rows: DataFrame) -> DataFrame:
    """(request, raw): events as one text for each request, in order."""
    one = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n"))
    g = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("t")))).alias("rows"))
    return g.select("request", F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("raw"))


def configure(config, values: dict, prefix: str = "QUILLMARK_"):
    """A configuration with values from a mapping, the environment's own on top."""
    found = {}
    for f in fields(config):
        own = getattr(config, f.name)
        if f.name in values:
            found[f.name] = values[f.name]
        if (text := os.environ.get(prefix + f.name.upper())) is not None:
            found[f.name] = text.lower() in ("1", "true", "yes") if isinstance(own, bool) else type(own)(text)
    return replace(config, **found)


def resolve_links(ids: DataFrame, pages: DataFrame, key: str = "date_id") -> DataFrame:
    """(key, link): each id with the link on its page; null where there is no page or no link."""
    return ids.select(key).distinct().join(pages.select(key, pdf_link(F.col("html")).alias("link")), key, "left").groupBy(key).agg(F.min("link").alias("link"))


def fetch_status(wanted: DataFrame, manifest: DataFrame, found: DataFrame, key: str = "date_id") -> DataFrame:
    """(status, n): already fetched, found, or without a link."""
    rows = wanted.select(key).distinct().join(manifest.select(key).distinct().withColumn("old", F.lit(True)), key, "left").join(found.select(key, "link"), key, "left")
    status = F.when(F.col("old"), "skipped").when(F.col("link").isNotNull(), "found").otherwise("missing")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def whole_section(rows: DataFrame, clip: int = 12_000) -> DataFrame:
    """All sections of a text as one, in order, clipped."""
    g = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")
    return g.select("path", F.when(F.length(text) > clip, F.concat(F.substring(text, 1, clip), F.lit("..."))).otherwise(text).alias("text"))


def web_results(replies: DataFrame, most: int = 10) -> DataFrame:
    """(request, place, title, link, snippet) of a web search's JSON replies (request, raw), at most 1 to 10 each."""
    found = F.from_json("raw", "organic array<struct<title: string, link: string, snippet: string>>")["organic"]
    rows = replies.select("request", F.posexplode(F.slice(found, 1, max(1, min(most, 10)))).alias("at", "r"))
    return rows.select("request", (F.col("at") + 1).alias("place"), "r.title", "r.link", "r.snippet")


def configuration_file(text: str) -> dict:
    """Nested ``name: value`` lines, two spaces a level, as a mapping: the part of YAML that configurations use."""
    out: dict = {}
    open_ = [(-1, out)]
    for line in text.split("\n"):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        m = re.match(r"^( *)([\w.-]+):\s*(.*)$", line)
        if not m:
            continue
        depth = len(m[1])
        while open_[-1][0] >= depth:
            open_.pop()
        if m[3]:
            open_[-1][1][m[2]] = _scalar(m[3])
        else:
            open_[-1][1][m[2]] = own = {}
            open_.append((depth, own))
    return out


def _scalar(text: str):
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(low)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
