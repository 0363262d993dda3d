"""Line rules over raw document text: page numbers, headers, titles, notices."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that begin a copyright notice.
NOTICES = (r"©", r"\(c\)\s*\d{4}", r"copyright\s+(?:notice|\d{4})", r"all\s+rights\s+reserved")
_NOTICE = re.compile("|".join(NOTICES), re.I)
_NUMBER = re.compile(r"^\s*\d{1,4}\s*$")


def is_page_number(lines: list[str], i: int) -> bool:
    """A lone number between blank lines, at an end, or one more than the last lone number nearby."""
    if not _NUMBER.match(lines[i]):
        return False
    before, after = lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""
    if not before.strip() or not after.strip():
        return True
    near = [int(lines[j]) for j in range(max(0, i - 2), i) if _NUMBER.match(lines[j])]
    return bool(near) and int(lines[i]) == near[-1] + 1


def strip_page_furniture(text: str, least: int = 3) -> str:
    """Without page numbers and without short lines that stand ``least`` times beside one."""
    lines = text.split("\n")
    numbers = {i for i in range(len(lines)) if is_page_number(lines, i)}
    beside: dict[str, int] = {}
    for i in numbers:
        for j in (i - 1, i + 1):
            if 0 <= j < len(lines) and lines[j].strip() and len(lines[j]) <= 80:
                beside[lines[j].strip()] = beside.get(lines[j].strip(), 0) + 1
    running = {line for line, n in beside.items() if n >= least}
    return "\n".join(line for i, line in enumerate(lines) if i not in numbers and line.strip() not in running)


def strip_notice(text: str, tail: float = 0.5) -> str:
    """Cut before the first notice in the last part of a text, back to the blank line before it."""
    m = _NOTICE.search(text, int(len(text) * tail))
    if not m:
        return text
    blank = text.rfind("\n\n", 0, m.start())
    line = text.rfind("\n", 0, m.start())
    return text[: blank if blank > len(text) * tail else max(line, 0)].rstrip()


def extract_title(text: str, most: int = 10) -> tuple[str, int]:
    """(title, lines used): up to four leading lines in capitals; ``Untitled`` without one."""
    title, used = [], 0
    for i, line in enumerate(text.split("\n")[:most]):
        line = line.strip()
        if not line and not title:
            continue
        letters = [c for c in line if c.isalpha()]
        if not letters or sum(c.isupper() for c in letters) < 0.8 * len(letters) or len(title) == 4:
            break
        title.append(line)
        used = i + 1
    return (" ".join(title), used) if title else ("Untitled", 0)


def strip_title_leaks(text: str, title: str) -> str:
    """Without lines that are the title, alone or with a page number."""
    own = re.compile(rf"^\s*(?:\d+\s+)?{re.escape(title)}(?:\s+\d+)?\s*$", re.I)
    return "\n".join(line for line in text.split("\n") if not own.match(line))


def clean_paragraph(text: str) -> str:
    """Without a leading mark; single spaces, none before punctuation."""
    text = re.sub(r"^\s*¶?\s*\d{1,4}[.)]?\s+", "", text)
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", text)).strip()


def clean_documents(papers: DataFrame) -> DataFrame:
    """(date_id, title, text): the rules in order, a document at a time."""

    def run(batches):
        for part in batches:
            rows = []
            for date_id, text in zip(part["date_id"], part["text"]):
                text = strip_notice(strip_page_furniture(text or ""))
                title, used = extract_title(text)
                body = "\n".join(text.split("\n")[used:])
                rows.append((date_id, title, strip_title_leaks(body, title) if used else body))
            yield pd.DataFrame(rows, columns=["date_id", "title", "text"])

    return papers.select("date_id", "text").mapInPandas(run, "date_id string, title string, text string")


def chronological(papers: DataFrame) -> DataFrame:
    """By year, month, day and letter of the id; ids of another form last."""
    part = lambda k: F.regexp_extract("date_id", r"^([0-9]{2})-([0-9]{2})([0-9]{2})([A-Z]?)", k)
    return papers.orderBy(F.when(part(1) == "", 1).otherwise(0), part(1), part(2), part(3), part(4))


#: Words, and abbreviations as whole words, of addresses.
ADDRESS_WORDS = frozenset("avenue street road drive lane boulevard highway route box pobox missouri arizona illinois california indiana kentucky ohio texas ave st rd dr ln blvd hwy po".split())
_MARK = re.compile(r"^\s*¶?\s*(\d{1,4})([a-z]?)(?:[.)]?\s+(\S.*))?$")
#: Announcements of numbered cards, seats and ranges: a pattern, and whether a number has to stand near.
_CALLS = (
    (r"\bprayer\s+cards?\b|\bcard\s+numbers?\b", True), (r"\bstart\s+about\b.*\bcard\b", True), (r"\b(?:who\s+has|raise\s+your\s+hand)\b", True), (r"\b(?:who\s+has|raise\s+your\s+hand)\b.*\bcards?\b", False),
    (r"\bup\s+to\b", True), (r"^or\s+\d{1,4}\b", False), (r"\b\d{1,4}\s+(?:to|-|–|—)\s+\d{1,4}\b", False),
)
_CALLS = tuple((re.compile(p), near) for p, near in _CALLS)
_CODE = re.compile(r"\b[A-Z]{1,2}[-–—]?\d{1,3}\b")


def looks_like_address(text: str) -> bool:
    """What follows a number holds a word of an address."""
    return any(w.replace(".", "") in ADDRESS_WORDS for w in re.findall(r"[a-z]+(?:\.[a-z]+)?", text.lower()))


def plausible_number(n: int, last: int | None) -> bool:
    """A paragraph's number: positive, no year; small at the start, later the next one."""
    if n <= 0 or 1900 <= n <= 2100:
        return False
    return n <= 50 if last is None else n == last + 1


def looks_like_call(text: str) -> bool:
    """What follows a number is a call of cards or a range, not a paragraph."""
    low = text.strip().lower()
    early = re.findall(r"[a-z']+|\d+", low)[:12]
    if not early:
        return False
    numbers, code = sum(w.isdigit() for w in early), bool(_CODE.search(text))
    if any(p.search(low) and (not near or numbers or code) for p, near in _CALLS):
        return True
    if "to" in early and (numbers >= 2 or (numbers and ("from" in early or "back" in early))):
        return True
    return code and numbers > 0


def line_marks(text: str) -> list[tuple[int, int, str, str]]:
    """(line, number, letter, rest) of every line that begins with a number."""
    found = ((i, _MARK.match(line)) for i, line in enumerate(text.split("\n")))
    return [(i, int(m[1]), m[2], m[3] or "") for i, m in found if m]


def last_mark(text: str) -> tuple[int, str] | None:
    """The last paragraph mark of a text, page numbers left out."""
    lines = text.split("\n")
    for i, n, letter, rest in reversed(line_marks(text)):
        if rest or letter or not is_page_number(lines, i):
            return n, letter
    return None


def coverage(raw: set[int], parsed: set[int]) -> float:
    """The share of raw marks that parsing kept."""
    return len(raw & parsed) / max(1, len(raw))


def strip_trailer(text: str, date_id: str, end_mark: str, signs: tuple[str, ...] = ()) -> str:
    """Cut behind the last line with the closing mark, if what follows names the document or holds a sign of a notice."""
    lines = text.split("\n")
    at = max((i for i, line in enumerate(lines) if end_mark in line), default=-1)
    rest = [line for line in lines[at + 1 :] if line.strip()]
    own = "\n".join(rest)
    if at >= 0 and rest and (date_id in own or any(s in own for s in signs) or _NOTICE.search(own)):
        return "\n".join(lines[: at + 1])
    return text


def first_of_each(paragraphs: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each (date_id, paragraph_no, sub_id): the first in reading order."""
    window = Window.partitionBy("date_id", "paragraph_no", "sub_id").orderBy(order)
    return paragraphs.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def line_neighbours(lines: DataFrame) -> DataFrame:
    """Each line (date_id, pos, text) with the two before and behind it and the next that is not blank, within four."""
    w = Window.partitionBy("date_id").orderBy("pos")
    out = lines
    for name, f, k in (("before_1", F.lag, 1), ("before_2", F.lag, 2), ("after_1", F.lead, 1), ("after_2", F.lead, 2)):
        out = out.withColumn(name, f("text", k).over(w))
    filled = F.when(F.trim("text") != "", F.col("text"))
    return out.withColumn("next_filled", F.first(filled, ignorenulls=True).over(w.rowsBetween(1, 4)))


def order_blocks(blocks: DataFrame, header: float = 0.08, footer: float = 0.06, wide: float = 0.6) -> DataFrame:
    """Text blocks (date_id, page, width, height, x0, y0, x1, y1, text) of pages in reading order, as one text.

    Blocks in the top and bottom margins go.  A page is read in two columns if
    at least two narrow blocks begin on either side of its middle; wide blocks
    then come with the left column.
    """
    own = blocks.where((F.col("y1") > F.col("height") * header) & (F.col("y0") < F.col("height") * (1 - footer)) & (F.trim("text") != ""))
    narrow = (F.col("x1") - F.col("x0")) < F.col("width") * wide
    right = narrow & (F.col("x0") >= F.col("width") / 2)
    page = Window.partitionBy("date_id", "page")
    two = (F.count_if(right).over(page) >= 2) & (F.count_if(narrow & ~right).over(page) >= 2)
    own = own.withColumn("col", F.when(two & right, 1).otherwise(0))
    g = own.groupBy("date_id").agg(F.array_sort(F.collect_list(F.struct("page", "col", "y0", "x0", "text"))).alias("rows"))
    return g.select("date_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))
