"""Order-dependent folds over a document's paragraphs and lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import ChunkConfig
from quillmark.functions.cleaning import coverage, line_marks
from quillmark.operators.audit import best_run
from quillmark.operators.store import merge_sub_rows

CHUNKS = "date_id string, chunk_index int, chunk_id string, ref_start string, ref_end string, paragraph_start int, paragraph_end int, text string, word_count int, char_count int, is_tail boolean"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def letters(n: int) -> str:
    """a, b, ... z, aa, ab, ... for 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def letter_index(suffix: str) -> int:
    n = 0
    for c in suffix:
        n = n * 26 + ord(c) - 96
    return n - 1


def split_budget(text: str, most: int, least: int) -> tuple[str, str]:
    """As many whole sentences as fit ``most`` words; if they make fewer than
    ``least``, a cut between words."""
    words = text.split()
    taken, head = 0, []
    for sentence in _SENTENCE.split(text):
        n = len(sentence.split())
        if taken + n > most:
            break
        taken += n
        head.append(sentence)
    if taken < least or taken >= len(words):
        taken = max(min(most, len(words)), least)
        return " ".join(words[:taken]), " ".join(words[taken:])
    return " ".join(" ".join(head).split()), " ".join(words[taken:])


def pack(paragraphs: list[tuple[int, str]], config: ChunkConfig = ChunkConfig()) -> list[list[tuple[str, str]]]:
    """Chunks of (reference, text) units.

    Fewer than ``least`` words in all: one chunk.  Otherwise whole units are
    taken while they fit ``most`` words, and a chunk closes at ``least``; a unit
    that does not fit is split, its parts lettered a, b, c ...
    """
    todo = [(no, "", text, len(text.split())) for no, text in reversed(paragraphs)]
    if sum(u[3] for u in todo) < config.least:
        return [[(str(no), text) for no, text in paragraphs]] if paragraphs else []
    used: dict[int, int] = {}
    chunks, now, words = [], [], 0
    while todo:
        no, suffix, text, n = todo.pop()
        if words + n <= config.most:
            now.append((f"{no}{suffix}", text))
            words += n
            if words >= config.least:
                chunks.append(now)
                now, words = [], 0
            continue
        head, tail = split_budget(text, config.most - words, config.least - words)
        if not suffix:
            suffix = letters(0)
            used[no] = 0
        used[no] += 1
        now.append((f"{no}{suffix}", head))
        chunks.append(now)
        now, words = [], 0
        if tail:
            todo.append((no, letters(used[no]), tail, len(tail.split())))
    if now:
        chunks.append(now)
    return chunks


def chunk_documents(paragraphs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Packs each document's paragraphs, the parts of one number merged first;
    an array holds one document's."""

    def fold(batches):
        for part in batches:
            out = []
            for date_id, rows in zip(part["date_id"], part["rows"]):
                own = sorted(((int(r["paragraph_no"]), r["text"]) for r in rows if r["text"] and r["text"].split()), key=lambda r: r[0])
                found = pack(own, config)
                for i, chunk in enumerate(found):
                    text = "\n".join(t for _, t in chunk)
                    first, last = chunk[0][0], chunk[-1][0]
                    out.append((date_id, i, f"{date_id}_chunk_{i}", first, last, int(re.match(r"\d+", first)[0]), int(re.match(r"\d+", last)[0]), text, len(text.split()), len(text), i == len(found) - 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    merged = merge_sub_rows(paragraphs) if "sub_id" in paragraphs.columns else paragraphs
    rows = merged.groupBy("date_id").agg(F.collect_list(F.struct("paragraph_no", "text")).alias("rows"))
    return rows.mapInPandas(fold, CHUNKS)


def paragraphize(text: str, cap: int = 800) -> list[str]:
    """Blocks between blank lines; short ones go, long ones are split at sentences, then words."""
    floor = 10 if len(text) < 2000 else 20
    out = []
    for block in re.split(r"\n\s*\n", text):
        block = " ".join(block.split())
        if len(block) < floor:
            continue
        while len(block.split()) > cap:
            head, block = split_budget(block, cap, 1)
            out.append(head)
        if block:
            out.append(block)
    return out


def split_near(text: str, target: int) -> tuple[str, str]:
    """Two parts, the first of about ``target`` words: the sentence end whose
    running count is nearest, or a cut between words where there is no inner end."""
    words = text.split()
    if target <= 0 or target >= len(words):
        return ("", text.strip()) if target <= 0 else (text.strip(), "")
    ends, total = [], 0
    for sentence in _SENTENCE.split(text.strip())[:-1]:
        total += len(sentence.split())
        ends.append(total)
    at = min(ends, key=lambda n: abs(n - target)) if ends else target
    return " ".join(words[:at]), " ".join(words[at:])


def rebalance(chunks: list[list[tuple[str, str]]], config: ChunkConfig = ChunkConfig()) -> list[list[tuple[str, str]]]:
    """Chunks of which none is below ``least``: from the last one back, each takes
    what it lacks from the end of the one before, which may owe then itself.

    Whole units move where they fit, else the donor's last unit is split and its
    parts are lettered.  ValueError if the first chunk is too short or no words can move.
    """
    chunks = [list(c) for c in chunks]
    size = lambda c: sum(len(t.split()) for _, t in c)
    used: dict[int, int] = {}
    for ref, _ in (u for c in chunks for u in c):
        m = re.match(r"(\d+)([a-z]*)$", ref)
        if m[2]:
            used[int(m[1])] = max(used.get(int(m[1]), 0), letter_index(m[2]))
    for i in range(len(chunks) - 1, -1, -1):
        while (lack := config.least - size(chunks[i])) > 0:
            if i == 0:
                raise ValueError("the first chunk is too short")
            donor = chunks[i - 1]
            room, spare = config.most - size(chunks[i]), size(donor) - 1
            if room <= 0 or spare <= 0:
                raise ValueError("no words can move")
            ref, text = donor[-1]
            n = len(text.split())
            if n <= min(room, spare, lack):
                chunks[i].insert(0, donor.pop())
                continue
            move = min(room, spare, lack, n - 1)
            if move <= 0:
                raise ValueError("no words can move")
            head, tail = split_near(text, n - move)
            if not head or not tail or len(tail.split()) > room:
                words = text.split()
                head, tail = " ".join(words[: n - move]), " ".join(words[n - move :])
            m = re.match(r"(\d+)([a-z]*)$", ref)
            number = int(m[1])
            used[number] = max(used.get(number, 0), letter_index(m[2]) if m[2] else 0) + 1
            donor[-1] = (ref if m[2] else f"{number}a", head)
            chunks[i].insert(0, (f"{number}{letters(used[number])}", tail))
    return chunks


def marked_paragraphs(lines: DataFrame) -> DataFrame:
    """(date_id, paragraph_no, text) from lines (date_id, pos, text), by windows alone.

    Marks are lines that begin with a number; the longest run of consecutive
    numbers bounds the text, and each line belongs to the last mark before it.
    """
    number = F.nullif(F.regexp_extract("text", r"^\s*¶?\s*(\d{1,4})[.)]?(?:\s|$)", 1), F.lit("")).cast("int")
    rows = lines.withColumn("mark", F.when(~number.between(1900, 2100) & (number > 0), number))
    best = best_run(rows.where("mark IS NOT NULL").select("date_id", F.col("mark").alias("paragraph_no")))
    rows = rows.join(best.select("date_id", "first", "last"), "date_id")
    # of each number of the run the first line that has it is its mark
    first = Window.partitionBy("date_id", "mark").orderBy("pos")
    own = F.col("mark").between(F.col("first"), F.col("last")) & (F.row_number().over(first) == 1)
    rows = rows.withColumn("starts", own.cast("int"))
    rows = rows.withColumn("n", F.sum("starts").over(Window.partitionBy("date_id").orderBy("pos"))).where("n > 0")
    text = F.trim(F.regexp_replace("text", r"^\s*¶?\s*\d{1,4}[.)]?(?:\s+|$)", ""))
    body = F.when(F.col("starts") == 1, text).otherwise(F.trim("text"))
    g = rows.groupBy("date_id", "n").agg(F.max(F.when(F.col("starts") == 1, F.col("mark"))).alias("paragraph_no"), F.array_sort(F.collect_list(F.when(body != "", F.struct("pos", body.alias("t"))))).alias("parts"))
    return g.select("date_id", "paragraph_no", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def choose_strategy(text: str, least_run: int = 12, gap: int = 50, least_coverage: float = 0.8) -> str:
    """``numbered`` unless there is no run, or marks beyond the parsed ones show that it breaks off."""
    parsed = {n for n, _ in numbered(text, least_run)}
    raw = {n for _, n, _, _ in line_marks(text)}
    if not parsed or max(raw) - max(parsed) > gap or coverage(raw, parsed) < least_coverage:
        return "blocks"
    return "numbered"


def numbered(text: str, least_run: int = 12) -> list[tuple[int, str]]:
    """Paragraphs that begin with their number, from the longest run of consecutive ones.

    A number counts if it is positive, no year (1900-2100), at most 50 at the
    start and otherwise the next one.  No run of ``least_run``: nothing.
    """
    out: list[tuple[int, list[str]]] = []
    best: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = re.match(r"\s*¶?\s*(\d{1,4})[.)]?\s+(\S.*)$", line)
        n = int(m[1]) if m else 0
        if m and n > 0 and not 1900 <= n <= 2100 and ((not out and n <= 50) or (out and n == out[-1][0] + 1)):
            out.append((n, [m[2]]))
        elif m and n == 1 and out:
            best, out = max(best, out, key=len), [(1, [m[2]])]
        elif out and line.strip():
            out[-1][1].append(line.strip())
    best = max(best, out, key=len)
    return [(n, " ".join(" ".join(t).split())) for n, t in best] if len(best) >= least_run else []


def parse_documents(papers: DataFrame) -> DataFrame:
    """(date_id, paragraph_no, text, strategy): numbered paragraphs, or blocks where there is no run."""

    def run(batches):
        for part in batches:
            rows = []
            for date_id, text in zip(part["date_id"], part["text"]):
                found = numbered(text or "") if choose_strategy(text or "") == "numbered" else []
                if found:
                    rows += [(date_id, n, t, "numbered") for n, t in found]
                else:
                    rows += [(date_id, i + 1, t, "blocks") for i, t in enumerate(paragraphize(text or ""))]
            yield pd.DataFrame(rows, columns=["date_id", "paragraph_no", "text", "strategy"])

    return papers.select("date_id", "text").mapInPandas(run, "date_id string, paragraph_no int, text string, strategy string")
