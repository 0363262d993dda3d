"""Gates and rewrites of questions and replies, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.answers import CITATION

#: Fixed value: a scripture reference in a reply.
SCRIPTURE_IN_REPLY = r"\b(?:[1-3]\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+\d+:\d+(?:-\d+)?\b"


def cites_document(text: Column) -> Column:
    return F.coalesce(text.rlike(CITATION), F.lit(False))


def cites_scripture(text: Column) -> Column:
    return F.coalesce(text.rlike(SCRIPTURE_IN_REPLY), F.lit(False))


def mode_addendum(query: Column, scripture: str, comparison: str) -> Column:
    """What a prompt gets besides: the caller's text for scripture, else for comparison, else null."""
    return F.when(T.scripture_question(query), F.lit(scripture)).when(T.comparison_question(query), F.lit(comparison))


def needs_external_section(query: Column, names: tuple[str, ...], words: tuple[str, ...], pairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """Whether a question is about people or bodies that the corpus does not speak of.

    ``names`` are looked for at the begin of words, ``words`` anywhere, of
    ``pairs`` both have to come; all in the lowered question.
    """
    q = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lit(" "))
    found = F.lit(False)
    for n in names:
        found |= F.contains(q, F.lit(" " + n))
    for w in words:
        found |= F.contains(q, F.lit(w))
    for a, b in pairs:
        found |= F.contains(q, F.lit(a)) & F.contains(q, F.lit(b))
    return (F.trim(q) != "") & found


def two_line_reply(text: Column, message: str, label: str = "Answer:") -> Column:
    """``label`` and one paragraph: what follows the label, else the first line, else ``message``."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: F.trim(line)), lambda line: line != "")
    first, second = F.try_element_at(lines, F.lit(1)), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(message))
    after = F.trim(F.substr(first, F.lit(len(label) + 1)))
    body = F.when(F.size(lines) == 0, F.lit(message)).when(first.startswith(label), F.when(after != "", after).otherwise(second)).otherwise(first)
    return F.concat(F.lit(label + "\n"), body)


def redact(text: Column, line_rules: tuple[str, ...], inline_rules: tuple[tuple[str, str], ...]) -> Column:
    """Without the lines that match a rule; then each inline rule's replacement, in order."""
    if line_rules:
        drop = "(?i)" + "|".join(line_rules)
        text = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(drop)), "\n")
    for pattern, put in inline_rules:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def compliance(text: Column) -> Column:
    """struct of four checks: begins with the answer's label, has references, cites, says nothing of tools."""
    return F.struct(
        F.ltrim(text).startswith("Answer:").alias("answer_label"), F.contains(text, F.lit("References:")).alias("references"), cites_document(text).alias("cites"),
        (~F.lower(text).rlike("tool call|retrieval pipeline|rag pipeline")).alias("no_mechanics"),
    )


def rate_limited(status: Column, message: Column) -> Column:
    """Status 429, or a message that says so."""
    return (F.coalesce(status, F.lit(0)) == 429) | F.coalesce(F.lower(message).rlike("rate.?limit|too many requests|quota exceeded|\\b429\\b"), F.lit(False))


def overrides_refusal(query: Column, should_refuse: Column) -> Column:
    """A refusal that stands: not for scripture or comparison, which are answered anyway."""
    return should_refuse & ~(T.scripture_question(query) | T.comparison_question(query))


def refusal_style(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a reply reads as a refusal: one of the phrases and no citation."""
    any_ = F.lit(False)
    for p in phrases:
        any_ |= F.contains(F.lower(text), F.lit(p.lower()))
    return any_ & ~cites_document(text)
