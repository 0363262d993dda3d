"""Quality by weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import BYTE_VALUE, EXACT_VALUE, IS_SPACE, U64, Scratch, doc_slices, forget, mix, span_hashes, text_bytes, window_hashes, word_spans

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_ALPHA = np.zeros(256, np.int64)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = 1
_LOUD = np.zeros(256, np.int64)
_LOUD[list(b"!?")] = 1
_POINT = np.zeros(256, np.int64)
_POINT[(np.arange(256) & 0xC0) != 0x80] = 1
_SPACE = IS_SPACE.astype(np.int64)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_loud")


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """STATS of each text: counts that the rules read.

    Lines and windows are compared by 64-bit hashes within a text.
    """
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = _sums(_POINT[data], offsets) - _sums(_SPACE[data], offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_alpha", _ALPHA), ("n_loud", _LOUD)):
        out[name] = _sums(table[data], offsets)
    # lines with a word
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[np.flatnonzero(data == 0x0A) + 1] = True
    line_starts = np.flatnonzero(edge[:-1])
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 0x0A)) if len(data) else line_ends
    line = np.unique(np.searchsorted(line_starts, starts, side="right") - 1)
    line_starts, line_ends = line_starts[line], line_ends[line]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    hashes = span_hashes(data, line_starts, line_ends, BYTE_VALUE)
    _, first = np.unique(hashes + mix(line_doc.astype(np.uint64) + U64(1)), return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)
    # words inside windows that occur twice or more
    words = span_hashes(data, starts, ends, EXACT_VALUE)
    hashes, at = window_hashes(words, doc, window)
    _, group, count = np.unique(hashes + mix(doc[at].astype(np.uint64) + U64(1)), return_inverse=True, return_counts=True)
    again = at[count[group] > 1] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {k: out[k].astype(np.int64) for k in STATS}


BAD, ABSTAIN, GOOD = 0, 1, 2


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def rule_votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes for each text: BAD, ABSTAIN or GOOD of every rule."""
    words = np.maximum(s["n_words"], 1)
    symbols = s["n_symbols"] / words
    upper = s["n_upper"] / np.maximum(s["n_alpha"], 1)
    loud = s["n_loud"] / words
    repeated = s["n_repeat_words"] / words
    dup = s["n_dup_lines"] / np.maximum(s["n_lines"], 1)
    length = s["word_chars"] / words
    alpha = s["n_alpha"] / np.maximum(s["word_chars"], 1)
    calm = (symbols < 0.02) & (upper < 0.3) & (loud < 0.1)
    return np.stack([
        _vote(symbols > 0.2, calm & (alpha > 0.6)),
        _vote(upper > 0.6, np.zeros(len(words), bool)),
        _vote(loud > 0.4, np.zeros(len(words), bool)),
        _vote((dup > 0.3) & (s["n_dup_lines"] > 2), np.zeros(len(words), bool)),
        _vote(repeated > 0.3, (repeated < 0.1) & (dup < 0.2) & (s["n_words"] >= 30) & calm),
        _vote((length < 2) | (length > 20), (length > 3) & (length < 10) & calm),
        _vote(alpha < 0.5, np.zeros(len(words), bool)),
        _vote(s["n_words"] < 10, np.zeros(len(words), bool)),
    ], axis=1)


N_RULES = 8


@dataclass
class VoteModel:
    """prior: probability of good; given[c, r, v]: that rule r, if it does not
    abstain, votes v (0 bad, 1 good) on a text of class c."""

    prior: float
    given: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        table = np.log(self.given)
        for r in range(votes.shape[1]):
            for v, side in ((BAD, 0), (GOOD, 1)):
                log[votes[:, r] == v] += table[:, r, side]
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85, trust: float = 0.9) -> VoteModel:
    """Expectation-maximisation over the different vote patterns and their counts.

    Abstentions carry no evidence.  It starts from every rule being right with
    probability ``trust``; pseudo-counts in that proportion keep rules that
    hardly ever vote near it and the classes the right way round.
    """
    start = np.array([[trust, 1 - trust], [1 - trust, trust]])
    model = VoteModel(prior, np.repeat(start[:, None, :], patterns.shape[1], axis=1))
    total = max(1.0, float(counts.sum()))
    weight = max(10.0, 0.01 * total)
    for _ in range(rounds):
        good = model.posterior(patterns)
        old = model.given
        given = np.empty_like(old)
        for c, p in ((0, 1 - good), (1, good)):
            for r in range(patterns.shape[1]):
                sides = np.array([(counts * p * (patterns[:, r] == v)).sum() for v in (BAD, GOOD)])
                sides += weight * start[c]
                given[c, r] = sides / sides.sum()
        share = float(((counts * good).sum() + weight * prior) / (total + weight))
        model = VoteModel(min(max(share, 0.05), 0.95), given)
        if np.abs(given - old).max() < 1e-9:
            break
    return model


def _per_text(column: pa.Array):
    """Statistics and votes of a column's texts."""
    forget()
    data, offsets = text_bytes(column)
    parts = []
    for a, b in doc_slices(offsets):
        parts.append(text_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    stats = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in STATS}
    return stats, rule_votes(stats)


def _code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1]))


def _fit_counts(found) -> VoteModel:
    """From rows (code, n); at most 3**8 of them."""
    codes = np.array(sorted(r["code"] for r in found), np.int64)
    by_code = {r["code"]: r["n"] for r in found}
    counts = np.array([by_code[c] for c in codes.tolist()], float)
    return fit_votes(_patterns(codes), counts)


def _patterns(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(N_RULES)) % 3


def fit_quality(docs: DataFrame, text_column: str = "text") -> VoteModel:
    """Weighs the rules over all texts.

    What comes to the driver is one count for each of at most 3**8 patterns of
    votes, whatever the table's size.  An empty table leaves the start values.
    """

    def run(batches):
        for batch in batches:
            code, count = np.unique(_code(_per_text(batch.column(0))[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])

    return _fit_counts(docs.select(text_column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect())


def text_votes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics, base rule and coded votes of every text.

    base_failed: fewer than 10 words, or more than 20 % of them in repeated
    5-word windows.  A null text is an empty one.  One pass; rows keep their
    ids as they are, null or repeated; long texts are counted whole.
    """

    def run(batches):
        for batch in batches:
            stats, votes = _per_text(batch.column(1))
            failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
            columns = [batch.column(0), *(pa.array(stats[k]) for k in STATS[:5]), pa.array(failed), pa.array(_code(votes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *STATS[:5], "base_failed", "code"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, code long")


def judge_quality(docs: DataFrame, model: VoteModel | None = None, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics, base rule, posterior quality and verdict of every text.

    kept: not base_failed and the posterior is at least ``least``, so a text
    whose posterior is just that stays.  Without a model one is fitted to these
    texts; their votes are written once and serve both.  A null text fails; an
    empty table gives no rows.
    """
    votes = text_votes(docs, id_column, text_column)
    if model is None:
        votes = Scratch(docs.sparkSession, "quality").write(votes, "votes")
        model = _fit_counts(votes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())

    def run(batches):
        for batch in batches:
            quality = model.posterior(_patterns(batch.column(7).to_numpy()))
            kept = ~batch.column(6).to_numpy(zero_copy_only=False).astype(bool) & (quality >= least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(quality), pa.array(kept)], names=[*batch.schema.names[:7], "quality", "kept"])

    fields = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return votes.mapInArrow(run, f"{fields}, quality double, kept boolean")


def keep_good(docs: DataFrame, model: VoteModel, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows whose texts are kept, with all their columns."""
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            stats, votes = _per_text(batch.column(place))
            failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
            yield batch.filter(pa.array(~failed & (model.posterior(votes) >= least)))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, base verdict, posterior quality and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_quality(docs)
