"""Slots for models: embedding, reranking and generation as Arrow functions.

Each takes a factory that a worker calls once; the model's own code and
weights are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.functions import text as T
from quillmark.functions.references import tolerant_json

_LOADED: dict = {}


def _load(factory: Callable, key: str):
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def embedder(factory: Callable, key: str):
    """A column function text -> array<float>; the model maps a list of texts to vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(factory, key)
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model(texts.tolist())])

    return run


def reranker(factory: Callable, key: str):
    """A column function (query, text) -> double; the model scores pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _load(factory, key)
        for queries, texts in batches:
            yield pd.Series([float(s) for s in model(list(zip(queries, texts)))])

    return run


def rerank(fused: DataFrame, queries: DataFrame, units: DataFrame, score) -> DataFrame:
    """(query_id, chunk_id, rerank_score) of fused hits."""
    pairs = fused.select("query_id", "chunk_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(units.select("chunk_id", "text"), "chunk_id")
    return pairs.select("query_id", "chunk_id", score("q", "text").alias("rerank_score"))


def yes_probability(yes, no):
    """softmax(yes, no)[yes] without overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors (array of arrays) whose mask is 1; zeros without one."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1), lambda t: t["v"])
    width = F.size(F.try_element_at(vectors, F.lit(1)))
    sums = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(sums, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def last_token_pool(vectors: Column, mask: Column) -> Column:
    """The vector of the last token whose mask is 1, wherever the padding stands."""
    return F.try_element_at(vectors, F.array_size(mask) - F.coalesce(F.array_position(F.reverse(mask), 1), F.lit(1)).cast("int") + 1)


def first_token_pool(vectors: Column) -> Column:
    return F.try_element_at(vectors, F.lit(1))


def truncate_vector(v: Column, size: int) -> Column:
    """The leading ``size`` components, to unit length again."""
    return T.l2_normalize(F.slice(v, 1, size))


def instructed(query: Column, template: str, task: str = "") -> Column:
    """The query inside a model's template with {task} and {query}, or behind a prefix without them."""
    if "{query}" not in template:
        return F.concat(F.lit(template), query)
    before, after = template.replace("{task}", task).split("{query}", 1)
    return F.concat(F.lit(before), query, F.lit(after))


def completion(factory: Callable, key: str):
    """A slot for a language model: list of message arrays -> texts, as a column function."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(factory, key)
        for messages in batches:
            yield pd.Series([model([dict(m) for m in own]) for own in messages])

    return run


def summaries(reply: Column) -> Column:
    """struct(conversation_summary, query_summary) of a model's JSON reply; blanks and unreadable replies are null."""
    own = tolerant_json(reply, "conversation_summary string, query_summary string")
    return F.struct(*[F.nullif(F.trim(own[c]), F.lit("")).alias(c) for c in ("conversation_summary", "query_summary")])
