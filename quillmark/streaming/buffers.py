"""Streamed answers: deltas out of chunks, whole texts, budgets kept as state, an event sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk as text: providers put the delta under ``choices`` and some a bare one.
_CHOICE = "choices array<struct<delta: struct<content: string, tool_calls: array<struct<index: int, id: string, function: struct<name: string, arguments: string>>>>>>"
_CHUNK = f"{_CHOICE}, delta struct<content: string>, content string"


def delta_text(chunk: Column) -> Column:
    """The text that a chunk adds; empty if it adds none or cannot be read."""
    c = F.from_json(chunk, _CHUNK)
    first = F.try_element_at(c["choices"], F.lit(1))
    return F.coalesce(first["delta"]["content"], c["delta"]["content"], c["content"], F.lit(""))


def delta_calls(rows: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(request, seq, index, id, name, args) of the calls that chunks add to."""
    first = F.try_element_at(F.from_json(chunk, _CHOICE)["choices"], F.lit(1))
    own = rows.select("request", "seq", F.explode(first["delta"]["tool_calls"]).alias("c"))
    return own.select("request", "seq", F.coalesce("c.index", F.lit(0)).alias("index"), "c.id", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("args"))


def buffer_text(rows: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(request, text, deltas): a request's whole text in order of seq, and how many chunks gave any."""
    own = rows.select("request", "seq", delta_text(F.col(chunk)).alias("t")).where("t <> ''")
    g = own.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("parts"))
    text = g.select("request", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"), F.size("parts").alias("deltas"))
    return rows.select("request").distinct().join(text, "request", "left").select("request", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("deltas", F.lit(0)).alias("deltas"))


def stream_budget(calls: DataFrame, most: int, per_name: dict[str, int]) -> DataFrame:
    """As ``call_budget`` for a stream: counts are kept for each request across batches."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get)) if state.exists else {}
        for batch in batches:
            out = []
            for row in batch.sort_values("seq").itertuples():
                used[""] = used.get("", 0) + 1
                used[row.name] = used.get(row.name, 0) + 1
                out.append((key[0], row.seq, row.name, used[""], used[row.name], used[""] <= most and used[row.name] <= per_name.get(row.name, most)))
            yield pd.DataFrame(out, columns=["request", "seq", "name", "n", "n_own", "allowed"])
        state.update((list(used), list(used.values())))

    return calls.groupBy("request").applyInPandasWithState(count, "request string, seq long, name string, n long, n_own long, allowed boolean", "names array<string>, counts array<long>", "append", "NoTimeout")


def event_sink(events: DataFrame, path: str, checkpoint: str):
    """Appends (request, seq, event, data) rows of a stream as event text, a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        one = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.coalesce("data", F.lit("{}")), F.lit("\n"))
        batch.sortWithinPartitions("request", "seq").select(one.alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_events(answers: DataFrame, piece: int = 40) -> DataFrame:
    """(request, seq, event, data): start, the text in pieces, the final text, done; an error ends a request."""
    whole = F.coalesce("answer", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(whole) / piece).cast("int") - 1)), lambda i: F.substring(whole, i * piece + 1, F.lit(piece)))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    body = F.concat(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: event("delta", F.to_json(F.struct(p.alias("text"))))), F.array(event("final", F.to_json(F.struct(whole.alias("answer")))), event("done", F.lit("{}"))))
    failed = F.array(event("error", F.to_json(F.struct(F.col("error").alias("message")))))
    rows = F.concat(F.array(event("start", F.lit("{}"))), F.when(F.col("error").isNotNull(), failed).otherwise(body))
    return answers.select("request", F.posexplode(rows).alias("seq", "e")).select("request", "seq", "e.event", "e.data")
