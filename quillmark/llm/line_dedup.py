"""Line dedup by pairwise alignment of overlapping documents."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.llm.common import BYTE_VALUE, Scratch, doc_slices, forget, span_hashes, text_bytes, word_spans


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, words and text of every ``\\n``-split line; 0 for lines without a word."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    doc = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(n)])
    ends = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((ends, doc))
    doc, ends = doc[order], ends[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    starts[first] = offsets[:-1][doc[first]]
    word_starts = word_spans(data, offsets)[0]
    # lines do not overlap, but an empty text's only line begins where the next one's does
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    hashes = np.zeros(len(doc), np.uint64)
    real = np.flatnonzero(words > 0)
    hashes[real] = span_hashes(data, starts[real], ends[real], BYTE_VALUE) | np.uint64(1)
    return hashes.astype(np.int64), words, doc


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (sorted by the first) whose seconds increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        if place == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[place], at[place] = j, k
        back.append(at[place - 1] if place else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest_run(a: list[int], b: list[int], words: list[int]) -> list[tuple[int, int]]:
    """The run of equal lines with the most words, however often its lines stand in either document."""
    places: dict[int, list[int]] = {}
    for i, line in enumerate(a):
        places.setdefault(line, []).append(i)
    most, best, before = 0, (0, 0, 0), {}
    for j, line in enumerate(b):
        now = {}
        if line:
            for i in places.get(line, ()):
                length, total = before.get(i - 1, (0, 0))
                now[i] = length + 1, total + words[j]
                if total + words[j] > most:
                    most, best = total + words[j], (i, j, length + 1)
        else:  # blank lines carry a run on, they begin none
            now = {i + 1: (length + 1, total) for i, (length, total) in before.items() if i + 1 < len(a) and not a[i + 1]}
        before = now
    i, j, length = best
    return [(i - k, j - k) for k in range(length - 1, -1, -1)]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two documents' lines, by patience diff."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, list[int]] = {}
        for side, lines, first, last in ((0, a, a0, a1), (2, b, b0, b1)):
            for i in range(first, last):
                own = place.setdefault(lines[i], [0, -1, 0, -1])
                own[side] += 1
                own[side + 1] = i
        anchors = sorted((p[1], p[3]) for line, p in place.items() if line and p[0] == 1 and p[2] == 1)
        anchors = _increasing(anchors)
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            found.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(found)


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int) -> list[tuple[int, int]]:
    """Ranges of b's lines that stand, line by line, in a too and hold at least
    ``least_words`` words.  What one alignment leaves is aligned again, so a
    block in another order is found as well.  An alignment that finds nothing,
    as where lines repeat, is followed by the run with the most words anywhere;
    a's lines stay, so a block that b holds twice is found twice."""
    held, b = set(a), list(b)
    blocks: list[tuple[int, int]] = []
    while True:
        new, run = [], []
        for i, j in [*patience(a, b), (-9, -9)]:
            if run and (i, j) == (run[-1][0] + 1, run[-1][1] + 1):
                run.append((i, j))
                continue
            while run and not b[run[0][1]]:
                run = run[1:]
            while run and not b[run[-1][1]]:
                run = run[:-1]
            if run and sum(words[r[1]] for r in run) >= least_words:
                new.append(run)
            run = [(i, j)]
        if not new and sum(w for line, w in zip(b, words) if line in held) >= least_words:
            run = longest_run(a, b, words)
            if sum(words[j] for _, j in run) >= least_words:
                new.append(run)
        if not new:
            return sorted(blocks)
        for run in new:
            blocks.append((run[0][1], run[-1][1] + 1))
            for _, j in run:
                b[j] = -2  # hashes are odd or 0, so it equals nothing


def dedup_lines(docs: DataFrame, least_words: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines that repeat earlier documents taken out.

    Adds ``lines_total``, ``lines_deleted`` and ``blocks_deleted``.  Of two
    documents the one with the larger id is the later (a null id comes first;
    equal ids by a hash of their texts; equal rows are one document).  A line's
    earliest holder stands for all its holders, and so does the earliest holder
    of a run: from each line the shortest run of lines (as they are, blank ones
    too) that holds ``least_words`` words.  A block that two documents share
    holds such a run, so its earliest holder is met whatever its single lines'
    holders are; each later holder makes one pair for a line and one for a run
    at most, however frequent they are.  Each pair is aligned on its
    own; blocks with fewer than ``least_words`` words stay, and so do a line's
    occurrences in its earliest holder.  A null text has no lines.  Columns of
    ``docs`` that have a name of the added ones give way to them; all others
    stay as they are.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("lines_total", "lines_deleted", "blocks_deleted")
    scratch = Scratch(spark, "line-dedup")

    def split(batches):
        forget()
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for x, y in doc_slices(offsets):
                hashes, words, doc = line_hashes(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                cuts = pa.array(np.searchsorted(doc, np.arange(y - x + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), pa.ListArray.from_arrays(cuts, pa.array(hashes)), pa.ListArray.from_arrays(cuts, pa.array(words.astype(np.int32)))],
                    names=["d", "t", "hashes", "words"],
                )

    def runs(batches):
        """Hash of the shortest run of ``least_words`` words that begins at each line with words."""
        for batch in batches:
            out = []
            for hashes, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, total, y = set(), 0, 0
                for x in range(len(hashes)):
                    while y < len(hashes) and total < least_words:
                        total, y = total + words[y], y + 1
                    if total < least_words:
                        break
                    if hashes[x] and y > x + 1:  # a single line is its own run
                        found.add(int.from_bytes(blake2b(array("q", hashes[x:y]).tobytes(), digest_size=8).digest(), "little", signed=True))
                    total -= words[x]
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["d", "t", "runs"])

    def align(batches):
        for batch in batches:
            own = batch.select(["d", "t", "a", "b", "words"]).to_pydict()
            out = [common_blocks(a, b, words, least_words) for a, b, words in zip(own["a"], own["b"], own["words"])]
            keep = [i for i, blocks in enumerate(out) if blocks]
            places = [[k for x, y in out[i] for k in range(x, y)] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([own["d"][i] for i in keep], pa.int64()), pa.array([own["t"][i] for i in keep], pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array([len(out[i]) for i in keep], pa.int32())], names=["d", "t", "places", "blocks"])

    key = [F.col(id_column).cast("long").alias("d"), F.xxhash64(F.col(text_column)).alias("t")]
    lines = docs.where(F.length(text_column) > 0).select(*key, F.col(text_column).alias("text"))
    lines = scratch.write(lines.mapInArrow(split, "d long, t long, hashes array<long>, words array<int>"), "lines")
    held = lines.select("d", "t", F.explode(F.array_distinct("hashes")).alias("h")).where("h <> 0")
    held = held.unionByName(lines.select("d", "t", "hashes", "words").mapInArrow(runs, "d long, t long, runs array<long>").select("d", "t", F.explode("runs").alias("h")))
    heads = held.groupBy("h").agg(F.min(F.struct("d", "t")).alias("head"), F.max(F.struct("d", "t")).alias("tail")).where("NOT (head <=> tail)").select("h", "head")
    pairs = held.join(heads, "h").where("NOT (head <=> struct(d, t))").select("d", "t", F.col("head.d").alias("hd"), F.col("head.t").alias("ht")).distinct()
    pairs = scratch.write(pairs, "pairs")
    one = lines.dropDuplicates(["d", "t"])
    later = one.select(F.col("d").alias("ld"), F.col("t").alias("lt"), F.col("hashes").alias("b"), "words")
    first = one.select(F.col("d").alias("fd"), F.col("t").alias("ft"), F.col("hashes").alias("a"))
    both = pairs.join(later, F.col("d").eqNullSafe(F.col("ld")) & (F.col("t") == F.col("lt"))).join(first, F.col("hd").eqNullSafe(F.col("fd")) & (F.col("ht") == F.col("ft")))
    deleted = both.select("d", "t", "a", "b", "words").mapInArrow(align, "d long, t long, places array<int>, blocks int")
    deleted = deleted.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.sum("blocks").cast("int").alias("blocks"))
    deleted = scratch.write(deleted, "deleted").select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("places").alias("__places"), F.col("blocks").alias("__blocks"))
    scratch.drop("lines", "pairs")

    # always by shuffling: a plan that changes with the size of what repeats could not be foreseen
    rows = docs.join(deleted.hint("merge"), F.col(id_column).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col(text_column)) == F.col("__t")), "left")
    texts = [f.name for f in docs.schema]
    place, marks = texts.index(text_column), len(texts)

    def cut(batches):
        for batch in batches:
            out, total, gone = [], [], []
            for text, places in zip(batch.column(place).to_pylist(), batch.column(marks).to_pylist()):
                own = [] if text is None else text.split("\n")
                total.append(len(own))
                gone.append(len(places or ()))
                if places:
                    drop = set(places)
                    text = "\n".join(line for k, line in enumerate(own) if k not in drop)
                out.append(text)
            columns = batch.columns[:marks]
            columns[place] = pa.array(out, batch.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(gone, pa.int32()), batch.column(marks + 1)], names=[*texts, "lines_total", "lines_deleted", "blocks_deleted"])

    schema = StructType(list(docs.schema)).add("lines_total", "integer").add("lines_deleted", "integer").add("blocks_deleted", "integer")
    rows = rows.select(*[F.col(c) for c in texts], "__places", F.coalesce("__blocks", F.lit(0)).alias("__blocks"))
    return rows.mapInArrow(cut, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps: counts and a digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "lines_total", "lines_deleted", "blocks_deleted", F.sha2("text", 256).alias("text_sha256"))
