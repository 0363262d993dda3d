"""N-gram Jaccard self-join by prefixes of token combinations.

A document's tokens are its word shingles.  Tokens are ordered by how many
different sets hold them, rare ones first.  Two sets whose similarity reaches
the threshold share a token in the prefixes of length ``e + 1``, where ``e`` is
the number of tokens a set may have outside the other; so a token held by one
set alone needs no index entry, and most documents drop out at once.

* Rare tokens (held by at most ``rare`` sets) are indexed on their own.
* Frequent tokens are indexed as pairs.  The prefix grows to ``e + c + 1``
  tokens, of which ``c + 1`` are shared; tokens are dealt into ``c`` colours by
  hash, so two shared ones have one colour, and only pairs of one colour are
  indexed.  With ``c = e`` their number stays in proportion to the prefix.

Candidates of one index entry are first verified against its head, the set with
the fewest tokens of its own.  Where an entry then still spans several
components, its sets are compared with each other by what sets them apart from
the head: the symmetric difference of two sets is that of their differences
from any third one, and among near copies these are short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import LOWER_VALUE, U64, Scratch, connected_components, doc_slices, forget, mix, span_hashes, star_edges, text_bytes, window_hashes, word_spans

def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle values of each text, how many each text
    has, and how many distinct shingles (told apart by 64 bits).

    Fewer than ``size`` words are one shingle; no words, none.
    """
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, LOWER_VALUE)
    value, at = window_hashes(words, doc, size)
    owner = doc[at]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        own = []
        for d, f in zip(short.tolist(), first.tolist()):
            h = mix(words[f : f + 1] + U64(count[d]))
            for w in words[f + 1 : f + count[d]]:
                h = mix(h * U64(0x9FB21C651E98DF25) + w)
            own.append(h[0])
        value, owner = np.concatenate([value, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    other = np.ones(len(value), bool)
    other[1:] = owner[1:] != owner[:-1]
    keep = other.copy()
    keep[1:] |= value[1:] != value[:-1]
    shingles = np.bincount(owner[keep], minlength=n)
    value = value >> U64(16)
    keep = other
    keep[1:] |= value[1:] != value[:-1]
    return value[keep], np.bincount(owner[keep], minlength=n), shingles


def _pack(value: np.ndarray) -> bytes:
    """48-bit values as six planes of bytes; those of sorted values compress."""
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8")[:, 0]


def allowed(n: int, threshold: int) -> int:
    """Tokens of a set of n that may lie outside a similar set."""
    return n - -(-threshold * n // 100)


def _size_class(n: int, threshold: int) -> int:
    return int(math.log(n) / -math.log(threshold / 100) + 1e-9)


def index_keys(value: np.ndarray, df: np.ndarray, threshold: int, rare: int) -> list[int]:
    """Index entries of one set: sorted tokens and how many sets hold each."""
    n = len(value)
    if n < 2:  # equal to a similar set, so of its class already
        return []
    e = allowed(n, threshold)
    order = np.lexsort((value, df))
    value, df = value[order], df[order]
    head, head_df = value[: e + 1], df[: e + 1]
    keys = [int(k) for k in mix(head[(head_df > 1) & (head_df <= rare)]).astype(np.int64)]
    if head_df[-1] <= rare:
        return keys
    # frequent tokens in the prefix: pairs of one colour, for this size class and the next
    for c in (_size_class(n, threshold), _size_class(n, threshold) + 1):
        colours = max(1, allowed(int((100 / threshold) ** c), threshold))
        own = value[: e + colours + 1][df[: e + colours + 1] > rare]
        colour = mix(own + U64(c)) % U64(colours)
        order = np.lexsort((own, colour))
        own, colour = own[order], colour[order]
        step = 1
        while step < len(own):
            same = np.flatnonzero(colour[:-step] == colour[step:])
            if not len(same):
                break
            pairs = mix(mix(own[same] + U64(c)) * U64(3) + own[same + step])
            keys += [int(k) for k in pairs.astype(np.int64)]
            step += 1
    return keys


def ngram_components(docs: DataFrame, size: int = 4, threshold: int = 85, rare: int = 16, block_bytes: int = 1 << 24, bucket_tokens: int = 1 << 20, chunk_rows: int = 1024, chunk_tokens: int = 1 << 19, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Links: 100 * shared >= ``threshold`` * united tokens.  Texts with equal
    sets are one class from the start.  A text without words, or a null, has
    no tokens and is its own component.  Rows with repeated ids are documents
    of their own; a component's id is the smallest id in it that is not null.
    Columns besides the id and the text are not read; an empty table gives no
    rows.  With ``row_column`` (a binary key of the row) that column comes too,
    and ``component``: equal for the rows of one component and for no others,
    null for rows without tokens.

    Sets are hashed into a bucketed table of blocks (some megabytes of text
    each).  A block sends each token once, however many of its documents hold
    it, so no token meets one task more often than there are blocks; the counts
    come back by block and join its bucket without moving the sets again.
    The sets of an index entry are verified against the entry's head.  Sets of
    entries that still span several components are dealt, head by head, to
    chunks of about ``chunk_rows`` sets or ``chunk_tokens`` tokens of
    difference; each task counts the overlaps between two chunks exactly and
    returns a star for each component that it finds, so no link between
    components is lost and no pair without a link leaves a task.  Two chunks of
    sets that all link with the head do not meet.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    table = "quillmark_sets_" + scratch.root.rsplit("-", 1)[1]
    try:
        return _components(docs, scratch, table, size, threshold, rare, block_bytes, bucket_tokens, chunk_rows, chunk_tokens, id_column, text_column, row_column)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _components(docs, scratch, table, size, threshold, rare, block_bytes, bucket_tokens, chunk_rows, chunk_tokens, id_column, text_column, row_column) -> DataFrame:
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # 1. sets by block -----------------------------------------------------
    def blocks(batches):
        forget()
        part, number = TaskContext.get().partitionId(), 0
        held: dict[bytes, list] = {}
        used = 0

        def close():
            nonlocal number, held, used
            rows = sorted(held.items())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 20) + number] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([v[3] for _, v in rows], pa.int64()),
                    pa.array([v[1] for _, v in rows], pa.list_(pa.int64())), pa.array([v[2] for _, v in rows], pa.list_(pa.binary())), pa.array([v[0] for _, v in rows], pa.binary()),
                ],
                names=["block", "set_key", "n", "ids", "keys", "tokens"],
            )
            number, held, used = number + 1, {}, 0
            return out

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in doc_slices(offsets):
                value, count, shingles = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                first = np.cumsum(count) - count
                finger = mix(value + U64(0x5851F42D4C957F2D))
                for d in range(b - a):
                    own = slice(first[d], first[d] + count[d])
                    key = b"" if not count[d] else b"%d:%d:%d" % (count[d], finger[own].sum(), np.bitwise_xor.reduce(mix(value[own])))
                    if key in held:
                        held[key][1].append(ids[a + d])
                        held[key][2].append(keys[a + d])
                    else:
                        held[key] = [_pack(value[own]), [ids[a + d]], [keys[a + d]], int(shingles[d])]
                used += int(offsets[b] - offsets[a])
                if used >= block_bytes:
                    yield close()
        if held:
            yield close()

    own_key = F.col(row_column).cast("binary") if row_column else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), own_key.alias("row_key"))
    made = rows.mapInArrow(blocks, "block long, set_key binary, n long, ids array<long>, keys array<binary>, tokens binary")
    made.write.bucketBy(max(8, shuffle), "block").sortBy("block").option("path", scratch.path("sets")).option("compression", "zstd").format("parquet").saveAsTable(table)
    sets = spark.table(table)
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))

    # 2. how many sets hold each token: counts go back to the blocks ----------
    def send(batches):
        """Each block's distinct tokens with the number of its sets, by bucket."""

        def close(block, blobs):
            value = np.concatenate([_unpack(b) for b in blobs]) if blobs else np.zeros(0, np.uint64)
            value, count = np.unique(value, return_counts=True)
            bucket = (value >> U64(16)).astype(np.int64) * buckets >> 32
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            parts = [slice(cuts[i], cuts[i + 1]) for i in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int64)), pa.array([block] * len(full), pa.int64()), pa.array([_pack(value[s]) for s in parts], pa.binary()), pa.array([np.minimum(count[s], 255).astype(np.uint8).tobytes() for s in parts], pa.binary())],
                names=["bucket", "block", "tokens", "counts"],
            )

        now, blobs = None, []
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now and blobs:
                    yield close(now, blobs)
                    blobs = []
                now = block
                blobs.append(blob)
        if blobs:
            yield close(now, blobs)

    def count(table: pa.Table) -> pa.Table:
        """Tokens of each block that more than one set holds, with their numbers."""
        blocks_, blobs, counts = (table[c].to_pylist() for c in ("block", "tokens", "counts"))
        values = [_unpack(b) for b in blobs]
        every = np.concatenate(values)
        own = np.concatenate([np.frombuffer(c, np.uint8) for c in counts]).astype(np.int64)
        distinct, back = np.unique(every, return_inverse=True)
        df = np.minimum(np.bincount(back, own), 2**31).astype(np.int64)[back]
        out, at = {"block": [], "tokens": [], "df": []}, 0
        for block, value in zip(blocks_, values):
            shared = df[at : at + len(value)]
            at += len(value)
            keep = shared > 1
            if keep.any():
                out["block"].append(block)
                out["tokens"].append(_pack(value[keep]))
                out["df"].append(shared[keep].astype("<u4").tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "df": pa.array(out["df"], pa.binary())})

    # rows of one block lie together within a file, and a file is read in order
    sent = sets.select("block", "tokens").where("n > 0")
    sent = sent.mapInArrow(send, "bucket long, block long, tokens binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "block long, tokens binary, df binary")

    # 3. index entries of the sets that may have a partner --------------------
    def choose(key, left: pa.Table, right: pa.Table) -> pa.Table:
        values = [_unpack(b) for b in right["tokens"].to_pylist()]
        token = np.concatenate(values) if values else np.zeros(0, np.uint64)
        df = np.concatenate([np.frombuffer(b, "<u4") for b in right["df"].to_pylist()]).astype(np.int64) if values else np.zeros(0, np.int64)
        order = np.argsort(token)
        token, df = token[order], df[order]
        out = {"set_key": [], "n": [], "alone": [], "rep": [], "tokens": [], "keys": []}
        for set_key, ids, blob in zip(*(left[c].to_pylist() for c in ("set_key", "ids", "tokens"))):
            value = _unpack(blob)
            own = np.ones(len(value), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, value), len(token) - 1)
                own = np.where(token[at] == value, df[at], 1)
            found = index_keys(value, own, threshold, rare)
            if found:
                known = [i for i in ids if i is not None]
                out["set_key"].append(set_key)
                out["n"].append(len(value))
                out["alone"].append(int((own <= 1).sum()))
                out["rep"].append(min(known) if known else None)
                out["tokens"].append(_pack(value[own > 1]))  # the others are in no other set
                out["keys"].append(found)
        kinds = {"set_key": pa.binary(), "n": pa.int64(), "alone": pa.int64(), "rep": pa.int64(), "tokens": pa.binary(), "keys": pa.list_(pa.int64())}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    choices = sets.where("n > 0").select("block", "set_key", "ids", "tokens").groupBy("block").cogroup(answers.groupBy("block"))
    chosen = choices.applyInArrow(choose, "set_key binary, n long, alone long, rep long, tokens binary, keys array<long>")
    chosen = scratch.write(chosen, "chosen")
    # the same set from several blocks is one candidate; its number stands for the class
    members = sets.select("set_key", "n", F.explode(F.arrays_zip("ids", "keys")).alias("row")).select("set_key", "n", F.col("row.ids").alias("doc_id"), F.col("row.keys").alias("row_key"))
    members = scratch.write(members, "members")
    one = Window.partitionBy("set_key").orderBy("rep")
    grouped = chosen.withColumn("one", F.row_number().over(one)).where("one = 1")
    cands = scratch.write(grouped.select(F.monotonically_increasing_id().alias("cid"), "set_key", "n", "alone", "tokens", "keys"), "cands")
    entries = cands.select("cid", "n", "alone", F.explode(F.array_distinct("keys")).alias("key"))
    entries = scratch.write(entries, "entries")

    # 4. stars around the entries' heads, then whatever they leave open ---------
    # the fewer tokens of its own a set has, the nearer it is to the middle of its copies
    keyed = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("alone", "cid", "n")).alias("head")).where("m > 1")
    keyed = scratch.write(keyed, "heads")
    # tokens of one's own cannot be shared
    most = F.least(F.col("n") - F.col("alone"), F.col("head.n") - F.col("head.alone"))
    stars = entries.join(keyed, "key").where("cid <> head.cid").where(100 * most >= threshold * (F.col("n") + F.col("head.n") - most))
    stars = stars.select(F.col("head.cid").alias("a"), F.col("cid").alias("b")).distinct()
    links = scratch.write(_verify(stars, cands, threshold), "stars")
    labels = scratch.write(connected_components(spark, links, scratch, "cc_stars"), "labels")
    # an entry of two sets is settled; so is one of a single component
    named = entries.join(keyed.where("m > 2").select("key", F.col("head.cid").alias("h")), "key")
    named = named.join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").select("key", "h", "cid", F.coalesce("component", "cid").alias("component"))
    named = scratch.write(named, "named")
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    opened = named.join(several, "key", "left_semi").select("h", "cid", "component").distinct()
    opened = scratch.write(_differences(opened, cands), "opened")
    # sets of the head's own component need only meet the others
    mine = opened.where("cid = h").select("h", F.col("component").alias("hc"))
    opened = opened.join(mine, "h").select("h", "cid", "n", "alone", "component", "apart", (F.col("component") == F.col("hc")).alias("near"))
    weight = F.greatest(F.count(F.lit(1)) / chunk_rows, F.sum(F.octet_length("apart")) / (6 * chunk_tokens))
    counts = opened.groupBy("h", "near").agg(F.ceil(weight).cast("int").alias("chunks"))
    counts = counts.groupBy("h").agg(F.coalesce(F.max(F.when(F.col("near"), F.col("chunks"))), F.lit(0)).alias("inner"), F.coalesce(F.max(F.when(~F.col("near"), F.col("chunks"))), F.lit(0)).alias("outer"))
    dealt = opened.join(counts.where("outer > 0"), "h")
    chunk = F.when(F.col("near"), F.pmod(F.xxhash64("cid"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("cid"), "outer")).cast("int")
    dealt = dealt.select("h", "cid", "n", "alone", "component", "apart", chunk.alias("chunk"), F.explode(F.sequence(F.when(F.col("near"), F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)).alias("other"))
    dealt = dealt.select("h", "cid", "n", "alone", "component", "apart", "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    second = scratch.write(dealt.groupBy("h", "x", "y").applyInArrow(_compare(threshold), "a long, b long"), "second")

    # 5. components of classes, then of rows -----------------------------------
    done = connected_components(spark, links.unionByName(second), scratch)
    done = scratch.write(done.join(cands.select(F.col("cid").alias("id"), "set_key"), "id").select("set_key", "component"), "done")
    classes = members.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("low")).join(done, "set_key", "left")
    lowest = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("root"))
    label = F.coalesce(F.col("component").cast("string").cast("binary"), "set_key").alias("label")  # a set's key holds colons, a number does not
    classes = classes.join(lowest, "component", "left").select("set_key", F.coalesce("root", "low").alias("root"), label)
    classes = scratch.write(classes, "classes")
    out = members.where("n > 0").join(classes, "set_key").select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), "row_key", "label")
    out = out.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("binary").alias("label")))
    extra = [F.col("row_key").alias(row_column), F.col("label").alias("component")] if row_column else []
    out = scratch.write(out.select("doc_id", "n_shingles", "component_id", *extra), "result")
    scratch.drop("sets", "chosen", "members", "cands", "entries", "heads", "stars", "labels", "named", "opened", "second", "done", "classes")
    return out


def _with_tokens(pairs: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, ...) with both sets: sizes, own tokens' numbers and shared tokens."""
    left = cands.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("alone").alias("aa"), F.col("tokens").alias("x"))
    right = cands.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("alone").alias("ba"), F.col("tokens").alias("y"))
    return pairs.join(right, "b").join(left, "a")


def _verify(pairs: DataFrame, cands: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the candidate pairs that link, by their whole sets."""

    def keep(batches):
        for batch in batches:
            an, bn = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shared = [len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            shared = np.array(shared, np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(100 * shared >= threshold * (an + bn - shared)))

    return _with_tokens(pairs, cands).select("a", "b", "an", "bn", "x", "y").mapInArrow(keep, "a long, b long")


def _differences(opened: DataFrame, cands: DataFrame) -> DataFrame:
    """(h, cid, component) with the set's size, its own tokens' number and, of
    the tokens that several sets hold, those in one of both sets only."""

    def apart(batches):
        for batch in batches:
            out = [_pack(np.setxor1d(_unpack(x), _unpack(y), assume_unique=True)) for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=["h", "cid", "component", "n", "alone", "apart"])

    both = _with_tokens(opened.select(F.col("h").alias("a"), F.col("cid").alias("b"), "component"), cands)
    return both.select("a", "b", "component", "bn", "ba", "x", "y").mapInArrow(apart, "h long, cid long, component long, n long, alone long, apart binary")


def overlaps(row: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int, heavy: int = 32, width: int = 1024) -> np.ndarray:
    """How many tokens each of the rows ``left`` shares with each of ``right``.

    (row, token) are the sets' members.  Tokens of ``heavy`` rows or more are
    counted by products of incidence matrices, ``width`` tokens at a time, the
    others pair by pair; each member takes part in fewer than ``heavy`` of those.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(rows, -1), np.full(rows, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    many = count >= heavy
    number = np.cumsum(many) - 1
    own = many[column]
    r, c = row[own], number[column[own]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for first in range(0, int(many.sum()), width):
        a, b = np.searchsorted(c, (first, first + width))
        marks = np.zeros((rows, width), np.float32)
        marks[r[a:b], c[a:b] - first] = 1
        out += marks[left] @ marks[right].T
    own = ~own & (count[column] > 1)
    r, c = row[own], column[own]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for step in range(1, heavy):
        same = np.flatnonzero(c[:-step] == c[step:]) if step < len(c) else ()
        if not len(same):
            break
        for i, j in ((r[same], r[same + step]), (r[same + step], r[same])):
            i, j = at_left[i], at_right[j]
            both = (i >= 0) & (j >= 0)
            np.add.at(out, (i[both], j[both]), 1)
    return out.astype(np.int64)


def _compare(threshold: int):
    """Links between two chunks of one head's sets, or within one: for each
    component that they make, its members with one of them."""

    def compare(table: pa.Table) -> pa.Table:
        cid, n, alone, component, chunk, x, y = (table[c].to_numpy() for c in ("cid", "n", "alone", "component", "chunk", "x", "y"))
        sets = [_unpack(b) for b in table["apart"].to_pylist()]
        length = np.array([len(s) for s in sets], np.int64)
        left = np.flatnonzero(chunk == x[0])
        right = left if x[0] == y[0] else np.flatnonzero(chunk == y[0])
        shared = overlaps(np.repeat(np.arange(len(sets)), length), np.concatenate(sets), left, right, len(sets))
        weight = length + alone
        apart = weight[left][:, None] + weight[right][None, :] - 2 * shared
        total = n[left][:, None] + n[right][None, :]
        linked = 100 * (total - apart) >= threshold * (total + apart)
        linked &= component[left][:, None] != component[right][None, :]
        i, j = np.nonzero(linked)
        member, centre = star_edges(left[i], right[j], len(sets))
        return pa.table({"a": pa.array(cid[member]), "b": pa.array(cid[centre])})

    return compare


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
