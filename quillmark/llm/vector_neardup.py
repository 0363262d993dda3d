"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, connected_components, star_edges


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def passes_needed(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes after which a pair at ``cosine`` has met in a window with probability ``recall``.

    A random hyperplane separates the pair with probability acos(cosine) / pi;
    the pair meets if it agrees on the bits that narrow n vectors to a window.
    """
    bits = max(0.0, math.log2(max(1.0, 2 * n / window)))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if meets > 0.999 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, window: int = 512, recall: float = 0.995, hash_bits: int = 48, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding", block: int = 1024, chunk: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class (their smallest id stands for it).  Each pass
    orders the classes of one length by ``hash_bits`` signs of random
    projections, read as one number, cuts the order into ranges that overlap by
    ``window`` places and compares each class with its next ``window``
    neighbours in double precision.  The number of passes follows from the
    number of classes and ``recall``, as if the classes were spread evenly.
    Where they are not, a row shares more bits with its whole window; each pass
    measures how many, which gives the chance that the row has met a neighbour
    at ``cosine`` in any pass.  Rows whose chance is below ``recall`` are
    crowded: all of them are compared with each other in blocks of ``chunk``,
    exactly.  A pair with one row that is not crowded has that row's chance.
    Verified pairs of all passes form components; links all lie within a
    component, so n_links is counted there against every member, in blocks.
    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, vectors of different lengths not with each other; all of
    them, and rows with null ids, still have a row.  A repeated id is a row of
    its own, equal codes are ordered by class, and columns besides the id and
    the vector are not read.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    # single precision stays as it is stored; every product is one of doubles
    element = vectors.schema[vector_column].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    v = F.col(vector_column).cast(kind)
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    rows = scratch.write(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "rows")
    # classes of equal vectors; a null id cannot stand for one unless all are null
    groups = rows.where("v IS NOT NULL").groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = scratch.write(groups.withColumn("cid", F.monotonically_increasing_id()), "classes")
    classes = groups.count()
    order_bits = min(62, hash_bits)
    passes = passes_needed(classes, window, cosine, recall) if classes > 1 else 0

    def sketch(batches):
        """Every pass's code of each vector."""
        powers = (1 << np.arange(order_bits - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            for own in _by_length(batch):
                m = _matrix(own.column(1))
                codes = [((m @ np.random.default_rng([seed, number]).standard_normal((m.shape[1], order_bits))) > 0).astype(np.int64) @ powers for number in range(passes)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *map(pa.array, codes)], names=["cid", "v", *code_names])

    code_names = [f"code_{number}" for number in range(passes)]

    def neighbours(number: int):
        return lambda batches: _neighbours(batches, number)

    def measured(ids, shared, number):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, number, np.int32)), pa.array(shared.astype(np.int32))], names=found_names)

    def _neighbours(batches, number):
        """Pairs within ``window`` places; a range is sorted, its last rows come again at the next one's head.
        Then every row's leading bits that a row ``window`` places away shares, -1 if there is none."""
        ids, mats, codes, shared = (np.zeros(0, np.int64),) * 4
        for batch in batches:
            for own in _by_length(batch):
                new = _unit(_matrix(own.column(1)))
                if len(ids) and mats.shape[1] != new.shape[1]:  # another length begins
                    yield measured(ids, shared, number)
                    ids = codes = shared = np.zeros(0, np.int64)
                if not len(ids):
                    mats = np.zeros((0, new.shape[1]))
                new_ids, new_codes = own.column(0).to_numpy(), own.column(2).to_numpy()
                for a in range(0, len(new), window):
                    part, part_ids = new[a : a + window], new_ids[a : a + window]
                    every, every_ids = np.concatenate([mats, part]), np.concatenate([ids, part_ids])
                    at = np.arange(len(part)) + len(ids)
                    close = part @ every.T >= cosine
                    gap = at[:, None] - np.arange(len(every))[None, :]
                    close &= (gap > 0) & (gap <= window)
                    i, j = np.nonzero(close)
                    if len(i):
                        # a star from each of the block's components says the same
                        member, centre = star_edges(at[i], j, len(every))
                        n = len(member)
                        yield pa.RecordBatch.from_arrays([pa.array(every_ids[member]), pa.array(every_ids[centre]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=found_names)
                    every_codes = np.concatenate([codes, new_codes[a : a + window]])
                    shared = np.concatenate([shared, np.full(len(part), -1)])
                    far = at[at >= window]
                    same = order_bits - np.frexp((every_codes[far] ^ every_codes[far - window]).astype(np.float64))[1]
                    np.maximum.at(shared, far, same)
                    np.maximum.at(shared, far - window, same)
                    if len(every) > window:
                        yield measured(every_ids[:-window], shared[:-window], number)
                    mats, ids, codes, shared = every[-window:], every_ids[-window:], every_codes[-window:], shared[-window:]
        yield measured(ids, shared, number)

    found_names = ["a", "b", "number", "shared"]
    pairs = None
    if passes:
        coded = scratch.write(groups.select("cid", "v").mapInArrow(sketch, f"cid long, v {kind}, " + ", ".join(f"{c} long" for c in code_names)).withColumn("length", F.size("v")), "coded")
        # at least 4 windows to a range, at most 64
        parts = max(math.ceil(classes / (64 * window)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), classes // (4 * window)), 1)
        cuts = coded.approxQuantile(code_names, [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else [[]] * passes
    for number in range(passes):
        # ranges of the order, each with the head of the next one as its tail
        bounds = sorted({int(b) for b in cuts[number]})
        code = F.col(code_names[number])
        part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < code)) if bounds else F.lit(0)
        dealt = coded.select("cid", "v", code.alias("code"), "length", part.alias("part"))
        if bounds:
            heads = dealt.withColumn("n", F.row_number().over(_by_part())).where(F.col("n") <= window).where("part > 0").select("cid", "v", "code", "length", (F.col("part") - 1).alias("part"))
            dealt = dealt.unionByName(heads)
        ranged = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("length", "code", "cid")
        found = ranged.select("cid", "v", "code").mapInArrow(neighbours(number), "a long, b long, number int, shared int")
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = spark.createDataFrame([], "a long, b long")
    else:
        found = scratch.write(pairs, "found")
        # -log of the chance to miss a neighbour in a pass, by the bits shared across the window
        agrees = 1 - math.acos(cosine) / math.pi
        sure = [-math.log(max(1e-300, 1 - agrees**bits)) for bits in range(order_bits + 1)] + [0.0]
        chance = F.element_at(F.array(*[F.lit(x) for x in sure]), F.col("shared") + 2)
        rows_seen = found.where("b IS NULL").repartition("a").groupBy("a", "number").agg(F.max("shared").alias("shared"))
        open_ = rows_seen.groupBy("a").agg(F.sum(chance).alias("sure")).where(F.col("sure") < -math.log(1 - recall))
        crowded = scratch.write(groups.select("cid", "v").join(open_.select(F.col("a").alias("cid")), "cid", "left_semi"), "crowded")
        chunks = math.ceil(crowded.count() / chunk)
        pairs = found.where("b IS NOT NULL").select("a", "b")
        if chunks:
            dealt = crowded.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            dealt = dealt.select("cid", "v", F.size("v").alias("length"), "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
            pairs = pairs.unionByName(dealt.groupBy("length", "x", "y").applyInArrow(_all_pairs(cosine, block), "a long, b long"))
    components = connected_components(spark, pairs, scratch)
    components = scratch.write(components.withColumnRenamed("id", "cid"), "components")
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    linked = groups.join(components, "cid").join(sizes, "component")
    linked = linked.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / block)).cast("int"))
    linked = scratch.write(linked.select("cid", "v", "copies", "component", "chunk", F.ceil(F.col("size") / block).cast("int").alias("chunks")), "linked")

    counted = _link_counter(cosine)
    sides = linked.select("component", "cid", "v", "copies", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    sides = sides.select(
        "component", "cid", "v", "copies", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk"
    )
    links = sides.groupBy("component", "x", "y").applyInArrow(counted, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    roots = groups.join(components, "cid").groupBy("component").agg(F.min("rep").alias("root"))
    known = groups.select("cid", "key", F.col("v").alias("gv"), "copies", "rep").join(components, "cid", "left").join(roots, "component", "left").join(links, "cid", "left")
    known = known.select("key", "gv", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    known = scratch.write(known.select("key", "gv", "n_links", "component_id"), "known")
    out = rows.join(known, (rows["key"] == known["key"]) & (rows["v"] == known["gv"]), "left")
    component = F.coalesce(F.when(F.col("v").isNotNull(), F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _by_part():
    return Window.partitionBy("part", "length").orderBy("code", "cid")


def _by_length(batch: pa.RecordBatch):
    """Stretches of a batch (vectors second) whose vectors have one length."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _all_pairs(cosine: float, block: int):
    """Stars of the pairs between two chunks, or within one, tile by tile."""

    def compare(table: pa.Table) -> pa.Table:
        m = _unit(_matrix(table["v"].combine_chunks()))
        cid, chunk, x, y = (table[c].to_numpy() for c in ("cid", "chunk", "x", "y"))
        one = x[0] == y[0]
        left = np.flatnonzero(chunk == x[0])
        right = left if one else np.flatnonzero(chunk == y[0])
        ends, centres = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(left), block):
            for b in range(a if one else 0, len(right), block):
                own, their = left[a : a + block], right[b : b + block]
                i, j = np.nonzero(m[own] @ m[their].T >= cosine)
                member, centre = star_edges(i, j + len(own), len(own) + len(their))
                both = np.concatenate([cid[own], cid[their]])
                ends.append(both[member])
                centres.append(both[centre])
        ends, centres = np.concatenate(ends), np.concatenate(centres)
        differ = ends != centres
        return pa.table({"a": pa.array(ends[differ]), "b": pa.array(centres[differ])})

    return compare


def _link_counter(cosine: float):
    """Counts links between two chunks of a component, or within one."""

    def count(table: pa.Table) -> pa.Table:
        m = _unit(_matrix(table["v"].combine_chunks()))
        cid, copies, chunk, x, y = (table[c].to_numpy() for c in ("cid", "copies", "chunk", "x", "y"))
        if x[0] == y[0]:
            close = m @ m.T >= cosine
            np.fill_diagonal(close, False)
            n = close @ copies
        else:
            left, right = np.flatnonzero(chunk == x[0]), np.flatnonzero(chunk == y[0])
            close = m[left] @ m[right].T >= cosine
            n = np.zeros(len(m), np.int64)
            n[left], n[right] = close @ copies[right], copies[left] @ close
        return pa.table({"cid": pa.array(cid), "n": pa.array(n.astype(np.int64))})

    return count


def op5_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
