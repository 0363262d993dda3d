"""What retrieval leaves on disk, and the row-wise search against the one with keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmark.config import RetrievalConfig
from quillmark.operators import fusion, lexical, results, store
from quillmark.plans import registry, registry_more  # noqa: F401

SF = "/root/testdata/sf0.001"


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["exact_match_promotion", "flat_hits", "llm_chunks", "neighbor_expand", "refusal", "rerank_apply", "retrieval_result", "ui_chunks", "collate_top8", "hybrid_retrieve", "language_report", "rrf_fuse", "source_overlap", "signals"])
def test_retrieval_shuffles_less_than_half_its_input(spark, name):
    before = _shuffled(spark)
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 2 * (_shuffled(spark) - before) < sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("documents", "embeddings"))


@pytest.mark.parametrize("scores, block, often", [(1 << 22, 10_000, 0.01), (40, 3, 2.0), (4_000, 3, 0.0)])
def test_row_search_equals_keyed_search(spark, monkeypatch, scores, block, often):
    monkeypatch.setattr(lexical, "SCORES", scores)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    monkeypatch.setattr(lexical, "OFTEN", often)
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 2) for _ in range(n))
    texts = [say(rnd.randint(0, 12)) for _ in range(300)] + ["same words here"] * 60 + ["", None]
    rows = spark.createDataFrame([(i, f"d{i // 7:03}", i % 7, t) for i, t in enumerate(texts)], "ord long, date_id string, chunk_index int, text string").repartition(3)
    asked = spark.createDataFrame([(i, say(4)) for i in range(7)] + [(100, "same same unheard"), (101, ""), (102, "unheard"), (103, None)], "query_id long, text string")
    config = RetrievalConfig(bm25_top=9)
    pick = lambda out: sorted((r["query_id"], r["rank"], r["ord"], round(r["score"], 9)) for r in out.collect())
    wanted = pick(lexical.search(rows, asked, config=config))
    found = lexical.search_rows(rows, asked, ["date_id", "chunk_index"], config=config)
    assert pick(found.withColumn("ord", F.substring("date_id", 2, 3).cast("long") * 7 + F.col("chunk_index"))) == wanted
    assert {q for q, *_ in wanted} == {*range(7), 100}


def test_numbers_find_their_units(spark):
    starts = spark.createDataFrame([("a", 3, 0), ("b", 0, 3), ("c", 250, 3), ("d", 1, 253)], "date_id string, n int, start long")
    rows = spark.createDataFrame([(n,) for n in (-1, 0, 2, 3, 99, 100, 252, 253, 254)], "number long")
    out = {r["number"]: (r["date_id"], r["chunk_index"]) for r in store.units_at(rows, "number", starts).collect()}
    assert out == {0: ("a", 0), 2: ("a", 2), 3: ("c", 0), 99: ("c", 96), 100: ("c", 97), 252: ("c", 249), 253: ("d", 0)}


def test_near_keys_keeps_every_wanted_row(spark, monkeypatch):
    rows = spark.range(20_000).select(F.concat(F.lit("d"), (F.col("id") % 200).cast("string")).alias("date_id"), F.floor(F.col("id") / 200).cast("int").alias("chunk_index"))
    wanted = spark.createDataFrame([(f"d{i % 200}", i // 200) for i in range(0, 20_000, 400)] + [(None, 1), ("d1", None), ("no", 1)], "date_id string, chunk_index long")
    for bits, most in ((1 << 28, 2_500), (64, 20_000)):
        monkeypatch.setattr(store, "BITS", bits)
        near = store.near_keys(rows, wanted, ["date_id", "chunk_index"])
        assert near.count() <= most
        assert near.join(wanted, ["date_id", "chunk_index"]).count() == 50
    assert store.near_keys(rows, wanted.limit(0), ["date_id", "chunk_index"]).count() == 0


@pytest.mark.parametrize("how", ["expand", "expanded_chunks", "decided"])
def test_expansion_shuffles_no_unwanted_text(spark, how):
    noise = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(8)])
    units = spark.range(4_000).select(F.concat(F.lit("50-"), F.floor(F.col("id") / 10).cast("string")).alias("date_id"), (F.col("id") % 10).cast("int").alias("chunk_index"), noise.alias("text"))
    units = units.withColumn("chunk_id", F.concat_ws("_chunk_", "date_id", F.col("chunk_index").cast("string")))
    fused = spark.createDataFrame([(1, "50-7_chunk_0", 0.5, 1), (1, "50-7_chunk_1", 0.4, 2), (2, "50-9_chunk_9", 0.3, 1), (2, "50-9_chunk_10", 0.2, 2)], "query_id long, chunk_id string, rrf double, fused_pos int")
    kept = spark.createDataFrame([(1, "50-7", 1), (2, "50-9", 1)], "query_id long, date_id string, group_pos int")
    decision = spark.createDataFrame([(1, False), (2, True)], "query_id long, should_refuse boolean") if how == "decided" else None
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for a broadcast
    try:
        before = _shuffled(spark)
        out = fusion.expand(fused, units, 1) if how == "expand" else results.expanded_chunks(kept, fused, units, 1, decision)
        found = {(r["query_id"], r["chunk_id"], r["is_retrieved"]) for r in out.collect() if len(r["text"]) == 1024}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        shuffled = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    last = {(2, "50-9_chunk_9", True)} if how == "decided" else {(2, "50-9_chunk_8", False), (2, "50-9_chunk_9", True)}
    assert found == {(1, "50-7_chunk_0", True), (1, "50-7_chunk_1", True), (1, "50-7_chunk_2", False)} | last
    assert 10 * shuffled < 4_000 * 1_024
