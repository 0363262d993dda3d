"""Sources, sinks, model slots and rendering on small frames."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quillmark.config import RetrievalConfig
from quillmark.functions import context, models
from quillmark.sources import pages, readers, tables


def test_upsert_replace_and_evolve(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "date_id string, n int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "date_id string, n int")
    assert sorted(map(tuple, tables.upsert(old, new, ["date_id"]).collect())) == [("a", 1), ("b", 5), ("c", 6)]
    path = str(tmp_path / "t")
    tables.replace_documents(spark, old, path)
    tables.replace_documents(spark, new.where("n = 5"), path)
    assert sorted((r["date_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]
    schema = StructType().add("date_id", StringType()).add("n", IntegerType()).add("language", StringType())
    assert tables.evolve(old, schema, {"language": "en"}).first()["language"] == "en"
    assert sorted(r["date_id"] for r in tables.not_yet_fetched(new, old).collect()) == ["c"]
    assert tables.changed(new.withColumn("t", F.lit(" x")), "t", F.trim("t")).count() == 2


def test_pages_and_links(spark):
    html = '<a href="/x.html">62-0128A</a> <a href="/d/1.pdf">Get PDF</a> 63-0801 62-0128A'
    df = spark.createDataFrame([(html,)], "html string")
    assert [r["date_id"] for r in pages.document_ids(df).collect()] == ["62-0128A", "63-0801"]
    assert [r["date_id"] for r in pages.document_ids(df, "1963").collect()] == ["63-0801"]
    assert df.select(pages.pdf_link(F.col("html"))).first()[0] == "/d/1.pdf"
    assert df.select(readers.links(F.col("html"))).first()[0] == ["/x.html", "/d/1.pdf"]


def test_sections(spark):
    df = spark.createDataFrame([("p", "skip\n=== SECTION: one ===\nfirst\nlines\n=== SECTION: two ===\nsecond")], "path string, text string")
    rows = pages.sections(df)
    assert {r["section"]: r["text"] for r in rows.collect()} == {"one": "first\nlines", "two": "second"}
    assert pages.section(rows, "two").first()["text"] == "second" and pages.section(rows, None, 5).first()["text"] == "first..."


def test_events_round_trip(spark):
    rows = spark.createDataFrame([("r", 0, "start", "{}"), ("r", 1, "delta", '{"a": 1}')], "request string, seq int, event string, data string")
    back = pages.parse_events(pages.format_events(rows))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_vectors_postings_and_config(spark, tmp_path, monkeypatch):
    v = spark.createDataFrame([(0, [1.0, 2.0], "a_chunk_0")], "vec_id long, vec array<float>, chunk_id string")
    tables.save_vectors(v, str(tmp_path / "v"), {"dim": 2})
    back, meta = tables.load_vectors(spark, str(tmp_path / "v"))
    assert back.first()["vec"] == [1.0, 2.0] and meta == {"dim": 2}
    p = spark.createDataFrame([("x", 1, 2), ("y", 1, 1), ("z", 2, 1)], "term string, doc_id long, tf int")
    readers.write_postings(p, str(tmp_path / "p"), 4)
    assert readers.read_postings(spark, str(tmp_path / "p"), ["x", "z"], 4).count() == 2
    monkeypatch.setenv("QUILLMARK_RRF_K", "10")
    config = pages.configure(RetrievalConfig(), {"max_groups": 3})
    assert (config.rrf_k, config.max_groups) == (10, 3)


def test_model_slots(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    vec = models.embedder(lambda: lambda texts: [[len(t), 1.0] for t in texts], "length")
    assert sorted(r[0] for r in df.select(vec("t")).collect()) == [[1.0, 1.0], [2.0, 1.0]]
    score = models.reranker(lambda: lambda pairs: [len(a) + len(b) for a, b in pairs], "sum")
    assert sorted(r[0] for r in df.select(score("t", "t")).collect()) == [2.0, 4.0]
    assert abs(df.select(models.yes_probability(F.lit(1.0), F.lit(1.0))).first()[0] - 0.5) < 1e-12


def test_rendering(spark):
    rows = spark.createDataFrame([(1, "d", 0, "near", False), (1, "d", 1, "hit", True)], "query_id int, date_id string, chunk_index int, text string, is_retrieved boolean")
    papers = spark.createDataFrame([("d", "Title")], "date_id string, title string")
    assert context.render_groups(rows, papers).first()["block"] == "### Title (d)\n¶1 near\n¶2 * hit"
    assert context.render_groups(rows, papers, True).first()["block"] == "### Title (d)\n¶2 * hit"
