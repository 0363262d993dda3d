"""Search modes, reply rules, parsers, pooling, web sources and streams on small cases."""

import http.server
import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmark.config import ChunkConfig, RetrievalConfig
from quillmark.functions import answers, cleaning, context, models, references, replies
from quillmark.functions import text as T
from quillmark.operators import chunking, lexical, results, search_modes, store
from quillmark.plans import corpus
from quillmark.sources import pages, readers, tables, web
from quillmark.sources.workspace import Workspace
from quillmark.streaming import buffers


@pytest.fixture(scope="module")
def tool(spark):
    papers = spark.createDataFrame([("50-0101", "The Red House"), ("50-0101E", "The Red House Again"), ("51-0202", "A Blue Door"), ("52-0303", "a blue door")], "date_id string, title string")
    lines = {"50-0101": ["the red fox ran", "hell on earth, he said", "boy and girl"], "50-0101E": ["a girl may marry", "the boy would marry the girl"], "51-0202": ["blue", "doors 5%", "end"], "52-0303": ["x"]}
    paragraphs = spark.createDataFrame([(d, i + 1, "", t) for d, rows in lines.items() for i, t in enumerate(rows)], "date_id string, paragraph_no int, sub_id string, text string")
    chunks = paragraphs.select("date_id", F.concat("date_id", F.lit("_chunk_"), (F.col("paragraph_no") - 1).cast("string")).alias("chunk_id"), F.col("paragraph_no").alias("paragraph_start"), F.col("paragraph_no").alias("paragraph_end"), (F.col("paragraph_no") - 1).alias("chunk_index"), "text")
    semantic = lambda query, ids, limit: chunks.where("date_id = '51-0202'").select("chunk_id", F.lit(1).alias("rank")).limit(limit)
    return search_modes.Store(papers, paragraphs, chunks, semantic)


def found(rows):
    return [(r["date_id"], r["paragraph_no"]) for r in rows.collect()]


def test_quote_ladder(tool):
    step, rows = search_modes.search_quote(tool, '"hell on earth" marry boy girl')
    assert step == "phrase" and found(rows) == [("50-0101", 2)]
    step, rows = search_modes.search_quote(tool, '"no such" "boy would" "girl"')
    assert step == "phrase" and found(rows) == [("50-0101E", 2)]
    step, rows = search_modes.search_quote(tool, '"qqqq" "zzzz" "the" "yyyy"')
    assert step == "literal" and found(rows) == []
    step, rows = search_modes.search_quote(tool, '"qq11" "ma%ry" "b%y"')
    assert step == "phrase"  # the user's wildcards act
    step, rows = search_modes.search_quote(tool, "red fox")
    assert step == "literal" and found(rows) == [("50-0101", 1)]
    assert search_modes.search_quote(tool, "red fox", ["51-0202"])[1].isEmpty()
    step, rows = search_modes.search_quote(tool, "a story about somebody who walked through a coloured entrance")
    assert step == "semantic" and found(rows) == [("51-0202", 1), ("51-0202", 2), ("51-0202", 3)]
    assert search_modes.longest_first(["bb", "a", "ccc", "AA"]) == ["ccc", "AA", "bb"]


def test_documents_are_resolved(tool):
    p = tool.papers
    assert search_modes.resolve_documents(p, "50-0101") == (["50-0101"], "date_id")
    assert search_modes.resolve_documents(p, "50-01") == (["50-0101", "50-0101E"], "prefix")
    assert search_modes.resolve_documents(p, "99", "the red house") == (["50-0101"], "title_fallback")  # the only one of exactly this title
    assert search_modes.resolve_documents(p, "", "blue door") == (["52-0303"], "title")  # the latest
    assert search_modes.resolve_documents(p, "", "blue door", "1951") == (["51-0202"], "title")
    assert search_modes.resolve_documents(p, "99") == ([], "none")


def test_search_tool(tool):
    run = lambda mode, **a: search_modes.db_search(tool, mode, **a)
    assert found(run("read_range", date_id="50-0101", start=3, end=2)["rows"]) == [("50-0101", 2), ("50-0101", 3)]
    assert found(run("read_paragraph", date_id="51-0202", paragraph_no=1, context=1)["rows"]) == [("51-0202", 1), ("51-0202", 2)]
    assert found(run("read_head", date_id="50-01", limit=2)["rows"]) == [("50-0101", 1), ("50-0101E", 1)]
    assert [r["date_id"] for r in run("search_titles", title="red house")["rows"].collect()] == ["50-0101", "50-0101E"]
    assert run("read_range", date_id="99", start=1, end=2) == {"ok": False, "mode": "read_range", "error": "no such document"}
    assert run("search_quote")["error"] == "query is required" and run("nothing")["error"] == "unknown mode nothing"
    assert run("read_range", date_id="50-0101", start="1", end=2)["error"] == "start has to be int"
    rows = run("batch_read", requests=[{"date_id": "50-0101", "start": 1, "end": 1}, {"date_id": "none", "start": 1, "end": 1}, {"date_id": "52-0303", "start": 1, "end": 9}])["rows"]
    assert found(rows) == [("50-0101", 1), ("52-0303", 1)]
    mixed = run("batch_mixed", ops=[{"mode": "search_quote", "query": "fox"}, {"mode": "batch_mixed", "ops": []}, {"mode": "read_range", "date_id": "51-0202", "start": 1, "end": 1}])["rows"]
    assert [m["ok"] for m in mixed] == [True, False, True]
    g = {r["date_id"]: r for r in search_modes.grouped(tool.paragraphs, 2).collect()}
    assert g["50-0101"]["first"] == 1 and g["50-0101"]["last"] == 2 and g["50-0101"]["place"] == 1 and len(g["51-0202"]["paragraphs"]) == 2
    asked = tool.papers.limit(0).select(F.lit(1).alias("request_id"), F.lit(1).alias("a"), F.lit(1).alias("b"), "date_id")
    assert store.overlapping(tool.chunks, asked).count() == 0


def test_result_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    kept = spark.createDataFrame([(1, "50-0101", 1)], "query_id long, date_id string, group_pos int")
    fused = spark.createDataFrame([(1, "50-0101_chunk_1", 0.5, 1)], "query_id long, chunk_id string, rrf double, fused_pos int")
    decision = spark.createDataFrame([(1, False, None), (2, True, "no relevant chunks")], "query_id long, should_refuse boolean, reason string")
    units = spark.createDataFrame([("50-0101", i, f"50-0101_chunk_{i}", f"t{i}") for i in range(3)], "date_id string, chunk_index int, chunk_id string, text string")
    papers = spark.createDataFrame([], "date_id string, title string, source string, language string")
    paragraphs = spark.createDataFrame([("50-0101", 1), ("50-0101", 3)], "date_id string, paragraph_no int")
    out = {r["query_id"]: r for r in results.nested_result(queries, {"kept": kept, "fused": fused, "decision": decision}, units, papers, paragraphs, 1).collect()}
    assert out[2]["should_refuse"] and out[2]["groups"] is None and out[2]["group_count"] == 0
    g = out[1]["groups"][0]
    assert (g["title"], g["language"], g["min_no"], g["max_no"], g["best_score"]) == (None, "en", 1, 3, 0.5)
    assert [(c["chunk_index"], c["is_retrieved"], c["score"]) for c in g["chunks"]] == [(0, False, None), (1, True, 0.5), (2, False, None)]
    chunks = results.expanded_chunks(kept, fused, units, 1)
    assert results.render_context(chunks, papers).first()["context"] == "--- Context 1 ---\n[50-0101]\n[ ¶1]\nt0\n\n[*¶2]\nt1\n\n[ ¶3]\nt2"
    order = spark.createDataFrame([(1, "b", 1)], "query_id long, date_id string, pos int")
    groups = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (1, "c", 0.95)], "query_id long, date_id string, best_score double")
    assert [r["date_id"] for r in results.by_given_order(groups, order).orderBy("place").collect()] == ["b", "c", "a"]


def test_stored_index_equals_search(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red fox red"), (2, "the fox"), (3, ""), (4, None), (5, "blue")], "ord long, text string")
    asked = spark.createDataFrame([(1, "fox red red"), (2, "blue nothing"), (3, "")], "query_id long, text string")
    stored = lexical.StoredIndex.build(rows, str(tmp_path / "i")).search(asked)
    direct = lexical.search(rows, asked)
    key = lambda df: sorted((r["query_id"], r["rank"], r["ord"], round(r["score"], 9)) for r in df.collect())
    assert key(stored) == key(direct) and [r[:3] for r in key(direct)] == [(1, 1, 1), (1, 2, 2), (2, 1, 5)]
    assert lexical.StoredIndex(spark, str(tmp_path / "i")).stats()["n"] == 5
    assert lexical.search(rows, asked, config=RetrievalConfig(stop_words=("fox", "red"))).count() == 1
    assert spark.createDataFrame([("ﬁne Ⅳ",)], "t string").select(T.tokens(F.col("t"), compatibility=True)).first()[0] == ["fine", "iv"]


def test_fact_questions(spark):
    yes = ["What was his exact home street address?", "what model of car did he drive", "Which Cadillac model did the speaker own?", "what is the author's personal favorite hymn"]
    no = ["explain what model did he drive", "what is love", "What model did Henry drive?"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = [r[0] for r in df.select(T.specific_fact_match(F.col("t"))).collect()]
    assert all(got[: len(yes)]) and not any(got[len(yes) :]) and got[1] == "what model of car did he"
    assert df.limit(1).select(T.quote_intent(F.lit("what did the speaker say"), T.SUBJECT), T.quote_intent(F.lit("what did the speaker say"))).first()[:] == (True, False)
    assert spark.range(1).select(T.query_text(F.lit("  a  ﬁ \n b "))).first()[0] == "a fi b"


def test_ids_stay_unique(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a\nb", "en", "s", 3) for i in (0, 1, 38_304, 38_305, 76_608)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    units = corpus.units(spark, str(tmp_path)).collect()
    assert len({r["date_id"] for r in units}) == 5 and sorted(r["ord"] for r in units) == list(range(10))
    assert [r["ord"] for r in sorted(units, key=lambda r: (r["date_id"], r["chunk_index"]))] == list(range(10))


def test_reply_rules():
    rules = answers.ReplyRules(refusal="No.", refusal_phrases=("cannot answer your question based on",), scrub_phrases=((r"\bthe archive\b", "the documents"),), subject=r"\bthe speaker\b", note="Read on.")
    run = lambda t, **k: answers.finalize(t, rules=rules, **k)
    assert run("No.")[:2] == ("refusal", "No.") and run("I cannot answer your question based on this")[2] == ["refusal_style"]
    mode, text, issues = run("**Answer:**\nHe said so [T — 50-0101: ¶2].\nthe retrieval pipeline found it\n\n## Unverified things\nweb\n\n### References:\n- [T — 50-0101: ¶2]\n- [T — 50-0101: ¶9]")
    assert mode == "answer" and text.startswith("Answer:\n\nHe said so") and "pipeline" not in text
    assert text.index("References") < text.index("Reader Note") < text.index(answers.EXTERNAL) and "- [T — 50-0101: ¶2, ¶9]" in text
    assert issues == ["wording_scrubbed", "label_normalised", "note_added", "sections_reordered"]
    mode, text, issues = run("Answer:\nThe speaker lived there.\n\n## References\nnone")
    assert mode == "external" and text == f"Answer:\n\n{answers.EXTERNAL}\nThe speaker lived there." and issues == ["sections_without_citation", "moved_to_external"]
    assert run("Plain text.")[0] == "uncited" and run("Said in the archive.")[1] == "Said in the documents."
    assert run("Said.\n\nEvidence: [T — 50-0101: ¶2]")[1].startswith("Said. Evidence: [T")
    assert answers.EXTERNAL in run("Text.", external="web")[1] and answers.EXTERNAL not in run(f"Text.\n\n{answers.EXTERNAL}\nx", external="")[1]
    assert "empty_external_section" in run(f"Text.\n\n{answers.EXTERNAL}\nnone")[2]


def test_replies(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(replies.two_line_reply(F.lit("Answer: yes\nmore"), "m")) == "Answer:\nyes" and get(replies.two_line_reply(F.lit("Answer:\n\n yes "), "m")) == "Answer:\nyes"
    assert get(replies.two_line_reply(F.lit("first\nsecond"), "m")) == "Answer:\nfirst" and get(replies.two_line_reply(F.lit(None), "m")) == "Answer:\nm" and get(replies.two_line_reply(F.lit("Answer:"), "m")) == "Answer:\nm"
    assert get(replies.redact(F.lit("keep\nthe tool loop ran\nby the archive"), (r"\btool loop\b",), ((r"the archive", "it"),))) == "keep\nby it"
    assert get(replies.compliance(F.lit("Answer: x [T — 50-0101: ¶2]")))[:] == (True, False, True, True)
    assert get(replies.overrides_refusal(F.lit("which bible verse"), F.lit(True))) is False and get(replies.refusal_style(F.lit("I Cannot say"), ("i cannot",)))
    calls = spark.createDataFrame([("r", 2, "web", [("b", "u")]), ("r", 1, "web", [("a", ""), ("c", "v")]), ("r", 0, "other", [("d", "w")])], "request string, seq int, name string, sources array<struct<title: string, url: string>>")
    row = references.external_sources(calls, "web", "unverified").first()
    assert row["disclaimer"] == "unverified" and [s["title"] for s in row["sources"]] == ["c"]
    assert get(references.parse_reference(F.lit("x1"))) is None and get(references.suffix_rank(F.lit("ab"))) == 28 and get(references.suffix_rank(F.lit("A"))) is None
    with pytest.raises(PySparkException):
        references.required_attribute(spark.createDataFrame([("a",)], "date_id string"), spark.createDataFrame([("b", "t")], "date_id string, title string"), "title").collect()


def test_parse_rules():
    assert cleaning.looks_like_address("Gano Avenue, St. Louis") and not cleaning.looks_like_address("draw near, Lord")
    assert [cleaning.plausible_number(n, last) for n, last in ((3, None), (60, None), (4, 3), (5, 3), (1950, 1949), (0, None))] == [True, False, True, False, False, False]
    assert all(map(cleaning.looks_like_call, ("back to 100 maybe", "From 1 to 100 in A", "prayer card number U-75", "or 65 of you", "who has card", "50 to 65", "up to 100")))
    assert not any(map(cleaning.looks_like_call, ("Then somebody came", "to the first chapter", "who has believed", "")))
    text = "TITLE\n1 One.\n2 Two.\n\n7\n\n3a Three."
    assert [m[1:3] for m in cleaning.line_marks(text)] == [(1, ""), (2, ""), (7, ""), (3, "a")] and cleaning.last_mark(text) == (3, "a") and cleaning.last_mark("1 One.\n\n9\n\n") == (1, "")
    assert cleaning.coverage({1, 2, 3, 4}, {1, 2, 9}) == 0.5
    assert cleaning.strip_trailer("Amen.#\n50-0101 Place\nENGLISH", "50-0101", "#") == "Amen.#" and cleaning.strip_trailer("Amen.#\nmore text", "50-0101", "#") == "Amen.#\nmore text"


def test_strategy_and_rebalance(spark):
    text = "\n".join(f"{n} word word" for n in range(1, 15))
    assert chunking.choose_strategy(text) == "numbered" and chunking.choose_strategy("no numbers") == "blocks"
    assert chunking.choose_strategy(text + "\n99 beyond") == "blocks" and chunking.choose_strategy(text + "".join(f"\n{n} x" for n in (30, 32, 34, 36))) == "blocks"
    assert chunking.split_near("a b c. d e. f g h.", 4) == ("a b c.", "d e. f g h.") and chunking.split_near("a b c d", 3) == ("a b c", "d") and chunking.split_near("a", 0) == ("", "a")
    config = ChunkConfig(least=4, most=8)
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(k))
    out = chunking.rebalance([[("1", words(7))], [("2", words(4))], [("3", words(2))]], config)
    sizes = [sum(len(t.split()) for _, t in c) for c in out]
    assert all(4 <= n <= 8 for n in sizes) and sum(sizes) == 13 and [r for c in out for r, _ in c] == ["1a", "1b", "2a", "2b", "3"]
    assert " ".join(t for c in out for _, t in c) == " ".join((words(7), words(4), words(2)))
    with pytest.raises(ValueError):
        chunking.rebalance([[("1", "a b")]], config)
    parts = spark.createDataFrame([("d", 1, "b", "third"), ("d", 1, "", "first"), ("d", 1, "a", "second"), ("d", 2, "", "last")], "date_id string, paragraph_no int, sub_id string, text string")
    row = chunking.chunk_documents(parts).first()
    assert row["text"] == "first second third\nlast" and (row["ref_start"], row["ref_end"]) == ("1", "2")


def test_blocks_in_reading_order(spark):
    b = lambda page, x0, y0, x1, text: ("d", page, 600.0, 800.0, x0, y0, x1, y0 + 10, text)
    rows = [b(1, 320.0, 100.0, 580.0, "right 1"), b(1, 20.0, 200.0, 290.0, "left 2"), b(1, 20.0, 100.0, 290.0, "left 1"), b(1, 320.0, 200.0, 580.0, "right 2"), b(1, 20.0, 10.0, 580.0, "header"), b(1, 20.0, 790.0, 580.0, "footer"), b(2, 20.0, 300.0, 580.0, "wide 2"), b(2, 20.0, 100.0, 580.0, "wide 1")]
    df = spark.createDataFrame(rows, "date_id string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string")
    assert cleaning.order_blocks(df).first()["text"].split("\n") == ["left 1", "left 2", "right 1", "right 2", "wide 1", "wide 2"]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    row = df.select(models.mean_pool(F.col("v"), F.col("m")), models.last_token_pool(F.col("v"), F.col("m")), models.first_token_pool(F.col("v")), models.truncate_vector(F.col("v")[1], 1), models.instructed(F.lit("q"), "Do {task}: {query}!", "it")).first()
    assert list(row) == [[2.0, 2.0], [3.0, 4.0], [1.0, 0.0], [1.0], "Do it: q!"]
    say = models.completion(lambda: lambda messages: messages[-1]["content"].upper(), "test-upper")
    history = spark.createDataFrame([([("user", "a")], "q")], "h array<struct<role: string, text: string>>, q string")
    assert history.select(say(context.messages("s", F.col("h"), F.col("q")))).first()[0] == "Q"
    assert spark.range(1).select(models.summaries(F.lit('```json\n{"conversation_summary": " c ", "query_summary": ""}\n```'))).first()[0][:] == ("c", None)
    assert spark.range(1).select(T.retrieval_text(F.lit(" a  b "), F.lit("s"))).first()[0] == "a b\n\nConversation summary:\ns"
    assert spark.range(1).select(T.unit_number(F.lit("x_chunk_12")), T.unit_number(F.lit("x")), T.paragraph_number(F.lit("¶12b"))).first()[:] == (12, None, 12)


def test_web(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        tries: dict = {}

        def do_GET(self):  # noqa: N802
            self.tries[self.path] = self.tries.get(self.path, 0) + 1
            status = 200 if self.path == "/a" else 503 if self.path == "/late" and self.tries[self.path] < 3 else 200 if self.path == "/late" else 404
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(b"body")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{base}/{p}", f"{p}.bin") for p in ("a", "late", "none")], "url string, name string").coalesce(1)
        got = {r["url"].rsplit("/", 1)[1]: r for r in web.fetch(urls, pause=0.01).collect()}
        assert [got[p]["status"] for p in ("a", "late", "none")] == [200, 200, 404] and bytes(got["late"]["body"]) == b"body" and got["none"]["body"] is None
        assert sorted(r["status"] for r in web.download(urls, str(tmp_path), pause=0.01).collect()) == ["failed", "written", "written"]
        assert sorted(r["status"] for r in web.download(urls, str(tmp_path), pause=0.01).collect()) == ["failed", "kept", "kept"]
    finally:
        server.shutdown()


def test_page_sources(spark):
    df = spark.createDataFrame([("a", '<script>x="https://my.cdn.example/f/1.pdf"</script>'), ("b", "nothing")], "date_id string, html string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "date_id string")
    links = pages.resolve_links(ids, df)
    assert {r["date_id"]: r["link"] for r in links.collect()} == {"a": "https://my.cdn.example/f/1.pdf", "b": None, "c": None}
    assert {r["status"]: r["n"] for r in pages.fetch_status(ids, ids.where("date_id = 'c'"), links).collect()} == {"found": 1, "missing": 1, "skipped": 1}
    raw = spark.createDataFrame([("r", json.dumps({"organic": [{"title": "t", "link": "l", "snippet": "s"}] * 20}))], "request string, raw string")
    assert pages.web_results(raw, 99).count() == 10 and pages.web_results(raw, 0).first()["place"] == 1
    text = "retrieval:\n  k1: 1.5\n  mode: never  # note\n  deep:\n    on: true\nlist: [1, two]\nname: 'x y'\n"
    assert pages.configuration_file(text) == {"retrieval": {"k1": 1.5, "mode": "never", "deep": {"on": True}}, "list": [1, "two"], "name": "x y"}
    rows = pages.sections(spark.createDataFrame([("p", "=== SECTION: one ===\nfirst\n=== SECTION: two ===\nsecond")], "path string, text string"))
    assert pages.whole_section(rows).first()["text"] == "first\n\nsecond" and pages.whole_section(rows, 5).first()["text"] == "first..."


def test_tables_and_files(spark, tmp_path):
    units = spark.createDataFrame([("b", 0, "b_chunk_0", "tb"), ("a", 1, "a_chunk_1", "t1"), ("a", 0, "a_chunk_0", "t0")], "date_id string, chunk_index int, chunk_id string, text string")
    papers = spark.createDataFrame([("a", "A", "en"), ("b", "B", "en")], "date_id string, title string, language string")
    assert [r["text"] for r in tables.corpus_text(units, limit=2).collect()] == ["t0", "t1"]
    tables.export_training(units, papers, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/instruction_tune")).count() == 3 and spark.read.json(str(tmp_path / "x/manifest")).first()["documents"] == 2
    assert {n: d.count() for n, d in tables.subset({"units": units, "papers": papers}, papers.where("date_id = 'a'")).items()} == {"units": 2, "papers": 1}
    assert {r["title"] for r in tables.backfill_title(units.withColumn("title", F.lit("")), papers).collect()} == {"A", "B"}
    new = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "k string, n int")
    assert tables.upsert(new.limit(0), new, ["k"], "n").first()["n"] == 3
    tables.append_manifest(spark.createDataFrame([("a", "c")], "date_id string, content string"), str(tmp_path / "m"))
    assert len(readers.read_json_lines(spark, str(tmp_path / "m"), "date_id string, sha256 string").first()["sha256"]) == 64
    readers.write_json_lines(papers, str(tmp_path / "j"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/50-0101.txt").write_text("hello")
    assert readers.read_texts(spark, str(tmp_path / "f")).first()["text"] == "hello" and tables.scan_files(spark, str(tmp_path / "f"), "*.txt").first()["stem"] == "50-0101"
    vectors = spark.createDataFrame([(0, "a_chunk_0", [1.0])], "vec_id long, chunk_id string, vec array<double>")
    tables.save_vectors(vectors, str(tmp_path / "v"), {"n": 1})
    assert tables.load_ids(spark, str(tmp_path / "v")).first()["chunk_id"] == "a_chunk_0"
    work = Workspace(spark, "t")
    assert work.write(papers, "p").count() == 2
    work.close()


def test_stream_budget_and_sink(spark, tmp_path):
    schema = "request string, seq long, name string"
    for k, rows in enumerate(([("r", 1, "a"), ("r", 2, "a")], [("r", 3, "b"), ("r", 4, "a"), ("s", 5, "a")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = buffers.stream_budget(stream, 3, {"a": 2})
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["seq"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [seq for seq, _ in got] == [1, 2, 3, 4, 5] and dict(got)[5] and sum(ok for _, ok in got) == 4
    answers_ = spark.createDataFrame([(1, "x" * 50, None), (2, None, "broken"), (3, "", None)], "request long, answer string, error string")
    e = buffers.answer_events(answers_)
    seen = {}
    for r in e.orderBy("request", "seq").collect():
        seen.setdefault(r["request"], []).append(r["event"])
    assert seen == {1: ["start", "delta", "delta", "final", "done"], 2: ["start", "error"], 3: ["start", "final", "done"]}
    e.write.json(str(tmp_path / "e"))
    events = spark.readStream.schema("request long, seq int, event string, data string").json(str(tmp_path / "e"))
    buffers.event_sink(events, str(tmp_path / "sse"), str(tmp_path / "c2")).awaitTermination()
    assert sum(r["value"].startswith("event: ") for r in spark.read.text(str(tmp_path / "sse")).collect()) == 10
    calls = spark.createDataFrame([("r", 1, json.dumps({"choices": [{"delta": {"tool_calls": [{"index": 1, "id": "i", "function": {"name": "f", "arguments": "{"}}]}}]}))], "request string, seq long, chunk string")
    assert buffers.delta_calls(calls).first()[:] == ("r", 1, 1, "i", "f", "{")
