"""Further queries: whole results, search modes, reports, replies and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.config import RetrievalConfig
from quillmark.functions import answers, cleaning, references, replies
from quillmark.operators import chunking, dense, lexical, reports, results, search_modes
from quillmark.plans import corpus as C
from quillmark.plans.registry import DENSE, DOCS, HYBRID, LINES, ORACLES, QUERIES, UNITS, _HAS, _HOLES, _R, _COMPARING, _SCRIPTURE, _hybrid, _vector_queries, bm25_sql, count_sql, query, words_sql
from quillmark.sources import pages, tables
from quillmark.sources.workspace import Workspace
from quillmark.streaming import buffers

# --- whole results ---------------------------------------------------------------

KEPT = "kept AS (SELECT query_id, date_id, best_score, group_pos FROM grp WHERE group_pos <= 8 UNION ALL SELECT query_id, date_id, best_score, group_pos FROM prom)"
SCORED = """scored_chunks AS (SELECT query_id, regexp_extract(chunk_id, '^(.*)_chunk_', 1) AS date_id, CAST(regexp_extract(chunk_id, '_chunk_([0-9]+)$', 1) AS INT) AS place, chunk_id, rrf, fused_pos FROM fused)"""
REFUSED = "refused AS (SELECT query_id, (hits = 0 OR CASE WHEN lang = 'en' THEN dense_top < 0.2 AND bm25_top < 0.2 ELSE dense_top < 0.2 END) AS r FROM dec)"
LLM = f"""{KEPT}, {SCORED}, {REFUSED}, llm AS (SELECT query_id, group_pos, w.date_id, w.chunk_index, chunk_id, is_retrieved, score FROM (
  SELECT s.query_id, k.group_pos, s.date_id, s.place + d AS chunk_index, bool_or(d = 0) AS is_retrieved, max(CASE WHEN d = 0 THEN rrf END) AS score
  FROM scored_chunks s JOIN kept k ON s.query_id = k.query_id AND s.date_id = k.date_id JOIN refused f ON f.query_id = s.query_id, (SELECT unnest([-1, 0, 1]) AS d) WHERE d = 0 OR NOT r GROUP BY ALL) w JOIN units u ON u.date_id = w.date_id AND u.chunk_index = w.chunk_index)"""


@query(f"WITH {HYBRID}, {LLM} SELECT query_id, group_pos, date_id, CAST(chunk_index AS INT) AS chunk_index, chunk_id, is_retrieved, round(score, 9) AS score FROM llm")
def llm_chunks(spark, sf):
    """The kept groups' hits with their neighbours; a refused query's without."""
    h = _hybrid(spark, sf)
    out = results.expanded_chunks(h["kept"], h["fused"], h["units"], 1, h["decision"])
    return out.select("query_id", "group_pos", "date_id", "chunk_index", "chunk_id", "is_retrieved", F.round("score", 9).alias("score"))


@query(f"WITH {HYBRID}, {SCORED} SELECT s.query_id, s.date_id, group_pos, CAST(s.place AS INT) AS chunk_index, chunk_id, round(rrf, 9) AS score FROM scored_chunks s JOIN grp g ON s.query_id = g.query_id AND s.date_id = g.date_id")
def ui_chunks(spark, sf):
    """All groups' hits, uncapped and without neighbours."""
    h = _hybrid(spark, sf)
    return results.expanded_chunks(h["groups"], h["fused"], h["units"], 0).select("query_id", "date_id", "group_pos", "chunk_index", "chunk_id", F.round("score", 9).alias("score"))


@query(f"""WITH {HYBRID}, {LLM}, bnd AS (SELECT date_id, min(paragraph_no) AS min_no, max(paragraph_no) AS max_no FROM paras GROUP BY 1),
per AS (SELECT query_id, group_pos, date_id, max(CASE WHEN is_retrieved THEN score END) AS best, string_agg(chunk_id || CASE WHEN is_retrieved THEN '*' ELSE '' END, ',' ORDER BY chunk_index) AS chunks, count(*) AS n FROM llm GROUP BY ALL)
SELECT q.query_id, r AS should_refuse, coalesce(count(group_pos), 0) AS group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunk_count,
  string_agg(group_pos || '|' || p.date_id || '|' || title || '|' || source || '|' || language || '|' || min_no || '-' || max_no || '|' || chunks, ';' ORDER BY group_pos) AS digest
FROM qs q JOIN refused f ON f.query_id = q.query_id LEFT JOIN per p ON p.query_id = q.query_id LEFT JOIN docs d ON d.date_id = p.date_id LEFT JOIN bnd b ON b.date_id = p.date_id GROUP BY 1, 2""")  # fmt: skip
def retrieval_result(spark, sf):
    """The nested result, its groups written out in one line each."""
    h = _hybrid(spark, sf)
    out = results.nested_result(h["queries"], h, h["units"], C.papers(spark, sf), C.paragraphs(spark, sf), 1)
    chunk = lambda c: F.concat(c["chunk_id"], F.when(c["is_retrieved"], "*").otherwise(""))
    line = lambda g: F.concat_ws("|", g["group_pos"].cast("string"), g["date_id"], g["title"], g["source"], g["language"], F.concat(g["min_no"].cast("string"), F.lit("-"), g["max_no"].cast("string")), F.array_join(F.transform(g["chunks"], chunk), ","))
    return out.select("query_id", "should_refuse", "group_count", F.col("chunk_count").cast("long").alias("chunk_count"), F.array_join(F.transform("groups", line), ";").alias("digest"))


@query(f"WITH {HYBRID}, {SCORED} SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY group_pos, round(rrf, 15) DESC, fused_pos) AS place, chunk_id, round(rrf, 9) AS score FROM scored_chunks s JOIN grp g ON s.query_id = g.query_id AND s.date_id = g.date_id")
def flat_hits(spark, sf):
    """Groups' ranked chunks as one list."""
    h = _hybrid(spark, sf)
    ranked = results.ranked_chunks(h["fused"]).join(h["groups"].select("query_id", "date_id", "group_pos"), ["query_id", "date_id"])
    return results.flatten_hits(ranked).select("query_id", "place", "chunk_id", F.round("score", 9).alias("score"))


@query(f"WITH {HYBRID} SELECT lang, count(*) AS queries, count(*) FILTER (r) AS refused, round(avg(dense_std), 6) AS dense_std, round(avg(dense_top), 6) AS dense_top, round(avg(overlap), 6) AS overlap, round(avg(bm25_top), 6) AS bm25_top FROM (SELECT d.query_id, d.lang, (hits = 0 OR CASE WHEN d.lang = 'en' THEN d.dense_top < 0.2 AND d.bm25_top < 0.2 ELSE d.dense_top < 0.2 END) AS r, dense_std, d.dense_top, overlap, d.bm25_top FROM dec d JOIN (SELECT query_id, dense_std, overlap FROM sig) s ON s.query_id = d.query_id) GROUP BY 1")
def language_report(spark, sf):
    h = _hybrid(spark, sf)
    out = reports.language_report(h["decision"], h["signals"])
    return out.select("lang", "queries", "refused", *[F.round(f"mean_{c}", 6).alias(c) for c in ("dense_std", "dense_top", "overlap", "bm25_top")])


@query(f"WITH {DOCS}, asked AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_sql('docs', 'doc_id', 'asked')} SELECT query_id, rank, k AS doc_id, round(score, 6) AS score FROM bm25")
def bm25_stored(spark, sf):
    """The same as bm25_top25, through an index that is written first."""
    asked = C.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = lexical.StoredIndex.build(C.papers(spark, sf), Workspace(spark, "index").root, "doc_id")
    return index.search(asked).select("query_id", "rank", "doc_id", *_R("score"))


_STOP = ("the", "and", "of", "to", "a", "in", "that", "is", "was", "he")


@query(f"WITH {DOCS}, cut AS (SELECT doc_id, array_to_string([x FOR x IN string_split(w, ' ') IF NOT list_contains({list(_STOP)}, x)], ' ') AS text FROM (SELECT doc_id, array_to_string({{words}}, ' ') AS w FROM docs)), asked AS (SELECT item_id AS query_id, array_to_string([x FOR x IN string_split(w, ' ') IF NOT list_contains({list(_STOP)}, x)], ' ') AS text FROM (SELECT item_id, array_to_string({{words}}, ' ') AS w FROM benchmark)), {bm25_sql('cut', 'doc_id', 'asked', 10)} SELECT query_id, rank, k AS doc_id, round(score, 6) AS score FROM bm25".replace("{words}", words_sql("text")))
def bm25_stopped(spark, sf):
    """With a list of stop words, which leave documents and questions alike."""
    asked = C.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.search(C.papers(spark, sf), asked, "doc_id", 10, RetrievalConfig(stop_words=_STOP)).select("query_id", "rank", "doc_id", *_R("score"))


# --- search modes ----------------------------------------------------------------


@query(f"WITH {UNITS} SELECT chunk_id, text FROM units WHERE text ILIKE '%license%' ORDER BY date_id, chunk_index LIMIT 20")
def chunk_search(spark, sf):
    return search_modes.chunk_search(C.units(spark, sf), "license").select("chunk_id", "text")


@query(f"WITH {UNITS}, {DENSE} SELECT query_id, rank, date_id, CAST(chunk_index + 1 AS INT) AS paragraph_no, text FROM (SELECT query_id, rank, date_id, chunk_index, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM dense0 JOIN units ON vec_id = ord) WHERE n <= 80")
def semantic_paragraphs(spark, sf):
    units = C.units(spark, sf).select("chunk_id", "date_id", "ord", (F.col("chunk_index") + 1).alias("paragraph_start"), (F.col("chunk_index") + 1).alias("paragraph_end"))
    hits = dense.search(C.vectors(spark, sf), _vector_queries(spark, sf)).join(units.select("chunk_id", "ord"), F.col("vec_id") == F.col("ord")).select("query_id", "rank", "chunk_id")
    return search_modes.covering_paragraphs(hits, units, C.paragraphs(spark, sf)).select("query_id", "rank", "date_id", "paragraph_no", "text")


def _store(spark, sf):
    return search_modes.Store(C.papers(spark, sf), C.paragraphs(spark, sf))


_FIRST30 = "ORDER BY date_id, paragraph_no LIMIT 30"


@query(f"WITH {LINES} SELECT date_id, paragraph_no, text FROM (SELECT * FROM paras WHERE text ILIKE '%license%' {_FIRST30})")
def quote_phrase(spark, sf):
    """The longest quoted phrase that is found."""
    return search_modes.search_quote(_store(spark, sf), 'where "no such phrase anywhere" or "license" stands')[1].select("date_id", "paragraph_no", "text")


@query(f"WITH {LINES} SELECT date_id, paragraph_no, text FROM (SELECT * FROM paras WHERE text ILIKE '%the%' AND date_id IN (SELECT date_id FROM docs WHERE starts_with(date_id, '5')) {_FIRST30})")
def quote_literal(spark, sf):
    """A text as it is, in the documents whose id begins so."""
    ids = [r["date_id"] for r in C.papers(spark, sf).where(F.col("date_id").startswith("5")).select("date_id").collect()]
    return search_modes.search_quote(_store(spark, sf), "the", ids)[1].select("date_id", "paragraph_no", "text")


@query(f"WITH {LINES} SELECT date_id, paragraph_no FROM paras WHERE (date_id = '47-0101S' AND paragraph_no BETWEEN 2 AND 5) UNION ALL SELECT date_id, paragraph_no FROM paras WHERE date_id = '48-0101S' AND paragraph_no BETWEEN 1 AND 3")
def search_tool_batch(spark, sf):
    """Two ranges of one batch, one with its bounds the wrong way round."""
    asked = [{"date_id": "47-0101S", "start": 5, "end": 2}, {"date_id": "48-0101S", "start": 1, "end": 3}]
    return search_modes.db_search(_store(spark, sf), "batch_read", requests=asked)["rows"].select("date_id", "paragraph_no")


# --- reports ---------------------------------------------------------------------


@query(f"WITH {UNITS} SELECT 'documents_rows' AS metric, count(*) AS n FROM docs UNION ALL SELECT 'documents_documents', count(DISTINCT date_id) FROM docs UNION ALL SELECT 'paragraphs_rows', count(*) FROM paras UNION ALL SELECT 'paragraphs_documents', count(DISTINCT date_id) FROM paras UNION ALL SELECT 'units_rows', count(*) FROM units UNION ALL SELECT 'units_documents', count(DISTINCT date_id) FROM units")
def table_counts(spark, sf):
    return reports.table_counts({"documents": C.papers(spark, sf), "paragraphs": C.paragraphs(spark, sf), "units": C.units(spark, sf)})


@query(f"WITH {LINES} SELECT 'text' AS column, count(*) FILTER (text IS NULL OR text = '') AS missing FROM paras UNION ALL SELECT 'sub_id', count(*) FILTER (sub_id = '') FROM paras UNION ALL SELECT 'date_id', count(*) FILTER (date_id = '') FROM paras")
def missing_values(spark, sf):
    return reports.missing_values(C.paragraphs(spark, sf), ["text", "sub_id", "date_id"])


@query("SELECT event_type, count(*) AS rows, round(sum(value), 4) AS seconds, round(count(*) / sum(value), 6) AS rows_per_second FROM events GROUP BY 1")
def throughput(spark, sf):
    return reports.throughput(C.table(spark, sf, "events"), "value", "event_type").select("event_type", "rows", F.round("seconds", 4).alias("seconds"), *_R("rows_per_second"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(avg(value), 6) AS value_avg, round(avg(CAST(value < 1 AS DOUBLE)), 6) AS fast_rate FROM events GROUP BY 1")
def event_extremes(spark, sf):
    return reports.extremes(C.table(spark, sf, "events"), "event_type", ["value"], {"fast": F.col("value") < 1}).select("event_type", "n", *_R("value_min", "value_max", "value_avg", "fast_rate"))


@query("SELECT user_id AS request, event_id % 3 AS iteration, count(*) FILTER (event_type = 'view') AS offered, count(*) FILTER (event_type = 'click') AS requested FROM events GROUP BY 1, 2")
def call_counts(spark, sf):
    kind = F.when(F.col("event_type") == "view", "offered").when(F.col("event_type") == "click", "requested")
    return reports.call_counts(C.table(spark, sf, "events").select(F.col("user_id").alias("request"), (F.col("event_id") % 3).alias("iteration"), kind.alias("kind")))


@query("SELECT conv_id, turn, rtrim(CASE WHEN NOT length(text) <= 400 THEN 'long,' ELSE '' END || CASE WHEN NOT contains(text, ' ') THEN 'one_word,' ELSE '' END || CASE WHEN NOT turn <= 6 THEN 'late,' ELSE '' END, ',') AS issues, length(text) <= 400 AND contains(text, ' ') AND turn <= 6 AS passed FROM conversations")
def rule_audit(spark, sf):
    c = C.table(spark, sf, "conversations").withColumn("case_id", F.struct("conv_id", "turn"))
    rules = {"long": F.length("text") <= 400, "one_word": F.contains(F.col("text"), F.lit(" ")), "late": F.col("turn") <= 6}
    return reports.rule_audit(c, rules).select("case_id.conv_id", "case_id.turn", F.array_join("issues", ",").alias("issues"), "passed")


@query(
    f"SELECT metric, CAST(n AS VARCHAR) AS value FROM ({ORACLES['antijoin_integrity']}) UNION ALL SELECT replace(metric, 'units_', 'chunks_'), CAST(n AS VARCHAR) FROM ({ORACLES['table_counts']})"
    f" UNION ALL SELECT 'documents_with_holes', CAST(count(*) AS VARCHAR) FROM ({ORACLES['paragraph_gaps']}) UNION ALL SELECT 'missing_paragraphs', CAST(CAST(coalesce(sum(missing), 0) AS BIGINT) AS VARCHAR) FROM ({ORACLES['paragraph_gaps']})"
    f" UNION ALL SELECT 'longest_paragraph_words', CAST(words AS VARCHAR) FROM ({ORACLES['longest_paragraph'].replace('FROM paras ORDER', f'FROM paras WHERE {_HOLES} ORDER')})"
)
def store_report(spark, sf):
    paragraphs = C.paragraphs(spark, sf).where(_HOLES)
    whole = reports.store_report(C.papers(spark, sf), paragraphs, C.units(spark, sf))
    counts = reports.table_counts({"documents": C.papers(spark, sf), "paragraphs": C.paragraphs(spark, sf), "chunks": C.units(spark, sf)}).select("metric", F.col("n").cast("string").alias("value"))
    orphans = QUERIES["antijoin_integrity"](spark, sf).select("metric", F.col("n").cast("string").alias("value"))
    own = whole.where(F.col("metric").isin("documents_with_holes", "missing_paragraphs", "longest_paragraph_words"))
    return own.unionByName(counts).unionByName(orphans)


# --- references, attributes and replies ------------------------------------------------


@query(f"WITH {LINES}, r AS (SELECT date_id, paragraph_no, CASE WHEN regexp_matches(text, '^[A-Za-z]') THEN lower(text[1]) ELSE '' END AS sub FROM paras) SELECT date_id, paragraph_no, paragraph_no || sub AS ref, paragraph_no AS number, sub AS suffix, CASE WHEN sub = '' THEN 0 ELSE ascii(sub) - 96 END AS rank FROM r")
def reference_parts(spark, sf):
    sub = F.when(F.col("text").rlike("^[A-Za-z]"), F.lower(F.substring("text", 1, 1))).otherwise("")
    rows = C.paragraphs(spark, sf).select("date_id", "paragraph_no", references.reference(F.col("paragraph_no"), sub).alias("ref"))
    p = references.parse_reference(F.col("ref"))
    return rows.select("date_id", "paragraph_no", "ref", p["number"].alias("number"), p["suffix"].alias("suffix"), references.suffix_rank(p["suffix"]).alias("rank"))


@query(f"WITH {DOCS} SELECT doc_id, '/d/19' || substr(date_id, 1, 2) || '/' || date_id || '.pdf' AS path, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM docs")
def file_names(spark, sf):
    return C.papers(spark, sf).select("doc_id", references.file_path("/d", F.col("date_id")).alias("path"), references.slug(F.col("title")).alias("slug"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id END AS conv, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role FROM conversations")
def tolerant_json(spark, sf):
    """Objects, objects in code fences and broken texts."""
    one = references.to_json(F.struct(F.col("conv_id").alias("conv"), "role"))
    text = F.when(F.col("turn") % 3 == 0, F.lit("{broken")).when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise(one)
    own = references.tolerant_json(text, "conv long, role string")
    return C.table(spark, sf, "conversations").select("conv_id", "turn", own["conv"].alias("conv"), own["role"].alias("role"))


@query(f"WITH {LINES} SELECT p.date_id, paragraph_no, title, coalesce(language, 'en') AS language FROM paras p JOIN docs d ON d.date_id = p.date_id")
def paragraph_attributes(spark, sf):
    rows = references.required_attribute(C.paragraphs(spark, sf).drop("text"), C.papers(spark, sf), "title")
    return references.with_attribute(rows, C.papers(spark, sf), "language", default="en").select("date_id", "paragraph_no", "title", "language")


@query(f"WITH {UNITS} SELECT chunk_id, text FROM units")
def corpus_scan(spark, sf):
    return tables.corpus_text(C.units(spark, sf))


_SUBJECT_NAMES, _SUBJECT_WORDS, _SUBJECT_PAIRS = ("he ", "they "), ("follower",), (("people", "church"),)


@query(
    f"SELECT conv_id, turn, CASE WHEN {_HAS(_SCRIPTURE, 'lower(text)')} OR regexp_matches(text, '\\b([1-3]\\s*)?[A-Za-z]+\\s+[0-9]+:[0-9]+(-[0-9]+)?\\b') THEN 'S' WHEN {_HAS(_COMPARING, chr(39) + ' ' + chr(39) + ' || lower(text) || ' + chr(39) + ' ' + chr(39))} THEN 'C' END AS addendum,"
    " contains(' ' || lower(trim(text)) || ' ', ' he ') OR contains(' ' || lower(trim(text)) || ' ', ' they ') OR contains(lower(text), 'follower') OR (contains(lower(text), 'people') AND contains(lower(text), 'church')) AS external,"
    " regexp_matches(text, '\\b(?:[1-3]\\s+)?[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?\\s+[0-9]+:[0-9]+(?:-[0-9]+)?\\b') AS scripture, contains(text, '[') AND regexp_matches(text, '[0-9]{2}-[0-9]{4}[A-Z]?:\\s*¶[0-9]+') AS cites,"
    " 'Answer:' || chr(10) || CASE WHEN trim(text) = '' THEN 'none' ELSE trim(string_split(trim(text), chr(10))[1]) END AS reply FROM conversations"
)
def reply_gates(spark, sf):
    text = F.col("text")
    return C.table(spark, sf, "conversations").select(
        "conv_id", "turn", replies.mode_addendum(text, "S", "C").alias("addendum"), replies.needs_external_section(text, _SUBJECT_NAMES, _SUBJECT_WORDS, _SUBJECT_PAIRS).alias("external"),
        replies.cites_scripture(text).alias("scripture"), replies.cites_document(text).alias("cites"), replies.two_line_reply(text, "none").alias("reply"),
    )


@query("SELECT event_id, event_type IN ('error') OR event_id % 5 = 0 AS limited FROM events")
def rate_limits(spark, sf):
    status = F.when(F.col("event_id") % 5 == 0, 429).otherwise(200)
    message = F.when(F.col("event_type") == "error", "Too many requests").otherwise(F.col("event_type"))
    return C.table(spark, sf, "events").select("event_id", replies.rate_limited(status, message).alias("limited"))


@query()
def merge_references(spark, sf):
    """Answers with two bullets of one document and one of another."""
    rows = C.table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit("\n- [T — 50-0101: ¶1–¶2]\n- [U — 51-0101: ¶4]\n- [T — 50-0101: ¶7]")).alias("answer"))
    return answers.finalize_answers(rows).select("conv_id", "turn", "mode", "final", "issues")


# --- parsing -----------------------------------------------------------------------------


@query(f"WITH {LINES}, w AS (SELECT date_id, pos, text, lag(text, 1) OVER o AS before_1, lag(text, 2) OVER o AS before_2, lead(text, 1) OVER o AS after_1, lead(text, 2) OVER o AS after_2, first_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY date_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_filled FROM lines WINDOW o AS (PARTITION BY date_id ORDER BY pos)) SELECT date_id, CAST(pos AS INT) AS pos, before_1, before_2, after_1, after_2, next_filled FROM w")
def line_neighbours(spark, sf):
    lines = C.paragraphs(spark, sf).select("date_id", (F.col("paragraph_no") - 1).alias("pos"), "text")
    return cleaning.line_neighbours(lines).drop("text")


@query(f"WITH {LINES}, m AS (SELECT date_id, CAST(length(text) % 5 AS INT) AS paragraph_no, sub_id, CAST(pos AS INT) AS pos FROM lines JOIN (SELECT DISTINCT date_id AS d, sub_id FROM paras) ON d = date_id) SELECT date_id, paragraph_no, min(pos) AS pos FROM m GROUP BY 1, 2")
def first_of_each(spark, sf):
    rows = C.paragraphs(spark, sf).select("date_id", (F.length("text") % 5).cast("int").alias("paragraph_no"), "sub_id", (F.col("paragraph_no") - 1).alias("pos"))
    return cleaning.first_of_each(rows).select("date_id", "paragraph_no", "pos")


_NUMBERED = "SELECT date_id, CAST(pos AS INT) AS pos, CASE WHEN pos % 3 = 0 THEN (pos // 3 + 1) || ' ' || text ELSE text END AS text FROM lines"


@query(f"WITH {LINES}, l AS ({_NUMBERED}), n AS (SELECT date_id, pos // 3 + 1 AS paragraph_no, pos, trim(CASE WHEN pos % 3 = 0 THEN regexp_replace(text, '^[0-9]+ ', '') ELSE text END) AS t, pos % 3 <> 0 AND regexp_matches(text, '^\\s*¶?\\s*[0-9]{{1,4}}[.)]?(\\s|$)') AS odd FROM l) SELECT date_id, CAST(paragraph_no AS INT) AS paragraph_no, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (t <> ''), '') AS text FROM n WHERE date_id NOT IN (SELECT date_id FROM n WHERE odd) GROUP BY 1, 2")
def marked_paragraphs(spark, sf):
    """Every third line gets a number; documents with other lines that begin with one are left out."""
    lines = C.paragraphs(spark, sf).select("date_id", (F.col("paragraph_no") - 1).alias("pos"), "text")
    odd = lines.where(F.col("pos") % 3 != 0).where(F.col("text").rlike(r"^\s*¶?\s*[0-9]{1,4}[.)]?(\s|$)")).select("date_id").distinct()
    numbered = F.when(F.col("pos") % 3 == 0, F.concat((F.expr("pos div 3") + 1).cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return chunking.marked_paragraphs(lines.join(odd, "date_id", "left_anti").withColumn("text", numbered)).select("date_id", "paragraph_no", "text")


@query()
def paragraphize(spark, sf):
    """Blocks between blank lines, of texts whose every fourth line end is made blank."""
    rows = C.papers(spark, sf).select("date_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return chunking.parse_documents(rows)


@query(f"WITH {LINES}, w AS (SELECT date_id, {count_sql('text')} AS n FROM paras) SELECT date_id, CAST(sum(n) AS BIGINT) AS words, 1 AS tails, true AS in_limits FROM w WHERE n > 0 GROUP BY 1")
def chunk_totals(spark, sf):
    """No word is lost in packing, each document has one last chunk, and no other is out of the limits."""
    chunks = chunking.chunk_documents(C.paragraphs(spark, sf))
    fine = F.col("is_tail") | F.col("word_count").between(260, 380)
    return chunks.groupBy("date_id").agg(F.sum("word_count").cast("long").alias("words"), F.count_if("is_tail").cast("int").alias("tails"), F.bool_and(fine).alias("in_limits"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf):
    """Whether the cells give nine tenths of the exact neighbours of all queries."""
    exact = dense.search(C.vectors(spark, sf), _vector_queries(spark, sf)).select("query_id", "vec_id")
    near = QUERIES["ann_search"](spark, sf).select("query_id", "vec_id", F.lit(True).alias("met"))
    both = exact.join(near, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce(F.col("met"), F.lit(False)).cast("double")) >= 0.9).alias("enough"))


# --- sources and streams -----------------------------------------------------------------


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'skipped' WHEN regexp_matches(html, '(?i)(href=[\"''][^\"'']+\\.pdf[\"'']|https?://[^\\s\"''<>]+\\.pdf)') THEN 'found' ELSE 'missing' END AS status, count(*) AS n FROM pages GROUP BY 1")
def fetch_status(spark, sf):
    p = C.table(spark, sf, "pages").select(F.col("page_id").alias("date_id"), "html")
    return pages.fetch_status(p, p.where("date_id % 4 = 0"), pages.resolve_links(p, p))


_CHUNKED = "SELECT user_id AS request, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE substr(event_type, 1, 3) END AS t FROM events"


def _stream_chunks(spark, sf):
    """Chunks in the shape of ``choices``, of a bare delta, and some that cannot be read."""
    e = C.table(spark, sf, "events").withColumn("t", F.substring("event_type", 1, 3))
    wide = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("t").alias("content")).alias("delta"))).alias("choices")))
    chunk = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 2 == 0, wide).otherwise(F.to_json(F.struct(F.struct(F.col("t").alias("content")).alias("delta"))))
    return e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), chunk.alias("chunk"))


@query(f"SELECT request, seq, t FROM ({_CHUNKED})")
def delta_text(spark, sf):
    return _stream_chunks(spark, sf).select("request", "seq", buffers.delta_text(F.col("chunk")).alias("t"))


@query(f"SELECT request, coalesce(string_agg(t, '' ORDER BY seq) FILTER (t <> ''), '') AS text, CAST(count(*) FILTER (t <> '') AS INT) AS deltas FROM ({_CHUNKED}) GROUP BY 1")
def buffered_text(spark, sf):
    return buffers.buffer_text(_stream_chunks(spark, sf))


@query("SELECT conv_id * 1000 + turn AS request, 3 + CAST(ceil(length(text) / 40.0) AS INT) AS events, text AS said FROM conversations")
def answer_events(spark, sf):
    """Start, deltas, final and done of every answer; the deltas make its text."""
    rows = C.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("error"))
    e = buffers.answer_events(rows)
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", F.get_json_object("data", "$.text").alias("t")))))
    return e.groupBy("request").agg(F.count(F.lit(1)).cast("int").alias("events"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("said"))
