"""Queries over the given records: manuals, chunks, questions and answers, trials, feedback, unit drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as Y
from ..operators import records as D
from ..operators import terms as T
from ..tables import latest, table


def _queries(spark, folder, *columns: str) -> DataFrame:
    return table(spark, folder, "queries", *columns)


def _questions(spark, folder) -> DataFrame:
    return _queries(spark, folder, "id", "question").where("question is not null").distinct()


def list_manuals(spark, folder):
    return table(spark, folder, "manuals", "id", "title", "status", "pages", "created_at").orderBy(F.desc("created_at"))


def _ready_chunks(spark, folder):
    m = table(spark, folder, "manuals", F.col("id").alias("manual_id"), "title", "status", "knowledge_status", "knowledge_release").where("status = 'ready'")
    return table(spark, folder, "chunks").join(m, "manual_id")


def scan_ready_chunks(spark, folder):
    return _ready_chunks(spark, folder).select("id", "manual_id", "page", "ordinal", "extraction", F.length("text").alias("chars"), "title", "knowledge_release").distinct()


def scan_chunks_scoped(spark, folder):
    return _ready_chunks(spark, folder).where("knowledge_status = 'visual-enriched' and extraction = 'ocr-eng'").select("id", "manual_id", "page", "ordinal", "title").distinct()


def library_metrics(spark, folder):
    return table(spark, folder, "manuals", "status", "pages").groupBy("status").agg(F.count("*").alias("manuals"), F.sum("pages").alias("pages"))


def dedup_by_sha256(spark, folder):
    d = table(spark, folder, "documents", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def corpus_digest(spark, folder):
    return D.digest(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def equal_pages(spark, folder):
    """Pages of the manuals, and bulletins of the sources as pages of their own, that hold the same texts."""
    pages = table(spark, folder, "chunks", "manual_id", "page", "ordinal", "text")
    bulletins = table(spark, folder, "documents", F.col("source").alias("manual_id"), F.col("doc_id").cast("int").alias("page"), F.lit(0).alias("ordinal"), "text")
    return D.equal_pages(pages.unionByName(bulletins)).where("n_pages > 1").select("n_pages", "first_page")


def upsert_feedback(spark, folder):
    return D.upserted(table(spark, folder, "feedback"), "query_id", "created_at")


def export_feedback_guarded(spark, folder):
    f = upsert_feedback(spark, folder).withColumnRenamed("created_at", "given_at")
    q = _queries(spark, folder, F.col("id").alias("query_id"), "question", "status").distinct()
    return q.join(f, "query_id", "left").select("query_id", *[D.guarded(F.col(c)).alias(c) for c in ("question", "status", "verdict", "note")])


def feedback_by_verdict(spark, folder):
    f = upsert_feedback(spark, folder)
    q = _queries(spark, folder, F.col("id").alias("query_id"), F.lower(F.btrim("status")).alias("status")).distinct()
    return q.join(f.select("query_id", "verdict"), "query_id", "left").groupBy("status", "verdict").agg(F.count("*").alias("n"))


def export_study(spark, folder):
    return D.trial_summary(table(spark, folder, "trials"), _queries(spark, folder, "id", "trial_id")).select("id", "trial_condition", "scenario", "status", "questions")


def trial_elapsed(spark, folder):
    return D.trial_summary(table(spark, folder, "trials"), _queries(spark, folder, "id", "trial_id")).select("id", "elapsed")


def export_queries(spark, folder):
    return D.query_sources(_queries(spark, folder, "id", "status", "sources_json"))


def cited_page_rollup(spark, folder):
    return D.cited_pages(_queries(spark, folder, "id", "sources_json"), table(spark, folder, "chunks", "id", "text"))


def uncited_chunks(spark, folder):
    cited = D.query_sources(_queries(spark, folder, "id", "status", "sources_json")).select(F.col("chunk_id").alias("id")).where("id is not null").distinct()
    return table(spark, folder, "chunks", "id", "manual_id").join(cited, "id", "left_anti").distinct().groupBy("manual_id").agg(F.count("*").alias("uncited"))


def cascade_delete(spark, folder):
    gone = table(spark, folder, "manuals", F.col("id").alias("manual_id"), "status").where("status = 'retired'")
    return D.without_manuals(_queries(spark, folder, "id", "sources_json"), gone).select("id").distinct()


def timing_summary(spark, folder):
    """Median and mean seconds by release; broken or empty timings count as missing."""
    t = _queries(spark, folder, "id", "retrieval_release", F.from_json("timings_json", D.TIMINGS).alias("t")).distinct()
    return t.groupBy("retrieval_release").agg(F.count("*").alias("n"), F.count("t.total_seconds").alias("timed"), F.round(F.median("t.total_seconds"), 6).alias("median_seconds"), F.round(F.avg("t.retrieval_seconds"), 6).alias("mean_retrieval"))


STATUSES = ("answered", "clarify", "no_evidence", "refused", "not_applicable", "provider_error", "pipeline_error")


def status_by_release(spark, folder):
    """Questions of each release by status, those without one as `missing` and those of any other as `other`."""
    q = _queries(spark, folder, "id", "retrieval_release", F.lower(F.btrim("status")).alias("status")).distinct()
    status = F.col("status")
    return q.groupBy("retrieval_release").agg(*[F.count_if(status == c).alias(c) for c in STATUSES], F.count_if(status.isNull()).alias("missing"), F.count_if(~status.isin(*STATUSES)).alias("other"))


def previous_question(spark, folder):
    """Each question of a trial with the one before it, by time."""
    q = _queries(spark, folder, "id", "trial_id", "created_at").where("trial_id is not null").distinct()
    return q.select("id", "trial_id", F.lag("id").over(Window.partitionBy("trial_id").orderBy("created_at", "id")).alias("previous_id"))


def normalized_questions(spark, folder):
    return _questions(spark, folder).select("id", X.normalized_question(F.col("question")).alias("normalized"))


def question_flags(spark, folder):
    q = F.col("question")
    return _questions(spark, folder).select("id", X.audible_noise(q).alias("noise"), X.event_trigger(q).alias("trigger"), X.diagnostic(q).alias("diagnostic"), X.requested_english(q).alias("english"), X.has_devanagari_letters(q).alias("devanagari"), X.latin_or_bengali_only(q).alias("plain_scripts"))


def electrical_noise_chunks(spark, folder):
    return table(spark, folder, "chunks", "id", "text").where(X.electrical_noise_only(F.col("text")) | X.audible_noise(F.col("text"))).select("id", X.audible_noise(F.col("text")).alias("audible")).distinct()


def question_models(spark, folder):
    return _questions(spark, folder).select("id", F.explode(X.model_ids(F.col("question"))).alias("model"))


def model_scope_resolution(spark, folder):
    """Models asked about and the number of manuals whose title or file name names them; 0 where no manual covers a model."""
    named = F.array_union(F.coalesce(X.model_ids(F.col("title")), F.array()), F.coalesce(X.model_ids(F.replace("filename", F.lit("_"), F.lit(" "))), F.array()))
    titles = table(spark, folder, "manuals", F.col("id").alias("manual_id"), F.explode(named).alias("model"))
    asked = question_models(spark, folder).groupBy("model").agg(F.count("*").alias("questions"))
    return asked.join(titles.groupBy("model").agg(F.count("*").alias("manuals")), "model", "left").select("model", "questions", F.coalesce("manuals", F.lit(0)).alias("manuals"))


def translation_number_drift(spark, folder):
    """Questions whose search question has other numbers or other models."""
    q = _queries(spark, folder, "id", "question", "search_question").where("question is not null and search_question is not null").distinct()
    q = q.select("id", X.ascii_digits(F.col("question")).alias("a"), X.ascii_digits(F.col("search_question")).alias("b"))
    same_models = (F.size(F.array_except(X.model_ids(F.col("a")), X.model_ids(F.col("b")))) == 0) & (F.size(F.array_except(X.model_ids(F.col("b")), X.model_ids(F.col("a")))) == 0)
    return q.select("id", X.same_multiset(X.numbers(F.col("a")), X.numbers(F.col("b"))).alias("same_numbers"), same_models.alias("same_models")).distinct()


def search_word_error(spark, folder):
    q = _queries(spark, folder, "id", "question", "search_question").where("question is not null and search_question is not null").distinct()
    return q.select("id", X.word_error_rate(F.col("question"), F.col("search_question")).alias("wer"))


def heading_keys(spark, folder):
    """Headings among the lines of documents and chunks, and the numbered headings that drafts stand under."""
    of = lambda name, key: table(spark, folder, name, F.lit(name).alias("item_table"), F.col(key).cast("string").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    drafts = table(spark, folder, "unit_drafts", F.lit("unit_drafts").alias("item_table"), F.col("draft_id").alias("item_id"), F.lit(0).alias("line"), F.concat_ws(" ", "section_key", "title").alias("t"))
    line = of("documents", "doc_id").unionByName(of("chunks", "id")).unionByName(drafts)
    return line.select("item_table", "item_id", "line", X.heading_key(F.col("t")).alias("key")).where("key is not null").distinct()


def chunk_windows(spark, folder):
    """Windows of all chunks and documents; a text within the limit is one window, a null or blank one none."""
    c = table(spark, folder, "chunks", F.lit("chunks").alias("item_table"), "id", "text")
    d = table(spark, folder, "documents", F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("id"), "text")
    return c.unionByName(d).distinct().select("item_table", "id", F.posexplode(X.windows(F.col("text"))).alias("ordinal", "piece"))


def search_text_builder(spark, folder):
    return D.search_text(table(spark, folder, "unit_drafts")).distinct()


def row_linearize(spark, folder):
    return Y.table_rows(table(spark, folder, "unit_drafts")).select("draft_id", "row", "text").distinct()


def filled_cells(spark, folder):
    return Y.filled_cells(table(spark, folder, "unit_drafts"))


def safety_notes(spark, folder):
    return D.safety_notes(table(spark, folder, "unit_drafts"), table(spark, folder, "manuals", "id", "title"))


def draft_manifest(spark, folder):
    d = table(spark, folder, "unit_drafts", "draft_id", "manual_id", "kind", "page", "section_key").distinct()
    return d.groupBy("manual_id").agg(F.count("*").alias("units"), F.count_if(F.col("kind") == "table").alias("tables"), F.countDistinct("page").alias("pages"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def section_siblings(spark, folder):
    """Drafts of one page whose section differs only in its last part: the context that goes along with a match."""
    d = table(spark, folder, "unit_drafts", "draft_id", "manual_id", "page", "section_key").where("section_key <> ''").distinct()
    d = d.withColumn("scope", F.when(F.contains("section_key", F.lit("-")), F.regexp_replace("section_key", "-[^-]*$", "")).otherwise(F.col("section_key")))
    other = d.select("manual_id", "page", "scope", F.col("draft_id").alias("sibling"))
    return d.join(other, ["manual_id", "page", "scope"]).where("draft_id <> sibling").select("draft_id", "sibling")


def question_intents(spark, folder):
    return _questions(spark, folder).select("id", F.posexplode(T.intents(F.col("question"))).alias("part", "intent"))


def manual_keyterms(spark, folder):
    return T.key_terms(table(spark, folder, "unit_drafts", F.col("manual_id").alias("owner"), F.regexp_replace("title", r" \d+$", "").alias("term")))


QUERIES = {q.__name__: q for q in (list_manuals, scan_ready_chunks, scan_chunks_scoped, library_metrics, dedup_by_sha256, corpus_digest, equal_pages, upsert_feedback, export_feedback_guarded, feedback_by_verdict, export_study, trial_elapsed, export_queries, cited_page_rollup, uncited_chunks, cascade_delete, timing_summary, status_by_release, previous_question, normalized_questions, question_flags, electrical_noise_chunks, question_models, model_scope_resolution, translation_number_drift, search_word_error, heading_keys, chunk_windows, search_text_builder, row_linearize, filled_cells, safety_notes, draft_manifest, section_siblings, question_intents, manual_keyterms)}

_READY = "r AS (SELECT c.*, title, knowledge_status, knowledge_release FROM chunks c JOIN manuals m ON m.id = manual_id AND m.status = 'ready')"
_FEEDBACK = "f AS (SELECT DISTINCT * FROM feedback QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST, note DESC NULLS LAST) = 1)"
_SOURCES = "CAST(from_json(sources_json, '[{\"id\":\"VARCHAR\",\"manual_id\":\"VARCHAR\",\"page\":\"INTEGER\"}]') AS STRUCT(id VARCHAR, manual_id VARCHAR, page INTEGER)[])"
_SRC = f"""q AS (SELECT DISTINCT id, status, sources_json FROM queries), s AS (SELECT id, status, {_SOURCES} AS a FROM q),
  e AS (SELECT id, status, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS rank FROM s)"""
_GUARD = "CASE WHEN regexp_matches({0}, '^ *[=+\\-@]') THEN concat('''', {0}) ELSE {0} END AS {0}"
_DIGITS = "translate({0}, '" + "".join(chr(ord(z) + i) for z in X.DIGIT_ZEROS for i in range(10)) + "', '" + "0123456789" * len(X.DIGIT_ZEROS) + "')"
_PLAIN = "regexp_replace(regexp_replace(" + _DIGITS + ", '([A-Za-z0-9])[‐‑‒–—−]([A-Za-z0-9])', '\\1-\\2', 'g'), '([A-Za-z0-9])[‐‑‒–—−]([A-Za-z0-9])', '\\1-\\2', 'g')"
_MODELS = ("list_distinct(list_transform(list_filter(regexp_extract_all(concat(' ', replace(upper(" + _PLAIN + "), ' ', '  ')), '(?:^|[^A-Z0-9])([A-Z]{{1,6}}(?:-|  )?\\d{{3,5}}[A-Z]{{0,3}}(?:-[A-Z0-9]{{1,5}})?)(?:[^A-Z0-9]|$)', 1), "
           f"lambda m: NOT regexp_matches(m, '^(?:{'|'.join(X.STANDARDS)})(?:-|  )?\\d|^(?:{'|'.join(X.QUANTITY_WORDS)})  ')), lambda m: regexp_replace(m, '[- ]', '', 'g')))")
_FILE = "replace(filename, '_', ' ')"
_H = "sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), coalesce(text, chr(0))))"

_STOP_AT = "coalesce(" + ", ".join(f"nullif(length(regexp_extract(own, '^(?s:.{{550,}}){b}')), 0)" for b in ("\\n\\n", "\\n", "\\. ", "। ")) + ", 1100)"
_STEP = f"SELECT item_table, id, t, n + 1 AS n, last, CASE WHEN last THEN length(t) ELSE pos + {_STOP_AT} - 180 END AS pos, regexp_replace(CASE WHEN last THEN own ELSE own[1:{_STOP_AT}] END, '^\\s+|\\s+$', '', 'g') AS piece"

ORACLE = {
    "chunk_windows": f"""WITH RECURSIVE i AS (SELECT 'chunks' AS item_table, id, text FROM chunks UNION SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents),
      s AS (SELECT item_table, id, regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM i WHERE text IS NOT NULL),
      w AS ({_STEP} FROM (SELECT item_table, id, t, -1 AS n, 0 AS pos, t[1:1100] AS own, length(t) <= 1100 AS last FROM s WHERE t <> '')
        UNION ALL {_STEP} FROM (SELECT item_table, id, t, n, pos, t[pos + 1:pos + 1100] AS own, pos + 1100 >= length(t) AS last FROM w WHERE NOT last))
      SELECT item_table, id, CAST(row_number() OVER (PARTITION BY item_table, id, t ORDER BY n) - 1 AS INTEGER) AS ordinal, piece FROM w WHERE piece <> ''""",
    "search_word_error": """WITH q AS (SELECT DISTINCT id, regexp_extract_all(lower(question), '[\\p{L}\\p{M}\\p{N}]+') AS a, regexp_extract_all(lower(search_question), '[\\p{L}\\p{M}\\p{N}]+') AS b, question, search_question FROM queries WHERE question IS NOT NULL AND search_question IS NOT NULL),
      d AS (SELECT id, a, b, question, search_question, list_distinct(list_concat(a, b)) AS v FROM q), c AS (SELECT id, len(a) AS n, array_to_string(list_transform(a, lambda w: chr(32 + CAST(list_position(v, w) AS INTEGER))), '') AS x, array_to_string(list_transform(b, lambda w: chr(32 + CAST(list_position(v, w) AS INTEGER))), '') AS y FROM d)
      SELECT id, round(levenshtein(x, y) / greatest(1, n), 4) AS wer FROM c""",
    "manual_keyterms": """WITH t AS (SELECT manual_id AS owner, trim(regexp_replace(title, ' \\d+$', '')) AS term FROM unit_drafts WHERE title IS NOT NULL AND manual_id IS NOT NULL),
      o AS (SELECT owner, lower(term) AS folded, min(term) AS term FROM t WHERE length(term) BETWEEN 1 AND 80 AND NOT regexp_matches(term, '[,;:]') GROUP BY ALL),
      l AS (SELECT owner, list(term ORDER BY folded) AS l FROM o GROUP BY owner),
      r AS (SELECT owner, list_reduce(list_prepend({'size': 0, 'terms': CAST([] AS VARCHAR[])}, list_transform(l, lambda x: {'size': CAST(strlen(x) + 1 AS INTEGER), 'terms': [x]})), lambda s, x: CASE WHEN len(s.terms) < 32 AND s.size + x.size <= 480 THEN {'size': s.size + x.size, 'terms': list_concat(s.terms, x.terms)} ELSE s END).terms AS terms FROM l)
      SELECT owner, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS position, unnest(terms) AS term FROM r""",
    "question_intents": f"""WITH q AS (SELECT DISTINCT id, question FROM queries WHERE question IS NOT NULL), p AS (SELECT id, question, list_filter(list_transform(string_split(regexp_replace(question, '([.!?;।])\\s+|\\n\\s*\\n', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: length(x) >= 15 AND regexp_matches(x, '{T.EVENTS}')) AS a FROM q),
      u AS (SELECT id, question, a, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM p), r AS (SELECT id, CASE WHEN len(d) <= 1 THEN [question] WHEN len(d) <= 4 THEN d END AS l FROM u)
      SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS part, unnest(l) AS intent FROM r""",
    "list_manuals": "SELECT id, title, status, pages, created_at FROM manuals",
    "scan_ready_chunks": f"WITH {_READY} SELECT DISTINCT id, manual_id, page, ordinal, extraction, CAST(length(text) AS INTEGER) AS chars, title, knowledge_release FROM r",
    "scan_chunks_scoped": f"WITH {_READY} SELECT DISTINCT id, manual_id, page, ordinal, title FROM r WHERE knowledge_status = 'visual-enriched' AND extraction = 'ocr-eng'",
    "library_metrics": "SELECT status, count(*) AS manuals, CAST(sum(pages) AS BIGINT) AS pages FROM manuals GROUP BY status",
    "dedup_by_sha256": "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "corpus_digest": f"WITH h AS (SELECT {_H} AS h FROM documents) SELECT count(*) AS n, concat_ws('-', " + ", ".join(f"CAST(sum(CAST(concat('0x', h[{1 + 12 * k}:{12 + 12 * k}]) AS HUGEINT)) AS VARCHAR)" for k in range(4)) + ") AS digest FROM h",
    "equal_pages": "WITH p AS (SELECT manual_id, page, string_agg(sha256(text), ',' ORDER BY ordinal, sha256(text)) AS hs FROM (SELECT manual_id, page, ordinal, text FROM chunks WHERE text IS NOT NULL UNION SELECT source, CAST(doc_id AS INTEGER), 0, text FROM documents WHERE text IS NOT NULL) GROUP BY ALL) SELECT count(*) AS n_pages, min(concat_ws(':', manual_id, page)) AS first_page FROM p GROUP BY hs HAVING count(*) > 1",
    "upsert_feedback": f"WITH {_FEEDBACK} SELECT * FROM f",
    "export_feedback_guarded": f"WITH {_FEEDBACK}, q AS (SELECT DISTINCT id AS query_id, question, status FROM queries) SELECT query_id, {', '.join(_GUARD.format(c) for c in ('question', 'status', 'verdict', 'note'))} FROM q LEFT JOIN f USING (query_id)",
    "feedback_by_verdict": f"WITH {_FEEDBACK}, q AS (SELECT DISTINCT id AS query_id, lower(trim(status)) AS status FROM queries) SELECT status, verdict, count(*) AS n FROM q LEFT JOIN f USING (query_id) GROUP BY ALL",
    "export_study": "SELECT t.id, trial_condition, scenario, t.status, count(DISTINCT q.id) AS questions FROM trials t LEFT JOIN queries q ON q.trial_id = t.id GROUP BY ALL",
    "trial_elapsed": "SELECT id, round(CASE WHEN ended_at IS NULL OR created_at IS NULL THEN 0.0 ELSE greatest(0.0, (epoch_us(ended_at) - epoch_us(created_at)) / 1e6) END, 3) AS elapsed FROM trials",
    "export_queries": f"WITH {_SRC} SELECT DISTINCT id AS query_id, status, s.id AS chunk_id, s.manual_id, s.page FROM e UNION ALL SELECT id, status, NULL, NULL, NULL FROM s WHERE coalesce(len(a), 0) = 0",
    "cited_page_rollup": f"""WITH {_SRC}, c AS (SELECT id, min(text) AS text FROM chunks GROUP BY id), j AS (SELECT e.id AS query_id, s.manual_id AS manual_id, s.page AS page, min(rank) AS rank, c.text, count(DISTINCT s.id) AS n, list(DISTINCT s.id) AS ids FROM e LEFT JOIN c ON c.id = s.id GROUP BY ALL)
      SELECT query_id, manual_id, page, CAST(min(rank) AS INTEGER) AS first_rank, CAST(len(list_distinct(flatten(list(ids)))) AS BIGINT) AS n_chunks, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') AS text FROM j GROUP BY ALL""",
    "uncited_chunks": f"WITH {_SRC} SELECT manual_id, count(DISTINCT id) AS uncited FROM chunks WHERE id NOT IN (SELECT s.id FROM e WHERE s.id IS NOT NULL) GROUP BY manual_id",
    "cascade_delete": f"WITH {_SRC}, g AS (SELECT id FROM manuals WHERE status = 'retired') SELECT DISTINCT id FROM queries WHERE id NOT IN (SELECT id FROM e WHERE s.manual_id IN (FROM g) OR string_split(s.id, ':')[1] IN (FROM g))",
    "timing_summary": "WITH t AS (SELECT DISTINCT id, retrieval_release, timings_json FROM queries) SELECT retrieval_release, count(*) AS n, count(json_extract(timings_json, '$.total_seconds')) AS timed, round(median(CAST(json_extract(timings_json, '$.total_seconds') AS DOUBLE)), 6) AS median_seconds, round(avg(CAST(json_extract(timings_json, '$.retrieval_seconds') AS DOUBLE)), 6) AS mean_retrieval FROM t GROUP BY ALL",
    "status_by_release": "WITH q AS (SELECT DISTINCT id, retrieval_release, lower(trim(status)) AS status FROM queries) SELECT retrieval_release, " + ", ".join(f"count(*) FILTER (status = '{c}') AS {c}" for c in STATUSES) + ", count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status NOT IN ('" + "', '".join(STATUSES) + "')) AS other FROM q GROUP BY ALL",
    "previous_question": "WITH q AS (SELECT DISTINCT id, trial_id, created_at FROM queries WHERE trial_id IS NOT NULL) SELECT id, trial_id, lag(id) OVER (PARTITION BY trial_id ORDER BY created_at NULLS FIRST, id) AS previous_id FROM q",
    "normalized_questions": "WITH q AS (SELECT DISTINCT id, question FROM queries WHERE question IS NOT NULL), n AS (SELECT id, " + _DIGITS.format("nfc_normalize(question)") + " AS t FROM q) SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z0-9])[‐‑‒–—−]([A-Za-z0-9])', '\\1-\\2', 'g'), '([A-Za-z0-9])[‐‑‒–—−]([A-Za-z0-9])', '\\1-\\2', 'g'), '([A-Za-z0-9])[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]([A-Za-z0-9])', '\\1\\2', 'g'), '([A-Za-z0-9])[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]([A-Za-z0-9])', '\\1\\2', 'g') AS normalized FROM n",
    "question_flags": """WITH q AS (SELECT DISTINCT id, question AS q FROM queries WHERE question IS NOT NULL) SELECT id,
      NOT regexp_matches(q, '(?i)electrical|electromagnetic|\\bEMI\\b|welder|interference|বৈদ্যুতিক|হস্তক্ষেপ') AND regexp_matches(q, '(?i)(mak\\w*|produc\\w*|hear\\w*|loud|audible).{0,60}\\b(noise|sounds?)\\b|আওয়াজ|আওয়াজ|সাউন্ড') AS noise,
      CASE WHEN regexp_matches(q, '(?i)neutral|নিউট্রাল') AND regexp_matches(q, '(?i)thread\\s*(trimm|cut)|cut\\w*\\s+(the\\s+)?thread|সুতা\\s*কাট') THEN 'neutral_after_thread_trim'
        WHEN regexp_matches(q, '(?i)knee|হাঁটু') AND regexp_matches(q, '(?i)treadle|pedal|প্যাডেল') AND regexp_matches(q, '(?i)after|once|following|এরপর|পরে|যদি') THEN 'after_knee_switch' END AS trigger,
      regexp_matches(q, '(?i)\\b(cause|causing|fault|symptoms?|cannot|incompatible|simultaneously|unresponsive)\\b|\\b(can|allows?|permits?)\\b.{0,80}\\b(rais\\w*|lower\\w*|lift\\w*)\\b|সমস্যা|একসঙ্গে|প্যাডেল.*(ওঠে|উঠছে|উপরে\\s+তোলা)') AS diagnostic,
      CASE WHEN regexp_matches(q, 'বাংলায়\\s+উত্তর|উত্তর(টি)?\\s+বাংলা') THEN false ELSE regexp_matches(q, 'ইংরেজিতে\\s+(উত্তর|বলুন|ব্যাখ্যা)|উত্তর(টি)?\\s+ইংরেজিতে') OR regexp_matches(regexp_replace(q, '(?i)(do not|don''t|never|not)\\s*\\b(answer|respond|reply|explain)\\s+(in|using)\\s+English\\b', '', 'g'), '(?i)\\b(answer|respond|reply|explain)\\s+(in|using)\\s+English\\b') END AS english,
      regexp_matches(q, '[\\x{0904}-\\x{0939}\\x{0950}\\x{0958}-\\x{0961}\\x{0972}-\\x{097F}]') AS devanagari,
      NOT contains(q, chr(65533)) AND regexp_matches(q, '\\p{L}') AND NOT regexp_matches(regexp_replace(q, '[\\p{Latin}\\p{Bengali}]', '', 'g'), '\\p{L}') AS plain_scripts FROM q""",
    "electrical_noise_chunks": """WITH c AS (SELECT DISTINCT id, regexp_matches(text, '(?i)electrical\\s+(noise|interference)') AND NOT regexp_matches(text, '(?i)abnormal\\s+noises?|audible|mechanical\\s+noise|sounds?|buzz\\w*|humming|rattl\\w*') AS e,
      NOT regexp_matches(text, '(?i)electrical|electromagnetic|\\bEMI\\b|welder|interference|বৈদ্যুতিক|হস্তক্ষেপ') AND regexp_matches(text, '(?i)(mak\\w*|produc\\w*|hear\\w*|loud|audible).{0,60}\\b(noise|sounds?)\\b|আওয়াজ|আওয়াজ|সাউন্ড') AS audible FROM chunks) SELECT id, audible FROM c WHERE e OR audible""",
    "question_models": f"WITH q AS (SELECT DISTINCT id, question FROM queries WHERE question IS NOT NULL) SELECT id, unnest({_MODELS.format('question')}) AS model FROM q",
    "model_scope_resolution": f"WITH q AS (SELECT DISTINCT id, question FROM queries WHERE question IS NOT NULL), a AS (SELECT model, count(*) AS questions FROM (SELECT unnest({_MODELS.format('question')}) AS model FROM q) GROUP BY model), t AS (SELECT model, count(DISTINCT id) AS manuals FROM (SELECT id, unnest({_MODELS.format('title')}) AS model FROM manuals UNION SELECT id, unnest({_MODELS.format(_FILE)}) FROM manuals) GROUP BY model) SELECT model, questions, coalesce(manuals, 0) AS manuals FROM a LEFT JOIN t USING (model)",
    "translation_number_drift": f"WITH q AS (SELECT DISTINCT id, {_DIGITS.format('question')} AS a, {_DIGITS.format('search_question')} AS b FROM queries WHERE question IS NOT NULL AND search_question IS NOT NULL) SELECT DISTINCT id, list_sort(regexp_extract_all(a, '[0-9]+(?:\\.[0-9]+)?')) = list_sort(regexp_extract_all(b, '[0-9]+(?:\\.[0-9]+)?')) AS same_numbers, list_sort({_MODELS.format('a')}) = list_sort({_MODELS.format('b')}) AS same_models FROM q",
    "heading_keys": """WITH i AS (SELECT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents UNION ALL SELECT 'chunks', id, text FROM chunks),
      s AS (SELECT item_table, item_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line FROM i UNION ALL SELECT 'unit_drafts', draft_id, concat_ws(' ', section_key, title), 0 FROM unit_drafts),
      l AS (SELECT item_table, item_id, line, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM s),
      k AS (SELECT item_table, item_id, line, regexp_extract(t, '^(\\d+(?:[-.]\\d+)*)\\.? +[A-Za-z]', 1) AS key, regexp_extract(t, '^\\d+(?:[-.]\\d+)*\\.? +([A-Za-z].*)$', 1) AS title, t FROM l)
      SELECT DISTINCT item_table, item_id, line, rtrim(key, '.') AS key FROM k WHERE key <> '' AND length(t) <= 180 AND (contains(key, '-') OR length(regexp_replace(title, '[^A-Z]+', '', 'g')) >= 0.8 * length(regexp_replace(title, '[^A-Za-z]+', '', 'g')))""",
    "search_text_builder": """WITH p AS (SELECT DISTINCT draft_id, list_concat([title, text], CASE WHEN coalesce(condition_text, '') <> '' THEN ['Condition: ' || condition_text] ELSE [] END, CASE WHEN coalesce(cause, '') <> '' THEN ['Cause: ' || cause] ELSE [] END,
      list_transform(coalesce(checks, []), lambda x: 'Check: ' || x), list_transform(coalesce(actions, []), lambda x: 'Action: ' || x), list_transform(coalesce(warnings, []), lambda x: 'Warning: ' || x)) AS l FROM unit_drafts),
      e AS (SELECT draft_id, l, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM p), f AS (SELECT draft_id, l, x, min(i) AS i FROM e WHERE x IS NOT NULL AND x <> '' GROUP BY ALL)
      SELECT DISTINCT draft_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS search_text FROM p LEFT JOIN f USING (draft_id, l) GROUP BY draft_id, l""",
    "row_linearize": """WITH d AS (SELECT DISTINCT draft_id, table_headers, table_rows FROM unit_drafts WHERE len(table_rows) > 0), r AS (SELECT draft_id, table_headers AS h, unnest(table_rows) AS cells, CAST(generate_subscripts(table_rows, 1) - 1 AS INTEGER) AS "row" FROM d)
      SELECT DISTINCT draft_id, "row", array_to_string(list_transform(range(1, greatest(len(h), len(cells)) + 1), lambda i: coalesce(h[i], '') || ': ' || coalesce(cells[i], '[merged/blank]')), '; ') AS text FROM r""",
    "filled_cells": """WITH d AS (SELECT DISTINCT draft_id, table_rows FROM unit_drafts WHERE len(table_rows) > 0), r AS (SELECT draft_id, unnest(table_rows) AS cells, CAST(generate_subscripts(table_rows, 1) - 1 AS INTEGER) AS "row" FROM d),
      c AS (SELECT draft_id, "row", unnest(cells) AS cell, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS col FROM r) SELECT draft_id, "row", col, cell, last_value(cell IGNORE NULLS) OVER (PARTITION BY draft_id, col ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS filled FROM c""",
    "safety_notes": """WITH w AS (SELECT DISTINCT manual_id, page, trim(regexp_replace(regexp_replace(w, '^\\s*(DANGER|WARNING|CAUTION)\\b:?\\s*', ''), '\\s+', ' ', 'g')) AS warning FROM (SELECT manual_id, page, unnest(warnings) AS w FROM unit_drafts) WHERE w IS NOT NULL),
      g AS (SELECT warning, count(*) AS n_refs, min({'m': manual_id, 'p': page}) AS f FROM w WHERE warning <> '' GROUP BY warning) SELECT warning, n_refs, title, f.p AS page FROM g LEFT JOIN manuals ON manuals.id = f.m""",
    "draft_manifest": "WITH d AS (SELECT DISTINCT draft_id, manual_id, kind, page, section_key FROM unit_drafts) SELECT manual_id, count(*) AS units, count(*) FILTER (kind = 'table') AS tables, count(DISTINCT page) AS pages, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM d GROUP BY manual_id",
    "section_siblings": "WITH d AS (SELECT DISTINCT draft_id, manual_id, page, section_key, CASE WHEN contains(section_key, '-') THEN regexp_replace(section_key, '-[^-]*$', '') ELSE section_key END AS scope FROM unit_drafts WHERE section_key <> '') SELECT a.draft_id, b.draft_id AS sibling FROM d a JOIN d b USING (manual_id, page, scope) WHERE a.draft_id <> b.draft_id",
}
