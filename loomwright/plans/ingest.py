"""Queries of units made from the given drafts and chunks, of claims about them, and of how well questions are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import closure as C
from ..operators import ingest as I
from ..operators import linking as L
from ..operators import records as D
from ..operators import retrieval as R
from ..session import materialise
from ..tables import latest, table
from . import search as S
from .records import _DIGITS, _SRC
from .views import GIVEN, given_units


def _drafts(spark, folder) -> DataFrame:
    return table(spark, folder, "unit_drafts")


def paragraph_units(spark, folder):
    c = table(spark, folder, "chunks", "id", "text").distinct()
    return c.select("id", F.posexplode(I.paragraphs(F.col("text"))).alias("part", "text"))


def table_units(spark, folder):
    return I.table_units(_drafts(spark, folder))


def searchable_drafts(spark, folder):
    return I.searchable(_drafts(spark, folder))


def inherited_sections(spark, folder):
    return I.inherited_sections(_drafts(spark, folder))


def section_context(spark, folder):
    return I.section_context(_drafts(spark, folder))


def block_classes(spark, folder):
    """Given units as procedures, warnings and by the pages they refer to."""
    u = given_units(spark, folder)
    return u.select("unit_id", "kind", F.col("text").rlike("WARNING|CAUTION|DANGER").alias("warning"), F.array_join(X.page_references(F.col("text")), ",").alias("pages"))


def settings_found(spark, folder):
    return L.settings(given_units(spark, folder)).select(F.col("target").alias("unit_id"), "setting_id")


def _claimed(spark, folder) -> DataFrame:
    d = _drafts(spark, folder).select(F.col("draft_id").alias("item_id"), "manual_id", "page", "text")
    return I.setting_claims(d.unionByName(table(spark, folder, "chunks", F.col("id").alias("item_id"), "manual_id", "page", "text")))


def claim_support(spark, folder):
    return I.claim_support(_claimed(spark, folder), I.declared_settings(_drafts(spark, folder)))


def effective_settings(spark, folder):
    """The value that a manual ends with for each setting: what a later page says overrides what an earlier one does."""
    return _claimed(spark, folder).groupBy("manual_id", "setting_id").agg(F.max_by("value", F.struct("page", "item_id", "value")).alias("value"), F.countDistinct("value").alias("values"))


def pending_pages(spark, folder):
    """Pages of each manual that no chunk was extracted from, so that a run goes on with these."""
    m = table(spark, folder, "manuals", F.col("id").alias("manual_id"), "pages").where("pages > 0")
    pages = m.select("manual_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return pages.join(table(spark, folder, "chunks", "manual_id", "page").distinct(), ["manual_id", "page"], "left_anti").groupBy("manual_id").agg(F.count("*").alias("pending"), F.min("page").alias("first"))


def retirement_effect(spark, folder):
    """What goes from each table with the retired manuals: their chunks and drafts, the queries that cite them and their feedback."""
    gone = table(spark, folder, "manuals", F.col("id").alias("manual_id"), "status").where("status = 'retired'").select("manual_id")
    q = table(spark, folder, "queries", "id", "sources_json").distinct()
    left = D.without_manuals(q, gone)
    counted = lambda name, rows, kept: rows.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept"))).select(F.lit(name).alias("item_table"), "kept", (F.col("n") - F.col("kept")).alias("removed"))
    parts = []
    for name, key in (("chunks", "id"), ("unit_drafts", "draft_id")):
        rows = table(spark, folder, name, key, "manual_id").distinct()
        parts.append(counted(name, rows, rows.join(gone, "manual_id", "left_anti")))
    f = table(spark, folder, "feedback", F.col("query_id").alias("id"), "created_at", "verdict", "note").distinct()
    parts += [counted("queries", q, left), counted("feedback", f, f.join(q.join(left, "id", "left_anti").select("id").distinct(), "id", "left_anti"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feedback_changes(spark, folder):
    """What the second half of the time brought: feedback as it stood then against as it stands now."""
    rows = table(spark, folder, "feedback", "query_id", "verdict", "note", "created_at").where("query_id is not null")
    half = rows.agg(((F.unix_micros(F.min("created_at").cast("timestamp")) + F.unix_micros(F.max("created_at").cast("timestamp"))) / 2).cast("long").alias("half"))
    then = rows.crossJoin(F.broadcast(half)).where(F.unix_micros(F.col("created_at").cast("timestamp")) <= F.col("half")).drop("half")
    last = lambda df: latest(df, ["query_id"], "created_at")
    return I.snapshot_changes(last(then), last(rows), ["query_id"], "verdict", "note")


def _translated(spark, folder) -> DataFrame:
    q = table(spark, folder, "queries", "id", "question", "search_question").where("question is not null and search_question is not null").distinct()
    return q.select("id", X.ascii_digits(F.col("question")).alias("a"), X.ascii_digits(F.col("search_question")).alias("b"))


def event_terms_missing(spark, folder):
    return _translated(spark, folder).select("id", F.explode(I.missing_terms(F.col("a"), F.col("b"))).alias("term")).distinct()


def translation_drift(spark, folder):
    return _translated(spark, folder).select("id", *I.drift(F.col("a"), F.col("b"))).distinct()


def _cited_texts(spark, folder) -> DataFrame:
    q = table(spark, folder, "queries", "id", "question", "answer", "sources_json").where("question is not null").distinct()
    cited = q.select(F.col("id").alias("query_id"), "question", F.explode(D.sources(F.col("sources_json"))).alias("s")).select("query_id", "question", F.col("s.id").alias("chunk_id")).distinct()
    return cited.join(table(spark, folder, "chunks", F.col("id").alias("chunk_id"), "text").where("text is not null").distinct(), "chunk_id")


def evidence_filter(spark, folder):
    """Cited texts that may be evidence for their question."""
    return _cited_texts(spark, folder).select("query_id", "chunk_id", I.kept_evidence(F.col("question"), F.col("text")).alias("kept")).distinct()


def evidence_checks(spark, folder):
    """Questions of functions: whether each function that is asked about stands in the cited texts, and in the answer."""
    q = table(spark, folder, "queries", F.col("id").alias("query_id"), "question", F.coalesce("answer", F.lit("")).alias("answer")).where("question is not null").distinct()
    asked = q.select("query_id", "answer", F.array_distinct(F.regexp_extract_all("question", F.lit(r"(?i)\bFunction No\. ?(\d+)"), F.lit(1))).alias("asked")).where(F.size("asked") > 0)
    texts = _cited_texts(spark, folder).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("evidence"))
    told = lambda c: F.forall("asked", lambda n: F.rlike(c, F.concat(F.lit(r"(?i)\bFunction No\. ?"), n, F.lit(r"\b"))))
    return asked.join(texts, "query_id", "left").select("query_id", F.array_join("asked", ",").alias("asked"), told(F.coalesce("evidence", F.lit(""))).alias("evidence_ok"), told(F.col("answer")).alias("answer_ok")).distinct()


def eligible_neighbours(spark, folder):
    """Exact nearest neighbours of which only those with a text stay; none comes up in the place of one that goes."""
    texts = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").rlike(r"\S")).select("doc_id")
    return S._ranked_dense(spark, folder).join(texts, "doc_id", "left_semi")


def retrieval_configurations(spark, folder):
    """Lexical, dense and fused search compared: questions, those with a document of their own source among the first four, and the
    mean of the reciprocal rank of the first such document among the first 24."""
    lexical, dense = materialise(S.bm25_topk(spark, folder), "lexical"), materialise(S._ranked_dense(spark, folder), "dense")
    fused = R.fused(dense, lexical).select("query_id", "doc_id", F.col("fused_rank").alias("rank"))
    ranked = lambda df, name: df.select(F.lit(name).alias("configuration"), "query_id", "doc_id", "rank")
    every = ranked(lexical, "lexical").unionByName(ranked(dense, "dense")).unionByName(ranked(fused, "fused"))
    asked = S._asked(spark, folder).select("query_id", "source")
    source = table(spark, folder, "documents", "doc_id", F.col("source").alias("of"))
    first = every.join(asked, "query_id").join(source, "doc_id").where("of = source").groupBy("configuration", "query_id").agg(F.min("rank").alias("first"))
    names = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c) for c in ("lexical", "dense", "fused")])).alias("configuration"))
    total = asked.agg(F.count("*").alias("questions"))
    hits = first.groupBy("configuration").agg(F.count_if(F.col("first") <= 4).alias("hits"), F.sum(1 / F.col("first")).alias("s"))
    return names.crossJoin(total).join(hits, "configuration", "left").select("configuration", "questions", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("s", F.lit(0.0)) / F.col("questions"), 6).alias("reciprocal"))


def evidence_map(spark, folder):
    """For each question and intent the primary and the supporting documents in order, and whether all its intents are covered."""
    d = table(spark, folder, "documents", F.col("doc_id").alias("query_id"), "title", "source").where("query_id % 20 = 0")
    asked = d.select((F.col("query_id") * 2).alias("query_id"), F.col("title").alias("question")).unionByName(d.select((F.col("query_id") * 2 + 1).alias("query_id"), F.col("source").alias("question"))).where("question is not null")
    found = R.bm25_top(S._docs(spark, folder), asked)
    found = found.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).cast("int").alias("intent"), "doc_id", "rank")
    docs = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("rank", "doc_id")))), lambda x: x["doc_id"].cast("string")), ",")
    out = found.groupBy("query_id", "intent").agg(docs(F.col("rank") <= 4).alias("primary"), docs(F.col("rank") > 4).alias("supporting"))
    both = asked.groupBy(F.floor(F.col("query_id") / 2).alias("query_id")).agg(F.count("*").alias("intents"))
    covered = F.count("*").over(Window.partitionBy("query_id")) == F.col("intents")
    return out.join(both, "query_id").select("query_id", "intent", "primary", "supporting", covered.alias("covered"))


def _by_20(number: Column) -> Column:
    """The remainder of a hexadecimal number of up to 32 digits after division by 20; 2 to the power of 64 leaves 16."""
    digits = F.lpad(number, 32, "0")
    part = lambda at: F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(38,0)") % 20
    return F.when(number.rlike("^[0-9a-fA-F]{1,32}$"), (part(1) * 16 + part(17)) % 20)


def evidence_search(spark, folder):
    """(query_id, node, via, applicability): search over the given units from question to evidence. Asked are the questions whose id,
    a hexadecimal number, is divisible by 20, of all units. The first 24 by BM25, without those of electrical noise, unrelated settings or another pitch;
    the first four of these, and all that they need: notes, settings, warnings, exceptions, plain notes. ``via`` tells a match
    from what came along; applicability is that of the sub-class that the question names."""
    q = table(spark, folder, "queries", F.col("id").alias("query_id"), "question").where((_by_20(F.col("id")) == 0) & F.col("question").isNotNull()).groupBy("query_id").agg(F.max("question").alias("question"))
    q, u = materialise(q, "asked"), materialise(given_units(spark, folder), "units")
    found = R.bm25_top(u, q, doc_id="unit_id").withColumnRenamed("doc_id", "node")
    # of a text only what is judged is shuffled
    text = u.select(F.col("unit_id").alias("node"), I.judged_text(F.col("text")).alias("text"))
    kept = found.join(q, "query_id").join(text, "node").where(I.kept_evidence(F.col("question"), F.col("text"))).select("query_id", F.col("node").alias("doc_id"), "rank")
    first = materialise(R.top(kept.withColumn("order", -F.col("rank")), F.col("order"), 4, "place").select("query_id", F.col("doc_id").alias("node")), "matches")
    none = F.lit(None).cast("string")
    edges = L.requirement_edges(u).select("src", "dst", "required_value", none.alias("when_value")).unionByName(L.note_edges(u).select("src", "dst", none.alias("required_value"), "when_value")).unionByName(L.hub_edges(u).select("src", "dst", none.alias("required_value"), none.alias("when_value")))
    nodes = C.evidence_closure(materialise(edges.distinct(), "edges"), first.withColumn("required_value", none)).select("query_id", "node").distinct().where(~F.col("node").startswith("hub:"))
    scope = u.select(F.col("unit_id").alias("node"), I.scoped_patterns(F.col("text")).alias("patterns"), F.coalesce(L._excludes(F.col("text")), F.lit(False)).alias("excludes"))
    rows = nodes.join(first.withColumn("hit", F.lit(True)), ["query_id", "node"], "left").join(q, "query_id").join(scope, "node")
    fits = F.exists("patterns", lambda p: F.exists("named", lambda s: X.matches_model(p, s)))
    rows = rows.withColumn("named", X.subclasses(F.col("question")))
    status = F.when(F.size("named") == 0, None).when(F.col("excludes") & fits, "excluded").when(F.size("patterns") > 0, F.when(fits, "within").otherwise("outside")).otherwise("not_established")
    return rows.select("query_id", "node", F.when(F.col("hit"), "match").otherwise("needed").alias("via"), status.alias("applicability"))


QUERIES = {q.__name__: q for q in (paragraph_units, table_units, searchable_drafts, inherited_sections, section_context, block_classes, settings_found, claim_support, effective_settings, pending_pages, retirement_effect, feedback_changes, event_terms_missing, translation_drift, evidence_filter, evidence_checks, eligible_neighbours, retrieval_configurations, evidence_map, evidence_search)}

_ROWS = """r0 AS (SELECT DISTINCT draft_id, manual_id, title, table_headers AS h, table_rows FROM unit_drafts WHERE len(table_rows) > 0),
  r1 AS (SELECT draft_id, manual_id, h, unnest(table_rows) AS cells, CAST(generate_subscripts(table_rows, 1) - 1 AS INTEGER) AS row_no FROM r0),
  r AS (SELECT draft_id, manual_id, row_no, array_to_string(list_transform(range(1, greatest(len(h), len(cells)) + 1), lambda i: coalesce(h[i], '') || ': ' || coalesce(cells[i], '[merged/blank]')), '; ') AS text FROM r1)"""
_CLAIMS = """ct AS (SELECT draft_id AS item_id, manual_id, page, text FROM unit_drafts UNION SELECT id, manual_id, page, text FROM chunks),
  cm AS (SELECT item_id, manual_id, page, unnest(regexp_extract_all(text, '(?i)\\bset\\s+Function\\s+No\\.?\\s*\\d+\\s+to\\s+\\d+')) AS m FROM ct),
  cl AS (SELECT DISTINCT item_id, manual_id, page, 'function:' || regexp_extract(m, '(?i)No\\.?\\s*(\\d+)', 1) AS setting_id, CAST(regexp_extract(m, '(\\d+)$', 1) AS INTEGER) AS value FROM cm)"""
_CITED = f"""{_SRC}, ci AS (SELECT DISTINCT e.id AS query_id, x.question, s.id AS chunk_id, c.text FROM e JOIN (SELECT DISTINCT id, question FROM queries WHERE question IS NOT NULL) x ON x.id = e.id JOIN (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL) c ON c.id = s.id)"""
_TR = f"WITH t AS (SELECT DISTINCT id, {_DIGITS.format('question')} AS a, {_DIGITS.format('search_question')} AS b FROM queries WHERE question IS NOT NULL AND search_question IS NOT NULL)"


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _has(c: str, p: str) -> str:
    p = p.replace("|V\\b", "|V(?:[^\\p{L}\\p{M}\\p{N}_]|$)")  # a word's end is ASCII only in DuckDB
    return f"regexp_matches({c}, {_quoted(p)})"


_BI = "NOT regexp_matches(regexp_replace(a, '[\\p{Latin}\\x{0980}-\\x{09ff}]', '', 'g'), '\\p{L}')"
_BOUND = "list_transform(regexp_extract_all({0}, " + _quoted(I.BINDING) + "), lambda m: regexp_extract(m, " + _quoted(I.BINDING) + ", 1) || '=' || regexp_extract(m, " + _quoted(I.BINDING) + ", 2))"


def _same(p: str) -> str:
    return f"CASE WHEN bi THEN {_has('a', p)} = {_has('b', p)} ELSE NOT {_has('a', p)} OR {_has('b', p)} END"


def _unit(u: str) -> str:
    bare = lambda c: f"list_sort(list_transform(regexp_extract_all({c}, {_quoted('(' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?)' + chr(92) + 's*(?:' + u + ')')}), lambda x: regexp_extract(x, '([0-9.]+)', 1)))"
    return f"({_same(u)}) AND (NOT (bi OR {_has('a', u)}) OR {bare('a')} = {bare('b')})"


_NOISY = f"(NOT {_has('question', X.ELECTRICAL)} AND {_has('question', X.HEARD)})"

ORACLE = {
    "paragraph_units": """WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL),
      p AS (SELECT id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(31), 'g'), '(?im)^(\\s*(?:\\(NOTE\\s+\\d+\\)|\\*\\s*\\d+\\s+[A-Za-z]))', chr(31) || '\\1', 'g'), chr(31)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM c),
      u AS (SELECT id, text, unnest(l) AS part, generate_subscripts(l, 1) AS k FROM p),
      s AS (SELECT id, text, k, CASE WHEN len(string_split_regex(part, '\\s+')) <= 250 THEN [part] ELSE string_split(regexp_replace(part, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) END AS parts FROM u),
      r AS (SELECT id, text, k, list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN len(string_split_regex(a[len(a)] || ' ' || x[1], '\\s+')) > 250 THEN list_append(a, x[1]) ELSE list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) END) AS packed FROM s),
      f AS (SELECT id, text, flatten(list(packed ORDER BY k)) AS l FROM r GROUP BY ALL) SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS part, unnest(l) AS text FROM f""",
    "table_units": f"WITH {_ROWS} SELECT draft_id AS unit_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS INTEGER) AS row, concat_ws(chr(10), title, 'Column headers: ' || array_to_string(h, '; ')) AS text FROM r0 UNION SELECT concat_ws('#', draft_id, row_no), draft_id, row_no, text FROM r",
    "searchable_drafts": "SELECT DISTINCT draft_id, NOT (kind = 'table' AND (len(list_filter(flatten(table_rows), lambda c: c IS NULL)) > 0 OR len(list_filter(table_headers, lambda h: coalesce(h, '') = '')) > 0 OR (parent_key IS NULL AND len(table_rows) > 1))) AS searchable FROM unit_drafts",
    "inherited_sections": """WITH d AS (SELECT DISTINCT draft_id, manual_id, page, coalesce(section_key, '') AS own FROM unit_drafts), o AS (SELECT manual_id, page, any_value(own) AS a FROM d WHERE own <> '' GROUP BY ALL HAVING count(DISTINCT own) = 1)
      SELECT draft_id, CASE WHEN own <> '' THEN own ELSE coalesce(a, '') END AS section_key, own = '' AND a IS NOT NULL AS inherited FROM d LEFT JOIN o USING (manual_id, page)""",
    "section_context": """WITH d AS (SELECT DISTINCT draft_id, manual_id, page, CASE WHEN contains(section_key, '-') THEN regexp_replace(section_key, '-[^-]*$', '') ELSE section_key END AS scope, coalesce(length(text), 0) AS size FROM unit_drafts WHERE section_key <> '' AND kind <> 'table'),
      p AS (SELECT a.draft_id, list({'id': b.draft_id, 'size': b.size} ORDER BY b.draft_id) AS l FROM d a JOIN d b USING (manual_id, page, scope) WHERE a.draft_id <> b.draft_id GROUP BY a.draft_id),
      t AS (SELECT draft_id, list_reduce(list_prepend({'size': 0, 'ids': CAST([] AS VARCHAR[])}, list_transform(l, lambda x: {'size': CAST(x.size AS INTEGER), 'ids': [x.id]})), lambda s, x: CASE WHEN s.size + x.size <= 4000 THEN {'size': s.size + x.size, 'ids': list_concat(s.ids, x.ids)} ELSE s END).ids AS ids FROM p)
      SELECT draft_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS position, unnest(ids) AS sibling FROM t""",
    "block_classes": f"WITH {GIVEN} SELECT unit_id, kind, regexp_matches(text, 'WARNING|CAUTION|DANGER') AS warning, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS pages FROM (SELECT *, regexp_extract_all(text, '(?i)\\b(?:refer to|see|on) page\\s+(\\d+)', 1) AS p FROM u)",
    "settings_found": f"WITH {GIVEN} SELECT unit_id, 'function:' || regexp_extract(text, '(?:^|; )No\\.: *(\\d+)', 1) AS setting_id FROM u WHERE kind = 'table' AND contains(text, 'Setting range:') AND regexp_matches(text, '(?:^|; )No\\.: *\\d+')",
    "claim_support": f"""WITH {_ROWS}, {_CLAIMS}, dc AS (SELECT DISTINCT manual_id, 'function:' || regexp_extract(text, '(?:^|; )No\\.: *(\\d+)', 1) AS setting_id, CAST(nullif(regexp_extract(text, 'Setting range: *(\\d+)-(\\d+)', 1), '') AS INTEGER) AS low, CAST(nullif(regexp_extract(text, 'Setting range: *(\\d+)-(\\d+)', 2), '') AS INTEGER) AS high FROM r),
      s AS (SELECT item_id, setting_id, value, bool_or(value BETWEEN low AND high) AS inside FROM cl LEFT JOIN (FROM dc WHERE low IS NOT NULL AND setting_id <> 'function:') dc USING (manual_id, setting_id) GROUP BY ALL)
      SELECT item_id, setting_id, value, CASE WHEN inside THEN 'supported' WHEN inside IS NULL THEN 'undeclared' ELSE 'out_of_range' END AS support FROM s""",
    "effective_settings": f"WITH {_CLAIMS} SELECT manual_id, setting_id, arg_max(value, {{'p': page, 'i': item_id, 'v': value}}) AS value, count(DISTINCT value) AS values FROM cl GROUP BY ALL",
    "pending_pages": "WITH p AS (SELECT id AS manual_id, CAST(unnest(range(1, pages + 1)) AS INTEGER) AS page FROM manuals WHERE pages > 0) SELECT manual_id, count(*) AS pending, min(page) AS first FROM p WHERE (manual_id, page) NOT IN (SELECT (manual_id, page) FROM chunks WHERE manual_id IS NOT NULL AND page IS NOT NULL) GROUP BY manual_id",
    "retirement_effect": f"""WITH {_SRC}, g AS (SELECT id FROM manuals WHERE status = 'retired'), dq AS (SELECT DISTINCT id, sources_json FROM queries), bad AS (SELECT DISTINCT id FROM e WHERE s.manual_id IN (FROM g) OR string_split(s.id, ':')[1] IN (FROM g)),
      t AS (SELECT 'chunks' AS item_table, manual_id IN (FROM g) AS gone FROM (SELECT DISTINCT id, manual_id FROM chunks) UNION ALL SELECT 'unit_drafts', manual_id IN (FROM g) FROM (SELECT DISTINCT draft_id, manual_id FROM unit_drafts)
        UNION ALL SELECT 'queries', id IN (FROM bad) FROM dq UNION ALL SELECT 'feedback', query_id IN (FROM bad) FROM (SELECT DISTINCT query_id, created_at, verdict, note FROM feedback))
      SELECT item_table, count(*) FILTER (gone IS NOT TRUE) AS kept, count(*) FILTER (gone) AS removed FROM t GROUP BY item_table""",
    "feedback_changes": """WITH f AS (SELECT DISTINCT query_id, verdict, note, created_at FROM feedback WHERE query_id IS NOT NULL), h AS (SELECT CAST((epoch_us(min(created_at)) + epoch_us(max(created_at))) // 2 AS BIGINT) AS half FROM f),
      o AS (SELECT query_id, verdict, note FROM f, h WHERE epoch_us(created_at) <= half QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST, note DESC NULLS LAST) = 1),
      n AS (SELECT query_id, verdict, note FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST, note DESC NULLS LAST) = 1)
      SELECT n.query_id, CASE WHEN o.query_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (query_id) WHERE o.query_id IS NULL OR o.verdict IS DISTINCT FROM n.verdict OR o.note IS DISTINCT FROM n.note""",
    "event_terms_missing": f"{_TR}, m AS (SELECT id, a, b, unnest([{', '.join('$$' + a + '$$' for a, _ in I.EVENT_TERMS)}]) AS term, unnest([{', '.join('$$(?i)' + b + '$$' for _, b in I.EVENT_TERMS)}]) AS target FROM t) SELECT DISTINCT id, term FROM m WHERE regexp_matches(a, term) AND NOT regexp_matches(b, target)",
    "translation_drift": f"""{_TR}, f AS (SELECT *, {_BI} AS bi FROM t) SELECT DISTINCT id, len(list_filter({_BOUND.format('a')}, lambda x: NOT list_contains({_BOUND.format('b')}, x))) = 0 AS bindings_kept,
      {' AND '.join(f'({_same(c)})' for c in I.CONCEPTS)} AS concepts_same, {' AND '.join(f'({_unit(u)})' for u in I.UNITS)} AS units_same, CASE WHEN bi THEN {_has('a', I.NEGATION)} = {_has('b', I.NEGATION)} ELSE true END AS negation_same FROM f""",
    "evidence_filter": f"""WITH {_CITED} SELECT DISTINCT query_id, chunk_id, NOT ({_NOISY} AND (({_has('text', X.ELECTRICAL_NOISE)} AND NOT {_has('text', X.OTHER_NOISE)}) OR (NOT {_has('question', X.SETTING_ASKED)} AND {_has('text', X.SETTING_TEXT)}))) AS kept FROM ci""",
    "evidence_checks": f"""WITH {_CITED}, q2 AS (SELECT DISTINCT id AS query_id, coalesce(answer, '') AS answer, list_distinct(regexp_extract_all(question, '(?i)\\bFunction No\\. ?(\\d+)', 1)) AS asked FROM queries WHERE question IS NOT NULL),
      t AS (SELECT query_id, string_agg(DISTINCT text, chr(10)) AS evidence FROM ci GROUP BY query_id)
      SELECT DISTINCT query_id, array_to_string(asked, ',') AS asked, len(list_filter(asked, lambda n: NOT regexp_matches(coalesce(evidence, ''), '(?i)\\bFunction No\\. ?' || n || '\\b'))) = 0 AS evidence_ok, len(list_filter(asked, lambda n: NOT regexp_matches(answer, '(?i)\\bFunction No\\. ?' || n || '\\b'))) = 0 AS answer_ok FROM q2 LEFT JOIN t USING (query_id) WHERE len(asked) > 0""",
    "eligible_neighbours": f"SELECT * FROM ({S._COSINE}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S'))",
    "retrieval_configurations": f"""WITH {S._FUSED}, k AS (SELECT 'lexical' AS configuration, query_id, doc_id, rank FROM l UNION ALL SELECT 'dense', query_id, doc_id, rank FROM d UNION ALL SELECT 'fused', query_id, doc_id, fused_rank FROM g WHERE fused_rank <= 24),
      a AS (SELECT doc_id AS query_id, source FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), m AS (SELECT configuration, k.query_id, min(rank) AS first FROM k JOIN a USING (query_id) JOIN documents x ON x.doc_id = k.doc_id AND x.source = a.source GROUP BY ALL)
      SELECT configuration, (SELECT count(*) FROM a) AS questions, count(*) FILTER (first <= 4) AS hits, round(sum(1.0 / first) / (SELECT count(*) FROM a), 6) AS reciprocal FROM m GROUP BY configuration""",
    "evidence_map": f"""WITH {S._TERMS}, i AS (SELECT doc_id AS query_id, 0 AS intent, title AS question FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id, 1, source FROM documents WHERE doc_id % 20 = 0),
      iq AS (SELECT DISTINCT query_id, intent, unnest({S.sql_tokens('question')}) AS term FROM i), n AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS a FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, intent, tf.doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM iq JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY score DESC, doc_id) AS rank FROM s), c AS (SELECT query_id, count(*) AS intents FROM i WHERE question IS NOT NULL GROUP BY query_id),
      o AS (SELECT query_id, intent, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 4), '') AS primary, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank > 4), '') AS supporting FROM r WHERE rank <= 24 GROUP BY ALL)
      SELECT query_id, intent, o.primary, supporting, count(*) OVER (PARTITION BY query_id) = intents AS covered FROM o JOIN c USING (query_id)""",
}
