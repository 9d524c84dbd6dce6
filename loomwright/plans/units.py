"""Linking, closure and layout queries over the views of units, edges and boxes, and as `given_…` over the given units."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import closure as C
from ..operators import layout as Y
from ..operators import linking as L
from ..session import materialise
from ..tables import table
from .views import BOXES, EDGES, GIVEN as GIVEN_SQL, UNITS, given_units, view


def _units(spark, folder):
    return view(spark, folder, UNITS)


def manual_units(spark, folder):
    return _units(spark, folder).select("unit_id", "manual_id", "page", "section_key", "kind")


def note_refs(spark, folder, units=_units):
    return L.note_references(units(spark, folder))


def note_edges(spark, folder, units=_units):
    return L.note_edges(units(spark, folder))


def unresolved_notes(spark, folder, units=_units):
    return L.unresolved_notes(units(spark, folder))


def setting_requirements(spark, folder, units=_units):
    return units(spark, folder).select("unit_id", F.explode(X.requirements(F.col("text"))).alias("r")).select("unit_id", "r.setting_id", "r.value")


def requirement_edges(spark, folder, units=_units):
    return L.requirement_edges(units(spark, folder))


def warning_edges(spark, folder, units=_units):
    return L.warnings_of(units(spark, folder))


def page_reference_edges(spark, folder, units=_units):
    return L.page_reference_edges(units(spark, folder))


def unresolved_page_refs(spark, folder, units=_units):
    return L.unresolved_pages(units(spark, folder))


def applicability_edges(spark, folder, units=_units):
    return L.exceptions_of(units(spark, folder))


def applicability_status(spark, folder, units=_units):
    return L.applicability(units(spark, folder), "-47A").select("unit_id", F.array_join("patterns", ",").alias("patterns"), "status")


def pitch_condition(spark, folder, units=_units, number="unit_id"):
    u = units(spark, folder).where(F.col("text").rlike(r"(?i)\bpitch\b"))
    asked = F.concat(F.lit("What speed at pitch "), (F.col(number) % 7).cast("string"), F.lit(".5 mm"))
    return u.select("unit_id", X.pitch_condition(asked, F.col("text")).alias("meets"))


def searchable_units(spark, folder):
    u = _units(spark, folder)
    return u.where((F.col("blocked") == 0) & ~((F.col("kind") == "table") & (F.col("extraction_method") == "vlm"))).select("unit_id", "kind")


def release_manifest(spark, folder, units=_units):
    """Counts of a release: units, blocked ones, and edges by relation, one row for each manual."""
    u = units(spark, folder)
    e = L.note_edges(u).select("src", F.lit("note").alias("relation")).unionByName(L.requirement_edges(u).select("src", F.lit("prerequisite").alias("relation")))
    by = e.join(u.select(F.col("unit_id").alias("src"), "manual_id"), "src").groupBy("manual_id").pivot("relation", ["note", "prerequisite"]).count()
    n = u.groupBy("manual_id").agg(F.count("*").alias("units"), F.sum("blocked").alias("blocked"), F.count_if(F.col("kind") == "table").alias("tables"))
    return n.join(by, "manual_id", "left").select("manual_id", "units", "blocked", "tables", F.coalesce("note", F.lit(0)).alias("note_edges"), F.coalesce("prerequisite", F.lit(0)).alias("prerequisite_edges"))


def section_carry_forward(spark, folder):
    u = _units(spark, folder).withColumn("heading", F.when(F.col("unit_id") % 6 == 0, F.col("section_key")))
    return Y.carried(u, ["manual_id", "page"], ["unit_id"], "heading", "section").select("unit_id", "section")


def overlap_blocks(spark, folder):
    return Y.covered_blocks(view(spark, folder, BOXES), ["manual_no", "page"]).select("box_id", F.round("covered", 9).alias("covered"))


def page_bounds(spark, folder):
    """Union of each page's boxes."""
    return view(spark, folder, BOXES).groupBy("manual_no", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _seeds(spark, folder):
    return table(spark, folder, "orders", F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("node"), F.lit(None).cast("string").alias("required_value")).where("query_id % 20 = 0")


def evidence_closure(spark, folder):
    return C.evidence_closure(view(spark, folder, EDGES), _seeds(spark, folder)).select("query_id", "node").distinct()


def conditional_closure(spark, folder):
    return C.evidence_closure(view(spark, folder, EDGES), _seeds(spark, folder))


def closure_budget_guard(spark, folder):
    return C.closure_sizes(evidence_closure(spark, folder), _units(spark, folder).select(F.col("unit_id").alias("node"), "text"), 400)


def setting_conflicts(spark, folder, units=_units):
    """Values that a manual's units require of each setting; a conflict where they are several."""
    r = units(spark, folder).select("manual_id", F.explode(X.requirements(F.col("text"))).alias("r")).groupBy("manual_id", F.col("r.setting_id").alias("setting_id")).agg(F.array_join(F.sort_array(F.collect_set("r.value")), ",").alias("required"), F.countDistinct("r.value").alias("n"))
    return r.withColumn("conflict", F.col("n") > 1)


def hypothesis_assessment(spark, folder, units=_units):
    """Required settings against known ones (function n is set to n modulo 3): possible or ruled out."""
    r = units(spark, folder).select("unit_id", F.explode(X.requirements(F.col("text"))).alias("r"))
    known = (F.substring_index("r.setting_id", ":", -1).cast("int") % 3).cast("string")
    return r.groupBy("unit_id").agg(F.count_if(F.col("r.value") != known).alias("against")).select("unit_id", F.when(F.col("against") > 0, "ruled_out").otherwise("possible").alias("assessment"))


def claim_violations(spark, folder, units=_units):
    """Units as claims: values out of the declared range of their setting, and citations of units that aren't there."""
    u = units(spark, folder)
    declared = u.where("kind = 'table'").select("manual_id", F.concat(F.lit("function:"), F.regexp_extract("text", r"^No\.: (\d+);", 1)).alias("setting_id"), F.regexp_extract("text", r"range: (\d+)-", 1).try_cast("int").alias("low"), F.regexp_extract("text", r"range: \d+-(\d+)", 1).try_cast("int").alias("high")).distinct()
    claimed = u.select("unit_id", "manual_id", F.explode(X.requirements(F.col("text"))).alias("r")).select("unit_id", "manual_id", "r.setting_id", F.col("r.value").try_cast("int").alias("value"))
    unknown = claimed.join(declared, ["manual_id", "setting_id"], "left_anti").select("unit_id", F.lit("undeclared_setting").alias("code"))
    out = claimed.join(declared, ["manual_id", "setting_id"]).where("value < low or value > high").select("unit_id", F.lit("value_out_of_range").alias("code"))
    cited = L.unresolved_notes(u).select("unit_id", F.lit("citation_missing").alias("code"))
    return unknown.unionByName(out).unionByName(cited).distinct()


def _given_closure(spark, folder):
    """Closure of every given unit over all mandatory edges that linking finds, by way of hubs; pages referred to are followed from
    the unit itself only, not from its context."""
    u = materialise(given_units(spark, folder), "units")
    none = F.lit(None).cast("string")
    edges = L.requirement_edges(u).select("src", "dst", "required_value", none.alias("when_value"))
    edges = edges.unionByName(L.note_edges(u).select("src", "dst", none.alias("required_value"), "when_value")).unionByName(L.hub_edges(u).select("src", "dst", none.alias("required_value"), none.alias("when_value")))
    own = u.select(F.col("unit_id").alias("query_id"), F.col("unit_id").alias("node"))
    pages = L.page_reference_edges(u).select(F.col("src").alias("query_id"), F.col("dst").alias("node"))
    found = C.evidence_closure(materialise(edges.distinct(), "edges"), own.unionByName(pages).withColumn("required_value", none))
    return found.where(~F.col("node").startswith("hub:"))


def given_conditional_closure(spark, folder):
    return _given_closure(spark, folder)


def given_evidence_closure(spark, folder):
    return _given_closure(spark, folder).select("query_id", "node").distinct()


def given_closure_budget_guard(spark, folder):
    return C.closure_sizes(given_evidence_closure(spark, folder), given_units(spark, folder).select(F.col("unit_id").alias("node"), "text"))


def blocked_closures(spark, folder):
    """Queries whose evidence has units with unresolved issues, and how many: these must not be answered from it."""
    blocked = _units(spark, folder).where("blocked = 1").select(F.col("unit_id").alias("node"))
    return evidence_closure(spark, folder).join(blocked, "node").groupBy("query_id").agg(F.count("*").alias("blocked"), F.min("node").alias("first"))


def note_footnotes(spark, folder):
    """The texts of the notes that a unit refers to, in the order of the notes' units: what its search text gains."""
    u = materialise(_units(spark, folder), "units")
    e = L.note_edges(u).select("src", "dst").distinct().join(u.select(F.col("unit_id").alias("dst"), "text"), "dst")
    notes = F.array_sort(F.collect_list(F.struct("dst", "text")))
    return e.groupBy("src").agg(F.array_join(F.transform(notes, lambda x: x["text"]), "\n").alias("footnotes"), F.count("*").alias("notes"))


def blocking_issues(spark, folder):
    """Units that can't stand alone as evidence: a note that is missing or not unique, a required function without a definition."""
    u = _units(spark, folder)
    notes = L.unresolved_notes(u).select("unit_id", F.concat(F.lit("note "), "number").alias("issue"))
    required = L.required_settings(u)
    need = required.select("unit_id", "setting_id").where("setting_id like 'function:%'").distinct()
    met = L.requirement_edges(u, required).select(F.col("src").alias("unit_id"), "setting_id").distinct()
    return notes.unionByName(need.join(met, ["unit_id", "setting_id"], "left_anti").select("unit_id", F.concat(F.lit("setting "), "setting_id").alias("issue"))).distinct()


GIVEN = {f"given_{q.__name__}": partial(q, units=given_units) for q in (note_refs, note_edges, unresolved_notes, setting_requirements, requirement_edges, warning_edges, page_reference_edges, unresolved_page_refs, applicability_edges, applicability_status, release_manifest, setting_conflicts, hypothesis_assessment, claim_violations)}
GIVEN |= {"given_pitch_condition": partial(pitch_condition, units=given_units, number="page")}
GIVEN |= {q.__name__: q for q in (given_conditional_closure, given_evidence_closure, given_closure_budget_guard)}

QUERIES = {q.__name__: q for q in (manual_units, note_refs, note_edges, unresolved_notes, setting_requirements, requirement_edges, warning_edges, page_reference_edges, unresolved_page_refs, applicability_edges, applicability_status, pitch_condition, searchable_units, release_manifest, section_carry_forward, overlap_blocks, page_bounds, evidence_closure, conditional_closure, closure_budget_guard, setting_conflicts, hypothesis_assessment, claim_violations, blocked_closures, note_footnotes, blocking_issues)} | GIVEN

_U = f"u AS ({UNITS})"
_DEF = """d AS (SELECT *, regexp_extract(text, '(?i)^\\s*\\(?NOTE\\s+(\\d+)\\)?(?:\\s|:)', 1) AS own FROM u),
  r0 AS (SELECT unit_id, manual_id, section_key, page, own, unnest(list_distinct(flatten(list_transform(regexp_extract_all(text, '(?i)\\bNOTES?\\s+(\\d+(?:\\s*(?:,|and|&|to|[-–])\\s*\\d+)*)', 1), lambda g: regexp_extract_all(g, '\\d+'))))) AS number FROM d),
  r AS (SELECT unit_id, manual_id, section_key, page, number FROM r0 WHERE number <> own)"""


def _unique(owner: str, pairs: str) -> str:
    """The one meant among candidates, in SQL: native ones first, then equal wordings of a page, then the owner's page."""
    return f"""p AS ({pairs}), p1 AS (SELECT * FROM p QUALIFY (t_method <> 'vlm') = bool_or(t_method <> 'vlm') OVER (PARTITION BY {owner})),
      p2 AS (SELECT {owner}, page, t_page, trim(regexp_replace(t_text, '\\s+', ' ', 'g')) AS w, max(target) AS target FROM p1 GROUP BY ALL),
      p3 AS (SELECT {owner}, CASE WHEN count(*) = 1 THEN max(target) WHEN count(*) FILTER (t_page = page) = 1 THEN max(target) FILTER (t_page = page) END AS target FROM p2 GROUP BY {owner})"""


_NOTE = f"{_U}, {_DEF}, " + _unique("unit_id, number", "SELECT r.unit_id, r.number, r.page, d.unit_id AS target, d.page AS t_page, d.extraction_method AS t_method, d.text AS t_text FROM r JOIN d ON d.manual_id = r.manual_id AND d.section_key = r.section_key AND d.own = r.number") + ", ne AS (SELECT unit_id AS src, target AS dst, number, CAST(NULL AS VARCHAR) AS when_value FROM p3 WHERE target IS NOT NULL AND target <> unit_id)"
_REQ = """q AS (SELECT unit_id, manual_id, section_key, page, concat('function:', regexp_extract(text, 'Function No. (\\d+) is set to "(\\d)"', 1)) AS setting_id, regexp_extract(text, 'is set to "(\\d)"', 1) AS value FROM u WHERE unit_id % 4 = 0 AND text NOT LIKE '%disabled%' AND text NOT LIKE '%" or "%')"""
_TIER = f"""{_U}, {_REQ}, s AS (SELECT manual_id, section_key, concat('function:', regexp_extract(text, '^No.: (\\d+)', 1)) AS setting_id, unit_id AS target, page AS t_page, extraction_method AS t_method, text AS t_text FROM u WHERE kind = 'table'),
  near AS (SELECT q.unit_id, q.setting_id, q.value, q.page, target, t_page, t_method, t_text, 'section' AS tier FROM q JOIN s USING (manual_id, section_key, setting_id)),
  far AS (SELECT q.unit_id, q.setting_id, q.value, q.page, target, t_page, t_method, t_text, 'manual' AS tier FROM q JOIN s USING (manual_id, setting_id) WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.unit_id = q.unit_id AND near.setting_id = q.setting_id)), """ + _unique("unit_id, setting_id, value, tier", "SELECT * FROM near UNION ALL SELECT * FROM far") + ", re AS (SELECT unit_id AS src, target AS dst, setting_id, value AS required_value, tier FROM p3 WHERE target IS NOT NULL AND target <> unit_id)"
_REFS = _U + ", pr AS (SELECT unit_id AS src, manual_id, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b(?:refer to|see|on) page\\s+(\\d+)', 1))) AS label FROM u)"
_EXC = _U + ", x AS (SELECT *, regexp_matches(text, '(?i)not\\s+(necessary|required|applicable|available)') AND regexp_matches(text, '(?i)sub[- ]?class') AS exception FROM u)"
_CLOSURE = f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT o_orderkey AS query_id, o_orderkey AS node, CAST(NULL AS VARCHAR) AS required_value FROM orders WHERE o_orderkey % 20 = 0
  UNION SELECT c.query_id, e.dst, e.required_value FROM c JOIN e ON e.src = c.node WHERE e.when_value IS NULL OR c.required_value IS NULL OR e.when_value = c.required_value)"""

ORACLE = {
    "manual_units": f"WITH {_U} SELECT unit_id, manual_id, page, section_key, kind FROM u",
    "note_refs": f"WITH {_U}, {_DEF} SELECT *, CAST(NULL AS VARCHAR) AS when_value FROM r",
    "note_edges": f"WITH {_NOTE} SELECT * FROM ne",
    "unresolved_notes": f"WITH {_NOTE} SELECT DISTINCT unit_id, number FROM r WHERE (unit_id, number) NOT IN (SELECT (src, number) FROM ne)",
    "setting_requirements": f"WITH {_U}, {_REQ} SELECT unit_id, setting_id, value FROM q",
    "requirement_edges": f"WITH {_TIER} SELECT * FROM re",
    "warning_edges": f"""WITH {_U}, w AS (SELECT * FROM u WHERE regexp_matches(text, 'WARNING|CAUTION|DANGER')),
      o AS (SELECT * FROM u WHERE kind IN ('procedure', 'table') OR regexp_matches(text, '(?i)\\b(adjust|remove|install|disconnect|tighten|loosen|lubricate)\\b')),
      e AS (SELECT DISTINCT o.unit_id AS src, w.unit_id AS dst FROM o JOIN w ON o.manual_id = w.manual_id AND (w.page <= 4 OR w.page = o.page) WHERE o.unit_id <> w.unit_id) SELECT src, count(*) AS warnings, min(dst) AS first FROM e GROUP BY src""",
    "page_reference_edges": f"WITH {_REFS} SELECT src, unit_id AS dst, label FROM pr JOIN u ON u.manual_id = pr.manual_id AND CAST(u.page AS VARCHAR) = label WHERE src <> unit_id",
    "unresolved_page_refs": f"WITH {_REFS} SELECT src, label FROM pr WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.manual_id = pr.manual_id AND CAST(u.page AS VARCHAR) = label)",
    "applicability_edges": f"WITH {_EXC} SELECT a.unit_id AS src, count(*) AS exceptions, max(b.unit_id) AS last FROM x a JOIN x b USING (manual_id, section_key) WHERE NOT a.exception AND b.exception GROUP BY a.unit_id",
    "applicability_status": f"""WITH {_EXC}, y AS (SELECT unit_id, exception, CASE WHEN unit_id % 4 = 3 THEN concat('-4', CAST(unit_id % 10 AS VARCHAR), '?') ELSE '' END AS patterns FROM x)
      SELECT unit_id, patterns, CASE WHEN patterns <> '' AND exception AND regexp_full_match('-47A', replace(patterns, '?', '[A-Z0-9]')) THEN 'excluded' WHEN patterns <> '' AND NOT exception THEN 'outside' ELSE 'not_established' END AS status FROM y""",
    "pitch_condition": f"""WITH {_U}, v AS (SELECT unit_id, CAST(unit_id % 7 AS DECIMAL(18,6)) + 0.5 AS q, CAST(regexp_extract(text, 'Pitch (\\d+)', 1) AS DECIMAL(18,6)) AS b, text FROM u WHERE unit_id % 4 = 2)
      SELECT unit_id, CASE WHEN text LIKE '%or less%' THEN q <= b ELSE q >= b END AS meets FROM v""",
    "searchable_units": f"WITH {_U} SELECT unit_id, kind FROM u WHERE blocked = 0 AND NOT (kind = 'table' AND extraction_method = 'vlm')",
    "release_manifest": f"""WITH {_U}, ne AS (WITH {_NOTE} SELECT * FROM ne), re AS (WITH {_TIER} SELECT * FROM re), cn AS (SELECT src, count(*) AS n FROM ne GROUP BY src), cr AS (SELECT src, count(*) AS n FROM re GROUP BY src)
      SELECT manual_id, count(*) AS units, CAST(sum(blocked) AS BIGINT) AS blocked, count(*) FILTER (kind = 'table') AS tables, CAST(coalesce(sum(cn.n), 0) AS BIGINT) AS note_edges, CAST(coalesce(sum(cr.n), 0) AS BIGINT) AS prerequisite_edges
      FROM u LEFT JOIN cn ON cn.src = unit_id LEFT JOIN cr ON cr.src = unit_id GROUP BY manual_id""",
    "section_carry_forward": f"WITH {_U} SELECT unit_id, last_value(CASE WHEN unit_id % 6 = 0 THEN section_key END IGNORE NULLS) OVER (PARTITION BY manual_id, page ORDER BY unit_id ROWS UNBOUNDED PRECEDING) AS section FROM u",
    "overlap_blocks": f"""WITH b AS ({BOXES}), s AS (SELECT b.box_id, greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS c
      FROM b JOIN b t ON t.kind = 'table' AND b.kind = 'block' AND t.page = b.page AND t.manual_no = b.manual_no) SELECT box_id, round(max(c), 9) AS covered FROM s GROUP BY box_id HAVING max(c) > 0.5""",
    "page_bounds": f"WITH b AS ({BOXES}) SELECT manual_no, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY ALL",
    "evidence_closure": f"{_CLOSURE} SELECT DISTINCT query_id, node FROM c",
    "conditional_closure": f"{_CLOSURE} SELECT query_id, node, required_value FROM c",
    "closure_budget_guard": f"{_CLOSURE}, {_U}, k AS (SELECT DISTINCT query_id, node FROM c) SELECT query_id, count(*) AS nodes, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, coalesce(sum(length(text)), 0) > 400 AS too_large FROM k LEFT JOIN u ON unit_id = node GROUP BY query_id",
    "blocked_closures": f"{_CLOSURE}, {_U}, k AS (SELECT DISTINCT query_id, node FROM c) SELECT query_id, count(*) AS blocked, min(node) AS first FROM k JOIN u ON unit_id = node AND blocked = 1 GROUP BY query_id",
    "note_footnotes": f"WITH {_NOTE}, ds AS (SELECT DISTINCT src, dst FROM ne) SELECT src, string_agg(text, chr(10) ORDER BY dst) AS footnotes, count(*) AS notes FROM ds JOIN u ON unit_id = dst GROUP BY src",
    "blocking_issues": f"""WITH n1 AS (WITH {_NOTE} SELECT DISTINCT unit_id, 'note ' || number AS issue FROM r WHERE (unit_id, number) NOT IN (SELECT (src, number) FROM ne)), n2 AS (WITH {_TIER} SELECT DISTINCT unit_id, 'setting ' || setting_id AS issue FROM q WHERE (unit_id, setting_id) NOT IN (SELECT (src, setting_id) FROM re))
      SELECT * FROM n1 UNION SELECT * FROM n2""",
    "setting_conflicts": f"WITH {_U}, {_REQ} SELECT manual_id, setting_id, string_agg(DISTINCT value, ',' ORDER BY value) AS required, count(DISTINCT value) AS n, count(DISTINCT value) > 1 AS conflict FROM q GROUP BY ALL",
    "hypothesis_assessment": f"WITH {_U}, {_REQ} SELECT unit_id, CASE WHEN value <> CAST(CAST(setting_id[10:] AS INTEGER) % 3 AS VARCHAR) THEN 'ruled_out' ELSE 'possible' END AS assessment FROM q",
    "claim_violations": f"""WITH {_NOTE}, {_REQ}, dc AS (SELECT DISTINCT manual_id, concat('function:', regexp_extract(text, '^No.: (\\d+);', 1)) AS setting_id FROM u WHERE kind = 'table')
      SELECT unit_id, 'undeclared_setting' AS code FROM q WHERE (manual_id, setting_id) NOT IN (SELECT (manual_id, setting_id) FROM dc)
      UNION SELECT unit_id, 'citation_missing' FROM r WHERE (unit_id, number) NOT IN (SELECT (src, number) FROM ne)""",
}

# the given units under the same SQL, where it doesn't lean on the arithmetic of the view
_GREFS = GIVEN_SQL + ", pr AS (SELECT DISTINCT unit_id AS src, manual_id, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b(?:refer to|see|on) page\\s+(\\d+)', 1))) AS label FROM u)"
_GWORKS = GIVEN_SQL + """, w AS (SELECT DISTINCT unit_id, manual_id, page FROM u WHERE regexp_matches(text, 'WARNING|CAUTION|DANGER')),
      o AS (SELECT DISTINCT unit_id, manual_id, page FROM u WHERE kind IN ('procedure', 'table') OR regexp_matches(text, '(?i)\\b(adjust|remove|install|disconnect|tighten|loosen|lubricate)\\b'))"""
ORACLE |= {
    "given_page_reference_edges": f"WITH {_GREFS} SELECT src, unit_id AS dst, label FROM pr JOIN u ON u.manual_id = pr.manual_id AND CAST(u.page AS VARCHAR) = label WHERE src <> unit_id",
    "given_unresolved_page_refs": f"WITH {_GREFS} SELECT src, label FROM pr WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.manual_id = pr.manual_id AND CAST(u.page AS VARCHAR) = label)",
    "given_warning_edges": f"WITH {_GWORKS}, e AS (SELECT o.unit_id AS src, w.unit_id AS dst FROM o JOIN w ON o.manual_id = w.manual_id AND (w.page <= 4 OR w.page = o.page) WHERE o.unit_id <> w.unit_id) SELECT src, count(*) AS warnings, min(dst) AS first FROM e GROUP BY src",
    "given_release_manifest": f"WITH {GIVEN_SQL} SELECT manual_id, count(*) AS units, CAST(0 AS BIGINT) AS blocked, count(*) FILTER (kind = 'table') AS tables, CAST(0 AS BIGINT) AS note_edges, CAST(0 AS BIGINT) AS prerequisite_edges FROM u GROUP BY manual_id",
    "given_applicability_status": f"""WITH {GIVEN_SQL}, m AS (SELECT unit_id, upper(regexp_replace(text, '\\[\\s*\\]|[□▯]', '?', 'g')) AS t, regexp_matches(text, '(?i)not\\s+(necessary|required|applicable|available)|does\\s+not\\s+apply') AND regexp_matches(text, '(?i)sub[- ]?class') AS exception FROM u),
      p AS (SELECT unit_id, exception, list_distinct(list_concat(regexp_extract_all(t, 'SUB[- ]?CLASS\\s+(-[0-9A-Z?]{{2,5}})(?:[^0-9A-Z]|$)', 1), list_transform(flatten(list_transform(regexp_extract_all(t, '\\((-[0-9A-Z? /]+)\\)', 1), lambda g: regexp_extract_all(g, '(?:-|/\\s*)([0-9][0-9A-Z?]{{1,4}})', 1))), lambda x: '-' || x))) AS a FROM m)
      SELECT unit_id, array_to_string(a, ',') AS patterns, CASE WHEN exception AND list_contains(a, '-47A') THEN 'excluded' WHEN len(a) > 0 AND NOT exception THEN CASE WHEN list_contains(a, '-47A') THEN 'within' ELSE 'outside' END ELSE 'not_established' END AS status FROM p""",
    "given_evidence_closure": f"""WITH RECURSIVE {_GREFS}, w AS (SELECT DISTINCT unit_id, manual_id, page FROM u WHERE regexp_matches(text, 'WARNING|CAUTION|DANGER')),
      o AS (SELECT DISTINCT unit_id, manual_id, page FROM u WHERE kind IN ('procedure', 'table') OR regexp_matches(text, '(?i)\\b(adjust|remove|install|disconnect|tighten|loosen|lubricate)\\b')),
      x AS (SELECT unit_id, manual_id, section_key, regexp_matches(text, '(?i)not\\s+(necessary|required|applicable|available)|does\\s+not\\s+apply') AND regexp_matches(text, '(?i)sub[- ]?class') AS exception FROM u),
      e AS (SELECT o.unit_id AS src, w.unit_id AS dst FROM o JOIN w ON o.manual_id = w.manual_id AND (w.page <= 4 OR w.page = o.page) UNION SELECT a.unit_id, b.unit_id FROM x a JOIN x b USING (manual_id, section_key) WHERE NOT a.exception AND b.exception),
      s AS (SELECT unit_id AS query_id, unit_id AS node FROM u UNION SELECT src, unit_id FROM pr JOIN u ON u.manual_id = pr.manual_id AND CAST(u.page AS VARCHAR) = label),
      c AS (SELECT query_id, node FROM s UNION SELECT c.query_id, e.dst FROM c JOIN e ON e.src = c.node) SELECT DISTINCT query_id, node FROM c""",
}
