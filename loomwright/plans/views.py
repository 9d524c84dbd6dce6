"""Views in SQL that both engines read: manuals' grammar spelt from the given tables, so that linking has text to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as Y
from ..tables import table

UNITS = """SELECT o_orderkey AS unit_id, concat('src', CAST(o_custkey % 20 AS STRING)) AS manual_id, CAST(o_orderkey % 40 + 1 AS INT) AS page,
  CAST(o_orderkey % 7 + 1 AS STRING) AS section_key,
  CASE WHEN o_orderkey % 4 = 3 THEN 'procedure' WHEN o_orderkey % 4 = 1 THEN 'table' ELSE 'information' END AS kind,
  CASE WHEN o_orderkey % 11 = 0 THEN 'vlm' ELSE 'text' END AS extraction_method, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS blocked,
  CASE o_orderkey % 4
    WHEN 0 THEN concat('(NOTE ', CAST(o_orderkey % 97 AS STRING), ') ', CASE WHEN o_orderkey % 7 = 3 THEN 'Operation is disabled' ELSE 'Only enabled' END, ' when Function No. ', CAST((o_orderkey + 1) % 60 AS STRING), ' is set to "', CAST(o_orderkey % 3 AS STRING), CASE WHEN o_orderkey % 7 = 5 THEN '" or "5".' ELSE '".' END)
    WHEN 1 THEN concat('No.: ', CAST(o_orderkey % 60 AS STRING), '; Setting range: 0-10; See NOTE ', CAST(o_orderkey % 97 AS STRING), ', ', CAST((o_orderkey + 5) % 97 AS STRING))
    WHEN 2 THEN concat('Pitch ', CAST(o_orderkey % 6 AS STRING), CASE WHEN o_orderkey % 8 = 2 THEN ' or less' ELSE ' or more' END, ': speed ', CAST(o_orderkey % 5000 AS STRING))
    ELSE concat('WARNING: Disconnect power. Sub-class -4', CAST(o_orderkey % 10 AS STRING), '[] adjustment is not required, see page ', CAST(o_orderkey % 43 + 1 AS STRING)) END AS text
  FROM orders"""

EDGES = """SELECT o_orderkey AS src, (o_orderkey * 7 + 3) % 997 AS dst, 'prerequisite' AS relation, CAST(o_orderkey % 3 AS STRING) AS required_value, CAST(NULL AS STRING) AS when_value FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey AS src, (o_orderkey * 5 + 11) % 499 AS dst, 'note' AS relation, CAST(NULL AS STRING) AS required_value, CAST(o_orderkey % 3 AS STRING) AS when_value FROM orders WHERE o_orderkey % 3 = 0"""

BOXES = """SELECT o_orderkey AS box_id, CAST(o_orderkey % 40 AS INT) AS page, CASE WHEN o_custkey % 10 = 0 THEN 'table' ELSE 'block' END AS kind,
  CAST(o_orderkey % 300 AS DOUBLE) AS x0, CAST(o_custkey % 500 AS DOUBLE) AS y0, CAST(o_orderkey % 300 + 20 + o_custkey % 200 AS DOUBLE) AS x1, CAST(o_custkey % 500 + 10 + o_orderkey % 90 AS DOUBLE) AS y1, o_custkey % 25 AS manual_no FROM orders"""


#: The given units in DuckDB's SQL, as given_units() makes them.
GIVEN = """gd AS (SELECT DISTINCT * FROM unit_drafts),
  gr AS (SELECT draft_id, manual_id, page, section_key, table_headers AS h, unnest(table_rows) AS cells, CAST(generate_subscripts(table_rows, 1) - 1 AS INTEGER) AS row_no FROM gd WHERE len(table_rows) > 0),
  gc AS (SELECT DISTINCT id, manual_id, page, extraction, text FROM chunks WHERE text IS NOT NULL),
  gp AS (SELECT id, manual_id, page, extraction, list_filter(string_split(regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(31), 'g'), '(?im)^(\\s*\\(NOTE\\s+\\d+\\))', chr(31) || '\\1', 'g'), chr(31)), lambda p: trim(p) <> '') AS parts FROM gc),
  gq AS (SELECT id, manual_id, page, extraction, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part FROM gp),
  u AS (SELECT DISTINCT draft_id AS unit_id, manual_id, page, coalesce(section_key, '') AS section_key, kind, 'text' AS extraction_method,
      array_to_string(list_filter(list_concat([text, condition_text, cause], checks, actions, warnings), lambda x: x IS NOT NULL), chr(10)) AS text FROM gd
    UNION SELECT concat_ws('#', draft_id, row_no), manual_id, page, coalesce(section_key, ''), 'table', 'text',
      array_to_string(list_transform(range(1, greatest(len(h), len(cells)) + 1), lambda i: coalesce(h[i], '') || ': ' || coalesce(cells[i], '[merged/blank]')), '; ') FROM gr
    UNION SELECT concat_ws('#', id, part), manual_id, page, '', CASE WHEN regexp_matches(text, '(?:^|\\n)\\s*1[.)]\\s') THEN 'procedure' ELSE 'information' END, extraction, text FROM gq)"""


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """``sql`` over the table orders of ``folder``."""
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))


def given_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the given tables, with the columns of UNITS: drafts with all their wording, each row of their tables, and the paragraphs
    of chunks, where a note begins one of its own. A null section is the empty one, as in the reference. Repeated rows collapse at the
    end, so texts are shuffled once."""
    d = table(spark, folder, "unit_drafts")
    section = F.coalesce("section_key", F.lit("")).alias("section_key")
    words = F.concat_ws("\n", "text", "condition_text", "cause", "checks", "actions", "warnings")
    draft = d.select(F.col("draft_id").alias("unit_id"), "manual_id", "page", section, "kind", F.lit("text").alias("extraction_method"), words.alias("text"))
    rows = Y.table_rows(d, "section_key").select(F.concat_ws("#", "draft_id", "row").alias("unit_id"), "manual_id", "page", section, F.lit("table").alias("kind"), F.lit("text").alias("extraction_method"), "text")
    c = table(spark, folder, "chunks", "id", "manual_id", "page", "extraction", "text")
    marked = F.regexp_replace(F.regexp_replace("text", r"\n\s*\n", "\u001f"), r"(?imd)^(\s*\(NOTE\s+\d+\))", "\u001f$1")
    part = c.select("id", "manual_id", "page", "extraction", F.posexplode(F.filter(F.split(marked, "\u001f"), lambda p: F.trim(p) != "")).alias("part", "text"))
    kind = F.when(F.col("text").rlike(r"(?:^|\n)\s*1[.)]\s"), "procedure").otherwise("information")
    chunk = part.select(F.concat_ws("#", "id", "part").alias("unit_id"), "manual_id", "page", F.lit("").alias("section_key"), kind.alias("kind"), F.col("extraction").alias("extraction_method"), "text")
    return draft.unionByName(rows).unionByName(chunk).distinct().withColumn("blocked", F.lit(0))
