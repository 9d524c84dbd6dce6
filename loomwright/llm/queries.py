"""The pN_ queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import latest, spread, table
from . import boilerplate, encoding, language, lookalikes, ocr, packing, pairs, reading, splitting


def labelled_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_table, item_id, label, text): every item of lang_labels with its latest label, and every document; written once."""
    labels = latest(table(spark, folder, "lang_labels"), ["item_table", "item_id"], "set_at").withColumnRenamed("lang", "label")
    of = lambda name, text: labels.where(F.col("item_table") == name).join(table(spark, folder, name, F.col("id").alias("item_id"), F.col(text).alias("text")), "item_id")
    documents = table(spark, folder, "documents", F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_id"), F.col("lang").alias("label"), "text")
    columns = ["item_table", "item_id", "label", "text"]
    return materialise(of("queries", "question").select(*columns).unionByName(of("chunks", "text").select(*columns)).unionByName(documents), "labelled-items")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(labelled_items(spark, folder)).select("item_table", "item_id", "seg_no", "lang")


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    items = labelled_items(spark, folder)
    return language.segments(items, language.fitted(items), ["item_table", "item_id"]).drop("segs").distinct()


def _language_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(label, text): documents and questions with their latest label, of which the cross-parser of the pairs is fitted on a sample."""
    documents = table(spark, folder, "documents", F.col("lang").alias("label"), "text")
    labels = latest(table(spark, folder, "lang_labels").where("item_table = 'queries'"), ["item_table", "item_id"], "set_at").select(F.col("item_id").alias("id"), F.col("lang").alias("label"))
    return documents.unionByName(labels.join(table(spark, folder, "queries", "id", F.col("question").alias("text")), "id").select("label", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_margins(spark, folder).select("query_id", "defect").distinct()


def p2_margins(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(spread(table(spark, folder, "queries", "id", "question", "answer", "status")), _language_labels(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = spread(table(spark, folder, "chunks", "id", "manual_id", "text", "extraction")).where("extraction = 'text'")
    return boilerplate.repeated_lines(chunks).withColumnRenamed("doc_id", "chunk_id")


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    chunks = spread(table(spark, folder, "chunks", "id", "manual_id", "text", "extraction")).where("extraction = 'text'")
    return boilerplate.without_repeated_lines(chunks).withColumnRenamed("doc_id", "chunk_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.look_same(spread(table(spark, folder, "queries", "id", "question", "search_question")))


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.unified(spread(table(spark, folder, "queries", "id", "question", "search_question")), "id", "question", "search_question").select("id", "name", "form").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.noise(table(spark, folder, "chunks", "id", "text", "extraction")).select("chunk_id", "line_no", "noise", "word").distinct()


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.repaired(table(spark, folder, "chunks", "id", "text", "extraction"))


def _both(spark: SparkSession, folder: str, f) -> DataFrame:
    chunks, drafts = spread(table(spark, folder, "chunks", "id", "text")), spread(table(spark, folder, "unit_drafts", "draft_id", "text"))
    return f(chunks, "id", "text").withColumn("item_table", F.lit("chunks")).unionByName(f(drafts, "draft_id", "text").withColumn("item_table", F.lit("unit_drafts")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder, splitting.cut_kinds).select("item_table", "item_id", "cut")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder, splitting.pieces).select("item_table", "item_id", "ordinal", "text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(spread(table(spark, folder, "documents", "doc_id", "text")))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(encoding.token_counts(spread(table(spark, folder, "documents", "doc_id", "text"))))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_levels(spark, folder).select("doc_id", "reading_level").distinct()


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    languages = language.fitted(table(spark, folder, "documents", F.col("lang").alias("label"), "text"))
    return reading.reading_levels(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "level_samples"), languages)


QUERIES = {q.__name__: q for q in (p1_found, p1_segments, p2_found, p2_margins, p3_found, p3_cleaned, p4_found, p4_unified, p5_found, p5_repaired, p6_found, p6_pieces, p7_ids, p8_containers, p9_found, p9_levels)}

_P3_LINES = """
  c AS (SELECT DISTINCT id, manual_id, text, regexp_replace(lower(text), '[^\\p{L}\\p{M}]+', '', 'g') AS cluster FROM chunks
        WHERE extraction = 'text' AND text IS NOT NULL AND manual_id IS NOT NULL),
  l0 AS (SELECT id, manual_id, cluster, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM c),
  l AS (SELECT *, regexp_replace(lower(line), '[^\\p{L}\\p{M}]+', '', 'g') AS k FROM l0),
  n AS (SELECT manual_id, count(DISTINCT cluster) AS total FROM l WHERE k <> '' GROUP BY manual_id),
  f AS (SELECT l.manual_id, k, n.total FROM l JOIN n USING (manual_id) WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT cluster) >= 5 AND count(DISTINCT cluster) >= 0.1 * n.total)"""

ORACLE = {
    "p3_found": f"WITH {_P3_LINES} SELECT DISTINCT id AS chunk_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN f USING (manual_id, k)",
    "p3_cleaned": f"""WITH {_P3_LINES}, g AS (SELECT DISTINCT id, line_no, true AS gone FROM l JOIN f USING (manual_id, k))
      SELECT id AS chunk_id, CASE WHEN count(gone) = 0 THEN any_value(text) ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (gone IS NULL), '') END AS text, CAST(count(gone) AS INTEGER) AS removed
      FROM (SELECT DISTINCT id, c.text, line, line_no FROM c JOIN l USING (id, manual_id, cluster)) LEFT JOIN g USING (id, line_no) GROUP BY id
      UNION ALL SELECT DISTINCT id, CAST(NULL AS VARCHAR), 0 FROM chunks WHERE extraction = 'text' AND text IS NULL""",
    "p6_found": """WITH i AS (SELECT 'chunks' AS item_table, id AS item_id, text FROM chunks UNION SELECT 'unit_drafts', draft_id, text FROM unit_drafts),
      s AS (SELECT item_table, item_id, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM i),
      m AS (SELECT item_table, item_id, regexp_replace(t, '\\b(No|Nr|Fig|n|p|ca|bzw|approx)\\.', '\\1_', 'g') AS t FROM s WHERE length(t) > 1100)
      SELECT DISTINCT item_table, item_id, CASE WHEN list_max(list_transform(string_split(regexp_replace(t, '([.!?।]["'')\\]]*)\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) > 1100 THEN 'forced' ELSE 'natural' END AS cut FROM m""",
}
