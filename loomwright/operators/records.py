"""Records of questions, answers, trials and feedback: latest states, exports, roll-ups, deletions, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import latest

SOURCES = "array<struct<id:string, manual_id:string, page:int>>"
TIMINGS = "struct<translation_seconds:double, retrieval_seconds:double, answer_seconds:double, total_seconds:double>"


def sources(json: Column) -> Column:
    """Cited sources; null for null or broken JSON."""
    return F.from_json(json, SOURCES)


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula: an apostrophe before =, +, - or @ as the first visible character."""
    return F.when(F.ltrim(cell).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def upserted(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    return latest(rows, [key], at)


def query_sources(queries: DataFrame) -> DataFrame:
    """One row for each cited source of a query, one with nulls where there is none."""
    q = queries.select("id", "status", F.explode_outer(sources(F.col("sources_json"))).alias("s")).distinct()
    return q.select(F.col("id").alias("query_id"), "status", F.col("s.id").alias("chunk_id"), F.col("s.manual_id").alias("manual_id"), F.col("s.page").alias("page"))


def cited_pages(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, manual_id, page, first_rank, n_chunks, text): cited chunks rolled up to pages, texts in the order cited, each once.

    Citations of a query are few by their nature; the text of a page is put together after the join with the chunks.
    """
    q = queries.select(F.col("id").alias("query_id"), F.posexplode(sources(F.col("sources_json"))).alias("rank", "s")).distinct()
    q = q.select("query_id", "rank", F.col("s.id").alias("chunk_id"), F.col("s.manual_id").alias("manual_id"), F.col("s.page").alias("page"))
    c = chunks.groupBy(F.col("id").alias("chunk_id")).agg(F.min("text").alias("text"))
    parts = q.join(c, "chunk_id", "left").groupBy("query_id", "manual_id", "page").agg(F.min("rank").alias("first_rank"), F.countDistinct("chunk_id").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    return parts.select("query_id", "manual_id", "page", "first_rank", "n_chunks", F.array_join(F.array_distinct(F.filter(F.col("p.text"), lambda t: t.isNotNull())), "\n\n").alias("text"))


def without_manuals(queries: DataFrame, gone: DataFrame) -> DataFrame:
    """Queries that cite none of the manuals ``gone`` (manual_id), as a source's manual or in its id; queries without sources stay."""
    cited = queries.select("id", F.explode(sources(F.col("sources_json"))).alias("s"))
    cited = cited.select("id", F.explode(F.array_distinct(F.array(F.col("s.manual_id"), F.substring_index("s.id", ":", 1)))).alias("manual_id")).where("manual_id is not null").distinct()
    return queries.join(cited.join(gone.select("manual_id").distinct(), "manual_id", "left_semi").select("id").distinct(), "id", "left_anti")


def trial_summary(trials: DataFrame, queries: DataFrame) -> DataFrame:
    """Each trial with the number of its queries, none included; queries are counted before the join, so a trial with a third of
    all queries is combined within tasks."""
    n = queries.where("trial_id is not null").select("id", "trial_id").distinct().groupBy("trial_id").agg(F.count("*").alias("questions"))
    t = trials.join(n, trials.id == n.trial_id, "left")
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6)
    return t.select("id", "trial_condition", "scenario", "status", F.coalesce("questions", F.lit(0)).alias("questions"), F.round(elapsed, 3).alias("elapsed"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): a digest of all rows that doesn't depend on their order, by sums of four parts of each row's SHA-256.

    Sums combine within tasks, so no task or driver sees the corpus; equal rows count as often as they stand there.
    """
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), F.concat_ws("-", *[F.coalesce(part(k), F.lit("0")) for k in range(4)]).alias("digest"))


def equal_pages(chunks: DataFrame) -> DataFrame:
    """(fingerprint, n_pages, first_page): pages of whatever manual that hold the same texts in the same order."""
    page = chunks.where("text is not null").select("manual_id", "page", "ordinal", F.sha2("text", 256).alias("h")).distinct()
    page = page.groupBy("manual_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), ",").alias("hs"))
    return page.groupBy(F.sha2("hs", 256).alias("fingerprint")).agg(F.count("*").alias("n_pages"), F.min(F.concat_ws(":", "manual_id", "page")).alias("first_page"))


def search_text(drafts: DataFrame) -> DataFrame:
    """(draft_id, search_text): a unit's title, text and labelled parts, each line once."""
    labelled = lambda label, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(label + ": "), x))
    one = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(label + ": "), c))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array("title", "text"), one("Condition", F.col("condition_text")), one("Cause", F.col("cause")), labelled("Check", F.col("checks")), labelled("Action", F.col("actions")), labelled("Warning", F.col("warnings")))
    return drafts.select("draft_id", F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), "\n").alias("search_text"))


def safety_notes(drafts: DataFrame, manuals: DataFrame) -> DataFrame:
    """(warning, n_refs, title, page): warnings of the same words, the number of pages they stand on and the first of these."""
    w = drafts.select("manual_id", "page", F.explode("warnings").alias("w")).where("w is not null")
    words = F.btrim(F.regexp_replace(F.regexp_replace("w", r"^\s*(DANGER|WARNING|CAUTION)\b:?\s*", ""), r"\s+", " "))
    w = w.select(words.alias("warning"), "manual_id", "page").where("warning <> ''").distinct()
    n = w.groupBy("warning").agg(F.count("*").alias("n_refs"), F.min(F.struct("manual_id", "page")).alias("first"))
    return n.join(manuals.select(F.col("id").alias("mid"), "title"), F.col("first.manual_id") == F.col("mid"), "left").select("warning", "n_refs", "title", F.col("first.page").alias("page"))
