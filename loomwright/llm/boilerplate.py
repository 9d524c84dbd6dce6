"""Lines repeated across one source's documents: find them, and give every document back without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: A line is excessive in at least so many distinct documents of its source, and in at least this share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.10


def letters(line: Column) -> Column:
    """The letters of a line in lower case, with the vowel signs that belong to them."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")


def lines(documents: DataFrame, doc_id: str, source: str, text: str, published: str | None = None) -> DataFrame:
    """(source, doc_id, cluster, day, line_no, key): one row for each line that has letters.

    ``cluster`` is the hash of the whole text's letters alone: copies of a document that came out
    again count once. ``day`` is the date of publication, null where none is given. ``key`` is 96 bits of the line's letters. Null texts have no lines.
    """
    doc = documents.select(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        (F.col(published).cast("date") if published else F.lit(None).cast("date")).alias("day"),
    ).where("text is not null")
    whole = letters(F.col("text"))
    doc = doc.withColumn("cluster", F.xxhash64(whole))
    line = doc.select("source", "doc_id", "cluster", "day", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.withColumn("letters", letters(F.col("line"))).where("letters <> ''")
    return line.select("source", "doc_id", "cluster", "day", (F.col("pos") + 1).cast("int").alias("line_no"),
                       F.struct(F.xxhash64("letters").alias("a"), F.hash("letters").alias("b")).alias("key"))


def excessive(line: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, key): lines in enough distinct documents of their source, which came out on several days where days are
    known; a document that came out again has its first day. ``documents`` has (source, cluster).

    Distinct documents are counted in two steps, first (source, key, document), then (source, key): a line that stands in a
    third of all rows is spread over all tasks in the first and combined before the shuffle in the second.
    """
    per_line = line.groupBy("source", "key", "cluster").agg(F.min("day").alias("day")).groupBy("source", "key").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    total = documents.groupBy("source", "cluster").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("total"))
    several = F.col("first").isNull() | (F.col("first") < F.col("last"))
    return per_line.where((F.col("n") >= LEAST_DOCUMENTS) & several).join(total, "source").where(F.col("n") >= LEAST_SHARE * F.col("total")).select("source", "key")


def repeated_lines(documents: DataFrame, doc_id: str = "id", source: str = "manual_id", text: str = "text", published: str | None = None) -> DataFrame:
    """(doc_id, line_no) of each line repeated excessively in its source, distinct rows.

    Lines are split at line feeds and numbered from 1, blank ones included; two are the same if their letters agree. Lines
    without letters, null and empty texts give no rows; documents with a null source form no source and give none; repeated
    rows and texts under several ids count once; an empty table gives an empty result; other columns are not read.
    """
    # split and hashed once, as lines are counted, documents are, and lines are looked up
    line = materialise(lines(documents.where(F.col(source).isNotNull()), doc_id, source, text, published), "lines")
    found = excessive(line, line.select("source", "cluster"))
    return line.join(found, ["source", "key"]).select("doc_id", "line_no").distinct()


def without_repeated_lines(documents: DataFrame, doc_id: str = "id", source: str = "manual_id", text: str = "text", published: str | None = None) -> DataFrame:
    """(doc_id, text, removed): every document once, without the lines of repeated_lines(); ``removed`` counts them.

    A null text stays null; blank lines that remain are kept. Of rows with one id the first text by order counts.
    """
    gone = repeated_lines(documents, doc_id, source, text, published).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    doc = documents.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(text).alias("text")).join(gone, "doc_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("int")))
    return doc.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                      F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
