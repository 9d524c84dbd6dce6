"""Readers: delivered files, JSON documents, snapshots of other stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 * 1024 * 1024


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, text, rejected) of each file below ``path``, HTML or plain text.

    Files over the size limit and ones that are not UTF-8 text are rejected with a reason and have no text; Spark leaves empty
    files out. Tags,
    scripts and entities of HTML are resolved by built-in functions, so contents stay in the JVM.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = F.when(F.col("length") <= MOST_BYTES, F.try_validate_utf8(F.expr("cast(content as string)")))
    rejected = F.when(F.col("length") > MOST_BYTES, "too large").when(F.col("raw").isNull() | F.contains("raw", F.lit("\0")), "not text")
    t = F.regexp_replace("raw", r"(?is)<(script|style|nav)\b.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h\d|/tr)\b[^>]*>", "\n"), r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[\n ]*", "\n"), r"^\s+|\s+$", "")
    f = f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "length", raw.alias("raw")).withColumn("rejected", rejected)
    return f.select("path", "sha256", "bytes", F.when(F.col("rejected").isNull(), text).alias("text"), "rejected")


def new_only(files: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows whose key no known row has, each key once (the smallest path)."""
    rest = [c for c in files.columns if c != key]
    first = files.groupBy(key).agg(F.min_by(F.struct(*rest), "path").alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])
    return first.join(known.select(key).distinct(), key, "left_anti")


def json_documents(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON files, one document each or one a line; broken ones have their text in _corrupt."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
