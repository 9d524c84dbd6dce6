"""The given tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only those, so that the scan reads nothing else."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt out over all cores where its files make fewer partitions than that; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row of each ``key``, the greatest by ``order`` with nulls last; whole-row repeats collapse first.

    Aggregates with max_by, so rows combine before the shuffle. A null key is a key of its own.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])
