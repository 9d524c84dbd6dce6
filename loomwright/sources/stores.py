"""Writers: versioned releases behind a pointer, replacement by key, guarded CSV."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import digest, guarded


def replace_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Write ``rows`` so that only the partitions of the keys they hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def guarded_csv(rows: DataFrame, path: str) -> None:
    """CSV for spreadsheets: a byte order mark and a header at its beginning, and no cell that is taken for a formula.

    The parts in the order of their names are one file: the first holds the header alone, empty ones nothing.
    """
    text = {c for c, kind in rows.dtypes if kind == "string"}
    rows = rows.select(*[guarded(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns])
    options = {"escape": '"'}
    header = rows.sparkSession.range(0, 1, 1, 1).select(F.concat(F.lit("\ufeff"), F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]), options)).alias("value"))
    header.union(rows.select(F.to_csv(F.struct(*rows.columns), options).alias("value"))).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/pointers")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def current_release(spark: SparkSession, root: str) -> dict | None:
    """What the last pointer says, or None."""
    numbers = _pointers(spark, root)
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/pointers/{numbers[-1]:08d}").collect())) if numbers else None


def _point(spark: SparkSession, root: str, now: dict) -> None:
    """Add the next pointer: written aside and renamed to a name that isn't there yet, so readers see the old one or the new one.
    Of two writers the second finds the name taken, and fails."""
    aside, number = f"{root}/aside-{uuid.uuid4().hex}", (_pointers(spark, root) or [0])[-1] + 1
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(now)).alias("value")).write.text(aside)
    fs, folder = _fs(spark, f"{root}/pointers")
    fs.mkdirs(folder)
    _, name = _fs(spark, f"{root}/pointers/{number:08d}")
    if fs.exists(name) or not fs.rename(_fs(spark, aside)[1], name):
        raise RuntimeError("another release was published meanwhile")


def publish(rows: DataFrame, root: str, *key: str) -> dict:
    """Write ``rows`` as a release named by their digest, check what was written, then point to it.

    The same rows in any order are the same release and nothing is written again. A failure before the pointer is renamed leaves
    the old release in force; earlier pointers stay and name the releases before it.
    """
    spark = rows.sparkSession
    stated = digest(rows, *(key or rows.columns)).first()
    name = "r-" + "".join(stated.digest.split("-"))[:24]
    now = current_release(spark, root)
    if now and now["release"] == name and now["rows"] == stated.n:
        return now
    path = f"{root}/releases/{name}"
    rows.write.mode("overwrite").parquet(path)
    written = digest(spark.read.parquet(path), *(key or rows.columns)).first()
    if (written.n, written.digest) != (stated.n, stated.digest):
        raise ValueError("the rows changed while they were written")
    now = {"release": name, "rows": stated.n, "path": path}
    _point(spark, root, now)
    return now


def rolled_back(spark: SparkSession, root: str, release: str) -> dict:
    """Point to an earlier release again, once its rows are found as they were published."""
    named = {r["release"]: r for n in _pointers(spark, root) for r in [json.loads("\n".join(x.value for x in spark.read.text(f"{root}/pointers/{n:08d}").collect()))]}
    if release not in named:
        raise ValueError("no such release was ever published")
    if spark.read.parquet(named[release]["path"]).count() != named[release]["rows"]:
        raise ValueError("the release's rows are no longer there")
    _point(spark, root, named[release])
    return named[release]
