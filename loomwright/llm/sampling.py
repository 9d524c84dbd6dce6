"""Bounded samples for fitting, chosen by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, n: int, groups: list[str], text: list[str]) -> DataFrame:
    """(groups…, text…): the ``n`` distinct rows of each group whose hash of ``text`` is smallest; ``groups`` have few values.

    Copies count once: the groups' distinct hashes are counted first, so that about twice ``n`` distinct rows of each pass a bound
    on the hash, and copies of these combine within tasks before anything is shuffled and ranked. What one task gathers doesn't
    grow with the table, its copies or its number of tasks.
    """
    rows = rows.select(*groups, *text, F.xxhash64(*text).alias("_h"))
    counts = rows.groupBy(*groups).agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()

    def bound(r) -> int:
        return (1 << 63) - 1 if r["n"] <= 4 * n else int(-(1 << 63) + (1 << 64) * min(1.0, 2 * n / r["n"]))

    same = lambda r: reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.lit(r[g])) for g in groups])
    limit = reduce(lambda c, r: F.when(same(r), F.lit(bound(r))).otherwise(c), counts, F.lit((1 << 63) - 1))
    once = rows.where(F.col("_h") <= limit).distinct()
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("_h", *text))
    return once.withColumn("_n", place).where(F.col("_n") <= n).drop("_h", "_n")
