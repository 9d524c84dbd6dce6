"""Containers of fixed capacity filled with items of varying length: vector best-fit under three capacities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Containers that one group of items fills at most; a group is packed by one task, so this bounds its memory and work.
GROUP_CONTAINERS = 512
#: A container of the first round with more than this share of unused tokens is opened again in the second.
REOPEN_SHARE = 0.004
#: Weights of the three residuals: tokens, number of documents, attention cost.
WEIGHTS = (1.0, 0.02, 0.05)


def best_fit(tokens: np.ndarray, capacity: int, most_documents: int, most_attention: int) -> np.ndarray:
    """The container of each item, items taken from the largest to the smallest.

    Among the open containers that can take an item under every capacity, it goes where its demand points along what is left
    (the largest weighted dot product of demand and residual, per length of the residual), a perfect fit before all. Items of
    one size have the same demand, so the containers are ranked once for each size and filled in that order.
    """
    order = np.argsort(-tokens, kind="stable")
    weight = np.array(WEIGHTS)
    scale = np.array([capacity, most_documents, most_attention], dtype=float)
    left = np.empty((1024, 3))
    used = 0
    out = np.empty(len(tokens), dtype=np.int64)
    start = 0
    while start < len(order):
        size = int(tokens[order[start]])
        stop = start
        while stop < len(order) and tokens[order[stop]] == size:
            stop += 1
        need = np.array([size, 1, size * size], dtype=float)
        i = start
        while i < stop:
            fit = np.flatnonzero((left[:used] >= need).all(axis=1))
            if len(fit):
                rest = (left[fit] - need) / scale
                dot = (left[fit] / scale * weight * (need / scale)).sum(axis=1)
                norm = np.sqrt((rest * rest * weight).sum(axis=1))
                # the residual norm decides; the dot product breaks near ties in favour of what points the same way
                ranked = fit[np.lexsort((-dot, np.round(norm, 6)))]
                for bin_ in ranked[: stop - i]:
                    out[order[i]] = bin_
                    left[bin_] -= need
                    i += 1
            else:
                if used == len(left):
                    left = np.concatenate([left, np.empty_like(left)])
                left[used] = scale - need
                out[order[i]] = used
                used += 1
                i += 1
        start = stop
    return out


def _pack(items: DataFrame, groups, capacity: int, most_documents: int, most_attention: int, first: int, count: int) -> DataFrame:
    """(…, container): ``items`` packed within each group; a container's name holds the round, the group and its place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "row"], ascending=[False, True], kind="stable")
        place = best_fit(pdf["tokens"].to_numpy(), capacity, most_documents, most_attention)
        names = {p: f"{first}-{pdf['bucket'].iloc[0]}-{p}" for p in np.unique(place)}
        return pdf.drop(columns="bucket").assign(container=[names[p] for p in place])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields) + ", container string"
    # an explicit number of partitions, as adaptive execution would put these small rows of much work into one task
    tasks = max(1, min(count, 4 * items.sparkSession.sparkContext.defaultParallelism))
    return items.withColumn("bucket", groups).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(run, schema)


def containers(counts: DataFrame, capacity: int = 2048, most_documents: int | None = None, most_attention: int | None = None, group_containers: int = GROUP_CONTAINERS) -> DataFrame:
    """(doc_id, piece, start, tokens, container) from (doc_id, tokens), each token of each item in exactly one container.

    An item within the capacity is one piece; a larger one is cut into full containers and a rest. Items without tokens (empty
    and null texts) have no row. ``most_documents`` and ``most_attention`` (the sum of squared lengths) bound a container too;
    by default neither binds before the tokens do. Repeated doc_id are packed as items of their own.

    Items are spread by hash over groups of bounded size, each packed by itself; what is left open at the end of that is spread
    and packed again, so the unused space is that of a few containers in each group. The groups grow in number, not in size.
    """
    most_documents, most_attention = most_documents or capacity, most_attention or capacity * capacity
    sized = counts.where("tokens > 0").select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    full = F.expr(f"sequence(0L, CAST(floor((tokens - 1) / {capacity}) AS LONG))")
    items = sized.select("doc_id", "tokens", F.explode(full).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))
    # the encoding runs once, as the number of groups needs its sums; rows are numbered as they are written, so that rows of one doc_id
    # or none are spread like any others
    items = materialise(items.withColumn("row", F.monotonically_increasing_id()), "packing-items")
    whole = F.col("tokens") == capacity
    total, n = items.where(~whole).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // (group_containers * capacity)), -(-n // (group_containers * 256)))
    spread = lambda salt, k: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(k))
    once = materialise(_pack(items.where(~whole), spread(1, groups), capacity, most_documents, most_attention, 0, groups), "packing-round")
    result = once
    if groups > 1:
        fill = once.groupBy("container").agg(F.sum("tokens").alias("fill"))
        open_ = fill.where(F.col("fill") < capacity * (1 - REOPEN_SHARE)).select("container")
        again = once.join(open_, "container", "left_semi").drop("container")
        left = max(1, -(-groups // 64))
        result = once.join(open_, "container", "left_anti").select(*once.columns).unionByName(_pack(again, spread(2, left), capacity, most_documents, most_attention, 1, left))
    alone = items.where(whole).withColumn("container", F.concat(F.lit("full-"), F.col("row").cast("string")))
    return result.unionByName(alone).drop("row")
