"""Evidence closure over typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rounds after which a closure that still grows is an error, as a graph has no longer paths than nodes.
MOST_ROUNDS = 10_000
#: The visited sets of so many rounds are merged into one table, so that plans stay short.
MERGE_EVERY = 8


def evidence_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, node, required_value): all that the seeds need, directly or through others, for many queries at once.

    ``edges`` has (src, dst, required_value, when_value), ``seeds`` (query_id, node, required_value). An edge that holds for one
    value is not followed from a node required with another. A state is (node, required value), visited once for each query.
    Each round joins the new states with the edges and drops visited ones; rounds are written to the shared folder, so the plan
    doesn't grow and a lost executor costs no more than a round. Cycles end as nothing new comes; null nodes are dropped.
    """
    state = ["query_id", "node", "required_value"]
    none = "\u0000"  # joins on null values need one that compares
    e = edges.select(F.col("src").alias("node"), "dst", F.col("required_value").alias("next_value"), "when_value")
    frontier = materialise(seeds.where("node is not null").select("query_id", "node", F.coalesce("required_value", F.lit(none)).alias("required_value")).distinct(), "closure")
    parts = [frontier]
    for _ in range(MOST_ROUNDS):
        follows = F.col("when_value").isNull() | (F.col("required_value") == none) | (F.col("when_value") == F.col("required_value"))
        new = frontier.join(e, "node").where(follows).select("query_id", F.col("dst").alias("node"), F.coalesce("next_value", F.lit(none)).alias("required_value")).where("node is not null").distinct()
        visited = parts[0]
        for p in parts[1:]:
            visited = visited.unionByName(p)
        frontier = materialise(new.join(visited, state, "left_anti"), "closure")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > MERGE_EVERY:
            parts = [materialise(visited.unionByName(frontier), "closure")]
    else:
        raise ValueError("the closure doesn't end")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("required_value", F.nullif("required_value", F.lit(none)))


def closure_sizes(closure: DataFrame, texts: DataFrame, limit: int = 30_000) -> DataFrame:
    """(query_id, nodes, chars, too_large): each query's evidence and whether its texts exceed the limit. ``texts``: (node, text)."""
    nodes = closure.select("query_id", "node").distinct().join(texts, "node", "left")
    return nodes.groupBy("query_id").agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("too_large", F.col("chars") > limit)
