"""Lexical and dense search of many queries at once, and the fusion of their rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOPWORDS, tokens
from ..session import materialise

K1, B, POOL, FUSION = 1.5, 0.75, 24, 60
#: Query vectors that are matched against all rows at once: a block of them goes to every task.
BLOCK = 2048
#: Terms of queries that are scored at once, and documents that a task scores them on at once.
TERMS, DOCS = 200_000, 32_768
#: Terms of documents that a task counts at once, and bytes of texts that it parts into words at once.
MOST, MOST_BYTES = 4_000_000, 16_000_000
_RUN = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


def _runs(documents: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """(doc_id, …, run, len): each document's terms with their counts, as an array, and the number of its terms. Parted and counted in
    Python on Arrow batches: Spark's functions of arrays take strings one call at a time."""
    t = documents.select(F.col(doc_id).alias("doc_id"), *keep, F.lower(text).alias("t"))
    kinds = T.StructType([*t.schema.fields[:-1], T.StructField("run", _RUN), T.StructField("len", T.IntegerType())])
    return t.mapInArrow(lambda batches: _counted(_worded(batches)), kinds)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end with a text in lower case to rows that end with an array of its terms, as tokens() makes them; stop words and
    plurals are judged once for each different word. MOST_BYTES of texts at a time, or those of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, MOST_BYTES + (ends[start - 1] if start else 0), "right")))
            part = batch.slice(start, stop - start)
            *rest, text = part.columns
            words = pc.split_pattern_regex(text, r"[^\p{L}\p{N}_]+")
            coded = words.flatten().dictionary_encode()
            word = coded.dictionary
            plural = pc.and_(pc.match_substring_regex(word, "^[a-z]{3,}s$"), pc.invert(pc.ends_with(word, "ss")))
            terms = pc.if_else(plural, pc.utf8_slice_codeunits(word, 0, -1), word).dictionary_encode()
            kept = pc.invert(pc.is_in(word, pa.array(["", *STOPWORDS])))
            code = np.where(kept.to_numpy(zero_copy_only=False), terms.indices.to_numpy(), -1)[coded.indices.to_numpy()]
            row = pc.list_parent_indices(words).to_numpy()[code >= 0]
            begins = pa.array(np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32))
            t = pa.ListArray.from_arrays(begins, pa.DictionaryArray.from_arrays(pa.array(code[code >= 0]), terms.dictionary), mask=pc.is_null(text))
            yield pa.RecordBatch.from_arrays([*rest, t], part.schema.names)
            start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end with an array of terms to rows that end with (run, len); MOST terms at a time, or those of one row."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, MOST + (ends[start - 1] if start else 0), "right")))
            part = batch.slice(start, stop - start)
            *rest, t = part.columns
            coded = t.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            each, tf = np.unique(pc.list_parent_indices(t).to_numpy() * np.int64(n) + coded.indices.to_numpy(), return_counts=True)
            begins = np.searchsorted(each, np.arange(len(t) + 1, dtype=np.int64) * n)
            run = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(each % n)), pa.array(tf.astype(np.int32))], ["term", "tf"])
            run = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), run)
            yield pa.RecordBatch.from_arrays([*rest, run, pc.list_value_length(t)], [*part.schema.names[:-1], "run", "len"])
            start = stop


def term_counts(documents: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """(doc_id, …, term, tf, len): a row for each term of each document. Counted within each row, so nothing is shuffled. Null and
    empty texts have no terms.
    """
    return _runs(documents, doc_id, text, *keep).select("doc_id", *keep, F.explode("run").alias("r"), "len").select("doc_id", *keep, "r.term", "r.tf", "len")


def term_stats(counts: DataFrame, *scope: str) -> DataFrame:
    """(scope…, term, df, cf)."""
    return counts.groupBy(*scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(documents: DataFrame, text: str, *scope: str) -> DataFrame:
    """(scope…, n, avg_len) over all documents, those without terms included."""
    length = F.coalesce(F.size(tokens(F.col(text))), F.lit(0))
    return documents.groupBy(*scope).agg(F.count("*").alias("n"), F.avg(F.greatest(length, F.lit(0))).alias("avg_len"))


def _weighed(documents: DataFrame, queries: DataFrame, doc_id: str, text: str, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """(postings with the gain of each, asked terms with df and idf). Documents are tokenised once, into a table of the shared folder."""
    keys = [scope] if scope else []
    postings = materialise(term_counts(documents, doc_id, text, *keys), "postings")
    asked = _runs(queries, "query_id", "question", *keys).select(F.col("doc_id").alias("query_id"), *keys, F.explode("run.term").alias("term"))
    n = documents.groupBy(*keys).agg(F.count("*").alias("n"))
    total = postings.groupBy(*keys).agg(F.sum("tf").alias("terms"))
    total = (n.join(total, keys) if keys else n.crossJoin(total)).select(*keys, "n", (F.col("terms") / F.col("n")).alias("avg_len"))
    wanted = postings.join(asked.select(*keys, "term").distinct(), [*keys, "term"], "left_semi")
    # without a scope the statistics are one row, which goes to every task
    with_total = lambda df: df.join(total, keys) if keys else df.crossJoin(F.broadcast(total))
    df = with_total(wanted.groupBy(*keys, "term").agg(F.count("*").alias("df")))
    terms = df.select(*keys, "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return with_total(wanted).select(*keys, "term", "doc_id", gain.alias("gain")), asked.join(terms, [*keys, "term"])


def bm25(documents: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    ``queries`` has (query_id, question) and, with ``scope``, that column: a query then sees only documents of its scope, whose
    statistics are those of the scope alone. Only postings of terms that some query has are kept before anything is shuffled
    further; scores add up in two steps, so frequent terms are combined within tasks.
    """
    keys = [scope] if scope else []
    postings, asked = _weighed(documents, queries, doc_id, text, scope)
    hit = asked.join(postings, [*keys, "term"])
    return hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("gain")).alias("score"))


def bm25_top(documents: DataFrame, queries: DataFrame, k: int = POOL, doc_id: str = "doc_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` of bm25() by score, rounded to six places, and doc_id; exact.

    Documents are tokenised once, into a table of the shared folder. Queries of the same terms are scored once; the rows of one
    query_id ask all their terms together. Sets of terms are taken in blocks of bounded size; each task adds up a block's scores
    over its own documents and keeps ``k`` of each set, so no score is shuffled but these. Of several blocks each is written
    to the shared folder before the next is collected, so the driver holds one at a time. Rows of one doc_id count together.
    """
    keys = [scope] if scope else []
    # a term of a scope is a term of its own
    scoped = (lambda t: F.concat(F.col(scope).cast("string"), F.lit("\u001f"), t)) if scope else (lambda t: t)
    docs = materialise(_runs(documents, doc_id, text, *keys), "terms")
    stats = docs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.greatest("len", F.lit(0))).alias("terms"))
    stats = materialise(stats.select(*keys, "n", (F.col("terms") / F.nullif("n", F.lit(0))).alias("avg_len")), "statistics")
    # without a scope the statistics are one row, which goes to every task
    with_stats = lambda df: df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    df = with_stats(docs.select(*keys, F.explode("run.term").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")

    asked = _runs(queries.where("query_id is not null"), "query_id", "question", *keys).select(F.col("doc_id").alias("query_id"), F.transform("run.term", scoped).alias("t")).where("size(t) > 0")
    asked = materialise(asked.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("terms")), "asked")
    sets = asked.groupBy("terms").agg(F.min("query_id").alias("set"))
    members = asked.join(sets, "terms").select("query_id", "set")
    weights = materialise(sets.select("set", F.explode("terms").alias("term")).join(df.select(scoped(F.col("term")).alias("term"), idf), "term"), "weights")

    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    terms = F.transform("run.term", scoped) if scope else F.col("run.term")
    gains = with_stats(docs.where("size(run) > 0")).select("doc_id", terms.alias("terms"), F.col("run.tf").alias("tf"), norm.alias("norm"))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        gains = gains.withColumn("gains", F.transform("tf", lambda tf: tf * (K1 + 1) / (tf + F.col("norm"))))
        gains = gains.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("gains")).alias("gains"))

    # a task keeps k of each set, so there are as many tasks as can run at once, whatever the number of documents
    gains = gains.coalesce(gains.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-weights.count() // TERMS))
    kinds = f"set {weights.schema['set'].dataType.simpleString()}, doc_id {gains.schema['doc_id'].dataType.simpleString()}, score double"

    def block(b: int) -> DataFrame:
        found = gains.mapInArrow(_scorer(weights.where(F.pmod(F.xxhash64("set"), F.lit(blocks)) == b).toArrow(), k), kinds)
        return top(found, F.col("score"), k, key="set")

    best = block(0) if blocks == 1 else reduce(DataFrame.unionByName, [materialise(block(b), "bm25") for b in range(blocks)])
    return members.join(best, "set").select("query_id", "doc_id", "score", "rank")


def _scorer(weights: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work for bm25_top(): from rows (doc_id, terms, tf, norm) or (doc_id, terms, gains) to (set, doc_id, score), the first
    ``k`` of each set, of which ``weights`` has (set, term, idf). Documents are taken DOCS at a time, by term; of later ones only those are kept that reach
    the k-th score so far."""
    first = lambda c: weights[c].combine_chunks().dictionary_encode()
    sets, terms = first("set"), first("term")
    names, words = sets.dictionary, terms.dictionary
    number, term = sets.indices.to_numpy(zero_copy_only=False), terms.indices.to_numpy(zero_copy_only=False)
    idf = np.zeros(len(words))
    idf[term] = weights["idf"].to_numpy()
    by_set = np.lexsort((term, number))
    members = np.split(term[by_set], np.searchsorted(number[by_set], np.arange(1, len(names)))) if len(names) else []

    def scored(batches: list[pa.RecordBatch], best: np.ndarray) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        by_id = pc.sort_indices(t["doc_id"]).to_numpy()
        ids, place = t["doc_id"].combine_chunks().take(pa.array(by_id)), np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        found = pc.index_in(pc.list_flatten(t["terms"]), words).fill_null(-1).to_numpy()
        row = pc.list_parent_indices(t["terms"]).to_numpy()
        known = np.flatnonzero(found >= 0)
        known = known[np.argsort(found[known], kind="stable")]
        found, row = found[known], row[known]
        if "norm" in t.column_names:
            tf = pc.list_flatten(t["tf"]).to_numpy()[known]
            gain = tf * (K1 + 1) / (tf + t["norm"].to_numpy()[row])
        else:
            gain = pc.list_flatten(t["gains"]).to_numpy()[known]
        gain, doc = gain * idf[found], place[row]
        ends = np.searchsorted(found, np.arange(len(words) + 1)).tolist()
        which, where, scores = [], [], []
        for s, own in enumerate(members):
            parts = [slice(ends[w], ends[w + 1]) for w in own.tolist() if ends[w] < ends[w + 1]]
            if not parts:
                continue
            total = np.bincount(np.concatenate([doc[p] for p in parts]), np.concatenate([gain[p] for p in parts]))
            # rounding can't lift a document by more than half a millionth
            at = np.flatnonzero(total >= max(best[s, 0] - 1e-6, 1e-300))
            score = np.round(total[at], 6)
            bound = best[s, 0] if len(at) <= k else max(best[s, 0], np.partition(score, -k)[-k])
            at, score = at[score >= bound], score[score >= bound]
            # of those that tie the ids decide, by which documents are numbered
            first = np.argsort(-score, kind="stable")[:k]
            if len(first):
                which.append(np.full(len(first), s))
                where.append(at[first])
                scores.append(score[first])
                best[s] = np.sort(np.concatenate([best[s], score[first]]))[-k:]
        if not which:
            return pa.RecordBatch.from_arrays([names[:0], ids[:0], pa.array([], pa.float64())], ["set", "doc_id", "score"])
        return pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(which))), ids.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(scores))], ["set", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, n = np.full((len(names), k), -np.inf), [], 0
        for batch in batches:
            part.append(batch)
            n += batch.num_rows
            if n >= DOCS:
                yield scored(part, best)
                part, n = [], 0
        if n:
            yield scored(part, best)

    return run


def top(scored: DataFrame, by: Column, k: int, rank: str = "rank", key: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each ``key`` with their rank; Spark cuts to ``k`` within each task before it shuffles."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(by.desc(), "doc_id"))).where(F.col(rank) <= k)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, doc_id, similarity, rank): exact nearest neighbours of each query's vector.

    ``vectors`` has (doc_id, vec), ``queries`` (query_id, vec). Queries are taken in blocks of bounded size; each task matches its
    rows against a block by one matrix product and keeps ``k`` of each query, so what is shuffled is k rows a query and task.
    Of several blocks each is written to the shared folder before the next is collected, so the driver holds one at a time.
    Null vectors match nothing.
    """
    queries = queries.where("vec is not null").select("query_id", "vec")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, similarity double"

    def block(b: int) -> DataFrame:
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        ids = [r.query_id for r in rows]
        m = np.array([r.vec for r in rows], dtype=np.float64).reshape(len(rows), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in frames:
                if not len(pdf) or not len(ids):
                    continue
                v = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.round(v @ m.T, 12)
                keep = min(k, len(pdf))
                # all that tie with the last one stay until the ids decide
                bound = np.partition(s, len(pdf) - keep, axis=0)[len(pdf) - keep]
                row, col = np.nonzero(s >= bound)
                found = pd.DataFrame({"query_id": np.array(ids, dtype=object)[col], "doc_id": pdf["doc_id"].to_numpy()[row], "similarity": s[row, col]})
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["similarity", "doc_id"], ascending=[False, True], kind="stable").groupby("query_id", sort=False).head(k)
            if best is not None:
                yield best

        return vectors.where("vec is not null").select("doc_id", "vec").mapInPandas(run, kinds)

    if blocks == 1:
        return top(block(0), F.col("similarity"), k)
    return reduce(DataFrame.unionByName, [materialise(top(block(b), F.col("similarity"), k), "cosine") for b in range(blocks)])


def fused(first: DataFrame, second: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, doc_id, rank_score, first_rank, second_rank): reciprocal rank fusion of two rankings (query_id, doc_id, rank)."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("first_rank")).join(second.select("query_id", "doc_id", F.col("rank").alias("second_rank")), ["query_id", "doc_id"], "full")
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    both = both.withColumn("rank_score", F.round(part("first_rank") + part("second_rank"), 12))
    return top(both, F.col("rank_score"), k, "fused_rank")
