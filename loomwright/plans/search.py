"""Search queries: documents are the corpus, and every twentieth document's title asks it (the stated query set: ids divisible by 20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import STOPWORDS, tokens
from ..operators import retrieval as R
from ..operators.terms import merged_intents
from ..tables import spread, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", "text", "source", "title"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", F.col("doc_id").alias("query_id"), "source", F.col("title").alias("question")).where("query_id % 20 = 0 and question is not null")


def tokenize_terms(spark, folder):
    return R.term_counts(_docs(spark, folder), "doc_id", "text").select("doc_id", "term", "tf")


def term_stats(spark, folder):
    return R.term_stats(R.term_counts(_docs(spark, folder), "doc_id", "text"))


def corpus_stats(spark, folder):
    return R.corpus_stats(_docs(spark, folder), "text", "source").select("source", "n", F.round("avg_len", 6).alias("avg_len"))


def bm25_topk(spark, folder):
    return R.bm25_top(_docs(spark, folder), _asked(spark, folder))


def bm25_scoped_topk(spark, folder):
    return R.bm25_top(_docs(spark, folder), _asked(spark, folder), scope="source")


def _vectors(spark, folder):
    return table(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def _vector_queries(spark, folder):
    return _vectors(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vec")


def _ranked_dense(spark, folder):
    near = R.cosine_top(_vectors(spark, folder), _vector_queries(spark, folder))
    return near.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


def cosine_topk(spark, folder):
    return _ranked_dense(spark, folder)


def vector_validation(spark, folder):
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.size("embedding").alias("dims"), V.is_unit(F.col("embedding")).alias("is_unit"))


def rrf_hybrid_topk(spark, folder):
    """Flagship: exact BM25 and exact cosine neighbours of each query, fused by reciprocal rank; the first four with their evidence."""
    lexical, dense = bm25_topk(spark, folder), _ranked_dense(spark, folder)
    best = R.fused(dense, lexical).where(F.col("fused_rank") <= 4)
    return best.select("query_id", "doc_id", "fused_rank", F.round("rank_score", 9).alias("rank_score"), F.col("first_rank").alias("dense_rank"), F.col("second_rank").alias("lexical_rank"))


def hybrid_trigger_first(spark, folder):
    """Fused matches of a query with those that share its source first, in their order (a stable sort on a flag)."""
    fused = R.fused(_ranked_dense(spark, folder), bm25_topk(spark, folder))
    docs = table(spark, folder, "documents", "doc_id", F.col("source").alias("s"))
    flagged = fused.join(docs, "doc_id").join(_asked(spark, folder).select("query_id", "source"), "query_id").withColumn("same", (F.col("s") == F.col("source")).cast("int"))
    return R.top(flagged.withColumn("order", F.col("same") * 100000 - F.col("fused_rank")), F.col("order"), 4, "final_rank").select("query_id", "doc_id", "same", "fused_rank", "final_rank")


def fused_page_check(spark, folder):
    """By source: how many queries, and how many of these have a document of their own source among the first four."""
    rows = hybrid_trigger_first(spark, folder).groupBy("query_id").agg(F.max("same").alias("hit")).join(_asked(spark, folder).select("query_id", "source"), "query_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def multi_intent_merge(spark, folder):
    """Two intents of each asking document, its title and its text's first line, searched by themselves and merged."""
    d = table(spark, folder, "documents", F.col("doc_id").alias("query_id"), "title", F.substring_index("text", "\n", 1).alias("line")).where("query_id % 20 = 0")
    asked = d.select((F.col("query_id") * 2).alias("query_id"), F.col("title").alias("question")).unionByName(d.select((F.col("query_id") * 2 + 1).alias("query_id"), F.col("line").alias("question"))).where("question is not null")
    found = R.bm25_top(_docs(spark, folder), asked)
    found = found.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).cast("int").alias("intent"), "doc_id", "rank")
    return merged_intents(found, 4)


def missing_embeddings(spark, folder):
    return table(spark, folder, "documents", "doc_id").join(table(spark, folder, "embeddings", F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def index_set_equality(spark, folder):
    d, e = table(spark, folder, "documents", "doc_id", F.lit(1).alias("d")), table(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), F.lit(1).alias("e"))
    both = d.join(e, "doc_id", "full")
    return both.agg(F.count_if(F.col("e").isNull()).alias("only_documents"), F.count_if(F.col("d").isNull()).alias("only_vectors"), F.count_if(F.col("d").isNotNull() & F.col("e").isNotNull()).alias("both"))


QUERIES = {q.__name__: q for q in (tokenize_terms, term_stats, corpus_stats, bm25_topk, bm25_scoped_topk, cosine_topk, vector_validation, rrf_hybrid_topk, hybrid_trigger_first, fused_page_check, multi_intent_merge, missing_embeddings, index_set_equality)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(text: str) -> str:
    """The search terms of an SQL text as a list."""
    return (f"list_transform(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})), "
            "lambda w: CASE WHEN regexp_full_match(w, '[a-z]{3,}s') AND NOT w LIKE '%ss' THEN w[1:len(w)-1] ELSE w END)")


_TERMS = f"""t AS (SELECT doc_id, source, {sql_tokens('text')} AS t FROM documents),
  tf AS (SELECT doc_id, source, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, source, unnest(t) AS term, len(t) AS l FROM t) GROUP BY ALL),
  q AS (SELECT DISTINCT doc_id AS query_id, source, unnest({sql_tokens('title')}) AS term FROM documents WHERE doc_id % 20 = 0)"""


_INTENT_TERMS = f"""i AS (SELECT doc_id AS query_id, 0 AS intent, title AS question FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id, 1, string_split(text, chr(10))[1] FROM documents WHERE doc_id % 20 = 0),
  iq AS (SELECT DISTINCT query_id, intent, unnest({sql_tokens('question')}) AS term FROM i)"""


def _bm25_sql(scoped: bool) -> str:
    using, key = (" USING (source)", "source, ") if scoped else ("", "")
    return f"""WITH {_TERMS}, n AS (SELECT {key}count(*) AS n, avg(coalesce(len(t), 0)) AS a FROM t{' GROUP BY source' if scoped else ''}),
      df AS (SELECT {key}term, count(*) AS df FROM tf GROUP BY {key}term),
      s AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
        FROM q JOIN tf USING ({key}term) JOIN df USING ({key}term) {'JOIN n USING (source)' if scoped else ', n'} GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
      SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 24"""


_COSINE = """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 12) AS s FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
  r AS (SELECT query_id, doc_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM s)
  SELECT * FROM r WHERE rank <= 24"""

_FUSED = f"""l AS ({_bm25_sql(False)}), d AS ({_COSINE}),
  f AS (SELECT query_id, doc_id, d.rank AS dense_rank, l.rank AS lexical_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 12) AS rank_score FROM d FULL JOIN l USING (query_id, doc_id)),
  g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, doc_id) AS INTEGER) AS fused_rank FROM f)"""
_TRIGGER = f"""{_FUSED}, h AS (SELECT g.*, CAST(x.source = y.source AS INTEGER) AS same FROM g JOIN documents x USING (doc_id) JOIN documents y ON y.doc_id = query_id AND y.title IS NOT NULL WHERE fused_rank <= 24),
  i AS (SELECT query_id, doc_id, same, fused_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY same * 100000 - fused_rank DESC, doc_id) AS INTEGER) AS final_rank FROM h)"""

ORACLE = {
    "tokenize_terms": f"WITH {_TERMS} SELECT doc_id, term, CAST(tf AS INTEGER) AS tf FROM tf",
    "term_stats": f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term",
    "corpus_stats": f"WITH {_TERMS} SELECT source, count(*) AS n, round(avg(coalesce(len(t), 0)), 6) AS avg_len FROM t GROUP BY source",
    "bm25_topk": _bm25_sql(False),
    "bm25_scoped_topk": _bm25_sql(True),
    "cosine_topk": _COSINE,
    "vector_validation": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) - 1) <= 0.02 AS is_unit FROM embeddings",
    "rrf_hybrid_topk": f"WITH {_FUSED} SELECT query_id, doc_id, fused_rank, round(rank_score, 9) AS rank_score, dense_rank, lexical_rank FROM g WHERE fused_rank <= 4",
    "hybrid_trigger_first": f"WITH {_TRIGGER} SELECT * FROM i WHERE final_rank <= 4",
    "fused_page_check": f"WITH {_TRIGGER}, k AS (SELECT query_id, max(same) AS hit FROM i WHERE final_rank <= 4 GROUP BY query_id) SELECT source, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM k JOIN documents ON doc_id = query_id GROUP BY source",
    "multi_intent_merge": f"""WITH {_TERMS}, {_INTENT_TERMS}, n AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS a FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, intent, tf.doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM iq JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, intent ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
      SELECT query_id, doc_id, string_agg(CAST(intent AS VARCHAR), ',' ORDER BY intent) AS intents, min(intent) AS first_intent, min(rank) AS best_rank, bool_or(rank <= 4) AS primary FROM r WHERE rank <= 24 GROUP BY ALL""",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "index_set_equality": "SELECT count(*) FILTER (vec_id IS NULL) AS only_documents, count(*) FILTER (doc_id IS NULL) AS only_vectors, count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NOT NULL) AS both FROM documents FULL JOIN embeddings ON vec_id = doc_id",
}
