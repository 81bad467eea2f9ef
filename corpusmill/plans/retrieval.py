"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, vectors
from ..operators import evaluation, pipeline, retrieval
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_TERM, _STOP = T.TERM, T.CJK_STOP


def _terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{_TERM}'), lambda t: NOT (regexp_full_match(t, '[a-z]') OR contains('{_STOP}', t)))"


_HITS = "SELECT query_id, chunk_id, min(parent_id) AS parent_id, min(dense_rank) AS dense_rank, min(sparse_rank) AS sparse_rank FROM fused_children GROUP BY query_id, chunk_id"
_FUSED = f"""WITH h AS ({_HITS}),
    s AS (SELECT *, coalesce(1e0 / (60 + dense_rank), 0e0) + coalesce(1e0 / (60 + sparse_rank), 0e0) AS raw FROM h),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank, round(raw, 6) AS rrf_score FROM s QUALIFY rank <= 5)"""
_PARENTS = "SELECT chunk_id AS parent_id, min(text) AS parent_text, min(doc_id) AS doc_id FROM chunks WHERE parent_id = '' GROUP BY chunk_id"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit once: a query's chunk with its rank on each route."""
    return table(spark, sf_dir, "fused_children").groupBy("query_id", "chunk_id").agg(F.min("parent_id").alias("parent_id"), F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("parent_id = ''").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("parent_id <> ''").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("source").alias("source"))


@query(
    "dense_topk",
    sql="""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], qe) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(v, q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    "vector_units",
    sql="""SELECT vec_id, label, len(embedding) AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
    round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first_unit FROM embeddings""",
)
def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", vectors.checked(F.col("embedding"), 64))
    return v.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(F.element_at(vectors.unit(F.col("embedding")), 1), 5).alias("first_unit"))


_BM25 = f"""WITH d AS (SELECT doc_id, {_terms("text")} AS terms FROM documents),
    n AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
    q AS (SELECT DISTINCT question_id AS query_id, unnest({_terms("question")}) AS term FROM test_set),
    t AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
    w AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT q.query_id, p.doc_id, sum(ln(1 + (n.n - w.df + 0.5) / (w.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / n.avgdl))) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), n GROUP BY q.query_id, p.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20"""


@query("bm25_topk", sql=_BM25)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "test_set").select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    return retrieval.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), q, 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    "term_counts",
    sql=f"""WITH t AS (SELECT doc_id, unnest({_terms("text")}) AS term FROM documents)
    SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY term""",
)
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and in how many documents each term stands."""
    return retrieval.term_table(table(spark, sf_dir, "documents"))


@query("rrf_fuse", sql=f"{_FUSED} SELECT query_id, chunk_id, dense_rank, sparse_rank, rank, rrf_score FROM f")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(hits(spark, sf_dir), 5, ["query_id"]).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rank", "rrf_score")


@query(
    "rrf_single_route",
    sql=f"""WITH h AS ({_HITS}) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY 1e0 / (60 + dense_rank) DESC, chunk_id) AS rank
    FROM h WHERE dense_rank IS NOT NULL QUALIFY rank <= 5""",
)
def rrf_single_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one route empty the other's order stays."""
    one = hits(spark, sf_dir).filter("dense_rank is not null").withColumn("sparse_rank", F.lit(None).cast("int"))
    return retrieval.rrf(one, 5, ["query_id"]).select("query_id", "chunk_id", "rank")


@query(
    "route_union",
    sql=f"""WITH h AS ({_HITS}) SELECT query_id, count(*) AS candidates, count(dense_rank) AS by_dense, count(sparse_rank) AS by_sparse,
    count(CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 1 END) AS by_both FROM h GROUP BY query_id""",
)
def route_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of both routes, merged by a full outer join."""
    h = hits(spark, sf_dir)
    d, s = h.filter("dense_rank is not null").withColumn("rank", F.col("dense_rank")), h.filter("sparse_rank is not null").withColumn("rank", F.col("sparse_rank"))
    both = retrieval.merge_routes(d, s, ["query_id"], "chunk_id")
    lone = h.filter("dense_rank is null and sparse_rank is null").select("query_id", "chunk_id", "dense_rank", "sparse_rank")
    rows = both.unionByName(lone)
    return rows.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count("dense_rank").alias("by_dense"), F.count("sparse_rank").alias("by_sparse"), F.count(F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), 1)).alias("by_both"))


@query(
    "rrf_hybrid",
    sql=f"""{_FUSED}, p AS ({_PARENTS}),
    g AS (SELECT query_id, parent_id, min(rank) AS best, any_value(doc_id) AS doc_id, any_value(length(parent_text)) AS parent_chars, count(*) AS n_hits, max(rrf_score) AS best_score,
          string_agg(chunk_id, ',' ORDER BY rank) AS hits FROM f JOIN p USING (parent_id) GROUP BY query_id, parent_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best, parent_id) AS parent_rank, parent_id, doc_id, parent_chars, n_hits, best_score, hits FROM g""",
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: both routes fused, the best children rolled up to their parents."""
    fused = retrieval.rrf(hits(spark, sf_dir), 5, ["query_id"])
    found, _ = retrieval.roll_up(fused, parents(spark, sf_dir), ["query_id"])
    ids = F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ",")
    return found.select("query_id", "parent_rank", "parent_id", "doc_id", F.length("parent_text").alias("parent_chars"), F.size("hits").alias("n_hits"), F.array_max(F.transform("hits", lambda h: h["rrf_score"])).alias("best_score"), ids.alias("hits"))


@query("lost_parents", sql=f"{_FUSED}, p AS ({_PARENTS}) SELECT query_id, parent_id, chunk_id FROM f ANTI JOIN p USING (parent_id)")
def lost_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused children whose parent is gone: a warning row each, never a silent loss."""
    return retrieval.roll_up(retrieval.rrf(hits(spark, sf_dir), 5, ["query_id"]), parents(spark, sf_dir), ["query_id"])[1]


@query(
    "kb_view",
    sql=f"""{_FUSED}, p AS ({_PARENTS}), c AS (SELECT chunk_id, min(text) AS child_text, min(source) AS source FROM chunks WHERE parent_id <> '' GROUP BY chunk_id)
    SELECT f.query_id, f.chunk_id, p.doc_id, coalesce(c.source, '') AS filename, TRY_CAST(nullif(regexp_extract(f.chunk_id, ':c([0-9]+)$', 1), '') AS INT) AS seq,
    left(c.child_text || chr(10) || '---' || chr(10) || p.parent_text, 500) AS content, f.rrf_score AS score FROM f JOIN p USING (parent_id) JOIN c ON c.chunk_id = f.chunk_id""",
)
def kb_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.rrf(hits(spark, sf_dir), T.clamp_k(0), ["query_id"])
    found, _ = retrieval.roll_up(fused, parents(spark, sf_dir), ["query_id"])
    return retrieval.view(found, children(spark, sf_dir), ["query_id"]).drop("parent_rank")


@query(
    "hit_rows",
    sql=f"""{_FUSED}, p AS ({_PARENTS}), g AS (SELECT query_id, parent_id, min(rank) AS best FROM f JOIN p USING (parent_id) GROUP BY query_id, parent_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, parent_id) AS parent_rank FROM g)
    SELECT o.query_id, o.parent_rank, o.parent_id, f.rank, f.chunk_id, f.rrf_score FROM o JOIN f USING (query_id, parent_id)""",
)
def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per parent and hit."""
    found, _ = retrieval.roll_up(retrieval.rrf(hits(spark, sf_dir), 5, ["query_id"]), parents(spark, sf_dir), ["query_id"])
    return evaluation.debug_rows(found)


@query(
    "route_agreement",
    sql=f"""WITH h AS ({_HITS}), rel AS (SELECT query_id, chunk_id AS id FROM h WHERE dense_rank <= 5), hit AS (SELECT query_id, chunk_id AS id, sparse_rank AS rank FROM h WHERE sparse_rank <= 5),
    t AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY query_id), g AS (SELECT query_id, count(*) AS found, min(rank) AS first FROM hit SEMI JOIN rel USING (query_id, id) GROUP BY query_id)
    SELECT query_id, round(coalesce(found, 0) / 5e0, 6) AS precision_at_k, round(coalesce(found, 0) / relevant::DOUBLE, 6) AS recall_at_k, round(coalesce(1e0 / first, 0e0), 6) AS reciprocal_rank FROM t LEFT JOIN g USING (query_id)""",
)
def route_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-based ranking measures, with the dense route's best five as labels for the sparse route."""
    h = hits(spark, sf_dir)
    labels = h.filter("dense_rank <= 5").select("query_id", F.col("chunk_id").alias("id"))
    out = evaluation.ranking(h.filter("sparse_rank is not null").select("query_id", F.col("chunk_id").alias("id"), F.col("sparse_rank").alias("rank")), labels, 5)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")])


@query("hybrid_search")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes from text: test questions over all child chunks, with the stand-in encoder, fused and rolled up."""
    q = table(spark, sf_dir, "test_set").select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    found, _ = retrieval.search(table(spark, sf_dir, "chunks"), q, retrieval.hashed_encoder())
    return found.select("query_id", "parent_rank", "parent_id", "doc_id", F.size("hits").alias("n_hits"))


@query("evaluation_samples")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the test set with the contexts that the hybrid search retrieves."""
    t = table(spark, sf_dir, "test_set")
    found, _ = retrieval.search(table(spark, sf_dir, "chunks"), t.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), retrieval.hashed_encoder())
    return evaluation.assemble(t, found)


@query("run_eval")
def run_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over the test set: searched with the stand-in encoder and measured against the documents whose chunks hold the question's first number, as
    those a reader would look up."""
    t, chunks = table(spark, sf_dir, "test_set"), table(spark, sf_dir, "chunks")
    number = F.regexp_extract("question", "[0-9]{3,}", 0)
    asked = t.select(F.col("question_id").alias("query_id"), number.alias("n")).filter("n <> ''")
    held = chunks.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0)))).alias("n"))
    return pipeline.evaluate(chunks, t, held.join(asked, "n").select("query_id", "id").distinct(), retrieval.hashed_encoder(), run_id="stand_in")[1]
