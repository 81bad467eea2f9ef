"""Retrieval: exact dense top-k, BM25, reciprocal rank fusion, roll-up to parents, and the hybrid of all for a batch of queries.

Every route works for many queries at once: ``query_id`` is part of every key and top-k per query is a rank that Spark prunes before the
shuffle (WindowGroupLimit). Ties fall to the smaller id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..session import spread, stage_table

K1, B, RRF_K = 1.2, 0.75, 60
#: Query vectors sent to the executors at once.
BLOCK = 2048
#: Up to so many query terms are sent to every task; beyond, the corpus' tokens are shuffled to them.
SMALL = 200_000


def need_positive(k: int) -> int:
    if k <= 0:
        raise ValueError(f"top_k must be positive, got {k}")
    return k


def top(df: DataFrame, score: Column, k: int, by: list[str], tie: str) -> DataFrame:
    """The best ``k`` rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= need_positive(k))


def _matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as one matrix, and which rows have one."""
    have = v.is_valid().to_numpy(zero_copy_only=False)
    flat = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = int(have.sum())
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1), have


def _scan(ids: list, matrix: np.ndarray, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, have = _matrix(b.column("embedding"))
            own = b.column("vec_id").to_numpy(zero_copy_only=False)[have]
            if not len(own):
                continue
            s = np.einsum("qd,nd->qn", matrix, x)
            kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            q, n = np.nonzero(s >= kth[:, None] - 1e-8)  # ties stay, to be ranked by id
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids)[q]), pa.array(own[n]), pa.array(s[q, n])], names=["query_id", "vec_id", "score"])

    return scan


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` vectors of greatest inner product for each query, exactly.

    The query set is stated by the caller and is taken in blocks of ``BLOCK`` vectors; every block meets all vectors in one scan, as a matrix
    product that keeps only what can be among a query's best, so the shuffle carries k rows per query and batch."""
    need_positive(k)
    rows_of = stage_table(queries.select("query_id", "embedding"))
    n = max(1, -(-rows_of.count() // BLOCK))
    out: DataFrame | None = None
    for block in range(n):
        rows = rows_of.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).select("query_id", "embedding").orderBy("query_id").collect()  # about BLOCK rows
        rows = [r for r in rows if r["embedding"] is not None]
        if not rows:
            continue
        scan = _scan([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), k)
        found = vectors.select("vec_id", "embedding").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    return top(out, F.round("score", 9), k, ["query_id"], "vec_id")


def term_table(docs: DataFrame) -> DataFrame:
    """(term, occurrences, documents) of a corpus with one text a row: every token and every first one of a text leave the scan as a term and a mark,
    summed in each task before the one shuffle."""
    own = T.terms(F.coalesce(F.col("text"), F.lit("")))
    rows = spread(docs.select("text")).select(own.alias("terms")).select(F.explode(F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))), F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))))).alias("t"))
    return rows.groupBy("t.term").agg(F.sum(1 - F.col("t.first")).alias("occurrences"), F.sum("t.first").cast("bigint").alias("documents"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score, rank): BM25 top-k of ``queries(query_id, text)`` over ``docs(key, text)``. The corpus is read and cut into terms once; only
    the queries' terms, and an empty one that carries each document's length, leave the scan and are written for the rest."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    kept = stage_table(wanted.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct())
    kept = F.broadcast(kept) if kept.count() <= SMALL else kept
    listed = spread(docs.select(key, "text")).select(key, F.array_append(T.terms(F.coalesce(F.col("text"), F.lit(""))), F.lit("")).alias("terms"))
    tokens = listed.select(key, (F.size("terms") - 1).alias("dl"), F.explode("terms").alias("term")).join(kept, "term", "left_semi")
    tf = stage_table(tokens.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    n, avgdl = tf.filter("term = ''").agg(F.count("*"), F.avg("dl")).first()  # two numbers
    df = tf.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    weight = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = wanted.join(weight, "term").join(tf, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    return top(scored, F.round("score", 9), k, ["query_id"], key)


def rrf(hits: DataFrame, k: int, by: list[str], key: str = "chunk_id", const: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``hits(by..., key, dense_rank, sparse_rank)``: the best ``k`` by the unrounded sum of 1 / (const + rank), the score
    rounded after ranking."""
    one = lambda r: F.coalesce(F.lit(1e0) / (const + F.col(r)), F.lit(0e0))
    scored = hits.withColumn("raw", one("dense_rank") + one("sparse_rank"))
    return top(scored, F.col("raw"), k, by, key).withColumn("rrf_score", F.round("raw", 6)).drop("raw")


def merge_routes(dense_hits: DataFrame, sparse_hits: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row per query and record with its rank on each route, null where it was not found."""
    keys = [*by, key]
    return dense_hits.select(*keys, F.col("rank").alias("dense_rank")).join(sparse_hits.select(*keys, F.col("rank").alias("sparse_rank")), keys, "full_outer")


def roll_up(children: DataFrame, parents: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fused children to parents: one row per parent, in the order of its best child, with all its hits; and the children whose parent is
    missing."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"), "doc_id")
    joined = children.join(p, "parent_id", "left")
    lost = joined.filter("parent_text is null").select(*by, "parent_id", "chunk_id")
    hit = F.struct("rank", "chunk_id", "rrf_score")
    per = joined.filter("parent_text is not null").groupBy(*by, "parent_id").agg(F.min("rank").alias("best"), F.first("parent_text").alias("parent_text"), F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(hit)).alias("hits"))
    ranked = per.withColumn("parent_rank", F.row_number().over(Window.partitionBy(*by).orderBy("best", "parent_id")))
    return ranked.select(*by, "parent_rank", "parent_id", "doc_id", "parent_text", "hits"), lost


def view(parents: DataFrame, children: DataFrame, by: list[str], most: int = 500) -> DataFrame:
    """What a reader is shown of each hit: document, child number, matched child then parent (the child first, so that the cut never hides what
    matched), score."""
    each = parents.select(*by, "parent_rank", "parent_id", "doc_id", "parent_text", F.explode("hits").alias("h"))
    c = children.select("chunk_id", F.col("text").alias("child_text"), "source")
    rows = each.select("*", F.col("h.chunk_id").alias("chunk_id"), F.col("h.rrf_score").alias("score")).join(c, "chunk_id")
    return rows.select(*by, "parent_rank", "chunk_id", "doc_id", F.coalesce("source", F.lit("")).alias("filename"), T.seq_of(F.col("chunk_id")).alias("seq"), F.left(F.concat_ws("\n---\n", "child_text", "parent_text"), F.lit(most)).alias("content"), "score")


def search(chunks: DataFrame, queries: DataFrame, encode: Callable[[Column], Column], top_k: int = 5, depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """Hybrid search of ``queries(query_id, text)`` over child chunks: dense and BM25 routes to ``depth``, fused to ``top_k`` children, then rolled up,
    which may leave fewer parents than ``top_k``. ``encode`` gives a vector for a text column."""
    need_positive(top_k)
    kids = chunks.filter("parent_id <> ''").dropDuplicates(["chunk_id"])
    ids = kids.select("chunk_id", "parent_id", F.xxhash64("chunk_id").alias("vec_id"), "text")
    q = queries.select("query_id", F.xxhash64("query_id").alias("q"), "text")
    vectors = stage_table(ids.select("vec_id", encode(F.col("text")).alias("embedding")))  # encoded once, however many blocks of queries
    near = dense(vectors, q.select(F.col("q").alias("query_id"), encode(F.col("text")).alias("embedding")), depth)
    near = near.withColumnRenamed("query_id", "q").join(q.select("q", "query_id"), "q").join(ids.select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", "rank")
    sparse = bm25(ids.select("chunk_id", "text"), q.select("query_id", "text"), depth, key="chunk_id")
    fused = rrf(merge_routes(near, sparse, ["query_id"], "chunk_id"), top_k, ["query_id"]).join(ids.select("chunk_id", "parent_id"), "chunk_id")
    return roll_up(fused, chunks.filter("parent_id = ''").dropDuplicates(["chunk_id"]), ["query_id"])


def hashed_encoder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model, for mechanics and tests only: signed counts of hashed terms at length one. An encoder is any
    function from a text column to a vector column; this one is an Arrow UDF, as a model's would be."""
    def vectors(terms: pd.Series) -> pd.Series:
        out = []
        for row in terms:
            v = np.zeros(dim)
            for t in row if row is not None else ():
                h = zlib.crc32(t.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    udf = F.pandas_udf(vectors, ArrayType(DoubleType()))
    return lambda c: udf(T.terms(F.coalesce(c, F.lit(""))))


def routed(encoders: dict[str, Callable[[Column], Column]], kind: Column, default: Callable[[Column], Column], failed: Column | None = None) -> Callable[[Column], Column]:
    """An encoder that sends each row to the one for its type: images to an image encoder, say, tables and texts to the default. Where a type's encoder gives
    no vector, the row's ``failed`` text (an image's placeholder) is encoded by the default, so no row is without one."""

    def encode(c: Column) -> Column:
        out = default(c)
        for name, f in encoders.items():
            out = F.when(kind == name, F.coalesce(f(c), default(c if failed is None else failed))).otherwise(out)
        return out

    return encode
