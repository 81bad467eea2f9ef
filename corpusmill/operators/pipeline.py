"""Whole runs: files to corpus tables, questions to an evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_table
from ..sources import documents
from . import chunking, corpus, evaluation, retrieval

Encoder = Callable[[Column], Column]


def ingest(files: DataFrame, encode: Encoder, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, report) of ``files(source, format, content)``: content id, items, cleaning, parents and children, byte limits, vectors; with
    a ``path`` the chunks then replace their sources' old ones in the table there. A file that can't be read, or holds nothing, is a row of
    the report with its reason and keeps no other from going on. Of files with the same content the first source in order is taken, the others are
    reported as its copies."""
    named = files.select("source", "format", corpus.address().alias("doc_id"), "content")
    taken = named.groupBy("doc_id").agg(F.min("source").alias("first"))
    own = named.join(taken, "doc_id").withColumn("copy", F.col("source") != F.col("first"))
    read = stage_table(documents.items(own.filter("not copy")))
    failed = read.filter("problem is not null").groupBy("doc_id").agg(F.first("problem").alias("reason"))
    items = read.filter("problem is null").select("doc_id", "pos", "type", "text", "heading_path", F.lit(None).cast("int").alias("page_no"), "level", F.lit(None).cast("string").alias("image_path"))
    cut = chunking.cleaned(items).join(taken.withColumnRenamed("first", "source"), "doc_id")
    fit, large = corpus.fit(cut.filter("parent_id <> ''"))
    parents, large_parents = corpus.fit(cut.filter("parent_id = ''"), corpus.PARENT_BYTES)
    chunks = stage_table(fit.withColumn("vector", encode(F.col("text"))).unionByName(parents, allowMissingColumns=True))
    counts = chunks.groupBy("doc_id").agg(F.sum((F.col("parent_id") == "").cast("int")).alias("parents"), F.sum((F.col("parent_id") != "").cast("int")).alias("children"))
    warned = large.select("doc_id", "warning").unionByName(large_parents.select("doc_id", "warning")).groupBy("doc_id").agg(F.count("*").alias("left_out"))
    rows = own.select("source", "doc_id", "copy", "first").distinct().join(failed, "doc_id", "left").join(counts, "doc_id", "left").join(warned, "doc_id", "left")
    reason = F.when(F.col("copy"), F.concat(F.lit("same content as "), F.col("first"))).otherwise(F.coalesce("reason", F.when(F.col("parents").isNull(), "no text")))
    zero = F.lit(0)
    ok = reason.isNull()
    report = rows.select("source", "doc_id", F.when(ok, "stored").when(F.col("copy"), "copy").otherwise("failed").alias("status"), reason.alias("reason"), *[F.when(ok, F.coalesce(c, zero)).otherwise(zero).alias(c) for c in ("parents", "children", "left_out")])
    if path is not None:
        corpus.store(chunks, path)
    return chunks, report


def evaluate(chunks: DataFrame, test_set: DataFrame, relevant: DataFrame, encode: Encoder, top_k: int = 5, run_id: str = "run", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, summary) of one run: every question searched, its sample assembled, label-based measures against ``relevant(query_id, id)`` (document ids)
    taken and averaged. With a ``folder`` samples and report are written there. Measures that a model has to judge are not computed here."""
    questions = test_set.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    found, _ = retrieval.search(chunks, questions, encode, top_k)
    found = stage_table(found)
    ranked = found.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.min("parent_rank").alias("rank"))
    measures = evaluation.ranking(ranked, relevant, top_k)
    samples = evaluation.assemble(test_set, found).withColumn("run_id", F.lit(run_id))
    means = measures.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")]).withColumn("run_id", F.lit(run_id))
    if folder is not None:
        samples.write.mode("overwrite").json(f"{folder}/samples")
        evaluation.report(means, folder, {"top_k": top_k})
    return samples, means
