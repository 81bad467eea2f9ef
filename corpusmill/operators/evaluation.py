"""Evaluation of retrieval: NaN-aware means, missing ids, comparison of runs, label-based ranking measures, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")


def number(c):
    """The value, null for NaN."""
    return F.when(~F.isnan(c), F.col(c) if isinstance(c, str) else c)


def once(samples: DataFrame) -> DataFrame:
    """Each sample once, as it arrived last."""
    return samples.groupBy("sample_id").agg(F.max_by(F.struct(*[c for c in samples.columns if c != "sample_id"]), "arrived_at").alias("s")).select("sample_id", "s.*")


def summary(samples: DataFrame) -> DataFrame:
    """Per run: each metric's mean over its rows that have it (null if none has), to four digits, and how many rows lack any."""
    lacks = F.lit(False)
    for m in METRICS:
        lacks = lacks | number(m).isNull()
    means = [F.round(F.avg(number(m)), 4).alias(m) for m in METRICS]
    counts = [F.count(number(m)).alias(f"n_{m}") for m in METRICS]
    return samples.groupBy("run_id").agg(F.count("*").alias("questions"), *means, *counts, F.sum(lacks.cast("int")).alias("incomplete"))


def incomplete(samples: DataFrame) -> DataFrame:
    """(run_id, ids): the samples that lack a metric, in order."""
    lacks = number(METRICS[0]).isNull()
    for m in METRICS[1:]:
        lacks = lacks | number(m).isNull()
    return samples.filter(lacks).select("run_id", "sample_id", "question_id")


def long(samples: DataFrame) -> DataFrame:
    """(run_id, metric, mean, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(m).alias("v")) for m in METRICS]))
    return samples.select("run_id", pairs.alias("p")).groupBy("run_id", "p.metric").agg(F.round(F.avg("p.v"), 4).alias("mean"), F.count("p.v").alias("n"))


def compare(samples: DataFrame, runs: list[str]) -> DataFrame:
    """Metrics by runs."""
    return long(samples).groupBy("metric").pivot("run_id", runs).agg(F.first("mean"))


def ranking(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Label-based measures of ``hits(query_id, id, rank)`` against ``relevant(query_id, id)``: precision and recall at ``k``, reciprocal rank."""
    wanted = relevant.select("query_id", "id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    good = hits.filter(F.col("rank") <= k).join(wanted, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    rows = total.join(good, "query_id", "left")
    zero = F.lit(0)
    return rows.select("query_id", (F.coalesce("found", zero) / F.lit(float(k))).alias("precision_at_k"), (F.coalesce("found", zero) / F.col("relevant")).alias("recall_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def assemble(questions: DataFrame, parents: DataFrame) -> DataFrame:
    """Samples from questions and their rolled-up parents: contexts in rank order."""
    contexts = parents.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("parent_rank", "parent_text"))), lambda x: x["parent_text"]).alias("retrieved_contexts"))
    return questions.join(contexts, questions["question_id"] == contexts["query_id"], "left").select("question_id", F.col("question").alias("user_input"), F.col("ground_truth").alias("reference"), F.coalesce("retrieved_contexts", F.array().cast("array<string>")).alias("retrieved_contexts"))


def debug_rows(parents: DataFrame) -> DataFrame:
    """One row per parent and hit."""
    return parents.select("query_id", "parent_rank", "parent_id", F.inline("hits"))


def report(rows: DataFrame, folder: str, about: dict) -> tuple[str, str]:
    """JSON and Markdown of a comparison table, one row per run, with what was evaluated and how."""
    found = [r.asDict() for r in rows.orderBy("run_id").collect()]  # one row per run
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = Path(folder, "report.json"), Path(folder, "report.md")
    paths[0].write_text(json.dumps({"about": about, "runs": found}, ensure_ascii=False, indent=1), encoding="utf-8")
    head = list(found[0]) if found else ["run_id"]
    lines = [f"- {k}: {v}" for k, v in about.items()] + ["", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)] + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in found]
    paths[1].write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(paths[0]), str(paths[1])
