"""Plans and task batches: readiness, failure cascade, validation, progress. Steps are ``(plan_id, step_id, status, ...)`` and dependencies
``(plan_id, step_id, dep_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import render
from ..session import stage_table

TERMINAL = ("done", "failed", "skipped")
PARALLEL = 3
#: Dependencies walked before what was reached is written.
HOPS = 3


def ready(steps: DataFrame, deps: DataFrame, at_once: int = PARALLEL) -> DataFrame:
    """Pending steps whose dependencies are all done, the first few of each plan."""
    state = steps.select("plan_id", F.col("step_id").alias("dep_id"), (F.col("status") == "done").alias("done"))
    met = deps.join(state, ["plan_id", "dep_id"], "left").groupBy("plan_id", "step_id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("met"))
    rows = steps.filter("status = 'pending'").join(met, ["plan_id", "step_id"], "left").filter(F.coalesce("met", F.lit(True)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("plan_id").orderBy("step_id"))).filter(F.col("n") <= at_once).select("plan_id", "step_id")


def cascade(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """Steps that a failure reaches: pending ones that depend, at any distance, on a failed or skipped step. Only dependencies of pending steps can
    carry a failure on; they are written once and walked from the failed steps until a round reaches nothing new, so a cycle ends too."""
    state = stage_table(steps.filter("status in ('failed', 'skipped', 'pending')").select("plan_id", "step_id", F.col("status").alias("s")))
    pending = state.filter("s = 'pending'").select("plan_id", "step_id")
    edges = stage_table(deps.join(pending, ["plan_id", "step_id"], "left_semi").select("plan_id", "step_id", "dep_id"))
    front = state.filter("s <> 'pending'").select("plan_id", F.col("step_id").alias("dep_id"))
    reached: DataFrame | None = None
    while True:
        found: DataFrame | None = None
        for _ in range(HOPS):
            hop = edges.join(front, ["plan_id", "dep_id"], "left_semi").select("plan_id", "step_id")
            found = hop if found is None else found.union(hop)
            front = hop.withColumnRenamed("step_id", "dep_id")
        new = stage_table(found.distinct() if reached is None else found.distinct().join(reached, ["plan_id", "step_id"], "left_anti"))
        if new.isEmpty():
            return pending.limit(0) if reached is None else reached
        reached = new if reached is None else reached.unionByName(new)
        front = new.select("plan_id", F.col("step_id").alias("dep_id"))


def invalid(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """(plan_id, step_id, problem): malformed or repeated ids, dependencies that are missing or not smaller."""
    bad_id = steps.filter(~F.col("step_id").rlike("^s[0-9]+$")).select("plan_id", "step_id", F.lit("id").alias("problem"))
    twice = steps.groupBy("plan_id", "step_id").count().filter("count > 1").select("plan_id", "step_id", F.lit("repeated").alias("problem"))
    missing = deps.join(steps.select("plan_id", F.col("step_id").alias("dep_id")).distinct(), ["plan_id", "dep_id"], "left_anti").select("plan_id", "step_id", F.lit("missing").alias("problem"))
    number = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit("^s([0-9]+)$"), F.lit(1)), F.lit(1)).cast("int")
    order = deps.filter(number(F.col("dep_id")) >= number(F.col("step_id"))).select("plan_id", "step_id", F.lit("order").alias("problem"))
    return bad_id.unionByName(twice).unionByName(missing).unionByName(order).distinct()


def finished(steps: DataFrame) -> DataFrame:
    """Per plan: whether every step has ended, and how many did."""
    end = F.col("status").isin(*TERMINAL)
    return steps.groupBy("plan_id").agg(F.bool_and(end).alias("finished"), F.sum(end.cast("int")).alias("ended"), F.count("*").alias("steps"))


def marked(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Steps with the outcome of their task: done, or failed, with a digest of 100 characters."""
    r = results.select("task_id", "ok", F.left("conclusion", F.lit(100)).alias("digest"))
    return steps.join(r, "task_id", "left").withColumn("status", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise(F.col("status"))).drop("ok")


def digests(deps: DataFrame, steps: DataFrame) -> DataFrame:
    """What a step is told of those before it: their digests in order."""
    rows = deps.join(steps.select("plan_id", F.col("step_id").alias("dep_id"), "title", "digest"), ["plan_id", "dep_id"])
    line = F.concat(F.col("dep_id"), F.lit(" "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("digest", F.lit("")))
    return rows.groupBy("plan_id", "step_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dep_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def ledger(tasks: DataFrame, thread: str) -> DataFrame:
    """Per thread: pending and done tasks, and what a watcher shows."""
    rows = tasks.groupBy(thread).agg(F.sum((F.col("status") == "pending").cast("int")).alias("pending"), F.sum((F.col("status") == "done").cast("int")).alias("done"))
    return rows.withColumn("state", F.when(F.col("pending") > 0, "running").when(F.col("done") > 0, "ready").otherwise("idle"))


def batches(tasks: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """Where each batch of a thread completes: the events at which its count of open tasks returns to zero. ``kind`` is 'submit' or 'finish'."""
    w = Window.partitionBy(thread).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "submit", 1).otherwise(-1)
    open_ = tasks.withColumn("open", F.sum(step).over(w))
    done = open_.filter("open = 0 and kind = 'finish'")
    return done.withColumn("batch", F.row_number().over(Window.partitionBy(thread).orderBy(*order))).select(thread, *order, "batch")


def drained(results: DataFrame, consumed: DataFrame) -> DataFrame:
    """Results not handed out yet."""
    return results.join(consumed.select("task_id").distinct(), "task_id", "left_anti")


def worst(checks: DataFrame, by: str) -> DataFrame:
    """The most severe state of each group."""
    rank = F.when(F.col("state") == "error", 3).when(F.col("state") == "warning", 2).when(F.col("state") == "unknown", 1).otherwise(0)
    return checks.groupBy(by).agg(F.max_by("state", rank).alias("state"))


def plan_tables(spark: SparkSession, plans: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Step and dependency tables of plans given as (plan_id, step_id, title, status, task_id, depends_on)."""
    rows = spark.createDataFrame(plans, "plan_id string, step_id string, title string, status string, task_id string, depends_on array<string>")
    return rows.drop("depends_on"), rows.select("plan_id", "step_id", F.explode("depends_on").alias("dep_id"))


def snapshot(steps: DataFrame) -> DataFrame:
    """(plan_id, snapshot): each plan's goal and its steps in order, of ``steps(plan_id, goal, n, step_id, title, assignee, status, digest)``."""
    line = render.step_line(F.col("status"), F.col("step_id"), F.col("title"), F.col("assignee"), F.col("digest"))
    rows = steps.groupBy("plan_id").agg(F.first("goal").alias("goal"), F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return rows.select("plan_id", F.concat(F.lit("plan: "), F.coalesce("goal", F.lit("")), F.lit("\n\n"), F.array_join("lines", "\n")).alias("snapshot"))


def effects(calls: DataFrame, by: str, order: str) -> DataFrame:
    """(by, files, runs) of tool calls ``(by, order, tool, filename)``: the files written, each once in the order first written, and how often code ran.
    Files are reduced to one row each before they are listed."""
    files = calls.filter("tool = 'write_file'").groupBy(by, F.coalesce("filename", F.lit("?")).alias("filename")).agg(F.min(order).alias("at"))
    listed = files.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "filename"))), lambda x: x["filename"]), ", ").alias("files"))
    runs = calls.filter("tool = 'execute_python'").groupBy(by).agg(F.count("*").alias("runs"))
    return listed.join(runs, by, "full_outer").select(by, F.coalesce("files", F.lit("")).alias("files"), F.coalesce("runs", F.lit(0)).alias("runs"))


def next_queued(items: DataFrame, by: str, order: str) -> DataFrame:
    """(by, next): the index, from 0, of each list's first item that is queued; -1 where none is."""
    ranked = items.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    return ranked.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("state") == "queued", F.col("i"))), F.lit(-1)).alias("next"))
