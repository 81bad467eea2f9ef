"""Views over event and message logs: sessions, usage, history, memories. A log is ``(thread, id, ts, role, text)`` or the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .corpus import upsert
from .retrieval import dense

BUDGET, REMIND = 16_000, 40


def meta(log: DataFrame, thread: str, key: str) -> DataFrame:
    """Per thread: the last checkpoint and how many there are."""
    return log.groupBy(thread).agg(F.max(key).alias("last_checkpoint"), F.count("*").alias("checkpoints"))


def recent(log: DataFrame, thread: str, key: str, limit: int = 50) -> DataFrame:
    """The threads touched last; ties by thread."""
    return meta(log, thread, key).orderBy(F.col("last_checkpoint").desc(), F.col(thread)).limit(limit)


def ids(log: DataFrame, thread: str, prefix: str | None = None) -> DataFrame:
    rows = log.select(thread).distinct()
    return rows.filter(F.col(thread).startswith(prefix)) if prefix else rows


def usage(log: DataFrame, by: str, input_: Column, output: Column, cached: list[Column]) -> DataFrame:
    """Calls and totals; a row without usage counts no call. The first cache field that has a value counts."""
    zero = F.lit(0)
    return log.groupBy(by).agg(F.count(F.coalesce(input_, output)).alias("calls"), F.sum(F.coalesce(input_, zero)).alias("input"), F.sum(F.coalesce(output, zero)).alias("output"), F.sum(F.coalesce(*cached, zero)).alias("cached"))


def growth(log: DataFrame, by: str, order: list[str], total: str) -> DataFrame:
    """What each row adds to a running counter, never below zero (a counter may restart)."""
    before = F.lag(total, 1, 0).over(Window.partitionBy(by).orderBy(*order))
    return log.withColumn("added", F.greatest(F.lit(0), F.col(total) - before))


def history(log: DataFrame, synthetic: list[str]) -> DataFrame:
    """What a reader sees: no tool rows, no empty assistant rows, no user rows made by the system."""
    made = F.lit(False)
    for p in synthetic:
        made = made | F.col("text").startswith(p)
    hidden = (F.col("role") == "tool") | (F.col("role") == "assistant") & (F.coalesce(T.strip(F.col("text")), F.lit("")) == "") | (F.col("role") == "user") & F.coalesce(made, F.lit(False))
    return log.filter(~hidden)


def titles(log: DataFrame, thread: str, key: str) -> DataFrame:
    """A thread's first user text as its title."""
    return log.filter("role = 'user'").groupBy(thread).agg(T.title(F.min_by("text", key)).alias("title"))


def last_user_text(log: DataFrame, thread: str, key: str, synthetic: list[str] = ()) -> DataFrame:
    rows = log.filter("role = 'user'")
    for p in synthetic:
        rows = rows.filter(~F.col("text").startswith(p))
    return rows.groupBy(thread).agg(F.max_by("text", key).alias("last_text"))


def merged_threads(server: DataFrame, local: DataFrame, thread: str) -> DataFrame:
    """Server threads with local titles; threads known only locally come first."""
    s, m = server.alias("s"), local.alias("l")
    rows = s.join(m, thread, "full_outer")
    return rows.select(thread, "title", "last_checkpoint", F.col("last_checkpoint").isNull().alias("local_only")).orderBy(F.col("local_only").desc(), F.col("last_checkpoint").desc(), thread)


def newest(memories: DataFrame, limit: int = 100) -> DataFrame:
    """The newest memories, ordered before they are limited; those without a time last."""
    return memories.orderBy(F.col("created_at").desc_nulls_last(), "key").limit(limit)


def matching(memories: DataFrame, keyword: str) -> DataFrame:
    """Memories that hold a keyword, case aside; a blank keyword matches all."""
    word = keyword.strip().lower()
    return memories.filter(F.contains(F.lower("content"), F.lit(word))) if word else memories


def put(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Memories with the new ones in place of those of the same key."""
    return upsert(memories, new, "key")


def forget(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Memories without those of the given keys; a key that is not there changes nothing."""
    return memories.join(keys.select("key").distinct(), "key", "left_anti")


def remembered(memories: DataFrame, queries: DataFrame, top_k: int | None = 5) -> DataFrame:
    """(query_id, rank, key, content, source, created_at): for each query the nearest of ``memories(key, content, source, created_at, embedding)`` by
    vector alone, however far; ``top_k`` is brought between 1 and 10. A memory without a source is an explicit one."""
    near = dense(memories.select(F.col("key").alias("vec_id"), "embedding"), queries.select("query_id", "embedding"), T.clamp_k(top_k))
    told = memories.select("key", "content", F.coalesce("source", F.lit("explicit")).alias("source"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"))
    return near.select("query_id", "rank", F.col("vec_id").alias("key")).join(told, "key").select("query_id", "rank", "key", "content", "source", "created_at")


def over_budget(log: DataFrame, thread: str, order: list[str], most: int = BUDGET) -> DataFrame:
    """Where a thread's text, summed in order, first passes the budget."""
    w = Window.partitionBy(thread).orderBy(*order)
    run = log.withColumn("total", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("total") > most)
    return run.groupBy(thread).agg(F.min_by(F.struct(*order, "total"), F.struct(*order)).alias("at")).select(thread, "at.*")


def after_reset(log: DataFrame, thread: str, order: list[str], reset: Column) -> DataFrame:
    """Append or reset: the rows after a thread's last reset."""
    last = log.filter(reset).groupBy(thread).agg(F.max(F.struct(*order)).alias("reset_at"))
    rows = log.filter(~F.coalesce(reset, F.lit(False))).join(last, thread, "left")
    return rows.filter(F.col("reset_at").isNull() | (F.struct(*order) > F.col("reset_at"))).drop("reset_at")


def deletable(tasks: DataFrame, thread: str) -> DataFrame:
    """Threads without a pending task, which alone may be deleted."""
    return tasks.groupBy(thread).agg(F.sum((F.col("status") == "pending").cast("int")).alias("pending")).filter("pending = 0").select(thread)


def without_threads(rows: DataFrame, tasks: DataFrame, asked: DataFrame, thread: str) -> DataFrame:
    """Rows without those of the threads asked for, except threads that still have a pending task: these are refused and keep all."""
    busy = tasks.filter("status = 'pending'").select(thread).distinct()
    gone = asked.select(thread).distinct().join(busy, thread, "left_anti")
    return rows.join(gone, thread, "left_anti")
