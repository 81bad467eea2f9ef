"""Session, usage and memory queries over the events and documents tables. An event is a message: its user is the thread, its type the role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, times
from ..operators import sessions
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_LOG = """SELECT user_id AS thread, event_id AS id, CASE event_type WHEN 'view' THEN 'tool' WHEN 'error' THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN event_type = 'error' AND value < 10 THEN ' ' WHEN event_type = 'signup' THEN '[system] ' || props ELSE event_type || ' ' || props END AS text, value, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "error", "assistant").otherwise("user")
    text = F.when((F.col("event_type") == "error") & (F.col("value") < 10), " ").when(F.col("event_type") == "signup", F.concat(F.lit("[system] "), F.col("props"))).otherwise(F.concat("event_type", F.lit(" "), "props"))
    return e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), role.alias("role"), text.alias("text"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("session_meta", sql="SELECT user_id, max(event_id) AS last_checkpoint, count(*) AS checkpoints FROM events GROUP BY user_id")
def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.meta(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("recent_sessions", sql="SELECT user_id, max(event_id) AS last_checkpoint, count(*) AS checkpoints FROM events GROUP BY user_id ORDER BY last_checkpoint DESC, user_id LIMIT 50")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("session_ids", sql="SELECT DISTINCT 'sess-' || user_id AS thread FROM events")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").select(F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("thread"))
    return sessions.ids(named, "thread", "sess-")


_USAGE = "CASE WHEN role = 'assistant' THEN NULL ELSE k END"


@query(
    "usage_totals",
    sql=f"""WITH l AS ({_LOG}) SELECT thread, count(coalesce({_USAGE}, CASE WHEN role = 'tool' THEN k * 2 END)) AS calls, CAST(sum(coalesce({_USAGE}, 0)) AS BIGINT) AS input, CAST(sum(coalesce(CASE WHEN role = 'tool' THEN k * 2 END, 0)) AS BIGINT) AS output,
    CAST(sum(coalesce(CASE WHEN role = 'user' THEN k % 7 END, CASE WHEN role = 'tool' THEN 1 END, 0)) AS BIGINT) AS cached FROM l GROUP BY thread""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-like totals: a row of the assistant has no usage."""
    k, tool, user = F.col("k"), F.col("role") == "tool", F.col("role") == "user"
    return sessions.usage(log(spark, sf_dir), "thread", F.when(F.col("role") != "assistant", k), F.when(tool, k * 2), [F.when(user, k % 7), F.when(tool, F.lit(1))])


@query("usage_growth", sql=f"WITH l AS ({_LOG}) SELECT thread, id, greatest(0, k - lag(k, 1, 0) OVER (PARTITION BY thread ORDER BY id)) AS added FROM l")
def usage_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.growth(log(spark, sf_dir), "thread", ["id"], "k").select("thread", "id", "added")


@query("history_view", sql=f"WITH l AS ({_LOG}) SELECT thread, id, role, text FROM l WHERE NOT (role = 'tool' OR role = 'assistant' AND trim(text) = '' OR role = 'user' AND starts_with(text, '[system]'))")
def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history(log(spark, sf_dir), ["[system]"]).select("thread", "id", "role", "text")


@query("thread_titles", sql=f"WITH l AS ({_LOG}) SELECT thread, left(trim(arg_min(text, id)), 20) AS title FROM l WHERE role = 'user' GROUP BY thread")
def thread_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.titles(log(spark, sf_dir), "thread", "id")


@query("last_user_text", sql=f"WITH l AS ({_LOG}) SELECT thread, arg_max(text, id) AS last_text FROM l WHERE role = 'user' AND NOT starts_with(text, '[system]') GROUP BY thread")
def last_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_user_text(log(spark, sf_dir), "thread", "id", ["[system]"])


@query(
    "merged_threads",
    sql="""WITH s AS (SELECT user_id AS thread, max(event_id) AS last_checkpoint FROM events GROUP BY user_id), l AS (SELECT c_custkey AS thread, c_name AS title FROM customer)
    SELECT thread, title, last_checkpoint, last_checkpoint IS NULL AS local_only FROM s FULL JOIN l USING (thread)""",
)
def merged_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = sessions.meta(table(spark, sf_dir, "events").withColumnRenamed("user_id", "thread"), "thread", "event_id").drop("checkpoints")
    return sessions.merged_threads(server, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_name").alias("title")), "thread")


@query("memory_list", sql="SELECT doc_id AS key FROM documents ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 100")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest notes: ordered, then limited."""
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("published_at").alias("created_at"))
    return sessions.newest(notes).select("key")


@query("memory_filter", sql="SELECT doc_id AS key FROM documents WHERE contains(lower(text), 'gross margin')")
def memory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return sessions.matching(notes, " Gross margin ").select("key")


@query(
    "context_budget",
    sql="""WITH r AS (SELECT ticker, doc_id, sum(length(text)) OVER (PARTITION BY ticker ORDER BY doc_id) AS total FROM documents WHERE ticker IS NOT NULL)
    SELECT ticker, doc_id, CAST(total AS BIGINT) AS total FROM r WHERE total > 16000 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY doc_id) = 1""",
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each ticker's documents, read in order, pass the context budget."""
    d = table(spark, sf_dir, "documents").filter("ticker is not null").select("ticker", "doc_id", "text")
    return sessions.over_budget(d, "ticker", ["doc_id"])


@query("reminders", sql="SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 40")
def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads long enough to be summarised."""
    return sessions.meta(table(spark, sf_dir, "events"), "user_id", "event_id").filter(F.col("checkpoints") >= sessions.REMIND).select("user_id")


@query(
    "after_reset",
    sql=f"""WITH l AS ({_LOG}), x AS (SELECT thread, max(id) AS reset_id FROM l WHERE role = 'assistant' AND trim(text) = '' GROUP BY thread)
    SELECT l.thread, l.id FROM l LEFT JOIN x USING (thread) WHERE NOT (role = 'assistant' AND trim(text) = '') AND (reset_id IS NULL OR l.id > reset_id)""",
)
def after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows since each thread's last reset (an empty assistant row)."""
    reset = (F.col("role") == "assistant") & (F.trim("text") == "")
    return sessions.after_reset(log(spark, sf_dir), "thread", ["id"], reset).select("thread", "id")


@query(
    "relative_times",
    sql="""WITH e AS (SELECT event_id, ts, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 604800 THEN (s // 86400) || ' d ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago,
    strftime(ts, '%Y-%m-%d %H:%M:%S %A') AS stamp FROM e""",
)
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before 1 February 2024 each event was."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.ago(ts, F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("ago"), times.stamp(ts).alias("stamp"))


@query("iso_millis", sql="SELECT DISTINCT chunk_id, coalesce(epoch_ms(TRY_CAST(created_at AS TIMESTAMPTZ)), 0) AS ms FROM chunks")
def iso_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", times.millis(F.col("created_at")).alias("ms")).distinct()


@query(
    "sizes_shown",
    sql="""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 102.4e0) / 10) || ' KB' ELSE printf('%.1f', floor(b / 104857.6e0) / 10) || ' MB' END AS shown, left(o_orderkey::VARCHAR, 8) AS short_id
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 11 AS b FROM orders)""",
)
def sizes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.file_size(F.floor("o_totalprice") * 11).alias("shown"), T.short_id(F.col("o_orderkey").cast("string")).alias("short_id"))


@query(
    "memory_search",
    sql="""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS key, list_dot_product(embedding::DOUBLE[], qe) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM s QUALIFY rank <= 10)
    SELECT query_id, rank, key, left(text, 40) AS content, coalesce(source, 'explicit') AS source FROM r JOIN documents ON doc_id = key""",
)
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories under their vectors; twelve are asked for and ten given."""
    v = table(spark, sf_dir, "embeddings")
    notes = v.join(table(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"))
    memories = notes.select(F.col("vec_id").alias("key"), F.left("text", F.lit(40)).alias("content"), "source", F.col("published_at").alias("created_at"), "embedding")
    # vectors without a document take part in the search, as memories without content do, and are not shown
    every = v.select(F.col("vec_id").alias("key"), "embedding").join(memories.drop("embedding"), "key", "left")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    shown = memories.select("key")
    return sessions.remembered(every, asked, 12).join(shown, "key", "left_semi").select("query_id", "rank", "key", "content", "source")


@query(
    "memory_changes",
    sql="""WITH m AS (SELECT doc_id AS key, coalesce(source, 'explicit') AS source FROM documents WHERE lang = 'en' OR lang IS NULL), n AS (SELECT doc_id AS key, 'confirmed' AS source FROM documents WHERE n_chars > 1000),
    p AS (SELECT * FROM m WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n) SELECT * FROM p WHERE key NOT IN (SELECT doc_id FROM documents WHERE ticker IS NULL)""",
)
def memory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English notes as memories; long notes are put, with new keys and known ones, then those without a ticker forgotten, whether there or not."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang = 'en' or lang is null").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("explicit")).alias("source"))
    new = d.filter("n_chars > 1000").select(F.col("doc_id").alias("key"), F.lit("confirmed").alias("source"))
    return sessions.forget(sessions.put(old, new), d.filter("ticker is null").select(F.col("doc_id").alias("key")))
