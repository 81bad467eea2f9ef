"""Plan and task queries. Orders are plans, their lines are steps: each line waits for the one before; a returned line failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import tasks
from ..session import spread, stage_table
from ..streaming import jobs
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_STEPS = "SELECT CAST(l_orderkey AS VARCHAR) AS plan_id, 's' || l_linenumber AS step_id, max(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE 'pending' END) AS status, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber"
_DEPS = "SELECT plan_id, step_id, 's' || (n - 1) AS dep_id FROM s WHERE n > 1"


def plan_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("pending")
    steps = stage_table(spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")).groupBy(F.col("l_orderkey").cast("string").alias("plan_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step_id")).agg(F.max(status).alias("status"), F.max("l_linenumber").alias("n")))
    deps = steps.filter("n > 1").select("plan_id", "step_id", F.concat(F.lit("s"), (F.col("n") - 1).cast("string")).alias("dep_id"))
    return steps, deps


@query(
    "plan_ready",
    sql=f"""WITH s AS ({_STEPS}), d AS ({_DEPS}), m AS (SELECT d.plan_id, d.step_id, bool_and(coalesce(p.status = 'done', FALSE)) AS met FROM d LEFT JOIN s p ON p.plan_id = d.plan_id AND p.step_id = d.dep_id GROUP BY d.plan_id, d.step_id)
    SELECT s.plan_id, s.step_id FROM s LEFT JOIN m USING (plan_id, step_id) WHERE s.status = 'pending' AND coalesce(met, TRUE) QUALIFY row_number() OVER (PARTITION BY s.plan_id ORDER BY s.step_id) <= 3""",
)
def plan_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.ready(*plan_tables(spark, sf_dir))


@query(
    "plan_cascade",
    sql=f"""WITH RECURSIVE s AS ({_STEPS}), d AS ({_DEPS}), r AS (SELECT plan_id, step_id FROM s WHERE status = 'failed'
      UNION SELECT d.plan_id, d.step_id FROM r JOIN d ON d.plan_id = r.plan_id AND d.dep_id = r.step_id JOIN s ON s.plan_id = d.plan_id AND s.step_id = d.step_id AND s.status = 'pending')
    SELECT r.plan_id, r.step_id FROM r JOIN s USING (plan_id, step_id) WHERE s.status = 'pending'""",
)
def plan_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.cascade(*plan_tables(spark, sf_dir))


_DRAFT = """SELECT CAST(l_orderkey AS VARCHAR) AS plan_id, l_linenumber AS n, CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'step ' || l_linenumber WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 's' || (l_linenumber - 1) ELSE 's' || l_linenumber END AS step_id,
    CASE WHEN l_quantity > 45 THEN 's99' WHEN l_tax = 0 THEN 's' || (l_linenumber + 1) WHEN l_linenumber > 1 THEN 's' || (l_linenumber - 1) END AS dep_id FROM lineitem"""


@query(
    "plan_problems",
    sql=f"""WITH s AS ({_DRAFT}), d AS (SELECT * FROM s WHERE dep_id IS NOT NULL)
    SELECT plan_id, step_id, 'id' AS problem FROM s WHERE NOT regexp_full_match(step_id, 's[0-9]+') UNION SELECT plan_id, step_id, 'repeated' FROM s GROUP BY plan_id, step_id HAVING count(*) > 1
    UNION SELECT d.plan_id, d.step_id, 'missing' FROM d ANTI JOIN s ON s.plan_id = d.plan_id AND s.step_id = d.dep_id
    UNION SELECT plan_id, step_id, 'order' FROM d WHERE CAST(substr(dep_id, 2) AS INT) >= TRY_CAST(substr(step_id, 2) AS INT)""",
)
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with malformed and repeated ids, and dependencies that are missing or not smaller."""
    n, text = F.col("l_linenumber"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    step = F.when(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz"), F.concat(F.lit("step "), n.cast("string"))).when((F.col("l_returnflag") == "R") & (n > 1), text(n - 1)).otherwise(text(n))
    dep = F.when(F.col("l_quantity") > 45, "s99").when(F.col("l_tax") == 0, text(n + 1)).when(n > 1, text(n - 1))
    drafts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("plan_id"), step.alias("step_id"), dep.alias("dep_id"))
    return tasks.invalid(drafts.select("plan_id", "step_id"), drafts.filter("dep_id is not null"))


@query("plan_finished", sql=f"WITH s AS ({_STEPS}) SELECT plan_id, bool_and(status IN ('done', 'failed', 'skipped')) AS finished, count(CASE WHEN status IN ('done', 'failed', 'skipped') THEN 1 END) AS ended, count(*) AS steps FROM s GROUP BY plan_id")
def plan_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.finished(plan_tables(spark, sf_dir)[0])


@query(
    "plan_results",
    sql=f"""WITH s AS ({_STEPS}), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS plan_id, o_orderstatus <> 'F' AS ok, o_orderpriority AS digest FROM orders)
    SELECT s.plan_id, s.step_id, CASE WHEN o.ok THEN 'done' WHEN NOT o.ok THEN 'failed' ELSE s.status END AS status, o.digest FROM s LEFT JOIN o ON o.plan_id = s.plan_id AND s.step_id = 's1'""",
)
def plan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps marked with the outcome of their task; an order's status is that of its first line's task."""
    steps, _ = plan_tables(spark, sf_dir)
    results = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("/s1")).alias("task_id"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_orderpriority").alias("conclusion"))
    named = steps.withColumn("task_id", F.concat("plan_id", F.lit("/"), "step_id"))
    return tasks.marked(named, results).select("plan_id", "step_id", "status", "digest")


@query(
    "plan_context",
    sql=f"""WITH s AS ({_STEPS}), d AS ({_DEPS}) SELECT d.plan_id, d.step_id, string_agg(d.dep_id || ' ' || coalesce(p.status, '') || ': ' || coalesce(p.status, ''), chr(10) ORDER BY d.dep_id) AS context
    FROM d JOIN s p ON p.plan_id = d.plan_id AND p.step_id = d.dep_id GROUP BY d.plan_id, d.step_id""",
)
def plan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step is told of those before it."""
    steps, deps = plan_tables(spark, sf_dir)
    return tasks.digests(deps, steps.withColumns({"title": F.col("status"), "digest": F.col("status")}))


_KIND = "CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'submit' ELSE 'finish' END"


@query(
    "task_status",
    sql="""WITH t AS (SELECT user_id AS thread, CASE event_type WHEN 'error' THEN 'pending' WHEN 'purchase' THEN 'done' ELSE 'other' END AS status FROM events),
    a AS (SELECT thread, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'done' THEN 1 END) AS done FROM t GROUP BY thread)
    SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN done > 0 THEN 'ready' ELSE 'idle' END AS state FROM a""",
)
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and done tasks per thread, and what a watcher shows."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type") == "purchase", "done").otherwise("other")
    return tasks.ledger(e.select(F.col("user_id").alias("thread"), status.alias("status")), "thread")


@query("deletable_threads", sql="SELECT user_id AS thread FROM events GROUP BY user_id HAVING count(CASE WHEN event_type = 'error' THEN 1 END) = 0")
def deletable_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import sessions

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"))
    return sessions.deletable(e, "thread")


@query(
    "batch_complete",
    sql=f"""WITH t AS (SELECT user_id AS thread, event_id AS n, {_KIND} AS kind FROM events),
    o AS (SELECT *, sum(CASE kind WHEN 'submit' THEN 1 ELSE -1 END) OVER (PARTITION BY thread ORDER BY n) AS open FROM t)
    SELECT thread, n, row_number() OVER (PARTITION BY thread ORDER BY n) AS batch FROM o WHERE open = 0 AND kind = 'finish'""",
)
def batch_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a thread's open tasks return to zero."""
    kind = F.when(F.col("event_type").isin("signup", "click", "view"), "submit").otherwise("finish")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("n"), kind.alias("kind"))
    return tasks.batches(e, "thread", ["n"])


@query("drained", sql="SELECT event_id AS task_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as results; those of users who signed up are handed out already."""
    e = table(spark, sf_dir, "events")
    used = e.filter("event_type = 'purchase'").join(e.filter("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_semi").select(F.col("event_id").alias("task_id"))
    return tasks.drained(e.filter("event_type = 'purchase'").select(F.col("event_id").alias("task_id")), used)


@query(
    "worst_state",
    sql="""SELECT s_nationkey, CASE max(CASE WHEN s_acctbal < 0 THEN 3 WHEN s_acctbal < 1000 THEN 2 WHEN s_acctbal < 2000 THEN 1 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' WHEN 1 THEN 'unknown' ELSE 'ok' END AS state FROM supplier GROUP BY s_nationkey""",
)
def worst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    checks = table(spark, sf_dir, "supplier").withColumn("state", F.when(b < 0, "error").when(b < 1000, "warning").when(b < 2000, "unknown").otherwise("ok"))
    return tasks.worst(checks, "s_nationkey")


_FRAMES = """WITH q AS (SELECT question_id AS stream, question, coalesce(question_type, '') AS kind FROM test_set)
    SELECT stream, 0 AS k, 'token' AS type, question AS value, FALSE AS bad FROM q UNION ALL SELECT stream, 1, 'unknown', NULL, TRUE FROM q
    UNION ALL SELECT stream, 2, 'route', kind, FALSE FROM q UNION ALL SELECT stream, 3, 'unknown', length(question)::VARCHAR, FALSE FROM q"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test question as a stream of four frames with data, a heartbeat and an unfinished frame, in pieces of eleven characters."""
    as_json = lambda name, c: F.to_json(F.struct(c.alias(name)))
    question, kind = F.col("question"), F.coalesce("question_type", F.lit(""))
    two = F.concat(F.lit("data: {\r\ndata:"), F.substring(as_json("token", question), 2, 1_000_000), F.lit("\r\n\r\n: ping\r\n\r\n"))
    rest = F.concat(F.lit('data: {"token": "br\n\nevent: x\r\ndata: '), as_json("route", kind), F.lit("\r\n\r\ndata: "), as_json("other", F.length(question)), F.lit('\n\ndata: {"token": "never ends"}'))
    text = table(spark, sf_dir, "test_set").select(F.col("question_id").alias("stream"), F.concat(two, rest).alias("t"))
    return text.select("stream", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 11).cast("int"))).alias("n"), "t").select("stream", "n", F.substring(F.col("t"), F.col("n") * 11 + 1, F.lit(11)).alias("text"))


@query("event_frames", sql=_FRAMES)
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut anywhere, with data on two lines, both kinds of line ends, heartbeats, broken JSON and an unfinished end."""
    return jobs.frames(_pieces(spark, sf_dir))


_SNAPSHOT = "CASE l_returnflag WHEN 'R' THEN '✗' WHEN 'A' THEN '☑' ELSE '☐' END"


@query(
    "plan_snapshots",
    sql=f"""WITH l AS (SELECT l_orderkey, l_linenumber, o_orderpriority, '- ' || {_SNAPSHOT} || ' s' || l_linenumber || ' ' || l_linestatus || ' (' || l_suppkey || ')' || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' — tax ' || l_returnflag END AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS plan_id, 'plan: ' || any_value(o_orderpriority) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS snapshot FROM l GROUP BY l_orderkey""",
)
def plan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a plan's snapshot text."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("pending")
    digest = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("tax\n"), "l_returnflag"))
    return tasks.snapshot(li.select(F.col("l_orderkey").cast("string").alias("plan_id"), F.col("o_orderpriority").alias("goal"), F.col("l_linenumber").alias("n"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step_id"), F.col("l_linestatus").alias("title"), F.col("l_suppkey").cast("string").alias("assignee"), status.alias("status"), digest.alias("digest")))


@query(
    "side_effects",
    sql="""WITH c AS (SELECT user_id AS thread, event_id, event_type, json_extract_string(props, '$.k') AS f FROM events), w AS (SELECT thread, f, min(event_id) AS first_id FROM c WHERE event_type = 'purchase' GROUP BY thread, f),
    x AS (SELECT thread, string_agg(f, ', ' ORDER BY first_id) AS files FROM w GROUP BY thread), r AS (SELECT thread, count(*) AS runs FROM c WHERE event_type = 'click' GROUP BY thread)
    SELECT thread, coalesce(files, '') AS files, coalesce(runs, 0) AS runs FROM x FULL JOIN r USING (thread)""",
)
def side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written (purchases) and code runs (clicks) per thread."""
    tool = F.when(F.col("event_type") == "purchase", "write_file").when(F.col("event_type") == "click", "execute_python")
    return tasks.effects(table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "event_id", tool.alias("tool"), F.get_json_object("props", "$.k").alias("filename")), "thread", "event_id")


@query(
    "next_queued",
    sql="""WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_custkey, CAST(coalesce(min(CASE WHEN o_orderstatus = 'O' THEN i END), -1) AS INT) AS next FROM o GROUP BY o_custkey""",
)
def next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as queued uploads of each customer's list."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"))
    return tasks.next_queued(rows, "o_custkey", "o_orderkey")


@query(
    "after_thread_delete",
    sql="""WITH busy AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 30), asked AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
    SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM asked) OR user_id IN (SELECT user_id FROM busy)""",
)
def after_thread_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when all threads with a sign-up are to be deleted and those with a costly error are still busy."""
    from ..operators import sessions

    e = table(spark, sf_dir, "events")
    jobs_ = e.select("user_id", F.when((F.col("event_type") == "error") & (F.col("value") > 30), "pending").otherwise("done").alias("status"))
    return sessions.without_threads(e, jobs_, e.filter("event_type = 'signup'").select("user_id"), "user_id").select("event_id")


@query("stream_batches", sql=f"""WITH t AS (SELECT user_id AS thread, event_id AS n, {_KIND} AS kind FROM events), o AS (SELECT *, sum(CASE kind WHEN 'submit' THEN 1 ELSE -1 END) OVER (PARTITION BY thread ORDER BY n) AS open FROM t)
    SELECT thread::VARCHAR AS thread, n, CAST(row_number() OVER (PARTITION BY thread ORDER BY n) AS INT) AS batch FROM o WHERE open = 0 AND kind = 'finish'""")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch completion as a stream with state, run over the events that are there."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    kind = F.when(F.col("event_type").isin("signup", "click", "view"), "submit").otherwise("finish")
    live = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").cast("string").alias("thread"), F.col("event_id").alias("n"), kind.alias("kind"))
    name = f"stream_{uuid.uuid4().hex}"
    jobs.outcome(jobs.batch_completion(live).writeStream.format("memory").queryName(name).outputMode("append").start())
    return spark.table(name)
