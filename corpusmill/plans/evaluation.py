"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import evaluation
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_M = evaluation.METRICS
_ONCE = "SELECT sample_id, arg_max(run_id, arrived_at) AS run_id, arg_max(question_id, arrived_at) AS question_id, " + ", ".join(f"arg_max({m}, arrived_at) AS {m}" for m in _M) + " FROM eval_samples GROUP BY sample_id"
_CLEAN = "SELECT sample_id, run_id, question_id, " + ", ".join(f"CASE WHEN isnan({m}) THEN NULL ELSE {m} END AS {m}" for m in _M) + " FROM o"
_LACKS = " OR ".join(f"{m} IS NULL" for m in _M)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.once(table(spark, sf_dir, "eval_samples"))


@query(
    "eval_summary",
    sql=f"WITH o AS ({_ONCE.replace('arg_max', 'arg_max_null')}), c AS ({_CLEAN}) SELECT run_id, count(*) AS questions, "
    + ", ".join(f"round(avg({m}), 4) AS {m}, count({m}) AS n_{m}" for m in _M)
    + f", count(CASE WHEN {_LACKS} THEN 1 END) AS incomplete FROM c GROUP BY run_id",
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(samples(spark, sf_dir))


@query("eval_incomplete", sql=f"WITH o AS ({_ONCE.replace('arg_max', 'arg_max_null')}), c AS ({_CLEAN}) SELECT run_id, sample_id, question_id FROM c WHERE {_LACKS}")
def eval_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.incomplete(samples(spark, sf_dir))


@query(
    "eval_metrics",
    sql=f"WITH o AS ({_ONCE.replace('arg_max', 'arg_max_null')}), c AS ({_CLEAN}) "
    + " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, round(avg({m}), 4) AS mean, count({m}) AS n FROM c GROUP BY run_id" for m in _M),
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.long(samples(spark, sf_dir))


@query(
    "eval_compare",
    sql=f"WITH o AS ({_ONCE.replace('arg_max', 'arg_max_null')}), c AS ({_CLEAN}) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg(CASE WHEN run_id = 'run_v1_a' THEN {m} END), 4) AS run_v1_a, round(avg(CASE WHEN run_id = 'run_v2_a' THEN {m} END), 4) AS run_v2_a FROM c" for m in _M),
)
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs side by side."""
    return evaluation.compare(samples(spark, sf_dir), ["run_v1_a", "run_v2_a"])


@query("eval_contexts", sql="SELECT DISTINCT sample_id, contexts_count, len(retrieved_contexts) AS n_contexts, CAST(list_sum(list_transform(retrieved_contexts, lambda x: length(x))) AS BIGINT) AS context_chars FROM eval_samples")
def eval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sample retrieved: how many contexts, how many characters."""
    chars = F.when(F.size("retrieved_contexts") > 0, F.aggregate("retrieved_contexts", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0))))
    return table(spark, sf_dir, "eval_samples").select("sample_id", "contexts_count", F.when(F.col("retrieved_contexts").isNotNull(), F.size("retrieved_contexts")).alias("n_contexts"), chars.alias("context_chars")).distinct()


_ANSWER = f"regexp_replace(regexp_replace(regexp_replace(response, '{T.ENDS}', '', 'g'), '^```(?:json)?[ \\t]*\\n?', ''), '\\n?```$', '')"


@query(
    "answer_extract",
    sql=f"""WITH s AS (SELECT DISTINCT sample_id, response, {_ANSWER} AS bare FROM eval_samples WHERE response IS NOT NULL),
    j AS (SELECT *, CASE WHEN json_valid(bare) AND json_type(bare) = 'OBJECT' THEN coalesce(nullif(json_extract_string(bare, '$.conclusion'), ''), nullif(json_extract_string(bare, '$.answer'), '')) END AS given FROM s)
    SELECT sample_id, left(coalesce(given, regexp_replace(regexp_replace(response, '[\\s\\p{{Z}}]+', ' ', 'g'), '{T.ENDS}', '', 'g')), 100) AS conclusion FROM j""",
)
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conclusion in each response: its JSON's, else its text."""
    s = table(spark, sf_dir, "eval_samples").filter("response is not null").select("sample_id", "response").distinct()
    return s.select("sample_id", T.answer(F.col("response"))["conclusion"].alias("conclusion"))


@query("test_set_problems", sql="SELECT question_id, question_type, CASE WHEN coalesce(trim(question), '') = '' THEN 'no question' WHEN coalesce(trim(ground_truth), '') = '' THEN 'no answer' END AS problem FROM test_set")
def test_set_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import test_set

    return test_set(table(spark, sf_dir, "test_set")).select("question_id", "question_type", "problem")
