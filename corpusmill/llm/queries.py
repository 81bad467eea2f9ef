"""Queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..registry import Registry
from ..tables import table
from . import answers, leaks, markup, mixing, neardup, pieces, repeats, scans, unify

REGISTRY = Registry()
query = REGISTRY.query


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("text")


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").filter("text <> ''").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("key"), F.col("chunk_id"), (F.col("parent_id") != "").alias("child"), "text")
    hits = table(spark, sf_dir, "fused_children").filter("text <> ''").select(F.lit("fused_children").alias("tbl"), F.col("hit_id").alias("key"), F.col("chunk_id"), F.lit(False).alias("child"), "text")
    both = chunks.unionByName(hits)
    seen = unify.looks(both, ["tbl", "key", "chunk_id", "child"])
    own = seen.filter("tbl = 'chunks'")
    pairs = unify.class_pairs(own.filter("child").select("key", "look", "raw")).withColumn("tbl", F.lit("chunks"))
    hit, chunk = seen.filter("tbl = 'fused_children'").select("key", "chunk_id", "look", "raw").alias("h"), own.select("chunk_id", "look", "raw").distinct().alias("c")
    copies = hit.join(chunk, (F.col("h.chunk_id") == F.col("c.chunk_id")) & (F.col("h.look") == F.col("c.look")) & (F.col("h.raw") != F.col("c.raw")))
    found = copies.select(F.lit("fused_children").alias("tbl"), F.col("h.chunk_id").alias("key_a"), F.col("h.key").alias("key_b")).distinct()
    return pairs.select("tbl", "key_a", "key_b").unionByName(found)


@query("p1_unified")
def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's and hit's text in its one form, once per row key."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_key"), "text")
    hits = table(spark, sf_dir, "fused_children").select(F.lit("fused_children").alias("tbl"), F.col("hit_id").alias("row_key"), "text")
    both = chunks.unionByName(hits).dropDuplicates(["tbl", "row_key", "text"])
    return unify.unify(both, ["tbl", "row_key"])


@query(
    "p3_found",
    sql="""
    SELECT DISTINCT c.chunk_id FROM chunks c JOIN chunk_limits l
      ON l.chunk_type = c.chunk_type AND l.tier = CASE WHEN coalesce(c.parent_id, '') = '' THEN 'parent' ELSE 'child' END
    WHERE l.max_chars IS NOT NULL AND length(c.text) > l.max_chars""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks the splitter had to cut."""
    cut = pieces.split(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))
    return cut.filter("n_pieces > 1 and piece_no = 0").select("chunk_id")


@query("p3_pieces")
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("parent_id <> '' and chunk_type = 'text'").select(F.col("chunk_id").alias("id"), "text")


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = neardup.reduced(_children(spark, sf_dir))
    return neardup.record_pairs(corpus, neardup.links(corpus)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each child chunk that repeats another: its group (the group's smallest chunk_id), its document and its number of links."""
    corpus = neardup.reduced(_children(spark, sf_dir))
    found = neardup.links(corpus)
    edges = found.select(F.hex("same_a").alias("a"), F.hex("same_b").alias("b"))
    roots = neardup.components(edges)
    degree = edges.select("a").union(edges.select("b")).groupBy("a").count()
    members = corpus.rows.select("id", F.hex("same").alias("same")).distinct()
    copies = members.groupBy("same").agg((F.count("*") - 1).alias("copies"))
    own = members.join(copies, "same").join(roots, F.col("same") == F.col("node"), "left").join(degree, F.col("same") == F.col("a"), "left").filter("copies > 0 or node is not null")
    own = own.select("id", F.coalesce("root", "same").alias("root"), (F.coalesce("count", F.lit(0)) + F.col("copies")).alias("links"))
    names = own.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return own.join(names, "root").select(F.col("id").alias("chunk_id"), F.substring_index("id", ":", 1).alias("doc_id"), "group_id", "group_size", "links")


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_set")).select("doc_id", "question_id").distinct()


@query("p7_items")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked test item: in how many documents its question, its answer and both stand, and the longest run of tokens."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_set"))
    per = found.groupBy("question_id", "doc_id").agg(F.max((F.col("field") == "question").cast("int")).alias("q"), F.max((F.col("field") == "answer").cast("int")).alias("a"), F.max("run").alias("run"))
    return per.groupBy("question_id").agg(F.count("*").alias("documents"), F.sum("q").alias("with_question"), F.sum("a").alias("with_answer"), F.sum(F.col("q") * F.col("a")).alias("with_both"), F.max("run").alias("longest_run"))


@query(
    "p9_found",
    sql="""WITH r AS (SELECT doc_id, any_value(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
    w AS (SELECT doc_id, length(t) AS n, i, substr(t, i, 30) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 28)) AS i FROM r WHERE length(t) >= 30)),
    again AS (SELECT doc_id, n, i FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY i) > 1),
    c AS (SELECT doc_id, n, least(30, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 30)) AS covered FROM again)
    SELECT doc_id FROM c GROUP BY doc_id, n HAVING sum(covered) / n::DOUBLE >= 0.30""",
)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.failed(repeats.ledger(table(spark, sf_dir, "documents")), "repeated_content").select("doc_id")


@query("p9_ledger")
def p9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of repeated content, by each rule, and its failure bits."""
    return repeats.ledger(table(spark, sf_dir, "documents"))


@query("p9_policies")
def p9_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.ablations(repeats.ledger(table(spark, sf_dir, "documents")))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.defects(table(spark, sf_dir, "parsed_items"))


@query("p2_paragraphs")
def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "parsed_items"))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.judged(table(spark, sf_dir, "eval_samples"))
    return rows.filter("bits <> 0").select("sample_id", answers.type_of(F.col("bits")).alias("defect"))


@query("p5_defects")
def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered type of every defective sample."""
    rows = answers.judged(table(spark, sf_dir, "eval_samples")).filter("bits <> 0")
    each = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(t).alias("defect")) for i, t in enumerate(answers.TYPES)])
    return rows.select("sample_id", "bits", F.explode(each).alias("t")).filter("bits & t.bit <> 0").select("sample_id", "t.defect")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    rows = mixing.plan(sizes, table(spark, sf_dir, "mix_targets"))
    return mixing.uses(sizes, rows), rows


@query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a target source with its number of uses and the slot of the schedule at which each use starts."""
    return mixing.scheduled(*_mix(spark, sf_dir))[0].select("doc_id", "source", "tokens", "uses", "slots")


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, rows = _mix(spark, sf_dir)
    return mixing.shares(used, rows)


@query("p8_schedule")
def p8_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, rows = _mix(spark, sf_dir)
    return mixing.interleave(used, rows)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "parsed_items").select(F.lit("parsed_items").alias("tbl"), F.concat_ws(":", "doc_id", F.col("pos").cast("string")).alias("row_key"), "text", F.col("type").alias("kind"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_key"), "text", F.col("chunk_type").alias("kind"))
    return items.unionByName(chunks)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(_marked(spark, sf_dir)).select("tbl", "row_key").distinct()


@query("p4_clean")
def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's clean text, once a row."""
    return markup.cleaned(_marked(spark, sf_dir), all_rows=True).dropDuplicates(["tbl", "row_key"])
