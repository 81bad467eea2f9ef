"""Corpus maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import corpus, pipeline, retrieval
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_ONCE = "SELECT chunk_id, min(text) AS text, min(parent_id) AS parent_id, min(doc_id) AS doc_id, min(source) AS source, min(page_no) AS page_no, min(heading_path) AS heading_path, min(chunk_type) AS chunk_type, max(created_at) AS created_at, min(image_path) AS image_path FROM chunks GROUP BY chunk_id"


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, as delivered last."""
    cols = ("text", "parent_id", "doc_id", "source", "page_no", "heading_path", "chunk_type", "image_path")
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in cols], F.max("created_at").alias("created_at"))


@query("content_address", sql="SELECT doc_id, left(sha256(text), 16) AS content_id FROM documents WHERE text IS NOT NULL")
def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", corpus.address("text").alias("content_id"))


@query(
    "upload_outcomes",
    sql="""WITH k AS (SELECT DISTINCT left(sha256(text), 16) AS content_id FROM documents WHERE source = 'announcement' AND text IS NOT NULL)
    SELECT d.doc_id AS name, left(sha256(d.text), 16) AS content_id, strlen(d.text) AS bytes, CASE WHEN strlen(d.text) > 20971520 THEN 'too large' WHEN k.content_id IS NOT NULL THEN 'exists' ELSE 'created' END AS outcome
    FROM documents d LEFT JOIN k ON k.content_id = left(sha256(d.text), 16) WHERE d.text IS NOT NULL""",
)
def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an upload, with the announcements already in the corpus."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    known = d.filter("source = 'announcement'").select(corpus.address("text").alias("doc_id"))
    return corpus.uploads(d.select(F.col("doc_id").alias("name"), F.col("text").alias("content")), known).select("name", F.col("doc_id").alias("content_id"), "bytes", "outcome")


@query("list_docs", sql=f"WITH c AS ({_ONCE}) SELECT doc_id, coalesce(arg_min(source, chunk_id), '') AS source, count(*) AS chunks FROM c WHERE parent_id <> '' GROUP BY doc_id")
def list_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.listing(once(spark, sf_dir).filter("parent_id <> ''"))


@query("corpus_snapshot", sql=f"WITH c AS ({_ONCE}) SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM c WHERE parent_id <> ''")
def corpus_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.snapshot(once(spark, sf_dir).filter("parent_id <> ''"))


@query("chunks_latest", sql=f"WITH c AS ({_ONCE}) SELECT chunk_id, doc_id, created_at, length(text) AS char_len, coalesce(page_no, -1) AS stored_page FROM c")
def chunks_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated upserts of a chunk reduced to the last, its length measured, its page in the stored form."""
    rows = corpus.latest(table(spark, sf_dir, "chunks"), "chunk_id", "created_at")
    return corpus.metadata(rows).select("chunk_id", "doc_id", "created_at", F.length("text").alias("char_len"), "stored_page")


_NEWEST = "SELECT source, max(doc_id) AS doc_id FROM parsed_docs WHERE source IS NOT NULL AND status = 'stored' GROUP BY source"


@query(
    "purge_stale",
    sql=f"""WITH k AS ({_NEWEST}) SELECT DISTINCT c.source, c.doc_id FROM chunks c JOIN k ON k.source = c.source AND k.doc_id <> c.doc_id""",
)
def purge_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions replaced if each source keeps one document (the greatest id)."""
    keep = table(spark, sf_dir, "parsed_docs").filter("source is not null and status = 'stored'").groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    return corpus.stale(table(spark, sf_dir, "chunks"), keep)


@query(
    "replace_source",
    sql=f"""WITH c AS ({_ONCE}), n AS (SELECT * FROM c WHERE source = 'rolling/daily_digest.pdf' AND doc_id = (SELECT max(doc_id) FROM c WHERE source = 'rolling/daily_digest.pdf')),
    o AS (SELECT * FROM c WHERE source <> 'rolling/daily_digest.pdf' OR source IS NULL) SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id FROM o UNION ALL SELECT doc_id FROM n) GROUP BY doc_id""",
)
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the rolling digest's last document replaces its source."""
    c = once(spark, sf_dir)
    digest = c.filter("source = 'rolling/daily_digest.pdf'")
    last = digest.agg(F.max("doc_id").alias("doc_id"))
    new = digest.join(F.broadcast(last), "doc_id", "left_semi")  # one row
    return corpus.replace_source(c, new).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("delete_doc", sql="SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM parsed_docs WHERE n_pages IS NULL AND doc_id IS NOT NULL) GROUP BY doc_id")
def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays if the documents without pages are deleted."""
    gone = table(spark, sf_dir, "parsed_docs").filter("n_pages is null and doc_id is not null")
    return corpus.without_doc(table(spark, sf_dir, "chunks"), gone).groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"))


@query(
    "upsert_merge",
    sql="""WITH o AS (SELECT chunk_id, min(created_at) AS created_at FROM chunks GROUP BY chunk_id), n AS (SELECT chunk_id, max(created_at) AS created_at FROM chunks GROUP BY chunk_id HAVING count(*) > 1)
    SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (chunk_id)""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries merged with the redelivered rows."""
    c = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count("*").alias("n"))
    return corpus.upsert(c.select("chunk_id", F.col("first").alias("created_at")), c.filter("n > 1").select("chunk_id", F.col("last").alias("created_at")), "chunk_id")


@query("oversize_quarantine", sql=f"WITH c AS ({_ONCE}) SELECT chunk_id, strlen(text) AS bytes, 'text of ' || strlen(text) || ' bytes, 1500 at most' AS warning FROM c WHERE strlen(text) > 1500")
def oversize_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over a byte limit (1500 here, so that the tables have some), each with its warning."""
    return corpus.fit(once(spark, sf_dir), 1500)[1].select("chunk_id", F.octet_length("text").alias("bytes"), "warning")


@query(
    "parents_lookup",
    sql="""WITH w AS (SELECT DISTINCT parent_id FROM fused_children WHERE parent_id <> ''), p AS (SELECT chunk_id AS parent_id, min(text) AS text, min(doc_id) AS doc_id FROM chunks WHERE parent_id = '' GROUP BY chunk_id)
    SELECT parent_id, doc_id, length(text) AS chars, text IS NULL AS missing FROM w LEFT JOIN p USING (parent_id)""",
)
def parents_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(spark, sf_dir).filter("parent_id = ''")
    return corpus.with_parents(table(spark, sf_dir, "fused_children"), p).select("parent_id", "doc_id", F.length("text").alias("chars"), "missing")


@query(
    "file_routing",
    sql=r"""WITH f AS (SELECT DISTINCT source AS path, lower(regexp_extract(source, '\.([^./\\]+)$', 1)) AS format FROM parsed_docs WHERE source IS NOT NULL),
    r AS (SELECT *, CASE WHEN format = 'doc' THEN 'save .doc as .docx first' WHEN format = '' THEN 'no suffix' WHEN format NOT IN ('pdf', 'docx', 'md') THEN 'unsupported format: ' || format END AS reason FROM f)
    SELECT path, format, reason, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status FROM r""",
)
def file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.route(table(spark, sf_dir, "parsed_docs").filter("source is not null").select(F.col("source").alias("path")).distinct())


@query(
    "ingest_report",
    sql="""WITH d AS (SELECT doc_id, any_value(source) AS source, any_value(status) AS status, any_value(warnings) AS warnings FROM parsed_docs WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT source) <= 1),
    w AS (SELECT source, string_agg(DISTINCT w, '|' ORDER BY w) AS warnings FROM (SELECT source, unnest(warnings) AS w FROM d) GROUP BY source)
    SELECT d.source, count(*) AS documents, coalesce(any_value(w.warnings), '') AS warnings FROM d LEFT JOIN w ON w.source IS NOT DISTINCT FROM d.source GROUP BY d.source""",
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "parsed_docs").filter("doc_id is not null").groupBy("doc_id").agg(F.first("source", True).alias("source"), F.first("status", True).alias("status"), F.first("warnings", True).alias("warnings"), F.countDistinct("source").alias("k")).filter("k <= 1")
    return corpus.ingest_report(d).select("source", "documents", F.array_join("warnings", "|").alias("warnings"))


@query("stored_pages", sql=f"WITH c AS ({_ONCE}) SELECT chunk_id, CASE WHEN coalesce(page_no, -1) >= 0 THEN page_no END AS page_no FROM c")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the stored form and back."""
    return corpus.metadata(once(spark, sf_dir)).select("chunk_id", corpus.read_page("stored_page").alias("page_no"))


@query(
    "settings_merge",
    sql="""WITH s AS (SELECT c_custkey, c_name AS a, c_mktsegment AS b, CASE WHEN c_nationkey < 8 THEN 'x****y' WHEN c_nationkey < 16 THEN '' ELSE 'new' END AS na, CASE WHEN c_acctbal > 0 THEN 'seg' END AS nb FROM customer)
    SELECT c_custkey, CASE WHEN na = '' THEN NULL WHEN contains(na, '****') THEN a ELSE na END AS name, coalesce(nb, b) AS segment FROM s""",
)
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides merged over saved settings: masked and absent values keep the old, an empty one clears it."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_nationkey") < 8, "x****y").when(F.col("c_nationkey") < 16, "").otherwise("new")
    new = F.map_filter(F.create_map(F.lit("name"), name, F.lit("segment"), F.when(F.col("c_acctbal") > 0, "seg")), lambda k, v: v.isNotNull())
    merged = corpus.kept_override(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment"), new)
    return c.select("c_custkey", F.try_element_at(merged, F.lit("name")).alias("name"), F.try_element_at(merged, F.lit("segment")).alias("segment"))


@query("secret_masks", sql="SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked, FALSE AS was_masked FROM customer")
def secret_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask(F.col("c_name")).alias("masked"), T.is_masked(F.col("c_name")).alias("was_masked"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files; those without a source are of a format that has no converter."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("%012d.md", "doc_id").alias("source"), F.when(F.col("source").isNull(), "pdf").otherwise("md").alias("format"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query("ingest_pipeline")
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to chunks with vectors, and a report with every file's outcome."""
    return pipeline.ingest(_files(spark, sf_dir), retrieval.hashed_encoder())[1]


@query(
    "ingest_copies",
    sql="""WITH d AS (SELECT printf('%012d.md', doc_id) AS source, coalesce(text, '') AS text, source IS NULL AS odd FROM documents), f AS (SELECT text, min(source) AS first FROM d GROUP BY text)
    SELECT source, 'same content as ' || first AS reason FROM d JOIN f USING (text) WHERE source <> first UNION ALL SELECT source, 'no converter for pdf' FROM d JOIN f USING (text) WHERE source = first AND odd""",
)
def ingest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline reports of files that are copies or of an unknown format."""
    rows = pipeline.ingest(_files(spark, sf_dir), retrieval.hashed_encoder())[1]
    return rows.filter("status = 'copy' or reason like 'no converter%'").select("source", "reason")
