"""Web and text-format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import render, text as T, urls
from ..operators import retrieval, web
from ..tables import table
from . import REGISTRY

query = REGISTRY.query


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'), '{T.ENDS}', '', 'g')"


@query(
    "search_results",
    sql=f"""WITH r AS (SELECT ticker AS query_id, doc_id AS n, left({_squeeze('source')}, 100) AS title, 'https://docs.example/' || doc_id AS url, left({_squeeze('text')}, 300) AS snippet FROM documents WHERE ticker IS NOT NULL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM r WHERE title <> '' OR snippet <> '' QUALIFY rank <= 5""",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each ticker as search results, normalised."""
    d = table(spark, sf_dir, "documents").filter("ticker is not null")
    raw = d.select(F.col("ticker").alias("query_id"), F.col("doc_id").alias("n"), F.col("source").alias("title"), F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("snippet"), F.col("text").alias("content"))
    return web.normalised(raw)


@query(
    "result_dedup",
    sql="""WITH r AS (SELECT ticker, doc_id, CASE WHEN lang = 'en' THEN text END AS url, source AS title FROM documents WHERE ticker IS NOT NULL), k AS (SELECT *, coalesce(nullif(trim(url), ''), trim(title)) AS key FROM r)
    SELECT ticker, min(doc_id) AS doc_id FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY ticker, key""",
)
def result_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First results by URL (here the text of English documents), else by title."""
    d = table(spark, sf_dir, "documents").filter("ticker is not null")
    rows = d.select("ticker", "doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("url"), F.col("source").alias("title"))
    return web.unique_results(rows, ["ticker"], ["doc_id"]).select("ticker", "doc_id")


@query("hit_dedup", sql="SELECT query_id, min(hit_id) AS hit_id FROM fused_children WHERE chunk_id <> '' GROUP BY query_id, chunk_id")
def hit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.unique_hits(table(spark, sf_dir, "fused_children").select("query_id", "hit_id", "chunk_id"), ["query_id"], ["hit_id"]).select("query_id", "hit_id")


@query(
    "sources_union",
    sql="""WITH b AS (SELECT query_id, 0 AS part, hit_id AS n, metadata.source AS url FROM fused_children WHERE dense_rank IS NOT NULL UNION ALL SELECT query_id, 1, hit_id, metadata.source FROM fused_children WHERE dense_rank IS NULL),
    f AS (SELECT query_id, url, min(row(part, n)) AS first_at FROM b WHERE url <> '' GROUP BY query_id, url), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_at, url) AS k FROM f)
    SELECT query_id, string_agg(url, '|' ORDER BY k) AS sources FROM k WHERE k <= 10 GROUP BY query_id""",
)
def sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of dense hits, then of the others, each once, ten at most."""
    h = table(spark, sf_dir, "fused_children").select("query_id", F.col("hit_id").alias("n"), F.col("metadata.source").alias("url"), "dense_rank")
    return web.sources(h.filter("dense_rank is not null"), h.filter("dense_rank is null"), "query_id").select("query_id", F.array_join("sources", "|").alias("sources"))


def _blocked() -> str:
    from ipaddress import ip_network

    return " OR ".join(f"ip BETWEEN {int(n[0])} AND {int(n[-1])}" for n in map(ip_network, urls.BLOCKED))


@query(
    "url_safety",
    sql=f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey * 2654435761 % 4294967296 AS BIGINT) AS ip, CASE o_orderkey % 5 WHEN 0 THEN ':8080' WHEN 1 THEN ':443' ELSE '' END AS port, CASE WHEN o_orderkey % 7 = 0 THEN 'ftp' ELSE 'http' END AS scheme FROM orders),
    u AS (SELECT *, scheme || '://' || (ip // 16777216) || '.' || (ip // 65536 % 256) || '.' || (ip // 256 % 256) || '.' || (ip % 256) || port || '/a' AS url FROM o)
    SELECT o_orderkey, url, CASE WHEN scheme <> 'http' THEN 'scheme' WHEN port = ':8080' THEN 'port' WHEN {_blocked()} THEN 'address' END AS refused FROM u""",
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses spread over the whole range, with ports and schemes."""
    ip = F.expr("o_orderkey * 2654435761 % 4294967296")
    octet = lambda d: (F.floor(ip / d) % 256).cast("bigint").cast("string")
    port = F.when(F.col("o_orderkey") % 5 == 0, ":8080").when(F.col("o_orderkey") % 5 == 1, ":443").otherwise("")
    url = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "ftp").otherwise("http"), F.lit("://"), F.concat_ws(".", octet(16777216), octet(65536), octet(256), octet(1)), port, F.lit("/a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url")).withColumn("refused", urls.refused(F.col("url")))


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: title, main text, whether it was cut."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"))
    return web.fetched(d)


@query("page_items")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document parsed as Markdown to items."""
    from ..sources.documents import items

    d = table(spark, sf_dir, "documents").filter("text is not null")
    return items(d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source"), F.lit("md").alias("format"), F.encode("text", "UTF-8").alias("content")))


@query(
    "briefs",
    sql=f"""WITH d AS (SELECT doc_id, {_squeeze('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || chr(8230) ELSE t END AS brief FROM d""",
)
def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.brief(F.col("text"), 80).alias("brief"))


_CAPTIONS = """WITH i AS (SELECT doc_id, pos, min(type) AS type, min(text) AS text, min(level) AS level, min(image_path) AS image_path FROM parsed_items GROUP BY doc_id, pos),
    s AS (SELECT *, CASE WHEN type = 'text' AND level IS NULL THEN nullif(regexp_replace(text, '{ends}', '', 'g'), '') END AS t FROM i), c AS (SELECT *, CASE WHEN length(t) <= 60 THEN t END AS short FROM s),
    n AS (SELECT *, coalesce(lead(short) OVER w, lag(short) OVER w) AS caption FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query(
    "image_texts",
    sql=_CAPTIONS.format(ends=T.ENDS) + """ SELECT doc_id, pos, '[image ' || pos || ': ' || coalesce(image_path, 'none') || CASE WHEN caption IS NOT NULL THEN '; caption: ' || caption ELSE '' END || ']' AS placeholder FROM n WHERE type = 'image'""",
)
def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each image, with the caption from the text beside it."""
    from ..operators import cleaning
    from .cleaning import items

    i = cleaning.captions(items(spark, sf_dir))
    return i.select("doc_id", "pos", T.image_placeholder(F.col("pos"), F.col("image_path"), F.col("caption")).alias("placeholder"))


@query("first_pages", sql="SELECT DISTINCT doc_id, pos, page_no AS page FROM parsed_items")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's page from its provenance, here none or its page and the next."""
    prov = F.when(F.col("page_no").isNotNull(), F.array(F.struct("page_no"), F.struct((F.col("page_no") + 1).alias("page_no")))).otherwise(F.array().cast("array<struct<page_no:int>>"))
    return table(spark, sf_dir, "parsed_items").select("doc_id", "pos", render.page_of(prov).alias("page")).distinct()


@query(
    "evidence_texts",
    sql=f"""WITH h AS (SELECT query_id, chunk_id, min(dense_rank) AS dense_rank, min(sparse_rank) AS sparse_rank, min(text) AS text, min(metadata.source) AS source FROM fused_children GROUP BY query_id, chunk_id),
    a AS (SELECT *, 'a' AS part, row_number() OVER (PARTITION BY query_id ORDER BY dense_rank, chunk_id) AS n FROM h WHERE dense_rank IS NOT NULL UNION ALL SELECT *, 'b', row_number() OVER (PARTITION BY query_id ORDER BY sparse_rank, chunk_id) FROM h WHERE dense_rank IS NULL AND sparse_rank IS NOT NULL),
    l AS (SELECT query_id, part, n, '    - ' || CASE part WHEN 'a' THEN '[' || coalesce(nullif(source, ''), chunk_id) || '] #' || coalesce(TRY_CAST(nullif(regexp_extract(chunk_id, ':c([0-9]+)$', 1), '') AS INT)::VARCHAR, '?') || ': ' || left({_squeeze('text')}, 250) ELSE left({_squeeze('chunk_id')}, 80) || ' (' || coalesce(source, '') || '): ' || left({_squeeze('text')}, 250) END AS line FROM a WHERE n <= 4),
    s AS (SELECT query_id, string_agg(source, ' ' ORDER BY source) AS named FROM (SELECT DISTINCT query_id, source FROM h WHERE source <> '' QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY source) <= 5) GROUP BY query_id),
    b AS (SELECT query_id, left(string_agg(line, chr(10) ORDER BY part, n), 1200) AS block FROM l GROUP BY query_id)
    SELECT query_id, concat_ws(chr(10), '  evidence:' || chr(10) || block, '  sources: ' || named) AS evidence FROM b LEFT JOIN s USING (query_id)""",
)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's best hits on the dense route as hits, those found on the sparse route alone as results, in the form an answer is written from."""
    h = table(spark, sf_dir, "fused_children").groupBy("query_id", "chunk_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"), F.min("text").alias("text"), F.min("metadata.source").alias("source"))
    best = lambda rows, by: retrieval.top(rows, -F.col(by), render.ITEMS, ["query_id"], "chunk_id")
    listed = lambda rows, cols: rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*cols).alias("x")))), lambda r: r["x"]).alias("list"))
    hits = listed(best(h.filter("dense_rank is not null"), "dense_rank"), [F.col("source").alias("filename"), F.col("chunk_id").alias("doc_id"), T.seq_of(F.col("chunk_id")).alias("seq"), F.col("text").alias("content")]).withColumnRenamed("list", "hits")
    lone = listed(best(h.filter("dense_rank is null and sparse_rank is not null"), "sparse_rank"), [F.col("chunk_id").alias("title"), F.col("source").alias("url"), F.col("text").alias("snippet")]).withColumnRenamed("list", "results")
    named = retrieval.top(h.filter("source <> ''").select("query_id", "source").distinct(), F.lit(0), render.SOURCES, ["query_id"], "source").groupBy("query_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    rows = hits.join(lone, "query_id", "full_outer").join(named, "query_id", "left")
    fetches = F.lit(None).cast("array<struct<url:string,excerpt:string>>")
    return rows.select("query_id", render.evidence(F.col("hits"), F.col("results"), fetches, F.lit(None).cast("map<string,string>"), F.col("sources")).alias("evidence"))


@query(
    "fetch_outcomes",
    sql=f"""SELECT 'https://docs.example/' || doc_id AS url, CASE WHEN source = 'forum_post' THEN 'unsafe: address' WHEN source = 'news_flash' THEN 'redirect without a target' WHEN source = 'call_transcript' THEN 'too many redirects' WHEN source = 'agent_digest' THEN 'status 404'
    WHEN source = 'kb_passage' THEN 'type application/pdf' WHEN source IS NULL THEN 'no answer' WHEN {_squeeze('text')} = '' THEN 'no text' END AS outcome FROM documents""",
)
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recorded fetches, the source deciding how they went."""
    d = table(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")))
    hop = lambda url, status, location=None, kind="text/html; charset=utf-8": F.struct(F.lit(url).alias("url") if isinstance(url, str) else url.alias("url"), F.lit(status).alias("status"), F.lit(location).cast("string").alias("location"), F.lit(kind).alias("content_type"))
    own = F.col("url")
    many = F.array(*[hop(own, 302, "https://docs.example/on")] * 5)
    hops = (
        F.when(F.col("source") == "forum_post", F.array(hop(own, 302, "http://10.0.0.7/"), hop("http://10.0.0.7/", 200)))
        .when(F.col("source") == "news_flash", F.array(hop(own, 301)))
        .when(F.col("source") == "call_transcript", many)
        .when(F.col("source") == "agent_digest", F.array(hop(own, 404)))
        .when(F.col("source") == "kb_passage", F.array(hop(own, 200, None, "application/pdf")))
        .when(F.col("source").isNotNull(), F.array(hop(own, 302, "https://docs.example/on"), hop(own, 200)))
    )
    return web.recorded(d.select("url", hops.alias("hops"), F.col("text").alias("body"))).select("url", "outcome")


@query(
    "fetch_excerpts",
    sql=f"""WITH m AS (SELECT ticker AS thread, doc_id AS n, 'https://docs.example/' || coalesce(source, '') AS url, text FROM documents WHERE ticker IS NOT NULL), f AS (SELECT thread, url, min(n) AS n FROM m GROUP BY thread, url)
    SELECT thread, n, url, left(regexp_replace(coalesce(text, ''), '{T.ENDS}', '', 'g'), 2000) AS excerpt FROM m JOIN f USING (thread, url, n)""",
)
def fetch_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetch messages of their ticker's thread; each source is one page, told by its first message."""
    d = table(spark, sf_dir, "documents").filter("ticker is not null")
    wrapped = F.concat(F.lit('<fetched url="https://docs.example/'), F.coalesce("source", F.lit("")), F.lit('">'), F.coalesce("text", F.lit("")), F.lit("</fetched>"))
    return web.excerpts(d.select(F.col("ticker").alias("thread"), F.col("doc_id").alias("n"), wrapped.alias("text")))


@query(
    "form_values",
    sql="""SELECT question_id, array_to_string(list_filter(regexp_split_to_array(question, '[\\s\\p{Z}]+'), lambda x: x <> ''), '|') AS args, array_to_string(list_filter(['doc=' || source_doc, 'kind=last ' || coalesce(question_type, '')], lambda x: x IS NOT NULL), ';') AS entries,
    question_type || '|plain' AS labels, 1 AS more FROM test_set""",
)
def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a form's fields become: arguments, a map of rows of which equal keys keep the last, tool labels of which two are shown."""
    t = table(spark, sf_dir, "test_set")
    row = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    rows = F.array(row("kind", F.col("notes")), row(" doc ", F.col("source_doc")), row(" ", F.lit("no key")), row("kind", F.concat(F.lit("last "), F.coalesce("question_type", F.lit("")))))
    tools = render.labels(F.array(F.to_json(F.struct(F.col("question_type").alias("name"))), F.lit('"plain"'), F.lit("7")), 2)
    shown = F.array_join(F.transform(render.entries(render.record(rows)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.select("question_id", F.array_join(render.arguments(F.col("question")), "|").alias("args"), shown.alias("entries"), F.array_join(tools["labels"], "|").alias("labels"), tools["more"].alias("more"))


@query("data_uris", sql="SELECT question_id, 'data:image/png;base64,' || base64(encode(question)) AS uri FROM test_set")
def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_set").select("question_id", T.data_uri(F.lit("image/png"), F.encode("question", "UTF-8")).alias("uri"))


@query(
    "table_grids",
    sql="""SELECT n_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS grid FROM nation GROUP BY n_regionkey""",
)
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a Markdown table."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows")).select("n_regionkey", T.grid(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.col("rows"))).alias("grid"))


@query(
    "interrupt_kinds",
    sql="""SELECT event_id, CASE event_type WHEN 'view' THEN 'plan_confirm' WHEN 'click' THEN 'ask' ELSE 'unknown' END AS kind FROM events""",
)
def interrupt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads told apart by their type, or by a key that older ones have."""
    raw = F.when(F.col("event_type") == "view", '{"type":"plan_confirm"}').when(F.col("event_type") == "click", '{"question":"x"}').otherwise(F.col("props"))
    kind = F.coalesce(F.get_json_object(raw, "$.type"), F.when(F.get_json_object(raw, "$.plan").isNotNull(), "plan_confirm"), F.when(F.get_json_object(raw, "$.question").isNotNull(), "ask"), F.lit("unknown"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
