"""Cleaning and chunking queries over parsed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import chunking, cleaning
from ..tables import table
from . import REGISTRY

query = REGISTRY.query
_ENDS = T.ENDS
_ITEMS = "SELECT doc_id, pos, min(type) AS type, min(text) AS text, min(heading_path) AS heading_path, min(page_no) AS page_no, min(level) AS level FROM parsed_items GROUP BY doc_id, pos"
_CHARS = f"regexp_replace(regexp_replace(regexp_replace(text, '{T.CONTROL}', '', 'g'), '{T.INVISIBLE}', '', 'g'), '{T.CID}', '', 'g')"
_CLEAN = f"regexp_replace({_CHARS}, '{T.PRIVATE_USE}', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_ENDS}', '', 'g')"


def _lines(x: str) -> str:
    return f"translate(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12288) || chr(160), '  ')"


_SPACE = _strip(f"regexp_replace(regexp_replace({_lines(_CLEAN)}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item once."""
    cols = ("type", "text", "heading_path", "page_no", "level", "image_path")
    return table(spark, sf_dir, "parsed_items").groupBy("doc_id", "pos").agg(*[F.min(c).alias(c) for c in cols])


@query(
    "clean_chars",
    sql=f"""WITH i AS ({_ITEMS}), c AS (SELECT *, {_CHARS} AS a, {_CLEAN} AS b FROM i)
    SELECT doc_id, pos, md5(b) AS cleaned, length(text) - length(b) AS removed, (length(a) - length(b)) / greatest(length(a), 1)::DOUBLE > 0.1 AS font_warning,
    (length(b) - length(replace(b, chr(65533), ''))) / greatest(length(b), 1)::DOUBLE > 0.01 AS decode_warning FROM c""",
)
def clean_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = items(spark, sf_dir)
    return raw.select("doc_id", "pos", F.md5(T.clean_chars(F.col("text"))).alias("cleaned"), (F.length("text") - F.length(T.clean_chars(F.col("text")))).alias("removed"), (T.private_use_share(F.col("text")) > 0.1).alias("font_warning"), (T.replacement_share(T.clean_chars(F.col("text"))) > 0.01).alias("decode_warning"))


@query("clean_space", sql=f"WITH i AS ({_ITEMS}) SELECT doc_id, pos, {_SPACE} AS text FROM i WHERE type = 'text'")
def clean_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.characters(items(spark, sf_dir)).filter("type = 'text'").select("doc_id", "pos", "text")


@query(
    "table_text",
    sql=f"""WITH i AS ({_ITEMS}), a AS (SELECT doc_id, pos, regexp_replace({_lines(_CLEAN)}, '[ \\t]{{2,}}', ' ', 'g') AS t FROM i WHERE type = 'table'),
    b AS (SELECT doc_id, pos, regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g') AS t FROM a)
    SELECT doc_id, pos, regexp_replace({_strip('t')}, '\\n([^|])', ' \\1', 'g') AS text FROM b""",
)
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.characters(items(spark, sf_dir)).filter("type = 'table'").select("doc_id", "pos", "text")


@query(
    "header_footer",
    sql=f"""WITH i AS ({_ITEMS}), k AS (SELECT doc_id, pos, page_no, regexp_replace(translate({_strip('text')}, '{T.FULL}', '{T.HALF.replace("'", "''")}'), '\\p{{Nd}}+', '#', 'g') AS key FROM i WHERE type = 'text' AND level IS NULL),
    p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM i GROUP BY doc_id), h AS (SELECT doc_id, key, count(DISTINCT page_no) AS hit FROM k WHERE key <> '' AND length(key) <= 50 GROUP BY doc_id, key)
    SELECT k.doc_id, k.pos FROM k JOIN h USING (doc_id, key) JOIN p USING (doc_id) WHERE hit >= greatest(3, ceil(pages * 0.6::DOUBLE))""",
)
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.furniture(items(spark, sf_dir))


@query("page_numbers", sql=f"WITH i AS ({_ITEMS}) SELECT doc_id, pos FROM i WHERE type = 'text' AND level IS NULL AND regexp_matches({_strip('text')}, '^\\p{{Nd}}{{1,4}}$')")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter("type = 'text' and level is null").filter(T.is_page_number(F.col("text"))).select("doc_id", "pos")


@query(
    "repeated_neighbours",
    sql=f"""WITH i AS ({_ITEMS}), k AS (SELECT doc_id, pos, level, type, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS key FROM i)
    SELECT doc_id, pos FROM (SELECT *, lag(key) OVER w AS before, lag(type) OVER w AS kind, lag(level) OVER w AS up FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE key <> '' AND key = before AND type = kind AND level IS NULL AND up IS NULL""",
)
def repeated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose letters equal the item just before: the exact part of the neighbour rule."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    k = items(spark, sf_dir).withColumn("key", T.letters_key(F.col("text")))
    rows = k.select("doc_id", "pos", "key", "type", "level", F.lag("key").over(w).alias("before"), F.lag("type").over(w).alias("kind"), F.lag("level").over(w).alias("up"))
    return rows.filter("key <> '' and key = before and type = kind and level is null and up is null").select("doc_id", "pos")


@query(
    "short_line_merge",
    sql=f"""WITH i AS ({_ITEMS}), t AS (SELECT * FROM i WHERE text <> '' AND NOT (type = 'text' AND level IS NULL AND regexp_matches({_strip('text')}, '^\\p{{Nd}}{{1,4}}$'))),
    f AS (SELECT *, lag(text) OVER w AS before, CASE WHEN type = 'text' AND level IS NULL AND length(text) < 30 AND lag(type) OVER w = 'text' AND lag(level) OVER w IS NULL AND lag(heading_path) OVER w = heading_path THEN 0 ELSE 1 END AS cut
          FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS island, CASE WHEN cut = 0 AND regexp_matches(before, '[A-Za-z0-9]$') THEN ' ' || text ELSE text END AS piece FROM f)
    SELECT doc_id, min(pos) AS pos, count(*) AS lines, string_agg(piece, '' ORDER BY pos) AS text FROM g GROUP BY doc_id, island""",
)
def short_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines joined to the item before, as islands: a line starts a new island unless it continues the one before."""
    rows = items(spark, sf_dir).filter("text <> ''").filter(~((F.col("type") == "text") & F.col("level").isNull() & T.is_page_number(F.col("text"))))
    w = Window.partitionBy("doc_id").orderBy("pos")
    goes_on = (F.col("type") == "text") & F.col("level").isNull() & (F.length("text") < cleaning.SHORT_LINE) & (F.lag("type").over(w) == "text") & F.lag("level").over(w).isNull() & (F.lag("heading_path").over(w) == F.col("heading_path"))
    flagged = rows.withColumns({"cut": F.when(goes_on, 0).otherwise(1), "before": F.lag("text").over(w)})
    piece = F.when((F.col("cut") == 0) & F.col("before").rlike("[A-Za-z0-9]$"), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    islands = flagged.withColumns({"island": F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)), "piece": piece})
    return islands.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.count("*").alias("lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text")).drop("island")


@query("adjacent_dedup")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stay after the neighbour rule, similarity included."""
    return cleaning.adjacent(items(spark, sf_dir))


@query(
    "twin_neighbours",
    sql=f"""WITH RECURSIVE i AS ({_ITEMS}), t AS (SELECT doc_id, pos, type, CASE WHEN level IS NULL THEN nullif(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '') END AS letters, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM i),
    n AS (SELECT *, type || '/' || letters AS twin FROM t),
    w(doc_id, pos, type, k, x, y, kept) AS (SELECT doc_id, pos, type, k, NULL::VARCHAR, twin, TRUE FROM n WHERE k = 1
      UNION ALL SELECT doc_id, pos, type, k, CASE WHEN again THEN x ELSE y END, CASE WHEN again THEN y ELSE twin END, NOT again
      FROM (SELECT n.*, w.x, w.y, coalesce(n.twin = w.x, FALSE) OR coalesce(n.twin = w.y, FALSE) AS again FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1))
    SELECT doc_id, pos, type FROM w WHERE kept""",
)
def twin_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stay after the neighbour rule by equal letters: A, B, B, A keeps A, B."""
    return cleaning.adjacent(items(spark, sf_dir), similar=False)


_BLOCKS = f"""i AS ({_ITEMS}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, level IS NULL AND type IN ('table', 'image') AS alone FROM i WHERE text <> ''),
    w(doc_id, pos, k, level, block, filled, sealed, depth) AS (SELECT doc_id, pos, k, level, 1, length(text), alone, level FROM n WHERE k = 1
      UNION ALL SELECT doc_id, pos, k, level, block + fresh::INT, n_chars + CASE WHEN fresh THEN 0 ELSE filled END, alone, coalesce(level, depth)
      FROM (SELECT n.doc_id, n.pos, n.k, n.level, n.alone, length(n.text) AS n_chars, w.block, w.filled, w.depth,
            CASE WHEN n.level IS NOT NULL THEN w.sealed OR w.depth IS NULL OR n.level <= w.depth ELSE w.sealed OR n.alone OR w.filled + length(n.text) > {chunking.HIGH} END AS fresh FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1))"""


@query(
    "parent_blocks",
    sql=f"""WITH RECURSIVE {_BLOCKS}, b AS (SELECT doc_id, block, bool_and(level IS NOT NULL) AS bare, arg_min(level IS NOT NULL, pos) AS titled FROM w GROUP BY doc_id, block),
    p AS (SELECT doc_id, block, sum(CASE WHEN coalesce(before, FALSE) AND NOT bare AND NOT titled THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block) AS parent FROM (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY block) AS before FROM b))
    SELECT w.doc_id, w.pos, w.block, CAST(p.parent AS INT) AS parent FROM w JOIN p USING (doc_id, block)""",
)
def parent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed up to the bound, cut at headings, tables and images, and the parents they make, headings alone handed on."""
    return chunking.placed(items(spark, sf_dir))


@query(
    "overlap_tails",
    sql=f"""WITH t AS (SELECT DISTINCT chunk_id AS id, right(text, {chunking.OVERLAP}) AS w, length(text) AS n FROM chunks WHERE text IS NOT NULL), e AS (SELECT *, length(regexp_extract(w, '(?s)^(.*?[。！？；…]+[」』”）)\\]】\"]*)', 1)) AS cut FROM t),
    c AS (SELECT id, n, CASE WHEN cut BETWEEN 1 AND {chunking.TOLERANCE} THEN substr(w, cut + 1) ELSE w END AS tail FROM e) SELECT id, CASE WHEN n <= {chunking.OVERLAP} THEN '' ELSE {_strip('tail')} END AS tail FROM c""",
)
def overlap_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the piece after each chunk would begin with, were it a piece."""
    return chunking.tails(table(spark, sf_dir, "chunks").filter("text is not null").select(F.col("chunk_id").alias("id"), "text").distinct())


@query("clean_document")
def clean_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(items(spark, sf_dir))


@query("clean_stats")
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stats(items(spark, sf_dir))


@query("chunk_split")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items to parents and children."""
    return chunking.cleaned(items(spark, sf_dir))


@query("chunk_counts")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.cleaned(items(spark, sf_dir))
    return c.groupBy("doc_id").agg(F.sum((F.col("parent_id") == "").cast("int")).alias("parents"), F.sum((F.col("parent_id") != "").cast("int")).alias("children"), F.max("char_len").alias("longest"))


@query(
    "heading_paths",
    sql="""WITH RECURSIVE i AS (SELECT doc_id, pos, min(level) AS level, min(text) AS text FROM parsed_items GROUP BY doc_id, pos),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM i),
    w(doc_id, pos, k, level, text, stack) AS (
      SELECT doc_id, pos, k, level, text, []::STRUCT(l INT, t VARCHAR)[] FROM n WHERE k = 1
      UNION ALL SELECT n.doc_id, n.pos, n.k, n.level, n.text, list_filter(CASE WHEN w.level IS NULL THEN w.stack ELSE list_append(list_filter(w.stack, lambda x: x.l < w.level), {'l': w.level, 't': w.text}) END, lambda x: n.level IS NULL OR x.l < n.level)
      FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1)
    SELECT doc_id, pos, array_to_string(list_transform(stack, lambda x: x.t), ' > ') AS path FROM w""",
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs rebuilt from headings and levels."""
    return chunking.heading_paths(items(spark, sf_dir))


@query(
    "page_offsets",
    sql=f"""WITH i AS ({_ITEMS}) SELECT doc_id, pos, page_no, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM i""",
)
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.offsets(items(spark, sf_dir))


@query(
    "page_at",
    sql=f"""WITH i AS ({_ITEMS}), o AS (SELECT doc_id, pos, page_no, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM i),
    w AS (SELECT DISTINCT doc_id, CAST(unnest([start_pos, start_pos + n // 2, start_pos + n, start_pos + n + 1]) AS BIGINT) AS at_pos FROM o)
    SELECT w.doc_id, w.at_pos AS at, o.page_no AS page FROM w JOIN o ON o.doc_id = w.doc_id AND o.start_pos <= w.at_pos QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.at_pos ORDER BY o.start_pos DESC, o.pos DESC) = 1""",
)
def page_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at each unit's start, middle, end and in the gap after it."""
    rows = items(spark, sf_dir)
    n = F.length("text")
    starts = chunking.offsets(rows).join(rows.select("doc_id", "pos", n.alias("n")), ["doc_id", "pos"])
    wanted = starts.filter("n is not null").select("doc_id", F.explode(F.array(F.col("start_pos"), F.col("start_pos") + F.floor(F.col("n") / 2), F.col("start_pos") + F.col("n"), F.col("start_pos") + F.col("n") + 1)).alias("at"))
    return chunking.pages_at(rows, wanted)


@query(
    "composed_text",
    sql="""SELECT chunk_id, CASE WHEN coalesce(max(heading_path), '') = '' THEN max(text) WHEN max(text) = '' THEN max(heading_path) ELSE max(heading_path) || chr(10) || chr(10) || max(text) END AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id""",
)
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading path and body in one text."""
    c = table(spark, sf_dir, "chunks").filter("text is not null").groupBy("chunk_id").agg(F.max("heading_path").alias("h"), F.max("text").alias("t"))
    return c.select("chunk_id", T.compose(F.coalesce("h", F.lit("")), F.col("t")).alias("text"))
