"""Corpus tables: content addresses, listing, keyed merge, replacing by source, deletion, upload checks.

Parquet has no MERGE; a change is built from anti-joins and put in place of the buckets it touches, in one step (``sources.versioned``), so no
failure loses rows and no reader sees half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources import versioned

TEXT_BYTES, PARENT_BYTES, UPLOAD_BYTES = 8192, 65535, 20 * 1024 * 1024
SUFFIXES = ("pdf", "docx", "md")


def address(content: str = "content"):
    """The content id: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def route(files: DataFrame) -> DataFrame:
    """``files(path)`` with a status: accepted formats go on, others get their reason."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    reason = F.when(suffix == "doc", "save .doc as .docx first").when(suffix == "", "no suffix").when(~suffix.isin(*SUFFIXES), F.concat(F.lit("unsupported format: "), suffix))
    return files.withColumns({"format": suffix, "reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("failed")})


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Each key's row delivered last; exact repeats once."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), by).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without the new rows' keys, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fit(rows: DataFrame, most: int = TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows whose text has at most ``most`` bytes, and the others with a warning."""
    size = F.octet_length("text")
    return rows.filter(size <= most), rows.filter(size > most).withColumn("warning", F.format_string("text of %d bytes, %d at most", size, F.lit(most)))


def without_doc(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def stale(children: DataFrame, keep: DataFrame) -> DataFrame:
    """(source, doc_id) of versions that ``keep(source, doc_id)`` replaces: same source, another document."""
    kept = keep.select("source", F.col("doc_id").alias("kept")).distinct()
    return children.select("source", "doc_id").distinct().join(kept, "source", "inner").filter("doc_id <> kept").select("source", "doc_id").distinct()


def replace_source(rows: DataFrame, new: DataFrame) -> DataFrame:
    """A source's rows replaced by its new document's; re-ingested documents lose all their old rows, so no orphan stays."""
    gone = stale(rows, new).select("doc_id").union(new.select("doc_id")).distinct()
    return rows.join(gone, "doc_id", "left_anti").unionByName(new)


def listing(children: DataFrame) -> DataFrame:
    """Documents with their chunk counts, the first chunk's source, in order of source."""
    return children.groupBy("doc_id").agg(F.coalesce(F.min_by("source", "chunk_id"), F.lit("")).alias("source"), F.count("*").alias("chunks")).orderBy("source", "doc_id")


def snapshot(children: DataFrame) -> DataFrame:
    return children.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def uploads(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files(name, content)`` with the outcome: too large, already there, or created."""
    rows = files.withColumns({"doc_id": address(), "bytes": F.octet_length("content")})
    seen = known.select("doc_id").distinct().withColumn("there", F.lit(True))
    large = F.col("bytes") > UPLOAD_BYTES
    return rows.join(seen, "doc_id", "left").select("name", "doc_id", "bytes", F.when(large, "too large").when(F.col("there"), "exists").otherwise("created").alias("outcome"), (~large & F.col("there").isNull()).alias("created"))


def metadata(chunks: DataFrame) -> DataFrame:
    """The stored form: a page of -1 where there is none, and a metadata struct; the image only where there is one."""
    return chunks.withColumns({"stored_page": F.coalesce("page_no", F.lit(-1)), "metadata": F.to_json(F.struct("source", "heading_path", F.coalesce("page_no", F.lit(-1)).alias("page_no"), F.length("text").alias("char_len"), "image_path"))})


def read_page(c: str):
    """A stored page as read: -1 is none."""
    return F.when(F.col(c) >= 0, F.col(c))


def with_parents(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """Point lookup of parents; ``missing`` marks the ids without one."""
    wanted = ids.select("parent_id").filter("parent_id <> ''").distinct()
    return wanted.join(parents.select(F.col("chunk_id").alias("parent_id"), "text", "doc_id"), "parent_id", "left").withColumn("missing", F.col("text").isNull())


def ingest_report(docs: DataFrame) -> DataFrame:
    """Totals and each source's warnings."""
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("status") == "stored").cast("int")).alias("stored"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("warnings", F.array().cast("array<string>")))))).alias("warnings"))


def checked(df: DataFrame, schema) -> DataFrame:
    """The frame, or an error that names what differs from the schema agreed on."""
    have, want = {f.name: f.dataType.simpleString() for f in df.schema}, {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        raise ValueError(f"schema drift: {sorted(set(have.items()) ^ set(want.items()))}")
    return df


def ensure(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, created empty if absent, with its schema checked."""
    if versioned.state(spark, path) is None:
        versioned.write(spark.createDataFrame([], schema), path, "doc_id")
    return checked(versioned.read(spark, path), schema)


def swap(df: DataFrame, path: str) -> None:
    """The whole table replaced."""
    versioned.write(df, path, "doc_id")


def store(new: DataFrame, path: str) -> list[int]:
    """``replace_source`` on a table at a path. Of the rows there, source and document are read to find what is replaced; only the buckets that hold a
    replaced or a new document are read whole and written again. Returns these."""
    spark = new.sparkSession
    old = ensure(spark, path, new.schema)
    n = versioned.state(spark, path)["n"]
    hit = versioned.touched(stale(old, new).select("doc_id").union(new.select("doc_id")), "doc_id", n)
    versioned.write(replace_source(versioned.read(spark, path, hit), new), path, "doc_id", hit)
    return hit


def kept_override(old, new):
    """Merged settings maps: an absent or masked value keeps the old one, an empty one clears it."""
    merged = F.map_zip_with(old, new, lambda k, a, b: F.when(b.isNull() | T.is_masked(b), a).otherwise(b))
    return F.map_filter(merged, lambda k, v: v.isNotNull() & (v != ""))


def changed(before, after):
    """What differs between two settings maps; a value removed is ''."""
    return F.map_filter(F.map_zip_with(before, after, lambda k, a, b: F.when(~a.eqNullSafe(b), F.coalesce(b, F.lit("")))), lambda k, v: v.isNotNull())
