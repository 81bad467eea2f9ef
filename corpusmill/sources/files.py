"""Files as rows: listing, JSON lines with line numbers, test sets, binary content."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TESTSET = ("question_id", "question", "ground_truth", "question_type", "source_doc", "reviewed", "notes")


def _listed(spark: SparkSession, path: str) -> Iterator[tuple[str, str | None]]:
    """(file, folder it was found under) as the path's own file system lists them; a path that is no folder is given as it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    at = fs.makeQualified(at)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        yield at.toString(), None
        return
    found = fs.listFiles(at, True)
    while found.hasNext():
        yield found.next().getPath().toString(), at.toString()


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, source) of the files named or below the folders named, in order of path. A file below a folder has its path inside it as source, other
    files their name. Hidden files and folders are left out, names that start with _ are not (Spark's own readers drop these). A file reached twice is
    listed once, from the path named first; a missing file stays, so that reading it gives an error row."""
    found = [(k, f, under) for k, p in enumerate(paths) for f, under in _listed(spark, p)]
    rows = spark.createDataFrame(found, "k int, path string, under string")
    source = F.when(F.col("under").isNull(), F.substring_index("path", "/", -1)).otherwise(F.expr("substring(path, length(rtrim('/', under)) + 2)"))
    shown = rows.withColumn("source", source).filter(F.col("under").isNull() | ~F.col("source").rlike(r"(^|/)\."))
    return shown.groupBy("path").agg(F.min_by("source", "k").alias("source")).orderBy("path")


def binary(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder with their content and content id. Spark leaves out names that start with _ or a dot; ``listing`` only the latter."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "length", "content", F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, line, row, problem)``: each non-blank line with its number in its file. Files are read in splits like any text; a split's lines are numbered
    within it, and what comes before it is the sum of the line counts of the splits before, one row a split."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    splits = text.groupBy("file", "split").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = text.filter("trim(value) <> ''").join(splits.select("file", "split", (before - F.col("first")).alias("shift")), ["file", "split"])
    line = F.col("n") + F.col("shift") + 1
    problem = F.when(F.try_parse_json("value").isNull(), F.concat(F.lit("line "), line.cast("string"), F.lit(": no JSON")))
    return lines.select("file", line.alias("line"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), problem.alias("problem"))


def test_set(rows: DataFrame) -> DataFrame:
    """The rows of a test set with what is wrong with each; an empty set is an error."""
    missing = [c for c in TESTSET if c not in rows.columns]
    if missing:
        raise ValueError(f"a test set needs {missing}")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return rows.select(*TESTSET, F.when(blank("question"), "no question").when(blank("ground_truth"), "no answer").alias("problem"))


def write_json_lines(rows: DataFrame | list[dict], path: str) -> int:
    """Rows as JSON lines: a frame to a folder of part files, in place of what was there; a small list of the driver's to one new file."""
    if isinstance(rows, DataFrame):
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return rows.sparkSession.read.text(path).count()
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return len(rows)


@dataclass(frozen=True)
class Settings:
    """Ingest and search settings; never read inside a task."""

    parent_chars: int = 1500
    child_chars: int = 450
    overlap_chars: int = 50
    short_line: int = 30
    top_k: int = 5
    depth: int = 20
    rrf_k: int = 60

    @classmethod
    def read(cls, env: dict[str, str], prefix: str = "CORPUSMILL_") -> Settings:
        """From a mapping of strings; a blank value is the default, a value that is no number an error that names it."""
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if raw:
                try:
                    given[f.name] = int(raw)
                except ValueError:
                    raise ValueError(f"{prefix}{f.name.upper()} must be a whole number, not {raw!r}") from None
        return cls(**given)
