"""Tables of Parquet files that change by buckets and never show a half-written state.

A table is a folder with one folder of files per write and the file ``_current``, which names for each bucket of rows the write that holds it. A
change writes the buckets it touches into a new folder and then replaces ``_current`` in one step (a rename over the old file where the file
system has one, else the overwriting of a single small object). A reader takes the names from ``_current``, so it sees the rows before a change or
those after it; a write that fails before the last step leaves the table as it was. Folders that neither the present state nor the one before
it names are removed, so a reader that began before a change can end. A table has one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
CURRENT = "_current"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def state(spark: SparkSession, path: str) -> dict | None:
    """What ``_current`` says, None where there is no table."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path, CURRENT)):
        return None
    stream = fs.open(at(path, CURRENT))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The rows of the table, or of some of its buckets."""
    now = state(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = StructType.fromJson(now["schema"])
    folders = [f"{path}/{write}/_bucket={b}" for b, write in now["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that rows fall into; at most ``buckets`` numbers."""
    return [r[0] for r in rows.select(bucket(key, buckets)).distinct().collect()]


def write(rows: DataFrame, path: str, key: str, replaced: list[int] | None = None, buckets: int = BUCKETS) -> None:
    """Puts ``rows`` in the place of the buckets ``replaced`` (None: of all). Every row must fall into one of these."""
    spark = rows.sparkSession
    before = state(spark, path)
    n = before["n"] if before else buckets
    name = f"w{uuid.uuid4().hex}"
    placed = rows.withColumn("_bucket", bucket(key, n))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    fs, at = _fs(spark, path)
    new = {s.getPath().getName().split("=")[1]: name for s in fs.listStatus(at(path, name)) if "=" in s.getPath().getName()}
    gone = None if replaced is None else {str(b) for b in replaced}
    if gone is not None and not set(new) <= gone:
        raise ValueError(f"rows of buckets that are not replaced: {sorted(set(new) - gone)}")
    kept = {b: w for b, w in (before["buckets"] if before else {}).items() if gone is not None and b not in gone}
    _point(spark, path, {"n": n, "key": key, "schema": json.loads(rows.schema.json()), "buckets": kept | new, "before": sorted(set(before["buckets"].values())) if before else []})
    alive = {*kept.values(), name, *(before["buckets"].values() if before else ())}
    for s in fs.listStatus(at(path)):
        if s.isDirectory() and s.getPath().getName().startswith("w") and s.getPath().getName() not in alive:
            fs.delete(s.getPath(), True)


def _point(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    fs, at = _fs(spark, path)
    new = at(path, f"_new-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(at(path, CURRENT)), over)
