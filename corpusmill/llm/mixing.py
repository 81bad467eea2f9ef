"""Mixing sources to target weights, scheduled fairly.

Sizes are tokens of ``text`` by a public tokenizer, whose vocabulary file is a parameter. The total wanted is that of the corpus. A source
gives its share of it, but no more than its tokens times its cap on repeats; what a capped source cannot give is shared among the others in
proportion to their targets (water filling), so the total holds as long as the caps allow it. Documents of a source without a target are
not used. A source's amount is whole passes over all its records and one partial pass over the first records of a hashed order, cut where
its sum is nearest the amount, so a record is used k or k + 1 times and never beyond the cap.

The mix is interleaved by Pfair scheduling. Each source's stream is cut into ``blocks`` in all, in proportion to its amount; block j of a
source of weight w has release floor((j-1)/w) and deadline ceil(j/w), and in every slot the released block with the earliest deadline runs
(ties by the successor bit, then by source). At each slot every source is less than one block from its share.

Prefix sums run in two levels (sums of hashed buckets, then inside a bucket), so a source with a third of all rows is no single task. The
driver holds one row per source and the schedule of at most ``blocks`` slots.

Null and empty texts have no tokens and no use; a null source has no target. Repeated rows of a document count once. Ties in the hashed
order fall to the doc_id.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stage_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern published with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = 4096
#: Rows a bucket of the prefix sums has on average, and characters encoded at once.
BUCKET, SPAN = 20_000, 50_000


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in spans of about ``size`` characters that end before a blank where there is one, so that no call is quadratic."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            blank = max(text.rfind(" ", at + size // 2, end), text.rfind("\n", at + size // 2, end))
            end = blank if blank > at else end
        yield text[at:end]
        at = end


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    enc = _encoder(path)
    return [sum(len(enc.encode_ordinary(s)) for s in spans(t)) if t else 0 for t in texts]


def _sizes(path: str):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens(b.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return sizes


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), each document once; written once, since every later step reads it."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(_sizes(path), "doc_id bigint, source string, tokens bigint")
    return stage_table(rows.groupBy("doc_id").agg(F.min_by("source", F.struct("source", "tokens")).alias("source"), F.max("tokens").alias("tokens")))


def amounts(total: int, have: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens wanted of each source: its share of the total within its cap, the rest shared on in proportion."""
    cap = {s: have.get(s, 0) * repeats for s, (_, repeats) in targets.items()}
    open_ = {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}
    out = dict.fromkeys(targets, 0.0)
    left = float(total)
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= cap[s]}
        if not full:
            return out | {s: left * targets[s][0] / weight for s in open_}
        for s in full:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One row per target source: target, cap, tokens at hand, tokens wanted, whole passes and the rest."""
    have = {r["source"]: r["n"] or 0 for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(targets.select("source").distinct()), "source").collect()}  # one row per target
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    goals = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.filter("source is not null").collect()}
    want = amounts(total, have, goals)
    out = []
    for s in sorted(goals):
        n = have.get(s, 0)
        passes = min(goals[s][1], int(want[s] / n + 1e-9)) if n else 0
        out.append({"source": s, "target_share": goals[s][0], "max_repeats": goals[s][1], "own": n, "wanted": want[s], "passes": passes, "rest": max(0.0, want[s] - passes * n) if passes < goals[s][1] else 0.0})
    return out


PLAN = "source string, target_share double, max_repeats int, own bigint, wanted double, passes int, rest double"


def uses(sizes: DataFrame, rows: list[dict]) -> DataFrame:
    """(doc_id, source, tokens, first, uses): each record of a target source, where it starts in its source's hashed order, and how often
    it is used."""
    spark = sizes.sparkSession
    steps = F.broadcast(spark.createDataFrame([tuple(r.values()) for r in rows], PLAN))  # one row per target source
    buckets = max(16, ceil(sizes.count() / BUCKET))
    hashed = sizes.filter("tokens > 0").join(steps, "source").withColumn("h", F.xxhash64("doc_id"))
    hashed = hashed.withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(before, ["source", "bucket"]).withColumn("first", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    extra = (F.col("first") + F.col("tokens") / 2.0 <= F.col("rest")).cast("int")
    return placed.withColumn("uses", F.least(F.col("passes") + extra, F.col("max_repeats"))).select("doc_id", "source", "tokens", "first", "uses")


def schedule(weights: dict[str, int], blocks: int) -> list[tuple[int, str, int, int, int]]:
    """(slot, source, block, release, deadline): Pfair slots by earliest deadline for sources of ``weights[s]`` blocks in ``blocks`` slots."""
    share = {s: Fraction(n, blocks) for s, n in weights.items() if n}

    def window(s: str, j: int) -> tuple[int, int]:
        return int((j - 1) / share[s]), ceil(Fraction(j) / share[s])

    waiting, ready, out = [], [], []
    for s in share:
        heapq.heappush(waiting, (0, s, 1))
    for slot in range(blocks):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = window(s, j)[1]
            overlap = int((Fraction(j) / share[s]).denominator != 1)  # the successor bit: this window overlaps the next
            heapq.heappush(ready, (due, -overlap, s, j))
        if not ready:
            continue
        due, _, s, j = heapq.heappop(ready)
        out.append((slot, s, j, window(s, j)[0], due))
        if j < weights[s]:
            heapq.heappush(waiting, (max(slot + 1, window(s, j + 1)[0]), s, j + 1))
    return out


def block_counts(tokens: dict[str, int], blocks: int) -> dict[str, int]:
    """Blocks of each source in proportion to its tokens, by largest remainders; they add up to ``blocks``."""
    total = sum(tokens.values())
    if not total:
        return {}
    exact = {s: Fraction(n * blocks, total) for s, n in tokens.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: blocks - sum(out.values())]:
        out[s] += 1
    return out


def _given(used: DataFrame) -> dict[str, int]:
    return {r["source"]: int(r["n"]) for r in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect() if r["n"]}  # one row a source


def scheduled(used: DataFrame, rows: list[dict], blocks: int = BLOCKS) -> tuple[DataFrame, list[tuple[int, str, int, int, int]]]:
    """(doc_id, source, tokens, uses, blocks, slots) and the schedule: for each use of a record, pass by pass, the block of its source's stream in which
    it starts and the slot at which the earliest deadline runs that block. The slots of all sources are at most ``blocks`` numbers and are sent along, so
    placing the records moves none of them."""
    given = _given(used)
    counts = block_counts(given, min(blocks, max(1, sum(given.values()))))
    slots = schedule(counts, sum(counts.values()))
    at: dict[str, list[int]] = {s: [0] * n for s, n in counts.items()}
    for slot, s, j, _, _ in slots:
        at[s][j - 1] = slot
    table = [(r["source"], r["own"], given[r["source"]], at[r["source"]]) for r in rows if counts.get(r["source"])]
    size = F.broadcast(used.sparkSession.createDataFrame(table, "source string, own bigint, given bigint, at array<int>"))
    start = lambda k: k * F.col("own") + F.col("first")
    block = lambda k: F.least(F.size("at"), (F.floor(start(k) * F.size("at") / F.col("given")) + 1).cast("int"))
    none = F.array().cast("array<int>")
    each = used.join(size, "source", "left").withColumn("blocks", F.when((F.col("uses") > 0) & F.col("at").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("uses") - 1), block)).otherwise(none))
    return each.select("doc_id", "source", "tokens", "uses", "blocks", F.transform("blocks", lambda b: F.element_at("at", b)).alias("slots")), slots


def interleave(used: DataFrame, rows: list[dict], blocks: int = BLOCKS) -> DataFrame:
    """(slot, source, block, release, deadline, uses, tokens): the schedule and what starts in each block of a source's stream of passes."""
    spark: SparkSession = used.sparkSession
    placed, slots = scheduled(used, rows, blocks)
    table = spark.createDataFrame(slots, "slot int, source string, block int, release int, deadline int")
    filled = placed.select("source", "tokens", F.explode("blocks").alias("block")).groupBy("source", "block").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    return table.join(filled, ["source", "block"], "left").select("slot", "source", "block", "release", "deadline", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def shares(used: DataFrame, rows: list[dict]) -> DataFrame:
    """One row per target source: target and actual share, tokens, records, uses."""
    spark = used.sparkSession
    goal = spark.createDataFrame([tuple(r.values()) for r in rows], PLAN)
    given = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.sum((F.col("uses") > 0).cast("int")).alias("records"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    all_ = Window.partitionBy(F.lit(1))  # one row per target source
    zero = F.lit(0)
    out = goal.join(given, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", zero).alias("most_uses"))
    return out.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(all_), F.lit(0)))
