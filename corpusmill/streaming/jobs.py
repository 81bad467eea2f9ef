"""Structured Streaming: event framing, task batches, incremental ingest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus
from ..operators.folds import ordered
from ..session import stage_table


# Kinds of events; a frame's kind is the first key of its object.
KINDS = ("token", "route", "interrupt", "usage", "error")


class Framer:
    """Server-sent events out of text that arrives in pieces: frames end at an empty line, what follows the last one is kept for the next piece."""

    def __init__(self, rest: str = "") -> None:
        self.rest = rest

    def feed(self, text: str | None) -> Iterator[tuple[str, str | None, bool]]:
        """(kind, value, bad) of each frame that the piece ends and that has data; comments and heartbeats have none."""
        *frames, self.rest = (self.rest + (text or "")).replace("\r\n", "\n").split("\n\n")
        for frame in frames:
            data = [x[5:].removeprefix(" ") for x in frame.split("\n") if x.startswith("data:")]
            if data:
                yield self.parsed("\n".join(data))

    @staticmethod
    def parsed(data: str) -> tuple[str, str | None, bool]:
        try:
            kind, value = next(iter(json.loads(data).items()))
        except (ValueError, AttributeError, StopIteration):  # no JSON, no object, an empty one
            return "unknown", None, True
        return kind if kind in KINDS else "unknown", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), False


FRAME = "stream string, k int, type string, value string, bad boolean"


def frames(chunks: DataFrame) -> DataFrame:
    """The frames of text pieces ``(stream, n, text)``, numbered within their stream; a frame may be cut anywhere between pieces. A stream's text is walked
    in order and only its unfinished frame is held."""

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        framer, k = Framer(), 0
        for r in rows:
            for frame in framer.feed(r.text):
                yield key[0], k, *frame
                k += 1

    return ordered(chunks.select("stream", "n", "text"), ["stream"], ["n"], walk, FRAME)


def _frame(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, k = state.get if state.exists else ("", 0)
    framer = Framer(rest)
    for rows in _in_order(batches):
        out = [(key[0], *f) for text in rows["text"] for f in framer.feed(text)]
        yield pd.DataFrame([(s, k + i, *f) for i, (s, *f) in enumerate(out)], columns=["stream", "k", "type", "value", "bad"])
        k += len(out)
    state.update((framer.rest, k))


def live_frames(chunks: DataFrame) -> DataFrame:
    """The same of a stream of pieces; the state is a stream's unfinished frame and its count."""
    return chunks.groupBy("stream").applyInPandasWithState(_frame, FRAME, "rest string, k int", "append", GroupStateTimeout.NoTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's rows of one trigger by ``n``. They arrive in Arrow batches of a bounded size; only where these overlap are they put together."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b.sort_values("n")
        if held is not None and held["n"].iloc[-1] > b["n"].iloc[0]:
            held = pd.concat([held, b]).sort_values("n")
            continue
        if held is not None:
            yield held
        held = b
    if held is not None:
        yield held


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_, done = state.get if state.exists else (0, 0)
    for rows in _in_order(batches):
        submits = rows["kind"].eq("submit").to_numpy()
        level = open_ + np.cumsum(np.where(submits, 1, -1))
        ends = rows["n"].to_numpy()[(level == 0) & ~submits]
        yield pd.DataFrame({"thread": key[0], "n": ends.astype("int64"), "batch": np.arange(done + 1, done + 1 + len(ends), dtype="int32")})
        open_, done = int(level[-1]), done + len(ends)
    state.update((open_, done))


def batch_completion(tasks: DataFrame) -> DataFrame:
    """A stream of ``(thread, n, kind)`` to one row whenever a thread's open tasks return to zero. The state is two numbers a thread."""
    return tasks.groupBy("thread").applyInPandasWithState(_count, "thread string, n bigint, batch int", "open int, done int", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window in event time; an extension, since nothing of the kind is among the operators."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def ingest(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of chunk rows into a table at ``path``: in each batch a source's old rows are replaced and texts beyond the byte limit are left out; only
    the buckets a batch touches are written, and they take effect at once, so a batch repeated after a failure gives the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        new = stage_table(corpus.fit(batch.dropDuplicates(["chunk_id"]))[0])
        if not new.isEmpty():
            corpus.store(new, path)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def outcome(query: Any) -> None:
    """Runs a stream over what is there and stops."""
    query.processAllAvailable()
    query.stop()
