"""Splitting oversized items at natural boundaries by content-defined chunking.

A gear rolling hash runs over the text. From each cut the next landmark is the position of the largest hash among those the limits allow,
so it depends only on the content near it; it snaps to the nearest natural boundary (paragraph, line, sentence, clause, blank) inside the
limits. An edit therefore moves the cuts next to it, and the later cuts fall where they fell before. Without any boundary inside the limits
the cut is made at the landmark itself, never inside a combining sequence.

Piece ``i`` starts ``overlap`` characters before the end of piece ``i - 1`` (fewer only where the limit is below twice the overlap), and no
piece, overlap included, is longer than the limit. The pieces without their overlaps, joined, give the text exactly.

Rows with a null text, or whose tier and type have no limit, are no items to cut and give no rows; an item within the limit is one piece.
Repeated rows count once. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import mix, points

#: Share of the room after the overlap that a piece has at least.
LEAST = 0.5
#: Natural boundaries, the strongest first: the cut follows the match.
BOUNDARIES = tuple(re.compile(p) for p in (r"\n[ \t]*\n+", r"\n+", r"[。！？!?；;][”’」』\"')）]*|\.[”\"')]*(?=\s)", r"[，、,：:](?=\D)", r"\s+"))
#: How much nearer to the landmark a weaker boundary must be to win over the next stronger one, as a share of the allowed span.
PULL = 0.35
_GEAR = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPAN = 24


def rolling(text: str) -> np.ndarray:
    """The gear hash at each position: position ``i`` depends on the ``_SPAN`` characters before it and on nothing else."""
    g = _GEAR[points(text) & 0xFFFF]
    h = np.zeros(len(g), np.uint64)
    for j in range(min(_SPAN, len(g))):
        h[j:] += g[: len(g) - j] << np.uint64(j)
    return mix(h)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Ends of the pieces' own parts, in order, with the kind of boundary at each ('end' for the last)."""
    overlap = min(overlap, limit // 2)
    out: list[tuple[int, str]] = []
    n, start = len(text), 0
    if n <= limit:
        return [(n, "end")]
    h = rolling(text)
    marks = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in BOUNDARIES]
    while True:
        room = limit - (overlap if start else 0)
        if n - start <= room:
            return [*out, (n, "end")]
        low, high = start + max(1, int(room * LEAST)), start + room
        mark = low + int(np.argmax(h[low - 1 : high]))
        best, kind, cost = -1, "hard", float("inf")
        for k, ends in enumerate(marks):
            near = ends[np.searchsorted(ends, low) : np.searchsorted(ends, high, "right")]
            if len(near):
                at = int(near[np.argmin(np.abs(near - mark))])
                c = abs(at - mark) + k * PULL * (high - low)
                if c < cost:
                    best, kind, cost = at, ("paragraph", "line", "sentence", "clause", "blank")[k], c
        if best < 0:
            best = mark
            while best > low and unicodedata.combining(text[best]):
                best -= 1
        out.append((best, kind))
        start = best


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece; consecutive pieces share the overlap."""
    overlap = min(overlap, limit // 2)
    out, start = [], 0
    for end, kind in cuts(text, limit, overlap):
        out.append((max(0, start - (overlap if start else 0)), end, kind))
        start = end
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = {k: [] for k in ("chunk_id", "heading_path", "piece_no", "n_pieces", "start_pos", "end_pos", "boundary", "text")}
        for id_, path, text, limit, overlap in zip(*(b.column(n).to_pylist() for n in ("chunk_id", "heading_path", "text", "max_chars", "overlap_chars"))):
            found = pieces_of(text, max(1, limit), max(0, overlap or 0))
            for i, (a, z, kind) in enumerate(found):
                for k, v in zip(rows, (id_, path, i, len(found), a, z, kind, text[a:z])):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[k], t) for k, t in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=list(rows)
        )


SCHEMA = "chunk_id string, heading_path string, piece_no int, n_pieces int, start_pos bigint, end_pos bigint, boundary string, text string"


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct chunks whose text, measured now, exceeds their limit. ``limits`` has one row per tier and type, so it is broadcast."""
    c = chunks.select("chunk_id", "heading_path", "text", "chunk_type", F.when(F.coalesce(F.col("parent_id"), F.lit("")) == "", "parent").otherwise("child").alias("tier"))
    return c.join(F.broadcast(limits.filter("max_chars is not null")), ["tier", "chunk_type"]).filter("length(text) > max_chars").dropDuplicates(["chunk_id"])


def split(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk."""
    return oversized(chunks, limits).select("chunk_id", "heading_path", "text", "max_chars", "overlap_chars").mapInArrow(_split, SCHEMA)
