"""Parents and children from items, in one ordered pass per document.

A parent is a run of units of one section: it closes at a heading of the same or a shallower level, before a unit that would pass the upper
bound, and at tables and images, which are parents of their own. A run of headings alone goes to the block after it. Children are cut from a
parent's body at the coarsest separator that fits, separators stay with the piece before them, and each child but the first starts with
the tail of the one before, aligned to a sentence end where one is near.

The pass numbers the units by the block they open or go on, groups them by that number and cuts each block; with ``cleaning.tidy`` before it in
the same walk, raw items become chunks in one shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby, tee
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import cleaning
from .folds import ordered

TARGET, CHILD, OVERLAP, TOLERANCE = 1500, 450, 50, 10
LOW, HIGH = round(TARGET * 0.8), round(TARGET * 1.2)
GAP = "\n\n"
# Separators from coarse to fine, signs that stay with the piece before them, and what ends a sentence.
SEPARATORS = ("\n\n", "\n", "。！？；")
_STAYS = re.compile(r"^[。！？；…\n」』”）)\]】\"]+")
_SENTENCE = re.compile(r"[。！？；…]+[」』”）)\]】\"]*")
CHUNK = "chunk_id string, text string, parent_id string, doc_id string, page_no int, heading_path string, chunk_type string, char_len int, image_path string"


_CUTS = tuple(re.compile(p) for p in (r"(?<=\n\n)", r"(?<=\n)", rf"(?<=[{SEPARATORS[2]}])(?![」』”）)\]】\"])"))


def _atoms(text: str, level: int) -> list[str]:
    """The text cut behind each separator of a level; a closing quote stays with its sentence."""
    return [p for p in _CUTS[level].split(text) if p]


def _fit(text: str, size: int, level: int = 0) -> Iterator[str]:
    """Pieces of at most ``size`` characters that join to the text."""
    if len(text) <= size:
        yield text
        return
    if level == len(SEPARATORS):
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    run = ""
    for atom in _atoms(text, level):
        if len(run) + len(atom) <= size:
            run += atom
            continue
        if run:
            yield run
        run = ""
        if len(atom) > size:
            *whole, run = _fit(atom, size, level + 1)
            yield from whole
        else:
            run = atom
    if run:
        yield run


def pieces(body: str, size: int) -> list[tuple[str, int]]:
    """(piece without blank ends, its start in the body); no piece starts with what ends a sentence."""
    out: list[tuple[str, int]] = []
    at = 0
    for raw in _fit(body, size):
        start, text = at, raw
        at += len(raw)
        if out and (m := _STAYS.match(text)):
            out[-1] = (out[-1][0] + m[0].strip("\n"), out[-1][1])
            start, text = start + m.end(), text[m.end() :]
        lead = len(text) - len(text.lstrip())
        if text.strip():
            out.append((text.strip(), start + lead))
    return out


def tail(prev: str, overlap: int = OVERLAP) -> str:
    """The end of a piece that the next one repeats: its last ``overlap`` characters, from the first sentence end if that lies within
    ``TOLERANCE`` of their start; nothing of a piece that short."""
    if not 0 < overlap < len(prev):
        return ""
    window = prev[-overlap:]
    end = _SENTENCE.search(window)
    return (window[end.end() :] if end and end.end() <= TOLERANCE else window).strip()


class Unit(NamedTuple):
    """What is cut: a clean item."""

    type: str
    text: str
    heading_path: str | None
    page_no: int | None
    level: int | None
    image_path: str | None

    @property
    def alone(self) -> bool:
        return self.level is None and self.type in ("table", "image")


def page_at(starts: list[tuple[int, int | None]], pos: int) -> int | None:
    """The page of the last unit that starts at or before a position."""
    at = bisect_right(starts, pos, key=lambda s: s[0])
    return starts[at - 1][1] if at else None


def numbered(units: Iterable[Unit], high: int = HIGH) -> Iterator[tuple[int, Unit]]:
    """Units with the number of their block. A heading opens one unless it is deeper than the heading before it, a unit that stands alone opens
    and seals one, other units open one where the block would pass ``high``."""
    block, filled, sealed, depth = 0, 0, True, None
    for u in units:
        if not u.text:
            continue
        if u.level is not None:
            fresh = sealed or depth is None or u.level <= depth
            depth = u.level
        else:
            fresh = sealed or u.alone or filled + len(u.text) > high
        block, filled, sealed = block + fresh, len(u.text) + (0 if fresh else filled), u.alone
        yield block, u


def blocks(units: Iterable[Unit], high: int = HIGH) -> Iterator[list[Unit]]:
    """Runs of units that make parents. Headings alone are held until a block comes that does not begin with a heading of its own."""
    held: list[Unit] = []
    for _, run in groupby(numbered(units, high), lambda x: x[0]):
        block = [u for _, u in run]
        title_only = all(u.level is not None for u in block)
        if held and (title_only or block[0].level is not None):
            yield held
            held = []
        held = held + block
        if not title_only:
            yield held
            held = []
    if held:
        yield held


def chunks_of(doc_id: str, units: Iterable[Unit], child: int = CHILD, high: int = HIGH, overlap: int = OVERLAP) -> Iterator[tuple]:
    """Parents and their children in order, as rows of ``CHUNK``."""
    n = 0
    for block in blocks(units, high):
        titles, body = [u.text for u in block if u.level is not None], [u for u in block if u.level is None]
        first, head = block[0], GAP.join(titles)
        kind = body[0].type if len(body) == 1 and body[0].alone else "text"
        path = first.heading_path if first.level is None else " > ".join(x for x in (first.heading_path, first.text) if x)
        image = body[0].image_path if kind == "image" else None
        starts, at = [], 0
        for u in body:
            starts.append((at, u.page_no))
            at += len(u.text) + len(GAP)
        core = GAP.join(u.text for u in body)
        page_of = lambda pos, s=starts, f=first: page_at(s, pos) if s else f.page_no
        over = kind == "text" and len(body) == 1 and len(core) > high
        for k, (part, offset) in enumerate(pieces(core, max(high - len(head) - len(GAP), 1)) if over else [(core, 0)]):
            n += 1
            pid, title = f"{doc_id}:p{n:03d}", head if k == 0 else ""
            row = lambda id_, text, parent, page: (id_, text, parent, doc_id, page, path, kind, len(text), image)
            yield row(pid, GAP.join(filter(None, (title, part))), "", page_of(offset))
            cut = pieces(part, child) if kind == "text" and part else [(part, 0)]
            shown = [(tail(cut[i - 1][0], overlap) if i and kind == "text" else "") + p for i, (p, _) in enumerate(cut)]
            shown[0] = GAP.join(filter(None, (title, shown[0])))
            for c, (text, (_, start)) in enumerate(((t, x) for t, x in zip(shown, cut) if t), 1):
                yield row(f"{pid}:c{c:03d}", text, pid, page_of(offset + start))


def split(items: DataFrame) -> DataFrame:
    """Parents and children of every document, from clean items."""
    fields = list(Unit._fields)
    return ordered(items.select("doc_id", "pos", *fields), ["doc_id"], ["pos"], lambda key, rows: chunks_of(key[0], (Unit(*r[2:]) for r in rows)), CHUNK)


def cleaned(items: DataFrame) -> DataFrame:
    """Parents and children of every document, from raw items: cleaning and cutting in one walk."""

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        return chunks_of(key[0], (Unit(f.type, text, f.heading_path, f.page_no, f.level, f.image_path) for f, text, *_ in cleaning.tidy(rows)))

    return ordered(cleaning.body(items), ["doc_id"], ["pos"], walk, CHUNK)


def placed(items: DataFrame, high: int = HIGH) -> DataFrame:
    """(doc_id, pos, block, parent): the number of the block that each item with text opens or goes on, and of the parent it goes into."""

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        mine, again = tee((r.pos, Unit(*r[2:])) for r in rows if r.text)
        numbers = (n for n, _ in numbered((u for _, u in mine), high))
        places, fed = tee(again)
        for parent, block in enumerate(blocks((u for _, u in fed), high), 1):
            for _ in block:
                yield key[0], next(places)[0], next(numbers), parent

    return ordered(items.select("doc_id", "pos", *Unit._fields), ["doc_id"], ["pos"], walk, "doc_id string, pos int, block int, parent int")


def heading_paths(items: DataFrame) -> DataFrame:
    """The breadcrumb above each item, from headings and their levels: for each level the last title, forgotten at a shallower heading. A
    heading's own path is without itself."""

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        trail: dict[int, str] = {}
        for r in rows:
            if r.level is not None:
                trail = {lv: t for lv, t in trail.items() if lv < r.level}
            yield r.doc_id, r.pos, " > ".join(trail.values())
            if r.level is not None:
                trail[r.level] = r.text

    return ordered(items.select("doc_id", "pos", "level", "text"), ["doc_id"], ["pos"], walk, "doc_id string, pos int, path string")


def offsets(items: DataFrame) -> DataFrame:
    """Where each item starts if a document's texts are joined by an empty line."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return items.select("doc_id", "pos", "page_no", F.coalesce(F.sum(F.length("text") + len(GAP)).over(w), F.lit(0)).alias("start_pos"))


def pages_at(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, page): the page of each position ``wanted(doc_id, at)`` in a document's joined text: that of the last unit that starts at or before
    it, null if that unit has none, even where an earlier one has. Positions before the first unit are left out."""
    units = offsets(items).select("doc_id", F.col("start_pos").alias("at"), F.struct("page_no", "pos").alias("unit"), F.lit(0).alias("kind"))
    asked = wanted.select("doc_id", F.col("at").cast("bigint").alias("at")).distinct().withColumns({"unit": F.lit(None).cast("struct<page_no:int,pos:int>"), "kind": F.lit(1)})
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "unit.pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.unionByName(asked).withColumn("last", F.last("unit", ignorenulls=True).over(w))
    return rows.filter("kind = 1 and last is not null").select("doc_id", "at", F.col("last.page_no").alias("page"))


def tails(texts: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(id, tail) of ``texts(id, text)``: what the piece after each would begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([tail(t, overlap) if t is not None else None for t in b.column("text").to_pylist()], pa.string())], names=["id", "tail"])

    return texts.select("id", "text").mapInArrow(run, "id string, tail string")
