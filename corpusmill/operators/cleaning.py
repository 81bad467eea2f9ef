"""Cleaning of parsed items: five rules in a fixed order.

1 characters, 2 white space, 3 headers and footers (a short text on many pages), 4 neighbours that repeat each other, 5 short lines joined and
bare page numbers dropped. Rules 1 to 3 are expressions and aggregates. What rules 4 and 5 ask of a single item is computed as columns too
(``traits``); only the part that depends on what was kept before is a walk in order, over those columns.

Decisions where the known behaviour is a defect: items that clean to nothing are dropped first, punctuation-only texts have no key and are
never equal, and only texts (not tables or images) are compared by similarity.
"""

from __future__ import annotations

import difflib
import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .folds import ordered

SHORT_LINE = 30
LONGEST_FURNITURE, LEAST_PAGES, PAGE_SHARE = 50, 3, 0.6
#: Neighbours at least so long and so alike are one.
LEAST_ALIKE, ALIKE = 20, 0.95
#: The longest text that is taken for a caption.
CAPTION = 60
COLUMNS = ("doc_id", "pos", "type", "text", "heading_path", "page_no", "level", "image_path")
ITEM = "doc_id string, pos int, type string, text string, heading_path string, page_no int, level int, image_path string"


def once(items: DataFrame) -> DataFrame:
    """Each item once, whatever was delivered again."""
    return items.dropDuplicates(["doc_id", "pos"])


def characters(items: DataFrame) -> DataFrame:
    """Rules 1 and 2, with the counts and warnings they give."""
    cleaned = T.clean_chars(F.col("text"))
    return (
        items.withColumn("cleaned", cleaned)
        .withColumn("removed", F.length("text") - F.length("cleaned"))
        .withColumn("font_warning", T.private_use_share(F.col("text")) > 0.10)
        .withColumn("decode_warning", T.replacement_share(F.col("cleaned")) > 0.01)
        .withColumn("text", F.when(F.col("type") == "table", T.table_text(F.col("cleaned"))).otherwise(T.clean_space(F.col("cleaned"))))
        .drop("cleaned")
    )


def furniture(items: DataFrame) -> DataFrame:
    """(doc_id, pos) of headers and footers: a short text, no heading, on 60 % of the document's pages and three at least."""
    keyed = items.filter("type = 'text' and level is null").withColumn("key", T.furniture_key(F.col("text"))).filter(f"key <> '' and length(key) <= {LONGEST_FURNITURE}")
    pages = items.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    hits = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page_no").alias("hit")).join(pages, "doc_id")
    repeated = hits.filter(F.col("hit") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * PAGE_SHARE))).select("doc_id", "key")
    return keyed.join(repeated, ["doc_id", "key"], "left_semi").select("doc_id", "pos")


def traits(items: DataFrame) -> DataFrame:
    """Items with what rules 4 and 5 ask of each alone: ``twin`` (equal numbers are repeats; null: never), ``fuzzy`` (compared by similarity),
    ``bare`` (a page number), ``tail`` (short enough to go on from the item before), ``flow`` (equal numbers: one flow of text; null: none) and
    ``glue`` (what stands between this text and its continuation)."""
    body = F.col("level").isNull()
    prose = body & (F.col("type") == "text")
    letters = T.letters_key(F.col("text"))
    return items.select(
        *COLUMNS,
        F.when(body & (letters != ""), F.xxhash64("type", letters)).alias("twin"),
        (prose & (F.length("text") >= LEAST_ALIKE)).alias("fuzzy"),
        (prose & T.is_page_number(F.col("text"))).alias("bare"),
        (prose & (F.length("text") < SHORT_LINE)).alias("tail"),
        F.when(prose & F.col("heading_path").isNotNull(), F.xxhash64("heading_path")).alias("flow"),
        F.when(F.col("text").rlike("[A-Za-z0-9]$"), " ").otherwise("").alias("glue"),
    )


def alike(a: str, b: str) -> bool:
    """Whether the matching blocks of two texts make up ``ALIKE`` of them; cheap upper bounds come first."""
    if 2 * min(len(a), len(b)) < ALIKE * (len(a) + len(b)):
        return False
    m = difflib.SequenceMatcher(None, a, b)
    return m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


class Repeats:
    """Rule 4 as a state: the last two items that stayed."""

    def __init__(self) -> None:
        self.stayed: deque[tuple[int | None, str | None]] = deque(maxlen=2)
        self.dropped = 0

    def __call__(self, item: tuple) -> bool:
        """Whether an item repeats one of them; if not, it takes its place among them."""
        text = item.text if item.fuzzy else None
        for twin, other in self.stayed:
            if twin is not None and twin == item.twin or text is not None and other is not None and alike(other, text):
                self.dropped += 1
                return True
        self.stayed.append((item.twin, text))
        return False


def tidy(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rules 4 and 5 over one document's ``traits`` in order: (first item of the flow, its whole text, lines joined, and on the document's last
    result the repeats and page numbers dropped)."""
    repeats, numbers = Repeats(), 0
    first, parts, glue = None, [], ""
    for item in rows:
        if repeats(item):
            continue
        if item.bare:
            numbers += 1
        elif first is not None and item.tail and item.flow is not None and item.flow == first.flow:
            parts += (glue, item.text)
            glue = item.glue
        else:
            if first is not None:
                yield first, "".join(parts), len(parts) // 2, None, None
            first, parts, glue = item, [item.text], item.glue
    if first is not None:
        yield first, "".join(parts), len(parts) // 2, repeats.dropped, numbers


def _tidied(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    for first, text, *counts in tidy(rows):
        yield (*first[:3], text, *first[4:8], *counts)


def _kept(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    seen = Repeats()
    return ((r.doc_id, r.pos, r.type) for r in rows if not seen(r))


def body(items: DataFrame) -> DataFrame:
    """Rules 1 to 3: clean items that are neither empty nor furniture, with their ``traits``."""
    base = characters(once(items))
    return traits(base.filter("text <> ''").join(furniture(base), ["doc_id", "pos"], "left_anti"))


def clean(items: DataFrame) -> DataFrame:
    """All five rules. The document's last item carries its counts of duplicates and page numbers."""
    return ordered(body(items), ["doc_id"], ["pos"], _tidied, ITEM + ", merged int, duplicates int, numbers int")


def adjacent(items: DataFrame, similar: bool = True) -> DataFrame:
    """(doc_id, pos, type) that rule 4 alone keeps: against the last two kept items, so A, B, B, A keeps A, B. Without ``similar`` only equal letters are
    repeats."""
    rows = traits(items)
    return ordered(rows if similar else rows.withColumn("fuzzy", F.lit(False)), ["doc_id"], ["pos"], _kept, "doc_id string, pos int, type string")


def captions(items: DataFrame, most: int = CAPTION) -> DataFrame:
    """(doc_id, pos, image_path, caption) of images: the text just after it, else just before, if that is a short plain text."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    text = T.strip(F.col("text"))
    short = F.when((F.col("type") == "text") & F.col("level").isNull() & text.isNotNull() & (text != "") & (F.length(text) <= most), text)
    rows = items.select("doc_id", "pos", "type", "image_path", short.alias("short"))
    near = rows.withColumn("caption", F.coalesce(F.lead("short").over(w), F.lag("short").over(w)))
    return near.filter("type = 'image'").select("doc_id", "pos", "image_path", "caption")


def stats(items: DataFrame) -> DataFrame:
    """Per document: characters removed, furniture, duplicates, merges, page numbers."""
    base = characters(once(items))
    by = base.groupBy("doc_id").agg(F.sum("removed").alias("removed_chars"), F.max(F.col("font_warning").cast("int")).alias("font_warning"), F.max(F.col("decode_warning").cast("int")).alias("decode_warning"))
    hf = furniture(base).groupBy("doc_id").agg(F.count("*").alias("furniture"))
    done = clean(items).groupBy("doc_id").agg(F.sum("merged").alias("merged"), F.sum("duplicates").alias("duplicates"), F.sum("numbers").alias("page_numbers"))
    return by.join(hf, "doc_id", "left").join(done, "doc_id", "left").fillna(0, ["furniture", "merged", "duplicates", "page_numbers"])


def least_pages(pages: int) -> int:
    """How many pages a text must stand on to be furniture."""
    return max(LEAST_PAGES, math.ceil(PAGE_SHARE * pages))
