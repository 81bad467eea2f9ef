"""Texts made of structured values, as Column expressions: evidence under a budget, plan snapshots, form values, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as T

# How much evidence one result may show.
ITEMS, ITEM_CHARS, TOTAL_CHARS, SOURCES, TITLE_CHARS, EXCERPT_CHARS = 4, 250, 1200, 5, 80, 600
# The mark of each step status.
MARKS = {"pending": "☐", "running": "▶", "done": "☑", "failed": "✗", "skipped": "⊘"}


def cut(c: Column, most: int = ITEM_CHARS) -> Column:
    """White space collapsed, at most so many characters; null is empty."""
    return F.left(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " ")), F.lit(most))


def first(*cs: Column) -> Column:
    """The first of several strings that is neither null nor empty, else ?."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("?"))


def evidence(hits: Column, results: Column, fetches: Column, facts: Column, sources: Column) -> Column:
    """The evidence and sources of one result. ``hits``: array of (filename, doc_id, seq, content); ``results``: of (title, url, snippet); ``fetches``:
    of (url, excerpt); ``facts``: map, shown in order of key only where there is nothing else; each kind up to ``ITEMS``, all of it up to ``TOTAL_CHARS``. Null arrays
    are empty ones; without evidence and sources the text is empty."""
    none = F.array().cast("array<string>")
    some = lambda c, f: F.coalesce(F.transform(F.slice(c, 1, ITEMS), f), none)
    shown = F.concat(
        some(hits, lambda h: F.concat(F.lit("["), first(h["filename"], h["doc_id"]), F.lit("] #"), F.coalesce(h["seq"].cast("string"), F.lit("?")), F.lit(": "), cut(h["content"]))),
        some(results, lambda r: F.concat(cut(r["title"], TITLE_CHARS), F.lit(" ("), F.coalesce(r["url"], F.lit("")), F.lit("): "), cut(r["snippet"]))),
        some(fetches, lambda f: F.concat(F.lit("page ("), cut(f["url"], TITLE_CHARS), F.lit("): "), cut(f["excerpt"], EXCERPT_CHARS))),
    )
    plain = some(entries(facts), lambda e: F.concat(e["key"], F.lit("="), cut(e["value"])))
    lines = F.when(F.size(shown) > 0, shown).otherwise(plain)
    block = F.left(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    - "), x)), "\n"), F.lit(TOTAL_CHARS))
    named = F.array_join(F.slice(F.coalesce(sources, none), 1, SOURCES), " ")
    return F.concat_ws("\n", F.when(block != "", F.concat(F.lit("  evidence:\n"), block)), F.when(named != "", F.concat(F.lit("  sources: "), named)))


def step_line(status: Column, step_id: Column, title: Column, assignee: Column, digest: Column) -> Column:
    """One step of a plan snapshot; the digest on the same line."""
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), status), F.lit("?"))
    tail = F.when(F.coalesce(digest, F.lit("")) != "", F.concat(F.lit(" — "), F.replace(digest, F.lit("\n"), F.lit(" ")))).otherwise("")
    return F.concat(F.lit("- "), mark, F.lit(" "), step_id, F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(assignee, F.lit("")), F.lit(")"), tail)


def arguments(c: Column) -> Column:
    """A text of arguments, cut at white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+"), lambda x: x != "")


def record(rows: Column) -> Column:
    """An array of (key, value) as a map in order of key: keys trimmed, rows without one left out, of equal keys the last."""
    keyed = F.filter(F.transform(rows, lambda r: F.struct(F.trim(r["key"]).alias("key"), r["value"].alias("value"))), lambda r: F.coalesce(r["key"], F.lit("")) != "")
    last = F.filter(keyed, lambda r, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda s: s["key"] == r["key"]))
    return F.map_from_entries(F.array_sort(last))


def entries(m: Column) -> Column:
    """A map's entries in order of key; none of a null map."""
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def label(tool: Column) -> Column:
    """What names a tool given as JSON: a string is its own name, an object has a name, anything else is shown as it is."""
    quoted = F.from_json(F.concat(F.lit('{"x":'), tool, F.lit("}")), "x string")["x"]
    return F.when(tool.startswith('"'), quoted).when(tool.startswith("{"), F.coalesce(F.nullif(F.get_json_object(tool, "$.name"), F.lit("")), tool)).otherwise(tool)


def labels(tools: Column, most: int = 8) -> Column:
    """(labels, more): the first labels and how many are not shown."""
    all_ = F.coalesce(F.transform(tools, label), F.array().cast("array<string>"))
    return F.struct(F.slice(all_, 1, most).alias("labels"), F.greatest(F.lit(0), F.size(all_) - most).alias("more"))


def page_of(provenance: Column) -> Column:
    """The page of an item's first provenance, null if it has none."""
    return F.get(provenance, F.lit(0))["page_no"]
