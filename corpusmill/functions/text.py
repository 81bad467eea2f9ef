"""Text functions as Column expressions; they stay in the JVM. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What cleaning removes.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}]"
CID = r"\(cid:[0-9]+\)"
PRIVATE_USE = r"[\x{e000}-\x{f8ff}]"
#: White space at the ends, as Unicode has it.
ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(map(chr, range(0x21, 0x7F)))
# One-character function words that carry no meaning for search.
CJK_STOP = "的了是在和与就都也这那个上下里中为对从把被让给到着过而但"
#: A search term: a word of letters and digits, or one CJK character.
TERM = r"[a-z0-9\x{c0}-\x{24f}]+|[\x{4e00}-\x{9fff}]"
#: The same without one-letter words and function words.
_SEARCH_TERM = rf"[a-z0-9\x{{c0}}-\x{{24f}}]{{2,}}|[0-9\x{{c0}}-\x{{24f}}]|[\x{{4e00}}-\x{{9fff}}&&[^{CJK_STOP}]]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def clean_chars(c: Column) -> Column:
    """Without control characters (tab and line feed stay), invisible ones, font residue and private-use characters."""
    for p in (CONTROL, INVISIBLE, CID, PRIVATE_USE):
        c = F.regexp_replace(c, p, "")
    return c


def private_use_share(c: Column) -> Column:
    """Share of private-use characters after the other removals."""
    for p in (CONTROL, INVISIBLE, CID):
        c = F.regexp_replace(c, p, "")
    return (F.length(c) - F.length(F.regexp_replace(c, PRIVATE_USE, ""))) / F.greatest(F.length(c), F.lit(1))


def replacement_share(c: Column) -> Column:
    """Share of U+FFFD in a cleaned text."""
    return (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / F.greatest(F.length(c), F.lit(1))


def clean_space(c: Column) -> Column:
    """One kind of line end and blank, no runs of blanks, at most one empty line, no ends."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.translate(c, "　 ", "  ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def table_text(c: Column) -> Column:
    """Table rows without blank lines; a line that doesn't start with a bar is glued to the row before it."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(F.translate(c, "　 ", "  "), r"[ \t]{2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n"), r"\n{2,}", "\n")
    return F.regexp_replace(strip(c), r"\n([^|])", " $1")


def furniture_key(c: Column) -> Column:
    """Ends stripped, full-width signs to half-width, runs of digits to #."""
    return F.regexp_replace(F.translate(strip(c), FULL, HALF), r"\p{Nd}+", "#")


def letters_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"^\p{Nd}{1,4}$")


def join_lines(head: Column, tail: Column) -> Column:
    """The tail after the head, with a blank only where the head ends in an ASCII letter or digit."""
    return F.concat(head, F.when(head.rlike("[A-Za-z0-9]$"), " ").otherwise(""), tail)


def compose(head: Column, core: Column) -> Column:
    """Heading and body, an empty line between them; either may be empty."""
    return F.concat_ws("\n\n", F.when(head != "", head), F.when(core != "", core))


def brief(c: Column, most: int) -> Column:
    """White space collapsed, at most so many characters, the last one an ellipsis where text was cut."""
    t = strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def mask(c: Column) -> Column:
    """A secret with its middle hidden: the first and last four characters stay where there are more than eight."""
    return F.when(c == "", "").when(F.length(c) <= 8, "****").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("****"), F.right(c, F.lit(4))))


def is_masked(c: Column) -> Column:
    return F.contains(c, F.lit("****"))


def is_http_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^\s/]+")


def file_size(c: Column) -> Column:
    """Bytes as B, KB or MB with one decimal, rounded down."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(F.format_string("%.1f", F.floor(c / F.lit(102.4)) / 10), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.floor(c / F.lit(104857.6)) / 10), F.lit(" MB")))
    )


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage, 0 where there is no whole."""
    return F.when(whole > 0, F.least(F.lit(100), F.round(part * 100.0 / whole))).otherwise(0).cast("int")


def short_id(c: Column, n: int = 8) -> Column:
    return F.left(c, F.lit(n))


def title(c: Column, most: int = 20) -> Column:
    return F.left(strip(c), F.lit(most))


def data_uri(mime: Column, content: Column, most: int = 10 * 1024 * 1024) -> Column:
    """A base64 data URI of a PNG or JPEG within the size limit, else null."""
    return F.when(mime.isin("image/png", "image/jpeg") & (F.octet_length(content) <= most), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", "")))


def image_placeholder(n: Column, path: Column, caption: Column) -> Column:
    """The text that stands for an image."""
    return F.concat(F.lit("[image "), n.cast("string"), F.lit(": "), F.coalesce(path, F.lit("none")), F.when(caption != "", F.concat(F.lit("; caption: "), caption)).otherwise(""), F.lit("]"))


def grid(rows: Column) -> Column:
    """A Markdown table from an array of arrays of cells, the first row its head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\n\s*|\|", " ")), " | "), F.lit(" |"))
    head = F.element_at(rows, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def answer(c: Column) -> Column:
    """(conclusion, key_points) of an answer: its JSON where it holds any, fenced or not, else its text; 100 characters and five points."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?[ \t]*\n?", ""), r"\n?```$", ""))
    parsed = F.from_json(bare, "conclusion string, answer string, key_points array<string>")
    text = F.coalesce(F.nullif(parsed["conclusion"], F.lit("")), F.nullif(parsed["answer"], F.lit("")), strip(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    return F.struct(F.left(text, F.lit(100)).alias("conclusion"), F.slice(F.coalesce(parsed["key_points"], F.array().cast("array<string>")), 1, 5).alias("key_points"))


def terms(c: Column) -> Column:
    """Search terms of a text in order: words and single CJK characters, without one-letter words and function words."""
    return F.regexp_extract_all(F.lower(c), F.lit(_SEARCH_TERM), F.lit(0))


def seq_of(chunk_id: Column) -> Column:
    """The child's number in a chunk id."""
    return F.try_element_at(F.regexp_extract_all(chunk_id, F.lit(r":c([0-9]+)$"), F.lit(1)), F.lit(1)).cast("int")


def clamp_k(k: int | None, low: int = 1, high: int = 10, default: int = 5) -> int:
    """A requested number of results within limits; 0 and None mean the default."""
    return max(low, min(high, k or default))


def quoted(value: str) -> str:
    """A value for a filter string, refused if it could end the quotes."""
    if any(c in value for c in '"\\\n\r'):
        raise ValueError(f"unsafe in a filter: {value!r}")
    return f'"{value}"'
