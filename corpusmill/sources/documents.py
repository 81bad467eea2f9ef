"""Documents to items. Markdown and HTML are parsed here; PDF and DOCX need a converter and give an error row. Errors are rows, not exceptions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ITEM = "doc_id string, source string, pos int, type string, text string, heading_path string, level int, problem string"
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_IMAGE = re.compile(r"^!\[([^\]]*)\]\(([^)\s]+)[^)]*\)\s*$")


def markdown(text: str) -> Iterator[tuple[str, str, int | None]]:
    """(type, text, level) of the blocks of a Markdown text: headings, tables, images, fenced code and paragraphs."""
    lines, i = text.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _HEADING.match(line):
            yield "text", m[2], len(m[1]) - 1
            i += 1
        elif m := _IMAGE.match(line):
            yield "image", m[1] or m[2], None
            i += 1
        elif line.startswith("```"):
            j = i + 1
            while j < len(lines) and not lines[j].startswith("```"):
                j += 1
            yield "text", "\n".join(lines[i + 1 : j]), None
            i = j + 1
        elif line.lstrip().startswith("|"):
            j = i
            while j < len(lines) and lines[j].lstrip().startswith("|"):
                j += 1
            yield "table", "\n".join(x.strip() for x in lines[i:j]), None
            i = j
        else:
            j = i
            while j < len(lines) and lines[j].strip() and not _HEADING.match(lines[j]) and not lines[j].startswith("```") and not lines[j].lstrip().startswith("|"):
                j += 1
            yield "text", "\n".join(lines[i:j]), None
            i = max(j, i + 1)


def html_blocks(page: str) -> Iterator[tuple[str, str, int | None]]:
    """The same of an HTML page."""
    page = re.sub(r"(?is)<(script|style|noscript|nav|footer|header|aside)\b.*?</\1\s*>|<!--.*?-->", " ", page)
    for m in re.finditer(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>|<table\b[^>]*>(.*?)</table\s*>|<img\b[^>]*?alt=\"([^\"]*)\"[^>]*>|<(?:p|li|pre|td|blockquote)\b[^>]*>(.*?)</(?:p|li|pre|td|blockquote)\s*>", page):
        if m[1]:
            yield "text", _bare(m[2]), int(m[1]) - 1
        elif m[3] is not None:
            rows = [[_bare(c) for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", m[3])]
            rows = [r for r in rows if r]
            if rows:
                yield "table", "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])] + ["| " + " | ".join(r) + " |" for r in rows[1:]]), None
        elif m[4] is not None:
            yield "image", m[4], None
        elif m[5] is not None and _bare(m[5]):
            yield "text", _bare(m[5]), None


def _bare(s: str) -> str:
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, source, fmt, content in zip(*(b.column(n).to_pylist() for n in ("doc_id", "source", "format", "content"))):
            if fmt not in ("md", "html"):
                out.append((doc, source, 0, None, None, None, None, f"no converter for {fmt}"))
                continue
            text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content or ""
            stack: list[tuple[int, str]] = []
            for pos, (kind, t, level) in enumerate(markdown(text) if fmt == "md" else html_blocks(text)):
                while level is not None and stack and stack[-1][0] >= level:
                    stack.pop()
                out.append((doc, source, pos, kind, t, " > ".join(x for _, x in stack), level, None))
                if level is not None:
                    stack.append((level, t))
        cols = list(zip(*out)) or [()] * 8
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "source", "pos", "type", "text", "heading_path", "level", "problem"])


def items(files: DataFrame) -> DataFrame:
    """Items of ``files(doc_id, source, format, content)``; a heading's path is that above it."""
    return files.select("doc_id", "source", "format", "content").mapInArrow(_walk, ITEM)
