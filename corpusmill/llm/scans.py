"""Noise in text from scanned pages: furniture, cut words and wrongly recognised characters, repaired into readable paragraphs.

Headers and footers are found by fuzzy repetition of lines at page edges: a line's key drops its page label, case, blanks, digits and the
differences a scan confuses, so ``M0rque Annual Report`` and ``Morque Annual Report - 7 -`` are one line. A key on ``REPEATS`` pages and a
share ``SHARE`` of a document's pages, or a running line in ``DOCS`` documents and most where it occurs, is furniture. A page label is furniture if
it states the item's page (digits, roman numerals, ``n of m``, with scan errors), or if labels of its style stand as far from their pages on
``RUN`` pages of the document (front matter, an extract). Lines of the same kinds inside a body item are removed there. Headings (with level)
never are.

Lines are then joined. A word cut by a hyphen-like mark at a line end, or at the end of an item before the next body item, is joined as
the corpus vocabulary has it: with or without its hyphen. A unit of the vocabulary is misread if one or two exchanges of characters a scan
confuses give one that is ``TIMES`` as frequent: units meet under a key on which all such exchanges agree, and the exchanges are then found
exactly. For CJK the unit is the character with its neighbours.

Vocabulary, keys and counts are aggregated over all rows and meet the items in joins; only a bit filter of bounded size reaches the driver. No stage
gathers a document: what an item asks of the one before or after it is found in blocks of ``SPAN`` positions, and across blocks from one row a
block. Only text items with a page count. Nulls and empty texts give no defect. Items delivered twice count once. Very long items are
processed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table
from .bits import bit_filter, has
from .textkit import fold

REPEATS, SHARE, DOCS = 2, 0.35, 3
TIMES, LEAST, EXCHANGES = 8, 4, 2
SPAN = 512
#: Labels that go on beside the pages' own count: on so many pages at the same distance.
RUN = 3
#: Positions from a page's first and last item that count as its edge, and the longest line that can be furniture.
EDGE, LINE = 3, 110
HYPHENS = "-‐‑­¬–﹣－"

# What a scan reads for a letter or a pair of letters, and what stands there.
LATIN_MISREAD = (("@", "a"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("†", "t"), ("cl", "d"), ("ri", "n"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("c", "e"), ("|", "l"), ("$", "s"), ("!", "l"), ("!", "i"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"))
# Pairs of CJK characters of similar shape, what stands there and what a scan reads.
CJK_MISREAD = "有冇 元兀 元无 计汁 业亚 长氏 司可 季李 响晌 格恪 单草 利刹 用甩 动劲 管菅 主王 户尸 降隆 露霹 告舌 末未 未末 己已 已己 日曰 土士 入人 千干 大犬 天夭 力刀 目曰 本木 问间 间问 因囚 困囚 值植 幅辐 账帐 税悦 资贷 货贷 贷货 期朋 增憎 收牧 券卷 析折 率卒 产严 市巿 风凤 令今 今令 申甲 由田 复夏 免兔 治冶 待侍 技枝 住佳 任仟 候侯 治洽 拔拨 微徽"
_CJK_FIX: dict[str, list[str]] = {}
for _pair in CJK_MISREAD.split():
    _CJK_FIX.setdefault(_pair[1], []).append(_pair[0])
_CJK_HOT = re.compile("[" + "".join(sorted(set(CJK_MISREAD) - {" "})) + "]")
_ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", re.I)
_DIGIT = str.maketrans("lIiOoSsBZzq|!", "1110055822911")
_DIGITS = re.compile(r"[0-9lIiOoSsBZzq|!]+")
_NUM = r"[0-9lIOoSBZq|]{1,4}"
_LABELS = tuple(
    re.compile(p, re.I)
    for p in (
        rf"第\s*({_NUM})\s*页\s*[,，/]?\s*(?:共\s*{_NUM}\s*页)?",
        rf"p[a@]g[e]\s+({_NUM})\s+[o0]f\s+{_NUM}",
        rf"p[a@]g[ec]\s+({_NUM})",
        rf"p\.\s*({_NUM})",
        rf"[-–—·•]\s*({_NUM})\s*[-–—·•]",
        rf"\[\s*({_NUM})\s*\]",
        rf"({_NUM})\s*/\s*{_NUM}",
        rf"({_NUM})",
        r"([ivxlc]{1,8})",
        r"[-–—·•]\s*([ivxlc]{1,8})\s*[-–—·•]",
        r"p[a@]g[e]\s+([ivxlc]{1,8})",
    )
)
_SHUT = re.compile(r"[\s|·/—–:：-]+$")


def number(label: str) -> int | None:
    """The number a label of digits (with scan errors) or roman numerals states."""
    m = _ROMAN.fullmatch(label)
    if m and m[0]:
        tens = {"": 0, "x": 10, "xx": 20, "xxx": 30, "xl": 40, "l": 50, "lx": 60, "lxx": 70, "lxxx": 80, "xc": 90}
        ones = {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
        roman = 100 * len(m[1]) + tens.get(m[2].lower(), 0) + ones.get(m[3].lower(), 0)
    else:
        roman = None
    digits = label.translate(_DIGIT)
    return int(digits) if digits.isdigit() and not (roman and len(label) > 1) else roman


def states(label: str, page: int) -> bool:
    """Whether the label states the page, read as digits with scan errors or as roman numerals."""
    digits = label.translate(_DIGIT)
    return digits.isdigit() and int(digits) == page or number(label) == page


def run_of(line: str, page: int) -> str | None:
    """What the labels of one run have in common: style and distance from the page, for a line that is nothing but a label."""
    for p in _LABELS:
        if (m := p.fullmatch(line.strip())) and (n := number(m[1])) is not None:
            return f"{'roman' if m[1].isalpha() else 'digits'} {n - page}"
    return None


@cache
def roman(n: int) -> str:
    tens, ones = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    return "c" * (n // 100) + tens[n // 10 % 10] + ones[n % 10] if 0 < n < 400 else "-"


def label_of(line: str, page: int) -> tuple[str, bool]:
    """The line without a page label that states its page, and whether there was one."""
    line = line.strip()
    if str(page) not in " ".join(_DIGITS.findall(line)).translate(_DIGIT) and roman(page) not in line.lower():
        return line, False
    for p in _LABELS:
        if (m := p.fullmatch(line)) and states(m[1], page):
            return "", True
    for p in _LABELS:
        for m in p.finditer(line):
            if m.end() == len(line) and m.start() and line[m.start() - 1] in " \t　|·/-—–" and states(m[1], page):
                return _SHUT.sub("", line[: m.start()]), p is not _LABELS[7] and p is not _LABELS[8]
            if m.start() == 0 and m.end() < len(line) and line[m.end()] in " \t　|·/-—–" and states(m[1], page) and p is not _LABELS[7] and p is not _LABELS[8]:
                return line[m.end() :].strip(" \t　|·/-—–"), p is not _LABELS[2] and p is not _LABELS[0] or line[m.end() :].lstrip()[:1] in "|·/-—–"
    return line, False


#: What a scan confuses with several characters, written as the longest reading, so that both readings give one key.
_SPREAD = (("m", "rn"), ("n", "ri"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("u", "ii"))
_ONE = str.maketrans("l1|!05$68" + "9@47†2e3", "iiiiossbb" + "gaattzcc")
_ONE_BY = {chr(k): chr(v) for k, v in _ONE.items()} | {k: v[0] for k, v in _CJK_FIX.items()}
_ONE_OF = re.compile("[" + "".join(map(re.escape, _ONE_BY)) + "]")
_NUMBER = re.compile(r"(?<![a-zà-ÿ])\d+(?:[.,]\d+)*(?![a-zà-ÿ])")


def fuzzy(line: str) -> str:
    """A key on which lines that a scan may confuse agree. ``line`` is folded."""
    t = _NUMBER.sub("#", line.lower())
    for whole, parts in _SPREAD:
        t = t.replace(whole, parts)
    if t.isascii():
        t = t.translate(_ONE)
    else:  # translate is slow beyond ASCII
        t = _ONE_OF.sub(lambda m: _ONE_BY[m[0]], t)
    return re.sub(r"[^\w#]+", "", t)


_PART = re.compile(r"\s[·|/]\s|\s-\s|, ")


def keys(base: str) -> list[str]:
    """The line's key, and for a line of parts (section · company) one key a part."""
    k = fuzzy(base)
    parts = [fuzzy(p) for p in _PART.split(base)]
    return ([k] if len(k) > 1 else []) + ([f"~{p}" for p in parts if len(p) > 3] if len(parts) == 2 else [])


_ENDS = re.compile(r"[。；;！？!?]\s*$|[a-zà-ÿ]{2}\.\s*$|[,，、]\s*$")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line that could be furniture: its number (-1: the whole item), keys, whether it states the page, else the run of labels it may be of."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "pos", "page_no", "line", "labelled", "keys")}
        for doc, pos, page, level, text in zip(*(b.column(n).to_pylist() for n in ("doc_id", "pos", "page_no", "level", "text"))):
            if level is not None:
                continue
            lines = fold(text.replace("­", "-")).split("\n")
            full = [x for x in lines if x.strip()]
            whole = len(full) == 1
            for i, x in enumerate(lines):
                if not x.strip() or len(x) > LINE or whole and _ENDS.search(x) or not whole and len(full) > 1 and re.match(r"\s*\|.*\|\s*$", x):
                    continue
                base, labelled = label_of(x, page)
                own = [] if _ENDS.search(base) else keys(base)
                run = None if labelled or len(base) > 24 else run_of(base, page)
                if base and not own and not run:
                    continue
                for k, v in zip(out, (doc, pos, page, -1 if whole else i, labelled, own + ([f"={run}"] if run else []))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())))], names=list(out))


LINES = "doc_id string, pos int, page_no int, line int, labelled boolean, keys array<string>"


def paged(items: DataFrame) -> DataFrame:
    """Text items of paged documents, each once, written for the steps that read them."""
    return stage_table(items.filter("type = 'text' and page_no is not null and text <> ''").select("doc_id", "pos", "page_no", "level", "text").dropDuplicates(["doc_id", "pos"]))


def furniture(items: DataFrame) -> DataFrame:
    """(doc_id, pos, line): lines that are furniture, line -1 for a whole item. ``items`` come from ``paged``."""
    lines = stage_table(items.mapInArrow(_lines, LINES))
    pages = items.groupBy("doc_id", "page_no").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    placed = lines.filter(F.size("keys") > 0).join(pages, ["doc_id", "page_no"]).filter((F.col("line") >= 0) | (F.col("pos") - F.col("lo") < EDGE) | (F.col("hi") - F.col("pos") < EDGE))
    near = stage_table(placed.select("doc_id", "page_no", "pos", "line", F.explode("keys").alias("key")))
    long = pages.groupBy("doc_id").agg(F.count("*").alias("of"))
    seen = near.filter("line = -1 or key like '=%'").groupBy("doc_id", "key").agg(F.countDistinct("page_no").alias("pages")).join(long, "doc_id")
    enough = F.when(F.col("key").startswith("="), F.col("pages") >= RUN).otherwise((F.col("pages") >= REPEATS) & (F.col("pages") >= SHARE * F.col("of")))
    seen = seen.withColumn("runs", enough)
    running = seen.filter("runs").select("doc_id", "key")
    whole = seen.filter(~F.col("key").rlike("^[~=]")).groupBy("key").agg(F.sum(F.col("runs").cast("int")).alias("docs"), F.count("*").alias("n"))
    everywhere = whole.filter((F.col("docs") >= DOCS) & (F.col("docs") >= 0.5 * F.col("n"))).select("key")
    known = near.join(running, ["doc_id", "key"], "left_semi").unionByName(near.join(everywhere, "key", "left_semi"))
    return lines.filter("labelled").select("doc_id", "pos", "line").unionByName(known.select("doc_id", "pos", "line")).distinct()


_WORD = re.compile(r"[A-Za-zÀ-ɏ@†$!|0-9]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ@†$!|0-9]*")
_COMPOUND = re.compile(r"[A-Za-zÀ-ɏ]+-[A-Za-zÀ-ɏ]+")
_BREAK = re.compile(rf"([A-Za-zÀ-ɏ@†0-9]*[A-Za-zÀ-ɏ])[{HYPHENS}][ \t]*\n[ \t\n]*([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ@†0-9]*)")
_CUT = re.compile(rf"[{HYPHENS}][ \t]*\n")
_MARKS = {*HYPHENS}
_TAIL = re.compile(r"[A-Za-zÀ-ɏ@†0-9]*[A-Za-zÀ-ɏ]$")
_HEAD = re.compile(r"\s*([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ@†0-9]*)")
_HAN = "㐀-䶿一-鿿，。；、：（）“”"


def _without(text: str, lines: list[int] | None) -> str:
    if not lines:
        return text
    gone = set(lines)
    return "\n".join(x for i, x in enumerate(fold(text.replace("­", "-")).split("\n")) if i not in gone)


def flow(text: str, compounds: set[tuple[str, str]] = frozenset()) -> str:
    """Lines of one item in one, words cut at a line end joined, with a hyphen if they are among the compounds."""
    t = text
    if _CUT.search(t):
        t = _BREAK.sub(lambda m: f"{m[1]}-{m[2]}" if (m[1].lower(), m[2].lower()) in compounds else m[1] + m[2], t)
    t = fold(t)
    if "\n" not in t:
        return t
    t = re.sub(rf"(?<=[{_HAN}]) ?\n ?|\n ?(?=[{_HAN}])", "", t)
    return re.sub(r"\s*\n\s*", " ", t)


def units(text: str) -> set[str]:
    """Vocabulary units of a flowing text: words, and for CJK each character that a scan confuses with its neighbours."""
    out = {w.lower() for w in _WORD.findall(text)} | {w.lower() for w in _COMPOUND.findall(text)}
    t = re.sub(r"(?<=[㐀-鿿]) (?=[㐀-鿿])", "", text)
    for m in _CJK_HOT.finditer(t):
        i = m.start()
        a = max(0, i - 1)
        out.update((t[a : i + 1], t[i : i + 2], t[a : i + 2]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n) of the texts, reduced within the task."""
    n: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["unit", "n"])
        n.clear()
        return out

    for b in batches:
        for t in b.column("flat").to_pylist():
            n.update(units(t))
        if len(n) > 200_000:
            yield flush()
    if n:
        yield flush()


def _classes(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """For each character of the pairs the least of those it can be exchanged with, at any distance."""
    of: dict[str, str] = {}
    for a, b in pairs:
        x, y = of.get(a, a), of.get(b, b)
        of |= {k: min(x, y) for k in {a, b, *(k for k, v in of.items() if v in (x, y))}}
    return of


_CLASS = _classes([(a, b) for a, b in LATIN_MISREAD if len(a) == 1] + [(p[0], p[1]) for p in CJK_MISREAD.split()])
#: Exchanges with their number: those of the list, and those whose several characters were themselves confused.
_EXCHANGES: dict[str, dict[str, int]] = {}
for _bad, _good in LATIN_MISREAD:
    for _i, _c in enumerate(_bad if len(_bad) > 1 else ""):
        for _b, _g in LATIN_MISREAD:
            if _g == _c:
                _EXCHANGES.setdefault(_good, {}).setdefault(_bad[:_i] + _b + _bad[_i + 1 :], 2)
for _bad, _good in LATIN_MISREAD:
    _EXCHANGES.setdefault(_good, {})[_bad] = 1


def scan_key(unit: Column) -> Column:
    """A key on which a unit agrees with all that exchanges make of it."""
    for whole, parts in (("w", "vv"), ("m", "rn"), ("u", "ii"), ("h", "li"), ("d", "cl"), ("n", "ri")):
        unit = F.replace(unit, F.lit(whole), F.lit(parts))
    return F.translate(unit, "".join(_CLASS), "".join(_CLASS.values()))


def exchanges(unit: str, fix: str, most: int = EXCHANGES) -> int | None:
    """The least number of exchanges that make a unit of Latin letters the fix, or None beyond ``most``; for CJK one exchange at most."""
    if any("㐀" <= c <= "鿿" for c in unit):
        odd = [(a, b) for a, b in zip(unit, fix) if a != b]
        return len(odd) if len(unit) == len(fix) and len(odd) <= 1 and all(b in _CJK_FIX.get(a, ()) for a, b in odd) else None
    best = {0: 0}  # characters of the unit used so far, for each length of the fix, to the exchanges made
    for c in fix:
        new: dict[int, int] = {}
        for at, cost in best.items():
            if unit.startswith(c, at):
                new[at + 1] = min(new.get(at + 1, cost), cost)
            for bad, n in _EXCHANGES.get(c, {}).items():
                if cost + n <= most and unit.startswith(bad, at):
                    new[at + len(bad)] = min(new.get(at + len(bad), most), cost + n)
        best = new
        if not best:
            return None
    return best.get(len(unit))


def _exchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [exchanges(u, v) for u, v in zip(b.column("unit").to_pylist(), b.column("variant").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("variant"), b.column("m"), pa.array(n, pa.int32())], names=["unit", "variant", "m", "exchanges"])


def misreadings(vocab: DataFrame) -> DataFrame:
    """(unit, fix): units that are rare beside what they become by exchanging confused characters; of several the fix by fewest exchanges, then the
    most frequent."""
    keyed = vocab.select("unit", "n", scan_key(F.col("unit")).alias("key"))
    word = F.col("unit").rlike("[㐀-鿿]") | F.col("unit").rlike(r"^\p{L}{3,}$")
    known = keyed.filter((F.col("n") >= LEAST) & word).select("key", F.col("unit").alias("variant"), F.col("n").alias("m"))
    met = keyed.join(known, "key").filter((F.col("m") >= TIMES * F.col("n")) & (F.col("unit") != F.col("variant")))
    better = met.select("unit", "variant", "m").mapInArrow(_exchanged, "unit string, variant string, m bigint, exchanges int").filter("exchanges > 0")
    return better.groupBy("unit").agg(F.max_by("variant", F.struct(-F.col("exchanges"), "m", "variant")).alias("fix"))


def _asked(bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, pos, unit) for the units of each item that may be misread ones."""
        known: dict[str, bool] = {}
        for b in batches:
            rows = []
            for doc, pos, t in zip(b.column("doc_id").to_pylist(), b.column("pos").to_pylist(), b.column("flat").to_pylist()):
                for u in units(t):
                    if u not in known:
                        if len(known) > 300_000:
                            known.clear()
                        known[u] = has(bad, u)
                    if known[u]:
                        rows.append((doc, pos, u))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], names=["doc_id", "pos", "unit"])

    return run


def misread(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, pos, unit, fix) of the body items that hold misread units."""
    asked = rows.select("doc_id", "pos", "flat").mapInArrow(_asked(bit_filter(fixes.select("unit"))), "doc_id string, pos int, unit string")
    return asked.join(fixes, "unit")


def vocabulary(rows: DataFrame) -> DataFrame:
    return stage_table(rows.select("flat").mapInArrow(_counts, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")))


def tail_of(text: str) -> str | None:
    """The word that a hyphen-like mark cuts at the end of a text."""
    text = text.rstrip()
    if text[-1:] not in _MARKS or not text:
        return None
    m = _TAIL.search(text[:-1].rsplit(None, 1)[-1]) if text[:-1].strip() and not text[-2].isspace() else None
    return m[0] if m else None


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [_without(t, x) for t, x in zip(b.column("text").to_pylist(), b.column("gone").to_pylist())]
        tails = [tail_of(t) for t in bodies]
        heads = [(_HEAD.match(fold(t)) or ["", None])[1] for t in bodies]
        cut = [bool(_CUT.search(t) and _BREAK.search(t)) for t in bodies]
        flat = [flow(t) for t in bodies]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in ("doc_id", "pos", "page_no", "level")), pa.array(bodies, pa.string()), pa.array(tails, pa.string()), pa.array(heads, pa.string()), pa.array(cut, pa.bool_()), pa.array(flat, pa.string())],
            names=["doc_id", "pos", "page_no", "level", "body", "tail", "head", "cut", "flat"],
        )


def bodies(items: DataFrame, found: DataFrame) -> DataFrame:
    """Body items without the furniture lines inside them, and what a word cut at their ends would join."""
    gone = found.filter("line >= 0").groupBy("doc_id", "pos").agg(F.collect_list("line").alias("gone"))
    rest = items.join(found.filter("line = -1").select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").join(gone, ["doc_id", "pos"], "left")
    rows = rest.mapInArrow(_bodies, "doc_id string, pos int, page_no int, level int, body string, tail string, head string, cut boolean, flat string")
    return stage_table(rows)


def _blocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / SPAN))


def _across(rows: DataFrame, value: Column, step: Column) -> DataFrame:
    """(doc_id, block, across): for each block a ``value`` of every block, moved over the blocks of the document by ``step``, a window function of
    the column ``own``. One row a block."""
    per = rows.groupBy("doc_id", "block").agg(value.alias("own"))
    return per.select("doc_id", "block", step.over(Window.partitionBy("doc_id").orderBy("block")).alias("across"))


def _block():
    return Window.partitionBy("doc_id", "block").orderBy("pos")


def next_heads(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, next_head) for items that end in a cut word: the first word of the next body item, however far it stands. No document is one
    task's work: windows run inside blocks of positions, and a block's last item looks at the first of the next block that has any."""
    slim = _blocked(rows.select("doc_id", "pos", F.struct("head").alias("first"), "tail"))
    ahead = _across(slim, F.min_by("first", "pos"), F.lead("own"))
    cut = slim.withColumn("inside", F.lead("first").over(_block())).filter("tail is not null").join(ahead, ["doc_id", "block"], "left")
    return cut.select("doc_id", "pos", F.coalesce("inside", "across")["head"].alias("next_head")).filter("next_head is not null")


def defects(items: DataFrame) -> DataFrame:
    """(doc_id, pos, defect): furniture, embedded, broken_word, misread."""
    texts = paged(items)
    found = stage_table(furniture(texts))
    rows = bodies(texts, found)
    whole = found.filter("line = -1").select("doc_id", "pos", F.lit("furniture").alias("defect"))
    inside = found.filter("line >= 0").join(whole.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").select("doc_id", "pos", F.lit("embedded").alias("defect"))
    broken = rows.filter("cut").select("doc_id", "pos").union(next_heads(rows).select("doc_id", "pos")).select("doc_id", "pos", F.lit("broken_word").alias("defect"))
    wrong = misread(rows, stage_table(misreadings(vocabulary(rows)))).select("doc_id", "pos", F.lit("misread").alias("defect"))
    return whole.unionByName(inside).unionByName(broken).unionByName(wrong).distinct()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The halves of the words cut in each item; the last may lie in the next item."""
    for b in batches:
        rows = []
        for doc, pos, body, tail, nxt in zip(*(b.column(n).to_pylist() for n in ("doc_id", "pos", "body", "tail", "next_head"))):
            found = {(m[1].lower(), m[2].lower()) for m in _BREAK.finditer(body)} | ({(tail.lower(), nxt.lower())} if tail and nxt else set())
            rows += [(doc, pos, x, y, x + y, f"{x}-{y}") for x, y in found]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.string()] * 4))], names=["doc_id", "pos", "x", "y", "solid", "hyphened"])


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for body, fixes, cuts, tail, nxt in zip(*(b.column(n).to_pylist() for n in ("body", "fixes", "compounds", "tail", "next_head"))):
            compounds = {(c["x"], c["y"]) for c in cuts or []}
            t = flow(body, compounds)
            if tail and nxt:  # the second half starts the next item, which follows without a blank
                t = re.sub(rf"[{HYPHENS}]\s*$", "-" if (tail.lower(), nxt.lower()) in compounds else "", t)
            for f in sorted(fixes or [], key=lambda f: (-len(f["unit"]), f["unit"])):
                bad, good = f["unit"], f["fix"]
                if bad.isascii() or not any("㐀" <= c <= "鿿" for c in bad):
                    t = re.sub(rf"(?<!\w){re.escape(bad)}(?!\w)", lambda m, g=good: g.upper() if m[0].isupper() and len(m[0]) > 1 else g.capitalize() if m[0][:1].isupper() else g, t, flags=re.I)
                else:
                    t = t.replace(bad, good)
            out.append(t.strip())
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "pos", "page_no", "level")), pa.array(out, pa.string()), pa.array([bool(x and y) for x, y in zip(b.column("tail").to_pylist(), b.column("next_head").to_pylist())], pa.bool_())], names=["doc_id", "pos", "page_no", "level", "text", "open_word"])


def paragraphs(items: DataFrame) -> DataFrame:
    """(doc_id, start_pos, first_page, last_page, heading, text): continuous paragraphs in reading order. A body item that does not end its
    sentence goes on in the next one, over any number of items."""
    texts = paged(items)
    rows = bodies(texts, stage_table(furniture(texts)))
    vocab = vocabulary(rows)
    fixes = misread(rows, stage_table(misreadings(vocab))).groupBy("doc_id", "pos").agg(F.collect_set(F.struct("unit", "fix")).alias("fixes"))
    ahead = rows.join(next_heads(rows), ["doc_id", "pos"], "left")
    cut = ahead.filter("cut or next_head is not null").select("doc_id", "pos", "body", "tail", "next_head").mapInArrow(_pairs, "doc_id string, pos int, x string, y string, solid string, hyphened string")
    words = cut.select("x", "y", "solid", "hyphened").distinct()
    solid, hyphened = vocab.select(F.col("unit").alias("solid"), F.col("n").alias("a")), vocab.select(F.col("unit").alias("hyphened"), F.col("n").alias("b"))
    compound = words.join(hyphened, "hyphened").join(solid, "solid", "left").filter(F.col("b") > F.coalesce("a", F.lit(0))).select("x", "y")
    compounds = cut.join(compound, ["x", "y"]).groupBy("doc_id", "pos").agg(F.collect_set(F.struct("x", "y")).alias("compounds"))
    whole = ahead.join(fixes, ["doc_id", "pos"], "left").join(compounds, ["doc_id", "pos"], "left")
    mended = whole.mapInArrow(_mend, "doc_id string, pos int, page_no int, level int, text string, open_word boolean").filter("text <> ''")
    ends = F.col("text").rlike(r"[。！？!?.:：;；」”)）]$") & ~F.col("open_word") | F.col("level").isNotNull()
    slim = stage_table(_blocked(mended.withColumn("ends", ends)))
    before = _across(slim, F.max_by("ends", "pos"), F.lag("own"))
    marks = slim.select("doc_id", "pos", "block", "level", F.lag("ends").over(_block()).alias("inside")).join(before, ["doc_id", "block"])
    starts = marks.select("doc_id", "pos", "block", F.when(F.coalesce("inside", "across", F.lit(True)) | F.col("level").isNotNull(), F.col("pos")).alias("start"))
    open_ = starts.groupBy("doc_id", "block").agg(F.max("start").alias("own")).withColumn("run", F.max("own").over(Window.partitionBy("doc_id").orderBy("block")))
    open_ = open_.select("doc_id", "block", F.lag("run").over(Window.partitionBy("doc_id").orderBy("block")).alias("across"))
    at = starts.withColumn("inside", F.max("start").over(_block())).join(open_, ["doc_id", "block"]).select("doc_id", "pos", F.coalesce("inside", "across").alias("start_pos"))
    placed = slim.join(at, ["doc_id", "pos"])
    glued = F.aggregate(
        F.sort_array(F.collect_list(F.struct("pos", "text", "open_word"))),
        F.struct(F.lit("").alias("t"), F.lit(True).alias("o")),
        lambda s, x: F.struct(F.concat(s["t"], F.when(s["o"] | s["t"].rlike("[㐀-鿿，。；、]$"), "").otherwise(" "), x["text"]).alias("t"), x["open_word"].alias("o")),
        lambda s: s["t"],
    )
    return placed.groupBy("doc_id", "start_pos").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.max(F.col("level").isNotNull()).alias("heading"), glued.alias("text"))
