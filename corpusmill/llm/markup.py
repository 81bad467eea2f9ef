"""Markup residue in text documents, decided by boosted trees over nodes and decoded over their tree.

A lexer proposes candidate nodes: HTML tags, comments and entities, Markdown, wiki and LaTeX constructs, and any loose run of characters
that markup uses. Nodes form a tree: a span or verbatim node owns what stands in it, an element what stands between its tags. Features are the
node's kind and extent, attribute and name tokens, its neighbours, depth, owner, siblings under that owner, partner and the density of nodes
around it and in its own subtree. The trees are trained here, on the driver, from ``SAMPLE`` generated labelled texts (a fixed bound); no row
of the data is needed for that.

Decoding takes the labels of the whole tree at once, of the greatest total log odds under three constraints: a tag and its partner have one
label; what stands inside a verbatim node (code, formula, comment, script) that is markup is its content, not markup of its own; and a tag
inside an element that is plain text is plain text.

Cleaning turns markup nodes into text and keeps headings (a line of their own), lists (``- ``), code, tables (pipe rows) and formulas (their
TeX source). Text without markup is returned unchanged, byte for byte. In rows of type table the pipe rows and the divider are format.

Null and empty texts hold no markup and stay as they are. Very long texts are parsed and decoded whole; only their feature rows are handed to the
trees in stretches of ``ROWS``. Repeated rows count once.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from html.entities import html5
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted
from .textkit import groups

SAMPLE = 5000
ROWS = 50_000
#: A row without any of these has no candidate node.
TRIGGER = r"[<>&#*_`~\[\]{}|\\$=^]|''|!!|(?m)^-{3,}[ \t]*$"
_KINDS = (
    ("comment", r"<!--(?:.|\n)*?(?:-->|\Z)"),
    ("script", r"<(?P<raw>script|style)\b[^<>]*>(?:.|\n)*?</(?P=raw)\s*>"),
    ("pre", r"<pre\b[^<>]*>(?:.|\n)*?</pre\s*>"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"),
    ("tag_cut", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?\Z"),
    ("entity", r"&(?:#\d{1,6}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,24});"),
    ("fence", r"```[^\n`]*(?:\n(?:.|\n)*?(?:```|\Z))?"),
    ("display", r"\$\$(?:.|\n)*?(?:\$\$|\Z)"),
    ("bracketmath", r"\\\[(?:.|\n)*?(?:\\\]|\Z)|\\\((?:.|\n)*?\\\)"),
    ("equation", r"\\begin\{(?P<eqn>equation|align|gather|multline|eqnarray|displaymath|math)\*?\}(?:.|\n)*?(?:\\end\{(?P=eqn)\*?\}|\Z)"),
    ("env", r"\\(?:begin|end)\{[^{}\n]*\}?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?"),
    ("command", r"~?\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})*"),
    ("escape", r"\\[%&$#_{}~^\\]"),
    ("math", r"\$(?=[^\s$])[^$\n]+?(?<=\S)\$(?!\d)"),
    ("wikitable", r"^\{\|[^\n]*|^\|\}|^\|-[ \t]*[^\n|]*$"),
    ("wikirow", r"^\|(?![-}|])[^\n|]*(?:\|\|[^\n|]*)+$"),
    ("wikihdr", r"^!(?!\[)[^\n]*"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("wikilink", r"\[\[[^\[\]]*\]\]"),
    ("image", r"!\[[^\]\n]*\]\([^()\n]*\)"),
    ("link", r"\[[^\[\]\n]+\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)"),
    ("extlink", r"\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]"),
    ("footdef", r"^\[\^[^\]\n]+\]:"),
    ("footref", r"\[\^[^\]\n]+\]"),
    ("task", r"^[ \t]*[-*+][ \t]\[[ xX]\][ \t]"),
    ("heading", r"^#{1,6}[ \t]+(?=\S)"),
    ("wikihead", r"^(?P<eq>={2,6})[ \t]*[^=\n]+?[ \t]*(?P=eq)[ \t]*$"),
    ("setext", r"^={3,}[ \t]*$|^-{3,}[ \t]*$"),
    ("rule", r"^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*(?:_[ \t]*){3,}$"),
    ("quote", r"^>[ \t]?"),
    ("divider", r"^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|[ \t]*:?(?:-{2,}:?)?[ \t]*$"),
    ("row", r"^\|[^\n]*\|[ \t]*$"),
    ("bullet", r"^[ \t]*\*[ \t]+(?=\S)"),
    ("bold", r"\*\*(?=[^\s*])[^*\n]+?\*\*|__(?=[^\s_])[^_\n]+?__"),
    ("italic", r"(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])"),
    ("wikiquote", r"'{2,5}(?=[^\s'])[^\n]*?(?<=[^\s'])'{2,5}|'{2,5}"),
    ("strike", r"~~(?=\S)[^~\n]+?~~"),
    ("code", r"`[^`\n]+`"),
    ("wikicell", r"\|\||!!"),
    ("bracket", r"\[[^\[\]\n]*\]"),
    ("brace", r"\{[^{}\n]*\}"),
    ("loose", r"[<>&#*_`~\[\]{}|\\$=^]+"),
)
NAMES = [k for k, _ in _KINDS]
_LEX = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in _KINDS), re.M)
_KIND_NO = {k: i for i, k in enumerate(NAMES)}
_VERBATIM = {"comment", "script", "pre", "fence", "display", "bracketmath", "equation", "math", "code", "template"}
_SPANS = {"row", "wikirow", "bold", "italic", "wikiquote", "strike", "wikihead", "link", "bracket", "brace", "wikihdr"}
# Element names of HTML, and frequent commands of LaTeX.
_TAGS = set("a abbr b big blockquote body br caption center cite code col dd del div dl dt em embed figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main math meta nav nowiki object ol option p param pre q ref references s script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video".split())
_COMMANDS = set("section subsection subsubsection chapter paragraph textbf textit texttt emph underline cite citep citet ref eqref label footnote item begin end frac sqrt sum prod int text mathrm mathbf times cdot alpha beta gamma delta sigma mu lambda left right leq geq neq approx caption includegraphics title author date url href par noindent newline newpage hline centering".split())
_BLOCK = set("p div tr table tbody thead ul ol dl h1 h2 h3 h4 h5 h6 br hr section header footer blockquote pre center title body html head caption li td th dt dd".split())


class Node:
    __slots__ = ("kind", "start", "end", "depth", "kids", "partner", "siblings", "parent", "name", "owner")

    def __init__(self, kind: str, start: int, end: int, depth: int) -> None:
        self.kind, self.start, self.end, self.depth = kind, start, end, depth
        self.kids: list[Node] = []
        self.partner: Node | None = None
        self.parent: Node | None = None  # the span or verbatim node whose extent it stands in
        self.owner: Node | None = None  # its parent in the tree: ``parent`` or the opening tag of an element, whichever is closer
        self.siblings, self.name = 0, ""


def _inside(kind: str, s: str) -> tuple[int, int]:
    """Where the content of a span starts and ends in it."""
    if kind in ("bold", "strike"):
        return 2, len(s) - 2
    if kind == "wikiquote":
        n = len(s) - len(s.lstrip("'"))
        return n, max(n, len(s.rstrip("'")))
    if kind == "wikihead":
        n = len(s) - len(s.lstrip("="))
        return n, len(s.rstrip().rstrip("="))
    if kind == "link":
        return 1, s.index("](")
    if kind == "fence":
        return (s.find("\n") + 1 or len(s)), len(s) - 3 * s.endswith("```", 4)
    if kind in ("pre", "script"):
        return s.index(">") + 1, s.rindex("<")
    if kind == "comment":
        return 4, len(s) - 3 * s.endswith("-->")
    if kind == "display":
        return 2, len(s) - 2 * s.endswith("$$", 2)
    if kind == "bracketmath":
        return 2, len(s) - 2 * s.endswith(("\\]", "\\)"))
    if kind == "equation":
        return s.index("}") + 1, s.rindex("\\end{") if "\\end{" in s else len(s)
    if kind == "template":
        return 2, len(s) - 2
    return 1, len(s) - 1


def parse(text: str, table: bool = False) -> list[Node]:
    """All candidate nodes of a text in order of their start, with parents, partners, owners in the tree and siblings."""
    out: list[Node] = []

    def lex(a: int, z: int, depth: int, parent: Node | None) -> None:
        at = a
        while m := _LEX.search(text, at, z):
            kind = m.lastgroup.removeprefix("k_")  # the outer group closes last
            start, end = m.span()
            if end == start:
                at = end + 1
                continue
            if parent is not None and parent.kind in ("row", "wikihdr", "wikirow") and (kind == "wikicell" or set(m[0]) <= {"|"}):
                at = end
                continue
            if table and (kind in ("row", "divider", "wikicell") or kind == "loose" and set(m[0]) <= {"|"} or kind == "setext"):
                at = start + 1 if kind == "row" else end
                continue
            node = Node(kind, start, end, depth)
            node.parent = parent
            out.append(node)
            if parent is not None:
                parent.kids.append(node)
            if kind in _VERBATIM and end - start > 2 or kind in _SPANS and end - start > 4:  # no kind can stand in itself, so this ends
                a1, z1 = _inside(kind, m[0])
                lex(start + a1, start + z1, depth + 1, node)
            at = end

    lex(0, len(text), 0, None)
    stacks: dict[int, list[Node]] = {}  # a tag's partner is never on the other side of a verbatim node's edge
    for n in out:
        shut = n.parent
        while shut is not None and shut.kind not in _VERBATIM:
            shut = shut.parent
        stack = stacks.setdefault(id(shut), [])
        if n.kind == "tag":
            s = text[n.start : n.end]
            n.name = re.match(r"</?([A-Za-z0-9]+)", s)[1].lower()
            if s.startswith("</"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == n.name:
                        n.partner, stack[k].partner = stack[k], n
                        del stack[k:]
                        break
            elif not s.endswith("/>") and n.name not in ("br", "hr", "img", "input", "meta", "link", "col"):
                n.depth += len(stack)
                stack.append(n)
        elif n.kind in ("command", "env"):
            n.name = (re.match(r"~?\\([A-Za-z]+)", text[n.start : n.end]) or ["", ""])[1]
            n.depth += len(stack)
        elif n.kind == "entity":
            n.name = text[n.start + 1 : n.end]
    around: list[Node] = []  # elements that are open at the node
    for n in out:
        while around and around[-1].partner.start < n.end:
            around.pop()
        n.owner = around[-1] if around and (n.parent is None or around[-1].start > n.parent.start) else n.parent
        if n.partner is not None and n.partner.start < n.start:
            n.owner = n.partner.owner
        elif n.partner is not None:
            around.append(n)
    counts: dict[tuple[int, str], int] = {}
    for n in out:
        counts[id(n.owner), n.kind] = counts.get((id(n.owner), n.kind), 0) + 1
    for n in out:
        n.siblings = counts[id(n.owner), n.kind] - 1
    return out


def _class(c: str) -> int:
    """0 no character or a line end, 1 blank, 2 Latin letter, 3 digit, 4 CJK, 5 stop, 6 opening or quote, 7 else."""
    if not c or c == "\n":
        return 0
    if c.isspace():
        return 1
    if c.isdigit():
        return 3
    if "㐀" <= c <= "鿿":
        return 4
    if c.isalpha():
        return 2
    return 5 if c in ".,;:。，；：！？!?、%" else 6 if c in "([{（“‘\"'「" else 7


N_FEATURES = 29


def features(text: str, nodes: list[Node], table: bool) -> Iterator[list[float]]:
    # of each subtree (0: the whole text): its extent, what its own nodes cover of it, its nodes and those that are no loose signs
    extent, covered, under, heavies = {id(None): len(text)}, {id(None): 0}, {id(None): 0}, {id(None): 0}
    for n in nodes:
        extent[id(n)], covered[id(n)], under[id(n)], heavies[id(n)] = (n.partner.start - n.end if n.partner is not None and n.start < n.partner.start else n.end - n.start), 0, 0, 0
    for n in reversed(nodes):  # what a node owns comes after it
        o = id(n.owner)
        covered[o] += n.end - n.start
        under[o] += under[id(n)] + 1
        heavies[o] += heavies[id(n)] + (n.kind not in ("loose", "bracket", "brace"))
    lines = [0, *(m.end() for m in re.finditer("\n", text))]  # where each line starts
    known_lines: dict[int, tuple[int, int, int]] = {}

    def line_of(k: int) -> tuple[int, int, int]:
        """Where a line's text starts and ends without blanks, and where the line ends."""
        if k not in known_lines:
            a, z = lines[k], lines[k + 1] - 1 if k + 1 < len(lines) else len(text)
            line = text[a:z]
            bare = line.strip()
            lead = a + len(line) - len(line.lstrip()) if bare else z
            known_lines[k] = lead, lead + len(bare) if bare else a, z
        return known_lines[k]

    for n in nodes:
        density, heavy = covered[id(n.owner)] / max(1, extent[id(n.owner)]), heavies[id(n.owner)]
        top = n.partner if n.partner is not None and n.partner.start < n.start else n
        s = text[n.start : n.end]
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        inner = re.sub(r"^[<>&#*_`~\[\]{}|\\$=^!'/\s]+|[<>&#*_`~\[\]{}|\\$=^!'/;\s]+$", "", s)
        letters = sum(c.isalpha() for c in inner)
        known = 1.0 if n.kind == "tag" and n.name in _TAGS or n.kind in ("command", "env") and n.name in _COMMANDS or n.kind == "entity" and (n.name in html5 or n.name.startswith("#")) else 0.0
        k, k_end = bisect_right(lines, n.start) - 1, bisect_right(lines, n.end) - 1
        line_a, (first, _, _), (_, last, line_z) = lines[k], line_of(k), line_of(k_end)
        alone = first >= n.start and last <= n.end
        before_a, before_z, _ = line_of(k - 1) if k else (0, 0, 0)
        yield [
            _KIND_NO[n.kind], len(s), n.start == line_a, n.end == line_z, _class(before), _class(after), len(inner), letters / max(1, len(inner)),
            sum(c.isdigit() for c in inner) / max(1, len(inner)), " " in inner.strip(), s.count("=") + s.count("{"), known, n.partner is not None, n.depth, min(n.siblings, 20),
            density, min(heavy, 30), np.log1p(len(text)), table, alone, _class(inner[:1]), _class(inner[-1:]), n.start == 0, n.end == len(text), ord(s[0]), len(set(s)), 0 < before_z - before_a < 60,
            -1 if n.owner is None else _KIND_NO[n.owner.kind], under[id(top)] / max(1, extent[id(top)]),
        ]


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The labels of greatest total log odds under the constraints: a tag and its partner have one label; nothing inside a verbatim node that
    is markup is markup; a tag inside an element that is plain text is plain text. One pass up the tree and one down, no recursion."""
    odds = {id(n): float(x) for n, x in zip(nodes, logits)}
    closing = {id(n) for n in nodes if n.partner is not None and n.partner.start < n.start}
    heads = [n for n in nodes if id(n) not in closing]  # a closing tag is decided with its opening one
    for n in heads:
        if n.partner is not None:
            odds[id(n)] += odds[id(n.partner)]
    # best total of what a node owns, and of the node: [free, inside an element that is plain text]
    below = {id(n): [0.0, 0.0] for n in nodes} | {id(None): [0.0, 0.0]}
    yes: dict[int, list[bool]] = {}
    for n in reversed(heads):
        own, o = below[id(n)], below[id(n.owner)]
        yes[id(n)] = []
        for plain in (0, 1):
            take = odds[id(n)] + (0.0 if n.kind in _VERBATIM else own[plain])
            leave = own[1 if n.partner is not None else plain]
            yes[id(n)].append(take > leave and not (plain and n.kind == "tag"))
            o[plain] += take if yes[id(n)][plain] else leave
    state: dict[int, int | None] = {id(None): 0}  # for what a node owns: 0 free, 1 in plain text, None in verbatim markup
    label: dict[int, bool] = {}
    for n in heads:
        at = state[id(n.owner)]
        y = label[id(n)] = at is not None and yes[id(n)][at]
        state[id(n)] = None if at is None or y and n.kind in _VERBATIM else 1 if not y and n.partner is not None else at
    return [label[id(n.partner if id(n) in closing else n)] for n in nodes]


# ---- training texts ----

_EN = "the segment margin lifted after strong orders while pricing held and management kept guidance for next year because demand in key markets stayed firm despite weaker freight".split()
_ZH = "公司预计全年收入增长毛利率保持稳定管理层维持指引主要因需求改善而成本压力缓和投资者关注后续订单情况"


def _plain(r: random.Random, zh: bool) -> str:
    if zh:
        a = r.randrange(len(_ZH) - 12)
        return _ZH[a : a + r.randint(6, 24)] + r.choice(["", f"{r.randint(1, 99)}.{r.randint(0, 9)}%", f"{r.randint(100, 9999)} 万元"]) + r.choice("。。。；")
    words = [r.choice(_EN) for _ in range(r.randint(4, 14))]
    if r.random() < 0.4:
        words.insert(r.randrange(len(words)), r.choice([f"{r.randint(1, 99)}.{r.randint(0, 9)}%", f"Q{r.randint(1, 4)} 20{r.randint(10, 25)}", "EBITDA", f"(K{r.randint(1000, 9999)})"]))
    return " ".join(words).capitalize() + r.choice([".", ".", ".", ";", ""])


def _name(r: random.Random, zh: bool) -> str:
    return "".join(r.choice(_ZH) for _ in range(r.randint(2, 6))) if zh else " ".join("".join(r.choice("abdegiklmnorstuv") for _ in range(r.randint(3, 8))).capitalize() for _ in range(r.randint(1, 3)))


def _residue(r: random.Random, zh: bool) -> tuple[str, bool]:
    """A piece of markup, and whether it stands on lines of its own."""
    n, t, s = r.randint(1, 99), _name(r, zh), _plain(r, zh)
    word = r.choice(["net", "gross", "ttm", "adj", "op", "unit"]) + "_" + r.choice(["profit", "eps", "fcf", "margin", "cost"])
    url = f"https://{r.choice(['docs', 'www', 'ir'])}.{r.choice(['abc', 'firm', 'data'])}.example/{r.randint(1, 9999)}"
    tag = r.choice(["p", "b", "i", "em", "strong", "span", "div", "sup", "sub", "u", "td", "li", "h2", "h3", "a", "center", "font", "small"])
    tag = tag.upper() if r.random() < 0.15 else tag
    inline = [
        f"<{tag}>{t}</{tag}>", f"<{tag}>{s}</{tag}>", f'<{tag} class="{r.choice(["note", "body", "c-12"])}">{s}</{tag}>', f'<span style="color:#{r.randint(100, 999)}">{s}</span>', r.choice(["<br>", "<br/>", "<BR>", "<br />", "<hr />", "<hr>"]),
        f'<a href="{url}">{t}</a>', f"<sup>{n}</sup>", f"<script>var k={n}.{n};</script>", f"<!-- {r.choice(['todo', 'x', t])} -->", "<!-- -->", f'<img src="a{n}.png">', f"</{tag}>", f"<{tag}>", f"<nowiki>{t}</nowiki>", f'<ref name="q{n}">{t}</ref>',
        r.choice(["&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&ldquo;", "&rdquo;", "&#8211;", "&#x2019;", "&hellip;", "&mdash;", "&copy;"]), f"&lt;{n}%", f"&lt;p&gt;{s}&lt;/p&gt;", f"&ldquo;{t}&rdquo;", f"&nbsp;{t} &amp;",
        f"**{t}**", f"**{s[:12].strip()}**", f"*{t}*", f"~~{t}~~", f"`{word}`", f"`{t}`", f"[{t}]({url})", f"![{t}](img/{n}.png)", f"[^{r.randint(1, 9)}]", f"__{t}__",
        f"'''{t}'''", f"''{s}''", f"[[{t}|{_name(r, zh)}]]", f"[[{t}]]", f"[[File:{t}.png|thumb|{_name(r, zh)}]]", f"{{{{{r.choice(['cite report', 'note', 'infobox'])}|title={t}|year=20{n:02}}}}}", f"[{url} {t}]",
        f"\\textbf{{{t}}}", f"\\textit{{{t}}}", f"\\emph{{{t}}}", f"${r.choice('abgr')}_{r.choice('efm')} = r_f + \\beta (r_m - r_f)$", f"$x^{n}$", f"$a + b = {n}$", f"\\[ g = {n} \\times b \\]", f"\\( x_{n} \\)", f"~\\cite{{ab{n}}} \\frac{{{n}}}{{{n + 1}}}", f"\\cite{{k{n}}}",
        f"\\frac{{{n}}}{{{n + 2}}}", f"{n}\\% \\& \\${n}", f"{n}.{n}\\%", f"\\footnote{{{t}}}", f"\\ref{{eq:{n}}}", f"\\label{{s:{n}}}", "\\\\",
    ]
    k = r.randint(1, 3)
    block = [
        f"{'#' * r.randint(1, 5)} {t}", f"{t}\n{'=' * r.randint(3, 12)}", f"{t}\n{'-' * r.randint(3, 12)}", r.choice(["* * *", "***", "---", "_____"]), f"> {s}", f"- [{r.choice('x X')}] {s}", f"[^{n}]: {t}", "\n".join(f"* {_plain(r, zh)}" for _ in range(r.randint(2, 4))),
        f"```{r.choice(['py', '', 'sql'])}\nmargin = gross / revenue\nprint({n})\n```", f"| {t} | {_name(r, zh)} |\n|---|---:|\n| {t} | {n}.{n} |", f"| {t} | {_name(r, zh)} |\n| --- | --- |\n| {t} | {n} |\n| {t} | {n} |", f"| {t} | {n}.{n} |",
        f"{'=' * (k + 1)} {t} {'=' * (k + 1)}", f'{{| class="wikitable"\n! {t} !! {_name(r, zh)}\n|-\n| {n}.{n} || {n}.{n}\n|}}', f"\\section{{{t}}}", f"\\subsection{{{t}}}", f"\\begin{{itemize}}\n\\item {s}\n\\item {s}\n\\end{{itemize}}", f"\\begin{{equation}}\n\\label{{eq:{n}}}\nM = \\frac{{R - C}}{{R}}\n\\end{{equation}}",
        f"$$\n\\text{{EV}} = \\sum_{{t=1}}^{{{n}}} \\frac{{F_t}}{{(1+w)^t}}\n$$", f"<ul>\n<li>{s}</li>\n<li>{s}</li>\n</ul>", f"<table><tr><td>{t}</td><td align=right>{n}.{n}</td></tr></table>", f"<pre><code>rate = {n}.{n}\n</code></pre>", f'<DIV class="note"><H2>{t}</H2>{s}</DIV>', f"<p>{s}</p>\n<p><b>{t}</b> {s}</p>", f"<h{k}>{t}</h{k}>",
    ]
    return (r.choice(block), True) if r.random() < 0.42 else (r.choice(inline), False)


def _honest(r: random.Random, zh: bool) -> tuple[str, bool]:
    """Plain text with characters that markup uses, and whether it stands on a line of its own."""
    n, m, t = r.randint(1, 99), r.randint(1, 99), _name(r, zh)
    inline = [
        f"[{n}]", f"[{n}].", f"P/E < {n} and ROE > {m}", f"PE < {n}", f"ROE > {m}%", f"US${n} to ${m}", f"${n}.{m}bn", f"${n} million", "{base, bull, bear}", f"{{{n}, {m}}}", f"{n}_year", f"item_no {n}", "A|B shares", "R&D", "R&D.", "S&P-style", "AT&T", "M&A", "C#", "C#.", "F#", f"#{n}", f"#{n}.",
        "x ~ y", f"~{n}%", f"about ~{n} million", f"{n}*{m} lots", f"{n} * {m}", "* unaudited", "* unaudited.", "^2 term", f"2^{n % 9}", "net debt == zero?", "a == b", f"k = {n}", "C:\\deals", "D:\\data\\deals.", f"{n} > {m}", f"{n} < {m}", f"<{n}%", f">{n}%", f"info@{r.choice(['abc', 'firm'])}.example", f"[{t}]", f"a -> b", f"{t} | {_name(r, zh)}", f"({n}|{m})", "**", "p*", f"{n}&{m}", "x_i", "B&B & Co", f"= {n}", f"[l{n}]", f"[{n}, {m}]", "sic [sic]",
        "[...]", f"[{t}: {n}]", f"{n}% [{m}]",
    ]
    if r.random() < 0.25:  # several in one sentence
        return ", ".join(r.choice(inline) for _ in range(r.randint(2, 5))), False
    inline += [f"{r.choice(['net', 'op', 'item', 'unit'])}_{r.choice(['no', 'id', 'cost', 'rate'])} {n}", f"{_name(r, False).split()[0].lower()}_{n}"]
    block = [f"- {_plain(r, zh)}", f"[{n}]", f"- {n} -", f"· {n} ·", f"{t} | {_name(r, zh)}", f"{t} | p. {n}", f"{t} | Page {n} of {m}", f"[image {n}: figs/{r.choice('abc')}_{m}.png; caption: {_plain(r, zh)}]", f"{t} [{n}]", f"* unaudited", f"* {t}", f"= {n}", f"{n} / {m}"]
    return (r.choice(block), True) if r.random() < 0.3 else (r.choice(inline), False)


def training(size: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated texts; a node is markup if it overlaps an inserted piece of markup and is not the content of
    a verbatim node that does."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(size):
        zh, table = r.random() < 0.4, r.random() < 0.08
        text, marked = "", []
        if table:
            text = "| a | b |\n| --- | --- |\n"
            for _ in range(r.randint(1, 4)):
                (value, own), good = (_residue(r, zh), True) if r.random() < 0.4 else (_honest(r, zh), False)
                if own or "\n" in value or "|" in value:
                    value, good = _name(r, zh), False
                if good:
                    marked.append((len(text) + 2, len(text) + 2 + len(value)))
                text += f"| {value} | {r.randint(1, 999)}.{r.randint(0, 9)} |"
                if r.random() < 0.15:
                    tail = r.choice(["<br>", "<br/>", "&nbsp;", "</td>", "<BR>"])
                    marked.append((len(text), len(text) + len(tail)))
                    text += tail
                text += "\n"
        else:
            for _ in range(r.randint(1, 6)):
                kind = r.random()
                if kind < 0.45:
                    text += _plain(r, zh) + ("" if zh else " ")
                    continue
                (piece, own), good = (_residue(r, zh), True) if kind < 0.72 else (_honest(r, zh), False)
                if own and text and not text.endswith("\n"):
                    text += r.choice(["\n", "\n\n"])
                if good:
                    marked.append((len(text), len(text) + len(piece)))
                text += piece + (r.choice(["\n", "\n\n"]) if own else r.choice([" ", " ", "", ". ", "\n\n"]))
            if r.random() < 0.3 and len(text) > 60:  # cut as chunks are
                a = r.randrange(len(text) // 2)
                z = r.randrange(a + 20, len(text) + 1)
                text, marked = text[a:z], [(max(0, x - a), y - a) for x, y in marked if y > a and x < z]
            elif r.random() < 0.5:
                text = text.strip("\n")
        nodes = parse(text, table)
        rows += features(text, nodes, table)
        shut: dict[int, bool] = {id(None): False}  # inside verbatim markup nothing is markup of its own
        for n in nodes:
            hit = any(x < n.end and n.start < y for x, y in marked)
            labels.append(hit and not shut[id(n.parent)])
            shut[id(n)] = shut[id(n.parent)] or hit and n.kind in _VERBATIM
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(labels, float)


@cache
def model(size: int = SAMPLE) -> Boosted:
    x, y = training(size)
    return Boosted().fit(x, y)


# ---- cleaning ----


def _plain_tag(n: Node, s: str) -> str:
    closing = s.startswith("</")
    if n.name == "li":
        return "" if closing else "\n- "
    if n.name in ("td", "th"):
        return " |" if closing else " "
    if n.name == "tr":
        return "\n" if closing else "\n|"
    return "\n" if n.name in _BLOCK else ""


def _render(text: str, n: Node, inner: str) -> str:
    """What stands for a markup node; inner is its own text with its children rendered."""
    s = text[n.start : n.end]
    k = n.kind
    if k in ("comment", "script", "divider_line", "footref", "setext", "rule"):
        return ""
    if k == "pre":
        return "\n" + html.unescape(re.sub(r"</?(?:pre|code)\b[^<>]*>", "", s)).strip("\n") + "\n"
    if k == "tag":
        return _plain_tag(n, s)
    if k == "tag_cut":
        return ""
    if k == "entity":
        return html.unescape(s).replace("\xa0", " ")
    if k == "fence":
        return re.sub(r"^```[^\n`]*\n?|\n?```$", "", s)
    if k in ("display", "math"):
        return s.strip("$").strip("\n ")
    if k == "bracketmath":
        return re.sub(r"^\\[\[(]\s*|\s*\\[\])]$", "", s)
    if k == "equation":
        return re.sub(r"\\(?:begin|end)\{[^{}]*\}|\\label\{[^{}]*\}", "", s).strip()
    if k == "env":
        return ""
    if k == "wikirow":
        return "| " + " | ".join(c.strip() for c in inner.lstrip("|").split("||")) + " |"
    if k == "command":
        lead = " " if s.startswith("~") else ""
        if n.name in ("cite", "citep", "citet", "ref", "eqref", "label", "includegraphics"):
            return ""
        if n.name == "item":
            return "- "
        args = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", s)
        if n.name == "frac" and len(args) == 2:
            return f"{lead}{args[0]}/{args[1]}"
        if n.name in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title", "caption"):
            return f"\n{args[0] if args else ''}\n"
        return lead + (" ".join(args) if args else s.lstrip("~") if n.name in _COMMANDS else "")
    if k == "escape":
        return "\n" if s == "\\\\" else s[1:]
    if k == "wikitable":
        return ""
    if k == "wikihdr":
        return "| " + " | ".join(c.strip() for c in s.lstrip("!").split("!!")) + " |"
    if k == "template":
        parts = [p.split("=", 1)[-1].strip() for p in s.strip("{}").split("|")[1:]]
        return " ".join(p for p in parts if p)
    if k == "wikilink":
        body = s[2:-2]
        return re.sub(r"\.(?:png|jpe?g|svg|gif)$", "", body.split("|")[0].split(":", 1)[1]) if re.match(r"(?:File|Image|文件|图像):", body) and "|" not in body else body.rsplit("|", 1)[-1]
    if k == "image":
        return s[2 : s.index("](")]
    if k == "link":
        return inner[1 : inner.rindex("](")]
    if k == "extlink":
        return s[1:-1].split(" ", 1)[1] if " " in s else ""
    if k == "footdef":
        return ""
    if k == "task":
        return "- "
    if k in ("heading", "quote"):
        return ""
    if k == "wikihead":
        return inner.strip().strip("=").strip()
    if k in ("row", "divider"):
        return inner
    if k == "bullet":
        return "- "
    if k in ("bold", "strike"):
        return inner[2:-2]
    if k in ("italic", "code"):
        return inner[1:-1]
    if k == "wikiquote":
        return inner.strip("'")
    if k == "wikicell":
        return " | "
    return "" if set(s) <= set("*~`$#>") or len(s) > 1 and set(s) <= set("=_") else s


def _clean_once(text: str, table: bool, nodes: list[Node], label: dict[int, bool]) -> str:
    def build(a: int, z: int, kids: list[Node]) -> str:
        out, at = [], a
        for n in kids:
            if n.start < at:
                continue
            out.append(text[at : n.start])
            inner = build(n.start, n.end, n.kids)
            out.append(_render(text, n, inner) if label[id(n)] else inner)
            at = n.end
        out.append(text[at:z])
        return "".join(out)

    return build(0, len(text), [n for n in nodes if n.parent is None])


def labels_of(texts: list[str], tables: list[bool], trees: Boosted) -> list[tuple[list[Node], list[bool]]]:
    """Nodes and labels of each text, with one call of the trees for all."""
    parsed = [parse(t, k) for t, k in zip(texts, tables)]
    rows = chain.from_iterable(features(t, n, k) for t, k, n in zip(texts, tables, parsed))
    logits = np.concatenate([np.zeros(0), *(trees.logit(np.array(some, float)) for some in batched(rows, ROWS))])
    out, at = [], 0
    for n in parsed:
        out.append((n, decode(n, logits[at : at + len(n)])))
        at += len(n)
    return out


def clean(texts: list[str], tables: list[bool], trees: Boosted) -> list[tuple[str, int, str]]:
    """(clean text, markup nodes, their kinds) of each text. Text that markup hid (escaped tags) is cleaned again, as long as it gets shorter."""
    found = labels_of(texts, tables, trees)
    counts = [sum(y) for _, y in found]
    kinds = [",".join(sorted({n.kind for n, y in zip(nodes, ys) if y})) for nodes, ys in found]
    out = list(texts)
    while True:
        again = []
        for i, (nodes, ys) in enumerate(found):
            if any(ys):
                new = _clean_once(out[i], tables[i], nodes, {id(n): y for n, y in zip(nodes, ys)})
                old = len(out[i])
                out[i] = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", new)).strip("\n")
                if len(out[i]) < old and any(y and n.kind == "entity" for n, y in zip(nodes, ys)) and re.search(r"</?[A-Za-z]|&[#\w]+;", out[i]):
                    again.append(i)
        if not again:
            break
        # only what was escaped is markup now: what the first round kept (formulas, code, tables) is not judged again
        redo = dict(zip(again, labels_of([out[i] for i in again], [tables[i] for i in again], trees)))
        found = [(redo[i][0], [y and n.kind in ("tag", "entity", "comment") for n, y in zip(*redo[i])]) if i in redo else ([], []) for i in range(len(out))]
    return list(zip(out, counts, kinds))


def _run(trees: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, tables = b.column("text").to_pylist(), [t == "table" for t in b.column("kind").to_pylist()]
            for a, z in groups(texts):
                out, n, kinds = zip(*clean(texts[a:z], tables[a:z], trees))
                own = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([own.column("tbl"), own.column("row_key"), pa.array(out, pa.string()), pa.array(n, pa.int32()), pa.array(kinds, pa.string())], names=["tbl", "row_key", "text", "n_nodes", "kinds"])

    return run


SCHEMA = "tbl string, row_key string, text string, n_nodes int, kinds string"


def cleaned(rows: DataFrame, all_rows: bool = False) -> DataFrame:
    """(tbl, row_key, text, n_nodes, kinds) of ``rows(tbl, row_key, text, kind)``: those that held markup, or with ``all_rows`` all of them.
    Rows without any character that markup uses do not leave the JVM."""
    hot = F.col("text").rlike(TRIGGER) & ((F.col("kind") != "table") | F.regexp_replace("text", r"(?m)[|\-\s]", "").rlike(TRIGGER) | F.col("kind").isNull())
    hot = F.coalesce(hot, F.lit(False))
    done = rows.filter(hot).mapInArrow(_run(model()), SCHEMA)
    if not all_rows:
        return done.filter("n_nodes > 0")
    rest = rows.filter(~hot).select("tbl", "row_key", "text", F.lit(0).alias("n_nodes"), F.lit("").alias("kinds"))
    return done.unionByName(rest)
