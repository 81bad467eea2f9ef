"""Character forms and array views of text, shared by the operators of this subpackage.

``fold`` brings width, composition, invisible characters, blanks, ligatures and CJK presentation forms to one form; ``shape`` also maps
letters of other scripts that look like Latin ones. Both keep case, accents, punctuation, wording and numbers. A null gives ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np

# Letters of the same shape as a Latin letter (a public subset of Unicode's confusables).
LOOKALIKE = str.maketrans(
    "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝԚԜ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϹϲϳ" + "օՏ" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏃᏚᏞᏟᏢᏦᏴ" + "ɑɡ",
    "ABEKMHOPCTYXSIJaeopcyxsijhdqwQW" + "ABEZHIKMNOPTYXoCcj" + "oS" + "DRTAJEWMHZSLCPKB" + "ag",
)
# Signs of the same shape as an ASCII sign.
SIGNS = {"‐": "-", "‑": "-", "﹣": "-", "․": ".", "∶": ":", "∼": "~", "∣": "|", "⁄": "/", "∕": "/", "ǃ": "!"}
#: Letters, digits and marks of one token outside CJK.
_WORD = "0-9A-Za-zÀ-ÖØ-öø-ʯ̀-ϿЀ-ԯԱ-Ֆա-ևᎠ-᏿"
WORD = re.compile(f"[{_WORD}]+")
_ALIKE = "".join(map(chr, LOOKALIKE))
SUSPECT = re.compile(f"[{_WORD}]*[{_ALIKE}][{_WORD}]*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯԱ-ևᎠ-᏿]")
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2}


def _forms() -> dict[int, str]:
    """By rule: what each presentation form, blank or invisible character stands for."""
    out = {c: "" for c in chain(range(0, 9), (11, 12), range(14, 32), (127,))} | {9: " ", 13: "\n"}
    for cp in chain(range(0x80, 0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800), range(0x2F800, 0x2FA20), range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        tag = form.split(" ")[0] if form.startswith("<") else ""
        if kind == "Cf" and cp not in _VISIBLE_FORMAT or 0xFE00 <= cp <= 0xFE0F or cp in (0x34F, 0x115F, 0x1160, 0x3164) or cp >= 0xE0000:
            out[cp] = ""
        elif kind == "Zs":
            out[cp] = " "
        elif kind in ("Zl", "Zp") or cp == 0x85:
            out[cp] = "\n"
        elif kind == "Cc":
            out[cp] = ""
        elif tag in ("<wide>", "<narrow>", "<font>", "<vertical>") or tag == "<compat>" and (0xFB00 <= cp <= 0xFB06 or 0x2E80 <= cp <= 0x2FDF or 0x2160 <= cp <= 0x217F):
            out[cp] = unicodedata.normalize("NFKC", ch)
        elif form and not tag and " " not in form:
            out[cp] = unicodedata.normalize("NFC", ch)
    return out | {ord(a): b for a, b in SIGNS.items()}


def _ranges(points: list[int]) -> str:
    spans: list[list[int]] = []
    for p in sorted(points):
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]"


_FORMS = _forms()
_ODD = re.compile(_ranges(list(_FORMS)))


def fold(text: str | None) -> str:
    """One form for width, composition, invisible characters, blanks, ligatures and CJK forms. Plain text is returned as it is."""
    if not text:
        return ""
    if _ODD.search(text):
        text = text.replace("\r\n", "\n").translate(_FORMS)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def latin(token: str) -> str | None:
    """The token in Latin letters, if every letter of another script in it looks like one; else None. Single lower-case Greek
    letters are symbols and stay."""
    out = token.translate(LOOKALIKE)
    if out == token or _FOREIGN.search(out) or len(token) == 1 and "α" <= token <= "ϲ":
        return None
    return out


def shape(text: str | None) -> str:
    """``fold``, then every token that can be read as Latin in Latin letters."""
    text = fold(text)
    return SUSPECT.sub(lambda m: latin(m[0]) or m[0], text) if not text.isascii() else text


@cache
def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the number of the text of each."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return points("".join(texts)), np.repeat(np.arange(len(texts)), lengths)


def groups(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Spans of rows with about ``most`` characters, so that array memory stays bounded; one longer text is a span of its own."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes its argument in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows(units: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window of ``width`` units that stays inside its owner, and the windows' starts. Built by doubling, so that the
    cost is logarithmic in the width."""
    n = len(units) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = 0x9E3779B97F4A7C15
    power, span, bits = units.astype(np.uint64), 1, width
    acc: np.ndarray | None = None
    done = 0
    while bits:
        if bits & 1:
            part = power[done : done + n]
            acc = part.copy() if acc is None else acc * np.uint64(pow(base, span, 1 << 64)) + part
            done += span
        bits >>= 1
        if bits:
            power = power[:-span] * np.uint64(pow(base, span, 1 << 64)) + power[span:]
            span *= 2
    starts = np.nonzero(owner[:n] == owner[width - 1 :])[0]
    return mix(acc[starts]), starts
