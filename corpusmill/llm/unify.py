"""Visually identical text with different characters: script-aware repair.

Every text is folded (width, composition, invisible characters, blanks, presentation forms). In the folded text each token with letters beyond
plain Latin gets a dominant script: the one with most letters that no other script has in that shape, then the one with most letters, then the
script of the rest of its text. A token of mixed scripts is suspect; its readings are the token with all other letters replaced by look-alikes
of the dominant script, then of its other scripts. A token made wholly of look-alikes counts as mixed where the rest of its text is written in
another script (Latin if nothing tells). The first reading that the corpus vocabulary attests, whatever its case, replaces the token; a token
without an attested reading stays as it is, in the text and in the comparison key, which is the hash of the repaired text.

The vocabulary is every token of every text that is not suspect. It is found in the same pass that folds the texts and never collected: readings
meet it in a shuffle join. Copies of a text are repaired once.

Nulls and empty texts give ''; they are no pairs. Exact repeats of a row count once. Very long texts are folded whole. Other columns are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .classes import BLOCK, between, inside
from .textkit import LOOKALIKE, WORD, fold

# More letters of a Latin letter's shape; they are too common in symbols to be read as Latin without a vocabulary.
_MORE = dict(zip("νριυѵոսհց", "vpiuvnuhg"))
_SKELETON = {chr(a): chr(b) for a, b in LOOKALIKE.items()} | _MORE
_RANGES = {"latin": "A-Za-zÀ-ÖØ-öø-ɏ", "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "armenian": "Ա-ֆ", "cherokee": "Ꭰ-᏿"}
_OF = {s: re.compile(f"[{r}]") for s, r in _RANGES.items()}
_BEYOND = re.compile("[ɑɡͰ-ϿЀ-ԯԱ-ֆᎠ-᏿]")
#: For each script, its letter of a Latin letter's shape.
_LETTER: dict[str, dict[str, str]] = {s: {} for s in _RANGES}
for _c, _l in _SKELETON.items():
    for _s, _p in _OF.items():
        if _p.match(_c):
            _LETTER[_s].setdefault(_l, _c)
_LETTER["latin"] = {c: c for c in _SKELETON.values()}
SUSPECTS = "array<struct<token: string, readings: array<string>>>"
_SUSPECTS = pa.list_(pa.struct([("token", pa.string()), ("readings", pa.list_(pa.string()))]))


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@cache
def _script(c: str) -> str:
    return next((s for s, p in _OF.items() if p.match(c)), "")


@cache
def _ambiguous(c: str) -> bool:
    """Whether another script has a letter of the same shape."""
    own, plain = _script(c), _SKELETON.get(c, c)
    return not own or any(plain in letters for s, letters in _LETTER.items() if s != own)


def _as(token: str, script: str) -> str | None:
    """The token in letters of one script; None if a letter has no look-alike there."""
    out = []
    for c in token:
        if c.isalpha() and _script(c) != script:
            c = _LETTER[script].get(_SKELETON.get(c, c), "")
            if not c:
                return None
        out.append(c)
    return "".join(out)


def scripts_of(token: str, around: str = "latin") -> list[str]:
    """The scripts of a token's letters, the dominant one first. ``around``: the script of the rest of the text."""
    letters = [c for c in token if c.isalpha()]
    every = Counter(_script(c) for c in letters)
    sure = Counter(_script(c) for c in letters if not _ambiguous(c))
    every.pop("", None)
    return sorted(every, key=lambda s: (-sure[s], -every[s], s != around, s))


def readings(token: str, around: str) -> list[str]:
    """What a suspect token may stand for, likeliest first; empty if it is not suspect."""
    own = scripts_of(token, around)
    mixed = len(own) > 1 or any(c.isalpha() and not _script(c) for c in token)
    if not mixed:
        if not own or own[0] == around or not all(_ambiguous(c) for c in token if c.isalpha()) or len(token) == 1 and "α" <= token <= "ϲ":
            return []
        own = [around]
    return list(dict.fromkeys(r for s in own or ["latin"] if (r := _as(token, s)) and r != token))


def examine(text: str) -> tuple[list[dict], list[str]]:
    """The suspect tokens of a folded text with their readings, and its other tokens in lower case."""
    if text.isascii() or not _BEYOND.search(text):
        return [], WORD.findall(text.lower())
    tokens = dict.fromkeys(WORD.findall(text))
    weight: Counter[str] = Counter()
    for t in tokens:
        if not _BEYOND.search(t):
            weight["latin"] += sum(map(str.isalpha, t))
        elif any(not _ambiguous(c) for c in t):
            weight[scripts_of(t)[0]] += len(t)
    around = max(weight, key=lambda s: (weight[s], s == "latin")) if weight else "latin"
    suspects, clean = [], []
    for t in tokens:
        if found := readings(t, around) if _BEYOND.search(t) else []:
            suspects.append({"token": t, "readings": found})
        else:
            clean.append(t.lower())
    return suspects, clean


def _scan(whole: bool):
    """Rows of texts (keys, raw, fid, folded, suspects), and of tokens (token) for the vocabulary, distinct within stretches of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        layout: pa.Schema | None = None
        for b in batches:
            raw, fid, text, suspects = [], [], [], []
            for t in b.column("text").to_pylist():
                f = fold(t)
                odd, clean = examine(f)
                seen.update(clean)
                raw.append(digest(t or ""))
                fid.append(raw[-1] if f is t else digest(f))
                text.append(f if odd or whole else None)
                suspects.append(odd)
            names = [n for n in b.schema.names if n != "text"]
            cols = [*(b.column(n) for n in names), pa.array(raw, pa.binary()), pa.array(fid, pa.binary()), pa.array(text, pa.string()), pa.array(suspects, _SUSPECTS), pa.nulls(len(raw), pa.string())]
            out = pa.RecordBatch.from_arrays(cols, names=[*names, "raw", "fid", "folded", "suspects", "token"])
            layout = out.schema
            yield out
            if len(seen) > 200_000:
                yield _tokens(seen, layout)
                seen.clear()
        if seen and layout is not None:
            yield _tokens(seen, layout)

    return run


def _tokens(seen: set[str], layout: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), f.type) if f.name == "token" else pa.nulls(len(seen), f.type) for f in layout], schema=layout)


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, known in zip(b.column("folded").to_pylist(), b.column("known").to_pylist()):
            by = {x["token"]: x["reading"] for x in known}
            out.append(WORD.sub(lambda m: by.get(m[0], m[0]), text))
        yield pa.RecordBatch.from_arrays([b.column("fid"), pa.array(out, pa.string()), pa.array(list(map(digest, out)), pa.binary())], names=["fid", "text", "look"])


def _repaired(scanned: DataFrame) -> DataFrame:
    """(fid, text, look) of the folded texts in which a token has an attested reading."""
    vocab = scanned.filter("token is not null").select(F.col("token").alias("word")).distinct()
    texts = scanned.filter(F.size("suspects") > 0).groupBy("fid").agg(F.first("folded").alias("folded"), F.first("suspects").alias("suspects"))
    tokens = texts.select("fid", F.explode("suspects").alias("s")).select("fid", "s.token", "s.readings")
    tried = tokens.select("token", "readings").distinct().select("token", "readings", F.posexplode("readings").alias("at", "reading"))
    attested = tried.join(vocab, F.lower("reading") == F.col("word"), "left_semi").groupBy("token", "readings").agg(F.min_by("reading", "at").alias("reading"))
    known = tokens.join(attested, ["token", "readings"]).groupBy("fid").agg(F.collect_list(F.struct("token", "reading")).alias("known"))
    return texts.join(known, "fid").mapInArrow(_replaced, "fid binary, text string, look binary")


def _scanned(df: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return stage_table(df.select(*keys, "text").mapInArrow(_scan(whole), f"{schema}, raw binary, fid binary, folded string, suspects {SUSPECTS}, token string"))


def looks(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and, for each row's ``text``: ``raw`` (hash of the stored string), ``look`` (hash of its consistent form). Written once."""
    scanned = _scanned(df, keys, False)
    rows = scanned.filter("token is null").select(*keys, "raw", "fid", (F.size("suspects") > 0).alias("odd"))
    fixed = rows.filter("odd").join(_repaired(scanned).select("fid", "look"), "fid", "left")
    return stage_table(rows.filter("not odd").select(*keys, "raw", F.col("fid").alias("look")).unionByName(fixed.select(*keys, "raw", F.coalesce("look", "fid").alias("look"))))


def unify(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``text`` in its one consistent form, for every row of ``df(keys..., text)``."""
    scanned = _scanned(df, keys, True)
    rows = scanned.filter("token is null")
    odd = rows.filter(F.size("suspects") > 0).select(*keys, "fid", "folded").join(_repaired(scanned).select("fid", "text"), "fid", "left")
    return rows.filter(F.size("suspects") == 0).select(*keys, F.col("folded").alias("text")).unionByName(odd.select(*keys, F.coalesce("text", "folded").alias("text")))


def class_pairs(members: DataFrame, full: int = BLOCK) -> DataFrame:
    """(key_a, key_b) for all members ``(key, look, raw)`` that share ``look`` and differ in ``raw``, the smaller key first. Classes of one
    spelling are dropped before the joins. Spellings are paired first, then their members, so copies of a spelling are never compared;
    hot looks and spellings are dealt into cells of about ``full``."""
    classes = members.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo < hi").select("look")
    several = members.join(classes, "look", "left_semi").distinct()
    own = stage_table(several.select("look", F.struct("look", "raw").alias("cls"), F.col("key").alias("member")))
    spellings = own.select(F.col("look").alias("cls"), F.col("cls").alias("member")).distinct()
    pairs = between(inside(spellings, full), own.select("cls", "member"), full)
    return pairs.filter("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
