"""Repetition inside a single document, by a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps each rule's measurement and one bit per failed rule; policies are versioned
masks over the bits, so a new policy, or a policy without one of its rules, is an aggregation of bit patterns and reads no text.

Measurements are shares from 0 to 1 of the document's own content: ``windows`` (positions of the text reduced to lower-case letters and
digits that lie in a 30-character substring which started earlier, overlap allowed), ``lines``, ``paragraphs``, ``sentences`` (characters in
units that occurred before) and ``shingles`` (five-word, or five-character for CJK, runs that occurred before).

A null, empty or too short text measures 0 and fails no rule. Very long texts are measured whole. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import alnum_table, groups, joined, windows

WIDTH = 30
#: Rule, in the order of its bit, and the share from which it fails.
RULES = {"windows": 0.30, "lines": 0.30, "paragraphs": 0.30, "sentences": 0.30, "shingles": 0.40}
#: Policy: version, rules it looks at, how many of them must fail.
POLICIES = {"repeated_content": (1, ("windows",), 1), "any_repetition": (2, tuple(RULES), 1), "agreed_repetition": (2, tuple(RULES), 2)}
_SENTENCE = re.compile(r"[^。！？!?.\n]+[。！？!?.\n]*")
_PIECES = {"lines": lambda t: t.split("\n"), "paragraphs": lambda t: re.split(r"\n\s*\n", t), "sentences": _SENTENCE.findall}
SCHEMA = "doc_id bigint, bits int, " + ", ".join(f"{r} double" for r in RULES)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _later(keys: np.ndarray) -> np.ndarray:
    """Indexes of the keys that occurred at a smaller index."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return np.zeros(0, np.int64)
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.concatenate([starts, [len(s)]]))
    many = sizes > 1
    inside = np.repeat(many, sizes)
    part = order[inside]
    first = np.minimum.reduceat(part, np.concatenate([[0], np.cumsum(sizes[many])[:-1]]))
    return part[part != np.repeat(first, sizes[many])]


def window_shares(texts: list[str]) -> np.ndarray:
    """The share of repeated positions of each text."""
    units, owner = joined([t.lower() for t in texts])
    keep = alnum_table()[units]
    units, owner = units[keep], owner[keep]
    total = np.bincount(owner, minlength=len(texts))
    h, starts = windows(units, owner, WIDTH)
    if not len(h):
        return np.zeros(len(texts))
    again = starts[_later(h ^ (owner[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))]
    edge = np.zeros(len(units) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WIDTH, -1)
    covered = np.bincount(owner, weights=np.cumsum(edge[:-1]) > 0, minlength=len(texts))
    return covered / np.maximum(total, 1)


def unit_share(units: list[str]) -> float:
    """The share of characters in units of at least ten characters that occurred before, case and blanks aside."""
    seen: set[str] = set()
    total = again = 0
    for u in units:
        u = "".join(u.lower().split())
        total += len(u)
        if len(u) >= 10:
            again += len(u) * (u in seen)
            seen.add(u)
    return again / total if total else 0.0


_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")


def shingle_share(text: str) -> float:
    words = _TOKEN.findall(text.lower())
    runs = [hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)]
    return 1 - len(set(runs)) / len(runs) if runs else 0.0


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        for a, z in groups(texts):
            part = texts[a:z]
            found = {"windows": window_shares(part)} | {r: np.array([unit_share(f(t)) for t in part]) for r, f in _PIECES.items()}
            found["shingles"] = np.array([shingle_share(t) for t in part])
            bits = sum(((found[r] >= least).astype(np.int32) << i for i, (r, least) in enumerate(RULES.items())), np.zeros(len(part), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:z], pa.int64()), pa.array(bits, pa.int32()), *(pa.array(found[r], pa.float64()) for r in RULES)], names=["doc_id", "bits", *RULES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and failure bits."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_ledger, SCHEMA).distinct()


def failed(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger rows a policy rejects."""
    _, rules, least = POLICIES[policy]
    return rows.filter(F.bit_count(F.col("bits").bitwiseAND(mask(rules))) >= least)


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy, and for it without each of its rules, how many documents it rejects: from counts of bit patterns only."""
    patterns = rows.groupBy("bits").agg(F.count("*").alias("n"))
    cases = [(p, v, left or "", mask(tuple(r for r in rules if r != left)), least) for p, (v, rules, least) in POLICIES.items() for left in (None, *(rules if len(rules) > 1 else ()))]
    variants = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("policy", "version", "without", "mask", "least"), c)]) for c in cases])
    each = patterns.select("bits", "n", F.explode(variants).alias("v")).select("bits", "n", "v.*")
    hit = F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))) >= F.col("least")
    return each.groupBy("policy", "version", "without").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"), F.sum("n").alias("documents"))
