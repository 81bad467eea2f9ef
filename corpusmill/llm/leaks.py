"""Evaluation texts leaking into training text: a BM25 index of the test items, searched by every document with block-max WAND.

An index term is a run of ``TERM`` consecutive tokens, hashed. A field (question or answer) of ``RUN`` or more tokens is one indexed text.
Its threshold is the least score of any ``RUN`` consecutive tokens of it, so a document that quotes ``RUN`` tokens scores at least that, and
retrieval of all texts above their thresholds loses none. Impacts are divided by the threshold, which makes the bar 1 for every text and
lets block maxima skip. The retrieved texts are then verified exactly on tokens.

Token: one CJK character, or one unbroken run of other letters and digits, of the text in its consistent shape and lower case. Documents are
searched whole. The test items are a stated query set: they are indexed in blocks of ``BLOCK`` items, the index of one block is what is
sent to the executors, and every document is searched against every block.

Null and empty texts, and items with fewer than ``RUN`` tokens, match nothing. Repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .textkit import alnum_table, groups, joined, mix, shape, windows

RUN = 16
TERM = 4
BLOCK = 20_000
K1, B = 1.2, 0.75
#: Postings per block of the index.
POSTINGS = 32
_CJK = "㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
TOKEN = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")
SCHEMA = "doc_id bigint, question_id string, field string, run int, score double"


def form(text: str | None) -> str:
    return shape(text).lower()


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per token of all texts, and the number of its text. ``texts`` are in ``form``."""
    units, owner = joined(texts)
    keep = alnum_table()[units]
    cjk = (units >= 0x3400) & (units <= 0x4DBF) | (units >= 0x4E00) & (units <= 0x9FFF) | (units >= 0xF900) & (units <= 0xFAFF) | (units >= 0x20000) & (units <= 0x323AF)
    begin = keep.copy()
    if len(units) > 1:
        begin[1:] &= cjk[1:] | cjk[:-1] | ~keep[:-1] | (owner[1:] != owner[:-1])
    units, owner, begin = units[keep].astype(np.uint64), owner[keep], begin[keep]
    starts = np.nonzero(begin)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(units)) - np.repeat(starts, np.diff(np.append(starts, len(units))))
    parts = mix((units + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix(np.add.reduceat(parts, starts)), owner[starts]


def _bars(ids: np.ndarray, who: np.ndarray, pairs: np.ndarray, impact: np.ndarray, terms: int, n: int) -> np.ndarray:
    """For each text the least score of any ``RUN`` of its tokens: the sum over the distinct terms of a window. Terms stand in order of text and place;
    a term counts in a window from its first place there, so its window sum is taken off again where it stood before within the window."""
    span = RUN - TERM + 1
    bar = np.full(n, math.inf)
    if not len(ids):
        return bar
    key = pairs[:, 0] * n + pairs[:, 1]
    order = np.argsort(key)
    own = impact[order][np.searchsorted(key[order], ids * n + who)]  # what each place's term scores in its text
    place = np.arange(len(ids))
    by = np.lexsort((place, ids * n + who))
    same = np.append(False, (ids[by][1:] == ids[by][:-1]) & (who[by][1:] == who[by][:-1]))
    before = np.full(len(ids), -(10**9))
    before[by[1:]] = np.where(same[1:], by[:-1], -(10**9))  # where the term stood last in this text
    starts = place[: len(ids) - span + 1][who[: len(ids) - span + 1] == who[span - 1 :]]
    for a in range(0, len(starts), 100_000):
        at = starts[a : a + 100_000, None] + np.arange(span)
        score = np.where(before[at] >= at[:, :1], 0.0, own[at]).sum(1)
        np.minimum.at(bar, who[at[:, 0]], score)
    return bar


class Index:
    """The inverted index of one block of items."""

    def __init__(self, items: list[tuple[str, str, str]]) -> None:
        """items: (question_id, field, text)"""
        tokens = [TOKEN.findall(form(t)) for _, _, t in items]
        kept = [i for i, t in enumerate(tokens) if len(t) >= RUN]
        self.names = [items[i][:2] for i in kept]
        self.tokens = [tokens[i] for i in kept]
        h, owner = token_hashes([form(items[i][2]) for i in kept])
        grams, at = windows(h, owner, TERM)
        who = owner[at]
        self.terms, ids = np.unique(grams, return_inverse=True)
        n = len(kept)
        length = np.bincount(who, minlength=n)
        mean = length.mean() if n else 1.0
        pairs, tf = np.unique(np.stack([ids, who], 1), axis=0, return_counts=True) if n else (np.zeros((0, 2), np.int64), np.zeros(0))
        df = np.bincount(pairs[:, 0], minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[pairs[:, 0]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[pairs[:, 1]] / mean))
        bar = _bars(ids, who, pairs, impact, len(self.terms), n)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        term, text, scaled = pairs[order, 0], pairs[order, 1], (impact / bar[pairs[:, 1]])[order]
        edges = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else np.zeros(1, np.int64)
        both = list(zip(text.tolist(), scaled.tolist()))
        self.lists: dict[int, list[tuple[int, float]]] = {int(term[x]): both[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())}
        self.blocks = {t: [(p[min(k + POSTINGS, len(p)) - 1][0], max(x for _, x in p[k : k + POSTINGS])) for k in range(0, len(p), POSTINGS)] for t, p in self.lists.items()}
        self.most = {t: max(x for _, x in b) for t, b in self.blocks.items()}
        self.runs: list[dict[tuple[str, ...], list[int]]] = []
        for t in self.tokens:
            runs: dict[tuple[str, ...], list[int]] = defaultdict(list)
            for k in range(len(t) - RUN + 1):
                runs[tuple(t[k : k + RUN])].append(k)
            self.runs.append(dict(runs))

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every text whose score over these distinct terms reaches its bar."""
        bar, out = 1 - 1e-9, []
        if sum(self.most[t] for t in terms) < bar:
            return out
        at = dict.fromkeys(terms, 0)
        live = list(terms)
        while live:
            live = sorted((t for t in live if at[t] < len(self.lists[t])), key=lambda t: self.lists[t][at[t]][0])
            total, pivot = 0.0, -1
            for k, t in enumerate(live):
                total += self.most[t]
                if total >= bar:
                    pivot = k
                    break
            if pivot < 0:
                break
            text = self.lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and self.lists[live[pivot + 1]][at[live[pivot + 1]]][0] == text:
                pivot += 1
            reach, ends = 0.0, []
            for t in live[: pivot + 1]:
                end, most = next(((e, m) for e, m in self.blocks[t][at[t] // POSTINGS :] if e >= text), (None, 0.0))
                reach += most
                if end is not None:
                    ends.append(end)
            if reach < bar:  # no text up to the nearest block end can reach the bar
                target = min([e + 1 for e in ends] + [self.lists[t][at[t]][0] for t in live[pivot + 1 : pivot + 2]])
            elif self.lists[live[0]][at[live[0]]][0] == text:
                score = sum(self.lists[t][at[t]][1] for t in live[: pivot + 1])
                if score >= bar:
                    out.append((text, score))
                target = text + 1
            else:
                target = text
            for t in live[: pivot + 1]:
                p = self.lists[t]
                while at[t] < len(p) and p[at[t]][0] < target:
                    at[t] += 1
        return out

    def run(self, words: list[str], text: int) -> int:
        """The longest run of consecutive tokens the document shares with the text, 0 if below ``RUN``."""
        best, own, k = 0, self.tokens[text], 0
        while k + RUN <= len(words):
            longest = 0
            for j in self.runs[text].get(tuple(words[k : k + RUN]), ()):
                n = RUN
                while k + n < len(words) and j + n < len(own) and words[k + n] == own[j + n]:
                    n += 1
                longest = max(longest, n)
            best, k = max(best, longest), k + max(1, longest - RUN + 1)
        return best


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(form, b.column("text").to_pylist())), pa.string())], names=["doc_id", "text"])


def _search(index: Index, formed: bool = False):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = index.terms
        small = np.zeros(1 << 18, bool)
        small[(terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            forms = texts if formed else [form(t) for t in texts]
            rows: list[tuple] = []
            for a, z in groups(forms):
                h, owner = token_hashes(forms[a:z])
                grams, at = windows(h, owner, TERM)
                maybe = np.nonzero(small[(grams & np.uint64((1 << 18) - 1)).astype(np.int64)])[0]
                place = np.minimum(np.searchsorted(terms, grams[maybe]), max(0, len(terms) - 1))
                hit = terms[place] == grams[maybe] if len(terms) else np.zeros(0, bool)
                per: dict[int, set[int]] = defaultdict(set)
                for d, t in zip(owner[at[maybe[hit]]].tolist(), place[hit].tolist()):
                    per[d].add(t)
                for d, found in per.items():
                    above = index.above(list(found))
                    words = TOKEN.findall(forms[a + d]) if above else []
                    for text, score in above:
                        if n := index.run(words, text):
                            rows.append((ids[a + d], *index.names[text], n, score))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()))], names=["doc_id", "question_id", "field", "run", "score"])

    return search


def leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, question_id, field, run, score): each document with each test text it quotes by ``RUN`` tokens or more."""
    texts = items.select("question_id", F.explode(F.create_map(F.lit("question"), "question", F.lit("answer"), "ground_truth")).alias("field", "text")).filter("text <> ''").distinct()
    docs = docs.filter("text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    parts = max(1, math.ceil(texts.count() / block))
    if parts > 1:  # the texts are brought to their form once, not once a block
        docs = stage_table(docs.mapInArrow(_forms, "doc_id bigint, text string"))
    out = None
    for k in range(parts):
        own = texts.filter(F.pmod(F.xxhash64("question_id", "field", "text"), F.lit(parts)) == k)
        index = Index([tuple(r) for r in own.orderBy("question_id", "field", "text").collect()])  # at most about ``block`` short texts
        found = docs.mapInArrow(_search(index, parts > 1), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "question_id", "field").agg(F.max("run").alias("run"), F.max("score").alias("score"))
