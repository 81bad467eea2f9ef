"""Broken prompt and response pairs, by ordered rules.

Rules, in the order that decides a pair's one type: ``empty`` (null, blank, only a placeholder), ``copy`` (only gives back the question),
``refusal`` (multilingual phrases about not answering; an undisclosed figure is an answer unless the reference has one), ``language``
(another script or language than the question, which does not ask for it), ``truncated`` (unclosed delimiters, open punctuation or a word
that cannot end, a proper prefix of the reference, or an unstopped sentence whose last words, where they stand elsewhere in the corpus, do not
end their sentence ``WHOLE`` times as often as they go on). Every triggered type is emitted as a bit.

The corpus for this are all responses, references and (where there are any) retrieved contexts. Being a ratio, the rule is the same at every
size: one chance sentence with such an end excuses nothing. The counts meet the pairs in a join. Null questions and references are taken as
''. Repeated samples count once (the latest arrival). Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_table
from .bits import bit_filter, has
from .textkit import fold, shape

#: How many times as often the last words of a whole sentence end one as they go on.
WHOLE = 2
TYPES = ("empty", "copy", "refusal", "language", "truncated")
# Placeholders, lower case, without blanks.
_PLACEHOLDER = re.compile(r"[\W_]*(?:n/?a|none|null|nil|nan|tb[ad]|todo|placeholder|empty|无|暂无|空|待补充|待定|略|none?provided|noanswer|\{[\"']?answer[\"']?:[\"']*(?:null)?[\"']*\})?[\W_]*", re.I)
# Phrases of declining to answer.
_REFUSAL = re.compile(
    r"(?:can ?not|can['’]t|could not|couldn['’]t|(?:am|are|is) (?:not able|unable)|unable) (?:to )?(?:\w+ ){0,3}?(?:answer|respond|give|provide|share|comment|determine|tell|say|assist|help|find)\b"
    r"|no answer can be given|have no answer|can['’]t be (?:settled|answered|determined)|cannot be (?:settled|answered|determined)|not (?:hold |contain |have )?(?:enough|sufficient) (?:information|context|material)|insufficient (?:information|context)"
    r"|(?:must|have to) decline|decline to (?:answer|comment)|rather not (?:speculate|say|answer|comment)|do(?:es)? not (?:give|provide|share) (?:numbers|figures|advice|such)|documents are silent|(?:do|does) not (?:mention|cover|contain) .{0,60}(?:so|therefore|thus)|i (?:do not|don['’]t) know"
    r"|(?:无法|不能|不便|恕难|难以|无从|暂不能|不予)(?:直接|给出|就此|对此)?(?:作答|回答|答复|回复|给出(?:答案|回答|结论)|提供(?:答案|此类|该|这)|判断该|评论)|不便对.{0,16}(?:发表|评论|置评)|恕难|回答不了|不足以(?:回答|作答|判断)|不提供此类|无法给出答案|无可奉告|我不(?:知道|清楚)"
    r"|nicht beantworten|kann ich (?:leider )?(?:nicht|keine)|keine (?:antwort|auskunft) (?:geben|möglich)|ne (?:peux|puis) pas (?:répondre|fournir|donner)|pas en mesure de répondre|no puedo (?:responder|contestar|dar|proporcionar)|no es posible responder|お答えできません|回答できません|答えられません|わかりません",
    re.I,
)
_UNDISCLOSED = re.compile(r"not disclosed?|did not disclose|undisclosed|未(?:予)?披露|未公布|没有披露", re.I)
_ASKS = re.compile(r"\b(?:chinese|english|german|french|spanish|japanese|translat\w*|language)\b|英文|中文|英语|汉语|德语|法语|日语|日文|西班牙语|翻译|译成|译为", re.I)
# Frequent function words.
_STOP = {
    "en": set("the of and in to was is for with because a an by at from that its on as which were has had this it".split()),
    "de": set("der die das und von im bei lag wegen vor allem den des mit für ein eine ist war nicht zu auf neuer höherer geringerer".split()),
    "fr": set("le la les des du de et est était pour sur en raison une un dans par niveau période que qui".split()),
    "es": set("el la los las de en y por con sobre todo que un una del para fue alcanzó mayores menores nuevos".split()),
    "it": set("il lo la gli di del della e per con che un una nel sono stato alla".split()),
    "pt": set("o os as do da dos em e por com que um uma no na foi pelo".split()),
}
_HAN, _KANA, _LATIN, _HANGUL, _CYR = (re.compile(f"[{r}]") for r in ("㐀-䶿一-鿿", "ぁ-ヿ", "A-Za-zÀ-ɏ", "가-힣", "Ѐ-ӿ"))
_WORDS = re.compile(r"[A-Za-zÀ-ɏ]+")
_HAN_RUN = re.compile("[㐀-䶿一-鿿]+")
_FRAME = set("the question is about you asked ask asking request please state what which how did does was in of for and why to restated user query prompt would like want wish know wondering had that 想 了 解 知 道 情 况 问 题 是 关 于 您 的 你 在 时 请 说 明 用 户 提".split())
# Words that cannot end an answer.
_OPEN_WORDS = set("of the a an in and because with to for by at from on was is were its than as since although while but or that which into over compared reached stood came".split())
_OPEN_HAN = re.compile(r"(?:的|在|为|与|和|及|或|由于|因为|主要|达到|约|但|而|对|从|将|以及|其中|同期|是|录得|以)$")
_CLOSE = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "”": "“", "》": "《"}
_STOPS = "。！？!?."
_STOP_AT = re.compile(r"[。！？!?]|\.(?=\s|$)")


def language(text: str) -> str | None:
    """The language of a text of several words, None if there is too little to tell. Names and capitals tell nothing."""
    han, kana, latin = len(_HAN.findall(text)), len(_KANA.findall(text)), len(_LATIN.findall(text))
    if len(_HANGUL.findall(text)) > 3:
        return "ko"
    if len(_CYR.findall(text)) > 8:
        return "ru"
    if kana >= 3:
        return "ja"
    if han >= 5 and han * 3 >= latin * 0.5:
        return "zh"
    words = [w for w in _WORDS.findall(text)]
    plain = [w.lower() for w in words if w.islower()]
    scores = {k: sum(w.lower() in s for w in words) for k, s in _STOP.items()}
    best = max(scores, key=lambda k: scores[k])
    if len(plain) < 3 and scores[best] < 2:
        return None
    return best if scores[best] >= 2 and (best == "en" or scores[best] > scores["en"]) else "en" if scores["en"] or len(plain) >= 4 else None


def _letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", shape(text).lower())


def is_copy(question: str, response: str) -> bool:
    """Whether a response has nothing but the question: its letters, or its words and a frame around them."""
    q, r = _letters(question), _letters(response)
    if not q or not r:
        return False
    if r == q or (len(r) >= 0.6 * len(q) and q.startswith(r)):
        return True
    split = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")
    own, asked = split.findall(shape(response).lower()), split.findall(shape(question).lower())
    known = set(asked)
    if any(re.search(r"\d", w) and w not in known for w in own):
        return False
    new = [w for w in own if w not in known and w not in _FRAME]
    old = [w for w in own if w in known and w not in _FRAME]
    framed = bool(re.search(r"question|asked|asking|query|you (?:would like|want|wish) to know|you are wondering|问题|您问|你问|题目|请问|提问|[您你]想(?:了解|知道)", response, re.I))
    return len(old) >= 0.4 * len({w for w in asked if w not in _FRAME}) and (not new or framed and len(new) <= 0.1 * len(own)) and (framed or len(own) >= 0.75 * len(asked) and own[0] == asked[0])


def unclosed(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if c in _CLOSE.values():
            stack.append(c)
        elif c in _CLOSE and stack and stack[-1] == _CLOSE[c]:
            stack.pop()
    return bool(stack) or text.count("```") % 2 == 1 or (text.lstrip()[:1] in '{["' and text.count('"') % 2 == 1)


_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def tail(text: str) -> str | None:
    """The last words of a text, digits as #, by which ends of sentences are compared."""
    t = _NUMBER.sub("#", fold(text).strip().lower()).rstrip("\"'”’」』)）*_` ")
    if _HAN.search(t[-5:]):
        return t[-5:]
    words = t.split()
    return " ".join(words[-3:]) if words else None


class Asked:
    """The tails that are asked about: all of them where they are few, beyond ``FEW`` a bit filter, whose false positives the join leaves out."""

    FEW = 100_000

    def __init__(self, tails: DataFrame) -> None:
        few = tails.count() <= self.FEW
        self.all = frozenset(r[0] for r in tails.collect()) if few else None
        self.bits = b"" if few else bit_filter(tails)
        self.words = frozenset(t.rsplit(" ", 1)[-1] for t in self.all) if few else None
        self.signs = frozenset(t[-1] for t in self.all) if few else None

    def __contains__(self, tail: str) -> bool:
        return tail in self.all if self.all is not None else has(self.bits, tail)


def runs(text: str, asked: Asked) -> Iterator[str]:
    """Tails asked about where the text goes on: runs of three words, and of five characters with Chinese ones, that no stop follows."""
    t = _NUMBER.sub("#", text.lower())
    words = t.split()
    for i in range(2, len(words)):
        if asked.words is None or words[i] in asked.words:
            yield f"{words[i - 2]} {words[i - 1]} {words[i]}"
    for m in _HAN_RUN.finditer(t):
        for i in range(max(5, m.start() + 1), min(m.end() + 5, len(t))):
            if t[i] not in _STOPS and (asked.signs is None or t[i - 1] in asked.signs):
                yield t[i - 5 : i]


def ends(text: str) -> list[str]:
    """Tails of the sentences of a text that end with a stop."""
    out = [tail(text[: m.start()]) for m in _STOP_AT.finditer(text)]
    return [x for x in out if x]


def open_end(question: str, response: str, reference: str) -> tuple[bool, str | None]:
    """Whether a response surely stops early; else, if only its last words can tell, these."""
    r, f = fold(response).strip(), fold(reference).strip()
    if unclosed(r):
        return True, None
    bare = r.rstrip("*_`\"'”’」』 ")
    if bare.endswith(("...", "…")) or bare[-1:] in ",，、;；:：-—(（[" :
        return True, None
    if bare[-1:] in _STOPS or bare[-1:] in ")）]}】" and len(_WORDS.findall(bare)) < 3 or bare[-1:] in "]}":
        return False, None
    if len(f) > len(r) and f.startswith(r) and f[len(r)] not in _STOPS + "；;" and not re.fullmatch(r"[^\s]*\d[\d.,]*\s?(?:%|million|billion|units|亿元|万元|个基点)?", r):
        return True, None
    if re.search(rf"[{_STOPS}][\"”)）]?\s*[*_`]*[^\s{_STOPS}]{{0,4}}\d[\d.,]*\s?(?:%|[^\W\d]{{1,12}}|basis points)?[*_`]*$", r):
        return False, None  # a value after a whole sentence
    words = r.split()
    last = words[-1].lower().strip("*_`") if words else ""
    if last in _OPEN_WORDS or _OPEN_HAN.search(bare) and len(bare) > 4:
        return True, None
    if "\n" in r or re.match(r"[-*•]\s|\{|\[", r):
        final = r.split("\n")[-1]
        return (True, None) if re.fullmatch(r"\s*[-*•]\s*(?:[^:：]{0,30}[:：])?\s*", final) else (False, None)
    han = len(_HAN.findall(r))
    sentence = han > 14 or "，" in r or len(words) > 7 and len([w for w in words if w.islower()]) > 3
    return False, tail(r) if sentence else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits, tails = [], []
        for q, r, f in zip(*(b.column(n).to_pylist() for n in ("user_input", "response", "reference"))):
            q, r, f = fold(q), r or "", f or ""
            plain = re.sub(r"\s+", "", fold(r))
            if _PLACEHOLDER.fullmatch(plain):
                bits.append(1)
                tails.append(None)
                continue
            text = shape(r)
            found = 2 * is_copy(q, r)
            hidden = _UNDISCLOSED.search(text) and len(_STOP_AT.findall(text)) <= 1 and bool(f.strip()) and not _UNDISCLOSED.search(f)
            found |= 4 * bool(_REFUSAL.search(text) or hidden)
            asked, given = language(shape(q)), language(text)
            found |= 8 * bool(asked and given and asked != given and not _ASKS.search(q))
            early, last = open_end(q, r, f)
            found |= 16 * early
            bits.append(int(found))
            tails.append(last)
        yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(bits, pa.int32()), pa.array(tails, pa.string())], names=["sample_id", "bits", "tail"])


def _ends(asked: Asked):
    """(tail, ends, goes): for the tails asked about, how often they end a sentence and how often they go on, summed within a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for n in ("response", "reference") for t in b.column(n).to_pylist() if t]
            if "retrieved_contexts" in b.schema.names:
                texts += [t for c in b.column("retrieved_contexts").to_pylist() if c for t in c if t]
            n: Counter[str] = Counter()
            goes: Counter[str] = Counter()
            for t, k in Counter(map(fold, texts)).items():
                for e in ends(t):
                    n[e] += k
                for r in runs(t, asked):
                    goes[r] += k
            known = [x for x in {*n, *goes} if x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array([n[x] for x in known], pa.int64()), pa.array([goes[x] for x in known], pa.int64())], names=["tail", "ends", "goes"])

    return count


def judged(samples: DataFrame) -> DataFrame:
    """(sample_id, bits): every sample with the types of defect it shows, bit i for ``TYPES[i]``."""
    rows = samples.groupBy("sample_id").agg(F.max_by(F.struct("user_input", "response", "reference"), "arrived_at").alias("s"), F.first(F.struct("user_input", "response", "reference")).alias("any"))
    rows = rows.select(F.col("sample_id").cast("bigint"), F.coalesce("s", "any").alias("s")).select("sample_id", "s.*")
    first = stage_table(rows.mapInArrow(_judge, "sample_id bigint, bits int, tail string"))
    asked = Asked(first.select("tail").filter("tail is not null").distinct())
    texts = samples.select("response", "reference", *[c for c in ("retrieved_contexts",) if c in samples.columns])
    known = texts.mapInArrow(_ends(asked), "tail string, ends bigint, goes bigint").groupBy("tail").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    whole = known.filter((F.col("ends") > 0) & (F.col("ends") >= WHOLE * F.col("goes"))).select("tail", F.lit(True).alias("whole"))
    rest = first.join(whole, "tail", "left")
    unended = F.when(F.col("tail").isNotNull() & F.col("whole").isNull(), 16).otherwise(0)
    return rest.select("sample_id", F.col("bits").bitwiseOR(unended).alias("bits"))


def type_of(bits: Column) -> Column:
    """The first type in the order of the rules."""
    out = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(TYPES))):
        out = F.when(bits.bitwiseAND(1 << i) != 0, t).otherwise(out)
    return out
