"""The training-data operators against brute force, exact round trips, held-out accuracy and the defined results of edge cases."""

import random
import re
import unicodedata
from collections import defaultdict
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import answers, bits, blocks, leaks, markup, mixing, neardup, pieces, repeats, scans, textkit, unify
from corpusmill.llm.queries import REGISTRY

CLASH = ", raw string, look string, size int, key string, rec int, bits int, tokens int, h int"  # names the operators use inside


def shape(t):
    """Its own reading of the consistent shape, for comparison."""
    look = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXSIJaeopcyxsijABEZHIKMNOPTYXo"))
    t = re.sub("[­​-‏⁠﻿]", "", unicodedata.normalize("NFKC", t))
    return "".join(look.get(c, c) for c in t)


def load(data, name):
    return pd.read_parquet(f"{data}/{name}.parquet")


def rows(spark, data, name):
    return {tuple(r) for r in REGISTRY.queries[name](spark, data).collect()}


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_runs(spark, data, name):
    df = REGISTRY.queries[name](spark, data)
    n, distinct = df.count(), df.distinct().count()
    assert n == distinct


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql_twin(spark, con, data, name):
    import oracle

    assert oracle.compare(spark, con, REGISTRY.queries[name], REGISTRY.sql[name], data) == ""


# ---- 1


def repaired(texts):
    """Its own reading of the attested repair: letters by ``shape``, token by token, only where the result is a word of the corpus."""
    plain = {t: "".join(unicodedata.normalize("NFKC", c) if unicodedata.east_asian_width(c) in "FH" else c for c in t) for t in texts}
    plain = {t: unicodedata.normalize("NFC", textkit.fold(x)) for t, x in plain.items()}
    words = {w.lower() for x in plain.values() for w in re.findall(r"[A-Za-z0-9À-ɏ]+", x)}
    return {t: re.sub(r"[0-9A-Za-zÀ-ɏͰ-ԯ]+", lambda m: shape(m[0]) if shape(m[0]).lower() in words else m[0], x) for t, x in plain.items()}


def test_p1_equals_brute_force(spark, data):
    c, f = load(data, "chunks").drop_duplicates("chunk_id"), load(data, "fused_children").drop_duplicates("hit_id")
    form = repaired({*c.text.dropna(), *f.text.dropna()})
    groups = defaultdict(list)
    for i, t in zip(c[c.parent_id != ""].chunk_id, c[c.parent_id != ""].text):
        groups[form[t]].append((i, t))
    want = {("chunks", *sorted((a[0], b[0]))) for g in groups.values() for a, b in combinations(g, 2) if a[1] != b[1]}
    m = f.merge(c[["chunk_id", "text"]], on="chunk_id", suffixes=("", "_c"))
    want |= {("fused_children", a, b) for a, b, x, y in zip(m.chunk_id, m.hit_id, m.text, m.text_c) if x != y and form[x] == form[y]}
    assert rows(spark, data, "p1_found") == want


@pytest.mark.parametrize("token, around, want", [("Мoсква", "latin", ["Москва"]), ("привeт", "latin", ["привет"]), ("ЕВІТDА", "latin", ["EBITDA"]), ("mаrket", "latin", ["market"]), ("АI", "latin", ["AI", "АІ"]), ("СЕО", "latin", ["CEO"]), ("СЕО", "cyrillic", []), ("Привет", "latin", []), ("α", "latin", []), ("Αθήνa", "latin", []), ("ɡap", "latin", ["gap"])])
def test_readings(token, around, want):
    assert unify.readings(token, around) == want


@pytest.mark.parametrize("a, b, same", [("ＡＢＣ１", "ABC1", True), ("é", "é", True), ("a​b", "ab", True), ("a b", "a b", True), ("ﬁn", "fin", True), ("⼤⾦", "大金", True), ("ЕВІТDА", "EBITDA", True), ("é", "e", False), ("A", "a", False), ("a,b", "a.b", False), ("β", "B", False), ("x²", "x2", False), ("Привет", "Privet", False), ("a b", "ab", False), ("‐", "-", True)])
def test_looks(a, b, same):
    assert (textkit.shape(a) == textkit.shape(b)) == same


def test_repair_needs_the_vocabulary(spark):
    texts = ["the mаrket", "The Market", "Zоrb only", None, "", "Привет, друг", "Zorb", "Привeт", "Zоrk only", "Zork-like", "ZоrQ only", "ZorQ? no: ZоrQ", "Он был в СССР и с ней", "the market"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    out = {r.id: r.text for r in unify.unify(df, ["id"]).collect()}
    assert [out[str(i)] for i in range(len(texts))] == ["the market", "The Market", "Zorb only", "", "", "Привет, друг", "Zorb", "Привет", "Zork only", "Zork-like", "ZorQ only", "ZorQ? no: ZorQ", "Он был в СССР и с ней", "the market"]
    keys = {r.id: bytes(r.look) for r in unify.looks(df, ["id"]).collect()}
    assert keys["0"] == keys["13"] != keys["1"] and unify.unify(df.limit(0), ["id"]).count() == unify.looks(df.limit(0), ["id"]).count() == 0
    alone = spark.createDataFrame([("1", "Zоrb only"), ("2", "Zоrb only"), ("3", "Zοrb only")], "id string, text string")  # nobody spells it cleanly
    lone = {r.id: bytes(r.look) for r in unify.looks(alone, ["id"]).collect()}
    assert lone["1"] == lone["2"] == unify.digest("Zоrb only") != lone["3"] and lone["1"] != unify.digest("Zorb only")


def test_hot_look_classes_stay_linked(spark):
    members = spark.createDataFrame([(f"k{i:03d}", b"L", bytes([i % 3])) for i in range(60)], "key string, look binary, raw binary")
    full = {tuple(r) for r in unify.class_pairs(members).collect()}
    assert len(full) == 3 * 20 * 20
    star = {tuple(r) for r in unify.class_pairs(members, full=10).collect()}
    assert star <= full and {x for p in star for x in p} == {f"k{i:03d}" for i in range(60)}


def test_hot_look_classes_give_all_pairs(spark):
    hot = [(f"k{i:03d}", b"L", bytes([i % 3])) for i in range(210)] + [(f"s{i:03d}", b"S", bytes([i])) for i in range(205)] + [("o1", b"O", b"x"), ("o2", b"O", b"x")]
    found = [tuple(r) for r in unify.class_pairs(spark.createDataFrame(hot, "key string, look binary, raw binary")).collect()]
    want = {(a[0], b[0]) for a, b in combinations(sorted(hot), 2) if a[1] == b[1] and a[2] != b[2]}
    assert len(found) == len(want) == 3 * 70 * 70 + 205 * 102 and set(found) == want


# ---- 2


def page_items(spark, pages=6, extra=()):
    r, out, pos = random.Random(3), [], 0
    words = "revenue margin orders market growth capital expenditure because freight fell while pricing held firm".split()
    for p in range(1, pages + 1):
        out.append(("d", pos, "text", f"Acme Holdings Annual Rep{'0' if p == 3 else 'o'}rt", "", p, None, None))
        for _ in range(3):
            pos += 1
            out.append(("d", pos, "text", "The " + " ".join(r.choice(words) for _ in range(40)) + ".", "", p, None, None))
        pos += 1
        out.append(("d", pos, "text", f"- {p} -", "", p, None, None))
        pos += 1
    out += [("d", 900 + i, "text", t, "", p, None, None) for i, (t, p) in enumerate(extra)]
    return spark.createDataFrame(out, "doc_id string, pos int, type string, text string, heading_path string, page_no int, level int, image_path string")


def test_p2_kinds(spark):
    extra = [("The expendi-\nture of cap1tal and mar-", 4), ("gin held firm\n- 4 -\nbecause freight fell.", 4), ("Page 4 of the prospectus covers leases.", 4), ("2021-\n2023 average", 4), ("", 4)]
    got = {(r.pos, r.defect) for r in scans.defects(page_items(spark, extra=extra)).collect()}
    furniture = {p for p, d in got if d == "furniture"}
    assert furniture == {p * 5 + k for p in range(6) for k in (0, 4)}
    assert {x for x in got if x[0] >= 900} == {(900, "broken_word"), (900, "misread"), (901, "embedded")}
    text = {r.start_pos: r.text for r in scans.paragraphs(page_items(spark, extra=extra)).collect()}
    assert text[900] == "The expenditure of capital and margin held firm because freight fell."


def test_p2_runs_of_labels(spark):
    """Labels that count beside the pages: front matter in roman numerals, then arabic from 1."""
    r, out, pos = random.Random(4), [], 0
    for p in range(1, 13):
        for k in range(3):
            out.append(("d", pos, "text", f"The committee of page {p} and part {k} " + " ".join(r.choice("orders grew and margins held while freight costs fell".split()) for _ in range(30)) + ".", "", p, None, None))
            pos += 1
        out.append(("d", pos, "text", ["- iii -", "- iv -", "- v -"][p - 1] if p < 4 else f"- {p - 2} -", "", p, None, None))
        pos += 1
    out += [("e", 0, "text", "2021", "", 1, None, None), ("e", 1, "text", "The committee met.", "", 1, None, None), ("e", 2, "text", "7", "", 5, None, None)]
    df = spark.createDataFrame(out, "doc_id string, pos int, type string, text string, heading_path string, page_no int, level int, image_path string")
    got = {(x.doc_id, x.pos) for x in scans.defects(df).filter("defect = 'furniture'").collect()}
    assert got == {("d", 4 * p + 3) for p in range(12)}


def test_p2_looks_over_any_gap(spark):
    """A cut word whose other half stands 700 positions on, and a paragraph of items in three blocks."""
    rows = [("d", 500, "text", "The board gave its recommen-", "", 9, None, None), ("d", 1200, "text", "dation in March.", "", 12, None, None), ("e", 10, "text", "The board", "", 1, None, None), ("e", 600, "text", "met and", "", 2, None, None), ("e", 1500, "text", "adjourned.", "", 3, None, None), ("e", 1501, "text", "Then more.", "", 3, None, None)]
    rows += [("d", 600 + i, "table", "| a |", "", 10, None, None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, type string, text string, heading_path string, page_no int, level int, image_path string")
    assert {(x.pos, x.defect) for x in scans.defects(df).collect()} == {(500, "broken_word")}
    got = {(x.doc_id, x.start_pos): x.text for x in scans.paragraphs(df).collect()}
    assert got == {("d", 500): "The board gave its recommendation in March.", ("e", 10): "The board met and adjourned.", ("e", 1501): "Then more."}


@pytest.mark.parametrize("unit, fix, n", [("recornrnendation", "recommendation", 2), ("cap1tal", "capital", 1), ("clear", "dear", 1), ("dear", "clear", None), ("c1ear", "dear", 2), ("rnarket", "market", 1), ("market", "market", 0), ("m@rk3t", "market", 2), ("rn@rk3t", "market", None), ("汁划", "计划", 1), ("计划", "汁划", None)])
def test_p2_exchanges(spark, unit, fix, n):
    assert scans.exchanges(unit, fix) == n
    if n:
        a, b = spark.range(1).select(scans.scan_key(F.lit(unit)), scans.scan_key(F.lit(fix))).first()
        assert a == b


def test_p2_misreadings_do_not_depend_on_rarity(spark):
    vocab = spark.createDataFrame([("recommendation", 400), ("recornrnendation", 6), ("cat", 50), ("eat", 40), ("rnarket", 3), ("market", 20), ("x1", 1)], "unit string, n bigint")
    assert {(r.unit, r.fix) for r in scans.misreadings(vocab).collect()} == {("recornrnendation", "recommendation")}
    own = bits.bit_filter(vocab.select("unit"))
    assert all(bits.has(own, r.unit) for r in vocab.collect()) and sum(bits.has(own, f"other{i}") for i in range(1000)) < 20
    assert not any(bits.has(bits.bit_filter(vocab.limit(0).select("unit")), u) for u in ("a", "b"))


def test_p2_edges(spark):
    df = page_items(spark)
    assert scans.defects(df.limit(0)).count() == 0 and scans.paragraphs(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), ("d", 1, "text", None, None, 1, None, None), ("d", 2, "text", "x " * 200_000, "", 1, None, None)], df.schema)
    assert scans.defects(nulls).count() == 0
    assert scans.defects(df.unionByName(df)).count() == scans.defects(df).count()
    assert scans.number("xxviii") == 28 and scans.states("l2", 12) and scans.label_of("[22]", 22) == ("", True) and scans.label_of("[22]", 23) == ("[22]", False)


# ---- 3


def test_pieces_round_trip_and_stability():
    r = random.Random(2)
    text = "".join(r.choice(["A sentence of some words here. ", "短句。", "\n\n", "word ", "clause, "]) for _ in range(800))
    found = pieces.pieces_of(text, 550, 50)
    assert all(z - a <= 550 for a, z, _ in found) and found[0][0] == 0 and found[-1][1] == len(text)
    assert all(b[0] == a[1] - 50 for a, b in zip(found, found[1:])) and all(a[1] < b[1] for a, b in zip(found, found[1:]))
    edited = text[:1500] + " INSERTED WORDS " + text[1500:]
    again = pieces.pieces_of(edited, 550, 50)
    before, after = {text[a:z] for a, z, _ in found}, {edited[a:z] for a, z, _ in again}
    assert len(before & after) >= len(before) * 0.6


@pytest.mark.parametrize("text, limit, overlap", [("x" * 2000, 100, 30), ("e" + "́" * 500, 40, 10), ("ab", 1, 5), ("a b " * 50, 7, 100), ("\n" * 300, 20, 3), ("汉" * 99, 10, 0)])
def test_pieces_always_fit(text, limit, overlap):
    found = pieces.pieces_of(text, limit, overlap)
    own = [(0 if i == 0 else found[i - 1][1], z) for i, (_, z, _) in enumerate(found)]
    assert "".join(text[a:z] for a, z in own) == text and all(z - a <= limit for a, z, _ in found)


def test_p3_edges(spark):
    limits = spark.createDataFrame([("child", "text", 20, 5), ("parent", "text", None, 0)], "tier string, chunk_type string, max_chars int, overlap_chars int")
    c = spark.createDataFrame([("a", "x " * 40, "p", "text", "h", 3, "no"), ("a", "x " * 40, "p", "text", "h", 3, "no"), ("b", None, "p", "text", None, 1, None), ("c", "y" * 99, "", "text", "h", 1, None), ("d", "z" * 99, "p", "other", "h", 1, None), ("e", "", None, None, None, None, None)], "chunk_id string, text string, parent_id string, chunk_type string, heading_path string, n_pieces int, max_chars_ string")
    out = pieces.split(c, limits).collect()
    assert {r.chunk_id for r in out} == {"a"} and all(len(r.text) <= 20 and r.heading_path == "h" for r in out)
    assert pieces.split(c.limit(0), limits).count() == 0


# ---- 4


def test_markup_held_out():
    trees = markup.model()
    x, y = markup.training(800, seed=99)
    assert ((trees.logit(x) > 0) == y).mean() > 0.97


@pytest.mark.parametrize("text", ["P/E < 12 and ROE > 15.", "R&D at S&P-style A|B shares", "US$3 to $5 and $4.2bn", "[2] and [22].", "net debt == zero?", "C:\\deals here", "{base, bull, bear}", "x ~ y, 5_year, item_no 7, C#, #1", "- plain bullet\n- another", "公司维持营业利润，同比增长3.5%。", ""])
def test_plain_prose_is_untouched(text):
    assert markup.clean([text], [False], markup.model()) == [(text, 0, "")]


@pytest.mark.parametrize(
    "text, want",
    [("<p>Net <b>profit</b> rose.</p>", "Net profit rose."), ("## Results\n\nBody text here.", "Results\n\nBody text here."), ("a **bold** word and `net_profit` here", "a bold word and net_profit here"), ("See [the report](https://a.example/1) now.", "See the report now."), ("1 &lt; 2 &amp; 3", "1 < 2 & 3"),
     ("\\section{Outlook}\nText \\textbf{bold} here.", "Outlook\n\nText bold here."), ("Text here.\n$$\n\\frac{a}{b}\n$$\nmore text", "Text here.\n\\frac{a}{b}\nmore text"), ("== Risks ==\nThe margin fell.", "Risks\nThe margin fell."), ("```py\na = 1\n```\nText after it.", "a = 1\nText after it."), ("<ul>\n<li>one thing</li>\n<li>two things</li>\n</ul>", "- one thing\n\n- two things")],
)
def test_markup_is_cleaned(text, want):
    assert markup.clean([text], [False], markup.model())[0][0] == want


def test_tables_keep_their_format():
    t = "| a | b |\n| --- | --- |\n| <b>x</b> | 1 |"
    clean, n, _ = markup.clean([t], [True], markup.model())[0]
    assert clean == "| a | b |\n| --- | --- |\n| x | 1 |" and n == 2
    assert markup.clean(["| a | b |\n| --- | --- |\n| x | 1 |"], [True], markup.model())[0][1] == 0


def test_decoding_is_consistent():
    nodes = markup.parse("<b>x</b> `a <i>b</i>` $x <b>y</b>$ text")
    rng = np.random.default_rng(0)
    for _ in range(50):
        label = markup.decode(nodes, rng.normal(size=len(nodes)) * 3)
        for n, y in zip(nodes, label):
            if n.partner is not None:
                assert label[nodes.index(n.partner)] == y
            if n.parent is not None and n.parent.kind in markup._VERBATIM and label[nodes.index(n.parent)]:
                assert not y


def test_decoding_is_the_best_labelling_of_the_tree():
    def allowed(nodes, label):
        at = {id(n): y for n, y in zip(nodes, label)}
        if any(n.partner is not None and at[id(n)] != at[id(n.partner)] for n in nodes):
            return False
        for n in nodes:
            o = n.owner
            while at[id(n)] and o is not None:
                if o.kind in markup._VERBATIM and at[id(o)] or n.kind == "tag" and o.partner is not None and not at[id(o)]:
                    return False
                o = o.owner
        return True

    rng = np.random.default_rng(1)
    for text in ("`a <i>b</i> *c*` text", "<b>x <i>y &amp; z</i></b> <br>", "<div>$x <b>y</b>$ **z <u>w</u>**</div>"):
        nodes = markup.parse(text)
        assert any(n.owner is not None for n in nodes) and len(nodes) < 11
        options = [x for x in product([False, True], repeat=len(nodes)) if allowed(nodes, x)]
        for _ in range(40):
            odds = rng.normal(size=len(nodes)) * 3
            got = tuple(bool(y) for y in markup.decode(nodes, odds))
            assert got in options and np.isclose(np.dot(got, odds), max(np.dot(x, odds) for x in options))


def test_markup_tree_has_elements_and_verbatim_content():
    text = "<p>a <b>b</b></p> `c <i>d</i>`"
    owner = {text[n.start : n.end]: n.owner and text[n.owner.start : n.owner.end] for n in markup.parse(text)}
    assert owner["<b>"] == owner["</b>"] == "<p>" and owner["<p>"] is None and owner["<i>"] == owner["</i>"] == "`c <i>d</i>`"


def test_p4_edges(spark):
    df = spark.createDataFrame([("t", "1", None, None, "x", 1), ("t", "2", "", "text", "x", 1), ("t", "3", "<b>a</b>", None, "x", 1), ("t", "4", "word " * 60_000 + "<b>a</b>", "text", "x", 1)], "tbl string, row_key string, text string, kind string, kinds string, n_nodes int")
    assert {r.row_key for r in markup.cleaned(df).collect()} == {"3", "4"} and markup.cleaned(df, all_rows=True).count() == 4 and markup.cleaned(df.limit(0)).count() == 0


def test_p4_has_no_length_limits():
    """Long formulas, brackets and texts, deep nesting, and markup that crosses any position."""
    trees = markup.model()
    formula = "$" + " + ".join(f"a_{i}" for i in range(80)) + "$"
    assert [n.kind for n in markup.parse(f"so {formula} holds")] [0] == "math" and len([n for n in markup.parse(f"so {formula} holds") if n.parent is None]) == 1
    filler = "The margin lifted after strong orders. " * 12_000
    text = filler[:199_990] + " <b>bold words over the edge</b> " + filler
    (out, n, kinds), (long_line, m, _) = markup.clean([text, "<i>x</i> " * 3_000], [False, False], trees)
    assert n == 2 and kinds == "tag" and "<b>" not in out and "bold words over the edge" in out and len(out) == len(text.strip("\n")) - 7
    assert m == 6_000 and "<i>" not in long_line
    deep = "x &amp;amp;amp;amp;lt;b&amp;amp;amp;amp;gt; y"
    assert "amp" not in markup.clean([deep], [False], trees)[0][0]


# ---- 5

Q = "What was the net profit of Acme Foods in fiscal 2020?"
FULL = "The net profit of Acme Foods was 5.1% in fiscal 2020, compared with 4% a year earlier, because the currency weakened and freight costs eased."
CASES = [
    (Q, None, "5%", "empty"), (Q, " \n", "5%", "empty"), (Q, "N/A", "5%", "empty"), (Q, "无", "5%", "empty"), (Q, Q, "5%", "copy"), (Q, "Question: " + Q, "5%", "copy"), (Q, Q + " 5.1%", "5.1%", None), (Q, "I cannot answer this from the material provided.", "5%", "refusal"),
    (Q, "抱歉，这个问题我回答不了。", "5%", "refusal"), (Q, "Sorry for the earlier mix-up: the net profit was 5%.", "5%", None), (Q, "Acme Foods cannot lift prices before year end, so the profit stayed at 5%.", "5%", None), (Q, "Not disclosed", "Not disclosed", None), (Q, "5.1%", FULL, None), (Q, FULL, "5%", None),
    (Q, FULL[:-1], "5%", None), (Q, FULL[:90], "5%", "truncated"), (Q, FULL[:120] + "...", "5%", "truncated"), (Q, '{"answer": "5', "5%", "truncated"), (Q, '{"answer": "5%"}', "5%", None), (Q, "阿克米食品在2020 年度的净利润为5.1%，上年同期为4%，主要由于运费回落。", "5%", "language"),
    ("What is Acme called in Chinese?", "阿克米食品公司", "阿克米食品公司", None), (Q, "Die Kennzahl von Acme lag im betrachteten Zeitraum bei 5%, vor allem wegen neuer Verträge.", "5%", "language"), ("公司净利润是多少？", "The net profit was 5% because the currency weakened in the period.", "5%", "language"), (None, "5%", None, None),
]


def test_p5_cases(spark):
    df = spark.createDataFrame([(i, q, r, f, None, "clash", 1) for i, (q, r, f, _) in enumerate(CASES)], "sample_id bigint, user_input string, response string, reference string, arrived_at timestamp, tail string, bits int")
    got = {r.sample_id: r.d for r in answers.judged(df.unionByName(df)).select("sample_id", answers.type_of(__import__("pyspark").sql.functions.col("bits")).alias("d")).collect()}
    assert {i: got[i] for i in got} == {i: d for i, (_, _, _, d) in enumerate(CASES)}
    assert answers.judged(df.limit(0)).count() == 0
    told = [("您想了解阿克米食品2020 年度的净利润情况。", "阿克米食品在2020 年度的净利润是多少？"), ("You would like to know the net profit that Acme Foods had in fiscal 2020.", Q)]
    assert all(answers.is_copy(q, r) for r, q in told) and not answers.is_copy(Q, "You would like to know the net profit: it was 5.1% in fiscal 2020.")


def test_p5_one_chance_sentence_excuses_nothing(spark, monkeypatch):
    cut, whole = "Net income rose at the firm in the period because turbine rebates", "Net income rose at the firm in the period because freight costs eased"
    on = [(10 + i, "q", "5%", f"Sales rose since turbine rebates were withdrawn in region {i}, and because freight costs eased.", None) for i in range(6)]
    rows = [(1, Q, cut, "5%", None), (2, Q, whole, "5%", None), (3, "q", "5%", "Profit fell on higher turbine rebates. It rose because turbine rebates.", None), (4, "q", "5%", "It also fell because turbine rebates were cut because turbine rebates fell.", None)] + on
    df = spark.createDataFrame(rows, "sample_id bigint, user_input string, response string, reference string, arrived_at timestamp")
    got = {r.sample_id: r.bits for r in answers.judged(df).collect()}
    assert got[1] & 16 and not got[2] & 16
    monkeypatch.setattr(answers.Asked, "FEW", 0)  # beyond the bound the filter stands in
    assert {r.sample_id: r.bits for r in answers.judged(df).collect()} == got


# ---- 6


def test_p6_equals_brute_force(spark, data):
    c = load(data, "chunks").drop_duplicates("chunk_id")
    c = c[(c.parent_id != "") & (c.chunk_type == "text")]
    sets = {i: (lambda t: {t[k : k + 5] for k in range(len(t) - 4)})("".join(filter(str.isalnum, shape(x).lower()))) for i, x in zip(c.chunk_id, c.text)}
    want = {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.65}
    assert rows(spark, data, "p6_found") == want


def test_p6_small_sets_are_exact(spark):
    r = random.Random(4)
    words = [f"{r.randrange(10**9):09d}" for _ in range(30)]
    texts = [w[: r.randint(5, 9)] + r.choice(["", "xy", "q"]) for w in words for _ in range(4)] + ["abc", "ABC", "", None, "!!", "abcd"]
    df = spark.createDataFrame([(f"r{i:03d}", t, "c") for i, t in enumerate(texts)], "id string, text string, same string")
    reduced, none = neardup.reduced(df), neardup.reduced(df.limit(0))
    found = {tuple(x) for x in neardup.record_pairs(reduced, neardup.links(reduced)).collect()}
    low = {f"r{i:03d}": "".join(filter(str.isalnum, (t or "").lower())) for i, t in enumerate(texts)}
    assert found == {tuple(sorted((a, b))) for a, b in combinations(low, 2) if neardup.likeness(low[a], low[b]) >= 0.65}
    assert neardup.record_pairs(none, neardup.links(none)).count() == neardup.record_pairs(none, neardup.links(none, True)).count() == 0


def test_p6_recall_at_the_threshold(spark):
    r, out = random.Random(8), []
    for i in range(150):
        t = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(200)]
        u = list(t)
        for k in r.sample(range(200), 8):  # about 0.69
            u[k] = "x"
        out += [(f"a{i}", "".join(t)), (f"b{i}", "".join(u))]
    low = dict(out)
    want = {(f"a{i}", f"b{i}") for i in range(150) if neardup.likeness(low[f"a{i}"], low[f"b{i}"]) >= 0.65}
    x = neardup.reduced(spark.createDataFrame(out, "id string, text string"))
    assert len(want) > 100 and len(want & {tuple(p) for p in neardup.record_pairs(x, neardup.links(x)).collect()}) >= 0.98 * len(want)


def test_p6_exact_way_loses_nothing(spark):
    """Texts of few frequent words, so that all lists are long and hundreds of pairs stand around the threshold."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(8, 40))] for _ in range(12)]
    texts = {f"t{i:03d}": "".join(w if r.random() > 0.06 else r.choice(words) for w in base[i % 12][: r.randint(6, 40)]) for i in range(220)} | {"s1": "ab", "s2": "ab", "s3": "abcde", "s4": "abcdef", "s5": "", "s6": "abcdefg"}
    low = {i: "".join(filter(str.isalnum, t.lower())) for i, t in texts.items()}
    want = {tuple(sorted((a, b))) for a, b in combinations(low, 2) if low[a] and neardup.likeness(low[a], low[b]) >= 0.65}
    corpus = neardup.reduced(spark.createDataFrame(list(texts.items()), "id string, text string"))
    assert len(want) > 300
    for exact in (True, False):
        got = {tuple(p) for p in neardup.record_pairs(corpus, neardup.links(corpus, exact)).collect()}
        assert got == want if exact else got <= want and len(got) >= 0.98 * len(want)


def test_p6_long_lists_lose_no_pair(spark):
    """Fifty variants of each text, most two of them 0.66 alike, every shared element in 45 or more: subsets drawn at random miss some of the pairs."""
    r, texts = random.Random(5), {}
    for i in range(4):
        t = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(200)]
        for v in range(50):
            u = list(t)
            u[v::50] = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(4)]
            texts[f"t{i}v{v:02d}"] = "".join(u)
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if a[:2] == b[:2] and neardup.likeness(texts[a], texts[b]) >= 0.65}
    corpus = neardup.reduced(spark.createDataFrame(list(texts.items()), "id string, text string"))
    assert neardup.short_lists(corpus.counts, len(texts)) < 45 and len(want) > 4_000
    assert {tuple(p) for p in neardup.record_pairs(corpus, neardup.links(corpus)).collect()} == want


def test_p6_cells_and_widths_lose_no_pair(spark, monkeypatch):
    """Sets of 10 to 1,300 elements, cut and changed copies of each other, in one cell and in three."""
    r, texts = random.Random(7), {}
    for i in range(60):
        t = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(int(24 * 1.07**i))]
        for v in range(8):
            u = t[: r.randint(int(0.62 * len(t)), len(t))]
            for k in r.sample(range(len(u)), r.randint(0, len(u) // 40)):
                u[k] = "x"
            texts[f"t{i:02d}v{v}"] = "".join(u)
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if a[:3] == b[:3] and neardup.likeness(texts[a], texts[b]) >= 0.65}
    corpus = neardup.reduced(spark.createDataFrame(list(texts.items()), "id string, text string"))
    monkeypatch.setattr(neardup, "short_lists", lambda counts, sets: 2)
    for cells in (1, 3):
        monkeypatch.setattr(blocks, "cells_of", lambda *_: cells)  # noqa: B023
        assert len(want) > 500 and {tuple(p) for p in neardup.record_pairs(corpus, neardup.links(corpus)).collect()} == want


def _sides(sets, common):
    """The sides of one width of sets of numbers, all of which may be shared; those below ``common`` are the common ones."""
    h = np.array([x for s in sets for x in sorted(s)], np.uint64)
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    placed = [(i, g, bits) for i, e, g, bits in blocks.places(h, owner, n, 0.65) if e == 9]
    i, g = np.array([x[0] for x in placed]), np.array([x[1] for x in placed])
    return blocks.sides(i, (n[i] << 32) | (n[i] << 1) | g, np.bincount(owner[h < common], minlength=len(n))[i], b"".join(x[2] for x in placed), 0.65)


def _pairs(x, y):
    return {tuple(sorted((int(x.rec[i]), int(y.rec[j])))) for u, v in blocks.close(x, y, 0.65) for i, j in zip(u, v)}


def test_p6_sets_without_enough_in_common_are_not_tested(monkeypatch):
    """Half of the sets have mostly common elements, half mostly rarer ones: the halves don't meet, and no wanted pair is lost."""
    r, sets, tested = random.Random(11), [], []
    for k in range(400):
        many = 220 if k % 2 else 50
        own = {*r.sample(range(1_000), many), *r.sample(range(1_000, 50_000), 270 - many)}
        sets += [own, {*r.sample(sorted(own), r.randint(215, 260)), *r.sample(range(50_000, 60_000), 12)}]
    wanted = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    tile = blocks._tile
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(blocks, "_tile", lambda x, y, a, z, columns, space: tested.append((z - a) * len(columns)) or tile(x, y, a, z, columns, space))
    x, _ = _sides(sets, 1_000)
    found = _pairs(x, x)
    assert len(wanted) > 300 and wanted <= found and len(found) < 2 * len(wanted)
    assert sum(tested) < 0.35 * len(sets) ** 2  # each against each once is 0.5, and what a tile has below the diagonal


def test_p6_tiles_of_any_shape_lose_no_pair(monkeypatch):
    """Sets of 200 to 400 elements and guests of the width below, around the threshold; tiles cut small, products in double precision, parities folded at will."""
    r, sets = random.Random(12), []
    for _ in range(60):
        own = r.sample(range(100_000), r.randint(170, 390))
        sets += [set(own), *({*own[r.randint(0, len(own) // 3) :], *r.sample(range(100_000), r.randint(0, 30))} for _ in range(4))]
    wanted = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    x, guests = _sides(sets, 30_000)
    own, met = {*x.rec.tolist()}, []
    wanted = {p for p in wanted if own & {*p} and {*p} <= own | {*guests.rec.tolist()}}
    usual, take = (512, 2_048, 1 << 21, 1 << 23), blocks._screen
    for *values, screen in ((*usual, take), (32, 48, 1 << 12, 1 << 23, take), (512, 2_048, 1 << 21, 0, take), *((*usual, lambda *_, k=k: k) for k in (1, 3, 8))):
        for name, value in (*zip(("ROWS", "COLUMNS", "TILE", "SINGLE"), values), ("_screen", screen)):
            monkeypatch.setattr(blocks, name, value)
        met.append(_pairs(x, x) | _pairs(x, guests))
    assert len(guests.n) > 10 and len(wanted) > 200 and all(wanted <= m and m == met[0] for m in met)


def test_p6_middle_list_halves_what_the_long_ones_hold():
    counts = np.zeros(neardup.SLOTS, np.uint32)
    counts[:100], counts[100:110], counts[110] = 5, 20, 150
    assert neardup.middle_list(counts, 6) == 20 and neardup.middle_list(counts, 2) == 5 and neardup.middle_list(counts, 150) == 150


def test_p6_short_lists_follow_the_cost():
    counts = np.zeros(neardup.SLOTS, np.int64)
    counts[:1000], counts[1000:1010] = 3, 50
    assert neardup.short_lists(counts, 10) == 2 and 3 <= neardup.short_lists(counts, 200) < 50 and neardup.short_lists(counts, 10**6) == 50
    assert neardup.short_lists(np.zeros(neardup.SLOTS, np.int64), 0) == 2


def test_p6_parities_never_exceed_the_difference():
    r = random.Random(3)
    for _ in range(50):
        a = "".join(r.choice("abcd") for _ in range(r.randint(5, 400)))
        b = a[: r.randint(5, len(a))] + "".join(r.choice("abcd") for _ in range(r.randint(0, 80)))
        h, owner = neardup.sets_of([a, b])
        bits = np.unpackbits(neardup._parities(h, owner, 2), axis=1)
        assert (bits[0] ^ bits[1]).sum() <= len(set(h[owner == 0].tolist()) ^ set(h[owner == 1].tolist()))


def test_p6_no_pair_that_is_met_is_screened_out(spark):
    r = random.Random(20724)  # of 0.655, with a key in common; a sketch of one bit a minimum would tell them apart
    t = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(100)]
    u = list(t)
    for k in r.sample(range(100), 4):
        u[k] = "x"
    x = neardup.reduced(spark.createDataFrame([("a", "".join(t)), ("b", "".join(u))], "id string, text string"))
    assert [tuple(p) for p in neardup.record_pairs(x, neardup.links(x)).collect()] == [("a", "b")]


def test_p6_hot_classes_give_all_pairs(spark):
    text = "management kept its guidance for the segment margin next year"
    hot = [(f"h{i:03d}", (text.upper() if i % 3 else text) + "." * (i % 50)) for i in range(230)]  # more than a cell, byte-equal copies too
    near = [(f"n{i}", text + " again" + "!" * i) for i in range(3)]
    rows_ = neardup.reduced(spark.createDataFrame(hot + near, "id string, text string"))
    found = [tuple(r) for r in neardup.record_pairs(rows_, neardup.links(rows_)).collect()]
    assert len(found) == len(set(found)) and set(found) == set(combinations(sorted(i for i, _ in hot + near), 2))


def test_components(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    got = {r.node: r.root for r in neardup.components(chain).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 43


def test_boundary_is_where_keys_are_fewest():
    assert neardup.boundary({300: 10}) == 0 and 5 < neardup.boundary({s: 10 for s in range(1, 400)}) < 40


# ---- 7


def test_p7_equals_brute_force(spark, data):
    token = re.compile("[㐀-䶿一-鿿]|[^\\W_㐀-䶿一-鿿]+")
    t, d = load(data, "test_set"), load(data, "documents")
    runs = defaultdict(set)
    for q, *texts in zip(t.question_id, t.question, t.ground_truth):
        for x in texts:
            w = token.findall(shape(x).lower())
            for k in range(len(w) - 15):
                runs[tuple(w[k : k + 16])].add(q)
    want = set()
    for i, x in zip(d.doc_id, d.text):
        w = token.findall(shape(x or "").lower())
        want |= {(i, q) for k in range(len(w) - 15) for q in runs.get(tuple(w[k : k + 16]), ())}
    assert rows(spark, data, "p7_found") == want and want


def test_p7_threshold_and_blocks(spark):
    r = random.Random(6)
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    items = spark.createDataFrame([("q1", item, None), ("q2", "too short", ""), ("q3", item, item)], "question_id string, question string, ground_truth string")
    w = item.split()
    docs = spark.createDataFrame([(1, "x " + "-".join(w[5:21]).upper() + " y", 1), (2, " ".join(w[5:20]), 1), (3, None, 1), (4, "", 1), (5, "filler " * 50_000 + item, 1)], "doc_id bigint, text string, run int")
    got = {(x.doc_id, x.question_id, x.field, x.run) for x in leaks.leaks(docs, items).collect()}
    assert got == {(d, q, f, n) for d, n in ((1, 16), (5, 40)) for q, f in (("q1", "question"), ("q3", "question"), ("q3", "answer"))}
    assert got == {(x.doc_id, x.question_id, x.field, x.run) for x in leaks.leaks(docs, items, block=1).collect()}
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0


def test_block_max_wand_finds_all_above_their_bars():
    r = random.Random(9)
    index = leaks.Index([(f"i{k}", "question", " ".join(f"w{r.randrange(60)}" for _ in range(30))) for k in range(200)])
    for _ in range(100):
        terms = r.sample(range(len(index.terms)), 30) + [t for t in index.lists if any(i == 7 for i, _ in index.lists[t])]
        terms = list(dict.fromkeys(terms))
        full = defaultdict(float)
        for t in terms:
            for i, x in index.lists[t]:
                full[i] += x
        assert {i for i, _ in index.above(terms)} == {i for i, s in full.items() if s >= 1 - 1e-9}


def test_p7_bars_are_the_least_window():
    r = random.Random(2)
    items = [(f"q{i}", "question", " ".join(r.choice("abcdefgh") for _ in range(r.randint(10, 40)))) for i in range(25)] + [("same", "answer", "a b " * 20)]
    index = leaks.Index(items)
    score = {(t, i): x for t, p in index.lists.items() for i, x in p}  # already divided by the bar, so the least window of each text is 1
    grams = [leaks.windows(*leaks.token_hashes([leaks.form(t)]), leaks.TERM)[0] for _, _, t in items if len(t.split()) >= leaks.RUN]
    for i, g in enumerate(grams):
        ids = np.searchsorted(index.terms, g).tolist()
        span = leaks.RUN - leaks.TERM + 1
        assert min(sum(score[t, i] for t in set(ids[k : k + span])) for k in range(len(ids) - span + 1)) == pytest.approx(1)


def test_p7_blocks_change_nothing(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/test_set.parquet")
    found = lambda n: {(r.doc_id, r.question_id, r.field, r.run) for r in leaks.leaks(docs, items, n).collect()}
    assert found(20_000) == found(70) != set()


# ---- 8


def test_shares_and_caps():
    got = mixing.amounts(1000, {"a": 500, "b": 50, "c": 450}, {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 1), "d": (0.0, 9)})
    assert got["b"] == 150 and got["d"] == 0 and abs(sum(got.values()) - 1000) < 1e-6 and abs(got["a"] / got["c"] - 5) < 1e-6
    assert mixing.amounts(0, {}, {"a": (1.0, 1)}) == {"a": 0.0}


def test_pfair_schedule_deviates_by_less_than_a_block():
    r = random.Random(0)
    for _ in range(20):
        n = r.randint(50, 400)
        counts = mixing.block_counts({f"s{i}": r.randint(0, 1000) for i in range(r.randint(1, 9))}, n)
        if not counts:
            continue
        slots = mixing.schedule(counts, n)
        assert len(slots) == n and all(rel <= t < due for t, _, _, rel, due in slots)
        for s, c in counts.items():
            done = 0
            for t, who, *_ in slots:
                done += who == s
                assert abs(done - c * (t + 1) / n) < 1


def test_p8_mix(spark, data):
    used = REGISTRY.queries["p8_mix"](spark, data).toPandas()
    shares = REGISTRY.queries["p8_shares"](spark, data).toPandas().set_index("source")
    target, docs = load(data, "mix_targets").set_index("source"), load(data, "documents")
    assert (used.uses <= used.source.map(target.max_repeats)).all() and used.doc_id.is_unique
    assert set(used.doc_id) == set(docs[docs.source.isin(target.index) & (docs.text.fillna("") != "")].doc_id)
    total = (used.tokens * used.uses).sum()
    assert np.isclose(shares.actual_share.sum(), 1) and shares.tokens.sum() == total
    assert (used.groupby("source").uses.agg(lambda u: u.max() - u.min()) <= 1).all()
    assert REGISTRY.queries["p8_schedule"](spark, data).toPandas().tokens.sum() == total


def test_p8_every_use_has_its_slot(spark, data):
    used, plan = REGISTRY.queries["p8_mix"](spark, data).toPandas(), REGISTRY.queries["p8_schedule"](spark, data).toPandas()
    assert all(len(x) == n for x, n in zip(used.slots, used.uses))
    source = dict(zip(plan.slot, plan.source))
    assert all(source[x] == s for s, xs in zip(used.source, used.slots) for x in xs)
    tokens = defaultdict(int)
    for n, xs in zip(used.tokens, used.slots):
        for x in xs:
            tokens[x] += n
    assert {x: tokens[x] for x in plan.slot} == dict(zip(plan.slot, plan.tokens))
    # read by slots, every source is always less than a block from its share of the blocks
    run, share = defaultdict(int), plan.groupby("source").size() / len(plan)
    for k, s in enumerate(plan.sort_values("slot").source, 1):
        run[s] += 1
        assert all(abs(run[t] - k * share[t]) < 1 for t in share.index)


def test_p8_edges(spark):
    docs = spark.createDataFrame([(1, "a", "one two", 5), (1, "a", "one two", 5), (2, "a", None, 5), (3, None, "x", 5), (4, "b", "w " * 100_000, 5)], "doc_id bigint, source string, text string, tokens int")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs)
    plan = mixing.plan(sizes, goal)
    used = {r.doc_id: r.uses for r in mixing.uses(sizes, plan).collect()}
    assert set(used) == {1, 4} and used[1] == 2
    empty = mixing.sized(docs.limit(0))
    assert mixing.shares(mixing.uses(empty, mixing.plan(empty, goal)), mixing.plan(empty, goal)).count() == 2
    assert "".join(mixing.spans("word " * 30_000)) == "word " * 30_000


# ---- 9


def share(text):
    t, seen, marked = "".join(filter(str.isalnum, text.lower())), set(), set()
    for i in range(len(t) - 29):
        w = t[i : i + 30]
        if w in seen:
            marked.update(range(i, i + 30))
        seen.add(w)
    return len(marked) / len(t) if t else 0.0


def test_p9_equals_brute_force(spark, data):
    d = load(data, "documents")
    want = {i: share(t or "") for i, t in zip(d.doc_id, d.text)}
    got = {r.doc_id: r.windows for r in REGISTRY.queries["p9_ledger"](spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert rows(spark, data, "p9_found") == {(i,) for i, s in want.items() if s >= 0.3}


def test_p9_edges(spark):
    texts = [None, "", "short", "ab" * 40, "x" * 29, "x" * 30, "x" * 31, "Ａ" * 100, "no repeats in this one at all"]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)], "doc_id bigint, text string, bits int, windows double")
    got = {r.doc_id: r.windows for r in repeats.ledger(df.unionByName(df)).collect()}
    assert got == {i: pytest.approx(share(t or "")) for i, t in enumerate(texts)}
    assert repeats.ledger(df.limit(0)).count() == 0 and repeats.ablations(repeats.ledger(df.limit(0))).count() == 0


def test_p9_ablations_match_policies(spark, data):
    ledger = REGISTRY.queries["p9_ledger"](spark, data)
    whole = {r.policy: r.rejected for r in repeats.ablations(ledger).filter("without = ''").collect()}
    assert whole == {p: repeats.failed(ledger, p).count() for p in repeats.POLICIES}
