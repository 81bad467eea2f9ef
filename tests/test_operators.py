"""Golden cases and checks against plain Python models."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import render, times, urls
from corpusmill.operators import chunking, cleaning, corpus, evaluation, pipeline, retrieval, sessions, tasks, web
from corpusmill.operators.folds import ordered
from corpusmill.sources import documents, files, versioned
from corpusmill.streaming import jobs

ITEM = "doc_id string, pos int, type string, text string, heading_path string, page_no int, level int, image_path string"


def item(pos, text, type_="text", path="", page=None, level=None, doc="d", image=None):
    return (doc, pos, type_, text, path, page, level, image)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_characters(spark):
    rows = [item(0, "a​b﻿c­d(cid:12)e\x07\tf"), item(1, "x\r\n\r\n\r\n\r\ny　 z \t w "), item(2, "| a |\n\nstray\n| b  c |", "table"), item(3, "" * 3 + "ab"), item(4, "�a"), item(5, None)]
    out = {r.pos: r for r in cleaning.characters(spark.createDataFrame(rows, ITEM)).collect()}
    assert out[0].text == "abcde\tf" and out[0].removed == 12
    assert out[1].text == "x\n\ny z w"
    assert out[2].text == "| a | stray\n| b c |"
    assert out[3].text == "ab" and out[3].font_warning
    assert out[4].decode_warning and out[5].text is None


def test_furniture_needs_pages(spark):
    rows = [item(p * 10 + k, t, page=p) for p in range(1, 6) for k, t in enumerate([f"Head ３ page {p}", f"body {'abc' * p}"])]
    rows += [item(100, "Head 3 page 9", level=1, page=5), item(101, "Head 3 page 9", page=5, type_="table")]
    rows += [item(p, "Same", page=None, doc="e") for p in range(5)]
    got = {(r.doc_id, r.pos) for r in cleaning.furniture(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {("d", p * 10) for p in range(1, 6)}
    assert [cleaning.least_pages(n) for n in (1, 5, 6, 10)] == [3, 3, 4, 6]


def test_neighbours_and_short_lines(spark):
    long = "a sentence that is long enough to be compared by similarity"
    rows = [item(0, "A" * 31), item(1, "B" * 31), item(2, "B" * 31), item(3, "A" * 31), item(4, "!!"), item(5, "??"), item(6, long), item(7, long + "."), item(8, "12"), item(9, "short"), item(10, "短"), item(11, "T", level=1), item(12, "T", level=1)]
    kept = [r.pos for r in cleaning.adjacent(spark.createDataFrame(rows, ITEM)).orderBy("pos").collect()]
    assert kept == [0, 1, 4, 5, 6, 8, 9, 10, 11, 12]  # A, B, B, A keeps A, B
    out = cleaning.clean(spark.createDataFrame(rows, ITEM)).orderBy("pos").collect()
    assert [r.text for r in out][-3:] == [long + " short 短", "T", "T"]
    assert out[-1].numbers == 1 and out[-1].duplicates == 3


def test_stream_folds_keys_of_any_size(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    out = ordered(rows, ["k"], ["n"], lambda key, own: [(key[0], sum(1 for _ in own))], "k bigint, n bigint").collect()
    assert sorted((r.k, r.n) for r in out) == [(0, 6667), (1, 6667), (2, 6666)]
    assert ordered(rows.limit(0), ["k"], ["n"], lambda key, own: own, "k bigint, n bigint").count() == 0
    early = ordered(rows, ["k"], ["n"], lambda key, own: [next(own)], "k bigint, n bigint").collect()  # a fold may stop early
    assert sorted((r.k, r.n) for r in early) == [(0, 0), (1, 1), (2, 2)]


def test_short_line_islands_equal_a_model(spark):
    r = random.Random(5)
    rows = [item(p, f"{p}" + r.choice(["ab", "短句", chr(97 + p) * 40, " 7 8", "end."]), doc=f"d{d}", path=r.choice(["p", "q"]), level=r.choice([None] * 6 + [1])) for d in range(20) for p in range(25)]
    def model(doc):
        out = []
        for t in doc:
            if out and len(t[3]) < 30 and t[6] is None and out[-1][1] is None and out[-1][2] == t[4]:
                out[-1][0] += (" " if out[-1][0][-1].isascii() and out[-1][0][-1].isalnum() else "") + t[3]
            else:
                out.append([t[3], t[6], t[4]])
        return [x[0] for x in out]

    # rule 4 keeps all of these: neighbours differ in a running number
    got = cleaning.clean(spark.createDataFrame(rows, ITEM)).orderBy("doc_id", "pos").collect()
    for d in {x[0] for x in rows}:
        assert [x.text for x in got if x.doc_id == d] == model([x for x in rows if x[0] == d])


def test_pieces_join_to_the_text_and_fit():
    r = random.Random(1)
    for _ in range(60):
        body = "".join(r.choice(["句子很短。", "A longer sentence here; ", "问？”", "\n\n", "\n", "x" * r.randint(1, 60), "3.14 "]) for _ in range(r.randint(1, 40)))
        got = chunking.pieces(body, 80)
        assert all(p and p[0] not in "。！？；”" for p, _ in got[1:])
        assert "".join("".join(p.split()) for p, _ in got) == "".join(body.split())
        assert all(len(p) <= 80 + 8 for p, _ in got)
        assert all(body[s : s + 5] == p[:5] for p, s in got if len(p) >= 5)


def test_overlap_and_pages():
    prev = "第一句话在这里结束了。" + "第二句有四十五个字左右" * 4
    assert 40 <= len(chunking.tail(prev)) <= 50
    assert chunking.tail("short") == ""
    assert chunking.page_at([(0, 1), (10, None), (20, 3)], 15) is None and chunking.page_at([(0, 1), (20, 3)], 25) == 3 and chunking.page_at([], 0) is None


def test_blocks_and_chunks(spark):
    rows = [item(0, "Intro " * 20), item(1, "H1", level=0), item(2, "Section", level=1, path="H1"), item(3, "| a |", "table", "H1 > Section", 2), item(4, "body。" * 300, path="H1 > Section", page=3), item(5, "pic", "image", image="i.png"), item(6, "Tail", level=0)]
    out = chunking.split(spark.createDataFrame(rows, ITEM)).orderBy("chunk_id").collect()
    parents = [r for r in out if r.parent_id == ""]
    assert [p.chunk_id for p in parents] == [f"d:p{n:03d}" for n in range(1, len(parents) + 1)]
    assert parents[1].text == "H1\n\nSection\n\n| a |" and parents[1].chunk_type == "table" and parents[1].heading_path == "H1"
    assert parents[-1].text == "Tail" and [p.image_path for p in parents if p.chunk_type == "image"] == ["i.png"]
    kids = [r for r in out if r.parent_id]
    assert all(k.char_len == len(k.text) <= 550 for k in kids) and {k.parent_id for k in kids} == {p.chunk_id for p in parents}


def test_heading_paths(spark):
    rows = [item(0, "A", level=0), item(1, "x"), item(2, "B", level=1), item(3, "y"), item(4, "C", level=1), item(5, "D", level=0), item(6, "z")]
    got = [r.path for r in chunking.heading_paths(spark.createDataFrame(rows, ITEM)).orderBy("pos").collect()]
    assert got == ["", "A", "A", "A > B", "A", "", "D"]


def test_fusion_cases(spark):
    schema = "query_id string, chunk_id string, dense_rank int, sparse_rank int"
    h = spark.createDataFrame([("q", "b", 1, 1), ("q", "a", 2, 3), ("q", "c", 3, 2), ("q", "z", 4, None), ("r", "only", None, 2)], schema)
    got = [(r.query_id, r.chunk_id, r.rank, r.rrf_score) for r in retrieval.rrf(h, 3, ["query_id"]).orderBy("query_id", "rank").collect()]
    assert got == [("q", "b", 1, round(2 / 61, 6)), ("q", "a", 2, round(1 / 62 + 1 / 63, 6)), ("q", "c", 3, round(1 / 62 + 1 / 63, 6)), ("r", "only", 1, round(1 / 62, 6))]
    for k in (0, -1):
        with pytest.raises(ValueError):
            retrieval.rrf(h, k, ["query_id"])


def test_roll_up_merges_and_reports(spark):
    kids = spark.createDataFrame([("q", "p1:c001", "p1", 1, 0.3), ("q", "p2:c001", "p2", 2, 0.2), ("q", "p1:c002", "p1", 3, 0.1), ("q", "p9:c001", "p9", 4, 0.05)], "query_id string, chunk_id string, parent_id string, rank int, rrf_score double")
    par = spark.createDataFrame([("p1", "one", "d"), ("p2", "two", "d")], "chunk_id string, text string, doc_id string")
    found, lost = retrieval.roll_up(kids, par, ["query_id"])
    rows = found.orderBy("parent_rank").collect()
    assert [(r.parent_id, r.parent_rank, len(r.hits)) for r in rows] == [("p1", 1, 2), ("p2", 2, 1)] and [r.chunk_id for r in lost.collect()] == ["p9:c001"]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[17] = v[3]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.dense(df, q, 7).collect()}
    for i in range(5):
        s = v.astype(np.float64) @ v[i].astype(np.float64)
        assert [got[i, k] for k in range(1, 8)] == sorted(range(300), key=lambda j: (-round(s[j], 9), j))[:7]
    assert retrieval.dense(df, q.limit(0), 3).count() == 0


def test_bm25_empty_and_null(spark):
    docs = spark.createDataFrame([(1, "revenue grew"), (2, None), (3, ""), (4, "revenue revenue fell 收入")], "doc_id bigint, text string")
    q = spark.createDataFrame([("a", "Revenue 收"), ("b", ""), ("c", None)], "query_id string, text string")
    got = [(r.query_id, r.doc_id) for r in retrieval.bm25(docs, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [("a", 4), ("a", 1)]
    assert retrieval.bm25(docs.limit(0), q, 5).count() == 0


def test_corpus_changes(spark, tmp_path):
    schema = "chunk_id string, source string, doc_id string, text string"
    old = spark.createDataFrame([("1", "a", "x", "t"), ("2", "a", "x", "t"), ("3", "b", "y", "t")], schema)
    new = spark.createDataFrame([("9", "a", "z", "n")], schema)
    assert {r.chunk_id for r in corpus.replace_source(old, new).collect()} == {"3", "9"}
    assert [(r.source, r.doc_id) for r in corpus.stale(old, new).collect()] == [("a", "x")]
    assert corpus.stale(old, spark.createDataFrame([("1", "a", "x", "t")], schema)).count() == 0
    again = spark.createDataFrame([("7", "a", "x", "n")], schema)  # the same document cut anew leaves no orphan
    assert {r.chunk_id for r in corpus.replace_source(old, again).collect()} == {"3", "7"}
    path = str(tmp_path / "t")
    corpus.swap(old, path)
    read = lambda: {r.chunk_id for r in versioned.read(spark, path).collect()}
    assert read() == {"1", "2", "3"}
    hit = corpus.store(new, path)
    assert read() == {"3", "9"} and len(hit) == 2  # the buckets of x and z
    kept = versioned.state(spark, path)["buckets"]
    assert len(set(kept.values())) == 2  # y is where the first write put it
    corpus.ensure(spark, path, old.schema)
    with pytest.raises(ValueError, match="schema drift"):
        corpus.ensure(spark, path, old.drop("text").schema)
    with pytest.raises(ValueError, match="not replaced"):
        versioned.write(old, path, "doc_id", [])
    assert read() == {"3", "9"}


def test_a_write_that_fails_before_its_last_step_changes_nothing(spark, tmp_path, monkeypatch):
    schema = "chunk_id string, source string, doc_id string, text string"
    path = str(tmp_path / "t")
    corpus.swap(spark.createDataFrame([("1", "a", "x", "t"), ("3", "b", "y", "t")], schema), path)
    before = versioned.read(spark, path)
    new = spark.createDataFrame([("9", "a", "z", "n")], schema)
    with monkeypatch.context() as m:
        m.setattr(versioned, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            corpus.store(new, path)
    assert {r.chunk_id for r in versioned.read(spark, path).collect()} == {"1", "3"}
    corpus.store(new, path)
    assert {r.chunk_id for r in versioned.read(spark, path).collect()} == {"3", "9"}
    assert {r.chunk_id for r in before.collect()} == {"1", "3"}  # a reader that began before
    for k in range(3):
        corpus.store(spark.createDataFrame([(f"{k}", "a", f"n{k}", "n")], schema), path)
    assert {r.chunk_id for r in versioned.read(spark, path).collect()} == {"3", "2"}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("w")]) <= 3  # what two states name


def test_fit(spark):
    fit, long = corpus.fit(spark.createDataFrame([("1", "汉" * 3), ("2", "a" * 9)], "chunk_id string, text string"), 8)
    assert fit.count() == 0 and {r.chunk_id for r in long.collect()} == {"1", "2"}


def test_incremental_ingest(spark, tmp_path):
    from corpusmill.streaming import jobs

    schema = "chunk_id string, source string, doc_id string, text string"
    feed, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("1", "a", "x", "t")], schema).coalesce(1).write.parquet(str(feed / "b=1"))
    stream = lambda: spark.readStream.schema(schema).parquet(f"{feed}/*")
    jobs.outcome(jobs.ingest(stream(), out, str(tmp_path / "c")).start())
    spark.createDataFrame([("2", "a", "y", "t"), ("3", "b", "z", "t")], schema).coalesce(1).write.parquet(str(feed / "b=2"))
    jobs.outcome(jobs.ingest(stream(), out, str(tmp_path / "c")).start())
    assert {r.chunk_id for r in versioned.read(spark, out).collect()} == {"2", "3"}


def test_evaluation_means(spark, tmp_path):
    nan = float("nan")
    m = ", ".join(f"{x} double" for x in evaluation.METRICS)
    df = spark.createDataFrame([("r", 1, "q1", 0.5, nan, 1.0, None), ("r", 2, "q2", 0.5, nan, None, None), ("s", 3, "q3", 0.25, 0.5, 1.0, 0.8)], f"run_id string, sample_id int, question_id string, {m}")
    got = {r.run_id: r for r in evaluation.summary(df).collect()}
    assert got["r"].context_precision == 0.5 and got["r"].context_recall is None and got["r"].n_faithfulness == 1 and got["r"].incomplete == 2
    paths = evaluation.report(evaluation.summary(df), str(tmp_path / "rep"), {"k": 5})
    assert json.loads(open(paths[0]).read())["runs"][0]["run_id"] == "r" and open(paths[1]).read().count("| r |") == 1


def test_plans(spark):
    steps, deps = tasks.plan_tables(spark, [("p", "s1", "a", "done", "t1", []), ("p", "s2", "b", "failed", "t2", ["s1"]), ("p", "s3", "c", "pending", "t3", ["s2"]), ("p", "s4", "d", "pending", "t4", ["s3"]), ("p", "s5", "e", "pending", "t5", ["s1"]), ("q", "x", "f", "pending", "t6", ["s9"])])
    assert {(r.plan_id, r.step_id) for r in tasks.ready(steps, deps).collect()} == {("p", "s5")}
    assert {(r.plan_id, r.step_id) for r in tasks.cascade(steps, deps).collect()} == {("p", "s3"), ("p", "s4")}
    assert {(r.step_id, r.problem) for r in tasks.invalid(steps, deps).collect()} == {("x", "id"), ("x", "missing")}


def test_urls(spark):
    cases = {"https://example.com/a": None, "http://10.0.0.1/": "address", "http://8.8.8.8:443/": None, "http://8.8.8.8:8080/": "port", "ftp://example.com": "scheme", "http:///x": "host", "http://[::1]/": "address", "http://user@127.0.0.1/": "address", "http://localhost/": "address", "http://999.1.1.1/": None, "": "scheme"}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.refused(F.col("u")).alias("r"))
    assert {r.u: r.r for r in df.collect()} == cases


def test_text_functions(spark):
    assert value(spark, T.mask(F.lit("abcdefghij"))) == "abcd****ghij" and value(spark, T.mask(F.lit("abc"))) == "****"
    assert value(spark, T.file_size(F.lit(2048))) == "2.0 KB" and value(spark, T.percent(F.lit(1), F.lit(0))) == 0
    assert value(spark, T.brief(F.lit(" a \n b "), 10)) == "a b" and value(spark, T.join_lines(F.lit("end"), F.lit("on"))) == "end on" and value(spark, T.join_lines(F.lit("句"), F.lit("子"))) == "句子"
    a = value(spark, T.answer(F.lit('```json\n{"conclusion": "c", "key_points": ["1","2","3","4","5","6"]}\n```')))
    assert a["conclusion"] == "c" and len(a["key_points"]) == 5
    assert value(spark, T.terms(F.lit("A big 的Revenue 收入"))) == ["big", "revenue", "收", "入"]
    assert value(spark, T.seq_of(F.lit("d:p001:c012"))) == 12 and value(spark, T.seq_of(F.lit("d:p001"))) is None
    assert value(spark, times.millis(F.lit("nonsense"))) == 0 and value(spark, times.millis(F.lit("1970-01-01T00:00:01+00:00"))) == 1000
    assert [T.clamp_k(k) for k in (0, None, 3, 99)] == [5, 5, 3, 10]
    with pytest.raises(ValueError):
        T.quoted('a"b')


def test_sessions(spark):
    log = spark.createDataFrame([("t", 1, "user", "[sys] x"), ("t", 2, "user", " hello "), ("t", 3, "assistant", " "), ("t", 4, "tool", "x"), ("t", 5, "user", "bye"), ("t", 6, "user", None)], "thread string, id int, role string, text string")
    assert [r.id for r in sessions.history(log, ["[sys]"]).orderBy("id").collect()] == [2, 5, 6]
    assert sessions.titles(log.filter("id = 2"), "thread", "id").first().title == "hello"
    assert sessions.growth(log, "thread", ["id"], "id").agg(F.sum("added")).first()[0] == 6


def test_web(spark):
    title, text = web.main_text("<html><title>T &amp; x</title><script>bad()</script><nav>menu</nav><p>One</p><p>Two &lt; 3</p></html>")
    assert title == "T & x" and text == "One\n\nTwo < 3" and web.main_text(None) == ("", "")
    rows = spark.createDataFrame([("q", 1, "", " "), ("q", 2, "u", "a"), ("q", 3, "u", "b"), ("q", 4, None, "a"), ("q", 5, None, "a")], "query_id string, n int, url string, title string")
    assert {r.n for r in web.unique_results(rows, ["query_id"], ["n"]).collect()} == {2, 4}


def test_evidence_budgets(spark):
    hit = "array<struct<filename:string,doc_id:string,seq:int,content:string>>"
    schema = f"hits {hit}, results array<struct<title:string,url:string,snippet:string>>, fetches array<struct<url:string,excerpt:string>>, facts map<string,string>, sources array<string>"
    long = "w " * 400
    rows = [
        ([("f", "d", 3, " a \n b ")] + [(None, "d", None, long)] * 5, None, None, None, [str(i) for i in range(9)]),
        (None, [("t " * 90, "u", "s")], [("u2", long * 3)], {"x": "1"}, None),
        (None, [], None, {"k": "v", "n": "2"}, []),
        (None, None, None, None, None),
    ]
    got = [r.e for r in spark.createDataFrame(rows, schema).select(render.evidence(*map(F.col, ("hits", "results", "fetches", "facts", "sources"))).alias("e")).collect()]
    assert got[0].startswith("  evidence:\n    - [f] #3: a b\n    - [d] #?: w w") and got[0].endswith("  sources: 0 1 2 3 4") and got[0].count("    - ") == 4
    assert max(map(len, got[0].split("\n"))) <= 270 and len(got[1]) <= 1200 + len("  evidence:\n") and "x=1" not in got[1] and got[1].count("    - ") == 2
    assert got[2] == "  evidence:\n    - k=v\n    - n=2" and got[3] == ""


def test_recorded_fetches(spark):
    hop = "struct<url:string,status:int,location:string,content_type:string>"
    ok = ("https://a.example/", 200, None, "text/html")
    rows = [
        ("ok", [ok], "<p>Hi <b>you</b></p>"), ("v6", [("http://[::1]/", 200, None, "text/html")], "x"), ("v6ok", [("http://[2001:db8::1]:443/", 200, None, "text/html")], "<p>x</p>"),
        ("mapped", [("http://[::ffff:10.0.0.1]/", 200, None, "text/html")], "x"), ("late", [("https://a.example/", 302, "http://127.0.0.1/", ""), ("http://127.0.0.1/", 200, None, "text/html")], "x"),
        ("many", [("https://a.example/", 302, "https://a.example/", "")] * 4 + [ok], "x"), ("three", [("https://a.example/", 307, "https://a.example/", "")] * 3 + [ok], "<p>y</p>"),
        ("status", [("https://a.example/", 503, None, "text/html")], "x"), ("type", [("https://a.example/", 200, None, "image/png")], "x"), ("empty", [ok], "<script>x</script>"), ("null", None, None), ("none", [ok], None),
        ("big", [ok], "<p>" + "字" * 900_000 + "</p>"),
    ]
    out = {r.url: r for r in web.recorded(spark.createDataFrame(rows, f"url string, hops array<{hop}>, body string")).collect()}
    assert {k: r.outcome for k, r in out.items()} == {"ok": None, "v6": "unsafe: address", "v6ok": None, "mapped": "unsafe: address", "late": "unsafe: address", "many": "too many redirects", "three": None, "status": "status 503", "type": "type image/png", "empty": "no text", "null": "no answer", "none": "no text", "big": None}
    assert out["ok"].text == "Hi you" and out["big"].cut and len(out["big"].text) == web.PAGE_CHARS and out["ok"].message.startswith('<fetched url="https://a.example/">Hi you</fetched>')
    assert web.excerpts(spark.createDataFrame([("t", 1, out["ok"].message)], "thread string, n int, text string")).first().excerpt == "Hi you"


@pytest.mark.parametrize("host, inside", [("::1", True), ("::", True), ("fe80::1", True), ("febf::1", True), ("fec0::1", False), ("fd12:3456::1", True), ("2001:db8::1", False), ("::ffff:192.168.0.1", True), ("::ffff:8.8.8.8", False), ("64:ff9b::10.0.0.1", True), ("1:2:3:4:5:6:7:8", False), ("1:2:3:4:5:6:7", True), ("1::2::3", True), ("g::1", True), ("", True)])
def test_ipv6(spark, host, inside):
    assert value(spark, urls._inside6(urls.address6(F.lit(host)))) == inside


def test_frames_live_and_at_rest(spark, tmp_path):
    text = 'data: {"token": "a"}\r\n\r\n: ping\n\ndata: {"route":\ndata: {"x": [1]}}\n\ndata: nonsense\n\ndata: [1]\n\nevent: y\n\ndata: {"token": "open'
    pieces = [(s, i, text[i * n : i * n + n]) for s, n in (("one", 1), ("seven", 7), ("all", 1000)) for i in range(-(-len(text) // n))] + [("null", 0, None)]
    df = spark.createDataFrame(pieces, "stream string, n int, text string")
    want = [("token", "a", False), ("route", '{"x": [1]}', False), ("unknown", None, True), ("unknown", None, True)]
    got = jobs.frames(df).orderBy("stream", "k").collect()
    assert {s: [(r.type, r.value, r.bad) for r in got if r.stream == s] for s in ("one", "seven", "all")} == dict.fromkeys(("one", "seven", "all"), want) and len(got) == 12
    feed = str(tmp_path / "feed")
    df.filter("n < 9").coalesce(1).write.parquet(feed)
    run = lambda: jobs.outcome(jobs.live_frames(spark.readStream.schema(df.schema).parquet(feed)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start())
    run()
    df.filter("n >= 9").coalesce(1).write.mode("append").parquet(feed)  # frames go on in the next trigger
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_ingest_isolates_failures_and_replaces(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files_ = lambda *rows: spark.createDataFrame([(s, f, bytearray(c, "utf-8")) for s, f, c in rows], "source string, format string, content binary")
    long = "# Title\n\n" + "\n\n".join(f"Paragraph {i} says something of its own about {i * 37} orders." for i in range(90))
    chunks, report = pipeline.ingest(files_(("a.md", "md", long), ("b.pdf", "pdf", "x"), ("c.md", "md", long), ("d.md", "md", "  ")), retrieval.hashed_encoder(8), path)
    got = {r.source: (r.status, r.reason) for r in report.collect()}
    assert got == {"a.md": ("stored", None), "b.pdf": ("failed", "no converter for pdf"), "c.md": ("copy", "same content as a.md"), "d.md": ("failed", "no text")}
    stored = versioned.read(spark, path)
    assert stored.count() == chunks.count() > 10 and stored.filter("parent_id <> '' and size(vector) = 8").count() == stored.filter("parent_id <> ''").count()
    with monkeypatch.context() as m:
        m.setattr(versioned, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            pipeline.ingest(files_(("a.md", "md", "# New\n\nA short one.")), retrieval.hashed_encoder(8), path)
    assert versioned.read(spark, path).count() == chunks.count()
    pipeline.ingest(files_(("a.md", "md", "# New\n\nA short one.")), retrieval.hashed_encoder(8), path)
    assert {r.text for r in versioned.read(spark, path).collect()} == {"New\n\nA short one."}


def test_run_evaluation(spark, tmp_path):
    chunks = spark.createDataFrame([("d1:p001", "", "d1", "zebra stripes explained"), ("d1:p001:c001", "d1:p001", "d1", "zebra stripes explained"), ("d2:p001", "", "d2", "harbour fees"), ("d2:p001:c001", "d2:p001", "d2", "harbour fees rose")], "chunk_id string, parent_id string, doc_id string, text string")
    asked = spark.createDataFrame([("q1", "zebra stripes", "a"), ("q2", "harbour fees", "b")], "question_id string, question string, ground_truth string")
    labels = spark.createDataFrame([("q1", "d1"), ("q2", "d2")], "query_id string, id string")
    samples, means = pipeline.evaluate(chunks, asked, labels, retrieval.hashed_encoder(), 2, "r", str(tmp_path / "rep"))
    assert means.first().recall_at_k == 1.0 and means.first().reciprocal_rank == 1.0 and samples.count() == 2
    assert spark.read.json(str(tmp_path / "rep/samples")).count() == 2 and json.loads((tmp_path / "rep/report.json").read_text())["runs"][0]["questions"] == 2


def test_memories(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, content string")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "key string, content string")
    assert {tuple(r) for r in sessions.put(old, new).collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert {r.key for r in sessions.forget(old, new).collect()} == {"a"} and sessions.forget(old, old.limit(0)).count() == 2
    rows = spark.createDataFrame([("t1", 1), ("t2", 2)], "thread string, n int")
    busy = spark.createDataFrame([("t1", "pending"), ("t2", "done")], "thread string, status string")
    assert [r.n for r in sessions.without_threads(rows, busy, rows.select("thread"), "thread").collect()] == [1]


def test_captions_and_cycles(spark):
    rows = [item(0, "before"), item(1, None, "image", image="i.png"), item(2, "x" * 61), item(3, None, "image"), item(4, " after "), item(5, "T", level=1), item(6, None, "image")]
    assert {r.pos: r.caption for r in cleaning.captions(spark.createDataFrame(rows, ITEM)).collect()} == {1: "before", 3: "after", 6: None}
    steps = spark.createDataFrame([("p", f"s{i}", "failed" if i == 0 else "pending") for i in range(12)] + [("q", "s1", "pending"), ("q", "s2", "pending")], "plan_id string, step_id string, status string")
    deps = spark.createDataFrame([("p", f"s{i}", f"s{i - 1}") for i in range(1, 12)] + [("p", "s1", "s11"), ("q", "s1", "s2"), ("q", "s2", "s1")], "plan_id string, step_id string, dep_id string")
    assert {r.step_id for r in tasks.cascade(steps, deps).collect()} == {f"s{i}" for i in range(1, 12)} and tasks.cascade(steps.filter("plan_id = 'q'"), deps).count() == 0


def test_encoders_by_type(spark):
    rows = spark.createDataFrame([("text", "a b", None), ("image", "data:x", "pic"), ("image", None, "pic")], "kind string, content string, shown string")
    flat = lambda n: lambda c: F.when(c.isNotNull(), F.array(F.lit(float(n)), F.length(c).cast("double")))
    got = [r.v for r in rows.select(retrieval.routed({"image": flat(2)}, F.col("kind"), flat(1), F.col("shown"))(F.col("content")).alias("v")).collect()]
    assert got == [[1.0, 3.0], [2.0, 6.0], [1.0, 3.0]]


def test_pages_at_positions(spark):
    rows = spark.createDataFrame([item(0, "abc", page=1), item(1, "de", page=None), item(2, "", page=2), item(3, "f", page=3)], ITEM)
    asked = spark.createDataFrame([("d", n) for n in (0, 4, 5, 8, 9, 10, 11, 99)] + [("none", 0), ("d", 0)], "doc_id string, at int")
    assert {r["at"]: r.page for r in chunking.pages_at(rows, asked).collect()} == {0: 1, 4: 1, 5: None, 8: None, 9: 2, 10: 2, 11: 3, 99: 3}


def test_form_values(spark):
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ((" b ", "1"), ("a", "2"), ("", "3"), ("b", "4"))])
    assert value(spark, render.record(rows)) == {"a": "2", "b": "4"} and value(spark, render.arguments(F.lit(" -x \n y  z"))) == ["-x", "y", "z"] and value(spark, render.arguments(F.lit(None))) == []
    shown = value(spark, render.labels(F.array(F.lit('"a\\"b"'), F.lit('{"name": "n"}'), F.lit('{"x": 1}'), F.lit("3")), 3))
    assert shown["labels"] == ['a"b', "n", '{"x": 1}'] and shown["more"] == 1


def test_sources(spark, tmp_path):
    (tmp_path / "in" / ".hid").mkdir(parents=True)
    for name, body in (("in/a.md", "# T\n\npara\nline\n\n## S\n\n| a | b |\n|---|---|\n\n```\ncode\n```\n"), ("in/_b.md", "x"), ("in/.hid/c.md", "x")):
        (tmp_path / name).write_text(body)
    got = files.listing(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "a.md"), str(tmp_path / "gone.md")]).collect()
    assert sorted(r.source for r in got) == ["_b.md", "a.md", "gone.md"] and [r.path for r in got] == sorted(r.path for r in got)
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.jsonl").write_text("".join(f'{{"a": {k * 100 + i}}}\r\n' + "\n" * (i % 3) for i in range(50)))
    numbered = files.json_lines(spark.newSession(), str(tmp_path / "many"), "a int")
    want = [(k * 100 + i, sum(1 + j % 3 for j in range(i)) + 1) for k in range(3) for i in range(50)]
    assert sorted((r.row.a, r.line) for r in numbered.collect()) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many splits a file
    try:
        assert sorted((r.row.a, r.line) for r in files.json_lines(spark, str(tmp_path / "many"), "a int").collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 3}\n')
    rows = files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("line").collect()
    assert [(r.line, r.problem) for r in rows] == [(1, None), (3, "line 3: no JSON"), (4, None)]
    df = files.binary(spark, str(tmp_path / "in")).filter("path like '%a.md'").select("doc_id", F.lit("a.md").alias("source"), F.lit("md").alias("format"), "content")
    out = documents.items(df).orderBy("pos").collect()
    assert [(r.type, r.level, r.heading_path) for r in out] == [("text", 0, ""), ("text", None, "T"), ("text", 1, "T"), ("table", None, "T > S"), ("text", None, "T > S")]
    bad = documents.items(spark.createDataFrame([("x", "s", "pdf", bytearray(b"x"))], "doc_id string, source string, format string, content binary")).first()
    assert bad.problem == "no converter for pdf"
    assert [k for k, _, _ in documents.html_blocks("<h1>A</h1><p>b</p><table><tr><td>1</td></tr></table>")] == ["text", "text", "table"]
    assert files.Settings.read({"CORPUSMILL_TOP_K": "7", "CORPUSMILL_DEPTH": " "}) == files.Settings(top_k=7)
    with pytest.raises(ValueError, match="CORPUSMILL_DEPTH"):
        files.Settings.read({"CORPUSMILL_DEPTH": "x"})
    with pytest.raises(ValueError):
        files.test_set(spark.range(1))
