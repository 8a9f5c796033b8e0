"""Operators without SQL: chunk spans, HTML blocks, quotable spans, sources, pipelines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftspark.functions.chunking import ChunkSettings, boundary_priority, regex_spans, split_spans
from siftspark.functions.evidence_spans import extract_spans
from siftspark.functions.html_blocks import html_blocks
from siftspark.functions.text import contains_quote
from siftspark.operators import checks as K
from siftspark.operators import corpus as C
from siftspark.operators import evidence as E
from siftspark.operators import metrics as M
from siftspark.plans import pipelines as P
from siftspark.plans.evidence import p29_quotes
from siftspark.sources import chat, fetch, files
from siftspark.streaming import resume


def test_token_spans_lose_nothing():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["word ", "x", ". ", "\n", "\n\n", "é", "!", "  "]) for _ in range(r.randint(0, 80)))
        spans = regex_spans(t)
        assert "".join(t[a:b] for a, b in spans) == t


def test_chunks_overlap_and_end():
    r = random.Random(2)
    s = ChunkSettings(40, 8)
    for _ in range(100):
        t = " ".join(r.choice(["one", "two.", "three\n", "four\n\n"]) for _ in range(r.randint(0, 300)))
        out, n = split_spans(t, s), len(regex_spans(t))
        assert (not out and not n) or (out[0][0] == 0 and out[-1][1] == n)
        for a, b in zip(out, out[1:], strict=False):
            assert a[1] - b[0] == 8 and b[1] > a[1]
        assert all(b - a <= 40 for a, b, _, _ in out)


def test_chunks_prefer_better_ends():
    assert [boundary_priority(x) for x in ("a\n\n", "a\n", "a. ", "a ", "a")] == [4, 3, 2, 1, 0]
    t = "w " * 30 + "end.\n\n" + "v " * 40
    first = split_spans(t, ChunkSettings(40, 4))[0]
    assert first[3].endswith("end.")
    with pytest.raises(ValueError):
        ChunkSettings(10, 10)


def test_quotable_spans_are_verbatim():
    text = "# Head\n\nA paragraph that is long enough to quote.\n\n```\ncode code code code code code\n```\n\nshort\n\n" + "Sentence number one is here. " * 30
    out = extract_spans(text, 100)
    assert all(hi - lo <= 100 and text[lo:hi].strip() == text[lo:hi] and "code" not in text[lo:hi] for lo, hi, _ in out) and len(out) > 20
    assert extract_spans("") == [] and extract_spans("tiny") == [(0, 4, False)]


def test_html_blocks():
    page = "<body><nav>n</nav><main><h1>T</h1><p>a <b>b</b> <a href='/x'>l</a></p><p>a <b>b</b> <a href='/x'>l</a></p><ol><li>x<ul><li>y</li></ul></li></ol><pre><code class='language-py'>c = 1\n</code></pre><table><tr><th>h</th></tr><tr><td>v</td></tr></table><dl><dt>d</dt><dd>e</dd></dl><hr><blockquote>q</blockquote><h2>Feedback</h2><p>no</p></main></body>"
    b = html_blocks(page, "https://e.example/d/")
    assert [x["type"] for x in b] == ["heading", "paragraph", "list", "code", "table", "definition_list", "separator", "blockquote"]
    assert b[1]["text"] == "a **b** [l](https://e.example/x)" and b[2]["text"] == "1. x\n  - y" and b[3]["language"] == "py" and b[4]["rows"] == [["h"], ["v"]]
    assert html_blocks(None) == []


def test_heading_tree_against_stack(spark):
    r = random.Random(4)
    rows = [(d, i, "heading" if r.random() < 0.6 else "paragraph", r.randint(1, 6), f"t{i}") for d in range(30) for i in range(r.randint(1, 20))]
    got = {(x.document_id, x.section_order): (x.parent_order, x.heading_path) for x in C.heading_tree(spark.createDataFrame(rows, "document_id long, block_index long, type string, level int, text string")).collect()}
    stacks, order = {}, {}
    for d, _, kind, level, text in rows:
        if kind == "heading":
            order[d] = order.get(d, 0) + 1
            s = stacks.setdefault(d, [])
            while s and s[-1][0] >= level:
                s.pop()
            assert got[d, order[d]] == (s[-1][1] if s else None, [x[2] for x in s] + [text])
            s.append((level, order[d], text))


def test_evidence_budget_against_loop(spark):
    r = random.Random(5)
    rows = [(q, c, k, "x" * r.randint(0, 2500)) for q in range(20) for k, c in enumerate(r.choices(range(12), k=14), 1)]
    got = sorted(tuple(x)[:6] for x in E.select_evidence(spark.createDataFrame(rows, "question long, chunk long, rank long, text string")).collect())
    want = []
    for q in range(20):
        left, seen, n = 10_500, set(), 0
        for _, c, k, t in (x for x in rows if x[0] == q):
            if c in seen:
                continue
            seen.add(c)
            if not t.strip():
                continue
            if left < 100:
                break
            size = min(len(t), 1500, left)
            n += 1
            want.append((q, c, k, f"C{n}", size, size < len(t)))
            left -= size
    assert got == sorted(want)


def test_fail_closed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "k long, t string")
    with pytest.raises(ValueError, match="empty: 2"):
        C.fail_closed(C.violation(df, "empty", F.col("k"), F.col("t") == ""))
    C.fail_closed(C.violation(df, "none", F.col("k"), F.lit(False)))


CHUNKS = [("a", "PersistentVolume is cluster storage.", "d1"), ("b", "LoadBalancer exposes a Service outside the cluster.", "d2")]


def test_index_search_and_tampering(spark, tmp_path):
    chunks = spark.createDataFrame([(i, c, t, d) for i, (c, t, d) in enumerate(CHUNKS)], "n long, name string, retrieval_text string, document_id string").withColumnRenamed("n", "chunk_id")
    path = f"file://{tmp_path}/index"
    P.build_bm25_index(chunks, path)
    P.check_bm25_index(spark, path, chunks)
    with pytest.raises(ValueError):
        P.check_bm25_index(spark, path, chunks.withColumn("retrieval_text", F.upper("retrieval_text")))
    q = spark.createDataFrame([(0, "What is a PersistentVolume?"), (1, "LoadBalancer service"), (2, "???")], "query_id long, text string")
    found = {(r.query, r.rank): r.chunk for r in P.search_index(spark, path, q, 2).collect()}
    assert found[0, 1] == 0 and found[1, 1] == 1 and (2, 1) not in found
    P.build_dense_index(chunks, path)
    hybrid = P.HybridRetriever(spark, path)
    assert {(r.query, r.chunk) for r in hybrid.search(q, 1).where("query < 2").collect()} == {(0, 0), (1, 1)}
    meta = chunks.select(F.col("chunk_id").alias("chunk"), F.lit("x").alias("domain"), "document_id")
    assert {r.chunk for r in hybrid.search(q, 2, meta, document_ids=[" d2 ", ""]).collect()} == {1}
    with pytest.raises(ValueError):
        P.HybridRetriever(spark, path, dense_weight=0, bm25_weight=0)


def test_answers(spark):
    class Echo:
        def complete(self, system, user):
            import json

            ids = [e["id"] for e in json.loads(user)["evidence"]]
            if "fail" in user:
                raise TimeoutError("no answer")
            return json.dumps({"abstain": False, "answer": f"said [{ids[0]}]", "citations": ids[:1]})

    q = spark.createDataFrame([(1, "q one"), (2, "fail"), (3, "nothing")], "question long, text string")
    hits = spark.createDataFrame([(1, 7, 1, "some text"), (2, 8, 1, "other text")], "question long, chunk long, rank long, text string")
    out = {r.question: r for r in P.answer_questions(q, hits, Echo(), "sys").collect()}
    assert (out[1].status, out[1].citations, out[2].status, out[3].status) == ("answered", ["C1"], "generation_error", "no_evidence")
    assert out[2].error.startswith("TimeoutError")


def test_fetch_waits_and_refuses():
    waits, calls = [], []
    answers = [fetch.Answer(503, "https://h.example/", {"retry-after": "7"}), fetch.Answer(200, "https://h.example/", {"content-type": "text/html; charset=x"}, b"<p>")]
    limiter = fetch.RateLimiter(1.0, clock=lambda: 0.0, sleep=waits.append)
    a, n = fetch.fetch("https://h.example/", lambda u: (calls.append(u), answers[len(calls) - 1])[1], limiter, frozenset(["h.example"]))
    assert a.body == b"<p>" and n == 2 and waits == [7.0, 1.0]
    for bad in (fetch.Answer(200, "http://h.example/", {"content-type": "text/html"}, b"x"), fetch.Answer(200, "https://evil.example/", {"content-type": "text/html"}, b"x"), fetch.Answer(200, "https://h.example/", {"content-type": "image/png"}, b"x"), fetch.Answer(404, "https://h.example/")):
        with pytest.raises(fetch.FetchError):
            fetch.fetch("u", lambda u, bad=bad: bad, limiter, frozenset(["h.example"]))
    assert fetch.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 1e12) == 0.0


def test_verifier_stays_local():
    with pytest.raises(ValueError):
        chat.require_local("https://far.example/api")
    chat.require_local("http://localhost:11434")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "b"), (1, "=x", "a")], "n long, t string, c string")
    out = f"{tmp_path}/rows"
    files.write_jsonl(df, out, ["n"], single_file=True)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"c":"a","n":1,"t":"=x"}', '{"c":"b","n":2,"t":null}']
    assert files.read_jsonl(spark, out, "n long, c string").count() == 2
    with pytest.raises(Exception, match="exists"):
        files.write_jsonl(df, out, ["n"])
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n long").collect()
    files.write_review_csv(df, f"{tmp_path}/r.csv")
    back = files.read_csv(spark, f"{tmp_path}/r.csv", ["n", "t", "c"]).orderBy("n").collect()
    assert back[0].t == "'=x"
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/r.csv", ["n", "c"])
    (tmp_path / "m.yaml").write_text("documents:\n- {id: a-001, url: 'https://x.example'}\n")
    assert files.read_manifest(spark, str(tmp_path / "m.yaml")).first().id == "a-001"
    assert files.settings_hash({"b": 1, "a": 2}) == files.settings_hash({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        files.check_written(df.select(F.col("n").alias("row_index")))
    packet = files.packet_markdown(spark.createDataFrame([("g", 1, "t", "x ```` y")], "g string, o long, t string, b string"), "g", "o", "t", "b").first().markdown
    assert "`````\nx ```` y\n`````" in packet


def test_resume_and_ingest(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,)], "k long")
    step = lambda s: lambda d: d.withColumn("status", F.when(F.col("k") == 2, s).otherwise("answered"))
    path = f"{tmp_path}/done"
    assert {r.k: r.status for r in resume.resume(work, path, "k", "f1", step("generation_error")).collect()} == {1: "answered", 2: "generation_error"}
    assert {r.k: r.status for r in resume.resume(work, path, "k", "f1", step("answered")).collect()} == {1: "answered", 2: "answered"}
    with pytest.raises(ValueError):
        resume.resume(work, path, "k", "f2", step("answered"))
    src = tmp_path / "in"
    src.mkdir()
    for n, rows in enumerate(('{"k": 1, "t": "a"}\n{"k": 2, "t": "b"}', '{"k": 1, "t": "a"}\n{"k": 2, "t": "c"}')):
        (src / f"{n}.json").write_text(rows)
        resume.ingest_changed(spark, str(src), "k long, t string", f"{tmp_path}/out", f"{tmp_path}/cp", "k", "t")
    assert sorted((r.k, r.t) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_quotes_in_all_documents(spark, sf_dir):
    """A row for every document, against Python's case folding."""
    flat = lambda t: re.sub(r"\s+", " ", t or "").strip().casefold()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    quotes = [(r.text or "")[4:16].upper() if r.doc_id % 3 == 0 else " " if r.doc_id % 3 == 1 else "zzzz qq" for r in docs]
    want = [(r.doc_id, flat(q) != "" and flat(q) in flat(r.text)) for r, q in zip(docs, quotes, strict=True)]
    assert sorted(map(tuple, p29_quotes(spark, sf_dir).collect())) == sorted(want)
    odd = [("Die Straße", "STRASSE"), ("a\u00a0b\u2003 c\x1cd", "A B C D"), ("λόγος", "ΛΌΓΟΣ"), ("λόγοσα", "όγος"), ("été", "ETE"), (None, "a"), ("a", None), (None, None), ("a", "\u00a0")]
    got = spark.createDataFrame(odd, "s string, q string").select("s", "q", contains_quote(F.col("s"), F.col("q")).alias("f")).collect()
    assert [(r.s, r.q, r.f) for r in got] == [(a, b, flat(b) != "" and flat(b) in flat(a)) for a, b in odd]


def test_quotes_fold_every_letter(spark):
    """Each letter that case folding changes, and the dotless i, against Python's case folding in all its cases; all white space is alike."""
    flat = lambda t: re.sub(r"\s+", " ", t).strip().casefold()
    letters = [c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) <= 0xDFFF and (c.casefold() != c or c.upper() != c)]
    pairs = {(f"x{a}y", f"X{b}Y") for c in letters for d in (c.upper(), c.lower(), c.casefold()) for a, b in ((c, d), (d, c))}
    pairs |= {(f"x{c}y", "X Y") for c in map(chr, range(1, 0x3100))}
    odd = [("STRAẞE", "strasse"), ("strasse", "STRAẞE"), ("Straße", "STRAẞE"), ("STRAẞE", "Straße"), ("kapı", "KAPI"), ("KAPI", "kapı"), ("kapı", "kapı"), ("kapı", "kapß"), ("kapß", "kapı"), ("kapẞ", "kapı")]
    got = spark.createDataFrame(sorted(pairs) + odd, "s string, q string").select("s", "q", contains_quote(F.col("s"), F.col("q")).alias("f")).collect()
    assert [(r.s, r.q, r.f) for r in got if r.f != (flat(r.q) in flat(r.s))] == []


def test_running_sums_over_slices(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, -1.5, *[rng.random() for _ in range(40)]]), rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, x double, n int").groupBy("x").agg(F.sum("n").alias("n"))
    for down in (False, True):
        got = {r["x"]: r for r in M.running(df, "x", ("n",), down=down).collect()}
        sums = {x: sum(n for _, y, n in rows if y == x) for x in {y for _, y, _ in rows}}
        order = sorted(sums, key=lambda x: (x is not None, x or 0), reverse=down)
        assert set(got) == set(sums) and {r["all_n"] for r in got.values()} == {sum(sums.values())}
        assert {r["last_value"] for r in got.values()} == {max(x for x in sums if x is not None) if not down else min(x for x in sums if x is not None)}
        seen = 0
        for i, x in enumerate(order):
            seen += sums[x]
            assert got[x]["to_n"] == seen and (x is None or got[x]["previous"] == (order[i - 1] if i else None))


def test_thresholds_of_odd_scores(spark):
    one = spark.createDataFrame([(0.5, True), (0.5, False), (None, True)], "score double, positive boolean")
    assert sorted(r[0] for r in M.thresholds(one).collect()) == [0.5 - M.EDGE, 0.5 + M.EDGE]
    assert M.auroc(one.where("score IS NOT NULL")).head()[0] == 0.5
    none = one.where("false")
    assert M.thresholds(none).count() == 0 and M.confusion(none, M.thresholds(none)).count() == 0 and M.auroc(none).head()[0] is None
    two = spark.createDataFrame([("a", "dev", 0.25, True), ("a", "dev", 0.75, False), ("a", "test", 0.9, True), ("b", "dev", 3.0, True), ("b", "dev", 1.0, False), ("b", "test", 2.5, True)], "system string, split string, score double, positive boolean")
    got = {r["system"]: (r["threshold"], r["dev_auroc"], r["recall"]) for r in K.system_thresholds(two).collect()}
    assert got["b"] == (2.0, 1.0, 1.0) and got["a"][1] == 0.0
