"""Command lines, retrievers, whole evaluations, models over HTTP, sinks, and functions against plain versions."""

import hashlib
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark import cli
from siftspark.functions import chunking
from siftspark.operators import checks as K
from siftspark.operators import corpus as C
from siftspark.operators import packets
from siftspark.plans import corpus as corpus_plans
from siftspark.plans import pipelines as P
from siftspark.sources import chat, files
from siftspark.streaming import resume

TEXTS = ["A PersistentVolume is cluster storage.", "LoadBalancer exposes a Service outside the cluster.", "# Only a heading", "A Service selects pods by label. It has a stable address."]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    rows = [{"chunk_id": f"doc-00{i}-sec-001-ch-001", "section_id": f"s{i}", "document_id": f"doc-00{i}", "domain": "storage" if i < 2 else "net", "heading_path": ["Guide", "Part"], "text": t, "token_count": 40 if i != 2 else 3} for i, t in enumerate(TEXTS)]
    (at / "chunks.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["prepare", "--input", f"{at}/chunks.jsonl", "--output", f"{at}/prepared"], spark) == 0
    assert cli.main(["build-index", "--input", f"{at}/prepared", "--output", f"{at}/index", "--dense"], spark) == 0
    return at


def test_cli_search_and_describe(spark, index, capsys):
    assert cli.main(["search", "--index", f"{index}/index", "--query", "PersistentVolume storage", "--system", "bm25", "--top-k", "1", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["chunk"] == "doc-000-sec-001-ch-001"
    for system in ("dense", "hybrid"):
        assert cli.main(["search", "--index", f"{index}/index", "--query", "LoadBalancer service", "--system", system, "--domain", "net", "--json"], spark) == 0
        assert {json.loads(x)["chunk"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"doc-003-sec-001-ch-001"}
    assert cli.main(["describe", "--index", f"{index}/index"], spark) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["bm25"]["chunks"] == 3 and told["bm25"]["k1"] == 1.5 and told["hybrid"]["rrf_k"] == 20
    assert P.DenseRetriever(spark, f"{index}/index").describe()["chunks"] == 3
    assert cli.main(["prepare", "--input", f"{index}/chunks.jsonl", "--output", f"{index}/prepared"], spark) == 1
    assert "exists" in capsys.readouterr().err.lower()


def test_cli_chunks_manifest_and_gate(spark, index, tmp_path, capsys):
    sections = [{"section_id": f"s{i}", "document_id": f"d{i % 2}", "text": "Some words in a row. " * 30} for i in range(4)]
    (tmp_path / "sections.jsonl").write_text("\n".join(map(json.dumps, sections)))
    assert cli.main(["build-chunks", "--input", f"{tmp_path}/sections.jsonl", "--output", f"{tmp_path}/c", "--target", "40", "--overlap", "5", "--document-id", "d1", "--limit", "1"], spark) == 0
    assert {r.section_id for r in files.read_jsonl(spark, f"{tmp_path}/c", "section_id string").collect()} == {"s1"}
    (tmp_path / "m.yaml").write_text("documents:\n- {id: bad, domain: storage, title: t, url: 'http://x.example/?q', rationale: r}\n")
    assert cli.main(["validate-manifest", "--input", f"{tmp_path}/m.yaml", "--host", "x.example"], spark) == 1
    assert "id_shape" in capsys.readouterr().err
    (tmp_path / "now.jsonl").write_text('{"metric": "rr", "value": 0.5}')
    (tmp_path / "then.jsonl").write_text('{"metric": "rr", "frozen": 0.51, "tolerance": 0.02}')
    assert cli.main(["gate", "--measured", f"{tmp_path}/now.jsonl", "--frozen", f"{tmp_path}/then.jsonl"], spark) == 0
    (tmp_path / "then2.jsonl").write_text('{"metric": "rr", "frozen": 0.6, "tolerance": 0.02}')
    assert cli.main(["gate", "--measured", f"{tmp_path}/now.jsonl", "--frozen", f"{tmp_path}/then2.jsonl"], spark) == 1


def golden(spark):
    rows = [("k8s-001", "PersistentVolume storage", "direct_fact", "easy", "dev", True, [("doc-000-sec-001-ch-001", 3)]), ("k8s-002", "stable address of a service", "direct_fact", "easy", "test", True, [("doc-003-sec-001-ch-001", 2)]), ("k8s-003", "cooking rice", "negative_near_miss", "easy", "dev", False, [])]
    return spark.createDataFrame(rows, cli.QUESTION)


def test_evaluate_golden(spark, index):
    cats = {m[0] for m in __import__("siftspark.operators.planning", fromlist=["MATRIX"]).MATRIX}
    q = golden(spark).withColumn("category", F.when(F.col("category") == "direct_fact", F.lit(sorted(cats - {"negative_near_miss"})[0])).otherwise(F.col("category")))
    per, grouped = P.evaluate_golden(q, P.Bm25Retriever(spark, f"{index}/index"), "dev", strict=False)
    assert {r.question: r.top1 for r in per.collect()} == {"k8s-001": 1.0, "k8s-003": None}
    assert grouped.where("grouping = 'overall'").first().recall5 == 1.0
    with pytest.raises(ValueError, match="not in the index"):
        P.evaluate_golden(q.withColumn("relevance_judgments", F.expr("transform(relevance_judgments, x -> named_struct('chunk_id', 'doc-009-sec-001-ch-001', 'grade', 3))")).where("answerable"), P.Bm25Retriever(spark, f"{index}/index"), strict=False)
    with pytest.raises(ValueError, match="empty_question"):
        P.evaluate_golden(q.withColumn("question", F.lit(" ")), P.Bm25Retriever(spark, f"{index}/index"), strict=False)


def test_question_states(spark):
    class Says:
        def complete(self, system, user):
            told = json.loads(user)
            if "findings" in told:
                return json.dumps({"abstain": False, "answer": "better [C1]", "citations": ["C1"]})
            return json.dumps({"abstain": "skip" in told["question"], "answer": "" if "skip" in told["question"] else "said [C1]", "citations": [] if "skip" in told["question"] else ["C1"]})

    class Judges:
        def complete(self, system, user):
            told = json.loads(user)
            return json.dumps({"verdict": "contradicted" if "bad" in told["question"] else "supported", "quotes": [told["evidence"][0]["text"][:6]]})

    q = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "skip"), (4, "nothing found")], "question long, text string")
    hits = spark.createDataFrame([(i, i, 1, f"source {i}") for i in (1, 2, 3)], "question long, chunk long, rank long, text string")
    out = {r.question: r for r in P.question_states(q, hits, Says(), Judges()).collect()}
    assert [(out[i].status, out[i].verdict, out[i].repaired) for i in (1, 2, 3, 4)] == [("answered", "supported", None), ("answered", "contradicted", True), ("abstained", "not_applicable", None), ("no_evidence", "not_applicable", None)]
    assert out[2].repaired_answer == "better [C1]"


def test_http_chat():
    m = chat.HttpChat("openai", "https://h.example/v1/", "m", {"Authorization": "Bearer t"})
    r = m.request("s", "u")
    assert r.full_url == "https://h.example/v1/chat/completions" and r.get_header("Authorization") == "Bearer t"
    assert json.loads(r.data) == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "temperature": 0}
    assert m.read(b'{"choices": [{"message": {"content": "hi"}}]}') == "hi"
    with pytest.raises(KeyError):
        m.read(b"{}")
    assert chat.HttpChat("ollama", "http://localhost:11434", "m").read(b'{"message": {"content": "x"}}') == "x"
    with pytest.raises(ValueError):
        chat.HttpChat("ollama", "http://far.example", "m")
    with pytest.raises(ValueError):
        chat.HttpChat("other", "http://localhost", "m")


def test_matrix_hash_and_rendering(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "row_index long, vector array<float>")
    files.write_matrix(rows, f"{tmp_path}/m.npy")
    assert np.load(f"{tmp_path}/m.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert sorted(map(tuple, files.read_matrix(spark, f"{tmp_path}/m.npy").collect())) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    for bad, kind in ((rows, FileExistsError), (rows.withColumn("row_index", F.col("row_index") + 1), ValueError), (rows.withColumn("vector", F.slice("vector", 1, (F.col("row_index") + 1).cast("int"))), ValueError)):
        with pytest.raises(kind):
            files.write_matrix(bad, f"{tmp_path}/m.npy" if kind is FileExistsError else f"{tmp_path}/n.npy")
    files.write_matrix(rows.limit(0), f"{tmp_path}/empty.npy")
    assert np.load(f"{tmp_path}/empty.npy").shape == (0, 0)
    df = spark.createDataFrame([(2, "b\nc"), (1, None)], "n long, t string")
    files.write_jsonl(df, f"{tmp_path}/j", ["n"], single_file=True)
    part = next((tmp_path / "j").glob("part-*"))
    assert hashlib.sha256(part.read_bytes()).hexdigest() == files.content_hash(df, ["n"])
    for k in "ab":
        files.write_jsonl(df, f"{tmp_path}/z{k}", ["n"], single_file=True, gzip=True)
    assert len({next((tmp_path / f"z{k}").glob("part-*")).read_bytes() for k in "ab"}) == 1
    assert files.render(df.orderBy("n")) == "n  t\n1\n2  b c"
    assert files.render(df.orderBy("n"), True) == '{"n":1,"t":null}\n{"n":2,"t":"b\\nc"}'


def test_attached_vectors_fail_closed(spark):
    meta, matrix = spark.createDataFrame([(0, "a"), (1, "b")], "row_index long, id string"), spark.createDataFrame([(0, [1.0])], "row_index long, vector array<double>")
    with pytest.raises(Exception, match="no counterpart of row 1"):
        K.attach_vectors(meta, matrix).collect()


def test_selection(spark):
    df = spark.createDataFrame([(i, f"d{i % 2}") for i in range(6)], "n long, d string")
    assert [r.n for r in K.select_rows(df, ["n"], 2, d=["d1"]).collect()] == [1, 3] and K.select_rows(df, ["n"], d=[]).count() == 6
    with pytest.raises(ValueError):
        K.select_rows(df, ["n"], 0)
    with pytest.raises(ValueError):
        K.in_split(df, "train")


def test_word_counts_against_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: r[1] for r in corpus_plans.p10_word_count(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(re.findall(r"\b[\w.-]+\b", r.text or "")) for r in rows}


def plain_spans(text, settings, at):
    """Chunks from the rule as it is told, end by end."""
    out, start, before = [], 0, 0
    while at:
        wished = start + settings.target
        end = len(at)
        if wished < len(at):
            end, best = wished, 0
            for e in range(wished, max(start + settings.overlap + 1, wished - settings.search) - 1, -1):
                stop = at[e][0] + len(text[at[e][0] : at[e][1]]) - len(text[at[e][0] : at[e][1]].lstrip())
                tail = text[at[max(start, e - 16)][0] : stop] if stop > at[e][0] else text[at[max(start, e - 16)][0] : at[e - 1][1]]
                level = next((k for k, p in ((4, r"\n[ \t]*\n[ \t]*\Z"), (3, r"\n[ \t]*\Z"), (2, r"[.!?][\"')\]]*\s*\Z"), (1, r"\s\Z")) if re.search(p, tail)), 0)
                if level > best:
                    end, best = e, level
        out.append((start, end, before - start if out else 0, text[at[start][0] : at[end - 1][1]]))
        if end >= len(at):
            break
        start, before = end - settings.overlap, end
    return out


@pytest.mark.parametrize("file", [None, "byte_bpe_50k.json"])
def test_chunk_spans_against_plain_rule(file):
    if file:
        import public_tokenizers

        path = public_tokenizers.path(file)
    tokenize = chunking.bpe_spans(path) if file else chunking.regex_spans
    r = random.Random(5)
    parts = ["word", "日本", "😀", " ", ". ", "\n", "\n\n", "! ", "(a) ", '"', "x1", "   ", "é"]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        s = chunking.ChunkSettings(r.randint(8, 40), r.randint(0, 6))
        at = tokenize(t)
        assert "".join(t[a:b] for a, b in at) == t
        assert chunking.split_spans(t, s, tokenize) == plain_spans(t, s, at)


def test_chunks_by_tokenizer_file(spark):
    import public_tokenizers

    df = spark.createDataFrame([("a", "One sentence here. " * 40), ("b", None), ("c", "")], "section_id string, text string")
    out = C.build_chunks(df, settings=chunking.ChunkSettings(32, 4), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    assert C.chunk_violations(out, "section_id", chunking.ChunkSettings(32, 4)).isEmpty()
    assert {r.section_id for r in out.collect()} == {"a"} and out.agg(F.max("token_end")).first()[0] == 161


def test_ingest_takes_back_old_content(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, t in enumerate(("a", "b", "a", "a")):
        (src / f"{n}.json").write_text(json.dumps({"k": 1, "t": t}))
        resume.ingest_changed(spark, str(src), "k long, t string", f"{tmp_path}/out", f"{tmp_path}/cp", "k", "t")
    assert sorted((r.batch, r.t) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, "a"), (1, "b"), (2, "a")]


def test_evidence_digits_of_any_script(spark):
    from siftspark.functions.text import evidence_tokens

    t = "has ٣٤٥ and 12 parts"
    got = spark.createDataFrame([(t,)], "t string").select(evidence_tokens(F.col("t"))).first()[0]
    assert "٣٤٥" in got and "12" in got and unicodedata.digit("٣") == 3


def test_labelling_packs(spark):
    slots = spark.createDataFrame([(1, "comparison", "easy", "dev"), (2, "negative_near_miss", "hard", "test")], "turn long, category string, difficulty string, split string")
    numbers = spark.createDataFrame([(4,), (12,)], "number long")
    anchors = spark.createDataFrame([(10, "a"), (20, "z")], "place int, chunk string")
    near = spark.createDataFrame([("a", c, s) for c, s in (("b", 0.9), ("c", 0.8), ("d", 0.7))], "anchor string, chunk string, score double")
    chunks = spark.createDataFrame([("a", "x", 1, "A"), ("b", "x", 1, "B"), ("c", "y", 2, "C"), ("d", "x", 3, None), ("z", None, None, "Z")], "chunk string, domain string, document int, text string")
    seeds = spark.createDataFrame([("q-001", "direct_factual", "easy", "dev")], "question_id string, category string, difficulty string, split string")
    got = {r["question_id"]: r for r in packets.labelling_packs(slots, numbers, anchors, near, chunks, seeds).collect()}
    assert [x["context"]["chunk"] for x in got["q-004"]["related"]] == ["d", "b", "c"] and got["q-004"]["anchor_context"]["text"] == "A"
    assert got["q-012"]["related"] == [] and got["q-012"]["answerable"] is False and got["q-012"]["anchor_context"]["chunk"] == "z"
    assert got["q-001"]["status"] == "seed_complete" and got["q-001"]["advice"] is None
    with pytest.raises(Exception, match="no number or no anchor"):
        packets.labelling_packs(slots, numbers.limit(1), anchors, near, chunks, seeds).collect()


def test_packets_and_review_scores_of_odd_rows(spark):
    questions = spark.createDataFrame([("p", "why"), ("q", None)], "question string, text string")
    snippets = spark.createDataFrame([("p", f"E{n}", n, None) for n in (2, 10, 1)], "question string, evidence_id string, chunk int, quote string")
    got = {r["question"]: r for r in packets.evidence_packets(questions, snippets).collect()}
    assert got["p"]["evidence_ids"] == "E1; E2; E10" and got["q"]["evidence_status"] == "missing_saved_retrieval" and got["q"]["evidence"] is None
    reviews = spark.createDataFrame([(1, " Supported "), (2, "partial"), (3, None), (4, "contradicted"), (5, "supported")], "key int, relation string")
    gold = spark.createDataFrame([(1, True), (2, True), (4, False)], "key int, answerable boolean")
    r = packets.review_scores(reviews, gold).first()
    assert (r.questions, r.reviewed, r.unreviewed, r.all_reviewed, r.positive_supported, r.positive_partial, r.negative_contradicted, r.negative_supported) == (5, 4, 1, False, 1, 1, 1, 0)
    assert packets.review_scores(reviews.limit(0), gold).first().all_reviewed is True
