"""Steps that must stay small on large tables, against plain versions of their rules."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType

from siftspark.functions import batches
from siftspark.functions.text import evidence_tokens
from siftspark.operators import corpus as C
from siftspark.operators import evidence as E
from siftspark.operators import metrics as M
from siftspark.operators import retrieval as R
from siftspark.plans import corpus, evaluation, packets, tables


def parts(df):
    """The text of the plan that runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def tokens_of(spark, text):
    return spark.range(1).select(evidence_tokens(F.lit(text))).head()[0]


def test_snippets_cut_a_question_once(spark):
    """The question is a table of its own; scores are those of a loop over the units, and an equal unit isn't listed twice."""
    texts = {1: "Alpha beta gammaRay delta-wave the epsilon 42", 2: None}
    lines = ["alpha beta", "alpha", "#### Note: gamma ray", "nothing here", "Delta_wave 42 alpha", ""]
    units = [(q, c, c % 4 + 1, i, i + 1, t) for q in texts for c in range(5) for i, t in enumerate(lines[c % 3 :])]
    schema = "question long, chunk long, rank long, lo long, hi long, quote string"
    got = E.rank_snippets(spark.createDataFrame(units, schema), spark.createDataFrame(list(texts.items()), "question long, question_text string"))
    want = set()
    for q, text in texts.items():
        asked = set(tokens_of(spark, text))
        own = [(u, asked & set(tokens_of(spark, u[5]))) for u in units if u[0] == q]
        f = Counter(t for _, terms in own for t in terms)
        scored = []
        for u, terms in own:
            w = sum(1 + math.log((len(own) + 1) / (f[t] + 1)) for t in terms) + 0.22 / u[2] - (0.3 if u[5].startswith("#### Note:") else 0)
            scored.append((-round(w, 5), u[2], u[3], u[1], u[4], tuple(sorted(terms))))
        per, kept = defaultdict(int), []
        for x in sorted(scored):
            per[x[3]] += 1
            if per[x[3]] <= 2:
                kept.append(x)
        want |= {(q, f"E{n}", x[3], x[2], x[5], -x[0]) for n, x in enumerate(kept[:6], 1)}
    assert {(r.question, r.evidence_id, r.chunk, r.lo, tuple(r.terms), r.lexical_score) for r in got.collect()} == want
    with pytest.raises(ValueError):
        E.rank_snippets(got, got, 0)


def test_packets_move_no_question_text(spark, sf_dir):
    """No task gets the text of a question with each line of its documents."""
    plan = parts(packets.c21_packets(spark, sf_dir))
    assert "question_text" not in plan and plan.count("min_by") == 0


def test_sections_and_questions_count_judgments_by_label(spark, sf_dir):
    """Counts and grades are those of the judgments themselves, but no task makes the pairs of a label."""
    judged = tables.vector_judgments(spark, sf_dir)
    sections = evaluation._sections(spark, sf_dir)
    for item, whole in (("chunk", judged), ("section", M.section_judgments(judged, sections))):
        want = {(r.question, r.grade): r["count"] for r in whole.groupBy("question", "grade").count().collect()}
        assert {(r.question, r.grade): r.n for r in tables.judgment_counts(spark, sf_dir, item).collect() if r.n} == want
        some = whole.where("question % 300 = 0").select("question", "chunk", "grade")
        pairs = some.select("question", "chunk").unionByName(some.select("question", (F.col("chunk") + 1).alias("chunk"))).distinct()
        assert sorted(tables.pair_judgments(spark, sf_dir, pairs, item).collect()) == sorted(pairs.join(whole, ["question", "chunk"]).select("question", "chunk", "grade").collect())
    rows = [(q, c, (q * c) % 4) for q in range(5) for c in range(q * 3)]
    got = {r.question: r for r in M.ideal(spark.createDataFrame(rows, "question long, chunk long, grade int")).collect()}
    for q in range(1, 5):
        grades = sorted((g for p, _, g in rows if p == q and g > 0), reverse=True)
        assert (got[q].n_rel if q in got else 0) == len(grades)
        for k in M.CUTS:
            assert not grades or got[q][f"idcg{k}"] == pytest.approx(sum((2**g - 1) / math.log2(n + 2) for n, g in enumerate(grades[:k])))


def test_near_search_ranks_pairs_without_making_them(spark):
    """Ids far and near, scores that round alike and ties at half a digit, against SQL's rounding of every pair."""
    ids = sorted({*range(0, 40), 127, 128, 639, 640, 3199, 16000, 80000, 400_000, 1_999_999, 2_000_000, 10_000_000, 10_000_003})
    v = spark.createDataFrame([(i, i % 2) for i in ids], "chunk long, topic long")
    q = v.where("chunk % 4 = 0 OR chunk > 100").select(F.col("chunk").alias("q"), "topic")
    pairs = q.join(v, "topic").where("q <> chunk").select(F.col("q").alias("query"), "chunk", F.round(1 / (1 + F.abs(F.col("q") - F.col("chunk"))), 6).alias("score"))
    for k in (1, 5, 100):
        got = R.near_search(v, q, k)
        assert "Join" not in parts(got)
        assert sorted(got.collect()) == sorted(R.top_k(pairs, k).select("query", "chunk", "score", "rank").collect())


def test_a_task_keeps_the_best_of_all_its_batches(monkeypatch):
    """However a task's rows are cut, it passes on k rows a query: those of a sort of all scores."""
    r = np.random.default_rng(1)
    scores, chunk = np.round(r.random((7, 500)), 1), r.permutation(500)
    scores[2, 5] = R.NAN
    best = R._Best(7, 6)
    for low in range(0, 500, 61):
        best.offer(scores[:, low : low + 61], chunk[low : low + 61])
    schema = to_arrow_schema(R._found_schema(LongType(), LongType()))
    rows = [x for b in best.batches(pa.array(range(7), pa.int64()), schema) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(q, int(chunk[c])) for q in range(7) for c in sorted(range(500), key=lambda c: (-scores[q, c], chunk[c]))[:6]]
    assert sorted((q, c) for q, c, _ in rows) == sorted(want) and sum(x[2] != x[2] for x in rows) == 1
    # A block of queries with all rows of a task: as many rows as queries and k ask for, not as batches do.
    monkeypatch.setattr(R, "SLICE_ROWS", 8)
    monkeypatch.setattr(R, "CELLS", 16)
    m, v = r.random((5, 4)), r.random((90, 4))
    batches = [pa.RecordBatch.from_pydict({"chunk": pa.array(range(n, n + 30)), "v": pa.array([list(x) for x in v[n : n + 30]])}) for n in (0, 30, 60)]
    out = [x for b in R._block_scores(list(range(5)), m, 3, True, schema)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    s = np.round(m @ v.T, 6)
    assert sorted(out) == sorted((q, c, s[q, c]) for q in range(5) for c in sorted((c for c in range(90) if c != q), key=lambda c: (-s[q, c], c))[:3])


def test_sweep_orders_lists_not_pairs_times_settings(spark, sf_dir):
    """The sweep has no window over candidates times settings, and ranks as ``fuse`` does under each of them."""
    rows = [(q, c, (c * 7 + q) % 30 + 1 if c % 3 else None, (c * 11 + q) % 30 + 1 if c % 3 != 1 else None, c % 4 or None) for q in range(4) for c in range(25)]
    both = spark.createDataFrame(rows, "query long, chunk long, dense_rank long, bm25_rank long, grade int")
    grid = M.fusion_grid(spark).where("candidate_k < 100")
    got = R.fuse_each(both, grid, 5)
    assert "Window" not in parts(got)
    want = []
    for s in grid.collect():
        cut = lambda c, s=s: F.when(F.col(c) <= s.candidate_k, F.col(c))
        own = both.withColumns({"dense_rank": cut("dense_rank"), "bm25_rank": cut("bm25_rank")}).where("dense_rank IS NOT NULL OR bm25_rank IS NOT NULL")
        want.append(R.fuse(own, 5, float(s.rrf_k), 1.0, s.bm25_weight).select(F.lit(s.bm25_weight).alias("w"), F.lit(s.rrf_k).alias("r"), F.lit(s.candidate_k).alias("c"), "query", "chunk", "grade", "rank"))
    whole = want[0]
    for w in want[1:8]:
        whole = whole.union(w)
    some = {tuple(x) for x in whole.collect()}
    assert some == {tuple(x) for x in got.collect() if (x.bm25_weight, x.rrf_k, x.candidate_k) in {y[:3] for y in some}}


def test_bm25_scores_rows_where_they_are(spark, monkeypatch):
    """Scores against a loop over all pairs, in pieces of any size; nothing is shuffled but what is kept."""
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9 + 1)) if i % 7 else None) for i in range(60)]
    asks = [(q, f"w{q} w{q} W{q + 1} w{q * 2 % 17} nowhere") for q in range(6)]
    chunks, queries = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(asks, "query_id long, text string")
    terms = {i: (t or "").split() for i, t in docs}
    avg, df = sum(map(len, terms.values())) / len(docs), Counter(w for t in terms.values() for w in set(t))
    weight = lambda w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
    want = {}
    for q, text in asks:
        for i, t in terms.items():
            own = [weight(w) * 2.5 * t.count(w) / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.lower().split() if w in t]
            if own:
                want[q, i] = pytest.approx(sum(own), abs=2e-6)
    found = R.bm25_scores(chunks, queries)
    assert "Exchange" not in parts(found)
    assert {(r.query, r.chunk): r.score for r in found.collect()} == want
    some = {(r.query, r.chunk) for r in R.bm25_scores(chunks, queries, allowed=F.col("chunk_id") % 2 == 0).collect()}
    assert some == {k for k in want if k[1] % 2 == 0}
    top = R.bm25_search(chunks, queries, 3).collect()
    assert sorted((r.query, r.chunk) for r in top) == sorted((q, i) for q in range(6) for i in sorted((i for p, i in want if p == q), key=lambda i: (-round(want[q, i].expected, 6), i))[:3])
    assert R.bm25_scores(chunks, queries.where("false")).count() == 0 and R.bm25_scores(chunks.where("false"), queries).count() == 0
    monkeypatch.setattr(R, "CELLS", 5)
    schema = to_arrow_schema(R._found_schema(LongType(), LongType()))
    each = [(q, w, weight(w) * 2.5) for q, text in asks for w in text.lower().split() if w in df]
    batch = pa.RecordBatch.from_pydict({"chunk": pa.array(list(terms)), "t": pa.array(list(terms.values()), pa.list_(pa.string()))})
    out = {(q, c): s for b in R._term_scores(each, avg, 1.5, 0.75, None, schema)(iter([batch])) for q, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    assert out == want


def test_results_of_a_batch_come_in_parts(monkeypatch):
    monkeypatch.setattr(batches, "PART_CHARS", 10)
    texts = pd.Series(["abc", None, "x" * 25, "", "abcdefgh", "ab"])
    got = list(batches.parts(texts, pd.Series(range(6))))
    assert [list(n) for _, n in got] == [[0, 1, 2], [3, 4, 5]] and len(list(batches.parts(texts[:0]))) == 1
    assert [x for t, _ in got for x in t] == list(texts)


def test_integrity_joins_are_dealt_by_counted_rows(spark, sf_dir, monkeypatch):
    """A task of the joins gets a stated number of lines, whatever the table's size; a line is joined once for both rules."""
    monkeypatch.setattr(C, "ROWS_A_TASK", 100)
    df = corpus.j06_integrity(spark, sf_dir)
    lines = tables.read(spark, sf_dir, "lineitem").count()
    plan = parts(df)
    assert "hashpartitioning(l_orderkey" in plan and f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan
    monkeypatch.undo()
    assert sorted(df.collect()) == sorted(corpus.j06_integrity(spark, sf_dir).collect())
