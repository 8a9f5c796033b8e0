"""Evidence selection, citation checks, verdicts and states over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence_spans import spans_of
from ..functions.text import STOP_WORDS, citation_markers, contains_quote
from ..operators import evidence as E
from .tables import read

def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as answers: those of the assistant answered, of the system abstained, others failed; with markers
    and sources made from the row's numbers."""
    c = read(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 3 + F.col("turn")
    key = F.concat_ws("-", "conv_id", "turn")
    status = F.when(F.col("role") == "assistant", "answered").when(F.col("role") == "system", "abstained").otherwise("generation_error")
    marks = F.concat(F.lit(" [C"), (n % 3 + 1).cast("string"), F.lit("] and [C"), (n % 2 + 1).cast("string"), F.lit("] `fieldRef` useOf("))
    body = F.when(n % 7 == 0, F.lit("Lorem ipsum.")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    answer = F.when(n % 5 == 0, body).otherwise(F.concat(body, marks))
    ids = F.when(n % 4 == 0, F.array(F.lit("C1"))).otherwise(F.array(F.lit("C1"), F.concat(F.lit("C"), (n % 3 + 1).cast("string"))))
    return c.select(key.alias("key"), "conv_id", "turn", n.alias("n"), status.alias("status"), answer.alias("answer"), ids.alias("ids"), F.concat("text", F.when(n % 2 == 0, F.lit(" fieldref")).otherwise("")).alias("source_text"))


def p24_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("key", F.array_join(citation_markers(F.col("answer")), ",").alias("markers"))


def p28_structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    flags = E.structural_checks(F.col("status"), F.col("answer"), F.col("ids"), F.col("source_text"))
    return a.select("key", F.array_join(flags["hard_flags"], ",").alias("hard"), F.array_join(flags["review_flags"], ",").alias("review"))


def _raw() -> Column:
    """What a model might have said: sometimes broken, abstaining, citing too much."""
    n = F.col("n")
    cited = F.when(n % 3 == 0, F.expr("transform(ids, x -> x)")).otherwise(F.array(F.concat(F.lit("C"), (n % 3 + 1).cast("string")), F.concat(F.lit("C"), (n % 2 + 1).cast("string"))))
    return F.when(n % 11 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct((n % 6 == 0).alias("abstain"), F.when((n % 6 == 0) & (n % 12 == 0), "").otherwise(F.col("answer")).alias("answer"), F.when((n % 6 == 0), F.array().cast("array<string>")).otherwise(cited).alias("citations"))))


def p25_parsed_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _answers(spark, sf_dir).select("key", E.parse_generation(_raw(), F.array(F.lit("C1"), F.lit("C2"))).alias("p"))
    return p.select("key", F.col("p.abstain").alias("abstain"), F.coalesce("p.error", F.lit("ok")).alias("error"))


def p26_used_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, listed = F.array(F.lit("C1"), F.lit("C2"), F.lit("C3")), F.array(F.lit("C3"), F.lit("C2"), F.lit("C1"))
    return _answers(spark, sf_dir).select("key", F.coalesce(F.array_join(E.used_citations(F.col("answer"), listed, known), ","), F.lit("-")).alias("used"))


def p27_chunk_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    listed = F.array(F.concat(F.lit("k"), (n % 3).cast("string")), F.lit("C9"), F.lit("kk"))
    ids, chunks = F.array(F.lit("C1"), F.lit("C2"), F.lit("C3"), F.lit("C4")), F.array(F.lit("k0"), F.lit("k1"), F.lit("kk"), F.lit("kk"))
    return _answers(spark, sf_dir).select("key", F.array_join(E.known_chunk_citations(listed, ids, chunks), ",").alias("mapped"))


def p29_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    quote = F.when(F.col("doc_id") % 3 == 0, F.upper(F.substring(t, 5, 12))).when(F.col("doc_id") % 3 == 1, F.lit(" ")).otherwise(F.lit("zzzz qq"))
    return read(spark, sf_dir, "documents").select("doc_id", contains_quote(t, quote).alias("found"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    flags = E.structural_checks(F.col("status"), F.col("answer"), F.col("ids"), F.col("source_text"))
    n = F.col("n")
    said = F.element_at(F.array(*map(F.lit, ("supported", "unsupported", "contradicted", "uncertain", "nonsense"))), (n % 5 + 1).cast("int"))
    quotes = F.when(n % 3 == 0, F.array(F.substring("source_text", 1, 9))).otherwise(F.array(F.lit("no such quote ##")))
    return a.select("key", "n", "status", flags["hard_flags"].alias("hard"), E.verified_verdict(said, quotes, F.col("source_text")).alias("said"))


def c18_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules alone, with a verifier on the answer, and on the question."""
    v = _verdicts(spark, sf_dir)
    names = {"rules": (False, False), "answer": (True, False), "question": (True, True)}
    out = v.select("key", *[E.gate_verdict(F.col("status"), F.col("hard"), F.col("said"), *mode).alias(k) for k, mode in names.items()])
    return out.withColumn("blocks", E.would_block(F.col("answer")))


def a17_gate_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = c18_gate(spark, sf_dir)
    return g.groupBy("answer").agg(F.count("*").alias("rows"), F.sum(F.col("blocks").cast("long")).alias("blocked"))


def c19_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    n = F.col("n")
    first = E.gate_verdict(F.col("status"), F.col("hard"), F.col("said"), True)
    second = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "uncertain"))), (n % 3 + 1).cast("int"))
    return v.select("key", E.repair_status(F.col("status"), n % 13 != 0, first, n % 8 == 0, n % 9 == 0, second).alias("final_status"))


def c20_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    n = F.col("n")
    return v.select("key", E.replay_status(F.col("status"), n % 13 != 0, n % 8 == 0, n % 9 == 0, F.coalesce("said", F.lit("verifier_error"))).alias("final_status"))


def a16_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    answered = F.col("status") == "answered"
    parts = {"answer_rate": (answered, F.lit(True)), "clean_rate": (F.size("hard") == 0, answered), "supported_rate": (F.col("said") == "supported", answered & F.col("said").isNotNull())}
    return E.rates(v, parts)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the ranked hits of a question; every fifth is met twice, some are blank."""
    d = read(spark, sf_dir, "documents")
    one = d.select(F.col("source").alias("question"), F.col("doc_id").alias("chunk"), (F.col("doc_id") + 1).alias("rank"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")).alias("text"))
    return one.unionByName(one.where("chunk % 5 = 0").withColumn("rank", F.col("rank") + 1_000_000_000))


def w18_evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.select_evidence(_hits(spark, sf_dir)).select("question", "chunk", "evidence_id", "chars", "truncated", F.sha2("excerpt", 256).alias("excerpt_sha256"))


def w19_passage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.select_evidence(_hits(spark, sf_dir), budget=E.PASSAGE_BUDGET, least=E.PASSAGE_LEAST)
    return out.select("question", "chunk", "evidence_id", "chars")


def w21_first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_sources(_hits(spark, sf_dir), "question", "chunk", "rank").select("question", "chunk", "rank")


def w20_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, W20 over lines of documents as units; the question of a source is its first document's text."""
    d = read(spark, sf_dir, "documents")
    # The key of the first document, then its text: no text of the others moves.
    first = E.held(d.groupBy("source").agg(F.min("doc_id").alias("doc_id")))
    asked = d.join(first, ["source", "doc_id"]).select(F.col("source").alias("question"), F.col("text").alias("question_text")).dropDuplicates(["question"])
    lines = d.select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("lo", "quote"))
    u = lines.select(F.col("source").alias("question"), F.col("doc_id").alias("chunk"), (F.col("doc_id") % 4 + 1).alias("rank"), F.col("lo").cast("long").alias("lo"), (F.col("lo") + 1).cast("long").alias("hi"), "quote")
    out = E.rank_snippets(u, asked)
    return out.select("question", "evidence_id", "chunk", "lo", F.size("terms").cast("long").alias("n_terms"), "lexical_score")


def p23_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotable spans of every document; each is a slice of its text."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(spans_of(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.lo", "s.hi", "s.truncated", (F.substring("text", F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo")) == F.col("s.text")).alias("verbatim"))


QUERIES = {
    f.__name__: f
    for f in (p24_markers, p28_structural_checks, p25_parsed_generations, p26_used_citations, p27_chunk_citations, p29_quotes, c18_gate, a17_gate_tallies, c19_repair, c20_replay, a16_rates, w18_evidence_budget, w19_passage_budget, w21_first_sources, w20_snippets, p23_spans)
}

_ANSWERS = r"""
raw AS (SELECT conv_id || '-' || turn AS key, conv_id * 3 + turn AS n, role, text FROM conversations),
answers AS (
  SELECT key, n, CASE role WHEN 'assistant' THEN 'answered' WHEN 'system' THEN 'abstained' ELSE 'generation_error' END AS status,
         CASE WHEN n % 7 = 0 THEN 'Lorem ipsum.' ELSE coalesce(text, '') END || CASE WHEN n % 5 = 0 THEN '' ELSE ' [C' || (n % 3 + 1) || '] and [C' || (n % 2 + 1) || '] `fieldRef` useOf(' END AS answer,
         CASE WHEN n % 4 = 0 THEN ['C1'] ELSE ['C1', 'C' || (n % 3 + 1)] END AS ids, text || CASE WHEN n % 2 = 0 THEN ' fieldref' ELSE '' END AS source_text FROM raw),
marked AS (SELECT *, CASE WHEN n % 5 = 0 THEN [] WHEN n % 3 = n % 2 THEN ['C' || (n % 3 + 1)] ELSE ['C' || (n % 3 + 1), 'C' || (n % 2 + 1)] END AS marks FROM answers),
checked AS (
  SELECT *, CASE WHEN status <> 'answered' THEN [] ELSE list_filter([CASE WHEN n % 7 = 0 THEN 'placeholder_answer' END, CASE WHEN n % 5 = 0 THEN 'answer_without_cited_evidence' END,
    CASE WHEN list_sort(marks) <> list_sort(list_distinct(ids)) THEN 'citation_marker_source_mismatch' END], lambda x: x IS NOT NULL) END AS hard FROM marked),
verified AS (
  SELECT *, CASE n % 5 WHEN 0 THEN CASE WHEN n % 3 = 0 THEN 'supported' ELSE 'uncertain' END WHEN 1 THEN 'unsupported' WHEN 2 THEN CASE WHEN n % 3 = 0 THEN 'contradicted' ELSE 'uncertain' END WHEN 3 THEN 'uncertain' END AS said FROM checked),
gated AS (
  SELECT *, CASE WHEN status <> 'answered' THEN 'not_applicable' WHEN len(hard) > 0 THEN 'structural_failure' ELSE 'not_semantically_checked' END AS rules,
         CASE WHEN status <> 'answered' THEN 'not_applicable' WHEN len(hard) > 0 THEN 'structural_failure' ELSE coalesce(said, 'verifier_error') END AS answer_stage,
         CASE WHEN status <> 'answered' THEN 'not_applicable' ELSE coalesce(said, 'verifier_error') END AS question_stage FROM verified)"""
_HITS = """
one AS (SELECT source AS question, doc_id AS chunk, doc_id + 1 AS rank, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS text FROM documents),
hits AS (SELECT * FROM one WHERE trim(coalesce(text, '')) <> ''),
run AS (SELECT *, {budget} - coalesce(sum(least(length(text), 1500)) OVER (PARTITION BY question ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM hits),
kept AS (SELECT *, CAST(least(length(text), 1500, remaining) AS BIGINT) AS chars, 'C' || row_number() OVER (PARTITION BY question ORDER BY rank) AS evidence_id FROM run WHERE remaining >= {least})"""
_STOP = "', '".join(STOP_WORDS)
_TERMS = f"""list_distinct(list_filter(flatten(list_transform(regexp_extract_all(coalesce({{t}}, ''), '[A-Za-z][A-Za-z0-9_-]*|[0-9]+'),
  lambda x: string_split_regex(lower(translate(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), ' +'))), lambda x: length(x) >= 2 AND x NOT IN ('{_STOP}')))"""

SQL = {
    "p24_markers": f"WITH {_ANSWERS} SELECT key, array_to_string(marks, ',') AS markers FROM marked",
    "p28_structural_checks": f"WITH {_ANSWERS} SELECT key, array_to_string(hard, ',') AS hard, CASE WHEN status = 'answered' AND n % 5 <> 0 THEN array_to_string(list_filter([CASE WHEN n % 2 = 1 THEN 'unmatched_technical_identifier:fieldRef' END, 'unmatched_technical_identifier:useOf'], lambda x: x IS NOT NULL), ',') ELSE '' END AS review FROM checked",
    "p26_used_citations": f"WITH {_ANSWERS} SELECT key, CASE WHEN len(marks) = 0 THEN '-' ELSE array_to_string(marks, ',') END AS used FROM marked",
    "p27_chunk_citations": f"WITH {_ANSWERS} SELECT key, CASE n % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' ELSE 'k2' END || ',C9,kk' AS mapped FROM answers",
    "p25_parsed_generations": f"""WITH {_ANSWERS}, c AS (SELECT *, CASE WHEN n % 3 = 0 THEN ids ELSE ['C' || (n % 3 + 1), 'C' || (n % 2 + 1)] END AS cited FROM marked)
SELECT key, CASE WHEN n % 11 <> 0 THEN n % 6 = 0 END AS abstain,
       CASE WHEN n % 11 = 0 THEN 'malformed' WHEN n % 6 = 0 THEN CASE WHEN n % 12 = 0 OR trim(answer) = '' THEN 'ok' ELSE 'abstention_with_content' END WHEN trim(answer) = '' THEN 'empty_answer' WHEN len(marks) = 0 THEN 'no_citation' WHEN marks <> cited THEN 'markers_differ_from_citations'
            WHEN list_contains(marks, 'C3') THEN 'unknown_citation' ELSE 'ok' END AS error FROM c""",
    "p29_quotes": r"""WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN upper(substring(text, 5, 12)) WHEN 1 THEN ' ' ELSE 'zzzz qq' END AS quote FROM documents WHERE strlen(text) = length(text)),
f AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS q FROM d) SELECT doc_id, q <> '' AND contains(t, q) AS found FROM f""",
    "c18_gate": f"WITH {_ANSWERS} SELECT key, rules, answer_stage AS answer, question_stage AS question, answer_stage IN ('structural_failure', 'unsupported', 'contradicted') AS blocks FROM gated",
    "a17_gate_tallies": f"WITH {_ANSWERS} SELECT answer_stage AS answer, count(*) AS rows, count(*) FILTER (answer_stage IN ('structural_failure', 'unsupported', 'contradicted')) AS blocked FROM gated GROUP BY answer_stage",
    "c19_repair": f"""WITH {_ANSWERS} SELECT key, CASE WHEN status = 'abstained' THEN 'original_abstained' WHEN status <> 'answered' THEN 'original_generation_error' WHEN n % 13 = 0 THEN 'unverified_missing_evidence' WHEN answer_stage = 'supported' THEN 'accepted_original_provisional'
  WHEN answer_stage NOT IN ('structural_failure', 'unsupported', 'contradicted') THEN 'unverified_original' WHEN n % 8 = 0 THEN 'repair_generation_error' WHEN n % 9 = 0 THEN 'repaired_abstained' WHEN n % 3 = 0 THEN 'accepted_repaired_provisional' WHEN n % 3 = 1 THEN 'blocked_after_repair' ELSE 'unverified_after_repair' END AS final_status FROM gated""",
    "c20_replay": f"""WITH {_ANSWERS} SELECT key, CASE WHEN status = 'abstained' THEN 'original_abstained' WHEN status <> 'answered' THEN 'original_generation_error' WHEN n % 13 = 0 THEN 'unverified_missing_evidence' WHEN n % 8 = 0 THEN 'regeneration_error' WHEN n % 9 = 0 THEN 'regenerated_abstained'
  WHEN said = 'supported' THEN 'accepted_regenerated_provisional' WHEN said IN ('unsupported', 'contradicted') THEN 'blocked_after_regeneration' ELSE 'unverified_regenerated' END AS final_status FROM gated""",
    "a16_rates": f"WITH {_ANSWERS} SELECT count(*) AS rows, round(count(*) FILTER (status = 'answered') / count(*), 6) AS answer_rate, round(count(*) FILTER (status = 'answered' AND len(hard) = 0) / count(*) FILTER (status = 'answered'), 6) AS clean_rate, round(count(*) FILTER (status = 'answered' AND said = 'supported') / count(*) FILTER (status = 'answered' AND said IS NOT NULL), 6) AS supported_rate FROM gated",
    "w18_evidence_budget": f"WITH {_HITS.format(budget=10500, least=100)} SELECT question, chunk, evidence_id, chars, length(text) > chars AS truncated, sha256(substring(text, 1, chars) || CASE WHEN length(text) > chars THEN ' [TRUNCATED EXCERPT]' ELSE '' END) AS excerpt_sha256 FROM kept",
    "w19_passage_budget": f"WITH {_HITS.format(budget=4800, least=80)} SELECT question, chunk, evidence_id, chars FROM kept",
    "w21_first_sources": "SELECT source AS question, doc_id AS chunk, doc_id + 1 AS rank FROM documents",
    "w20_snippets": f"""WITH asked AS (SELECT source, arg_min(text, doc_id) AS question_text FROM documents GROUP BY source),
qt AS (SELECT source, {_TERMS.format(t='question_text')} AS terms FROM asked),
lines AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS quote, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS lo FROM documents),
units AS (SELECT l.*, doc_id % 4 + 1 AS rank, list_intersect(qt.terms, {_TERMS.format(t='quote')}) AS terms, count(*) OVER (PARTITION BY l.source) AS n FROM lines l JOIN qt USING (source)),
w AS (SELECT source, doc_id, lo, sum(1 + ln((n + 1) / (f + 1))) AS w FROM (SELECT *, count(*) OVER (PARTITION BY source, term) AS f FROM (SELECT source, doc_id, lo, n, unnest(terms) AS term FROM units)) GROUP BY ALL),
scored AS (SELECT u.*, round(coalesce(w, 0) + 0.22::DOUBLE / rank - CASE WHEN regexp_matches(quote, '^\\s*(?:```|\\| |\\[|#### Note:)') THEN 0.3::DOUBLE ELSE 0 END, 5) AS s FROM units u LEFT JOIN w USING (source, doc_id, lo)),
a AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY s DESC, rank, lo) AS c FROM scored QUALIFY c <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, rank, lo, doc_id) AS p FROM a QUALIFY p <= 6)
SELECT source AS question, 'E' || p AS evidence_id, doc_id AS chunk, lo, len(terms) AS n_terms, s AS lexical_score FROM b""",
}
