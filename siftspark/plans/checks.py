"""Selections, table checks, the chunk audit and reports over the test tables. Faults are planted by changing values; no row is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import ChunkSettings
from ..functions.text import tokens
from ..functions.vectors import norm
from ..operators import checks as K
from ..operators import corpus as C
from .evidence import _ANSWERS, _answers
from .tables import SQL_QUESTIONS, SQL_TOKENS, chunks, read, vector_questions, vectors


def f04_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.in_split(vector_questions(spark, sf_dir), "dev").select("question", "split")


def f05_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 lines of three suppliers, in order."""
    return K.select_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 100, l_suppkey=[1, 2, 3], l_returnflag=[]).select("l_orderkey", "l_linenumber", "l_suppkey")


def f07_field_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    told = F.when(F.col("doc_id") % 13 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    rows = d.withColumn("text_sha256", told).withColumn("lang", F.when(F.col("doc_id") % 17 == 0, "xx").otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 19 == 0, -1).otherwise(F.col("n_chars")))
    key = F.when(F.col("doc_id") % 23 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return K.field_faults(rows, key, ("text", "lang"), ("text",), {"lang": ("en", "de", "es", "fr")}, {"text_sha256": F.sha2("text", 256), "n_chars": F.length("text").cast("long")})


def f15_dev_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dev_only_faults(vector_questions(spark, sf_dir))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors numbered by (label, id): counts per label first, so the order is total without a global sort."""
    v = vectors(spark, sf_dir)
    before = v.groupBy("label").agg(F.count("*").alias("c")).select("label", (F.sum("c").over(Window.orderBy("label")) - F.col("c")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return v.join(F.broadcast(before), "label").select("vec_id", "label", "embedding", (F.col("before") + inner).alias("row_index"))  # a row a label


def f14_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with vectors that are too long, too short, and a number too far on."""
    i = _indexed(spark, sf_dir)
    v = F.when(F.col("vec_id") % 41 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 43 == 0, F.transform("embedding", lambda x: (x * 2).cast("float"))).otherwise(F.col("embedding"))
    odd = i.select(F.when(F.col("vec_id") == 3, F.lit(10_000_000)).otherwise(F.col("row_index")).alias("row_index"), v.alias("vector"))
    return K.dense_index_faults(odd, 7, 64)


def j19_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _indexed(spark, sf_dir)
    found = K.attach_vectors(i.select("row_index", "vec_id"), i.select("row_index", F.col("embedding").alias("vector")))
    return found.select("row_index", "vec_id", F.size("vector").cast("long").alias("width"), F.round(norm(F.col("vector")), 5).alias("norm"))


def f11_prepared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preparation that swaps neighbours, changes texts and renames keys."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    before = d.select("doc_id", k.alias("place"), F.sha2("text", 256).alias("sha"))
    moved = F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).otherwise(k)
    after = d.select(F.when(k % 29 == 0, -k - 1).otherwise(k).alias("doc_id"), moved.alias("place"), F.sha2(F.when(k % 31 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return K.prepared_differences(before, after, "doc_id", "place", "sha")


def p38_judgment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "conversations"), F.col("conv_id") * 3 + F.col("turn")
    one = lambda i, g: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("chunk_id"), g.cast("int").alias("grade"))
    m = K.judgment_map(F.array(one(n % 3, n % 4), one(n % 2, F.lit(2)), one(n % 5, F.lit(3))))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), shown.alias("judgments"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as chunks of orders as sections of customers as documents, with faults of every kind."""
    c, o, li = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    doc, sec, p = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_partkey")
    url = lambda k: F.concat(F.lit("https://docs.example/"), k.cast("string"))
    manifest = c.select(F.when(doc % 97 == 0, -doc - 1).otherwise(doc).alias("document_id"), F.col("c_mktsegment").alias("domain"), url(doc).alias("url"), F.sha2("c_name", 256).alias("document_hash"))
    sections = o.select(F.when(sec % 53 == 0, -sec - 1).otherwise(sec).alias("section_id"), F.col("o_custkey").alias("document_id"), F.array("o_orderpriority").alias("heading_path"), F.sha2(sec.cast("string"), 256).alias("section_hash"))
    wrong = lambda by, bad, good: F.when(p % by == 0, bad).otherwise(good)
    rows = li.join(o, F.col("l_orderkey") == sec).join(c, F.col("o_custkey") == doc)
    told = rows.select(
        wrong(31, F.concat(F.lit("odd"), F.col("l_orderkey").cast("string"), F.lit("x"), F.col("l_linenumber").cast("string")), F.concat_ws("-ch-", "l_orderkey", "l_linenumber")).alias("chunk_id"),
        wrong(37, F.col("l_linenumber") + 1, F.col("l_linenumber")).alias("chunk_index"), F.col("l_orderkey").alias("section_id"), wrong(41, F.col("o_custkey") + 1, F.col("o_custkey")).alias("document_id"),
        wrong(43, F.lit("NONE"), F.col("c_mktsegment")).alias("domain"), wrong(47, F.lit("http://x"), url(doc)).alias("url"), F.array(wrong(59, F.lit("other"), F.col("o_orderpriority"))).alias("heading_path"),
        wrong(61, F.lit("0"), F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("section_hash"), wrong(67, F.lit("0"), F.sha2("c_name", 256)).alias("document_hash"),
    )
    return K.audit_chunks(told, sections, manifest, r"\A[0-9]+-ch-([0-9]+)\z")


def j06_chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("rule", "key")


def c08_chunk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.audit_verdict(_audited(spark, sf_dir), ("section_without_chunks", "document_without_sections", "document_without_chunks"))


def a24_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "failed").when(F.col("chunk_id") % 3 == 0, "new").otherwise("unchanged")
    return K.stage_report(c, status, chars=F.length("text").cast("long"), words=F.size(tokens(F.col("text"))).cast("long"))


def c26_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text alone, with its path before it, and with a query prefix as well."""
    n = chunks(spark, sf_dir).select(F.size(tokens(F.col("text"))).alias("n"))
    variants = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col("n") + k).cast("long").alias("n")) for v, k in (("text", 0), ("with_path", 12), ("with_prefix", 20))]))
    return K.length_audit(n.select(variants), 512)


def c11_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of the labelled documents, chosen on dev and applied to test."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    k, n = F.col("doc_id"), F.col("n_chars")
    scores = {"length": F.floor(n / 50), "mixed": (k * 37 + n) % 101, "residue": n % 83}
    rows = d.select(F.when(k % 5 < 3, "dev").otherwise("test").alias("split"), (F.col("quality") == 1).alias("positive"), F.inline(F.array(*[F.struct(F.lit(s).alias("system"), v.cast("double").alias("score")) for s, v in scores.items()])))
    return K.system_thresholds(rows)


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = _answers(spark, sf_dir), F.col("n")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (n % by % len(names) + 1).cast("int"))
    judged = lambda names, by: F.when(n % 19 == 0, "odd").when((F.col("status") == "answered") | (n % 23 == 0), pick(names, by)).otherwise("not_applicable")
    return a.select("key", "status", (n % 10 != 0).alias("answerable"), judged(K.CORRECTNESS, 7).alias("correctness"), judged(K.CITATION, 11).alias("citation"))


def c22_factuality_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.factuality_faults(_reviewed(spark, sf_dir))


def c22_factuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.factuality_scores(_reviewed(spark, sf_dir))


def p30_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    evidence = F.array(F.struct(F.lit("C1").alias("id"), F.coalesce("source_text", F.lit("")).alias("text")), F.struct(F.lit("C2").alias("id"), F.lit(" ").alias("text")))
    made = K.prompts(F.concat(F.lit("about "), F.col("key")), F.col("answer"), evidence, F.array(F.lit("uncited")))
    return a.select("key", *[F.sha2(v, 256).alias(f"{k}_sha256") for k, v in made.items()])


def f10_planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 over lines of orders as spans: every line has its number as index and three tokens, with faults by part."""
    li = read(spark, sf_dir, "lineitem")
    # Lines of an order are numbered anew, as not every table has them without gaps.
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    i = F.row_number().over(w) - 1
    n, p = li.select("l_orderkey", "l_partkey", i.alias("i")), F.col("l_partkey")
    spans = n.select(
        F.col("l_orderkey").alias("key"), F.when(p % 31 == 0, F.col("i") + 100).otherwise(F.col("i")).alias("chunk_index"),
        (F.col("i") * 3 + F.when(p % 37 == 0, 1).otherwise(0)).alias("token_start"), (F.col("i") * 3 + F.when(p % 41 == 0, 9).when(p % 43 == 0, -1).otherwise(4)).alias("token_end"),
    )
    return C.chunk_violations(spans, "key", ChunkSettings(4, 1))


def u01_all_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all documents with some languages changed."""
    d = read(spark, sf_dir, "documents")
    return C.row_differences(d.select("doc_id", "lang"), d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang")))


def u04_all_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union of all documents and all labels: the first list's row wins."""
    ids = [read(spark, sf_dir, t).select("doc_id", F.lit(k).alias("list")) for k, t in ((1, "labels"), (2, "documents"))]
    return ids[0].unionByName(ids[1]).groupBy("doc_id").agg(F.min("list").alias("list"))


def k05_all_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into a store of all documents, some under other keys, some with other text."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    old = d.select(F.when(k % 4 == 0, -k - 1).otherwise(k).alias("doc_id"), F.sha2("text", 256).alias("sha"))
    new = d.select("doc_id", F.sha2(F.when(k % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return C.upsert(old, new, "doc_id", "sha")


QUERIES = {
    f.__name__: f
    for f in (
        f04_split, f05_selection, f07_field_faults, f15_dev_guard, f14_dense_index, j19_matrix_rows, f11_prepared_order, p38_judgment_map, j06_chunk_audit, c08_chunk_verdict, a24_stage_counts, c26_truncation, c11_systems,
        c22_factuality_faults, c22_factuality, p30_prompts, f10_planted_faults, u01_all_differences, u04_all_distinct, k05_all_upserts,
    )
}

_INDEXED = "indexed AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY label, vec_id) - 1 AS row_index FROM embeddings)"
_AUDIT = r"""
manifest AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS document_id, c_mktsegment AS domain, 'https://docs.example/' || c_custkey AS url, sha256(c_name) AS document_hash FROM customer),
sections AS (SELECT CASE WHEN o_orderkey % 53 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS section_id, o_custkey AS document_id, o_orderpriority AS heading, sha256(CAST(o_orderkey AS VARCHAR)) AS section_hash FROM orders),
ch AS (
  SELECT CASE WHEN l_partkey % 31 = 0 THEN 'odd' || l_orderkey || 'x' || l_linenumber ELSE l_orderkey || '-ch-' || l_linenumber END AS chunk_id, l_partkey % 31 <> 0 AS shape, l_partkey % 37 = 0 AS off, l_orderkey AS section_id,
         CASE WHEN l_partkey % 41 = 0 THEN o_custkey + 1 ELSE o_custkey END AS document_id, CASE WHEN l_partkey % 43 = 0 THEN 'NONE' ELSE c_mktsegment END AS domain, CASE WHEN l_partkey % 47 = 0 THEN 'http://x' ELSE 'https://docs.example/' || c_custkey END AS url,
         CASE WHEN l_partkey % 59 = 0 THEN 'other' ELSE o_orderpriority END AS heading, CASE WHEN l_partkey % 61 = 0 THEN '0' ELSE sha256(CAST(l_orderkey AS VARCHAR)) END AS section_hash, CASE WHEN l_partkey % 67 = 0 THEN '0' ELSE sha256(c_name) END AS document_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
j AS (SELECT ch.*, s.section_id AS sid, s.document_id AS sd, s.heading AS sh, s.section_hash AS ss, m.document_id AS mid, m.domain AS md, m.url AS mu, m.document_hash AS mh
      FROM ch LEFT JOIN sections s ON ch.section_id = s.section_id LEFT JOIN manifest m ON ch.document_id = m.document_id),
found AS (
  SELECT 'chunk_id_shape' AS rule, chunk_id AS key FROM ch WHERE NOT shape UNION ALL SELECT 'chunk_index_mismatch', chunk_id FROM ch WHERE shape AND off
  UNION ALL SELECT 'orphan_chunk', chunk_id FROM j WHERE sid IS NULL UNION ALL SELECT 'unknown_document', chunk_id FROM j WHERE mid IS NULL
  UNION ALL SELECT 'document_mismatch', chunk_id FROM j WHERE sid IS NOT NULL AND document_id <> sd UNION ALL SELECT 'heading_path_mismatch', chunk_id FROM j WHERE sid IS NOT NULL AND heading <> sh
  UNION ALL SELECT 'section_hash_mismatch', chunk_id FROM j WHERE sid IS NOT NULL AND section_hash <> ss UNION ALL SELECT 'domain_mismatch', chunk_id FROM j WHERE mid IS NOT NULL AND domain <> md
  UNION ALL SELECT 'url_mismatch', chunk_id FROM j WHERE mid IS NOT NULL AND url <> mu UNION ALL SELECT 'document_hash_mismatch', chunk_id FROM j WHERE mid IS NOT NULL AND document_hash <> mh
  UNION ALL SELECT 'section_without_chunks', CAST(section_id AS VARCHAR) FROM sections ANTI JOIN ch USING (section_id) UNION ALL SELECT 'document_without_sections', CAST(document_id AS VARCHAR) FROM manifest ANTI JOIN sections USING (document_id)
  UNION ALL SELECT 'document_without_chunks', CAST(document_id AS VARCHAR) FROM manifest ANTI JOIN ch USING (document_id))"""
_SYSTEMS = """
joined AS (SELECT doc_id, n_chars, quality = 1 AS positive, CASE WHEN doc_id % 5 < 3 THEN 'dev' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)),
scores AS (
  SELECT 'length' AS system, split, positive, CAST(n_chars // 50 AS DOUBLE) AS score FROM joined UNION ALL SELECT 'mixed', split, positive, CAST((doc_id * 37 + n_chars) % 101 AS DOUBLE) FROM joined
  UNION ALL SELECT 'residue', split, positive, CAST(n_chars % 83 AS DOUBLE) FROM joined),
d AS (SELECT DISTINCT system, score FROM scores WHERE split = 'dev'),
cuts AS (
  SELECT system, (score + nxt) / 2 AS threshold FROM (SELECT system, score, lead(score) OVER (PARTITION BY system ORDER BY score) AS nxt FROM d) WHERE nxt IS NOT NULL
  UNION ALL SELECT system, min(score) - 1e-12::DOUBLE FROM d GROUP BY system UNION ALL SELECT system, max(score) + 1e-12::DOUBLE FROM d GROUP BY system),
counted AS (
  SELECT c.system, c.threshold, s.split, count(*) FILTER (positive AND score >= threshold) AS tp, count(*) FILTER (positive AND score < threshold) AS fn, count(*) FILTER (NOT positive AND score < threshold) AS tn, count(*) FILTER (NOT positive AND score >= threshold) AS fp
  FROM cuts c JOIN scores s USING (system) GROUP BY ALL),
rated AS (SELECT system, threshold, split, round(coalesce(tp / (tp + fn), 0), 6) AS recall, round(coalesce(tn / (tn + fp), 0), 6) AS rejection, round((coalesce(tp / (tp + fn), 0) + coalesce(tn / (tn + fp), 0)) / 2, 6) AS balanced_accuracy FROM counted),
best AS (SELECT * FROM rated WHERE split = 'dev' QUALIFY row_number() OVER (PARTITION BY system ORDER BY balanced_accuracy DESC, rejection DESC, recall DESC, threshold DESC) = 1),
areas AS (SELECT p.system, p.split, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM scores p JOIN scores n ON p.system = n.system AND p.split = n.split WHERE p.positive AND NOT n.positive GROUP BY ALL)"""
_LABELS = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_REVIEWED = f"""{_ANSWERS},
reviewed AS (SELECT key, status, n % 10 <> 0 AS answerable,
  CASE WHEN n % 19 = 0 THEN 'odd' WHEN status = 'answered' OR n % 23 = 0 THEN {_LABELS(K.CORRECTNESS)}[n % 7 % 5 + 1] ELSE 'not_applicable' END AS correctness,
  CASE WHEN n % 19 = 0 THEN 'odd' WHEN status = 'answered' OR n % 23 = 0 THEN {_LABELS(K.CITATION)}[n % 11 % 5 + 1] ELSE 'not_applicable' END AS citation FROM answers)"""
_SPANS = """
n AS (SELECT l_orderkey AS key, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem),
spans AS (SELECT key, CASE WHEN p % 31 = 0 THEN i + 100 ELSE i END AS ci, i * 3 + CASE WHEN p % 37 = 0 THEN 1 ELSE 0 END AS a, i * 3 + CASE WHEN p % 41 = 0 THEN 9 WHEN p % 43 = 0 THEN -1 ELSE 4 END AS b FROM n),
w AS (SELECT *, lag(b) OVER v AS prev, row_number() OVER v - 1 AS k FROM spans WINDOW v AS (PARTITION BY key ORDER BY ci))"""

SQL = {
    "f04_split": f"WITH {SQL_QUESTIONS} SELECT question, split FROM questions WHERE split = 'dev'",
    "f05_selection": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 2, 3) ORDER BY l_orderkey, l_linenumber LIMIT 100",
    "f07_field_faults": """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 23 = 1 THEN doc_id - 1 ELSE doc_id END AS key, text, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 19 = 0 THEN -1 ELSE n_chars END AS n,
                  CASE WHEN doc_id % 13 = 0 THEN '0' ELSE sha256(text) END AS h FROM documents)
SELECT 'missing_text' AS rule, CAST(key AS VARCHAR) AS key, '' AS detail FROM r WHERE text IS NULL UNION ALL SELECT 'missing_lang', CAST(key AS VARCHAR), '' FROM r WHERE lang IS NULL
UNION ALL SELECT 'blank_text', CAST(key AS VARCHAR), '' FROM r WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'unknown_lang', CAST(key AS VARCHAR), '' FROM r WHERE lang NOT IN ('en', 'de', 'es', 'fr')
UNION ALL SELECT 'text_sha256_differs', CAST(key AS VARCHAR), '' FROM r WHERE h IS DISTINCT FROM sha256(text) UNION ALL SELECT 'n_chars_differs', CAST(key AS VARCHAR), '' FROM r WHERE n IS DISTINCT FROM length(text)
UNION ALL SELECT 'repeated_key', CAST(key AS VARCHAR), CAST(count(*) AS VARCHAR) FROM r GROUP BY key HAVING count(*) > 1""",
    "f15_dev_guard": f"""WITH {SQL_QUESTIONS}
SELECT 'not_dev' AS rule, CAST(question AS VARCHAR) AS key, split AS detail FROM questions WHERE split <> 'dev' UNION ALL SELECT 'row_count', 'all', CAST(count(*) AS VARCHAR) FROM questions HAVING count(*) <> 60
UNION ALL SELECT 'answerable_count', 'all', CAST(count(*) FILTER (answerable) AS VARCHAR) FROM questions HAVING count(*) FILTER (answerable) <> 54""",
    "f14_dense_index": f"""WITH {_INDEXED},
i AS (SELECT CASE WHEN vec_id = 3 THEN 10000000 ELSE row_index END AS row_index, vec_id FROM indexed)
SELECT 'row_count' AS rule, 'index' AS key, CAST(count(*) AS VARCHAR) AS detail FROM i UNION ALL SELECT 'row_index_gap', 'index', '10000000'
UNION ALL SELECT 'vector_width', CAST(row_index AS VARCHAR), '63' FROM i WHERE vec_id % 41 = 0 UNION ALL SELECT 'not_a_unit_vector', CAST(row_index AS VARCHAR), '' FROM i WHERE vec_id % 41 <> 0 AND vec_id % 43 = 0""",
    "j19_matrix_rows": f"WITH {_INDEXED} SELECT row_index, vec_id, len(embedding) AS width, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM indexed",
    "f11_prepared_order": """
SELECT 'lost' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 29 = 0 UNION ALL SELECT 'added', CAST(-doc_id - 1 AS VARCHAR) FROM documents WHERE doc_id % 29 = 0
UNION ALL SELECT 'moved', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 10 IN (3, 4) UNION ALL SELECT 'changed', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 31 = 0 AND text IS NOT NULL""",
    "p38_judgment_map": """
WITH r AS (SELECT conv_id || '-' || turn AS key, conv_id * 3 + turn AS n FROM conversations),
e AS (SELECT key, n, unnest([{'i': 1, 'k': 'k' || (n % 3), 'g': n % 4}, {'i': 2, 'k': 'k' || (n % 2), 'g': 2}, {'i': 3, 'k': 'k' || (n % 5), 'g': 3}]) AS j FROM r),
l AS (SELECT key, j.k AS k, arg_max(j.g, j.i) AS g FROM e GROUP BY ALL) SELECT key, string_agg(k || ':' || g, ',' ORDER BY k) AS judgments FROM l GROUP BY key""",
    "j06_chunk_audit": f"WITH {_AUDIT} SELECT rule, key FROM found",
    "c08_chunk_verdict": f"WITH {_AUDIT}, c AS (SELECT count(*) FILTER (rule NOT LIKE '%without%') AS errors, count(*) FILTER (rule LIKE '%without%') AS warnings FROM found) SELECT errors, warnings, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM c",
    "a24_stage_counts": f"""WITH {SQL_TOKENS}, r AS (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'failed' WHEN doc_id % 3 = 0 THEN 'new' ELSE 'unchanged' END AS status, length(text) AS chars, len(t) AS words FROM documents JOIN toks ON chunk = doc_id)
SELECT coalesce(status, 'all') AS status, count(*) AS rows, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words FROM r GROUP BY GROUPING SETS ((status), ())""",
    "c26_truncation": f"""WITH {SQL_TOKENS}, l AS (SELECT v.variant, len(t) + v.k AS n FROM toks, (VALUES ('text', 0), ('with_path', 12), ('with_prefix', 20)) v(variant, k))
SELECT variant, count(*) AS rows, count(*) FILTER (n > 512) AS truncated, CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS lost, max(n) AS longest, round(quantile_cont(n, 0.5), 3) AS median, round(quantile_cont(n, 0.9), 3) AS p90, round(quantile_cont(n, 0.95), 3) AS p95 FROM l GROUP BY variant""",
    "c11_systems": f"""WITH {_SYSTEMS} SELECT b.system, b.threshold, b.balanced_accuracy AS dev_balanced_accuracy, da.auroc AS dev_auroc, ta.auroc AS test_auroc, t.recall, t.rejection, t.balanced_accuracy
FROM best b JOIN rated t ON t.system = b.system AND t.threshold = b.threshold AND t.split = 'test' JOIN areas da ON da.system = b.system AND da.split = 'dev' JOIN areas ta ON ta.system = b.system AND ta.split = 'test'""",
    "c22_factuality_faults": f"""WITH {_REVIEWED} SELECT 'unknown_correctness' AS rule, key FROM reviewed WHERE correctness = 'odd' UNION ALL SELECT 'unknown_citation', key FROM reviewed WHERE citation = 'odd'
UNION ALL SELECT 'answer_not_judged', key FROM reviewed WHERE status = 'answered' AND 'not_applicable' IN (correctness, citation) UNION ALL SELECT 'judged_without_answer', key FROM reviewed WHERE status <> 'answered' AND (correctness <> 'not_applicable' OR citation <> 'not_applicable')""",
    "c22_factuality": f"""WITH {_REVIEWED}, c AS (SELECT count(*) AS rows, count(*) FILTER (correctness IN ('correct_complete', 'correct_incomplete', 'incorrect')) AS assessed, count(*) FILTER (correctness = 'correct_complete') AS correct_complete,
  count(*) FILTER (correctness = 'correct_incomplete') AS correct_incomplete, count(*) FILTER (correctness = 'incorrect') AS incorrect, count(*) FILTER (citation = 'fully_supported') AS citation_fully_supported, count(*) FILTER (citation = 'partially_supported') AS citation_partially_supported,
  count(*) FILTER (citation = 'unsupported') AS citation_unsupported, count(*) FILTER (status = 'answered' AND NOT answerable) AS negative_false_answers FROM reviewed)
SELECT *, round(correct_complete / assessed, 6) AS accuracy_complete_only, round((correct_complete + correct_incomplete) / assessed, 6) AS accuracy_allow_incomplete FROM c""",
    "p30_prompts": f"""WITH {_ANSWERS}, e AS (SELECT key, 'about ' || key AS q, answer AS a, json_array(json_object('id', 'C1', 'text', coalesce(source_text, '')), json_object('id', 'C2', 'text', ' ')) AS pair,
  CASE WHEN trim(coalesce(source_text, '')) = '' THEN json('[]') ELSE json_array(json_object('id', 'C1', 'text', source_text)) END AS one FROM answers)
SELECT key, sha256(CAST(json_object('question', q, 'evidence', pair) AS VARCHAR)) AS ask_sha256, sha256(CAST(json_object('question', q, 'answer', a, 'evidence', pair) AS VARCHAR)) AS verify_sha256,
       sha256(CAST(json_object('question', q, 'answer', a, 'findings', json_array('uncited'), 'evidence', pair) AS VARCHAR)) AS repair_sha256, sha256(CAST(json_object('question', q, 'evidence', one) AS VARCHAR)) AS replay_sha256 FROM e""",
    "f10_planted_faults": f"""WITH {_SPANS}
SELECT 'chunk_index_gap' AS rule, CAST(key AS VARCHAR) AS key, CAST(ci AS VARCHAR) AS detail FROM w WHERE ci <> k UNION ALL SELECT 'overlap_mismatch', CAST(key AS VARCHAR), CAST(ci AS VARCHAR) FROM w WHERE prev - a <> 1
UNION ALL SELECT 'first_chunk_start', CAST(key AS VARCHAR), CAST(a AS VARCHAR) FROM w WHERE prev IS NULL AND a <> 0 UNION ALL SELECT 'oversized_chunk', CAST(key AS VARCHAR), CAST(ci AS VARCHAR) FROM w WHERE b - a > 4
UNION ALL SELECT 'empty_chunk', CAST(key AS VARCHAR), CAST(ci AS VARCHAR) FROM w WHERE b <= a""",
    "u01_all_differences": "SELECT doc_id, lang, 'left' AS side FROM documents WHERE doc_id % 7 = 0 AND lang IS DISTINCT FROM 'xx' UNION ALL SELECT doc_id, 'xx', 'right' FROM documents WHERE doc_id % 7 = 0 AND lang IS DISTINCT FROM 'xx'",
    "u04_all_distinct": "SELECT doc_id, min(list) AS list FROM (SELECT doc_id, 1 AS list FROM labels UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY doc_id",
    "k05_all_upserts": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'conflict' ELSE 'unchanged' END AS status FROM documents UNION ALL SELECT -doc_id - 1, 'kept' FROM documents WHERE doc_id % 4 = 0",
}
