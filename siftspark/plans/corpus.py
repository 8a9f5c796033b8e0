"""Corpus preparation, sections, chunks and their audits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import ChunkSettings
from ..functions.html_blocks import blocks_of
from ..operators import corpus as C
from .tables import SQL_TOKENS, chunks, read

AUDIT = ChunkSettings(256, 32)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line starts of documents as Markdown headings now and then, so that every rule meets both cases."""
    c = chunks(spark, sf_dir)
    short = F.concat(F.lit("# "), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    text = F.when(F.col("chunk_id") % 11 == 0, short).otherwise(F.col("text"))
    c = c.withColumns({"text": text, "heading_path": F.array(F.concat(F.lit("  "), F.col("domain")), F.lit(" "), F.concat(F.col("document_id"), F.lit("  x ")))})
    return C.prepare_chunks(c.withColumn("token_count", F.size(T.tokens(F.col("text")))))


def p07_prepared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, indexable, retrieval text."""
    return _prepared(spark, sf_dir).select("chunk_id", F.col("token_count").cast("long").alias("token_count"), F.array_join("quality_flags", "+").alias("flags"), "indexable", "retrieval_text_sha256")


def f01_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).where("indexable").select("chunk_id")


def a06_excluded_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir).withColumn("reason", F.array_join(F.array_sort("quality_flags"), "+"))
    return p.groupBy("reason").agg(F.count("*").alias("rows"), F.sum((~F.col("indexable")).cast("long")).alias("excluded"))


def p11_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", T.preview(F.col("text"), 80).alias("preview"))


def p12_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made and parsed; ids that are too long don't parse."""
    i = chunks(spark, sf_dir).select("chunk_id", T.chunk_id(T.section_id(F.format_string("doc-%03d", F.pmod("chunk_id", F.lit(1000))), F.pmod("chunk_id", F.lit(7))), F.col("chunk_id")).alias("id"))
    p = i.withColumn("p", T.parse_chunk_id(F.col("id")))
    return p.select("chunk_id", "id", F.col("p.document_id").alias("document_id"), F.col("p.section_id").alias("section_id"), F.col("p.chunk_number").alias("chunk_number"))


def p08_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", T.sha256_text(F.col("text")).alias("sha256"))


def p10_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", T.word_count(F.col("text")).cast("long").alias("words"))


def p09_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tidy(T.nfc(F.concat(F.col("text"), F.lit("\r\nx  \n\n\n\ny"))))
    return chunks(spark, sf_dir).select("chunk_id", F.sha2(t, 256).alias("tidy_sha256"))


def p18_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels")
    return d.select("doc_id", T.canonical_json(toxic=F.col("toxic"), doc_id=F.col("doc_id"), note=F.lit(None).cast("string"), quality=F.col("quality")).alias("json"))


def k06_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events")
    signed = F.concat(F.element_at(F.array(F.lit("="), F.lit(" +"), F.lit("-"), F.lit("@"), F.lit("x")), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_type"))
    return d.select("event_id", T.csv_safe(signed).alias("cell"))


def p37_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.size_text(F.col("n_chars") * 40).alias("size"))


def a05_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_groups(read(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id"))


def a05_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_members(read(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id"))


def a06_count_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_by(chunks(spark, sf_dir), "domain", "document_id")


def a08_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("domain").alias("domains"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


def a14_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(chunks(spark, sf_dir), F.size(T.tokens(F.col("text"))))


def a15_chunks_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines an order has, as chunks a section has, with orders that have none."""
    per = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("sections"))


def a22_unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("document_id")), ",").alias("documents"))


def w29_smallest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))
    return c.orderBy("tokens", "chunk_id").limit(50)


def u02_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def u03_shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' shared evidence tokens with a fixed question."""
    asked = T.evidence_tokens(F.lit("How should the edition of this be handled in MyOtherThing?"))
    return chunks(spark, sf_dir).select("chunk_id", F.array_join(F.array_sort(F.array_intersect(T.evidence_tokens(F.col("text")), asked)), " ").alias("shared"))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a user as blocks of a document: three kinds are headings of levels 1 to 6."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "signup", "click"), "heading").otherwise("paragraph")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("block_index"), kind.alias("type"), (F.col("event_id") * 7 % 6 + 1).cast("int").alias("level"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("language"))


def j09_heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.heading_tree(_headings(spark, sf_dir))
    return t.select("document_id", "section_order", "block_start", "block_end", "level", "parent_order", F.size("heading_path").cast("long").alias("depth"))


def j20_section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.section_text(_headings(spark, sf_dir)).select("document_id", "section_order", F.sha2("text", 256).alias("text_sha256"))


def w13_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_repeats(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def w14_trim_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return C.trim_tail(e, "user_id", "event_id", (F.col("event_type") == "error") & (F.col("value") > 20)).select("user_id", "event_id")


def _intervals(spark: SparkSession, sf_dir: str, kind: str, minutes: int) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", F.col("event_id").alias("id"), s.alias("lo"), (s + 60 * minutes).alias("hi"))


def j07_interval_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two kinds of events of a user that overlap by half of the shorter."""
    out = C.project_intervals(_intervals(spark, sf_dir, "purchase", 600), _intervals(spark, sf_dir, "view", 900), "user_id")
    return out.select("user_id", "source_id", "target_id", "overlap", F.round("share", 6).alias("share"))


def a20_best_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where several spans land on one target the greatest grade stays."""
    p = C.project_intervals(_intervals(spark, sf_dir, "purchase", 600), _intervals(spark, sf_dir, "view", 900), "user_id")
    return p.groupBy("target_id").agg(F.max(F.col("source_id") % 4).alias("grade"), F.count("*").alias("sources"))


def j06_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations over a parent-child-grandchild chain: orphans, mismatches, parents without children."""
    li, o, c = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    few = o.where("o_orderkey % 50 <> 0").select("o_orderkey", "o_orderdate")
    lines, known = C.dealt(li, (li.select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey"), (few, "o_orderkey"))
    # Both rules of a line in one row after one join.
    lines = lines.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rule = F.when(F.col("o_orderkey").isNull(), "orphan_line").when(F.col("l_shipdate") < F.col("o_orderdate"), "shipped_before_order")
    told = lines.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    orders, met = C.dealt(li, (o.select("o_orderkey"), "o_orderkey"), (li.select("l_orderkey"), "l_orderkey"))
    customers, buyers = C.dealt(o, (c.select("c_custkey"), "c_custkey"), (o.select("o_custkey"), "o_custkey"))
    rows = C.all_violations(
        told.withColumn("detail", F.lit("")),
        C.violation(orders.join(met, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "order_without_lines", F.col("o_orderkey"), F.lit(True)),
        C.violation(customers.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "customer_without_orders", F.col("c_custkey"), F.lit(True)),
    )
    return rows.select("rule", "key")


def c08_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by rule and the verdict over all."""
    v = j06_integrity(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("rows"))
    severe = F.col("rule").isin("orphan_line")
    return v.withColumn("severity", F.when(severe, "ERROR").otherwise("WARNING"))


def c04_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token chunks of every document."""
    out = C.build_chunks(chunks(spark, sf_dir), "chunk_id", "text", AUDIT)
    return out.select("chunk_id", "chunk_index", "token_start", "token_end", "overlap", F.sha2("text", 256).alias("text_sha256"))


def f10_chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None are expected of the builder's own chunks."""
    return C.chunk_violations(C.build_chunks(chunks(spark, sf_dir), "chunk_id", "text", AUDIT), "chunk_id", AUDIT)


def w12_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12 over spans that overlap now and then: minutes of a user's events."""
    w = Window.partitionBy("user_id").orderBy("lo", "id")
    i = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 3600).alias("hi"))
    return i.select("user_id", "id", F.greatest(F.lag("hi").over(w) - F.col("lo"), F.lit(0).cast("long")).alias("overlap"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("document_id"), F.explode(blocks_of(F.col("html"), F.col("url"))).alias("b")).select("document_id", "b.*")


def c06_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page."""
    return _blocks(spark, sf_dir).select("document_id", "block_index", "type", "level", F.sha2("text", 256).alias("text_sha256"))


def p16_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("type") == "heading", 1)).alias("headings"), F.sum(T.word_count(F.col("text"))).alias("words"))


def c05_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page from its blocks."""
    return C.section_text(_blocks(spark, sf_dir)).select("document_id", "section_order", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def p17_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and rule violations of page urls."""
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract(u, "^https?://([^/?#]+)", 1)).alias("host"), (~u.startswith("https://")).alias("not_https"),
        F.contains(u, F.lit("?")).alias("has_query"), F.contains(u, F.lit("#")).alias("has_fragment"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p07_prepared_chunks, f01_indexable, a06_excluded_by_reason, p11_preview, p12_ids, p08_sha256, p10_word_count, p09_tidy, p18_canonical_json, k06_csv_safe, p37_sizes, a05_duplicate_groups, a05_duplicate_members,
        a06_count_by_domain, a08_distinct_counts, a14_token_buckets, a15_chunks_per_section, a22_unique_values, w29_smallest_chunks, u02_without_labels, u03_shared_tokens,
        j09_heading_tree, j20_section_text, w13_drop_repeats, w14_trim_tail, j07_interval_projection, a20_best_grade, j06_integrity, c08_audit_status, c04_chunks, f10_chunk_violations, w12_overlap, c06_page_blocks,
        p16_block_statistics, c05_sections, p17_urls,
    )
}

_PREPARED = r"""
base AS (
  SELECT doc_id AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN '# ' || string_split(coalesce(text, ''), chr(10))[1] ELSE text END AS text, lang, source FROM documents),
counted AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*')) AS token_count,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM base),
flagged AS (SELECT *, len(ls) = 1 AND coalesce(regexp_full_match(trim(ls[1]), '#{1,6}\s+\S[^\n]*'), false) AS heading_only, token_count < 32 AS short FROM counted),
prepared AS (
  SELECT chunk_id, token_count, concat_ws('+', CASE WHEN heading_only THEN 'heading_only' END, CASE WHEN short THEN 'very_short' END) AS flags, NOT (heading_only AND short) AS indexable,
         'sha256:' || sha256(trim(lang) || ' > ' || trim(regexp_replace(source || '  x ', '\s+', ' ', 'g')) || chr(10) || chr(10) || trim(text)) AS retrieval_text_sha256 FROM flagged)"""
_TEXTS = "(SELECT doc_id, text, sha256(text) AS value FROM documents)"
_SPANS = "e AS (SELECT *, epoch(ts)::BIGINT AS s FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events))"
_PROJECT = f"""WITH {_SPANS},
a AS (SELECT user_id, event_id AS source_id, s AS lo, s + 36000 AS hi FROM e WHERE event_type = 'purchase'),
b AS (SELECT user_id, event_id AS target_id, s AS lo, s + 54000 AS hi FROM e WHERE event_type = 'view'),
p AS (SELECT a.user_id, source_id, target_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap, least(a.hi - a.lo, b.hi - b.lo) AS shorter FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi)"""
_BLOCKS = """blocks AS (SELECT user_id AS document_id, event_id AS block_index, event_type IN ('view', 'signup', 'click') AS h, CAST(event_id * 7 % 6 + 1 AS INTEGER) AS level, event_type AS text FROM events),
heads AS (SELECT *, row_number() OVER w AS section_order, coalesce(lead(block_index) OVER w - 1, (SELECT max(block_index) FROM blocks b WHERE b.document_id = x.document_id)) AS block_end FROM blocks x WHERE h WINDOW w AS (PARTITION BY document_id ORDER BY block_index))"""
_SHARED = """list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_-]*|[0-9]+'),
  lambda x: string_split_regex(lower(translate(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), ' +'))), lambda x: x IN ('edition', 'handled', 'my', 'other', 'thing'))))"""

SQL = {
    "p07_prepared_chunks": f"WITH {_PREPARED} SELECT * FROM prepared",
    "f01_indexable": f"WITH {_PREPARED} SELECT chunk_id FROM prepared WHERE indexable",
    "a06_excluded_by_reason": f"WITH {_PREPARED} SELECT flags AS reason, count(*) AS rows, CAST(sum(CAST(NOT indexable AS INTEGER)) AS BIGINT) AS excluded FROM prepared GROUP BY flags",
    "p11_preview": r"SELECT doc_id AS chunk_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 79) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "p12_ids": r"""WITH i AS (SELECT doc_id AS chunk_id, printf('doc-%03d-sec-%03d-ch-%03d', doc_id % 1000, doc_id % 7, doc_id) AS id FROM documents)
SELECT chunk_id, id, CASE WHEN ok THEN regexp_extract(id, p, 1) END AS document_id, CASE WHEN ok THEN regexp_extract(id, p, 1) || '-sec-' || regexp_extract(id, p, 2) END AS section_id, CASE WHEN ok THEN CAST(regexp_extract(id, p, 3) AS INTEGER) END AS chunk_number
FROM (SELECT *, '([a-z0-9]+-[0-9]{3})-sec-([0-9]{3})-ch-([0-9]{3})' AS p, regexp_full_match(id, '([a-z0-9]+-[0-9]{3})-sec-([0-9]{3})-ch-([0-9]{3})') AS ok FROM i)""",
    "p08_sha256": "SELECT doc_id AS chunk_id, 'sha256:' || sha256(text) AS sha256 FROM documents",
    "p09_tidy": r"SELECT doc_id AS chunk_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text || chr(13) || chr(10) || 'x  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'y'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS tidy_sha256 FROM documents",
    "p18_canonical_json": """SELECT doc_id, '{"doc_id":' || doc_id || ',"note":null,"quality":' || quality || ',"toxic":' || toxic || '}' AS json FROM labels""",
    "k06_csv_safe": "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN '''' ELSE '' END || ['=', ' +', '-', '@', 'x'][event_id % 5 + 1] || event_type AS cell FROM events",
    "p37_sizes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM (SELECT doc_id, n_chars * 40 AS n FROM documents)",
    "a05_duplicate_groups": f"SELECT value, count(*) AS members, min(doc_id) AS first_key FROM {_TEXTS} GROUP BY value HAVING count(*) > 1",
    "a05_duplicate_members": f"SELECT value, doc_id AS key, n AS members FROM (SELECT *, count(*) OVER (PARTITION BY value) AS n FROM {_TEXTS}) WHERE n > 1",
    "a06_count_by_domain": "SELECT lang AS domain, source AS document_id, count(*) AS rows FROM documents GROUP BY ALL",
    "a08_distinct_counts": "SELECT count(DISTINCT source) AS documents, count(DISTINCT lang) AS domains, count(DISTINCT text) AS texts FROM documents",
    "a14_token_buckets": f"""WITH {SQL_TOKENS}, b AS (SELECT * FROM (VALUES (0, '0', 0, 1), (1, '1-15', 1, 16), (2, '16-31', 16, 32), (3, '32-63', 32, 64), (4, '64-127', 64, 128), (5, '128-255', 128, 256), (6, '256-383', 256, 384), (7, '384-511', 384, 512), (8, '512', 512, 513), (9, '513+', 513, 1000000000)) t(position, bucket, lo, hi))
SELECT position, bucket, count(chunk) AS rows FROM b LEFT JOIN toks ON len(t) >= lo AND len(t) < hi GROUP BY position, bucket""",
    "a15_chunks_per_section": "SELECT n, count(*) AS sections FROM (SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) GROUP BY n",
    "a22_unique_values": "SELECT lang AS domain, string_agg(DISTINCT source, ',' ORDER BY source) AS documents FROM documents GROUP BY lang",
    "w29_smallest_chunks": f"WITH {SQL_TOKENS} SELECT chunk AS chunk_id, len(t) AS tokens FROM toks ORDER BY tokens, chunk_id LIMIT 50",
    "u02_without_labels": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "u03_shared_tokens": f"SELECT doc_id AS chunk_id, array_to_string({_SHARED}, ' ') AS shared FROM documents",
    "j09_heading_tree": f"""WITH RECURSIVE {_BLOCKS},
parents AS (SELECT a.document_id, a.section_order, max(b.section_order) AS parent_order FROM heads a LEFT JOIN heads b ON a.document_id = b.document_id AND b.section_order < a.section_order AND b.level < a.level GROUP BY ALL),
depths AS (SELECT document_id, section_order, CAST(1 AS BIGINT) AS depth FROM parents WHERE parent_order IS NULL
  UNION ALL SELECT p.document_id, p.section_order, d.depth + 1 FROM parents p JOIN depths d ON p.document_id = d.document_id AND p.parent_order = d.section_order)
SELECT document_id, section_order, block_index AS block_start, block_end, level, parent_order, depth FROM heads JOIN parents USING (document_id, section_order) JOIN depths USING (document_id, section_order)""",
    "j20_section_text": f"""WITH {_BLOCKS}, n AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY document_id ORDER BY block_index) AS o FROM blocks)
SELECT document_id, CAST(o AS BIGINT) AS section_order, sha256(string_agg(CASE WHEN h THEN repeat('#', level) || ' ' || text ELSE text END, chr(10) || chr(10) ORDER BY block_index)) AS text_sha256 FROM n WHERE o > 0 GROUP BY ALL""",
    "w13_drop_repeats": "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)",
    "w14_trim_tail": "WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' AND value > 20 GROUP BY user_id) SELECT user_id, event_id FROM events LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop",
    "j07_interval_projection": f"{_PROJECT} SELECT user_id, source_id, target_id, overlap, round(overlap / shorter, 6) AS share FROM p WHERE overlap / shorter >= 0.5",
    "a20_best_grade": f"{_PROJECT} SELECT target_id, max(source_id % 4) AS grade, count(*) AS sources FROM p WHERE overlap / shorter >= 0.5 GROUP BY target_id",
    "j06_integrity": """
SELECT 'orphan_line' AS rule, l_orderkey || '-' || l_linenumber AS key FROM lineitem WHERE l_orderkey % 50 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'shipped_before_order', l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 50 <> 0 AND l_shipdate < o_orderdate
UNION ALL SELECT 'order_without_lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customer_without_orders', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "w12_overlap": f"WITH {_SPANS} SELECT user_id, event_id AS id, greatest(lag(s + 3600) OVER w - s, 0) AS overlap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)",
    "f10_chunk_violations": "SELECT '' AS rule, '' AS key, '' AS detail WHERE false",
    "p17_urls": "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, NOT starts_with(url, 'https://') AS not_https, contains(url, '?') AS has_query, contains(url, '#') AS has_fragment FROM pages",
}
SQL["c08_audit_status"] = f"SELECT rule, count(*) AS rows, CASE WHEN rule = 'orphan_line' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM ({SQL['j06_integrity']}) GROUP BY rule"
