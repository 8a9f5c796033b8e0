"""Corpus preparation: flags, duplicates, histograms, sections, chunks, and their checks as violation rows.

A check returns rows (rule, key, detail); ``fail_closed`` raises when there are any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import ChunkSettings, bpe_spans, chunks_of, regex_spans

#: Rows that a task of a large join sorts, about.
ROWS_A_TASK = 500_000
#: The token buckets of the audit (from, to exclusive).
BUCKETS = ((0, 1), (1, 16), (16, 32), (32, 64), (64, 128), (128, 256), (256, 384), (384, 512), (512, 513), (513, None))


def dealt(by: DataFrame, *sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """The sides of a join dealt out by their keys to tasks that get about ROWS_A_TASK rows of ``by``, the largest side. Adaptive
    execution would put together as much as makes 64 compressed MB, which for sorted keys are many times the rows."""
    n = max(int(by.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-by.count() // ROWS_A_TASK))
    return [df.repartition(n, key) for df, key in sides]


def violation(df: DataFrame, rule: str, key: Column, bad: Column, detail: Column | None = None) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fail_closed(violations: DataFrame, limit: int = 20) -> None:
    """Raises with the first few violations (in order) if there are any."""
    found = violations.orderBy("rule", "key").limit(limit).collect()
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.key} {r.detail}".strip() for r in found))


def prepare_chunks(chunks: DataFrame, text: str = "text", path: str = "heading_path", tokens: str = "token_count") -> DataFrame:
    """The chunks with quality flags, indexable, retrieval text and its hash; all their columns stay."""
    body, count = F.col(text), F.col(tokens)
    out = chunks.withColumns({"quality_flags": T.quality_flags(body, count), "indexable": T.indexable(body, count), "retrieval_text": T.retrieval_text(F.col(path), body)})
    return out.withColumn("retrieval_text_sha256", T.sha256_text(F.col("retrieval_text")))


def duplicate_groups(df: DataFrame, value: Column, key: Column) -> DataFrame:
    """A5: values that several rows share, with how many and the least key; ids stay a joinable table, not one long list."""
    g = df.select(value.alias("value"), key.alias("key")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("members"), F.min("key").alias("first_key"))
    return g.where("members > 1")


def duplicate_members(df: DataFrame, value: Column, key: Column) -> DataFrame:
    groups = duplicate_groups(df, value, key).select("value", "members")
    return df.select(value.alias("value"), key.alias("key")).join(groups, "value")


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """All buckets, with 0 where nothing falls. One aggregate row, unfolded."""
    name = lambda a, b: f"{a}+" if b is None else str(a) if b == a + 1 else f"{a}-{b - 1}"
    inside = lambda a, b: (value >= a) if b is None else (value >= a) & (value < b)
    row = df.agg(*[F.count(F.when(inside(a, b), 1)).alias(f"b{i}") for i, (a, b) in enumerate(BUCKETS)])
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name(a, b)).alias("bucket"), F.col(f"b{i}").alias("rows")) for i, (a, b) in enumerate(BUCKETS)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def heading_tree(blocks: DataFrame, doc: str = "document_id", index: str = "block_index") -> DataFrame:
    """One row per heading with its order, block range, parent and path. ``blocks`` has type, level, text.

    A heading's parent is the nearest heading before it with a smaller level. The last heading of each level is carried along;
    ancestors are those levels below the own one that came after every shallower candidate.
    """
    is_h = F.col("type") == "heading"
    run = Window.partitionBy(doc).orderBy(index)
    n_blocks = F.max(index).over(Window.partitionBy(doc))
    h = blocks.withColumn("__last_block", n_blocks).where(is_h)
    order = F.row_number().over(run)
    h = h.withColumn("section_order", order).withColumn("block_end", F.coalesce(F.lead(index).over(run) - 1, F.col("__last_block")))
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.struct(F.col("section_order").alias("o"), F.col("text").alias("t"))), ignorenulls=True).over(before) for n in range(1, 7)}
    h = h.withColumns({f"__l{n}": c for n, c in last.items()})
    # Level n is an ancestor if it is shallower than the heading and nothing shallower than n came after it.
    parts = []
    for n in range(1, 7):
        later = [F.coalesce(F.col(f"__l{m}.o"), F.lit(0)) for m in range(1, n)]
        newest = F.greatest(F.lit(0), *later) if later else F.lit(0)
        parts.append(F.when((F.lit(n) < F.col("level")) & F.col(f"__l{n}").isNotNull() & (F.col(f"__l{n}.o") > newest), F.col(f"__l{n}")))
    # Going up from the heading, an ancestor hides every deeper one that came before it.
    chain = F.array_sort(F.array_compact(F.array(*parts)))
    h = h.withColumn("__chain", chain)
    path = F.concat(F.transform("__chain", lambda x: x["t"]), F.array("text"))
    return h.select(
        doc, F.col("section_order").cast("long").alias("section_order"), F.col(index).alias("block_start"), F.col("block_end"), "level", "text",
        F.get(F.transform("__chain", lambda x: x["o"]), F.size("__chain") - 1).cast("long").alias("parent_order"),
        path.alias("heading_path"),
    )


def section_text(blocks: DataFrame, doc: str = "document_id", index: str = "block_index") -> DataFrame:
    """Blocks joined to their section by the running count of headings; text of each section."""
    n = F.sum((F.col("type") == "heading").cast("long")).over(Window.partitionBy(doc).orderBy(index))
    rendered = T.render_block(F.col("type"), F.col("text"), F.col("level"), F.col("language"))
    placed = blocks.select(doc, index, rendered.alias("r"), n.alias("section_order")).where("section_order > 0")
    g = placed.groupBy(doc, "section_order").agg(F.sort_array(F.collect_list(F.struct(index, "r"))).alias("b"))
    return g.select(doc, "section_order", F.array_join(F.transform("b", lambda x: x["r"]), "\n\n").alias("text"))


def drop_repeats(blocks: DataFrame, doc: str, index: str, *same: str) -> DataFrame:
    """Blocks equal to the one before are dropped; runs of equal blocks leave one."""
    prev = Window.partitionBy(doc).orderBy(index)
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(prev)) for c in same])
    first = F.row_number().over(prev) == 1
    return blocks.withColumn("__keep", first | ~equal).where("__keep").drop("__keep")


def trim_tail(blocks: DataFrame, doc: str, index: str, stop: Column) -> DataFrame:
    """Everything from the first stop block of a document on is dropped."""
    seen = F.max(stop.cast("int")).over(Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("__seen", seen).where(F.coalesce("__seen", F.lit(0)) == 0).drop("__seen")


def build_chunks(sections: DataFrame, key: str = "section_id", text: str = "text", settings: ChunkSettings = ChunkSettings(), tokenizer_path: str | None = None) -> DataFrame:  # noqa: B008
    """C4: one row per chunk; sections stay in their rows, so nothing is shuffled. Tokens are a tokenizer file's, or words."""
    tokenize = bpe_spans(tokenizer_path) if tokenizer_path else regex_spans
    return sections.select(key, F.explode(chunks_of(F.col(text), settings, tokenize)).alias("c")).select(key, "c.*", (F.col("c.token_end") - F.col("c.token_start")).alias("token_count"))


def chunk_violations(chunks: DataFrame, key: str, settings: ChunkSettings) -> DataFrame:
    """Indexes run from 0, spans overlap exactly as set, no chunk is larger than the target."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    c = chunks.withColumns({"__prev": F.lag("token_end").over(w), "__n": F.row_number().over(w) - 1})
    return all_violations(
        violation(c, "chunk_index_gap", F.col(key), F.col("chunk_index") != F.col("__n"), F.col("chunk_index")),
        violation(c, "overlap_mismatch", F.col(key), F.col("__prev").isNotNull() & (F.col("__prev") - F.col("token_start") != settings.overlap), F.col("chunk_index")),
        violation(c, "first_chunk_start", F.col(key), F.col("__prev").isNull() & (F.col("token_start") != 0), F.col("token_start")),
        violation(c, "oversized_chunk", F.col(key), F.col("token_end") - F.col("token_start") > settings.target, F.col("chunk_index")),
        violation(c, "empty_chunk", F.col(key), F.col("token_end") <= F.col("token_start"), F.col("chunk_index")),
    )


def project_intervals(source: DataFrame, target: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Pairs of source and target spans (id, lo, hi) of one key that overlap by ``share`` of the shorter. The key makes
    it an equi-join; the overlap is its residual."""
    s = source.select(key, F.col("id").alias("source_id"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    t = target.select(key, F.col("id").alias("target_id"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    both = s.join(t, key).where("s_lo < t_hi AND t_lo < s_hi")
    overlap = F.least("s_hi", "t_hi") - F.greatest("s_lo", "t_lo")
    out = both.withColumn("overlap", overlap).withColumn("share", F.col("overlap") / F.least(F.col("s_hi") - F.col("s_lo"), F.col("t_hi") - F.col("t_lo")))
    return out.where(F.col("share") >= share)


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-1, F11: rows of either side that the other lacks, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def upsert(old: DataFrame, new: DataFrame, key: str, content: str, overwrite: bool = False) -> DataFrame:
    """K5: key and status (new, unchanged, overwritten, conflict, kept) from one full outer join."""
    o = old.select(key, F.col(content).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(key, F.col(content).alias("__new"), F.lit(True).alias("__in_new"))
    status = (
        F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "kept").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("overwritten" if overwrite else "conflict")
    )
    return o.join(n, key, "full_outer").select(key, status.alias("status"))
