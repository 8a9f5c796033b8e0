"""Planning a labelled question set: quotas, slots, ids, anchors, related candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the set by category, difficulty and split. Each line: category, easy, medium, hard, dev, test.
MATRIX = (
    ("direct_factual", 12, 8, 0, 12, 8),
    ("comparison", 2, 8, 5, 9, 6),
    ("scenario_application", 4, 10, 6, 12, 8),
    ("multi_hop", 2, 8, 10, 12, 8),
    ("troubleshooting", 2, 7, 6, 9, 6),
    ("negative_near_miss", 3, 4, 3, 6, 4),
)
DIFFICULTIES, SPLITS, TOTAL = ("easy", "medium", "hard"), ("dev", "test"), 100
TOTALS = {"easy": 25, "medium": 45, "hard": 30, "dev": 60, "test": 40}
NEIGHBOURS, IDEAL_TOKENS, SMALL_TOKENS = 30, 180, 64


def quota_cells(spark: SparkSession) -> DataFrame:
    """category, category_index, axis (difficulty or split), value, value_index, target."""
    rows = [(m[0], i, "difficulty", d, j, m[1 + j]) for i, m in enumerate(MATRIX) for j, d in enumerate(DIFFICULTIES)]
    rows += [(m[0], i, "split", s, j, m[4 + j]) for i, m in enumerate(MATRIX) for j, s in enumerate(SPLITS)]
    return spark.createDataFrame(rows, "category string, category_index int, axis string, value string, value_index int, target int")


def quota_faults(cells: DataFrame) -> DataFrame:
    """the two axes of a category must sum to the same, each value to its total, each axis to the whole."""
    by_category = cells.groupBy("category").pivot("axis", ["difficulty", "split"]).sum("target").where("difficulty <> split").select(F.lit("category_sums_differ").alias("rule"), F.col("category").alias("key"))
    totals = cells.sparkSession.createDataFrame(list(TOTALS.items()), "value string, total int")
    by_value = cells.groupBy("value").agg(F.sum("target").alias("s")).join(totals, "value").where("s <> total").select(F.lit("value_total").alias("rule"), F.col("value").alias("key"))
    by_axis = cells.groupBy("axis").agg(F.sum("target").alias("s")).where(F.col("s") != TOTAL).select(F.lit("axis_total").alias("rule"), F.col("axis").alias("key"))
    return by_category.union(by_value).union(by_axis)


def quota_counts(seeds: DataFrame) -> DataFrame:
    """Counts over the five groupings in one pass."""
    keys = ("category", "difficulty", "split")
    g = seeds.groupingSets([["category"], ["difficulty"], ["split"], ["category", "difficulty"], ["category", "split"]], *keys)
    return g.agg(F.count("*").alias("rows"))


def quota_excess(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """cells of which the seeds already hold more than the target."""
    long = seeds.select("category", F.expr("stack(2, 'difficulty', difficulty, 'split', split) AS (axis, value)"))
    have = long.groupBy("category", "axis", "value").agg(F.count("*").alias("have"))
    return have.join(cells.select("category", "axis", "value", "target"), ["category", "axis", "value"], "left").where(F.col("have") > F.coalesce("target", F.lit(0))).select("category", "axis", "value", "have", "target")


def residual_slots(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """What is left of the quotas as one row per slot. Per category the difficulties in order, and the splits in order but
    turned by a third of their number, are laid side by side."""
    long = seeds.select("category", F.expr("stack(2, 'difficulty', difficulty, 'split', split) AS (axis, value)"))
    have = long.groupBy("category", "axis", "value").agg(F.count("*").alias("have"))
    left = cells.join(have, ["category", "axis", "value"], "left").withColumn("n", F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).cast("int")).where("n > 0")
    slots = left.select("category", "category_index", "axis", "value", "value_index", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    own = Window.partitionBy("category", "axis")
    slots = slots.withColumns({"position": F.row_number().over(own.orderBy("value_index", "i")) - 1, "size": F.count("*").over(own)})
    turned = F.when(F.col("axis") == "split", F.pmod(F.col("position") - F.floor(F.col("size") / 3), F.col("size"))).otherwise(F.col("position")).cast("int")
    at = slots.withColumn("position", turned).groupBy("category", "category_index", "position").pivot("axis", ["difficulty", "split"]).agg(F.first("value"))
    return at.where("difficulty IS NOT NULL AND split IS NOT NULL")


def interleave(slots: DataFrame) -> DataFrame:
    """One slot of each category in turn."""
    return slots.withColumn("turn", F.row_number().over(Window.orderBy("position", "category_index")).cast("long"))


def free_numbers(used: DataFrame, column: str, n: int, highest: int = TOTAL) -> DataFrame:
    """The n smallest numbers up to ``highest`` that aren't used."""
    every = used.sparkSession.range(1, highest + 1).toDF("number")
    return every.join(used.select(F.col(column).cast("long").alias("number")), "number", "left_anti").orderBy("number").limit(n)


def chunk_quality(tokens: Column) -> list[Column]:
    """Chunks that aren't small first, then those nearest to the ideal length."""
    return [(tokens < SMALL_TOKENS).cast("int"), F.abs(tokens - IDEAL_TOKENS)]


def balanced_anchors(chunks: DataFrame, n: int, domain: str = "domain", key: str = "chunk_id", tokens: str = "token_count") -> DataFrame:
    """The next best chunk of the domain with the fewest so far, n times: by place in the domain, then domain."""
    place = F.row_number().over(Window.partitionBy(domain).orderBy(*chunk_quality(F.col(tokens)), key))
    ranked = chunks.select(key, domain, tokens).withColumn("place", place.cast("long")).where(F.col("place") <= n)
    return ranked.orderBy("place", domain).limit(n)


def related(neighbours: DataFrame, tiers: Column, n: int) -> DataFrame:
    """Of each anchor's neighbours (anchor, chunk, score) the n first by tier, score and chunk, each once; ``tiers`` is null for
    those that no tier takes."""
    ranked = neighbours.withColumn("tier", tiers).where("tier IS NOT NULL")
    best = ranked.groupBy("anchor", "chunk").agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    order = Window.partitionBy("anchor").orderBy("tier", F.desc("score"), "chunk")
    return best.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)
