"""Labelling packs for people who write questions, evidence packets for people who review them, and the score of their reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many related candidates a question of a category gets; those not listed get FEW.
CANDIDATES = {"comparison": 4, "multi_hop": 4, "troubleshooting": 4, "negative_near_miss": 4}
FEW = 3
UNANSWERABLE = "negative_near_miss"
#: What the writer of a question is told.
ADVICE = {
    "direct_factual": "Ask for one fact that the anchor states.",
    "comparison": "Ask what sets two things apart; the anchor tells of one, a candidate of the other.",
    "scenario_application": "Describe a situation in which a reader has to act on what the anchor says, in other words than its heading.",
    "multi_hop": "Ask what only two or more chunks together answer, and label each of them.",
    "troubleshooting": "Describe a symptom whose cause or remedy the anchor gives.",
    "negative_near_miss": "Ask for something close to the anchor that the corpus doesn't say; give it no relevant chunk.",
}
WARNING = "Anchor and candidates are material to write from; only what was read and judged is relevant."


def candidate_tier(category: Column, same_domain: Column, same_document: Column) -> Column:
    """Which neighbours come first. Comparisons want another document of the domain, questions of several hops other domains next,
    all others the domain as a whole."""
    other_document = F.when(same_domain & ~same_document, 1)
    return (
        F.when(category == "comparison", F.coalesce(other_document, F.when(same_domain, 2), F.lit(3)))
        .when(category == "multi_hop", F.coalesce(other_document, F.when(same_domain, 3), F.lit(2)))
        .otherwise(F.when(same_domain, 1).otherwise(2))
    )


def labelling_packs(slots: DataFrame, numbers: DataFrame, anchors: DataFrame, neighbours: DataFrame, chunks: DataFrame, seeds: DataFrame, prefix: str = "q-") -> DataFrame:
    """A record for every question of the set: seeds as they are, and a draft for each open slot with its anchor and candidates.

    slots (turn, category, difficulty, split), numbers (number), anchors (place, chunk), neighbours (anchor, chunk, score), chunks
    (chunk, domain, document and whatever a writer should see) and seeds (question_id, category, difficulty, split). The k-th slot
    gets the k-th free number and anchor; a slot without either is an error when read. Slots, numbers and anchors are at most as
    many as the quotas, neighbours a fixed number of each, so only chunks is large, and it is joined once by key.
    """
    nth = lambda df, by: df.withColumn("turn", F.row_number().over(Window.orderBy(by)).cast("long")).drop(by)
    drafts = slots.join(numbers.select(F.col("number").alias("own"), F.col("number")).transform(lambda d: nth(d, "own")), "turn", "left")
    drafts = drafts.join(nth(anchors.select("place", F.col("chunk").alias("anchor")), "place"), "turn", "left")
    whole = F.when(F.col("number").isNotNull() & F.col("anchor").isNotNull(), True).otherwise(F.raise_error("a slot has no number or no anchor").cast("boolean"))
    drafts = drafts.where(whole)

    near = drafts.select("turn", "category", "anchor").join(neighbours, "anchor")
    wanted = near.select("chunk").union(drafts.select(F.col("anchor").alias("chunk"))).distinct()
    shown = chunks.join(wanted, "chunk", "left_semi").select("chunk", F.struct(*chunks.columns).alias("context"))
    own = shown.select(F.col("chunk").alias("anchor"), F.col("context").alias("anchor_context"))
    met = near.join(shown, "chunk").join(own, "anchor")
    same = lambda c: F.col(f"context.{c}").eqNullSafe(F.col(f"anchor_context.{c}"))
    met = met.withColumn("tier", candidate_tier(F.col("category"), same("domain"), same("document")))
    order = Window.partitionBy("turn").orderBy("tier", F.desc("score"), "chunk")
    most = F.coalesce(*[F.when(F.col("category") == c, n) for c, n in CANDIDATES.items()], F.lit(FEW))
    kept = met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    lists = kept.groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("k", "score", "context"))).alias("related"))

    advice = F.coalesce(*[F.when(F.col("category") == c, F.lit(a)) for c, a in ADVICE.items()])
    told = drafts.join(own, "anchor", "left").join(lists, "turn", "left").select(
        F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), 3, "0")).alias("question_id"), F.lit("needs_labeling").alias("status"), "category", "difficulty", "split",
        (F.col("category") != UNANSWERABLE).alias("answerable"), advice.alias("advice"), "anchor_context", F.coalesce("related", F.array().cast(lists.schema["related"].dataType)).alias("related"), F.lit(WARNING).alias("warning"),
    )
    done = seeds.select("question_id", F.lit("seed_complete").alias("status"), "category", "difficulty", "split", (F.col("category") != UNANSWERABLE).alias("answerable"))
    return told.unionByName(done, allowMissingColumns=True)


def evidence_packets(questions: DataFrame, snippets: DataFrame) -> DataFrame:
    """A row for every question (question, text) with its ranked snippets (question, evidence_id, chunk, quote ...), for a
    reviewer who sees neither answers nor labels. One without snippets says so. Snippets are few a question by their ranking."""
    number = F.substring("evidence_id", F.lit(2), F.length("evidence_id")).cast("int")
    rest = [c for c in snippets.columns if c != "question"]
    lists = snippets.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), *rest))).alias("evidence"))
    ids = F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), "; ")
    status = F.when(F.col("evidence").isNull(), "missing_saved_retrieval").otherwise("evidence_available")
    return questions.join(lists, "question", "left").select("question", "text", status.alias("evidence_status"), F.coalesce(ids, F.lit("")).alias("evidence_ids"), "evidence")


def review_scores(reviews: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over reviews (key, relation) that have no faults (``audits.review_faults``), joined to (key, answerable) only here.

    Open reviews are counted, never guessed at; relations are compared without case and outer white space. A key without gold counts
    as reviewed but neither as positive nor as negative.
    """
    said = F.nullif(F.lower(F.trim(F.coalesce("relation", F.lit("")))), F.lit(""))
    rows = reviews.select("key", said.alias("said")).join(gold.select("key", "answerable"), "key", "left")
    yes, no = F.col("answerable"), ~F.col("answerable")
    has = lambda group, relation: F.count_if(group & (F.col("said") == relation))
    return rows.agg(
        F.count("*").alias("questions"), F.count("said").alias("reviewed"), F.count_if(F.col("said").isNull()).alias("unreviewed"), F.coalesce(F.bool_and(F.col("said").isNotNull()), F.lit(True)).alias("all_reviewed"),
        F.count_if(yes & F.col("said").isNotNull()).alias("positive_reviewed"), F.count_if(no & F.col("said").isNotNull()).alias("negative_reviewed"),
        has(yes, "supported").alias("positive_supported"), has(yes, "partial").alias("positive_partial"), has(no, "contradicted").alias("negative_contradicted"),
        has(no, "insufficient").alias("negative_insufficient"), has(no, "supported").alias("negative_supported"),
    )
