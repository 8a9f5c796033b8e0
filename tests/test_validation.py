import pytest

from siftspark.operators import corpus as C
from siftspark.operators import validation as V


def rules(df):
    return sorted((r.rule, r.key) for r in df.collect())


def test_manifest(spark):
    rows = [("abc-001", "storage", "t", "https://h.example/a", "r"), ("abc-001", "odd", "t", "http://h.example/a?x", ""), ("Bad", "storage", "u", "https://evil.example/", "r")]
    m = spark.createDataFrame(rows, "id string, domain string, title string, url string, rationale string")
    got = rules(V.manifest_violations(m, ("h.example",), {"storage": 2, "workloads": 1}))
    assert got == sorted([("missing_rationale", "abc-001"), ("id_shape", "Bad"), ("unknown_domain", "abc-001"), ("url_rule", "abc-001"), ("url_rule", "Bad"), ("repeated_id", "abc-001"), ("repeated_title", "t"), ("domain_count", "workloads")])
    with pytest.raises(ValueError, match="domain_count"):
        C.fail_closed(V.manifest_violations(m, ("h.example",)))


GOLDEN = "question_id string, question string, category string, difficulty string, split string, answerable boolean, relevance_judgments array<struct<chunk_id:string,grade:int>>"


def test_golden(spark):
    good = ("k8s-001", "q", "multi_hop", "hard", "dev", True, [("abc-001-sec-001-ch-001", 2)])
    bad = [("k8s-002", " ", "multi_hop", "hard", "dev", False, [("abc-001-sec-001-ch-001", 2), ("abc-001-sec-001-ch-001", 5)]), ("x", "q", "negative_near_miss", "odd", "dev", False, []), ("k8s-001", "q", "multi_hop", "hard", "dev", True, [("short", 0)])]
    assert rules(V.golden_violations(spark.createDataFrame([good], GOLDEN), False)) == []
    got = rules(V.golden_violations(spark.createDataFrame([good, *bad], GOLDEN), False))
    assert got == sorted([("empty_question", "k8s-002"), ("repeated_judgment", "k8s-002"), ("grade_range", "k8s-002"), ("negative_with_evidence", "k8s-002"), ("negative_category_mismatch", "k8s-002"), ("question_id_shape", "x"), ("unknown_difficulty", "x"), ("repeated_question_id", "k8s-001"), ("chunk_id_shape", "k8s-001"), ("answerable_without_evidence", "k8s-001")])
    assert ("total", "questions") in rules(V.golden_violations(spark.createDataFrame([good], GOLDEN)))


def test_blocks_sections_and_ids(spark):
    d = spark.createDataFrame([("a", [(0, "heading", 1, "t"), (2, "heading", 9, " ")]), ("b", [(0, "paragraph", None, "x")])], "document_id string, blocks array<struct<block_index:int,type:string,level:int,text:string>>")
    assert rules(V.block_violations(d)) == [("block_index", "a"), ("empty_heading", "a"), ("heading_level", "a"), ("no_heading", "b")]
    s = spark.createDataFrame([("a", 1, 0, 3, 1, None), ("a", 2, 3, 2, 1, 1), ("a", 4, 9, 9, 3, 7)], "document_id string, section_order int, block_start int, block_end int, level int, parent_order int")
    assert rules(V.section_violations(s)) == [("block_range", "a#2"), ("overlapping_range", "a#2"), ("parent_level", "a#2"), ("parent_order", "a#4"), ("section_order", "a#4"), ("unknown_parent", "a#4")]
    assert V.select_ids(d, "document_id", ["b"]).count() == 1
    for ids in (["b", "b"], ["zz"]):
        with pytest.raises(ValueError):
            V.select_ids(d, "document_id", ids)
