"""Stage policies, allow-lists of artifact scans, infeasible floors and measured passes."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scans as Z
from spanloom.operators import calibration as C
from spanloom.operators import harness as H
from spanloom.operators import policies as P
from spanloom.operators import routing as T


def test_release_policies_may_not_weaken(spark):
    for weak in ({"validators": False}, {"thresholds": False}, {"conflicts": "exact_duplicates_only"}, {"rule_labels": ()}, {"model_labels": ("PERSON",)}):
        with pytest.raises(ValueError, match="may not weaken"):
            P.StagePolicy(**weak)
        P.StagePolicy(purpose="evaluation_ablation", **weak)
    for wrong in ({"name": " "}, {"purpose": "other"}, {"conflicts": "none"}, {"context": False, "context_required": True}, {"purpose": "evaluation_ablation", "rule_labels": ("A", "A")}):
        with pytest.raises(ValueError):
            P.StagePolicy(**wrong)
    with pytest.raises(ValueError, match="no route"):
        P.opened(T.routes(spark), P.StagePolicy("x", "evaluation_ablation", model_labels=("NOT_THERE",)))


def test_thresholds_are_no_secrets(spark):
    rows = [
        ("a/calibration.json", '"SECRET": 0.1234567890123,'), ("thresholds.yaml", "  SECRET: 0.9999999999999"), ("other.json", "SECRET: 0.1234567890123"), ("thresholds.yaml", "SECRET: 1.5000000000000"),
        ("thresholds.yaml", "SECRET: 0.1234567890123 # note"), ("calibration.json", "secret: 0.1234567890123"), ("calibration.json", "api_key = abcdefghijklmnop"),
    ]
    lines = spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(rows)], "path string, line long, text string")
    assert sorted(r.line for r in Z.artifact_findings(lines).where("kind = 'assigned_secret'").collect()) == [2, 3, 4, 5, 6]
    paths = spark.createDataFrame([("f", 1, "see file:///x/y and /home/u/v and C:\\Users\\me"), ("f", 2, "{'CUDA_VISIBLE_DEVICES': '0,1'} CUDA_VISIBLE_DEVICES=0")], "path string, line long, text string")
    assert sorted((r.line, r.kind) for r in Z.artifact_findings(paths).collect()) == [(1, "private_local_path"), (2, "fixed_physical_gpu")]


def test_infeasible_floor_fails(spark):
    rows = spark.createDataFrame([("A", 0.9, True), ("A", 0.2, False), ("B", 0.8, True)], "label string, score double, positive boolean")
    support = spark.createDataFrame([("A", 4), ("B", 1)], "label string, n_gold long")
    assert {r.label for r in C.choose_thresholds(rows, support, min_recall=0.25).collect()} == {"A", "B"}
    with pytest.raises(Exception, match="recall floor for A"):
        C.choose_thresholds(rows, support, min_recall=0.5).collect()


def test_measured_passes(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "x")], "doc_id long, text string")
    report = H.measured(spark, docs, {"words": lambda df: df.select(F.explode(F.split("text", " ")).alias("w")), "none": lambda df: df.where("doc_id < 0")}, 0, 3).collect()
    assert [(r.name, r.repetitions, r.n_docs, r.n_chars, r.n_rows, r.warmup_ms) for r in report][0] == ("words", 3, 9, 18, 9, 0.0)
    assert report[0].p50_ms <= report[0].p95_ms <= report[0].elapsed_ms and report[1].n_rows == 0
    assert H.percentile([4.0, 1.0, 3.0, 2.0], 0.5) == 2.5 and H.percentile([1.0], 0.95) == 1.0
    with pytest.raises(ValueError):
        H.measured(spark, docs, {}, 0, 0)


def test_extracts_assert_their_rows(spark, tmp_path):
    import os

    from spanloom.operators import audits as S
    from spanloom.operators.datasets import corpus_overlap
    from spanloom.sources import records as A

    path = f"file://{tmp_path}/x"
    assert A.write_extract(spark.range(10).where("id > 2"), path, 7) == 7 and spark.read.parquet(path).count() == 7
    assert any(".zstd." in n for n in os.listdir(tmp_path / "x"))
    with pytest.raises(ValueError, match="3 rows, not 4"):
        A.write_extract(spark.range(3), f"file://{tmp_path}/y", 4)
    assert not os.path.exists(tmp_path / "y")
    docs = spark.createDataFrame([("a", 1, "One two"), ("b", 2, "one  TWO"), (None, 1, "x"), ("b", 3, None)], "corpus string, doc_id long, text string")
    values = spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("b", None)], "corpus string, value string")
    overlap = corpus_overlap(S.corpus_fingerprints(docs, values))
    assert [tuple(r) for r in overlap.collect()] == [("normalized_text_sha256", "a", "b", 1)]
    with pytest.raises(ValueError, match="normalized_text_sha256 x1"):
        S.require_isolated(overlap)
    S.require_isolated(overlap.limit(0))
