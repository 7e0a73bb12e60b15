"""Odd inputs and large groups that the smallest tables do not hold, against the same SQL."""

import duckdb
import pytest

from spanloom import catalog
from tests.conftest import SF
from tests.test_oracles import rows


def check(spark, name, folder, **tables):
    """The query and its SQL over tables made from rows in DuckDB."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    theirs = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, theirs.fetchall())


TEXTS = ("at 38.211.12.42 4366089147969128 ly", "to x1.2.3.4@mail0.example.com and on", "plain", "a.b@c.org 38.211.12.42")


def test_rebuild_of_overlapping_spans(spark, tmp_path):
    check(spark, "e14_rebuild", tmp_path, documents="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS)) + ") t(doc_id, text)")


def test_combine_has_no_fold_over_the_text_so_far(spark, tmp_path):
    check(spark, "i26_combine", tmp_path, customer="SELECT (i * 30 + i // 3000)::BIGINT AS c_custkey, 'Customer#' || i AS c_name, 'X' AS c_mktsegment FROM range(4000) t(i)")
    plan = catalog.queries()["i26_combine"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.replace("Aggregate", "")


@pytest.mark.parametrize("name, most", [("a24_evidence", 40), ("b_crafted_rules", 60), ("b_label_counts", 90)])
def test_patterns_stand_once_in_the_plan(spark, name, most):
    """Every search takes two or three expressions; neither a filter nor a comparison of spans repeats them."""
    spark.conf.set("spark.sql.maxPlanStringLength", 20_000_000)
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < sum(plan.count(x) for x in ("regexp_extract_all(", "split(")) <= most
    assert plan.count("Filter (size(") == 0


def test_few_row_groups_are_dealt_to_all_tasks(spark):
    for name in ("a24_evidence", "b_crafted_rules", "c10_other_formats"):
        assert catalog.queries()[name](spark, SF).rdd.getNumPartitions() > 8


def test_short_ranges_share_tasks(tmp_path):
    """Ranges of 64 bytes: their lines are those of the file, few tasks read them, and a range reads little beyond its end."""
    from spanloom.sources import strict_lines as L

    lines = ["x" * (k % 90) for k in range(2000)]
    (tmp_path / "part.jsonl").write_text("\n".join(lines))
    for size in (64, 1000, 1 << 20):
        reader = L.StrictReader({"path": str(tmp_path), "rangebytes": str(size)})
        parts = reader.partitions()
        assert len(parts) == 1
        assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == [x for x in lines if x]
        counter = L.StrictReader({"path": str(tmp_path), "rangebytes": str(size), "counts": "true"})
        counts = [(p, n) for q in counter.partitions() for b in counter.read(q) for p, n in zip(b.column("part").to_pylist(), b.column("row").to_pylist(), strict=True)]
        assert [p for p, _ in counts] == list(range(-(-(tmp_path / "part.jsonl").stat().st_size // size))) and sum(n for _, n in counts) == len(lines)


def test_tokens_come_in_short_slices(spark):
    """600 documents in one batch: at most AT_ONCE at a time, with the offsets of each document's own text."""
    import re

    from spanloom.operators import safe_windows as W

    texts = [" ab c\n" * (k % 7) + "d" * (k % 3) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: [tuple(o) for o in r["offsets"]] for r in W.covering_tokens(docs).collect()}
    assert found == {k: [m.span() for m in re.finditer(r"\s*\S+|\s+\Z", t)] for k, t in enumerate(texts)}
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    assert [b.num_rows for b in W._slices(iter([batch]))] == [W.AT_ONCE, W.AT_ONCE, 600 - 2 * W.AT_ONCE]
