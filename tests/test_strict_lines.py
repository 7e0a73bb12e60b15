"""Strict JSON lines: what is refused, line numbers over byte ranges, all-or-nothing writes, and the same reader on a stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from spanloom.sources import records as A
from spanloom.sources import strict_lines as L

BROKEN = [
    '{"doc_id":"a","doc_id":"b","spans":[]}', '{"doc_id":"a","spans":[{"start":0,"start":1,"end":3,"label":"X"}]}', '{"doc_id":"a","spans":[{"start":0,"end":3,"label":"X","score":NaN}]}',
    '{"doc_id":"a","spans":[{"start":0,"end":3,"label":"X","score":-Infinity}]}', '{"doc_id":"a","spans":[]} x', '{"doc_id":"a","spans":[]}{"doc_id":"b","spans":[]}', '{"doc_id":"a","spans":[]},{"doc_id":"b","spans":[]}',
    '{"doc_id":5,"spans":[]}', '{"doc_id":"a","spans":[{"start":0,"end":3,"label":7}]}', '{"doc_id":"a","spans":[{"start":true,"end":3,"label":"X"}]}', '{"doc_id":"a","spans":[{"start":0.5,"end":3,"label":"X"}]}',
    '{"doc_id":"a","spans":[{"start":"0","end":3,"label":"X"}]}', "{'doc_id':'a','spans':[]}", "[]", "1", "{", '{"\\u0064oc_id":"a","doc_id":"b","spans":[]}',
]
GOOD = ['{"doc_id":"a","spans":[]}', ' {"spans": [{"label":"X","end":3,"start":0,"score":null}], "doc_id":"b"} ', '{"doc_id":"ü","spans":[{"start":0,"end":3,"label":"X","score":1}]}']


@pytest.mark.parametrize("parse", [A.parse_predictions, A.parse_gold])
def test_broken_records(spark, parse):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(BROKEN + GOOD)], "line long, value string")
    got = {r.line: r.violations for r in parse(rows).collect()}
    assert [got[i] for i in range(len(BROKEN))] == [["not_valid_json"]] * len(BROKEN)
    assert all(got[len(BROKEN) + i] == [] for i in range(len(GOOD)))


def test_infinite_score_and_texts(spark):
    rows = spark.createDataFrame([('{"doc_id":"a","spans":[{"start":0,"end":3,"label":"X","score":1e400}]}',)], "value string")
    assert A.parse_predictions(rows).first().violations == ["span_invalid"]
    texts = spark.createDataFrame([('{"text":"a","text":"b"}',), ('{"text":1}',), ('{"text":"a"}',)], "value string")
    assert sorted(str(r.violations) for r in A.parse_texts(texts).collect()) == ["['not_valid_json']", "['not_valid_json']", "[]"]


def test_line_numbers_over_ranges(spark, tmp_path):
    """Ranges of a few bytes, blank lines, lines longer than a range, no newline at the end, a folder within the folder."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    a = ["first", "", "  ", "x" * 50, "", "ünï", "last"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(a))
    (tmp_path / "in" / "deep" / "b.jsonl").write_text("\r\n".join(["one", "two"]) + "\r\n")
    (tmp_path / "in" / "_hidden").write_text("no\n")
    (tmp_path / "in" / "empty.jsonl").write_text("")
    want = {("a.jsonl", i + 1, v) for i, v in enumerate(a) if v.strip()} | {("b.jsonl", 1, "one"), ("b.jsonl", 2, "two")}
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        for size in (1, 3, 7, 10, 1 << 20):
            rows = L.read_strict_lines(spark, path, size).collect()
            assert {(os.path.basename(r.file), r.line, r.value) for r in rows} == want and len(rows) == len(want)
    with pytest.raises(Exception, match="missing"):
        L.read_strict_lines(spark, str(tmp_path / "missing")).collect()


def test_write_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(1000).select(F.to_json(F.struct("id")).alias("value")).repartition(4)
    assert L.write_strict_lines(lines, path) == 1000
    assert L.write_strict_lines(lines.limit(10), path) == 1010
    ids = [json.loads(r.value)["id"] for r in L.read_strict_lines(spark, path, 500).collect()]
    assert sorted(ids) == sorted([*range(1000), *sorted(ids, key=ids.count)[-10:]]) or len(ids) == 1010
    broken = lines.withColumn("value", F.when(F.col("value").contains("777"), F.lit("two\nlines")).otherwise(F.col("value")))
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="line break"):
        L.write_strict_lines(broken, path, "overwrite")
    assert sorted(os.listdir(path)) == before and not any(n.startswith("_staging") for n in before)
    assert L.write_strict_lines(lines.limit(7), path, "overwrite") == 7 == L.read_strict_lines(spark, path).count()


def test_stream_reads_new_files_once(spark, tmp_path):
    path, name = tmp_path / "in", "strict_stream"
    path.mkdir()
    (path / "1.jsonl").write_text("\n".join([GOOD[0], BROKEN[0]]) + "\n")
    lines = L.stream_strict_lines(spark, str(path), settle_seconds=0.0, range_bytes=16)
    query = A.parse_predictions(lines).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        assert sorted(str(r.violations) for r in spark.table(name).collect()) == ["['not_valid_json']", "[]"]
        time.sleep(0.05)
        (path / "2.jsonl").write_text(GOOD[2] + "\n")
        query.processAllAvailable()
        assert sorted((r.doc_id or "") for r in spark.table(name).where("size(violations) = 0").collect()) == ["a", "ü"]
        assert spark.table(name).count() == 3
    finally:
        query.stop()
