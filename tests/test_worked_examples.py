"""Small cases with known answers, and invariances."""

import random

from pyspark.sql import functions as F

from spanloom.functions import rules as R
from spanloom.functions import validators as V
from spanloom.functions.text import find_spans
from spanloom.operators import calibration as C
from spanloom.operators import decoding as D
from spanloom.operators import evaluation as E
from spanloom.operators import spans as S
from spanloom.operators.graph import connected_components
from spanloom.operators.windows import plan_windows, token_windows
from spanloom.streaming.detection import label_counts, redact_stream
from tests.conftest import SF

SPAN = "doc_id long, start int, end int, label string"


def check(spark, validator, value):
    return spark.createDataFrame([(value,)], "v string").select(validator(F.col("v")).alias("r")).first().r


def test_metrics_example(spark):
    gold = spark.createDataFrame([(1, 0, 2, "PERSON"), (1, 4, 8, "PHONE")], SPAN)
    pred = spark.createDataFrame([(1, 0, 2, "PERSON"), (1, 5, 8, "PHONE"), (1, 8, 9, "EMAIL")], SPAN)
    strict = E.strict_counts(gold, pred)
    micro = strict.where("label IS NULL").first()
    assert (micro.tp, micro.fp, micro.fn) == (1, 2, 1)
    assert abs(micro.f1 - 0.4) < 1e-12 and abs(micro.f2 - 5 / 11) < 1e-12
    assert abs(E.macro(strict).first().macro_f1 - 1 / 3) < 1e-12
    relaxed = E.relaxed_counts(gold, pred).where("label IS NULL").first()
    assert relaxed.tp == 2 and abs(relaxed.f1 - 0.8) < 1e-12
    chars = E.character_counts(gold, pred).where("label IS NULL").first()
    assert (chars.tp, chars.fp, chars.fn) == (5, 1, 1)
    near = E.boundary_accuracy(gold, pred).first()
    assert (near.matched, near.start_accuracy, near.end_accuracy) == (2, 0.5, 1.0)
    assert ("__SPURIOUS__", "EMAIL", 1) in [tuple(r) for r in E.confusion(gold, pred).collect()]


def test_calibration_example(spark):
    rows = spark.createDataFrame([("A", 0.8, True), ("A", 0.4, False)], "label string, score double, positive boolean")
    r = C.calibration_error(rows).first()
    assert abs(r.brier - 0.1) < 1e-12 and abs(r.ece - 0.3) < 1e-12
    assert C.fit_temperature(rows.where("positive")) == 1.0


def test_published_counts():
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn)
    assert round(f1(21_229, 382, 1_977), 8) == 0.94736372
    assert round(f1(21_578, 3_338, 1_628), 8) == 0.89680396


def test_validators(spark):
    for value in ("+86 199-1234-5678", "010-12345678"):
        assert check(spark, V.phone, value).valid
    for validator, good, bad in (
        (V.phone, "199-1234-5678", "12345"), (V.ip, "192.0.2.10", "999.1.1.1"), (V.ip, "2001:db8::1", "2001:db8::g"),
        (V.ip_plain, "2001:db8::1", ":::"), (V.mac, "02:00:00:AA:BB:CC", "02:00"), (V.coordinate, "31.2,121.5", "91,121.5"),
        (V.vehicle_plate, "京A12345", "京A１2345"), (V.vehicle_plate, "京AD12345", "京AABCDE"),
    ):
        assert check(spark, validator, good).valid and not check(spark, validator, bad).valid
    assert check(spark, V.ip, "2001:0db8:0:0::1").normalized == "2001:db8::1"
    assert check(spark, V.luhn, "4111 1111 1111 1111").valid and not check(spark, V.luhn, "0000000000000000").valid
    assert check(spark, V.email, None).valid is False


def test_rule_offsets(spark):
    text = "😀邮箱a@example.invalid，手机199-1234-5678"
    found = {r.label: r for r in R.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    for label, value in (("EMAIL_ADDRESS", "a@example.invalid"), ("PHONE_NUMBER", "199-1234-5678")):
        assert text[found[label].start : found[label].end] == value == found[label].value


def test_capture_keeps_its_place(spark):
    text = "access_token=access_token_01"
    r = R.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels=["SECRET"]).first()
    assert text[r.start : r.end] == r.value == "access_token_01"


def test_fusion_and_redaction(spark):
    schema = "doc_id long, start int, end int, label string, score double, source string, valid boolean"
    rows = spark.createDataFrame([(1, 0, 10, "PERSON", 0.99, "qwen", None), (1, 2, 6, "CN_ID_CARD", 0.5, "rule:cn_common", True), (1, 12, 14, "SECRET", 0.9, "x", False)], schema)
    kept = S.fuse(rows).collect()
    assert [(r.start, r.end, r.label) for r in kept] == [(2, 6, "CN_ID_CARD")]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("label")) for a, b, x in ((0, 3, "A"), (2, 4, "B"), (4, 5, "A"))])
    assert spark.range(1).select(S.redact(F.lit("😀bcdefg"), spans)).first()[0] == "<PII><A>fg"


def test_decoding(spark):
    tags = [("O", "I-X", "I-X", "B-Y", "I-X")]
    rows = [(1, i, i * 2, i * 2 + 1, t, 0.5) for i, t in enumerate(tags[0])]
    t = spark.createDataFrame(rows, "doc_id long, token_index int, start int, end int, tag string, score double")
    assert sorted((r.start, r.end, r.label) for r in D.decode_bio(t).collect()) == [(2, 5, "X"), (6, 7, "Y"), (8, 9, "X")]
    legal = lambda x: spark.range(1).select(D.bie_valid(F.array(*map(F.lit, x)))).first()[0]
    assert legal(["B-X", "I-X", "E-X", "B-Y", "O"]) and not legal(["B-X", "I-X", "O"]) and not legal(["E-X"])


def test_find_spans_like_re(spark):
    import re

    r = random.Random(3)
    texts = ["".join(r.choice("ab1 é😀\n") for _ in range(r.randint(0, 40))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", find_spans(F.col("t"), "[a1]+b?").alias("s")).collect()
    for row in got:
        assert [(s.start, s.end, s.value) for s in row.s] == [(*m.span(), m[0]) for m in re.finditer("[a1]+b?", texts[row.i])]


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), lambda df: df.checkpoint())
    assert {x.node: x.component for x in found.collect()} == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_windows_cover_and_own(spark):
    assert plan_windows(10, {5}, 6, 0.6, 0.25) == [(0, 5), (4, 10)]
    text = " ".join(f"w{i}." + ("\n" if i % 9 == 0 else "") for i in range(100))
    w = sorted(token_windows(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string"), 16).collect(), key=lambda x: x.window_id)
    assert w[0].owner_start == 0 and w[-1].owner_end == len(text)
    assert all(a.owner_end == b.owner_start and b.start < a.end for a, b in zip(w, w[1:], strict=False))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail u{i}@example.com now", i) for i in range(20)], "doc_id long, text string, k long")
    docs = docs.withColumn("ts", F.timestamp_seconds(F.col("k") * 120))
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("red", redact_stream(stream, labels=["EMAIL_ADDRESS"]), "append"), ("cnt", label_counts(stream, "ts", labels=["EMAIL_ADDRESS"]), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert {r.text for r in spark.table("red").collect()} == {"mail <EMAIL_ADDRESS> now"}
    assert spark.table("cnt").agg(F.sum("n")).first()[0] == 20


def test_bootstraps_over_all_documents(spark):
    """Every document is in the plan, and samples agree with draws made one by one."""
    import hashlib

    from spanloom import catalog

    q = catalog.queries()
    stats = [(r.tp, r.fp, r.fn) for r in q["h13_per_document"](spark, SF).orderBy("doc_id").collect()]
    n, found = len(stats), {r["sample"]: (r.tp, r.fp, r.fn) for r in q["h12_bootstrap_all"](spark, SF).collect()}
    assert n > 500 - 1 and sorted(found) == list(range(1000))

    def draw(counter, below):
        return int(hashlib.sha256(b"bootstrap\0" + (2).to_bytes(4) + b"42" + counter.to_bytes(16)).hexdigest(), 16) % below

    for sample in (0, 1, 999):
        rows = [stats[draw(i, n)] for i in range(sample * n, sample * n + n)]
        assert found[sample] == tuple(map(sum, zip(*rows, strict=True)))
    assert q["h18_paired_bootstrap_all"](spark, SF).first().samples == 1000
    draws = {r.counter: r.draw for r in q["h20_counter_draws_all"](spark, SF).collect()}
    orders = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    assert draws == {k: draw(k, 1000) for k in orders} and max(orders) >= 500
    assert q["g2_softmax_all"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_outcomes_without_join(spark, capsys):
    """Both sides' spans meet in one aggregate, not in a join that sorts them; repeats count once and null spans equal none."""
    from spanloom.operators.evaluation import outcomes

    kind = "doc_id long, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (1, 3, 4, "A"), (2, 0, 1, None), (2, 0, 1, None)], kind)
    pred = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 4, "B"), (2, 0, 1, None)], kind)
    found = outcomes(gold, pred)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        (1, 0, 2, "A", True, True), (1, 3, 4, "A", True, False), (1, 3, 4, "B", False, True), (2, 0, 1, None, True, False), (2, 0, 1, None, False, True),
    ]))
    found.explain()
    assert "Join" not in capsys.readouterr().out
