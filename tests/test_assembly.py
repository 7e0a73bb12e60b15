"""Records on disk, splits, packing and ids against plain Python."""

import hashlib
import hmac
import json
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assembly as Y
from spanloom.operators import evaluation as E
from spanloom.plans import fixtures as X
from spanloom.sources import converters as K
from spanloom.sources import records as A


def test_files_keep_line_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"doc_id":"a","spans":[]}', "", "oops", '{"doc_id":"b","spans":[{"start":0,"end":2,"label":"X","score":0.5}]}', '{"doc_id":"a","spans":[{"start":3,"end":1,"label":"X"}]}']
    (tmp_path / "in" / "p.jsonl").write_text("\n".join(lines) + "\n")
    parsed = A.parse_predictions(A.numbered_lines(spark, f"file://{tmp_path}/in"))
    got = {r.line: r.violations for r in parsed.collect()}
    assert got == {1: [], 3: ["not_valid_json"], 4: [], 5: ["span_invalid"]}
    assert [r.doc_id for r in A.repeated_ids(parsed).collect()] == ["a"]
    with pytest.raises(ValueError, match="not_valid_json x1, span_invalid x1"):
        A.require_clean(parsed)
    out = f"file://{tmp_path}/out"
    good = parsed.where(F.size("violations") == 0)
    assert A.write_lines(A.prediction_lines(good, good.select("doc_id", F.inline("spans"))), out) == 2
    assert {json.loads(r.value)["doc_id"] for r in spark.read.text(out).collect()} == {"a", "b"}


def test_pinned_schema_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    assert A.read_pinned(spark, path, "id long", 3).count() == 3
    with pytest.raises(ValueError, match="schema"):
        A.read_pinned(spark, path, "id int")
    with pytest.raises(ValueError, match="3 rows"):
        A.read_pinned(spark, path, "id long", 4)


def most_pairs(beside, left):
    """The size of a maximum matching, by trying every order."""
    best = 0
    for order in permutations(left):
        used, n = set(), 0
        for g in order:
            free = next((p for p in beside.get(g, ()) if p not in used), None)
            if free is not None:
                used.add(free)
                n += 1
        best = max(best, n)
    return best


def test_matching_is_largest(spark):
    rows = [(d, (d * 7 + i * 3) % 11, (d * 7 + i * 3) % 11 + 2 + (i * d) % 4, "X") for d in range(12) for i in range(5)]
    gold = spark.createDataFrame(sorted(set(rows)), "doc_id long, start int, end int, label string")
    pred = gold.select("doc_id", (F.col("start") + F.col("end") % 3).cast("int").alias("start"), (F.col("end") + 1).alias("end"), "label").distinct()
    pairs, found = defaultdict(lambda: defaultdict(list)), defaultdict(int)
    for r in E.overlapping_pairs(gold, pred).collect():
        pairs[r.g_doc][(r.g_start, r.g_end)].append((r.p_start, r.p_end))
    for r in E.match_overlaps(gold, pred).collect():
        found[int(r.doc_id)] += 1
    assert {d: most_pairs(b, list(b)) for d, b in pairs.items()} == dict(found)


def test_packs(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 90 + 1).cast("int").alias("n"))
    n = {r.doc_id: r.n for r in docs.collect()}
    packs = defaultdict(list)
    for r in Y.greedy_packs(docs, "s", X.store, block=32).orderBy("pack", "position").collect():
        packs[r.pack].append(r.doc_id)
    assert len(packs) > 50 and all(128 <= sum(n[d] for d in p) <= 192 for p in packs.values())
    assert all(sum(n[d] for d in p[:-1]) < 128 for p in packs.values())
    assert len({d for p in packs.values() for d in p}) == sum(map(len, packs.values()))
    low = defaultdict(list)
    for r in Y.low_density_packs(docs.withColumn("positive", F.col("doc_id") % 6 == 0), "s", X.store, block=90).orderBy("pack", "position").collect():
        low[r.pack].append(r.doc_id)
    assert low and all([d % 6 == 0 for d in p] == [True] + [False] * (len(p) - 1) and 128 <= sum(n[d] for d in p) <= 192 for p in low.values())


def test_splits_keep_their_promises(spark):
    rows = [(i, i % 4 + 1, ["a", "b" if i % 9 else "rare"], f"{i * 7919 % 1000:04x}", i % 2, i // 2 % 2) for i in range(200)]
    c = spark.createDataFrame(rows, "component long, size long, labels array<string>, digest string, n_clean long, n_hard long")
    targets = {"train": 0.8, "validation": 0.1, "test": 0.1}
    dealt = {r.component: r.split for r in Y.coverage_split(c, targets, ("validation", "test"), "7").collect()}
    assert len(dealt) == 200
    for split in ("validation", "test"):
        assert {x for i, _, ls, *_ in rows if dealt[i] == split for x in ls} == {"a", "b", "rare"}
    with pytest.raises(ValueError, match="not enough"):
        Y.coverage_split(c.where("component < 9"), targets, ("validation", "test"), "7")
    balanced = {r.component: r.split for r in Y.balanced_split(c, targets, "7").collect()}
    total = sum(r[1] for r in rows)
    for split, share in targets.items():
        assert abs(sum(r[1] for r in rows if balanced[r[0]] == split) - share * total) <= 4


def test_opaque_ids(spark):
    got = Y.opaque_ids(spark.createDataFrame([("x", 1), ("x", None)], "a string, b int"), b"k", "grp", ["a", "b"], protocol=b"p").collect()
    framed = b"p" + (3).to_bytes(4, "big") + b"grp" + b"".join(len(v).to_bytes(8, "big") + v for v in (b"x", b"1"))
    digest = hmac.new(b"k", framed, hashlib.sha256).digest()[:18]
    import base64

    assert got[0].opaque == "grp_v2_" + base64.urlsafe_b64encode(digest).decode() and got[1].opaque is None
    assert Y.expanded(b"k", b"c") == hmac.new(b"k", b"c\1", hashlib.sha256).digest() and Y.expanded(b"k", b"c", 40)[:32] == Y.expanded(b"k", b"c")
    with pytest.raises(ValueError, match="32 bytes"):
        Y.Deriver.of(b"short")


def test_isolated_ids(spark):
    """One id per split, scope and relation whatever the label; seeds differ between labels; broken parts give none."""
    rows = [("train", "a", "L", "s"), ("train", "a", "M", "s"), ("test", "a", "L", "s"), ("train", "a", "L", "t"), ("train", "", "L", "s"), ("train", None, "L", "s"), (" train", "a", "L", "s"), ("train", "a", None, "s")]
    key = b"k" * 32
    got = Y.isolated_ids(spark.createDataFrame(rows, "split string, relation string, label string, scope string"), key).collect()
    ids, seeds = [r.relation_id for r in got], [r.seed for r in got]
    assert ids[0] == ids[1] and len(set(ids[:4])) == 3 and len(set(seeds[:4])) == 4 and ids[4:] == seeds[4:] == [None] * 4
    frame = lambda *ps: b"".join(len(p).to_bytes(8, "big") + p for p in ps)
    mac = lambda k, m: hmac.new(k, m, hashlib.sha256).digest()
    domain = lambda name: b"pii-zh/surrogate/v2/" + name
    root = mac(domain(b"hkdf-extract"), key)
    split = mac(root, frame(domain(b"split-key"), b"train") + b"\1")
    relation = mac(mac(root, frame(domain(b"relation-key")) + b"\1"), frame(domain(b"relation-mac"), b"s", b"a"))
    assert seeds[0] == mac(mac(split, frame(domain(b"label-key"), b"L") + b"\1"), frame(domain(b"seed"), b"s", relation))
    import base64

    name = mac(mac(split, frame(domain(b"relation-id-key")) + b"\1"), frame(domain(b"relation-id"), b"s", relation))[:18]
    assert ids[0] == "rel_v2_" + base64.urlsafe_b64encode(name).decode()


def test_guards(spark):
    with pytest.raises(ValueError, match="aggregate"):
        Y.require_aggregate(spark.range(1).select(F.col("id").alias("doc_id")), ("doc_id",))
    assert Y.canonical_hash({"b": 1, "a": [None, "ü"]}) == hashlib.sha256(b'{"a":[null,"\\u00fc"],"b":1}').hexdigest()
    with pytest.raises(Exception, match="source value"):
        K.render_dialogue(spark.createDataFrame([(1, 1, "user", "ab")], "conv_id long, turn long, role string, text string"), replacements={"a": "ba"}).collect()
    doubled = X.docs(spark, "/root/testdata/sf0.001").select("doc_id").limit(3).withColumn("text", F.lit("t")).withColumn("at", F.col("doc_id"))
    assert Y.unique_records(doubled, "at", X.store).count() == 1
