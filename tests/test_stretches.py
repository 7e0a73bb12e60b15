"""Matching over stretches of overlapping spans, against plain walks over whole documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.operators import evaluation as E
from spanloom.operators import stretches

SPAN = "doc_id long, start int, end int, label string"
ODD = [(None, 1, 4, "A"), (3, None, 4, "A"), (3, 1, None, "B"), (3, 5, 5, "A"), (3, 6, 2, "B"), (3, 2, 9, None)]


def some(seed, n, docs=9):
    r = random.Random(seed)
    out = {(r.randrange(docs), s, s + r.randint(1, 9), r.choice("AB")) for s in (r.randrange(70) for _ in range(n))}
    return sorted(out) + [(77, 3 * i, 3 * i + r.choice((4, 7)), "A") for i in range(60)] + ODD  # document 77 is one long stretch


@pytest.fixture(params=[10_000, 7])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_matching(gold, pred, minimum, same_label):
    """Per document: all pairs; those whose spans meet no other at once, the others along augmenting paths."""
    pairs = []
    for g in set(gold):
        for p in set(pred):
            if None in g[:3] or None in p[:3] or g[0] != p[0] or (same_label and (g[3] is None or g[3] != p[3])):
                continue
            shared = min(g[2], p[2]) - max(g[1], p[1])
            if g[1] < g[2] and p[1] < p[2] and shared > 0 and (iou := shared / (max(g[2], p[2]) - min(g[1], p[1]))) >= minimum:
                pairs.append((g, p, iou))
    times = Counter(x for g, p, _ in pairs for x in (("g", g), ("p", p)))
    free = [(g, p) for g, p, _ in pairs if times["g", g] == times["p", p] == 1]
    key = lambda s: (s[1], s[2], s[3] or "")
    beside = defaultdict(lambda: defaultdict(list))
    for g, p, _ in sorted((x for x in pairs if x[:2] not in free), key=lambda r: (r[0][1:3] != r[1][1:3], -r[2], key(r[1]))):
        beside[g[0]][g].append(p)
    return Counter(free + [m for own in beside.values() for m in E._matching(own, sorted(own, key=lambda g: (len(own[g]), key(g)))).items()])


@pytest.mark.parametrize("minimum, same_label", [(0.0, False), (0.5, True)])
def test_matching_by_stretches(spark, batches, minimum, same_label):
    gold, pred = some(1, 150), some(2, 150)
    gold, pred = gold + gold[:20], pred + gold[30:60]
    a, b = spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, SPAN)
    want = plain_matching(gold, pred, minimum, same_label)
    found = E.match_overlaps(a, b, minimum, same_label)
    as_pair = lambda r: ((int(r.doc_id), r.g_start, r.g_end, r.g_label), (int(r.doc_id), r.p_start, r.p_end, r.p_label))
    assert Counter(map(as_pair, found.collect())) == want and len(want) > 60
    rows = E.match_overlaps(a, b, minimum, same_label, unmatched=True).collect()
    assert Counter(as_pair(r) for r in rows if r.g and r.p) == want
    for side, own, k in (("g", gold, 0), ("p", pred, 1)):
        alone = [(r.doc_id and int(r.doc_id), *(r[f"{side}_{c}"] for c in ("start", "end", "label"))) for r in rows if r.g != r.p and r[side]]
        assert Counter(alone) == Counter(set(own) - {m[k] for m in want})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_pairs_come_in_blocks_of_whole_stretches(monkeypatch):
    monkeypatch.setattr(stretches, "PAIRS", 5)
    number = np.repeat(np.arange(1, 9), [1, 2, 5, 1, 3, 1, 4, 2])
    start, end = np.arange(len(number)), np.arange(len(number)) + 3
    blocks = list(stretches.overlaps(number, start, end))
    assert [b[0] for b in blocks[1:]] == [b[1] for b in blocks[:-1]] and blocks[-1][1] == len(number) and len(blocks) > 2
    assert all(a == 0 or number[a] != number[a - 1] for a, *_ in blocks)
    near = {(i, j) for i in range(len(number)) for j in range(i + 1, len(number)) if number[i] == number[j] and start[j] < end[i]}
    assert near == {x for _, _, i, j in blocks for x in zip(i.tolist(), j.tolist(), strict=True)}


def test_confusion_counts_every_span(spark):
    gold, pred = some(3, 120), some(4, 120)
    rows = E.confusion(spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, SPAN)).collect()
    pairs = plain_matching(gold, pred, 0.0, False)
    want = Counter((g[3], p[3]) for g, p in pairs)
    want += Counter((g[3], "__MISSED__") for g in set(gold) - {g for g, _ in pairs})
    want += Counter(("__SPURIOUS__", p[3]) for p in set(pred) - {p for _, p in pairs})
    assert {(r.gold_label, r.pred_label): r.n for r in rows} == want
