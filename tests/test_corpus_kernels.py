"""Similarity joins, packs, first-wins records, label search and fits of temperatures against plain Python."""

import itertools
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import assembly as Y
from spanloom.operators import calibration as C
from spanloom.operators import decoding as D
from spanloom.operators import near_pairs as N
from spanloom.plans import fixtures as X
from tests.conftest import SF

# near pairs ----------------------------------------------------------------------------------------------------------


def grams(text, size, letters):
    t = unicodedata.normalize("NFKC", text or "").casefold() if letters else "".join((text or "").split()).casefold()
    t = "".join(c for c in t if c.isalnum()) if letters else t
    return frozenset(t[i : i + size] for i in range(max(1, len(t) - size + 1))) if t else frozenset()


@pytest.mark.parametrize("size,letters", [(5, False), (3, True)])
def test_documents_against_all_pairs(spark, monkeypatch, size, letters):
    """Every pair of the small table by brute force; blocks and postings so small that all their edges are met."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "POSTINGS", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: grams(t, size, letters) for d, t in rows.items()}
    some = sorted(d for d in sets if sets[d])
    near = {(a, b) for a, b in itertools.combinations(some, 2) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    members, classes, links = N.near_classes(docs.repartition(5), X.store, N.skeleton if letters else N.folded, size)
    rep = {r.doc_id: r.rep for r in members.collect()}
    assert rep == {d: min(x for x in some if sets[x] == sets[d]) for d in some}
    found = {(r.a, r.b): (r.shared, r.na, r.nb) for r in links.collect()}
    assert set(found) == {(a, b) for a, b in near if sets[a] != sets[b] and rep[a] == a and rep[b] == b}
    assert all(v == (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for (a, b), v in found.items())
    label = {d: d for d in some}
    for _ in some:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component for r in N.near_groups(members, links, X.store).collect()} == label
    if not letters:
        audit = N.pair_audit(docs, classes, links, members, 0.75).first()
        copies = Counter(rows.values())
        texts = {t: grams(t, size, letters) for t in copies if t}
        alike = sum(len(x & y) >= 0.75 * len(x | y) for x, y in itertools.combinations([s for s in texts.values() if s], 2))
        assert (audit.n_docs, audit.exact_pairs, audit.near_pairs) == (len(rows), sum(n * (n - 1) // 2 for n in copies.values()), alike)


def test_common_grams_make_no_candidates(spark):
    """Texts over few letters share most rare grams of a prefix with many others, but only near copies are compared."""
    import random

    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh", k=r.randrange(200, 300))) for _ in range(400)]
    texts[7], texts[9] = texts[300][:-15], texts[301] + "abc"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, classes, links = N.near_classes(docs, X.store, N.skeleton, 3)
    assert {(x.a, x.b) for x in N.candidates(classes, 0.75).collect()} == {(7, 300), (9, 301)} == {(x.a, x.b) for x in links.collect()}


def test_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "ab"), (5, "AB"), (6, "abcd efgh ijkl"), (7, "abcdefghijkl"), (8, "Straße und mehr davon"), (9, "strasse und mehr davon"), (10, "x" * 200_000)]
    members, _, links = N.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), X.store)
    assert {r.doc_id: r.rep for r in members.collect()} == {4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10} and links.count() == 0
    empty = N.near_classes(spark.createDataFrame([], "doc_id long, text string"), X.store)
    assert [t.count() for t in empty] == [0, 0, 0]
    assert N.gram_hashes("abcab", 3).tolist() == sorted({ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in ("abc", "bca", "cab")})


def test_a_text_goes_to_the_blocks_of_its_size(spark, monkeypatch):
    """What is shuffled is a text for each block that may hold its like, not a set for each pair of blocks."""
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=int(20 * 1.012**i))) for i in range(400)] * 2
    docs = spark.createDataFrame([(i, t + "xyz" * (i >= 400)) for i, t in enumerate(texts)], "doc_id long, text string")
    _, classes, links = N.near_classes(docs, X.store)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "BINNED", 2048)
    sent, apart = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: sent.append(df) or apart(df, f, schema))
    found = N.candidates(classes, 0.75)
    pairs = {(x.a, x.b) for x in found.collect()}
    assert pairs == {(x.a, x.b) for x in links.collect()} and {(i, i + 400) for i in range(50, 400)} <= pairs
    passed = sent[0].groupBy("rep").count().agg(F.max("count"), F.sum("count")).first()
    assert passed[0] <= 2 + N.BLOCKS // 2 and passed[1] <= 8 * 800


def test_groups_need_no_link_within_a_group(spark):
    r = random.Random(6)
    base = ["".join(r.choices("abcdefghijklmnop", k=300)) for _ in range(5)]
    chain = [base[0][3 * i : 3 * i + 200] for i in range(30)]  # each is near its neighbours and not near the last
    texts = [*chain, *(base[i % 4 + 1] + "q" * (1 + i // 4) for i in range(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for spanning in (False, True):
        members, _, links = N.near_classes(docs, X.store, N.skeleton, 3, spanning=spanning)
        found[spanning] = links.count(), {x.doc_id: x.component for x in N.near_groups(members, links, X.store).collect()}
    assert found[True][1] == found[False][1] and len(set(found[True][1].values())) == 5
    assert found[True][0] < len(texts) < found[False][0]


def test_blocks_cover_all_sizes_that_fit():
    sizes = [(b, 1 + b * 7 % 40, (1 + b * 7 % 40) * (b + 2), b + 1, b + 2) for b in range(0, 90, 2)] + [(95, 5000, 5000 * 100, 100, 101)]
    plan = N._dealt(sizes, 0.75)
    spans = {b: (first, first + parts - 1, low) for b, first, parts, low in plan}
    assert [first for _, first, _, _ in plan] == sorted(first for _, first, _, _ in plan)
    for bucket, _, _, least, _ in sizes:
        for other, _, _, _, largest in sizes:
            if other <= bucket and largest >= 0.75 * least:  # such classes may be alike: the larger passes by the smaller's blocks
                assert spans[bucket][2] <= spans[other][0] and spans[other][1] <= spans[bucket][1]


# packs and records ---------------------------------------------------------------------------------------------------


def hashed(docs, seed):
    import hashlib

    return sorted(docs, key=lambda d: (hashlib.sha256(f"{seed}:{d[0]}".encode()).hexdigest(), d[0]))


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_packs_are_those_of_one_walk(spark, block):
    r = random.Random(block)
    docs = [(i, r.choice([1, 5, 30, 60, 100, 127, 128, 150, 192, 193, 400])) for i in range(400)]
    df = spark.createDataFrame([*docs, (9999, 0)], "doc_id long, n int").repartition(5)
    want, open_, size, pack = {}, [], 0, -1

    def close():
        if open_ and 128 <= size <= 192:
            want.update({(pack, i): d for i, d in enumerate(open_)})

    for d, n in hashed(docs, "s"):
        if open_ and size + n > 192:
            close()
            open_, size = [], 0
        if not open_:
            pack += 1
        open_, size = [*open_, d], size + n
        if size >= 128:
            close()
            open_, size = [], 0
    packs = Y.greedy_packs(df, "s", X.store, block=block).collect()
    # blocks are runs of places, and places leave gaps between partitions; the packs are the same
    assert {(p.pack, p.position): p.doc_id for p in packs} == want and len(packs) == len(want)


def test_first_record_wins(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(60)]), r.choice([None, *"abcdefghijklmnopqrstuvwxyz"]) if r.random() < 0.5 else f"t{r.randrange(90)}") for i in range(500)]
    chain = [(1000 + i, 10_000 + i // 2, f"c{(i + 1) // 2}") for i in range(3000)]
    rows += chain
    ids, texts, want = set(), set(), []
    for at, d, t in sorted(rows):
        if d not in ids and t not in texts:
            want.append(at)
            ids.add(d)
            texts.add(t)
    df = spark.createDataFrame(rows, "at long, doc_id long, text string").repartition(4)
    for rounds in (0, 1, 3):
        assert sorted(x.at for x in Y.unique_records(df, "at", X.store, rounds).collect()) == want


# labels --------------------------------------------------------------------------------------------------------------


def legal(path):
    open_, inside = None, False
    for tag in path:
        kind, _, name = tag.partition("-")
        if kind in "OB":
            if open_ and inside:
                return False
            open_, inside = (name if kind == "B" else None), False
        elif name != open_:
            return False
        else:
            open_, inside = (open_, True) if kind == "I" else (None, False)
    return not (open_ and inside)


def test_best_legal_paths(spark):
    types, r = ["P", "Q"], np.random.default_rng(3)
    labels = D.bie_labels(types)
    assert labels == ["O", "B-P", "I-P", "E-P", "B-Q", "I-Q", "E-Q"]
    rows = []
    for i in range(60):
        n = int(r.integers(0, 5))
        rows.append((i, (r.normal(size=(n, 7)) * 3).round(2).tolist(), (r.random(n) > 0.15).tolist()))
    rows += [(100, [[0.0, 8.0, 9.0, -4.0, -9.0, -9.0, -9.0], [7.0, -3.0, 1.0, 0.0, -9.0, -9.0, -9.0]], [True, True]), (101, [[0.0] * 6], [True]), (102, [[float("nan")] * 7], [True]), (103, None, None), (104, [[0.0] * 7] * 3, None), (105, [[1.0] * 7], [True, True])]
    df = spark.createDataFrame(rows, "doc_id long, logits array<array<double>>, valid array<boolean>").repartition(3)
    got = {int(x.doc_id): x for x in D.bie_viterbi(df, types, tokens=8).collect()}
    only = {int(x.doc_id): x for x in D.bie_viterbi(df, types, scope=["Q"]).collect()}
    for i, logits, valid in rows[:60]:
        for found, names in ((got[i], labels), (only[i], ["O", "B-Q", "I-Q", "E-Q"])):
            score = lambda p: sum((0.0 if t == "O" else -math.inf) if not ok else x[labels.index(t)] for t, x, ok in zip(p, logits, valid, strict=True))  # noqa: B023, E731
            best = max((score(p) for p in itertools.product(names, repeat=len(logits)) if legal(p)), default=0.0)
            assert legal(found.tags) and len(found.tags) == len(logits) and score(found.tags) == pytest.approx(best) and found.violation is None
    assert got[100].tags == ["B-P", "O"] and got[104].tags == ["O", "O", "O"]
    assert all(got[i].tags is None and got[i].violation == "logits" for i in (101, 102, 103, 105))
    big = [f"T{i}" for i in range(24)]
    wide = spark.createDataFrame([(i, r.normal(size=(30, 73)).tolist(), [True] * 30) for i in range(20)], "doc_id long, logits array<array<double>>, valid array<boolean>")
    assert len(D.bie_labels(big)) == 73 and all(legal(x.tags) and len(x.tags) == 30 for x in D.bie_viterbi(wide, big).collect())


# temperatures --------------------------------------------------------------------------------------------------------


def plain_fit(rows):
    z = [(math.log(p) - math.log1p(-p), y) for p, y in ((min(max(s, 1e-6), 1 - 1e-6), y) for s, y in rows)]

    def loss(log_t):
        return sum(max(x, 0.0) + math.log1p(math.exp(-abs(x))) - y * x for x, y in ((v / math.exp(log_t), y) for v, y in z))

    a, b, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(96):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def test_temperatures_of_labels(spark):
    r = random.Random(6)
    rows = [(label, s := round(r.random() ** power, 2), r.random() < s ** (1 / heat)) for label, power, heat in (("A", 1, 1), ("B", 0.3, 3), ("C", 2, 0.4)) for _ in range(400)]
    rows += [("few", 0.5, True)] * 3 + [("same", 0.7, True)] * 50 + [("A", 0.0, True), ("A", 1.0, False)]
    df = spark.createDataFrame(rows, "label string, score double, positive boolean")
    got = {x.label: x for x in C.fit_temperatures(df, min_rows=20, min_class=5).collect()}
    for label in ("A", "B", "C"):
        own = [(s, y) for x, s, y in rows if x == label]
        assert got[label].temperature == pytest.approx(plain_fit(own), rel=1e-3) and got[label].status == "fitted"
        assert (got[label].n, got[label].positives) == (len(own), sum(y for _, y in own))
    assert got[None].temperature == pytest.approx(plain_fit([x[1:] for x in rows]), rel=1e-3)
    assert C.fit_temperature(df) == pytest.approx(got[None].temperature, rel=1e-6)
    assert [(got[x].temperature, got[x].status) for x in ("few", "same")] == [(1.0, "insufficient_statistics")] * 2
    none = C.fit_temperatures(df.limit(0)).collect()
    assert [(x.label, x.n, x.temperature) for x in none] == [(None, 0, 1.0)]
    # the likelihood falls by fitting, as does the calibration error of overconfident scores
    flat = df.where("label = 'B'")
    before, after = C.calibration_error(flat).first().ece, C.calibration_error(flat.withColumn("score", C.scaled(F.col("score"), F.lit(got["B"].temperature)))).first().ece
    assert after <= before + 0.02
