"""Windows that cut no gold span: worked examples, every rule's violation, and a plain walk over random documents."""

import random

import pytest

from spanloom.operators import safe_windows as W

SCHEMA = "doc_id long, text_length int, offsets array<struct<start:int,end:int>>, gold array<struct<start:int,end:int,label:string>>"


def characters(n):
    return [(i, i + 1) for i in range(n)]


def planned(spark, size, *docs, share=0.25):
    rows = [(i, n, characters(n) if offsets is None else offsets, [(*g, "X") if len(g) == 2 else g for g in gold]) for i, (n, offsets, gold) in enumerate(docs)]
    out = {i: [] for i in range(len(docs))}
    for r in W.safe_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), size, share).orderBy("doc_id", "window_id").collect():
        out[r.doc_id].append(r)
    return out


def test_worked_examples(spark):
    four = planned(
        spark, 4, (10, None, []), (10, None, [(3, 5)]), (6, [(0, 0), (0, 1), (1, 2), (2, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 0)], []), (0, [(0, 0), (0, 0)], []), (0, None, [])
    )
    assert [(r.token_start, r.token_end) for r in four[0]] == [(0, 4), (3, 7), (6, 10)] == [(r.start, r.end) for r in four[0]]
    assert four[0][0].owner_start == 0 and four[0][-1].owner_end == 10
    assert [(r.token_start, r.token_end) for r in four[1][:2]] == [(0, 3), (2, 6)]
    (owner,) = [r for r in four[1] if r.gold]
    assert tuple(owner.gold[0]) == (0, "X", 3, 5, 3 - owner.start, 5 - owner.start)
    assert [r.source_tokens for r in four[2]] == [[1, 2, 4, 5], [5, 6, 7]]
    assert four[3] == four[4] == []
    five = planned(spark, 5, (12, None, []), (9, None, [(5, 9)]))
    assert [(r.token_start, r.token_end) for r in five[0]] == [(0, 5), (4, 9), (8, 12)]
    assert [(r.token_start, r.token_end) for r in five[1]] == [(0, 5), (4, 9)] and sum(len(r.gold) for r in five[1]) == 1
    two = planned(spark, 2, (3, [(0, 1), (0, 1), (1, 2), (2, 3)], []))
    assert [(r.token_start, r.token_end, r.start, r.end) for r in two[0]] == [(0, 2, 0, 1), (2, 4, 1, 3)]
    six = planned(spark, 6, (16, None, [(13, 15), (7, 10), (1, 3)]))
    owned = [g for r in six[0] for g in r.gold]
    assert [g.span_index for g in owned] == [0, 1, 2] and [(g.start, g.end) for g in owned] == [(1, 3), (7, 10), (13, 15)]


def test_violations(spark):
    docs = [
        (2, [(0, 1), (0, 1), (0, 1), (1, 2)], []), (10, None, [(1, 8)]), (4, [(0, 1), (2, 3), (3, 4)], []), (4, [(0, 2), (1, 1), (1, 3), (0, 4)], []), (4, [(0, 2), (2, 4)], [(0, 5)]),
        (3, None, [(1, 2), (1, 2)]), (3, None, [(2, 4)]), (3, None, [(1, 2, " ")]), (3, [(0, 1), (1, 4)], []), (3, [], []), (3, [(1, 3)], []), (3, [(0, 2)], []), (None, [], []), (0, [], [(0, 0)]),
        (3, [(0, 3)], [(1, 2)]),
    ]
    got = {i: [v for r in rows for v in r.violations] for i, rows in planned(spark, 2, *docs).items()}
    assert got == {
        0: ["indivisible_range"], 1: ["gold_exceeds_window"], 2: ["character_gap"], 3: ["offsets_not_monotonic"], 4: ["gold_out_of_bounds"], 5: ["gold_duplicate"], 6: ["gold_out_of_bounds"],
        7: ["gold_label"], 8: ["offset_out_of_bounds"], 9: ["no_tokens"], 10: ["document_start_not_covered"], 11: ["document_end_not_covered"], 12: ["text_length"], 13: ["gold_out_of_bounds"], 14: [],
    }
    secret = spark.createDataFrame([(0, 4, [(0, 2), (2, 4)], [(0, 5, "PRIVATE-LABEL")])], SCHEMA)
    with pytest.raises(ValueError, match="gold_out_of_bounds x1") as error:
        W.require_windows(W.safe_windows(secret, 2))
    assert "PRIVATE" not in str(error.value)
    for share in (0.0, 0.19, 0.26, 1.0, float("nan")):
        with pytest.raises(ValueError, match="between 0.20 and 0.25"):
            W.safe_windows(secret, 2, share)
    with pytest.raises(ValueError, match="size"):
        W.safe_windows(secret, 0)


def plain(length, tokens, gold, size, share):
    """Try every cut by itself: ranges and owner edges, or None where no plan exists."""
    gold = sorted(gold)
    over = [[i for i, (a, e) in enumerate(tokens) if a < ge and e > gs] for gs, ge in gold]
    if any(len(c) > size for c in over):
        return None
    ok = [all(not (c[0] < b <= c[-1]) for c in over) and (b in (0, len(tokens)) or tokens[b][0] >= tokens[b - 1][1]) for b in range(len(tokens) + 1)]

    def end_of(start):
        return max((b for b in range(start + 1, min(start + size, len(tokens)) + 1) if ok[b]), default=None)

    out, start = [], 0
    while True:
        end = end_of(start)
        if end is None or (out and end <= out[-1][1]):
            return None
        out.append((start, end))
        if end == len(tokens):
            break
        want = end - min(max(1, round((end - start) * share)), end - start - 1)
        later = [c for c in range(start + 1, end + 1) if ok[c] and (end_of(c) or 0) > end]
        if not later:
            return None
        start = min(later, key=lambda c: (abs(c - want), c))
    edges = [0]
    for (_, e), (s, _) in zip(out, out[1:], strict=False):
        lo, hi = tokens[s][0], tokens[e - 1][1]
        safe = [c for c in range(lo, hi + 1) if not any(gs < c < ge for gs, ge in gold)]
        known = {lo, hi, (lo + hi) // 2, *(x for g in gold for x in g)}
        safe = [c for c in safe if c in known]
        if not safe:
            return None
        edges.append(min(safe, key=lambda c: (abs(c - (lo + hi) // 2), c)))
    edges.append(length)
    for (s, e), a, b in zip(out, edges, edges[1:], strict=False):
        if not tokens[s][0] <= a < b <= tokens[e - 1][1]:
            return None
    if any(sum(a <= gs and ge <= b for a, b in zip(edges, edges[1:], strict=False)) != 1 for gs, ge in gold):
        return None
    return [(s, e, a, b, sum(a <= gs and ge <= b for gs, ge in gold)) for (s, e), a, b in zip(out, edges, edges[1:], strict=False)]


def test_random_documents_against_a_plain_walk(spark):
    r = random.Random(8)
    docs = []
    for _ in range(400):
        tokens, at = [], 0
        for _ in range(r.randrange(1, 40)):
            if tokens and r.random() < 0.1:  # a token that shares its last character with the one before
                tokens.append((max(tokens[-1][0], at - 1), at))
                continue
            n = r.choice([1, 1, 2, 3, 5])
            tokens.append((at, at + n))
            at += n
        gold = {(a, min(at, a + r.randrange(1, 9))) for a in (r.randrange(at) for _ in range(r.randrange(6)))}
        docs.append((at, tokens, list(gold)))
    size = 6
    seen = [0, 0]
    for i, rows in planned(spark, size, *docs).items():
        want = plain(*docs[i], size, 0.25)
        seen[want is None] += 1
        if want is None:
            assert len(rows) == 1 and rows[0].window_id is None and rows[0].violations
        else:
            assert [(w.token_start, w.token_end, w.owner_start, w.owner_end, len(w.gold)) for w in rows] == want
    assert min(seen) > 20


def test_tokens_cover_the_text(spark):
    texts = ["  two words \n", "", "one", "𝒳 y\n\n z", "   "]
    rows = W.covering_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    for r in rows:
        assert "".join(r.text[a:e] for a, e in r.offsets) == r.text and all(a < e for a, e in r.offsets) and r.text_length == len(r.text)
        assert [r.text[a:e].strip() for a, e in r.offsets if r.text[a:e].strip()] == r.text.split()


def test_chunks_against_a_plain_walk(spark):
    """Windows at structural marks, token by token in plain Python, over odd white space and characters beyond the BMP."""
    import re

    from spanloom.operators.windows import token_windows

    r = random.Random(1)
    letters = [*"ab. \n\t。！?;；　\x85x𝒳", *["word ", "long "] * 3]
    docs = [(i, "".join(r.choice(letters) for _ in range(r.randrange(200)))) for i in range(300)] + [(900, None), (901, ""), (902, "  \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size in (3, 8, 20):
        want = []
        for i, t in docs:
            words = [m.span() for m in re.finditer(r"\S+", t or "")]
            if not words:
                continue
            ends_at = {m.end() for m in re.finditer(r"[\n。！？!?；;\t]", t)}
            stops = [k for k, (_, e) in enumerate(words, 1) if any(e <= x <= (words[k][0] if k < len(words) else e) for x in ends_at)]
            spans, first = [], 0
            while True:
                last = min(first + size, len(words))
                if last < len(words):
                    last = max((k for k in stops if first + max(1, int(size * 0.6)) <= k <= last), default=last)
                spans.append((first, last))
                if last == len(words):
                    break
                first = last - min(max(1, round((last - first) * 0.25)), last - first - 1)
            text = [(words[a][0], words[b - 1][1]) for a, b in spans]
            text[0], text[-1] = (0, text[0][1]), (text[-1][0], len(t))
            if len(text) == 1:
                text = [(0, len(t))]
            cuts = [0, *(b[0] if b[0] >= a[1] else (a[1] + b[0]) // 2 for a, b in zip(text, text[1:], strict=False)), len(t)]
            want += [(str(i), k, *text[k], cuts[k], cuts[k + 1], *spans[k]) for k in range(len(spans))]
        assert sorted(tuple(x) for x in token_windows(df, size).collect()) == sorted(want)
