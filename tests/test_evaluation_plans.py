"""Plans of the evaluation steps: documents are dealt once, and no join or sort holds more than it must."""

from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.operators import bootstrap as B
from spanloom.operators import decoding as D
from spanloom.operators import evaluation as E
from spanloom.plans import fixtures as X
from tests.conftest import SF

SPAN = "doc_id long, start int, end int, label string"


def plan(spark, name):
    """The optimized plan and, with adaptive execution off, the physical one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = catalog.queries()[name](spark, SF)._jdf.queryExecution()
        return run.optimizedPlan().toString(), run.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boundaries_meet_in_one_aggregate(spark):
    logical, physical = plan(spark, "h9_boundary_counts")
    assert "Join" not in logical and "Sort" not in physical
    assert physical.count("Exchange hashpartitioning") == 2  # the two sides, dealt by document


def test_boundaries_of_repeated_and_null_spans(spark):
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "B"), (1, 0, 2, "A"), (None, 0, 2, "A"), (2, 5, 7, None)], SPAN)
    pred = spark.createDataFrame([(1, 0, 2, "C"), (None, 0, 2, "A"), (2, 5, 7, None), (2, 5, 7, "A")], SPAN)
    assert tuple(E.boundary_counts(gold, pred).first()) == (2, 4, 4)


def test_characters_come_from_one_walk(spark):
    for name in ("h8_character_counts", "h16_redaction_rates"):
        logical, physical = plan(spark, name)
        assert "Join" not in logical
        assert physical.count("Sort [") == 1 and physical.count("Exchange hashpartitioning(doc_id") == 2


def test_characters_against_sets_of_places(spark):
    rows = [(d, (d * 7 + i * 5) % 23, (d * 7 + i * 5) % 23 + i % 4, "AB"[i % 3 % 2]) for d in range(20) for i in range(7)]
    gold, pred = rows[::2], [(d, s + d % 3, e + i % 2 + d % 3, x) for i, (d, s, e, x) in enumerate(rows[1::3])] + rows[:40:5]
    frames = [spark.createDataFrame(x, SPAN) for x in (gold, pred)]
    for labels, by in ((True, lambda r: (r[0], r[3])), (False, lambda r: r[0])):
        g, p = ({(by(r), c) for r in x for c in range(r[1], r[2])} for x in (gold, pred))
        total = E.character_counts(*frames, by_label=labels)
        total = (total.where(F.col("label").isNull()) if labels else total).first()
        assert (total.tp, total.fp, total.fn) == (len(g & p), len(p - g), len(g - p))
    none = spark.createDataFrame([(None, 0, 4, "A"), (3, None, 4, "A"), (3, 2, None, "A")], SPAN)
    assert tuple(E.character_counts(none, none, by_label=False).select("tp", "fp", "fn").first()) == (0, 4, 4)


def test_no_text_goes_through_the_sort_of_tokens(spark):
    logical, physical = plan(spark, "f9_decode_sparse")
    ordered = [x for x in logical.splitlines() if "RepartitionByExpression" in x]
    assert len(ordered) == 1 and "substr" not in logical.split("RepartitionByExpression")[0]
    texts = {1: "ab - \tcd ef.gh", 2: "\u00e4\U0001f600 \x0b-x  y", 3: None}
    spans = {1: [(0, 2), (6, 8), (9, 11), (12, 14)], 2: [(0, 2), (5, 6), (8, 9)], 3: [(0, 1), (2, 3)]}
    rows = [(d, i, a, b, "I-X" if i else "B-X", 0.5, texts[d]) for d, x in spans.items() for i, (a, b) in enumerate(x)]
    tokens = spark.createDataFrame(rows, "doc_id long, token_index int, start int, end int, tag string, score double, text string")
    found = sorted((r.doc_id, r.start, r.end, r.bridges) for r in D.decode_sparse(tokens, structured=("X",)).collect())
    assert found == [(1, 0, 11, 2), (1, 12, 14, 0), (2, 0, 9, 2), (3, 0, 1, 0), (3, 2, 3, 0)]
    assert {r.bridges for r in D.decode_sparse(tokens).collect()} == {0}


def test_comparators_share_one_pass(spark):
    """Gates of both comparators at once are those of each alone, and the spans are gone over once."""
    made = []

    def store(df):
        made.append(df)
        return X.store(df)

    docs, gold, pred = X.docs(spark, SF), X.gold(spark, SF).where("doc_id % 3 > 0"), X.pred(spark, SF)
    others = {"second": X.second(spark, SF).where("label <> 'ZZ'"), "even": pred.where("start % 2 = 0")}
    get = lambda names: sorted(tuple(r) for r in B.superiority(docs, gold, pred, {n: others[n] for n in names}, 5, "42", store).collect())
    both = get(["second", "even"])
    assert len(made) == 2 and len(both) == 6
    assert both == sorted(get(["second"]) + get(["even"]))


def test_paired_bootstrap_takes_all_samples(spark):
    assert catalog.queries()["h18_paired_bootstrap"](spark, SF).first().samples == 1000


def test_superiority_takes_all_samples(spark):
    assert {(r.metric, r.samples) for r in catalog.queries()["h19_superiority"](spark, SF).collect()} == {(m, 1000) for m in ("micro", "macro", "clean_rate")}


def test_comparators_take_all_samples(spark, monkeypatch):
    monkeypatch.setattr(B, "passes_all", lambda gates: gates.select("comparator", "samples").distinct())
    assert {tuple(r) for r in catalog.queries()["h21_all_comparators"](spark, SF).collect()} == {("second", 1000), ("even", 1000)}


def test_documents_are_counted_once_for_a_bootstrap(spark, monkeypatch):
    """Draws need the number of documents, which comes from the written counts and not from a second pass over the spans."""
    read = []
    monkeypatch.setattr(X, "_lines", lambda *args, own=X._lines: read.append(1) or own(*args))
    counted = []
    monkeypatch.setattr(B, "resampled_sums", lambda stats, columns, sizes, *rest: counted.append((stats._jdf.queryExecution().optimizedPlan().toString(), sizes)) or stats)
    monkeypatch.setattr(B, "paired_difference", lambda sums: sums)
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df, own=type(spark.range(1)).count: counted.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    catalog.queries()["h18_paired_bootstrap"](spark, SF)
    assert "o_orderkey" not in counted[0] and "l_orderkey" not in counted[0]
    assert len(read) == 3  # gold once, and each system


def test_report_is_whole(spark):
    found = {r.metric: r.value for r in catalog.queries()["h13_report"](spark, SF).collect()}
    gold, pred = X.gold(spark, SF).where("doc_id % 3 > 0"), X.pred(spark, SF)
    for group, counts in (("relaxed", E.relaxed_counts(gold, pred)), ("character", E.character_counts(gold, pred))):
        total, macro = counts.where("label IS NULL").first(), E.macro(counts).first()
        assert [found[f"{group}_{c}"] for c in ("tp", "fp", "fn", "f1")] == [total.tp, total.fp, total.fn, round(total.f1, 9)]
        assert [found[f"{group}_{c}"] for c in ("macro_f1", "macro_f2")] == [round(macro.macro_f1, 9), round(macro.macro_f2, 9)]
    assert found["relaxed_tp"] > found["strict_tp"]
