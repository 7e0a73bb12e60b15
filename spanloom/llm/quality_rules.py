"""Quality rules as a learned decision list, in DataFrame expressions only.

``text_profile`` measures a text, ``learn_decision_list`` grows and prunes threshold
conjunctions by sequential covering, and ``DecisionList.verdict`` emits the ordered list
as one Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE_CLASS, table

#: Measurements that a rule may test, each a ratio or a size that does not depend on the corpus.
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "upper_share", "digit_share", "bangs_per_word",
    "distinct_share", "repeat_share", "dup_line_share", "words_per_line",
)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def repeated_word_count(words: Column, width: int = 5) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash; texts whose windows are all distinct stop after one hash-set pass.
    """

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def covered(grams: Column) -> Column:
        keyed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]),
            )
            return F.sort_array(F.transform(twin, lambda x: x["p"]))

        fold = F.aggregate(
            _bind(keyed, positions),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(fold)

    grams = _bind(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_bind(grams, covered)).cast("long")


def text_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rest that FEATURES needs, prefix ``_``.

    A null text counts as empty. Columns of ``docs`` named like the new ones are replaced.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_word = f"[^{SPACE_CLASS}]"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    df = docs.withColumns({"_text_words": words_of(t), "_text_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_text_words").cast("long"),
        "word_chars": F.char_length(t).cast("long") - count(f"[{SPACE_CLASS}]"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": (F.size("_text_lines") - F.size(F.array_distinct("_text_lines"))).cast("long"),
        "n_repeat_words": repeated_word_count(F.col("_text_words")),
        "_lines": F.size("_text_lines").cast("long"),
        "_distinct": F.size(F.array_distinct("_text_words")).cast("long"),
        "_upper": count("[A-Z]"),
        "_digits": count("[0-9]"),
        "_bangs": count("!"),
    })
    return df.drop("_text_words", "_text_lines")


def feature_columns() -> dict[str, Column]:
    """FEATURES as expressions over the columns that ``text_profile`` adds."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("_upper", "word_chars"),
        "digit_share": per("_digits", "word_chars"),
        "bangs_per_word": per("_bangs", "n_words"),
        "distinct_share": per("_distinct", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "_lines"),
        "words_per_line": per("n_words", "_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature_columns()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects the text, a text that none matches is kept."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def verdict(self) -> Column:
        """Name of the first rule that holds, null for none."""
        out: Column | None = None
        for i, rule in enumerate(self.rules):
            holds = rule[0].column()
            for c in rule[1:]:
                holds = holds & c.column()
            name = F.lit(f"rule_{i + 1}")
            out = F.when(holds, name) if out is None else out.when(holds, name)
        return F.lit(None).cast("string") if out is None else out

    def __str__(self) -> str:
        return "\n".join(f"rule_{i + 1}: " + " and ".join(map(str, r)) for i, r in enumerate(self.rules))


def learn_decision_list(
    rows: list[tuple[tuple[float, ...], bool, bool]], max_rules: int = 12, max_conditions: int = 4,
    precision: float = 0.97, support: int = 5, cuts: int = 48,
) -> DecisionList:
    """Sequential covering over labelled statistics: rows of (features, rejected, belongs to the prune fold).

    A rule grows by the condition with the best FOIL gain on the grow fold, then loses trailing conditions
    while that does not lower (p - n) / (p + n) on the prune fold. A rule must reach ``precision`` (of both folds
    together, with one false hit added) and ``support`` rejected rows; learning stops at the first that does not.
    """
    import math

    if not rows:
        return DecisionList()
    bits = lambda flags: int("".join("1" if x else "0" for x in flags) or "0", 2)
    positive, pruning = bits(r[1] for r in rows), bits(r[2] for r in rows)
    everything = (1 << len(rows)) - 1
    tests: list[tuple[Condition, int]] = []
    for k, name in enumerate(FEATURES):
        values = sorted({r[0][k] for r in rows})
        edges = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        # equal steps over the rows and over the distinct values, so that short tails get cuts too
        by_row = sorted(r[0][k] for r in rows)
        picked = {edges[len(edges) * i // cuts] for i in range(cuts)} if edges else set()
        for i in range(1, cuts):
            v = by_row[len(rows) * i // cuts]
            picked |= {e for e in edges[max(0, _below(edges, v) - 1) : _below(edges, v) + 1]}
        for t in sorted(picked):
            mask = bits(r[0][k] > t for r in rows)
            tests += [(Condition(name, True, t), mask), (Condition(name, False, t), everything & ~mask)]
    left, rules = everything, []
    while len(rules) < max_rules:
        mask, rule, masks = left & ~pruning, [], []
        while len(rule) < max_conditions and mask & ~positive:
            p, n = (mask & positive).bit_count(), (mask & ~positive).bit_count()
            if not p:
                break
            base, best = math.log2(p / (p + n)), (0.0, None)
            for condition, own in tests:
                q = (mask & own & positive).bit_count()
                if q >= max(1, support // 2):
                    gain = q * (math.log2(q / (mask & own).bit_count()) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, (condition, own))
            if best[1] is None:
                break
            rule.append(best[1][0])
            masks.append(best[1][1])
            mask &= best[1][1]
        if not rule:
            break

        def worth(k: int, masks=masks) -> float:
            m = left & pruning
            for own in masks[:k]:
                m &= own
            p, n = (m & positive).bit_count(), (m & ~positive).bit_count()
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        whole = left
        for own in masks[:keep]:
            whole &= own
        p, n = (whole & positive).bit_count(), (whole & ~positive).bit_count()
        if p < support or p / (p + n + 1) < min(precision, p / (p + 1)) or p / (p + n) < precision:
            break
        rules.append(tuple(rule[:keep]))
        left &= ~whole
        if not left & positive:
            break
    return DecisionList(tuple(rules))


def _below(edges: list[float], v: float) -> int:
    import bisect

    return bisect.bisect_left(edges, v)


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, text: str = "text", **options
) -> DecisionList:
    """Learn from at most ``sample_rows`` labelled documents (those with the smallest hashed ids).

    ``labels`` holds doc_id and quality (1 good, 0 bad); null labels are ignored, and of repeated ids the lowest label
    counts. Rows of ``docs`` that repeat a labelled id all count, up to twice ``sample_rows`` rows, those with the smallest
    hashed ids and features. Without labels, or labelled documents, the list is empty.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(9))
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_quality"))
        .where(F.col("_quality").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(h, "doc_id", "_quality")
        .limit(sample_rows)
        .groupBy("doc_id")
        .agg(F.min("_quality").alias("_quality"))
    )
    # at most sample_rows pairs of numbers, so the broadcast is bounded
    mine = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    measured = text_profile(mine).select(
        F.array(*[feature_columns()[f] for f in FEATURES]).alias("x"),
        (F.col("_quality") == 0).alias("rejected"),
        (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(3)) == 0).alias("prune"),
        F.col("doc_id"),
    )
    rows = sorted((r["doc_id"], tuple(r["x"]), r["rejected"], r["prune"]) for r in measured.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "x").limit(2 * sample_rows).collect())
    return learn_decision_list([r[1:] for r in rows], **options)


def apply_quality_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Profile every text and add base_failed, rule (first rejecting rule or null) and kept.

    Null and empty texts have no words and fail; long texts are profiled whole; repeated rows each get a row with the same
    verdict; other columns stay as they are, but for one named like an added column, which it replaces; an empty table gives none.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = text_profile(docs, text).withColumn("base_failed", base_failed)
    df = df.withColumn("rule", F.when(~F.col("base_failed"), rules.verdict()))
    df = df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return df.drop(*[c for c in df.columns if c in ("_lines", "_distinct", "_upper", "_digits", "_bangs")])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    out = apply_quality_rules(docs.select("doc_id", "text"), rules)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
