"""Tag sequences to spans, and back: islands over ordered token rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


# token rows: doc_id, token_index, start, end, tag, score
def _order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("token_index")


def _parts() -> tuple[Column, Column]:
    return F.substring("tag", 1, 1), F.when(F.substring("tag", 2, 1) == "-", F.expr("substring(tag, 3)"))


def repair_bio(tokens: DataFrame) -> DataFrame:
    """I without a B or I of the same label before it becomes B; tokens without width count as O."""
    kind, label = _parts()
    flat = tokens.withColumn("tag", F.when(F.col("end") <= F.col("start"), F.lit("O")).otherwise(F.col("tag")))
    before = F.lag("tag").over(_order())
    orphan = (kind == "I") & (before.isNull() | (before == "O") | (F.expr("substring(lag(tag) over (partition by doc_id order by token_index), 3)") != label))
    return flat.withColumn("tag", F.when(orphan, F.concat(F.lit("B-"), label)).otherwise(F.col("tag")))


def decode_bio(tokens: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, label, score): from each B over the I of its label; the score is the least of its tokens."""
    kind, label = _parts()
    t = repair_bio(tokens).withColumns({"_kind": kind, "_label": label}).where("_kind IN ('B', 'I')")
    t = t.withColumn("_span", F.sum((F.col("_kind") == "B").cast("int")).over(_order()))
    out = t.groupBy("doc_id", "_span", F.col("_label").alias("label")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"))
    return out.select("doc_id", "start", "end", "label", "score")


def decode_bios(tokens: DataFrame) -> DataFrame:
    """As decode_bio, with S for a span of one token."""
    kind, label = _parts()
    single = F.concat(F.lit("S-"), label)
    begins = tokens.withColumn("_single", kind == "S")
    as_bio = begins.withColumn("tag", F.when(F.col("_single"), F.concat(F.lit("B-"), label)).otherwise(F.col("tag")))
    # an I after an S starts a span of its own
    after = F.lag("_single").over(_order())
    as_bio = as_bio.withColumn("tag", F.when((kind == "I") & F.coalesce(after, F.lit(False)), F.concat(F.lit("B-"), label)).otherwise(F.col("tag")))
    del single
    return decode_bio(as_bio.drop("_single"))


def decode_bie(tokens: DataFrame) -> DataFrame:
    """B opens, E closes; a span that is still open ends before a B, an O or the end; an orphan or foreign I or E drops out and closes."""
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "start", "end", "tag", "score")))
    docs = tokens.where("end > start").groupBy("doc_id").agg(ordered.alias("t"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string,score:double>>)")
    init = F.struct(none.alias("done"), F.expr("cast(null as struct<start:int,end:int,label:string,score:double>)").alias("open"))

    def step(acc: Column, t: Column) -> Column:
        kind, label = F.substring(t["tag"], 1, 1), F.substring(t["tag"], F.lit(3), F.lit(1000))
        own = F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), label.alias("label"), t["score"].cast("double").alias("score"))
        o = acc["open"]
        longer = F.struct(o["start"].alias("start"), t["end"].cast("int").alias("end"), o["label"].alias("label"), F.least(o["score"], t["score"].cast("double")).alias("score"))
        closed = F.when(o.isNotNull(), F.concat(acc["done"], F.array(o))).otherwise(acc["done"])
        empty = F.expr("cast(null as struct<start:int,end:int,label:string,score:double>)")
        same = o.isNotNull() & (o["label"] == label)
        return (
            F.when(kind == "B", F.struct(closed.alias("done"), own.alias("open")))
            .when((kind == "I") & same, F.struct(acc["done"].alias("done"), longer.alias("open")))
            .when((kind == "E") & same, F.struct(F.concat(acc["done"], F.array(longer)).alias("done"), empty.alias("open")))
            .otherwise(F.struct(closed.alias("done"), empty.alias("open")))
        )

    end = lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return docs.select("doc_id", F.inline(F.aggregate("t", init, step, end)))


def bie_valid(tags: Column) -> Column:
    """Whether an array of tags is legal: I and E follow B or I of their label, a lone B is fine, an I must lead to an E."""
    init = F.struct(F.lit(True).alias("ok"), F.lit("O").alias("kind"), F.lit("").alias("label"))

    def step(acc: Column, tag: Column) -> Column:
        kind, label = F.substring(tag, 1, 1), F.substring(tag, F.lit(3), F.lit(1000))
        inside = kind.isin("I", "E")
        follows = acc["kind"].isin("B", "I") & (acc["label"] == label)
        good = F.when(inside, follows).otherwise(acc["kind"] != "I")
        return F.struct((acc["ok"] & good).alias("ok"), kind.alias("kind"), label.alias("label"))

    return F.aggregate(tags, init, step, lambda acc: acc["ok"] & (acc["kind"] != "I"))


def decode_sparse(tokens: DataFrame, text: str = "text", connectors: str = " \t\n\x0b\f\r-", structured: tuple[str, ...] = ()) -> DataFrame:
    """Tagged tokens only: same-label tokens that touch or overlap join, those of ``structured`` labels also across ``connectors``.

    ``tokens`` carries the document's text, of which a token takes along how many connectors stand right before it; a gap is all
    connectors if they reach back to its start. bridges counts the gaps that were crossed.
    """
    kind, label = _parts()
    w = Window.partitionBy("doc_id").orderBy("start", "end", "token_index")
    before = F.substring(F.col(text), F.lit(1), F.col("start"))
    lead = F.char_length(before) - F.char_length(F.rtrim(before, F.lit(connectors)))
    t = tokens.where(kind.isin("B", "I") & (F.col("end") > F.col("start")))
    t = t.select("doc_id", "start", "end", "token_index", "score", label.alias("label"), F.when(label.isin(*structured), lead).alias("_lead"))
    t = t.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    t = t.withColumns({"_pl": F.lag("label").over(w), "_pe": F.lag("end").over(w)})
    same = F.col("_pl") == F.col("label")
    touch = same & (F.col("start") <= F.col("_pe"))
    bridge = same & (F.col("start") > F.col("_pe")) & (F.col("_lead") >= F.col("start") - F.col("_pe"))
    starts = ~F.coalesce(touch | bridge, F.lit(False))
    t = t.withColumns({"_new": starts.cast("int"), "_bridge": F.coalesce(bridge, F.lit(False)).cast("int")})
    t = t.withColumn("_span", F.sum("_new").over(w))
    out = t.groupBy("doc_id", "_span", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.sum("_bridge").alias("bridges"))
    return out.drop("_span")


def to_bie(tokens: DataFrame) -> DataFrame:
    """The last I of a run becomes E."""
    kind, label = _parts()
    after = F.lead("tag").over(_order())
    last = (kind == "I") & (after.isNull() | (after != F.concat(F.lit("I-"), label)))
    return tokens.withColumn("tag", F.when(last, F.concat(F.lit("E-"), label)).otherwise(F.col("tag")))


def align(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens with the tag of the span that they share a character with: B the first, I the others, O without one."""
    t, s = tokens.select("doc_id", "token_index", "start", "end"), spans.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), "label")
    hit = t.join(s, (t["doc_id"] == s["_d"]) & (t["start"] < s["_e"]) & (s["_s"] < t["end"]))
    first = F.row_number().over(Window.partitionBy("doc_id", "_s", "_e", "label").orderBy("token_index")) == 1
    tagged = hit.select("doc_id", "token_index", F.concat(F.when(first, F.lit("B-")).otherwise(F.lit("I-")), F.col("label")).alias("tag"))
    return t.join(tagged, ["doc_id", "token_index"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def alignment_rates(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """How many span starts and ends no token boundary meets."""
    s = spans.select("doc_id", "start", "end", "label").distinct()
    starts, ends = tokens.select("doc_id", "start").distinct().withColumn("_a", F.lit(1)), tokens.select("doc_id", "end").distinct().withColumn("_b", F.lit(1))
    both = s.join(starts, ["doc_id", "start"], "left").join(ends, ["doc_id", "end"], "left")
    miss = lambda c: F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("n_spans"), miss("_a").alias("bad_starts"), miss("_b").alias("bad_ends"))


def scoped_argmax(logits: Column, labels: list[str], allowed: list[str]) -> Column:
    """Best allowed label: others are masked before the choice, which is not the same as dropping them after it."""
    kept = [i for i, x in enumerate(labels) if x in allowed]
    values = F.array(*[F.get(logits, F.lit(i)) for i in kept])
    return F.get(F.array(*[F.lit(labels[i]) for i in kept]), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def viterbi(docs: DataFrame, labels: list[str], allowed: np.ndarray, may_start: np.ndarray, may_end: np.ndarray) -> DataFrame:
    """Best legal label path of logits array<array<double>>, tokens marked invalid being O; ties go to the first label.

    ``allowed[i, j]`` says whether label j may follow label i. Documents are independent rows, so partitions need nothing
    but themselves.
    """
    outside = labels.index("O")
    block = np.where(allowed, 0.0, -np.inf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = []
            for logits, valid in zip(pdf["logits"], pdf["valid"], strict=True):
                x = np.array([np.asarray(row, float) for row in logits]).reshape(-1, len(labels))
                for i, ok in enumerate(valid):
                    if not ok:
                        x[i] = -np.inf
                        x[i, outside] = 0.0
                if not len(x):
                    paths.append([])
                    continue
                score, back = x[0] + np.where(may_start, 0.0, -np.inf), []
                for row in x[1:]:
                    total = score[:, None] + block
                    back.append(total.argmax(0))
                    score = total.max(0) + row
                at = int((score + np.where(may_end, 0.0, -np.inf)).argmax())
                path = [at]
                for step in reversed(back):
                    at = int(step[at])
                    path.append(at)
                paths.append([labels[i] for i in reversed(path)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tags": paths})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "logits", "valid").mapInPandas(run, "doc_id string, tags array<string>")


def bie_labels(types: Sequence[str]) -> list[str]:
    """O, then begin, inside and end of every type."""
    return ["O", *(f"{p}-{t}" for t in types for p in "BIE")]


def bie_paths(logits: np.ndarray, sizes: np.ndarray, types: int) -> np.ndarray:
    """Best legal paths of padded documents, longest first: logits[document, token, label] of ``bie_labels`` to label numbers.

    O and B follow O, B or E; I and E follow B or I of their type; a document starts with O or B and ends with O, B or E.
    So a state needs one best predecessor that may end a span, and per type one of two: a step costs as much as there are
    labels, not their square. Ties go to O, then to B and E by type; before I and E to B.
    """
    docs, steps, _ = logits.shape
    o, b, i, e = logits[..., 0], logits[..., 1::3], logits[..., 2::3], logits[..., 3::3]
    score_o, score_b = o[:, 0].copy(), b[:, 0].copy()
    score_i, score_e = np.full((docs, types), -np.inf), np.full((docs, types), -np.inf)
    ended, inner = np.zeros((docs, steps), np.int64), np.zeros((docs, steps, types), bool)
    last = np.zeros(docs, np.int64)
    rows = np.arange(docs)

    def best_end(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Label and score of the best state that may end a span, of the first ``n`` documents."""
        if not types:
            return np.zeros(n, np.int64), score_o[:n].copy()
        kb, ke = score_b[:n].argmax(1), score_e[:n].argmax(1)
        vb, ve = score_b[rows[:n], kb], score_e[rows[:n], ke]
        label, value = np.where(vb > score_o[:n], 1 + 3 * kb, 0), np.maximum(score_o[:n], vb)
        return np.where(ve > value, 3 + 3 * ke, label), np.maximum(value, ve)

    for t in range(steps):
        n = int(np.searchsorted(-sizes, -t, "left"))  # documents of more than t tokens
        if t:
            ended[:n, t], value = best_end(n)
            inner[:n, t] = score_i[:n] > score_b[:n]
            source = np.maximum(score_b[:n], score_i[:n])
            score_o[:n], score_b[:n] = value + o[:n, t], value[:, None] + b[:n, t]
            score_i[:n], score_e[:n] = source + i[:n, t], source + e[:n, t]
        done = slice(int(np.searchsorted(-sizes, -t - 1, "left")), n)
        if done.stop > done.start:
            last[done] = best_end(n)[0][done]
    path = np.zeros((docs, steps), np.int64)
    for t in range(steps - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, "left"))
        ends = sizes[:n] == t + 1
        if t + 1 < steps:
            after = path[:n, t + 1]
            kind = np.maximum(after - 1, 0) // 3
            inside = (after > 0) & ((after - 1) % 3 > 0)
            was = np.where(inner[rows[:n], t + 1, kind] if types else False, 2, 1) + 3 * kind if types else after
            path[:n, t] = np.where(inside, was, ended[:n, t + 1])
        path[:n, t] = np.where(ends, last[:n], path[:n, t])
    return path


def bie_viterbi(docs: DataFrame, types: Sequence[str], scope: Sequence[str] | None = None, tokens: int = 1 << 15) -> DataFrame:
    """docs(doc_id, logits array<array<double>>, valid array<boolean>) to doc_id, tags and violation.

    Logits are those of ``bie_labels(types)``; only types of ``scope``, if given, may be chosen, which is decided before the
    search. Invalid tokens are O. Documents are decoded together, padded, in parts of about ``tokens`` tokens. Logits that
    are missing, not finite or of another width give no tags and a violation; empty documents give no tags.
    """
    labels = bie_labels(types)
    names = pa.array(labels)
    shut = np.array([scope is not None and t not in scope for t in types], bool)

    def numbers(rows: pa.Array) -> np.ndarray | None:
        values, sizes = rows.flatten(), np.diff(rows.offsets.to_numpy())
        if rows.null_count or values.null_count or (sizes != len(labels)).any():
            return None
        x = values.to_numpy(zero_copy_only=False).reshape(-1, len(labels)).astype(float)
        return x if np.isfinite(x).all() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits, valid = batch.column("logits"), batch.column("valid")
            found = [numbers(logits[k].values) if logits[k].is_valid and logits[k].values is not None else None for k in range(batch.num_rows)]
            marks = [np.array(v if v is not None else [True] * (0 if x is None else len(x)), object) for v, x in zip(valid.to_pylist(), found, strict=True)]
            bad = [x is None or len(m) != len(x) for x, m in zip(found, marks, strict=True)]
            tags: list[list[str] | None] = [None if wrong else [] for wrong in bad]
            order = sorted((k for k in range(batch.num_rows) if not bad[k] and len(found[k])), key=lambda k: -len(found[k]))
            at = 0
            while at < len(order):
                part = order[at : at + max(1, tokens // len(found[order[at]]))]
                at += len(part)
                sizes = np.array([len(found[k]) for k in part])
                x = np.zeros((len(part), sizes[0], len(labels)))
                for d, k in enumerate(part):
                    x[d, : sizes[d]] = found[k]
                    off = ~(marks[k] == True)  # noqa: E712
                    x[d, : sizes[d]][off] = -np.inf
                    x[d, : sizes[d], 0][off] = 0.0
                for k in np.flatnonzero(shut).tolist():
                    x[:, :, 1 + 3 * k : 4 + 3 * k] = -np.inf
                paths = bie_paths(x, sizes, len(types))
                for d, k in enumerate(part):
                    tags[k] = names.take(pa.array(paths[d, : sizes[d]])).to_pylist()
            why = ["logits" if wrong else None for wrong in bad]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tags, pa.list_(pa.string())), pa.array(why, pa.string())], ["doc_id", "tags", "violation"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "logits", "valid").mapInArrow(run, "doc_id string, tags array<string>, violation string")


def owns(start: Column, end: Column, owner_start: Column, owner_end: Column, is_last: Column) -> Column:
    """Whether a window owns a span: the span's doubled centre lies in its owner range, whose end counts only in the last."""
    centre = start + end
    return (centre >= 2 * owner_start) & ((centre < 2 * owner_end) | (is_last & (centre <= 2 * owner_end)))


def code_points(text: Column) -> Column:
    """array<struct<index,start,end,value>>: every code point a token."""
    points = F.filter(F.split(text, ""), lambda c: F.char_length(c) > 0)
    return F.transform(points, lambda c, i: F.struct(i.alias("index"), i.alias("start"), (i + 1).alias("end"), c.alias("value")))


def lower_percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Per ``key`` the element at index int((n - 1) * share) of the sorted values, from counts per distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(value))
    rows = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(Window.partitionBy(key))})
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * F.lit(q)), F.col(value)))
    return rows.groupBy(key).agg(*[at(q).alias(f"p{int(q * 100)}") for q in shares])


def to_global(start: Column, end: Column, window_start: Column) -> Column:
    """Offsets in a window as offsets in its document."""
    return F.struct((start + window_start).cast("int").alias("start"), (end + window_start).cast("int").alias("end"))
