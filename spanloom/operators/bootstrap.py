"""Document bootstraps over per-document counts, with a random-access counter generator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.compiled import DRAWS, java_function
from spanloom.operators.evaluation import SPAN, ratio


def counter_draw(seed: str, domain: str, counter: Column, n: Column) -> Column:
    """Number below ``n`` from sha256(domain, 0, length of seed, seed, 16-byte counter), read as one big number modulo n.

    Any draw can be had without the ones before it, so plans are made in parallel.
    """
    size = f"{len(seed.encode()):08x}"
    head = domain.encode().hex() + "00" + size + seed.encode().hex()
    digest = F.sha2(F.unhex(F.concat(F.lit(head), F.lpad(F.hex(counter.cast("bigint")), 32, "0"))), 256)
    # base 2**24 digits, most significant first: every step stays far below 2**63
    digits = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.conv(F.substring(F.concat(F.lit("00"), digest), i * 6 + 1, F.lit(6)), 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: F.pmod(acc * (1 << 24) + d, n.cast("bigint")))


def drawn_index(head: bytes, counters: Iterable[int], n: int) -> list[int]:
    """The draws of ``counter_draw`` in plain Python; ``head`` is all that comes before the counter."""
    sha256, number = hashlib.sha256, int.from_bytes
    return [number(sha256(head + c.to_bytes(16, "big")).digest(), "big") % n for c in counters]


def indexed(stats: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: df, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add index, 0 to n - 1 in ``order``: places within ranges, offset by the counts of the ranges before.

    ``store`` writes the ranged rows, so that both uses see the same ranges; the offsets are one row per range.
    """
    ranged = store(stats.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = ranged.join(before, part == F.col("_p"))
    return joined.withColumn("index", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_at", "_p", "_before")


#: Documents of a block at least, blocks at most, draws that a task makes before it sends them, digests that are read at once,
#: draws of a row from Java, and rows of draws that are multiplied at once.
BLOCK, BLOCKS, GATHERED, HASHED, PIECE, TOGETHER = 1 << 13, 4096, 1 << 24, 1 << 13, 1 << 16, 64


def drawn_range(head: bytes, first: int, count: int, n: int) -> np.ndarray:
    """The draws of ``counter_draw`` for counters ``first`` and on: NumPy lays out the messages and takes the digests modulo n."""
    if n >= 1 << 31:
        return np.array(drawn_index(head, range(first, first + count), n), np.int64)
    sha256, out, size = hashlib.sha256, np.empty(count, np.int64), len(head) + 16
    powers = np.array([pow(2, 32 * k, n) for k in range(7, -1, -1)], np.uint64)
    for at in range(0, count, HASHED):
        m = min(HASHED, count - at)
        message = np.zeros((m, size), np.uint8)
        message[:, : len(head)] = np.frombuffer(head, np.uint8)
        message[:, -8:] = np.arange(first + at, first + at + m, dtype=np.int64).astype(">i8").view(np.uint8).reshape(m, 8)
        digests = b"".join([sha256(x).digest() for x in message.view(f"V{size}").ravel().tolist()])
        # eight products of 32-bit words and powers below n: their sum stays below 2**63 for n below 2**28
        products = np.frombuffer(digests, ">u4").reshape(m, 8).astype(np.uint64) * powers
        out[at : at + m] = ((products if n < 1 << 28 else products % np.uint64(n)).sum(1) % np.uint64(n)).astype(np.int64)
    return out


def resampled_sums(stats: DataFrame, columns: Sequence[str], sizes: Sequence[int], samples: int, seed: str, domain: str = "bootstrap") -> DataFrame:
    """Per sample (from 0) the sums of ``columns`` over the documents that it draws, for stats(index, columns...).

    ``sizes``: documents per stratum; strata follow each other in index, and every sample draws as many of each as it has.
    Draws are made in parallel, a run of one sample's places at a time, and travel as one packed row per run and block of
    documents: a byte per document that says how often it was drawn, or the places drawn where they are few. A task holds one
    block's counts as a matrix, multiplies every row's counts of places with it, and sends one row per sample and block;
    nothing has a row per sample and document. All columns, of as many systems as there are, share one set of draws.
    """
    spark, n, columns = stats.sparkSession, sum(sizes), list(columns)
    width = max(BLOCK, -(-n // BLOCKS))
    head = domain.encode() + b"\0" + len(seed.encode()).to_bytes(4, "big") + seed.encode()
    starts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    blocks, spot = -(-n // width), np.uint16 if width <= 1 << 16 else np.int32
    tasks = 4 * spark.sparkContext.defaultParallelism
    runs = max(1, -(-n // GATHERED), min(-(-tasks // max(1, samples)), -(-n // BLOCK)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Runs and their draws, one after the other, from runs alone."""
        for run in (i for b in batches for i in b.column("id").to_pylist()):
            sample, k = divmod(run, runs)
            low, high = k * n // runs, (k + 1) * n // runs
            parts = [(max(low, s), min(high, e), s, e - s) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield run, np.concatenate([drawn_range(head, sample * n + a, e - a, size) + s for a, e, s, size in parts if a < e] or [np.zeros(0, np.int64)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The same from rows of draws, those of a run following each other."""
        own, kept = None, []
        for b in batches:
            for run, some in zip(b.column("id").to_pylist(), b.column("draws"), strict=True):
                if run != own and kept:
                    yield own, np.concatenate(kept)
                    kept = []
                own = run
                kept.append(np.frombuffer(some.as_buffer(), "<i4"))
        if kept:
            yield own, np.concatenate(kept)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, index in (joined if java else made)(batches):
            sample = run // runs
            if not len(index):
                continue
            times = np.bincount(index, minlength=blocks * width) if 2 * len(index) >= n else None
            if times is not None and times.max() < 1 << 8:
                rows = times.astype(np.uint8).reshape(blocks, width)
                packed = [(i, True, rows[i].tobytes()) for i in range(blocks)]
            else:
                index = np.sort(index)
                at = np.searchsorted(index, np.arange(blocks + 1) * width).tolist()
                packed = [(i, False, (index[x:y] - i * width).astype(spot).tobytes()) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if x < y]
            for at in range(0, len(packed), 512):
                block, whole, picks = zip(*packed[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([sample] * len(block), pa.int64()), pa.array(whole), pa.array(picks, pa.binary())], ["block", "sample", "whole", "picks"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after the other: first their documents, then the lists of draws."""
        own, counts, sums = None, None, {}

        def send() -> pa.RecordBatch:
            values = np.rint(np.array(list(sums.values()))).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *[pa.array(values[:, i]) for i in range(len(columns))]], ["sample", *columns])

        for b in batches:
            block, at = b.column("block").to_numpy(), b.column("at").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [b.num_rows]])
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if not b.num_rows:
                    continue
                if block[a] != own:
                    if sums:
                        yield send()
                    own, counts, sums = block[a], np.zeros((width, len(columns))), {}
                part = b.slice(a, e - a)
                is_doc = ~np.isnan(at[a:e].astype(float))
                docs = part.filter(pa.array(is_doc))
                if docs.num_rows:
                    counts[docs.column("at").to_numpy()] = np.stack([docs.column(c).to_numpy() for c in columns], 1)
                draws = part.filter(pa.array(~is_doc))
                for at_ in range(0, draws.num_rows, TOGETHER):
                    some = draws.slice(at_, TOGETHER)
                    times = np.empty((some.num_rows, width))
                    for k, (whole, picks) in enumerate(zip(some.column("whole").to_pylist(), some.column("picks").to_pylist(), strict=True)):
                        times[k] = np.frombuffer(picks, np.uint8) if whole else np.bincount(np.frombuffer(picks, spot), minlength=width)
                    for sample, got in zip(some.column("sample").to_pylist(), times @ counts, strict=True):
                        sums[sample] = sums[sample] + got if sample in sums else got
        if sums:
            yield send()

    java = java_function(spark, DRAWS, "Draws", "binary") if 0 < n < 1 << 31 else None
    # what a task of draws holds at once is a run, or many short ones
    work = spark.range(0, samples * runs, 1, max(1, min(samples * runs, max(4 * tasks, samples * n // (GATHERED // 2)))))
    if java:
        pieces = -(-(-(-n // runs)) // PIECE)
        cut = work.select("id", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_c"))
        first = F.expr(f"(id % {runs}L) * {n}L div {runs}L") + F.col("_c") * PIECE
        last = F.least(F.expr(f"(id % {runs}L + 1) * {n}L div {runs}L"), first + PIECE)
        base = F.expr(f"id div {runs}L * {n}L")
        work = cut.select("id", F.call_function(java, F.lit(head), base, first, F.greatest(first, last), F.lit(",".join(map(str, starts)))).alias("draws"))
    draws = work.mapInArrow(draw, "block long, sample long, whole boolean, picks binary")
    draws = draws.select("block", F.lit(None).cast("int").alias("at"), "sample", "whole", "picks", *[F.lit(None).cast("long").alias(c) for c in columns])
    block = (F.col("index") / width).cast("long")
    rows = stats.select(block.alias("block"), F.pmod("index", F.lit(width)).cast("int").alias("at"), F.lit(None).cast("long").alias("sample"),
                        F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("binary").alias("picks"), *[F.col(c).cast("long").alias(c) for c in columns])
    lined = rows.unionByName(draws).repartition("block").sortWithinPartitions("block", F.col("at").isNull())
    parts = lined.mapInArrow(add, ", ".join(f"{c} long" for c in ["sample", *columns]))
    return parts.groupBy("sample").agg(*[F.sum(c).alias(c) for c in columns])


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """Exact percentiles with linear interpolation, one row."""
    tail = (1 - level) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"), F.avg(column).alias("mean"))


def f1_samples(sums: DataFrame) -> DataFrame:
    return sums.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def paired_difference(sums: DataFrame, level: float = 0.95) -> DataFrame:
    """Two systems on the same samples, sums(a_tp, a_fp, a_fn, b_tp, ...): interval of the F1 difference, wins, ties, and the smoothed tail probability."""
    f1 = lambda s: ratio(2 * F.col(f"{s}_tp"), 2 * F.col(f"{s}_tp") + F.col(f"{s}_fp") + F.col(f"{s}_fn"))
    both = sums.select((f1("a") - f1("b")).alias("d"))
    tail = (1 - level) / 2
    n, worse = F.count(F.lit(1)), F.sum((F.col("d") <= 0).cast("long"))
    return both.agg(
        F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"), n.alias("samples"),
        F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.sum((F.col("d") == 0).cast("long")).alias("ties"), ((worse + 1) / (n + 1)).alias("tail"),
    )


def side_by_side(gold: DataFrame, systems: Sequence[DataFrame]) -> tuple[DataFrame, list[str]]:
    """One row per distinct span of any side, with flags g and one per system (their names are returned too): one aggregate over all spans."""
    seen = [f"s{k}" for k in range(len(systems))]
    alone = reduce(Column.__or__, [F.col(c).isNull() for c in SPAN])  # a span with a null equals none of another side

    def side(df: DataFrame, own: str) -> DataFrame:
        return df.select(*SPAN, *[F.lit(c == own).alias(c) for c in ("g", *seen)], F.when(alone, F.lit(own)).alias("_side"))

    rows = reduce(DataFrame.unionByName, [side(df, c) for df, c in zip([gold, *systems], ("g", *seen), strict=True)])
    return rows.groupBy(*SPAN, "_side").agg(*[F.bool_or(c).alias(c) for c in ("g", *seen)]), seen


def _kinds(seen: Sequence[str], kinds: Sequence[str] = ("tp", "fp", "fn")) -> list[Column]:
    """Per system its spans found, spurious and missed: sums over rows of ``side_by_side``."""
    g = F.col("g")
    on = {"tp": lambda p: g & p, "fp": lambda p: ~g & p, "fn": lambda p: g & ~p}
    return [F.sum(on[k](F.col(c)).cast("long")).alias(f"{c}_{k}") for c in seen for k in kinds]


def paired_counts(docs: DataFrame, gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, a_tp, a_fp, a_fn, b_tp, ...) of every document for two systems, in one pass over all spans."""
    spans, seen = side_by_side(gold, [first, second])
    out = docs.select("doc_id").join(spans.groupBy("doc_id").agg(*_kinds(seen)), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(f"{c}_{k}", F.lit(0)).alias(f"{s}_{k}") for s, c in zip("ab", seen, strict=True) for k in ("tp", "fp", "fn")])


#: Margin and ceiling of the clean-document rate.
MARGIN, MOST = 0.005, 0.05


def superiority(
    docs: DataFrame, gold: DataFrame, candidate: DataFrame, comparators: Mapping[str, DataFrame], samples: int, seed: str,
    store: Callable[[DataFrame], DataFrame] = lambda df: df, level: float = 0.95,
) -> DataFrame:
    """One row per comparator and metric: interval of what the candidate gains, and whether its gate holds.

    Documents are drawn within strata (with gold, clean). Micro and macro F1, the latter over the labels that gold, the candidate
    or this comparator has, must gain (low > 0); the rate of clean documents with a finding must not be worse by more than MARGIN
    (low of comparator - candidate + MARGIN at least 0) nor above MOST. The counts of all systems per label lie side by side in
    one row per document, so there is one pass over the spans and one set of draws, however many comparators there are.
    """
    names = list(comparators)
    spans, seen = side_by_side(gold, [candidate, *comparators.values()])
    kinds = ("tp", "fp", "fn")
    per = store(spans.groupBy("doc_id", "label").agg(F.sum(F.col("g").cast("long")).alias("g"), *_kinds(seen, kinds)))
    has = lambda c: F.max(F.col(f"{c}_tp") + F.col(f"{c}_fp") > 0).alias(c)
    labels = per.groupBy("label").agg((F.max("g") > 0).alias("g"), *[has(c) for c in seen]).collect()  # one row per label
    labels = sorted(labels, key=lambda r: (r["label"] is None, r["label"] or ""))
    column = lambda system, i, what: f"{system}_{i}_{what}"
    at = [F.sum(F.when(F.col("label").eqNullSafe(F.lit(r["label"])), F.col(f"{c}_{w}")).otherwise(0)).alias(column(c, i, w)) for c in seen for i, r in enumerate(labels) for w in kinds]
    any_ = [F.max((F.col(f"{c}_tp") + F.col(f"{c}_fp") > 0).cast("int")).alias(f"{c}_any") for c in seen]
    one = per.groupBy("doc_id").agg((F.max("g") > 0).alias("_gold"), *any_, *at)
    clean = F.when(F.coalesce("_gold", F.lit(False)), 0).otherwise(1)
    columns = [column(c, i, w) for c in seen for i in range(len(labels)) for w in kinds]
    hits = [(clean * F.coalesce(f"{c}_any", F.lit(0))).alias(f"{c}_hit") for c in seen]
    stats = docs.select("doc_id").join(one, "doc_id", "left")
    stats = stats.select("doc_id", clean.alias("clean"), *[F.coalesce(c, F.lit(0)).alias(c) for c in columns], *hits)
    placed = indexed(stats, store, ("clean", "doc_id"))
    strata = {r["clean"]: r for r in placed.groupBy("clean").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("s0_hit").cast("double")).alias("rate")).collect()}
    sizes = [strata[k]["n"] for k in (0, 1) if k in strata]
    own = strata[1]["rate"] if 1 in strata else 0.0
    sums = resampled_sums(placed, ["clean", *columns, *[f"{c}_hit" for c in seen]], sizes, samples, seed)

    def metrics(c: str, mine: list[int]) -> list[Column]:
        f1 = lambda tp, fp, fn: ratio(2 * tp, 2 * tp + fp + fn)
        of = lambda what: [F.col(column(c, i, what)) for i in mine]
        add = lambda xs: reduce(lambda x, y: x + y, xs, F.lit(0))
        micro = f1(*(add(of(w)) for w in kinds))
        macro = add([f1(*xs) for xs in zip(*(of(w) for w in kinds), strict=True)]) / max(1, len(mine))
        return [micro, macro, ratio(F.col(f"{c}_hit"), F.col("clean"))]

    gains = []
    for name, c in zip(names, seen[1:], strict=True):
        mine = [i for i, r in enumerate(labels) if r["g"] or r["s0"] or r[c]]
        (micro, macro, rate), (micro_b, macro_b, rate_b) = metrics("s0", mine), metrics(c, mine)
        gains += [(name, "micro", micro - micro_b), (name, "macro", macro - macro_b), (name, "clean_rate", rate_b - rate + MARGIN)]
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("comparator"), F.lit(m).alias("metric"), d.alias("d")) for n, m, d in gains])))
    tail = (1 - level) / 2
    out = rows.groupBy("comparator", "metric").agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("samples"))
    gate = F.when(F.col("metric") == "clean_rate", (F.col("low") >= 0) & (F.lit(own) <= MOST)).otherwise(F.col("low") > 0)
    return out.select("comparator", "metric", "low", "high", "samples", gate.alias("passed"))


def passes_all(gates: DataFrame) -> DataFrame:
    """gates(comparator, metric, passed): whether the candidate passes each comparator's gates, and all of them (comparator null)."""
    return gates.rollup("comparator").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("n_gates"))
