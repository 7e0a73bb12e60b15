"""Long byte strings that occur more than once: merged Burrows-Wheeler transforms of repeated regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, shuffle_partitions, stored, table
from spanloom.llm.packing import mix64

#: Most bytes of the hashed piece that stands for a window (its smallest one), and of one symbol of the transform.
PIECE, SYMBOL = 64, 80
#: Offsets of the piece in its window that share a name when the windows of a hot name are named anew.
BAND = 22
#: Bits of the filter that the second reading of the texts uses; a full filter only lets more through.
FILTER_BITS = 27
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def rolled(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of the ``size`` bytes from each position, for sizes that are powers of two in rising order."""
    h, size, out = _BYTES[data], 1, []
    with np.errstate(over="ignore"):
        while True:
            if size in sizes:
                out.append(h)
            if size >= sizes[-1]:
                return out
            h = h[: max(0, len(h) - size)] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
            size *= 2


def smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each position."""
    m, size = v, 1
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - size : width - size + len(v) - width + 1])


def piece_bytes(length: int) -> int:
    """The largest power of two that is at most PIECE and fits into a window."""
    return 1 << (min(PIECE, length).bit_length() - 1)


def symbol_bytes(length: int) -> int:
    """The largest divisor of a window's length that is at most SYMBOL, so that whole symbols make up a window."""
    return max(d for d in range(1, min(SYMBOL, length) + 1) if length % d == 0)


def window_runs(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes whose smallest piece has the same hash.

    Returns the joined texts, the texts' ends, the pieces' hashes, and per run the hash, the first window and the end of
    its windows, as positions in the joined texts. Equal windows have equal hashes, wherever they are.
    """
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    none, piece = np.zeros(0, np.int64), piece_bytes(length)
    if len(joined) < length:
        return joined, ends, none.astype(np.uint64), none.astype(np.uint64), none, none
    v = mix64(rolled(np.frombuffer(joined, np.uint8), (piece,))[0])
    m = smallest(v, length - piece + 1)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(m)]
    change = np.flatnonzero((m[1:] != m[:-1]) | (doc[1:] != doc[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.minimum(np.concatenate([change, [len(m)]]), ends[doc[first]] - length + 1)
    good = last > first
    return joined, ends, v, m[first[good]], first[good], last[good]


def periodic_windows(part: bytes, key: int, length: int) -> np.ndarray:
    """The period of each window of ``part`` that equals the one a period, of at most PIECE bytes, before it; 0 for the others.

    In a stretch of that period the piece ``key`` recurs at even distances, which is where to look; bytes are compared.
    """
    data, n = np.frombuffer(part, np.uint8), len(part) - length + 1
    period = np.zeros(n, np.int32)
    at = np.flatnonzero(mix64(rolled(data, (piece_bytes(length),))[0]) == np.uint64(key))
    gap = np.diff(at)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(gap)) + 1, [len(gap)]])
    for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e > a and gap[a] <= PIECE:
            d, lo, hi = int(gap[a]), max(0, int(at[a]) - length), min(len(data), int(at[e]) + 2 * length)
            unlike = np.flatnonzero(data[lo : hi - d] != data[lo + d : hi])
            bounds = np.concatenate([[-1], unlike, [hi - d - lo]])
            # between two places that differ lie this many windows that equal the one d further on
            for first, end in zip((bounds[:-1] + 1).tolist(), (bounds[1:] - length + 1).tolist(), strict=True):
                if end > first:
                    period[lo + first + d : lo + end + d] = d
    return period


def periodic_repeats(period: np.ndarray) -> np.ndarray:
    """Windows that equal another of their part: those with a period, and those a period before them."""
    later = np.flatnonzero(period)
    again = period > 0
    again[later - period[later]] = True
    return again


def named_anew(part: bytes, key: int, length: int, band: int) -> list[tuple[int, int, int]]:
    """(name, first, end) of the runs of windows of ``part``, all with piece ``key``, that keep one place of the piece and one band.

    Windows with the piece at offsets o to o + band - 1 share all but band - 1 of their bytes; the hash of those is the new
    name, so equal windows are again in runs of one name. With a band of one the name is that of the whole window. Windows
    that equal the one a period before them have no name of their own: the first period stands for them.
    """
    piece, n = piece_bytes(length), len(part) - length + 1
    at = np.flatnonzero(mix64(rolled(np.frombuffer(part, np.uint8), (piece,))[0]) == np.uint64(key))
    place = at[np.searchsorted(at, np.arange(n))]
    own = (place - np.arange(n)) // band
    later = periodic_windows(part, key, length) > 0
    edges = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0) | (np.diff(own) != 0) | (later[1:] != later[:-1])) + 1, [n]])
    kept = ~later[edges[:-1]]
    out = []
    for a, e in zip(edges[:-1][kept].tolist(), edges[1:][kept].tolist(), strict=True):
        low, q = int(own[a]) * band, int(place[a])
        shared = part[q - low : q + length - min(low + band - 1, length - piece)]
        out.append((xxhash.xxh3_64_intdigest(shared, (key + low) & (1 << 64) - 1), a, e))
    return out


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers below 2**32 by two passes over 16 bits, the second only where it matters."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def symbol_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each position, from those of powers of two."""
    parts = tuple(1 << k for k in range(size.bit_length()) if size >> k & 1)
    found = dict(zip(parts, rolled(data, parts), strict=True))
    n, out, at = max(0, len(data) - size + 1), None, 0
    with np.errstate(over="ignore"):
        for p in reversed(parts):
            h = found[p][at : at + n]
            out = h if out is None else out * np.uint64(pow(_BASE, p, 1 << 64)) + h
            at += p
    return out


def sorted_shard(symbol: np.ndarray, after: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """The rotations lo..hi of one shard in the order of their first ``depth`` symbols, from the last symbol to the first."""
    steps = [np.arange(lo, hi)]
    for _ in range(depth - 1):
        steps.append(after[steps[-1]])
    order = np.arange(hi - lo)
    for step in reversed(steps):
        order = order[stable_order(symbol[step[order]])]
    return order + lo


def merged_prefixes(transform: np.ndarray, shard: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards, laid end to end: the rank of each of their places, and per rank the common prefix.

    Round j takes the symbols before the rotations in the interleave of round j - 1, sorts them stably, and so gets the
    interleave by j symbols from the transforms alone; no suffix is compared or sorted again. The round in which two
    neighbouring ranks first part gives the length in symbols, at most ``depth``, of their common prefix.
    """
    n = len(transform)
    interleave, group, prefix = shard, np.zeros(n, np.int32), np.full(n, depth, np.int16)
    prefix[:1] = 0
    for j in range(1, depth + 1):
        now = np.empty(n, transform.dtype)
        now[np.argsort(interleave, kind="stable")] = transform
        to = stable_order(now)
        interleave, now, was = interleave[to], now[to], group[to]
        parts = (now[1:] != now[:-1]) | (was[1:] != was[:-1])
        prefix[1:][parts & (prefix[1:] == depth)] = j - 1
        group = np.concatenate([[0], np.cumsum(parts, dtype=np.int32)]).astype(np.int32)[:n]
    return np.argsort(interleave, kind="stable"), prefix


def repeated_windows(segments: list[bytes], length: int, weights: list[int] | None = None, shard_bytes: int = 1 << 17) -> list[np.ndarray]:
    """Per segment, whether the string of ``length`` bytes from each position occurs again, in any segment or in a copy of its own.

    A segment is a set of strings, one per phase, of symbols of equal size, each closed by its own end; its rotations start
    at every position and at the ends. Segments are dealt out to shards of about ``shard_bytes``; every shard is sorted on
    its own by as many symbols as make up ``length`` and gives its transform, the symbols before its rotations in that
    order. The transforms are merged by refining their interleave; ranks with a common prefix of ``length`` bytes form the
    repeated intervals, and an interval repeats if its segments weigh two or more (``weights``: copies of each segment).
    """
    size = symbol_bytes(length)
    depth = length // size
    n = np.array([len(s) for s in segments], np.int64)
    # segment k has n[k] + 1 rotations: n - size + 1 that start with a symbol, size that start with an end
    base = np.concatenate([[0], np.cumsum(n + 1)])
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    p = (np.arange(base[-1]) - base[owner]).astype(np.int32)
    is_end = p > (n[owner] - size)
    joined = np.frombuffer(b"".join(segments) + bytes(size), np.uint8)
    hashes = symbol_hashes(joined, size)
    symbol = np.zeros(len(p), np.int32)
    starts = np.flatnonzero(~is_end)
    symbol[starts] = np.unique(hashes[starts - owner[starts]], return_inverse=True)[1] + 1
    del joined, hashes, starts
    after = np.where(is_end, base[owner] + p % size, np.arange(len(p)) + size).astype(np.int32)
    before = np.empty_like(after)
    before[after] = np.arange(len(after), dtype=np.int32)
    shard = ((np.cumsum(n) - 1) // shard_bytes).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(n)]
    order = np.concatenate([sorted_shard(symbol, after, base[a], base[e], depth) for a, e in zip(cuts, cuts[1:], strict=False)])
    own = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint16), [base[e] - base[a] for a, e in zip(cuts, cuts[1:], strict=False)])
    ranks, prefix = merged_prefixes(symbol[before[order]], own, depth)
    interval = np.cumsum(prefix < depth) - 1
    weight = np.ones(len(n)) if weights is None else np.array(weights, float)
    total = np.bincount(interval[ranks], weight[owner[order]])
    again = np.zeros(len(order), bool)
    again[order] = total[interval[ranks]] > 1
    again &= p <= n[owner] - length
    return [again[base[k] : base[k] + n[k] - length + 1] for k in range(len(n))]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_spans(
    docs: DataFrame, length: int = 400, text: str = "text", chunk_bytes: int = 1 << 20, hot_bytes: int = 1 << 19
) -> DataFrame:
    """doc_id, th (hash of the text) and spans: windows [start, end) of every document whose ``length`` bytes occur elsewhere.

    Every window is named by its smallest hashed piece, which equal windows share. Names seen once rule a window out;
    the rest come in runs of windows with one name. Runs with equal bytes form a class, known by name and content hash,
    and one text of each class, with its number of copies, goes to the merge of transforms, which finds what repeats.
    Names are dealt out by hash. A name whose classes have more than ``hot_bytes`` is split: its windows are named anew by
    what surrounds the piece, names with one window drop out, and those that are still hot by all bytes of the window.
    Windows that equal the one a period before them, as in long runs of one character, repeat at sight and aren't named. So
    no task holds much more than ``chunk_bytes`` of segments, however many documents share a passage.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    spark = docs.sparkSession
    piece = piece_bytes(length)
    body = F.col(text).cast("string")
    source = docs.select("doc_id", F.xxhash64(body).alias("th"), body.alias("text"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        for b in byte_slices(batches, "text", 1 << 20):
            yield b, [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]

    def name_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            _, _, v, key, first, last = window_runs(texts, length)
            width = length - piece
            times = np.array([np.count_nonzero(v[a : b + width] == k) for k, a, b in zip(key, first.tolist(), last.tolist(), strict=True)], np.int64)
            names, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, times, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["key", "n"])

    names = source.select("text").mapInArrow(name_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    slot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    words = names.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")
    ).toArrow()  # at most 2**FILTER_BITS bits
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    seen = spark.sparkContext.broadcast(bits)

    def named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = seen.value
        for b, texts in chunks(batches):
            joined, ends, v, key, first, last = window_runs(texts, length)
            place = (key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            hit = (filter_[place >> 6] >> (place & 63)) & 1 == 1
            key, first, last = key[hit], first[hit], last[hit]
            doc = np.searchsorted(ends, first, "right")
            start = ends[doc] - np.array([len(t) for t in texts], np.int64)[doc]
            view, width = memoryview(joined), length - piece
            pairs = list(zip(key, first.tolist(), last.tolist(), strict=True))
            inner = [np.count_nonzero(v[a : e + width] == k) > 1 for k, a, e in pairs]
            content = np.array([xxhash.xxh3_64_intdigest(view[a : e - 1 + length]) for _, a, e in pairs], np.uint64)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("th").take(at), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array((first - start).astype(np.int32)), pa.array((last - start).astype(np.int32)), pa.array(inner, pa.bool_())],
                ["doc_id", "th", "key", "content", "first", "last", "inner"],
            )

    runs = stored(source.mapInArrow(named_runs, "doc_id long, th long, key long, content long, first int, last int, inner boolean"), "repeat-runs")
    one = [F.first(c).alias(c) for c in ("doc_id", "th", "first", "last", "inner")]
    classes = stored(runs.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), *one), "repeat-classes")
    load = F.sum(F.col("last") - F.col("first") + (length - 1))
    open_ = classes.groupBy("key").agg(F.sum("copies").alias("n"), F.max("inner").alias("any"), load.alias("load")).where("n > 1 OR any")
    # stored, so that a hot name's rows are dealt anew by the joins below
    open_ = stored(open_.select("key", (F.col("load") > hot_bytes).alias("hot")), "repeat-open")
    wanted = classes.join(open_, "key").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "content", "copies", "hot", "first", "last")).alias("runs"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    texts = source.join(wanted, same(source, wanted)).select("text", "runs")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "content": pa.int64(), "copies": pa.int64(), "hot": pa.bool_()}
        for b in byte_slices(batches, "text", 1 << 20):
            rows, part = [], []
            for t, own in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                rows += own
                part += [t[r["first"] : r["last"] - 1 + length] for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()] + [pa.array(part, pa.binary())], [*kinds, "part"])

    segments = stored(texts.mapInArrow(cut_out, "key long, content long, copies long, hot boolean, part binary"), "repeat-segments")
    names = ["name", "key", "content", "base", "copies", "part"]
    cool = segments.where("NOT hot").select(F.col("key").alias("name"), "key", "content", F.lit(0).alias("base"), "copies", "part")

    def renamed(band: int):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in byte_slices(batches, "part", 1 << 18):
                for key, content, base, copies, part in zip(*(b.column(c).to_pylist() for c in ("key", "content", "base", "copies", "part")), strict=True):
                    found = named_anew(part, key % (1 << 64), length, band)
                    if not found:
                        continue
                    name, a, e = (np.array(x, np.uint64) for x in zip(*found, strict=True))
                    same = lambda v, n=len(found), kind=np.int64: pa.array(np.full(n, v, kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)), same(key), same(content), same(base, kind=np.int32), same(copies), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))],
                        ["name", "key", "content", "base", "copies", "a", "b"],
                    )

        return split

    def periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that repeat each other at the distance of a period."""
        for b in byte_slices(batches, "part", 1 << 18):
            rows = zip(*(b.column(c).to_pylist() for c in ("key", "content", "part")), strict=True)
            out = [(k, c, a, e) for k, c, part in rows for a, e in intervals(periodic_repeats(periodic_windows(part, k % (1 << 64), length)))]
            key, content, a, e = map(list, zip(*out, strict=True)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(content, pa.int64()), pa.array(a, pa.int32()), pa.array(e, pa.int32())], ["key", "content", "a", "b"])

    anew = "name long, key long, content long, base int, copies long, a int, b int"
    marks = None
    if not segments.where("hot").isEmpty():
        parts = stored(segments.where("hot").dropDuplicates(["key", "content"]).withColumn("base", F.lit(0)), "repeat-hot")
        split = stored(parts.mapInArrow(renamed(BAND), anew), "repeat-renamed")
        several = split.groupBy("name").agg(F.sum("copies").alias("n"), F.sum(F.col("b") - F.col("a") + (length - 1)).alias("load")).where("n > 1")
        several = stored(several.select("name", (F.col("load") > hot_bytes).alias("hotter")), "repeat-several")
        again = split.join(several, "name").drop("copies", "base")
        cut = F.substring("part", F.col("a") + 1, F.col("b") - F.col("a") + (length - 1))
        again = stored(again.join(parts, ["key", "content"]).select("name", "key", "content", F.col("a").alias("base"), "copies", cut.alias("part"), "hotter"), "repeat-split")
        cool = cool.unionByName(again.where("NOT hotter").select(*names))
        windows = stored(again.where("hotter").mapInArrow(renamed(1), anew), "repeat-windows")
        twice = stored(windows.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select("name"), "repeat-twice")
        marks = windows.join(twice, "name").select("key", "content", (F.col("base") + F.col("a")).alias("a"), (F.col("base") + F.col("b")).alias("b"))
        marks = marks.unionByName(parts.mapInArrow(periods, "key long, content long, a int, b int"))

    dealt = cool.repartition(shuffle_partitions(spark), "name").sortWithinPartitions("name", "key", "content", "base")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_windows([r[-1] for r in rows], length, [r[4] for r in rows])
            out = [(k, c, base + a, base + e) for (_, k, c, base, _, _), f in zip(rows, flags, strict=True) for a, e in intervals(f)]
            key, content, a, e = map(list, zip(*out, strict=True)) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(content, pa.int64()), pa.array(a, pa.int32()), pa.array(e, pa.int32())], ["key", "content", "a", "b"])

        rows, size = [], 0
        for b in byte_slices(batches, "part"):
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if size >= chunk_bytes and rows[-1][0] != row[0]:
                    yield found(rows)
                    rows, size = [], 0
                if not rows or rows[-1][:4] != row[:4]:  # repeated rows of one id bring a class twice; it counts once
                    rows.append(row)
                    size += len(row[-1])
        if rows:
            yield found(rows)

    shared = dealt.select(*names).mapInArrow(merge, "key long, content long, a int, b int")
    shared = shared.unionByName(marks) if marks is not None else shared
    marks = stored(shared.groupBy("key", "content").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "repeat-marks")
    spans = F.transform("marks", lambda m: F.struct((F.col("first") + m["a"]).alias("start"), (F.col("first") + m["b"] - 1 + length).alias("end")))
    placed = runs.join(marks, ["key", "content"]).select("doc_id", "th", spans.alias("spans"))
    return placed.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of positions that the spans cover; touching ones are one run."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", **limits: int) -> DataFrame:
    """Return doc_id, n_bytes, removed (array of byte ranges) and kept (the remaining bytes) for every row of ``docs``.

    ``limits``: chunk_bytes and hot_bytes of ``repeated_spans``; they bound a task's memory and never change the result.

    Null texts are empty, long ones are read in slices of some megabytes. Repeated rows repeat each other, so all of what
    reaches ``length`` goes; rows are told apart by id and text. Extra columns are ignored; without rows there are none.
    """
    found = stored(repeated_spans(docs, length, text, **limits), "repeat-spans").withColumnsRenamed({"doc_id": "_d", "th": "_th"})
    body = F.col(text).cast("string")
    rows = docs.select("doc_id", F.xxhash64(body).alias("th"), body.alias("text"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["th"] == found["_th"]), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in byte_slices(batches, "text"):
            n, gone, kept = [], [], []
            for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                t, holes = t or b"", covered(spans or [])
                at, parts = 0, []
                for a, e in holes:
                    parts.append(t[at:a])
                    at = e
                n.append(len(t))
                gone.append([{"start": a, "end": e} for a, e in holes])
                kept.append(b"".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, ranges), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
