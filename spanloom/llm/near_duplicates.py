"""Near-duplicate documents: fast similarity sketches, banding, verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, stored, table
from spanloom.llm.packing import mix64
from spanloom.llm.vector_duplicates import block_forest
from spanloom.operators.graph import connected_components

#: Coordinates of a sketch and rows of a band. Two sets of similarity 0.85 miss all 32 bands with probability 5e-11.
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Most shingles, and most documents, on either side of a block that is compared as a whole.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 400_000, 2000
#: Sampled pairs whose one-bit sketches differ in more places are not verified: at similarity 0.85 about 10 of the 128 bits
#: differ, and more than 34 with probability below 1e-10.
MOST_BITS = 34
#: The same below 85 percent: at similarity 0.80 about 13 bits differ, and more than 39 with probability 3e-11.
MOST_BITS_80 = 39

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of them."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = value
        return value


def shingles(text: bytes | None, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole sequence where there are fewer words."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        if len(h) < width:
            return mix64(np.array([np.sum(h * _ODD[: len(h)]) + np.uint64(len(h))], np.uint64))
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            rolled += h[k : k + len(rolled)] * _ODD[k]
        return np.unique(mix64(rolled))


def similarity_sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One key per coordinate, equal for two sets with probability their similarity.

    Round i < t throws every item into a random coordinate with a random value, round t + b throws all into
    coordinate b; a coordinate keeps the smallest (round, value), so it ends with the first round that reached it.
    Rounds run in blocks large enough to fill all coordinates as a rule; those still empty get their own round.
    """
    out = np.full(t, _FAR, np.uint64)
    done, step = 0, min(t, int(np.ceil(t * (np.log(t) + 1.5) / len(items))))
    with np.errstate(over="ignore"):
        while done < t and (out == _FAR).any():
            rounds = np.arange(done, min(t, done + step), dtype=np.uint64)[:, None]
            h = mix64(items[None, :] + (rounds + np.uint64(1)) * _ODD[1])
            place = ((h & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).astype(np.int64)
            np.minimum.at(out, place.ravel(), ((rounds << np.uint64(48)) | (h >> np.uint64(16))).ravel())
            done += step
        for b in np.flatnonzero(out == _FAR):
            i = np.uint64(t + int(b))
            out[b] = (i << np.uint64(48)) | (mix64(items + (i + np.uint64(1)) * _ODD[1]) >> np.uint64(16)).min()
    return out


def signature(items: np.ndarray) -> tuple[bytes, int, int, list[int]]:
    """Digest of the set, the sketch's low bits as two longs, one key per band."""
    sketch = mix64(similarity_sketch(items))
    bits = np.packbits((sketch & np.uint64(1)).astype(np.uint8)).view(np.int64)
    with np.errstate(over="ignore"):
        rows = sketch.reshape(BANDS, ROWS)
        bands = mix64((rows * _ODD[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64) * _ODD[4])
    return xxhash.xxh3_128_digest(items.tobytes()), int(bits[0]), int(bits[1]), bands.view(np.int64).tolist()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n, digest, b0, b1, bands per document; of an empty set digest and bands are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in byte_slices(batches, "text"):
            rows = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                items = shingles(t, words)
                rows.append((len(items), *signature(items)) if len(items) else (0, None, 0, 0, None))
            n, digest, b0, b1, bands = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(b0, pa.int64()), pa.array(b1, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "b0", "b1", "bands"],
            )

    schema = "doc_id long, n long, digest binary, b0 long, b1 long, bands array<long>"
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(sign, schema)


def _alike(percent: int) -> Column:
    """What any pair of columns a_, b_ at the threshold satisfies: sizes and one-bit sketches that are near enough."""
    near = F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))) + F.bit_count(F.col("a_b1").bitwiseXOR(F.col("b_b1")))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return sizes & (near <= (MOST_BITS if percent >= 85 else MOST_BITS_80))


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sets = WordHashes(), {}
        for batch in byte_slices(batches, "tb", most_rows=200):
            keep = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            for i in range(len(a)):
                if a[i] not in sets:
                    if len(sets) >= 16:
                        sets.clear()
                    sets[a[i]] = shingles(ta[i].as_py(), words)
                x, y = sets[a[i]], shingles(tb[i].as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and len(x) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}"))
    full = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(check, "a long, b long")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``.

    Shingles that few sets hold are counted occurrence by occurrence, the others by products of indicator matrices.
    """
    hashes = np.concatenate([*a, *b])
    _, column = np.unique(hashes, return_inverse=True)
    cut = sum(map(len, a))
    ca, cb = column[:cut], column[cut:]
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    width = int(column.max()) + 1 if len(column) else 0
    na, nb = np.bincount(ca, minlength=width), np.bincount(cb, minlength=width)
    out = np.zeros(len(a) * len(b), np.float32)
    few = na * nb * 400 < len(a) * len(b)
    order = np.argsort(cb, kind="stable")
    rows_b, first = rb[order], np.cumsum(nb) - nb
    rare = np.flatnonzero(few[ca])
    for at in range(0, len(rare), 1 << 18):
        c, r = ca[rare[at : at + (1 << 18)]], ra[rare[at : at + (1 << 18)]]
        times = nb[c]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[c], times)
        out += np.bincount(np.repeat(r, times) * len(b) + rows_b[place], minlength=len(out)).astype(np.float32)
    out = out.reshape(len(a), len(b))
    many = np.flatnonzero(~few & (na > 0) & (nb > 0))
    for at in range(0, len(many), 2048):
        slot = np.full(width, -1)
        slot[many[at : at + 2048]] = np.arange(len(many[at : at + 2048]))
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        for m, r, c in ((x, ra, slot[ca]), (y, rb, slot[cb])):
            m[r[c >= 0], c[c >= 0]] = 1
        out += x @ y.T
    return out


def compare_blocks(open_: DataFrame, top: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a band outside its largest component and members of its other components.

    Both sides of a band are dealt out in blocks by hash, and a task compares two blocks on full sets; what it returns is
    a spanning forest of the links found, never pairs, so rows grow with the members and not with their square.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in byte_slices(batches, "text", most_rows=200):
            sets = [shingles(t, words).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"])

    sets = texts.join(open_.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(pack, "doc_id long, set binary")
    sets = stored(sets, "near-sets")
    size = open_.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCUMENTS)).cast("int").alias("blocks"))
    rows = open_.select("key", "doc_id", "component").join(size, "key").join(top.select("key", "top"), "key").join(sets, "doc_id")
    block, every = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ["key", "p", "q", "asks", "doc_id", "component", "set"]
    ask = rows.where("component <> top").withColumns({"asks": F.lit(True), "p": block}).withColumn("q", every)
    stay = rows.withColumns({"asks": F.lit(False), "q": block}).withColumn("p", every)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sides = []
        for asks in (True, False):
            part = t.filter(pa.compute.equal(t.column("asks"), asks))
            found = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
            sides.append((found, part.column("doc_id").to_numpy(), part.column("component").to_numpy()))
        (a, ids_a, comp_a), (b, ids_b, comp_b) = sides
        forest = np.zeros((0, 2), np.int64)
        if len(a) and len(b):
            both = shared_counts(a, b)
            total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
            i, j = np.nonzero((100 * both >= percent * (total - both)) & (comp_a[:, None] != comp_b))
            if len(i):
                forest = block_forest(i, j, ids_a, ids_b)
        return pa.table({"a": pa.array(forest[:, 0], pa.int64()), "b": pa.array(forest[:, 1], pa.int64())})

    return ask.select(*names).unionByName(stay.select(*names)).groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = 85, rounds: int = 3) -> DataFrame:
    """Return doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents with equal sets form a class, and only its smallest id goes on. Class representatives that share a band
    are candidates: first each with the smallest of its band (one row per member, whatever the band's size), verified
    on full sets and joined into components. Bands whose members are then still in several components are followed
    up: members outside the band's largest component against a random member of it, for a few rounds while that
    joins anything, and last against every member of another component, block by block on full sets. So no links
    between components are lost, and no pairs are listed there.

    Null and empty texts have no shingles, link with nothing and stay. Rows without an id have a null component and
    stay. Repeated rows each get a row; rows that repeat an id count as one document with the links of all. Extra
    columns are ignored, long texts are read whole, and an empty table gives an empty one.
    """
    keep = lambda name: lambda df: stored(df, f"near-{name}")
    signed = keep("signatures")(signatures(docs, text))
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = keep("classes")(linked.groupBy("digest", "n").agg(F.min("doc_id").alias("rep")))
    own = F.col("doc_id") == F.col("rep")
    members = keep("members")(
        linked.join(classes, ["digest", "n"]).select(
            "doc_id", "rep", "n", F.when(own, F.col("b0")).alias("b0"), F.when(own, F.col("b1")).alias("b1"), F.when(own, F.col("bands")).alias("bands"),
        )
    )
    reps = members.where("doc_id = rep")
    banded = reps.select("doc_id", "n", "b0", "b1", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    grouped = keep("bands")(banded.join(shared, "key").select("key", "pivot", "m", "doc_id", "n", "b0", "b1"))
    checked = keep("pairs-0")(grouped.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    wanted = grouped.select("doc_id").distinct()
    texts = keep("texts")(docs.select("doc_id", F.col(text).cast("string").alias("text")).join(wanted, "doc_id", "left_semi"))
    links = keep("links-0")(verify(checked, texts, percent))

    side = lambda s, p="": [F.col(f"{p}doc_id").alias(s), *(F.col(f"{p}{c}").alias(f"{s}_{c}") for c in ("n", "b0", "b1"))]
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    components = keep("components-0")(connected_components(links, keep("edges-0")))
    # a band of two has had its one pair verified, and a band in one component stays so: neither is looked at again
    r, last, left = 0, False, grouped.where("m > 2").drop("pivot", "m")
    while not last:
        r += 1
        placed = left.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
        split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        open_ = keep(f"open-{r}")(placed.join(split, "key"))
        if open_.isEmpty():
            break
        left = open_.drop("component")
        # the smallest hash picks another member each round
        parts = open_.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("m"), F.min_by(F.struct("doc_id", "n", "b0", "b1"), F.xxhash64("doc_id", F.lit(r))).alias("one")
        )
        top = parts.groupBy("key").agg(F.max_by(F.struct("component", "one"), F.struct("m", "component")).alias("top"))
        top = keep(f"top-{r}")(top.select("key", F.col("top.component").alias("top"), "top.one"))
        outside = open_.join(top, "key").where("component <> top")
        sampled = ordered(outside.select(*side("b"), *side("a", "one.")).where(_alike(percent))).distinct()
        fresh = keep(f"pairs-{r}")(sampled.join(ordered(checked), ["a", "b"], "left_anti"))
        more = keep(f"links-{r}")(verify(fresh, texts, percent))
        if r > rounds or more.isEmpty():  # sampling brings nothing more: look at all that is left
            last = True
            more = more.unionByName(keep("links-rest")(compare_blocks(open_, top, texts, percent)))
        checked, links = checked.unionByName(fresh), links.unionByName(more)
        components = keep(f"components-{r}")(connected_components(links, keep(f"edges-{r}")))
    found = members.select("doc_id", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
