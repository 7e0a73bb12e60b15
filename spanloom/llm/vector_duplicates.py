"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table
from spanloom.operators.graph import connected_components


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from randomly chosen rows; an emptied centre stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(half - x[rows] @ centres.T).argmin(1) for rows in slices(x, centres)] or [np.zeros(0, np.int64)])


def slices(x: np.ndarray, centres: np.ndarray) -> Iterator[slice]:
    """Rows of ``x`` whose distances to all centres take about 32 MB, so that memory doesn't grow with the lists."""
    step = max(1, (1 << 22) // len(centres))
    return (slice(at, at + step) for at in range(0, len(x), step))


@dataclass(frozen=True)
class Index:
    """Coarse centres, one codebook per subspace of the residual, and how many lists a query must visit."""

    centres: np.ndarray
    books: np.ndarray  # subspace x code x dimension of the subspace
    probes: int
    radius: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, cosine: float, subspaces: int = 8, recall: float = 0.995, seed: int = 7) -> Index:
        """``x``: unit vectors, finite all. Probes: the rank, under which ``recall`` of vectors turned by exactly ``cosine`` find their list."""
        if not np.isfinite(x).all():
            raise ValueError("the index takes finite vectors alone")
        r = np.random.default_rng(seed)
        centres = kmeans(x, lists)
        own = nearest(x, centres)
        width = -(-x.shape[1] // subspaces)
        residual = np.pad(x - centres[own], ((0, 0), (0, width * subspaces - x.shape[1]))).reshape(len(x), subspaces, width)
        few = residual[:8192]  # rows that the codebooks of the residuals are fitted on
        books = [kmeans(np.ascontiguousarray(few[:, m]), 256, 5) for m in range(subspaces)]
        books = np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books])
        probe = x[r.choice(len(x), min(len(x), 2000), replace=False)]
        aside = r.normal(size=probe.shape)
        aside -= (aside * probe).sum(1, keepdims=True) * probe
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        turned = cosine * probe + np.sqrt(1 - cosine**2) * aside
        half, goal, rank = 0.5 * (centres * centres).sum(1), nearest(turned, centres), []
        for rows in slices(probe, centres):
            far = half - probe[rows] @ centres.T
            rank.append((far < np.take_along_axis(far, goal[rows][:, None], 1)).sum(1))
        probes = int(np.quantile(np.concatenate(rank), recall)) + 1
        return cls(centres, books, min(probes, len(centres)), float(np.sqrt(2 - 2 * cosine)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and length of what the code leaves out, per unit vector."""
        m, _, width = self.books.shape
        own = nearest(x, self.centres)
        residual = np.pad(x - self.centres[own], ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)
        code = np.stack([nearest(residual[:, i], self.books[i]) for i in range(m)], 1).astype(np.uint8)
        decoded = np.stack([self.books[i][code[:, i]] for i in range(m)], 1)
        return own, code, np.sqrt(((residual - decoded) ** 2).sum((1, 2)))

    def visit(self, x: np.ndarray) -> np.ndarray:
        """The ``probes`` nearest lists of each vector."""
        if self.probes >= len(self.centres):
            return np.tile(np.arange(len(self.centres)), (len(x), 1))
        half = 0.5 * (self.centres * self.centres).sum(1)
        near = [np.argpartition(half - x[rows] @ self.centres.T, self.probes - 1, axis=1)[:, : self.probes] for rows in slices(x, self.centres)]
        return np.concatenate(near or [np.zeros((0, self.probes), np.int64)])

    def table_distances(self, x: np.ndarray, list_id: int, code: np.ndarray) -> np.ndarray:
        """Distances of queries to coded vectors of one list, by one table of partial distances per subspace."""
        m, _, width = self.books.shape
        residual = np.pad(x - self.centres[list_id], ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)
        total = np.zeros((len(x), len(code)), np.float32)
        for i in range(m):
            part = (residual[:, i] ** 2).sum(1)[:, None] - 2 * residual[:, i] @ self.books[i].T + (self.books[i] ** 2).sum(1)
            total += np.take(part.astype(np.float32), code[:, i], axis=1)
        return np.sqrt(np.maximum(total, 0))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Packed doubles as unit vectors; the largest component is brought near one before anything is squared."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)
    # powers of two are exact, and take two steps where one would leave the range of a double
    power = -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]
    x = np.ldexp(np.ldexp(x, power // 2), power - power // 2)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_forest(i: np.ndarray, j: np.ndarray, ids_i: np.ndarray, ids_j: np.ndarray) -> np.ndarray:
    """Pairs (node, smallest id reachable in this block) for the links i-j, one per node."""
    nodes, at = np.unique(np.concatenate([ids_i[i], ids_j[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return np.stack([nodes[other], nodes[label[other]]], 1)


def vector_duplicates(
    vectors: DataFrame, embedding: str = "embedding", cosine: float = 0.9, sample: int = 20_480, list_size: int = 256,
    base_lists: int = 1024, block: int = 2048,
) -> DataFrame:
    """Return vec_id, n_links, component_id and kept for every row of ``vectors``.

    Equal vectors form a class; one of each is indexed, and the rest only count. The index has a list for every
    ``list_size`` classes, up to ``base_lists`` or the square root of their number, whichever is more. It is fitted on at
    most ``sample`` classes, or 16 a list if that is more (smallest hashes), and holds all: every class lies in the list of its nearest centre with the
    code of its residual, and visits as many lists as find 99.5% of the vectors at the threshold. Lists and the
    queries that visit them are dealt out in blocks of at most about ``block`` vectors, so a crowded list is many
    tasks. A link that only one side's visits find counts on both sides. In a block, table-lookup distances, less what
    each code leaves out, rule pairs out without loss; the rest is decided by the cosine in double precision. A block returns link counts per query and a spanning forest, never
    pairs, so a group of n vectors costs rows in proportion to n.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Shorter vectors count as
    padded with zeros, however long the longest is. Repeated rows each count; rows without an id are left out of all links.
    Extra columns are ignored; an empty table gives an empty one. What the driver fits, the centres and what is broadcast
    grow with the square root of the number of classes, and so does the work per vector.
    """
    raw = vectors.select("vec_id", F.col(embedding).cast("array<double>").alias("e"))
    width = raw.agg(F.max(F.size("e"))).first()[0] or 0
    if width < 1:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e in b.column("e").to_pylist():
                x = np.array([np.nan if v is None else v for v in e or ()], np.float64)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                out.append(np.pad(x + 0.0, (0, width - len(x))).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "x"])

    packed = stored(raw.mapInArrow(pack, "vec_id long, x binary"), "vectors")
    good = packed.where("x IS NOT NULL AND vec_id IS NOT NULL")
    classes = stored(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "vector-classes")
    n = classes.count()
    lists = max(1, min(n // list_size, max(base_lists, math.isqrt(n))))
    rows = classes.orderBy(F.xxhash64("x"), "rep").limit(max(sample, 16 * lists)).select("x").toArrow()
    if n:
        index = Index.fit(unit_rows(rows.column("x").combine_chunks(), width), lists, cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_rows(b.column("x"), width)
            own, code, left = index.encode(x)
            visits = index.visit(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(left), pa.array(list(visits.astype(np.int32)), pa.list_(pa.int32()))],
                [*b.schema.names, "list", "code", "left", "visits"],
            )

    empty = spark_empty(vectors.sparkSession, "rep long, n long, node long, root long")
    if n:
        placed = stored(classes.select("x", "rep", "m").mapInArrow(place, "x binary, rep long, m long, list int, code binary, left double, visits array<int>"), "vector-lists")
        h = F.xxhash64("rep")
        # one row per list: in how many blocks it lies, and in how many the queries come that visit it
        held = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        asked = placed.select(F.explode("visits").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("asking"))
        parts = stored(held.join(asked, "list"), "vector-parts")
        stay = placed.select("list", F.lit(False).alias("query"), "rep", "m", "x", "code", "left", "visits").join(parts, "list")
        stay = stay.withColumns({"c": F.pmod(h, "blocks").cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("asking") - 1))})
        come = placed.select(F.explode("visits").alias("list"), F.lit(True).alias("query"), "rep", "m", "x", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("left"), F.array("list").alias("visits"))
        come = come.join(parts, "list").withColumns({"q": F.pmod(F.xxhash64("rep", F.lit(1)), "asking").cast("int"), "c": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
        names = ["list", "c", "q", "query", "rep", "m", "x", "code", "left", "visits"]

        def compare(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            is_query = t.column("query")
            ask, db = t.filter(is_query), t.filter(pa.compute.invert(is_query))
            out, forest = [], [np.zeros((0, 2), np.int64)]
            if ask.num_rows and db.num_rows:
                y = unit_rows(db.column("x").combine_chunks(), width)
                code = np.frombuffer(b"".join(db.column("code").to_pylist()), np.uint8).reshape(db.num_rows, -1)
                left, ids, many = (db.column(c).to_numpy() for c in ("left", "rep", "m"))
                list_id = db.column("list")[0].as_py()
                own = ask.column("visits").combine_chunks().flatten().to_numpy()
                visits = db.column("visits").combine_chunks().flatten().to_numpy().reshape(db.num_rows, -1)
                asked_from, own = np.unique(own, return_inverse=True)
                spot = np.minimum(np.searchsorted(asked_from, visits), len(asked_from) - 1)
                row, col = np.nonzero(asked_from[spot] == visits)
                comes = np.zeros((db.num_rows, len(asked_from)), bool)  # whether a vector of this list visits a query's list
                comes[row, spot[row, col]] = True
                weight = ask.column("m").to_numpy()
                for at in range(0, ask.num_rows, 512):
                    part = ask.slice(at, 512)
                    x, mine = unit_rows(part.column("x").combine_chunks(), width), part.column("rep").to_numpy()
                    near = index.table_distances(x, list_id, code) <= index.radius + left + 1e-3
                    i, j = np.nonzero(near)
                    other = mine[i] != ids[j]
                    i, j = i[other], j[other]
                    linked = np.einsum("nd,nd->n", x[i], y[j]) >= cosine
                    i, j = i[linked], j[linked]
                    if len(i):
                        counts = np.bincount(i, many[j], len(x)).astype(np.int64)
                        out += [(int(mine[k]), int(counts[k])) for k in np.flatnonzero(counts)]
                        # the other side counts the link here if its own visits do not come to this query's list
                        one_way = ~comes[j, own[at + i]]
                        back = np.bincount(j[one_way], weight[at + i[one_way]], len(ids)).astype(np.int64)
                        out += [(int(ids[k]), int(back[k])) for k in np.flatnonzero(back)]
                        forest.append(block_forest(i, j, mine, ids))
            forest = np.concatenate(forest)
            long = lambda x: pa.array(x, pa.int64())
            gap = lambda k: [None] * k
            return pa.table({
                "rep": long([r for r, _ in out] + gap(len(forest))), "n": long([c for _, c in out] + gap(len(forest))),
                "node": long(gap(len(out)) + forest[:, 0].tolist()), "root": long(gap(len(out)) + forest[:, 1].tolist()),
            })

        both = stay.select(*names).unionByName(come.select(*names))
        empty = stored(both.groupBy("list", "c", "q").applyInArrow(compare, "rep long, n long, node long, root long"), "vector-links")
    found = empty
    counts = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    links = found.where("node IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b"))
    components = stored(connected_components(links, lambda df: stored(df, "vector-edges")), "vector-components").withColumnRenamed("node", "rep")
    summary = classes.join(counts, "rep", "left").join(components, "rep", "left")
    summary = stored(summary.select("x", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-summary")
    out = good.join(summary, "x").select("vec_id", "n_links", "component_id")
    bad = packed.where("x IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def spark_empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))
