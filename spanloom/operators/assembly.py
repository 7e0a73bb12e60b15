"""Putting training data together: fingerprints, opaque ids, coverage-aware splits, packing, templates, audits, contracts."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from spanloom.functions.text import contains_any, find_spans, slice_text
from spanloom.operators.datasets import greedy_split, ranked_in_order
from spanloom.operators.dealing import deal, taken
from spanloom.operators.graph import connected_components
from spanloom.operators.spans import rebuild, replace_spans

Store = Callable[[DataFrame], DataFrame]


@F.pandas_udf(StringType())
def security_normal(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, which Spark has no functions for."""
    return text.str.normalize("NFKC").str.casefold()


# fingerprints and ids ------------------------------------------------------------------------------------------------


def placeholder_fingerprint(text: Column, edits: Column) -> Column:
    """sha256 of the text with every edit (start, end, label) as <PII:label>, normalised, white space collapsed."""
    masked = replace_spans(text, F.array_sort(edits), lambda e: F.concat(F.lit("<PII:"), e["label"], F.lit(">")))
    return F.sha2(F.trim(F.regexp_replace(security_normal(masked), r"(?U)\s+", " ")), 256)


def linkage_edges(docs: DataFrame, groups: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, value) that tie candidates together: source and record, placeholder fingerprint, groups, relations.

    docs: source_id, domain, fingerprint, relations (array), and a nullable column per group kind.
    """
    one = lambda kind, value: F.struct(kind.alias("kind"), value.cast("string").alias("value"))
    own = [
        one(F.lit("record"), F.concat(F.col("source_id"), F.lit("\0"), F.col(key).cast("string"))), one(F.lit("exact_placeholder"), F.col("fingerprint")),
        *[one(F.lit(g), F.col(g)) for g in groups],
    ]
    related = F.transform("relations", lambda r: one(F.concat_ws(":", F.lit("relation"), F.col("source_id"), F.col("domain")), r))
    rows = docs.select(F.col(key).alias("doc_id"), F.inline(F.concat(F.array(*own), related)))
    return rows.where("value IS NOT NULL").distinct()


# What stands before the parts of an id, and the purposes that keys and codes are derived for.
ID_PROTOCOL = b"pii-zh/context-v2/public-id/v1"
EXTRACT_SALT = b"pii-zh/surrogate/v2/hkdf-extract"
RELATION_KEY, SPLIT_KEY, LABEL_KEY = b"pii-zh/surrogate/v2/relation-key", b"pii-zh/surrogate/v2/split-key", b"pii-zh/surrogate/v2/label-key"
RELATION_MAC, SEED = b"pii-zh/surrogate/v2/relation-mac", b"pii-zh/surrogate/v2/seed"
RELATION_ID_KEY, RELATION_ID = b"pii-zh/surrogate/v2/relation-id-key", b"pii-zh/surrogate/v2/relation-id"
#: Bytes of an opaque id, and the shortest key.
ID_BYTES, KEY_BYTES = 18, 32


def framed(*parts: bytes) -> bytes:
    """The parts, each behind its length in eight bytes, so that no two lists of parts look alike."""
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def code(key: bytes, message: bytes) -> bytes:
    return hmac.new(key, message, hashlib.sha256).digest()


def url_name(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest).rstrip(b"=").decode()


def expanded(key: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256's second step: ``length`` bytes from a key for one purpose."""
    out, block, i = b"", b"", 0
    while len(out) < length:
        i += 1
        block = code(key, block + info + bytes([i]))
        out += block
    return out[:length]


def opaque_ids(docs: DataFrame, secret: bytes, prefix: str, parts: Sequence[str], protocol: bytes = ID_PROTOCOL, name: str = "opaque") -> DataFrame:
    """Add ``name``: prefix_v2_ and 18 bytes of HMAC-SHA256 over the framed parts, URL-safe; null if a part is. The key never enters the plan."""
    head = protocol + len(prefix).to_bytes(4, "big") + prefix.encode("ascii")

    @F.pandas_udf(StringType())
    def opaque(rows: pd.DataFrame) -> pd.Series:
        one = lambda values: None if any(v is None for v in values) else f"{prefix}_v2_{url_name(code(secret, head + framed(*(v.encode() for v in values)))[:ID_BYTES])}"
        return pd.Series([one(v) for v in rows.itertuples(index=False)], dtype=object)

    return docs.withColumn(name, opaque(F.struct(*[F.col(p).cast("string").alias(p) for p in parts])))


class Deriver:
    """Keys of one secret: ids of relations that differ between splits and scopes, seeds that differ between labels as well."""

    def __init__(self, root: bytes) -> None:
        self.root, self.relation = root, expanded(root, framed(RELATION_KEY))
        self.of_split, self.of_label = lru_cache(1024)(self._split), lru_cache(4096)(self._label)

    @classmethod
    def of(cls, secret: bytes) -> Deriver:
        if len(secret) < KEY_BYTES:
            raise ValueError(f"a key has {KEY_BYTES} bytes at least")
        return cls(code(EXTRACT_SALT, secret))

    def __reduce__(self) -> tuple:
        return Deriver, (self.root,)  # workers get the root key and never the secret

    def _split(self, split: str) -> tuple[bytes, bytes]:
        key = expanded(self.root, framed(SPLIT_KEY, split.encode()))
        return key, expanded(key, framed(RELATION_ID_KEY))

    def _label(self, split: str, label: str) -> bytes:
        return expanded(self.of_split(split)[0], framed(LABEL_KEY, label.encode()))

    def derive(self, split: str | None, label: str | None, scope: str | None, relation: str | None) -> tuple[str | None, bytes | None]:
        """(relation id, seed); none if a part is missing, empty or has blanks at its ends."""
        if not relation or any(not p or p != p.strip() for p in (split, label, scope)):
            return None, None
        mac = code(self.relation, framed(RELATION_MAC, scope.encode(), relation.encode()))
        name = code(self.of_split(split)[1], framed(RELATION_ID, scope.encode(), mac))[:ID_BYTES]
        return f"rel_v2_{url_name(name)}", code(self.of_label(split, label), framed(SEED, scope.encode(), mac))


def isolated_ids(docs: DataFrame, secret: bytes, split: str = "split", relation: str = "relation", label: str = "label", scope: str = "scope") -> DataFrame:
    """Add relation_id (one per split, scope and relation, whatever the label) and seed (32 bytes, which the label enters too).

    Keys of splits and labels are derived where they are met, so nothing is collected first.
    """
    keys = Deriver.of(secret)

    @F.pandas_udf(StructType([StructField("relation_id", StringType()), StructField("seed", BinaryType())]))
    def derive(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([keys.derive(s, v, w, r) for s, v, w, r in rows.itertuples(index=False)], columns=["relation_id", "seed"])

    given = F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate((split, label, scope, relation))])
    return docs.withColumn("_d", derive(given)).select(*docs.columns, "_d.relation_id", "_d.seed")


# splits --------------------------------------------------------------------------------------------------------------


def coverage_split(components: DataFrame, targets: Mapping[str, float], required: Sequence[str], seed: str) -> DataFrame:
    """(component, split) where each of the ``required`` splits gets every label, and the rest goes where most room is left.

    components: component, size, labels (array), digest (hex). Rare labels come first; each step takes one component by
    the most new labels, their scarcity, least overflow, smallest size, greatest digest: a filter and one maximum over the
    table, and there are at most labels x splits steps. A label with too few components fails.
    """
    counts = {r["label"]: r["n"] for r in components.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = sorted(k for k, n in counts.items() if n < len(required))
    if short:
        raise ValueError(f"not enough components for labels {short}")
    total = components.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = {k: v * total for k, v in targets.items()}
    token = {k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() for k in targets}
    covered, assigned, taken = {k: set() for k in required}, dict.fromkeys(targets, 0), {}
    scarce = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1.0 / n)]) if counts else None
    for label in sorted(counts, key=lambda k: (counts[k], k)):
        for split in sorted(required, key=lambda k: (target[k], token[k])):
            if label in covered[split]:
                continue
            have = F.array(*map(F.lit, sorted(covered[split]))) if covered[split] else F.expr("cast(array() as array<string>)")
            fresh = F.array_except(F.array_distinct("labels"), have)
            gain = F.aggregate(F.array_sort(fresh), F.lit(0.0), lambda a, x: a + F.element_at(scarce, x))
            room = F.least(F.lit(target[split] - assigned[split]) - F.col("size"), F.lit(0.0))
            score = F.struct(F.size(fresh).alias("a"), gain.alias("b"), room.alias("c"), (-F.col("size")).alias("d"), F.col("digest").alias("e"), F.col("component").alias("f"))
            free = components.where(F.array_contains("labels", label))
            if taken:
                free = free.where(~F.col("component").isin(list(taken)))
            best = free.agg(F.max_by(F.struct("component", "size", "labels"), score).alias("x")).first()["x"]
            if best is None:
                raise ValueError(f"no component left for label {label} in {split}")
            taken[best["component"]] = split
            assigned[split] += best["size"]
            covered[split] |= set(best["labels"])
    seeded = components.sparkSession.createDataFrame(list(taken.items()) or [(None, None)], components.select("component", F.lit("").alias("split")).schema).where("split IS NOT NULL")
    rest = components.join(F.broadcast(seeded.select("component")), "component", "left_anti")  # at most labels x splits rows
    return greedy_split(rest.select("component", "size"), targets, seed, assigned, total).unionByName(seeded)


def balanced_split(components: DataFrame, targets: Mapping[str, float], seed: str) -> DataFrame:
    """(component, split) with the least 4 documents^2 + 2 clean^2 + hard^2 of relative errors, component by component.

    components: component, size, n_clean, n_hard. Hard, then clean, then large components come first. Components of equal
    figures are dealt in hashed order; the sum of squares grows by a fixed amount more with each that a split has, so the
    split of a component follows from its rank, and the driver keeps one row per combination of figures. A component above
    the largest target, or a split left empty or off by more than a component, fails. Ties go to the smaller hash.
    """
    figures = ["size", "n_clean", "n_hard"]
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256)
    components = components.select("component", *[F.col(c).cast("long").alias(c) for c in figures])
    ranked = ranked_in_order(components.withColumn("_h", h), figures, F.substring("_h", 1, 3), ["_h", "component"])
    rows = [tuple(r) for r in components.groupBy(*figures).agg(F.count(F.lit(1)).alias("n")).collect()]  # one row per combination
    rows.sort(key=lambda r: (-(r[2] > 0), -(r[1] > 0), -r[0], r[1], r[2]))
    sums = [sum(r[i] * r[3] for r in rows) for i in range(3)]
    aims = {k: [v * s for s in sums] for k, v in targets.items()}
    largest = max((r[0] for r in rows), default=0)
    if rows and largest > -(-max(a[0] for a in aims.values()) // 1):
        raise ValueError("a component is larger than the largest split")
    if any(r[0] < 1 for r in rows):
        raise ValueError("a component has no documents")
    splits = sorted(targets, key=lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    now, plan = {k: [0, 0, 0] for k in splits}, []
    scale = {k: [w / max(1.0, a) ** 2 for w, a in zip((4.0, 2.0, 1.0), aims[k], strict=True)] for k in splits}
    for *own, n in rows:
        first = [sum(w * o * (2 * (x - a) + o) for w, o, x, a in zip(scale[k], own, now[k], aims[k], strict=True)) for k in splits]
        step = [sum(2 * w * o * o for w, o in zip(scale[k], own, strict=True)) for k in splits]
        plan.append((*own, first, step))
        for k, m in zip(splits, taken(first, step, n), strict=True):
            now[k] = [x + o * m for x, o in zip(now[k], own, strict=True)]
    if rows and any(v[0] == 0 for v in now.values()):
        raise ValueError("a split is empty")
    if any(abs(now[k][0] - aims[k][0]) > max(1, largest) for k in targets):
        raise ValueError("a split is off by more than a component")
    return deal(ranked, figures, plan, splits)


def close_over_groups(members: DataFrame) -> DataFrame:
    """members(member, group, split) -> member, group, owner, clash: validation owns groups that touch it; a group that
    touches test and another split clashes."""
    g = members.groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("s"))
    test, other = F.array_contains("s", "test"), F.size(F.array_remove("s", "test")) > 0
    owner = F.when(F.array_contains("s", "validation"), F.lit("validation")).when(F.array_contains("s", "train"), F.lit("train"))
    g = g.select("group", owner.alias("owner"), (test & other).alias("clash"))
    return members.join(g, "group").select("member", "group", F.when(F.col("split") == "test", F.lit("test")).otherwise(F.col("owner")).alias("owner"), "clash")


def allocate_campaign(categories: Sequence[str], quotas: Mapping[str, int]) -> dict[str, dict[str, int]]:
    """Even shares of the total per category, dealt to the splits in order, each place to the category with most left."""
    total = sum(quotas.values())
    left = {c: total // len(categories) + (i < total % len(categories)) for i, c in enumerate(categories)}
    out: dict[str, dict[str, int]] = {}
    for turn, (split, n) in enumerate(quotas.items()):
        out[split] = dict.fromkeys(categories, 0)
        for _ in range(n):
            best = max((c for c in categories if left[c]), key=lambda c: (left[c], -((categories.index(c) - turn) % len(categories))))
            out[split][best] += 1
            left[best] -= 1
    return out


# packing and templates -----------------------------------------------------------------------------------------------


def _in_hashed_order(docs: DataFrame, seed: str, block: int, store: Store) -> DataFrame:
    """``docs`` with _at, rising in hashed order over all rows, and the block of about ``block`` rows that it lies in."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), 256)
    rows = docs.withColumn("_h", h).repartitionByRange("_h", "doc_id").sortWithinPartitions("_h", "doc_id").withColumn("_at", F.monotonically_increasing_id())
    return store(rows.withColumn("_block", F.expr(f"_at div {block}")))


def _per_block(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per block with the columns of its rows as lists in order; a block is bounded, so its row is."""
    listed = F.array_sort(F.collect_list(F.struct("_at", *columns)))
    blocks = rows.groupBy("_block").agg(listed.alias("_rows"))
    return blocks.select("_block", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def open_sizes(n: Sequence[int], least: int, most: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a block of documents of ``n`` tokens makes of every open pack size: the size left open, and how many packs it opens."""
    size, opened = size.copy(), np.zeros(len(size), np.int64)
    for x in n:
        size = np.where(size + x > most, 0, size)
        opened += size == 0
        size += x
        size = np.where(size >= least, 0, size)
    return size, opened


def greedy_packs(docs: DataFrame, seed: str, store: Store, least: int = 128, most: int = 192, block: int = 8192) -> DataFrame:
    """docs(doc_id, n): (pack, position, doc_id) of packs of ``least`` to ``most`` tokens, built by a walk in hashed order.

    A document joins the open pack unless that would pass ``most``; a pack closes as soon as it reaches ``least``. Packs
    that end outside the bounds are given up. What a block of documents does depends on the walk before it only by the
    size of the open pack, of which there are ``least``; so blocks tabulate that apart from each other, their tables are
    put together in order, one row per block, and the blocks then place their documents apart again. Packs are numbered
    in the order in which they are opened, those given up included. Documents without tokens are in none.
    """
    rows = _in_hashed_order(docs.where("n > 0").select("doc_id", "n"), seed, block, store)
    blocks = store(_per_block(rows, ["doc_id", "n"]))
    states = np.arange(least)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [open_sizes(n, least, most, states) for n in b.column("n").to_pylist()]
            lists = [pa.array([f[i].tolist() for f in found], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("_block"), *lists], ["_block", "left", "opened"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The size of the open pack before every block, and how many packs were opened by then."""
        size, packs = 0, 0
        for b in batches:
            out, (left, opened) = [], (b.column(c) for c in ("left", "opened"))
            for k in range(b.num_rows):
                out.append((b.column("_block")[k].as_py(), size, packs))
                packs += opened[k][size].as_py()
                size = left[k][size].as_py()
            columns = [pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)]
            yield pa.RecordBatch.from_arrays(columns, ["_block", "size", "packs"])

    tables = blocks.select("_block", "n").mapInArrow(tabulate, "_block long, left array<long>, opened array<long>")
    # one row of least x 2 numbers per block, read in order by one task that holds two numbers
    chained = store(tables.repartition(1).sortWithinPartitions("_block").mapInArrow(chain, "_block long, size long, packs long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, doc_id, at, state): the pack of every document, and per pack that closes here whether it is in bounds."""
        for b in batches:
            for k in range(b.num_rows):
                size, pack = b.column("size")[k].as_py(), b.column("packs")[k].as_py() - 1
                out, at = [], b.column("_block")[k].as_py() * block
                for i, (d, n) in enumerate(zip(b.column("doc_id")[k].as_py(), b.column("n")[k].as_py(), strict=True)):
                    if size and size + n > most:
                        out.append((pack, None, None, least <= size <= most))
                        size = 0
                    pack += size == 0
                    size += n
                    out.append((pack, d, at + i, None))
                    if size >= least:
                        out.append((pack, None, None, size <= most))
                        size = 0
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["pack", "doc_id", "at", "good"])

    placed = store(blocks.join(chained, "_block").mapInArrow(place, "pack long, doc_id long, at long, good boolean"))
    good = placed.where("good").select("pack")
    kept = placed.where("at IS NOT NULL").join(good, "pack", "left_semi")
    position = F.row_number().over(Window.partitionBy("pack").orderBy("at")) - 1  # a pack has most documents at most
    return kept.select("pack", position.cast("int").alias("position"), "doc_id")


def low_density_packs(docs: DataFrame, seed: str, store: Store, least: int = 128, most: int = 192, block: int = 8192) -> DataFrame:
    """docs(doc_id, n, positive): (pack, position, doc_id) of one positive, which names the pack, and the negatives that follow it.

    The hashed order is cut into blocks of ``block`` rows, as many as there is data for. In a block every positive takes the
    negatives from where the one before it stopped, round and round, as many as reach ``least``; one that would pass ``most``
    is used up and ends the pack, which is given up if it is too short.
    """
    blocks = _per_block(_in_hashed_order(docs.select("doc_id", "n", "positive"), seed, block, store), ["doc_id", "n", "positive"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, marks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "positive")), strict=True):
                rows = list(zip(ids, sizes, marks, strict=True))
                pool, at, out = [(d, n) for d, n, p in rows if not p], 0, []
                for first, size in ((d, n) for d, n, p in rows if p):
                    pack = [first]
                    for _ in range(len(pool) if size < least else 0):
                        d, n = pool[at % len(pool)]
                        at += 1
                        if size + n > most:
                            break
                        pack.append(d)
                        size += n
                        if size >= least:
                            break
                    if least <= size <= most:
                        out += [(first, i, d) for i, d in enumerate(pack)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["pack", "position", "doc_id"])

    return blocks.mapInArrow(walk, "pack long, position int, doc_id long")


def combine(parts: DataFrame, connector: str = "\n") -> DataFrame:
    """parts(pack, position, text, spans array<start,end,label>) -> pack, text, spans at their new offsets, n_parts.

    Offsets are running sums over the pack, so that a pack of many parts costs no more than its text.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")
    spans = F.coalesce(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))), none)
    lead = F.when(F.col("position") > 0, F.lit(connector)).otherwise(F.lit(""))
    rows = parts.select("pack", "position", F.coalesce("text", F.lit("")).alias("text"), spans.alias("spans"), lead.alias("lead"))
    in_order = Window.partitionBy("pack").orderBy("position", "text", "spans")
    length = F.char_length("lead") + F.char_length("text")
    placed = rows.select("pack", F.row_number().over(in_order).alias("i"), F.concat("lead", "text").alias("out"), "spans",
                         (F.sum(length).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("text")).cast("int").alias("at"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).cast("int").alias("start"), (s["end"] + F.col("at")).cast("int").alias("end"), s["label"].alias("label")))
    packs = placed.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("i", "out", moved.alias("spans")))).alias("p"))
    return packs.select("pack", F.array_join("p.out", "").alias("text"), F.flatten("p.spans").alias("spans"), F.size("p").alias("n_parts"))


def unique_records(docs: DataFrame, order: str, store: Store, rounds: int = 3) -> DataFrame:
    """The rows that a walk in ``order`` keeps, which leaves out each whose doc_id or text an earlier kept row has.

    In a round, the rows that come first in both of their groups are kept and what conflicts with them goes. Most conflicts
    are settled so. Chains, where a row waits for one before it, would take a round a link: after ``rounds`` of them what is
    left is split into connected parts, and each part is walked in order, as a stream, in one pass over the data. Rows
    whose id or text is null conflict with those whose is null as well.
    """
    keys = docs.select(F.xxhash64("doc_id").alias("_i"), F.sha2(F.col("text"), 256).alias("_h"), F.col(order).alias("_o"), F.col("doc_id").alias("_d"))
    left, kept = store(keys), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        first = lambda key: F.min("_o").over(Window.partitionBy(key)) == F.col("_o")
        now = store(left.withColumn("_a", first("_d")).withColumn("_b", first("_h")).where("_a AND _b").drop("_a", "_b"))
        kept.append(now.select("_o"))
        ids, texts = now.select(F.col("_d").alias("_x")).distinct(), now.select(F.col("_h").alias("_y")).distinct()
        left = left.join(ids, F.col("_d").eqNullSafe(F.col("_x")), "left_anti")
        left = store(left.join(texts, F.col("_h").eqNullSafe(F.col("_y")), "left_anti"))
    if not left.isEmpty():
        kept.append(_walked(left, store))
    wanted = reduce(DataFrame.unionByName, kept) if kept else keys.select("_o").limit(0)
    return docs.join(wanted, F.col(order) == F.col("_o"), "left_semi")


def _walked(left: DataFrame, store: Store) -> DataFrame:
    """Places that the walk keeps of rows whose conflicts chain: one walk for each connected part."""
    text = F.xxhash64(F.coalesce("_h", F.lit("")), F.lit(1))
    nodes = connected_components(left.select(F.col("_i").alias("a"), text.alias("b")), store)
    parted = left.withColumn("_t", text).join(nodes, F.col("_i") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "_i"))
    lined = parted.repartition("_c").sortWithinPartitions("_c", "_o").select("_c", "_o", "_d", "_h")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, texts = None, set(), set()
        for b in batches:
            part, place, keep = b.column("_c").to_pylist(), b.column("_o"), []
            for c, d, h in zip(part, b.column("_d").to_pylist(), b.column("_h").to_pylist(), strict=True):
                if c != own:
                    own, ids, texts = c, set(), set()
                keep.append(d not in ids and h not in texts)
                if keep[-1]:
                    ids.add(d)
                    texts.add(h)
            yield pa.RecordBatch.from_arrays([place.filter(pa.array(keep, pa.bool_()))], ["_o"])

    return lined.mapInArrow(walk, f"_o {left.schema['_o'].dataType.simpleString()}")


SLOT = r"\{[a-z_]+\}"


def render(template: Column, values: Column, labels: Column) -> Column:
    """Struct (text, spans): every {slot} of the template replaced by its value, spans where ``labels`` names the slot.

    ``values`` and ``labels``: maps from slot to string. One pass from left to right, so offsets are exact.
    """
    def edit(m: Column) -> Column:
        name = F.substring(m["value"], F.lit(2), F.char_length(m["value"]) - 2)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(F.element_at(labels, name), F.lit("")).alias("label"),
                        F.coalesce(F.element_at(values, name), F.raise_error(F.concat(F.lit("no value for "), name)).cast("string")).alias("value"))

    done = rebuild(template, F.transform(find_spans(template, SLOT), edit))
    return F.struct(done["text"].alias("text"), F.filter(done["spans"], lambda s: s["label"] != "").alias("spans"))


def cycled_templates(spark: SparkSession, templates: Sequence[str], n: int, seed: str) -> DataFrame:
    """(serial, template): whole cycles, each a hashed order of all templates, before one is used again."""
    k = len(templates)
    rows = spark.range(-(-n // k)).select(F.col("id").alias("cycle"), F.explode(F.array(*map(F.lit, templates))).alias("template"))
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("cycle").cast("string"), "template"), 256)
    place = F.row_number().over(Window.partitionBy("cycle").orderBy(h, "template")) - 1
    return rows.select((F.col("cycle") * k + place).alias("serial"), "template").where(F.col("serial") < n)


def reserved_values(rows: DataFrame, modulus: int, step: int, offset: int) -> DataFrame:
    """Per serial of ``rows`` unique values from names that are reserved for examples: mails, IPv6 and MAC addresses, numbers of unused regions."""
    v = F.pmod(F.col("serial") * step + offset, F.lit(modulus))
    hexed = lambda shift, digits: F.lower(F.lpad(F.hex(F.pmod(F.floor(v / shift), F.lit(16**digits)).cast("long")), digits, "0"))
    return rows.select(
        "serial", F.concat(F.lit("user"), v.cast("string"), F.lit("@example.invalid")).alias("mail"),
        F.concat(F.lit("2001:db8::"), hexed(1 << 16, 4), F.lit(":"), hexed(1, 4)).alias("ipv6"),
        F.concat(F.lit("02:00:00:"), hexed(1 << 16, 2), F.lit(":"), hexed(1 << 8, 2), F.lit(":"), hexed(1, 2)).alias("mac"),
        F.concat(F.lit("9900"), F.lpad(v.cast("string"), 8, "0")).alias("number"),
    )


# audits --------------------------------------------------------------------------------------------------------------

# Words that would let a model learn the surface.
SHORTCUTS = ("test", "syn", "测试", "示例", "合成", "虚构", "演练")


def surface_violations(docs: DataFrame, values: DataFrame, shortcuts: Sequence[str] = SHORTCUTS) -> DataFrame:
    """One row (texts, values, repeated): texts and values with a shortcut word, and value groups used more than once."""
    # lower case, and the long s and the two st ligatures, which full case folding turns into ASCII letters as well
    folded = lambda c: F.regexp_replace(F.translate(F.lower(F.col(c)), "ſ", "s"), "[ﬅﬆ]", "st")
    hit = lambda c: F.coalesce(F.sum(contains_any(folded(c), shortcuts).cast("long")), F.lit(0))
    texts = docs.agg(hit("text").alias("texts"))
    own = values.agg(hit("value").alias("values"))
    again = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("repeated"))
    return texts.join(own).join(again)  # one row each


FINGERPRINTS = ("document_id", "template_group", "entity_value_group", "source_group")


def split_fingerprints(docs: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(kind, split, fingerprint): namespaced hashes of the given columns (arrays give one each)."""
    types, out = dict(docs.dtypes), None
    for kind, column in columns.items():
        value = F.explode(column) if types[column].startswith("array") else F.col(column)
        part = docs.select(F.lit(kind).alias("kind"), "split", value.alias("_v")).where("_v IS NOT NULL")
        part = part.select("kind", "split", F.sha2(F.concat(F.lit(f"pii-zh-split-v1\0{kind}\0"), F.col("_v").cast("string")), 256).alias("fingerprint"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def disjointness(prints: DataFrame, a: str = "train", b: str = "validation") -> DataFrame:
    """(kind, collisions) between two splits, also where there are none."""
    both = prints.where(F.col("split").isin(a, b)).groupBy("kind", "fingerprint").agg(F.count_distinct("split").alias("s"))
    return both.groupBy("kind").agg(F.sum((F.col("s") > 1).cast("long")).alias("collisions"))


def require_disjoint(prints: DataFrame, a: str = "train", b: str = "validation") -> None:
    bad = disjointness(prints, a, b).where("collisions > 0").collect()  # one row per kind
    if bad:
        raise ValueError("shared between splits: " + ", ".join(f"{r['kind']}={r['collisions']}" for r in sorted(bad)))


def require_one_split(leaks: DataFrame) -> None:
    """Raise if ``leakage`` found a key in several splits."""
    if (n := leaks.count()) > 0:
        raise ValueError(f"{n} keys lie in several splits")


def benchmark_statistics(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per split, and over all (split null): rows, rows without spans, spans, characters, extremes."""
    n = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = docs.join(n, "doc_id", "left").na.fill(0, ["_n"])
    return rows.rollup("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("_n") == 0).cast("long")).alias("clean_rows"), F.sum("_n").alias("n_spans"), F.sum("text_length").alias("n_chars"),
        F.min("text_length").alias("min_chars"), F.max("text_length").alias("max_chars"), F.min("_n").alias("min_spans"), F.max("_n").alias("max_spans"),
    )


# Surfaces that a skeleton masks.
ASCII_SURFACE = r"(?<![A-Za-z0-9])([A-Za-z0-9][A-Za-z0-9@._:/+*\-]{5,}[A-Za-z0-9])(?![A-Za-z0-9])"
CN_DATE = r"(?U)(?<!\d)((?:19|20|21)\d{2}年\d{1,2}月\d{1,2}日)(?!\d)"


def structured_surfaces(text: Column) -> Column:
    """array<struct<start,end,value>> of ASCII surfaces of seven or more characters and of dates, distinct, in order."""
    of = lambda p: F.transform(find_spans(text, p, 1), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.array_sort(F.array_distinct(F.concat(of(ASCII_SURFACE), of(CN_DATE))))


def masked_skeleton(text: Column, mask: str = "占位") -> Column:
    """The text with every structured surface masked, without case and white space."""
    masked = replace_spans(text, structured_surfaces(text), lambda m: F.lit(mask))
    return F.replace(F.lower(F.regexp_replace(masked, r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))


def split_profile(docs: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """Per split: records, clean ones, distinct templates, distinct labels, values used twice (must be 0)."""
    n = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    base = docs.join(n, "doc_id", "left").na.fill(0, ["_n"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum((F.col("_n") == 0).cast("long")).alias("clean"), F.count_distinct("template").alias("templates")
    )
    own = labels.join(docs.select("doc_id", "split"), "doc_id").groupBy("split").agg(F.count_distinct("label").alias("labels"))
    twice = values.join(docs.select("doc_id", "split"), "doc_id").groupBy("split", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("split").agg(F.count(F.lit(1)).alias("repeated_values"))
    return base.join(own, "split", "left").join(twice, "split", "left").na.fill(0, ["labels", "repeated_values"])


def rewrite_in_turn(docs: DataFrame, chosen: Column, cell: Sequence[str], order: str, modes: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Add mode: of the chosen rows, in turn within their cell by ``order``; null for all others, which stay as they are."""
    marked = docs.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    ranked = ranked_in_order(marked.where("_chosen"), list(cell), F.lpad(F.floor(F.col(order) / block).cast("string"), 12, "0"), [order])
    mode = F.element_at(F.array(*map(F.lit, modes)), (F.pmod(F.col("_rank") - 1, F.lit(len(modes))) + 1).cast("int"))
    rewritten = ranked.withColumn("mode", mode).select(*docs.columns, "mode")
    return rewritten.unionByName(marked.where("NOT _chosen").select(*docs.columns, F.lit(None).cast("string").alias("mode")))


def single_candidate(text: Column, start: Column, end: Column, case_start: Column, case_end: Column) -> Column:
    """Whether the candidate's slice occurs exactly once in the text and differs from the case value."""
    value = slice_text(text, start, end)
    times = (F.char_length(text) - F.char_length(F.replace(text, value, F.lit("")))) / F.greatest(F.char_length(value), F.lit(1))
    return (F.char_length(value) > 0) & (times == 1) & (value != slice_text(text, case_start, case_end))


def token_scope(tokens: DataFrame, numeric: Column, weight: int = 4) -> DataFrame:
    """tokens(tag): valid tokens, numeric ones outside and inside entities, and the shares that a weight on the former gives."""
    outside = F.col("tag") == "O"
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = tokens.agg(F.count(F.lit(1)).alias("valid"), count(numeric & outside).alias("digit_o"), count(numeric & ~outside).alias("digit_entity"))
    mass = F.lit(weight) * F.col("digit_o")
    whole = F.col("valid") + F.lit(weight - 1) * F.col("digit_o")
    share = lambda a, b: F.when(b > 0, a / b)
    return c.withColumns({
        "o_fraction": share(F.col("digit_o"), F.col("valid")), "entity_fraction": share(F.col("digit_entity"), F.col("valid")),
        "weighted_fraction": share(mass, whole), "entity_over_o": share(F.col("digit_entity"), F.col("digit_o")),
    })


def recipe_audit(docs: DataFrame, wanted: Mapping[str, int], least_clean: float, least_templates: int) -> DataFrame:
    """docs(split, clean, template, cue): per split the counts and whether its gates hold: size, clean share, templates, cue placement."""
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("split")), F.lit(-1))
    g = docs.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("clean").cast("long")).alias("n_clean"), F.count_distinct("template").alias("templates"),
                                  F.count_distinct("cue").alias("cues"))
    return g.select("split", "n", "n_clean", "templates", "cues", (F.col("n") == size).alias("size_ok"), (F.col("n_clean") >= F.col("n") * F.lit(least_clean)).alias("clean_ok"),
                    (F.col("templates") >= least_templates).alias("templates_ok"), (F.col("cues") >= 2).alias("cues_ok"))


# contracts -----------------------------------------------------------------------------------------------------------

# The frozen composition.
CONTRACT = {"train": 14_000, "validation": 2_000, "public_test": 2_000, "hidden_leaderboard": 2_000}
CLEAN_SHARE, HARD_SHARE = 0.40, 0.25


def contract_check(docs: DataFrame, splits: Mapping[str, int] = CONTRACT) -> DataFrame:
    """docs(split, clean, hard_negative): one row of what the frozen contract asks and whether it holds."""
    n = F.count(F.lit(1))
    per = [(F.coalesce(F.sum((F.col("split") == s).cast("long")), F.lit(0)) == k) for s, k in splits.items()]
    sizes = per[0]
    for p in per[1:]:
        sizes = sizes & p
    clean, hard = F.coalesce(F.sum(F.col("clean").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("hard_negative").cast("long")), F.lit(0))
    return docs.agg(n.alias("n"), (n == sum(splits.values())).alias("total_ok"), sizes.alias("splits_ok"), (clean * 100 == n * round(100 * CLEAN_SHARE)).alias("clean_ok"), (hard >= n * F.lit(HARD_SHARE)).alias("hard_ok"))


def canonical_hash(value: object) -> str:
    """sha256 of a value as JSON with sorted keys, compact, ASCII."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def row_hash(df: DataFrame, name: str = "row_sha256") -> DataFrame:
    """Add the canonical hash of each row's ASCII content: JSON with fields in alphabetical order."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


# Keys that only declare what is denied, flags that must not be true, flags that must not be false for a
# purpose, keys that hold a state, and marks of retirement in them.
DECLARATIONS = ("denied_artifacts", "denied_ids", "forbidden_parent_artifacts", "prohibited_inputs")
DENIED_TRUE = (
    "artifact_test_informed_ancestry", "generator_defect_ancestry", "generator_defect_retired", "retired_due_to_generator_defect", "test_informed_ancestry",
)
DENIED_FALSE = {
    "training": ("training_eligible", "public_weight_training_allowed", "weight_training_eligible"),
    "release": ("release_eligible", "pii_release_eligible"),
    "confirmatory_evaluation": ("confirmatory_evaluation_eligible", "external_benchmark_confirmatory_eligible", "PII_Bench_confirmatory_eligible"),
    "ancestry": ("ancestry_eligible", "v3_parent_eligible"),
}
STATUS_KEYS = ("classification", "storage_class", "status", "artifact_status")
RETIRED = ("diagnostic_generator_defect", "generator_defect_retired", "retired_generator_defect", "test_informed_diagnostic")


def denied_documents(docs: DataFrame, values: Sequence[str], purpose: str, store: Store, key: str = "doc_id", document: str = "document") -> DataFrame:
    """(key, denied) per row of ``docs``: whether its JSON document may not be used for ``purpose``.

    A document is denied if a key or text at any depth is one of ``values``, if a flag of DENIED_TRUE is true or one of the
    purpose's flags false, if any known flag is no boolean, or if a state holds a mark of retirement; what lies below a key
    of DECLARATIONS doesn't count. Documents that are null, broken or repeat a key are denied. The tree is unfolded level by
    level as VARIANT, so there are as many rounds as the deepest document has levels, and nothing leaves the JVM.
    """
    if purpose not in DENIED_FALSE:
        raise ValueError(f"unknown purpose {purpose}")
    flags = sorted({*DENIED_TRUE, *(f for own in DENIED_FALSE.values() for f in own)})
    level = store(docs.select(F.col(key).alias("_key"), F.try_parse_json(document).alias("value"), F.lit(None).cast("string").alias("name")))
    found = [level.where("value IS NULL").select("_key")]
    name, kind, text = F.col("name"), F.schema_of_variant("value"), F.try_variant_get("value", "$", "string")
    open_ = F.coalesce(~name.isin(*DECLARATIONS), F.lit(True))
    is_true = (kind == "BOOLEAN") & (text == "true")
    marked = name.isin(*STATUS_KEYS) & (kind == "STRING") & contains_any(F.lower(text), RETIRED)
    unsafe = (name.isin(*flags) & (kind != "BOOLEAN")) | (name.isin(*DENIED_TRUE) & is_true) | (name.isin(*DENIED_FALSE[purpose]) & (kind == "BOOLEAN") & (text == "false")) | marked
    listed = F.lit(False) if not values else name.isin(*values) | (open_ & (kind == "STRING") & text.isin(*values))
    while not level.isEmpty():
        found.append(level.where(F.coalesce(listed, F.lit(False)) | F.coalesce(open_ & unsafe, F.lit(False))).select("_key"))
        below = docs.sparkSession.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("_name"), F.col("value").alias("_value"))
        level = store(level.where(open_ & kind.rlike("^(OBJECT|ARRAY)")).lateralJoin(below).select("_key", F.col("_value").alias("value"), F.col("_name").alias("name")))
    hits = reduce(DataFrame.unionByName, found).distinct().withColumn("denied", F.lit(True))
    rows = docs.select(F.col(key).alias(key))
    return rows.join(hits, rows[key].eqNullSafe(hits["_key"]), "left").select(key, F.coalesce("denied", F.lit(False)).alias("denied"))


def require_aggregate(report: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """``report`` if its columns are all allowed and none is a text, an id or a value; otherwise it fails before anything runs."""
    extra = [c for c in report.columns if c not in allowed]
    named = [c for c in report.columns if c in ("text", "doc_id", "value", "spans", "entities")]
    if extra or named:
        raise ValueError(f"not an aggregate report: {sorted(set(extra + named))}")
    return report
