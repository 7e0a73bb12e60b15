"""Packing documents into fixed-length sequences along a Hilbert curve through their content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, shuffle_partitions, stored, table
from spanloom.llm.token_files import _ENCODERS, encoder_for, id_bytes, id_lists

DIMENSIONS, BITS = 4, 10
#: Bits of the order key below the curve position, filled from a hash of the document id: they spread groups of copies,
#: which share a position, over several ranges.
TIE_BITS = 62 - DIMENSIONS * BITS


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def directions(vocabulary: int) -> np.ndarray:
    """One hashed vector of DIMENSIONS numbers around zero, of unit variance, per token id."""
    cells = np.arange(1, vocabulary * DIMENSIONS + 1, dtype=np.uint64)
    uniform = mix64(cells).astype(np.float64) / 2.0**64
    return ((uniform - 0.5) * np.sqrt(12)).reshape(vocabulary, DIMENSIONS).astype(np.float32)


def project(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The document's set of token ids as a point of the unit cube: the hashed sum, squashed per dimension."""
    if not len(ids):
        return np.full(DIMENSIONS, 0.5)
    distinct = np.unique(ids)
    z = table[distinct].sum(0) / np.sqrt(len(distinct))
    return 0.5 + 0.5 * np.tanh(0.8 * z)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``points`` (numbers in [0, 1]).

    The coordinates are turned level by level into the curve's frame, and the Gray code of the interleaved bits gives the position.
    """
    n = points.shape[1]
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations that the coarser levels bring
        low = level - 1
        for i in range(n):
            upper = (x[i] & level) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[n - 1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tail_cuts(total: int, length: int) -> list[int]:
    """Ends of the sequences after the last full one: the rest of the tokens in falling powers of two, so without padding."""
    at, cuts = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, text: str = "text",
    bucket_tokens: int = 2_000_000, as_bytes: bool = False,
) -> DataFrame:
    """Cut all documents, laid end to end along the curve, into sequences of ``length`` tokens.

    Returns per piece doc_id, start, length, ids, doc_tokens, sequence_id and offset; ids is a list of ints, or with
    ``as_bytes`` little-endian unsigned 32-bit numbers. Every sequence is full but the last few of the whole corpus, whose
    lengths are falling powers of two, so nothing is padded. Documents are encoded once and stored with their order key;
    the corpus is split into ranges of the key that hold about ``bucket_tokens`` tokens, at most four per shuffle partition;
    one small row per range gives each its first position, and each range is then sorted and cut on its own.

    Null texts are empty (only the end id), long ones are encoded a few at a time. Rows with equal keys follow by doc_id,
    then by their number of tokens; full repeats are packed as often as they occur. Extra columns are left out; no rows
    give no pieces.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        vectors = directions(1 << 16 if encoder.code.itemsize == 2 else encoder.tokenizer.get_vocab_size() + 1)
        for b, ids, n in encoder.chunks(batches, end_id):
            ends = np.cumsum(n).tolist()
            points = np.array([project(ids[e - k : e - 1], vectors) for e, k in zip(ends, n.tolist(), strict=True)])
            ties = b.column("tie").to_numpy(zero_copy_only=False) & ((1 << TIE_BITS) - 1)
            keys = (hilbert_key(points) << TIE_BITS) | ties
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(n), id_bytes(ids, n)], ["doc_id", "key", "n", "ids"])

    source = docs.select("doc_id", F.col(text).cast("string").alias("text"), F.xxhash64("doc_id").alias("tie"))
    coded = stored(source.mapInArrow(encode, "doc_id long, key long, n long, ids binary"), "packing-ids")
    total = coded.agg(F.sum("n")).first()[0] or 0
    partitions = shuffle_partitions(spark)
    ranges = max(1, min(4 * partitions, 1 + total // max(1, bucket_tokens // 8)))
    points = [i / ranges for i in range(1, ranges)]
    splits = coded.agg(F.percentile_approx("key", points, 20 * ranges)).first()[0] if points else []
    splits = np.unique(np.array(splits or [], np.int64))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.searchsorted(splits, b.column("key").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket)], [*b.schema.names, "bucket"])

    sums = coded.select("key", "n").mapInArrow(locate, "key long, n long, bucket int").groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = np.zeros(len(splits) + 2, np.int64)  # one number per range
    for row in sums.collect():
        starts[row["bucket"] + 1] = row["n"]
    starts = np.cumsum(starts)
    total = int(starts[-1])
    full = total // length * length
    tail = np.array([full, *tail_cuts(total, length)], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # a worker that has encoded gives its tables back
        bucket, at = -1, 0
        for b in byte_slices(batches, "ids", most_rows=10_000):
            own, n = b.column("bucket").to_numpy(), b.column("n").to_numpy()
            raw = b"".join(b.column("ids").to_pylist())
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(n.sum()) else "<u4")
            ends = np.cumsum(n)
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(n)]
            for i, j in zip(edges, edges[1:], strict=False):
                if own[i] != bucket:
                    bucket, at = int(own[i]), int(starts[own[i]])
                # rows i..j lie end to end from position ``at``; pieces start at rows and at the ends of sequences
                first = at + np.concatenate([[0], ends[i : j - 1] - ends[i] + n[i]])
                last = at + int(n[i:j].sum())
                seams = np.concatenate([np.arange(at // length + 1, min(last, full) // length + 1) * length, tail])
                piece = np.unique(np.concatenate([first, seams[(seams > at) & (seams < last)]]))
                row = np.searchsorted(first, piece, "right") - 1
                size = np.diff(np.append(piece, last))
                k = np.searchsorted(tail, piece, "right")
                whole = k == 0
                sequence = np.where(whole, piece // length, full // length + k - 1)
                offset = np.where(whole, piece % length, piece - tail[np.maximum(k, 1) - 1])
                mine = ids[ends[i] - n[i] :][: last - at]
                lists = id_bytes(mine.astype("<u4"), size) if as_bytes else id_lists(mine, size)
                at = last
                of = b.slice(i, j - i)
                long = lambda x: pa.array(x.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [of.column("doc_id").take(pa.array(row)), long(piece - first[row]), long(size), lists, long(n[i:j][row]), long(sequence), long(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    dealt = coded.mapInArrow(locate, "doc_id long, key long, n long, ids binary, bucket int")
    dealt = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "n")
    kind = "binary" if as_bytes else "array<int>"
    return dealt.mapInArrow(cut, f"doc_id long, start long, length long, ids {kind}, doc_tokens long, sequence_id long, offset long")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, as_bytes=True)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
