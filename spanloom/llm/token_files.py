"""Token ids of a corpus as Parquet list columns that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, scratch, shuffle_partitions, table

#: Writer settings of a token file: dictionary codes for the ids, delta coding for the sorted metadata columns, small
#: pages with their index, and row groups that one task can hold.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
}


#: Words of ASCII and Latin-1 letters only: one pre-token each, whatever the neighbours.
LETTERS = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: A word that ends in a letter and then ASCII marks (but ' and <, which can start tokens of their own): the ids of both parts.
CLOSED = "^(?P<body>.*[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])(?P<tail>[!-&(-/:;=-@\\[-`{-~]+)$"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + sizes[i] - 1 of all i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class DocumentEncoder:
    """Encode whole texts with a tokenizer file, one distinct word at a time.

    For tokenizers that lower-case, drop white space and split letters from punctuation: the ids of a text are then
    those of its lower-cased words between ASCII white space, in order. Arrow splits a chunk of texts and numbers its
    distinct words, only parts of words that are not in the table yet reach the tokenizer, and numpy lays out the ids.
    The table stops growing at ``most`` parts; what it lacks is encoded again for each chunk. Texts that may hold a
    special token go to the tokenizer whole. ``code`` is the type of the ids, two bytes where the vocabulary allows it.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        ends = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.most, self.place = most, {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, self.code)

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the parts, numbers of ids in that order, and all ids; words of letters are told apart by their last ids."""
        letters = pc.match_substring_regex(parts, LETTERS).to_numpy(zero_copy_only=False)
        raw = parts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        plain, other = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        order, sizes, ids = [], [], []
        for i in range(0, len(plain), 1000):
            group = plain[i : i + 1000]
            joined = b" ".join([raw[k] for k in group]).decode()
            own = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.code)
            cuts = np.flatnonzero(self.ends[own]) + 1
            if len(cuts) != len(group):  # not a tokenizer of that kind
                other += group
                continue
            order += group
            sizes.append(np.diff(cuts, prepend=0))
            ids.append(own)
        for i in range(0, len(other), 10_000):
            group = other[i : i + 10_000]
            found = self.tokenizer.encode_batch_fast([raw[k].decode("utf-8", "replace") for k in group], add_special_tokens=False)
            order += group
            sizes.append(np.array([len(e.ids) for e in found]))
            ids += [np.array(e.ids, self.code) for e in found]
        return np.array(order, np.int64), np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, self.code), *ids])

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place and number of the ids of each of the distinct ``parts``, and the ids that the places point into."""
        raw = parts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        row = np.fromiter((self.place.get(p, -1) for p in raw), np.int64, len(raw))
        lacking = np.flatnonzero(row < 0)
        order, sizes, ids = self._encode_parts(parts.take(pa.array(lacking)))
        row[lacking[order]] = len(self.sizes) + np.arange(len(order))
        all_sizes, all_ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        starts = np.cumsum(all_sizes) - all_sizes
        room = min(len(order), self.most - len(self.sizes))
        if room > 0:
            self.place.update((raw[k], len(self.sizes) + i) for i, k in enumerate(lacking[order[:room]].tolist()))
            self.sizes, self.ids = all_sizes[: len(self.sizes) + room], all_ids[: len(self.ids) + int(sizes[:room].sum())]
        return starts[row], all_sizes[row], all_ids

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and the number of ids of each text; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        whole = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.code) for i in special}
        if whole:
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        closed = pc.extract_regex(coded.dictionary, CLOSED)
        body = pc.coalesce(pc.struct_field(closed, "body"), coded.dictionary)
        tail = pc.fill_null(pc.struct_field(closed, "tail"), "")
        parts = pa.concat_arrays([body, tail]).dictionary_encode()
        part = parts.indices.to_numpy()
        starts, sizes, ids = self._part_ids(parts.dictionary)
        # the ids of every distinct word: its body's, then its tail's
        pair = np.stack([part[: len(body)], part[len(body) :]], 1).ravel()
        word_sizes = sizes[pair].reshape(-1, 2).sum(1)
        word_ids = ids[spread(starts[pair], sizes[pair])]
        token = coded.indices.to_numpy()
        own = word_sizes[token]
        flat = word_ids[spread((np.cumsum(word_sizes) - word_sizes)[token], own)]
        at = np.concatenate([[0], np.cumsum(own)])
        edges = at[np.concatenate([[0], np.cumsum(counts)])]
        if whole:
            pieces = [whole.get(i, flat[edges[i] : edges[i + 1]]) for i in range(len(counts))]
            flat, edges = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return np.insert(flat, edges[1:], end_id).astype(self.code), np.diff(edges) + 1

    def chunks(self, batches: Iterator[pa.RecordBatch], end_id: int, text: str = "text", most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of the batches of about ``most_bytes`` of text, each with its ids and their number per row."""
        for part in byte_slices(batches, text, most_bytes, most_rows=10_000):
            yield part, *self.encode(part.column(text), end_id)


_ENCODERS: dict[str, DocumentEncoder] = {}


def encoder_for(path: str) -> DocumentEncoder:
    """One encoder per worker process: later tasks of the same worker find its tables filled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = DocumentEncoder(path)
    return _ENCODERS[path]


def id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Ids laid end to end as an Arrow array of int lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))


def id_bytes(ids: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Ids laid end to end as an Arrow array of byte strings, little-endian, as wide as the ids are."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def crc_of_ids(ids: pa.ListArray) -> list[int]:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
    at = ids.offsets.to_numpy()
    return [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", partitions: int | None = None
) -> None:
    """Write doc_id, shard, shard_start, n_tokens and ids of every document, in ascending doc_id order.

    Texts are dealt out by ranges of doc_id (rows of one id by a hash of the text), sorted, and encoded in the task that
    writes them, so ids never pass a shuffle. shard numbers the ranges in order; shard_start counts the ids before a
    document in its shard. Null texts are empty, rows with a null id come first, extra columns are left out.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    body = F.col(text).cast("string")
    dealt = docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("h")).repartitionByRange(n, "doc_id", "h")
    dealt = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b, ids, n_tokens in encoder_for(tokenizer).chunks(batches, end_id):
            starts = done + np.cumsum(n_tokens) - n_tokens
            done += len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("shard"), pa.array(starts), pa.array(n_tokens), id_lists(ids, n_tokens)],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )

    schema = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
    dealt.mapInArrow(encode, schema).write.options(**FILE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents from ``first`` to ``last`` (all without bounds).

    start counts the ids of all documents before; it needs only the metadata columns of the other files, and a range of
    ids only the row groups and pages whose statistics overlap it. The table of shard totals has one row per file.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("shard").alias("_shard"), before.alias("before"))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    rows = rows.join(F.broadcast(starts), F.col("shard") == F.col("_shard"))
    return rows.select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_crc(df: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace the list column ``ids`` by the crc32 of its ids."""
    rest = [c for c in df.columns if c != ids]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array(crc_of_ids(b.column(ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), crc], [*rest, name])

    types = dict(df.dtypes)
    return df.select(*rest, ids).mapInArrow(digest, ", ".join(f"{c} {types[c]}" for c in rest) + f", {name} long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return with_crc(read_token_files(spark, path))
