"""Log-probabilities of whole texts under a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, stored, table
from spanloom.llm.packing import mix64

#: Units of the upper level: the end, the most frequent words, classes of BLOCK words each of the learned vocabulary, and
#: classes of word endings for all words beyond it.
WORDS, CLASSES, BLOCK, RARE = 127, 96, 128, 32
VOCABULARY = CLASSES * BLOCK
UNITS = 1 + WORDS + CLASSES + RARE
START = UNITS
CONTEXT, DIM, NOISE, INNER, BATCH = 4, 24, 32, 4, 4096
#: Tokens that are scored at once: their logits stay in a core's cache.
SCORED = 512
#: Share of the unigram distribution in the model's, so that no unit and no word has probability zero.
FLOOR = 0.05
#: Low bits of a word's hash that tell its ending.
ENDING = 12
END_HASH = 0x5DEECE66D1CE4E00
#: Places that the noise words of a class are drawn from.
SLOTS = 2048
#: Training tokens of a shard in one round.
SHARD_TOKENS = 1_000_000


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow array of words, whose low ENDING bits are a hash of the word's last three bytes."""
    raw = words.cast(pa.binary())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(raw))
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
    tail = np.zeros(len(raw), np.uint64)
    for k in (3, 2, 1):
        at = ends[1:] - k
        tail = (tail << np.uint64(8)) | np.where(at >= ends[:-1], data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint64)
    low = np.uint64((1 << ENDING) - 1)
    return (h & ~low) | (mix64(tail) & low)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the distinct token of each token, the distinct tokens' hashes (the end's comes last), and tokens per text.

    Each text is its words and an end; null is an empty text.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # what a leading or trailing space leaves
        real = code != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        code = code[real]
    h = word_hashes(coded.dictionary)
    return np.insert(code, np.cumsum(counts), len(h)), np.append(h, np.uint64(END_HASH)), counts + 1


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col(text).cast("string").alias("text"))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): how often each token occurs in the documents that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def emit() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([h for h, _ in waiting]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c for _, c in waiting])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in byte_slices(batches, "text"):
            code, h, _ = tokens(b.column("text"))
            c = np.bincount(code, minlength=len(h))
            waiting.append((h[c > 0], c[c > 0]))
            size += len(h)
            if size > 1_000_000:
                yield emit()
                waiting, size = [], 0
        if waiting:
            yield emit()

    counted = _texts(docs, text).where(~F.col("held_out")).select("text").mapInArrow(count, "h long, c long")
    return counted.groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent tokens with their counts, units and places among the learned words, and the mass of every unit; all of bounded size."""

    def __init__(self, h: np.ndarray, c: np.ndarray, class_mass: np.ndarray, class_types: np.ndarray, total: int, types: int) -> None:
        order = np.argsort(h)
        self.h, self.c, self.total, self.types = h[order], c[order], total, types
        unit = self.rare_unit(self.h)
        end = self.h == np.uint64(END_HASH)
        rank = np.lexsort((self.h, -self.c))
        rank = rank[~end[rank]]
        own, learned = rank[:WORDS], rank[WORDS : WORDS + VOCABULARY]
        # words of one class have like endings: in the order of ending, then hash, cut into blocks of equal size
        learned = learned[np.lexsort((self.h[learned], self.h[learned] & np.uint64((1 << ENDING) - 1)))]
        self.place = np.full(len(self.h), -1, np.int32)
        self.place[learned] = np.arange(len(learned))
        unit[own], unit[learned], unit[end] = 1 + np.arange(len(own)), 1 + WORDS + np.arange(len(learned)) // BLOCK, 0
        self.unit = unit.astype(np.int16)
        self.n_words = len(learned)
        mass = np.bincount(unit, self.c + 0.5, UNITS)
        # a rare class holds all words of its endings but the own and learned ones, and one place for unknown words
        out = np.concatenate([own, learned])
        moved = np.bincount(self.rare_unit(self.h[out]) - (UNITS - RARE), self.c[out] + 0.5, RARE)
        mass[UNITS - RARE :] = np.maximum(class_mass + 0.5 * class_types - moved, 0) + 0.5
        self.mass = np.maximum(mass, 0.5)
        self.share = self.mass / self.mass.sum()
        weight = np.ones(VOCABULARY)
        weight[: len(learned)] = self.c[learned] + 0.5
        weight[len(learned) :] = 1e-9
        inside = np.repeat(np.add.reduceat(weight, np.arange(0, VOCABULARY, BLOCK)), BLOCK)
        self.inside = (weight / inside).astype(np.float32)
        # noise words of a class come from SLOTS places, at least one per word and the others by share
        share = self.inside.reshape(CLASSES, BLOCK)
        slots = 1 + np.floor(share * (SLOTS - BLOCK)).astype(np.int64)
        slots[np.arange(CLASSES), share.argmax(1)] += SLOTS - slots.sum(1)
        self.slots = np.repeat(np.arange(VOCABULARY), slots.ravel()).reshape(CLASSES, SLOTS)
        self.noise = (slots.ravel() / SLOTS).astype(np.float32)

    @staticmethod
    def rare_unit(h: np.ndarray) -> np.ndarray:
        return (UNITS - RARE) + (h & np.uint64(RARE - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each hash among the frequent tokens (-1: not there), its unit, and its place among the learned words (-1: none)."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        unit = np.where(known, self.unit[at] if len(self.h) else 0, self.rare_unit(h)).astype(np.int64)
        unit[h == np.uint64(END_HASH)] = 0
        return np.where(known, at, -1), unit, np.where(known, self.place[at] if len(self.h) else -1, -1)


def contexts(unit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token, START where the text begins."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(unit)) - first
    out = np.full((len(unit), CONTEXT), START, np.int64)
    for j in range(1, CONTEXT + 1):
        out[j:, j - 1] = np.where(place[j:] >= j, unit[:-j], START)
    return out


class LogBilinear:
    """Prediction of the next token: context vectors, one matrix per context position, output vectors and biases of units, and
    output vectors and biases of the learned words, each against the words of its class.

    The parameters of the units are one flat array and those of the words another, so models trained apart can be averaged.
    """

    SHAPES = (("r", (UNITS + 1, DIM)), ("m", (CONTEXT, DIM, DIM)), ("q", (UNITS, DIM)), ("b", (UNITS,)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray, words: np.ndarray) -> None:
        self.flat, self.words, at = flat, words, 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 4) -> LogBilinear:
        r = np.random.default_rng(seed)
        model = cls(np.zeros(cls.SIZE, np.float32), np.zeros((VOCABULARY, DIM + 1), np.float32))
        model.r[:], model.q[:] = r.normal(0, 0.1, model.r.shape), r.normal(0, 0.1, model.q.shape)
        model.m[:] = np.eye(DIM) / CONTEXT + r.normal(0, 0.02, model.m.shape)
        model.b[:] = np.log(vocabulary.share)
        model.words[:, :DIM] = r.normal(0, 0.02, (VOCABULARY, DIM))
        model.words[:, DIM] = np.log(vocabulary.inside)
        return model

    @classmethod
    def unpacked(cls, raw: bytes) -> LogBilinear:
        flat = np.frombuffer(raw, np.float32).copy()
        return cls(flat[: cls.SIZE], flat[cls.SIZE :].reshape(VOCABULARY, DIM + 1))

    def packed(self) -> bytes:
        return self.flat.astype("<f4").tobytes() + self.words.astype("<f4").tobytes()

    def predict(self, context: np.ndarray) -> np.ndarray:
        out = np.zeros((len(context), DIM), np.float32)
        for j in range(CONTEXT):
            out += (self.r @ self.m[j])[context[:, j]]
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray, place: np.ndarray, noise: np.ndarray, inner: np.ndarray, v: Vocabulary) -> tuple:
        """Of the noise-contrastive loss: for units with the same noise units for all tokens of the batch, for learned words with
        ``inner`` (one row per learned word) noise words of the same class. Returns the gradient of the units, and rows and gradients of the words."""
        grad = LogBilinear(np.zeros(self.SIZE, np.float32), self.words)
        p = self.predict(context)
        log_noise = np.log(len(noise) * v.share).astype(np.float32)
        up = _sigmoid((p * self.q[target]).sum(1) + self.b[target] - log_noise[target]) - 1
        down = _sigmoid(p @ self.q[noise].T + self.b[noise] - log_noise[noise])
        up, down = (up / len(target)).astype(np.float32), (down / len(target)).astype(np.float32)
        dp = up[:, None] * self.q[target] + down @ self.q[noise]
        _scatter(grad.q, target, up[:, None] * p)
        np.add.at(grad.q, noise, down.T @ p)
        grad.b += np.bincount(target, up, UNITS).astype(np.float32) + np.bincount(noise, down.sum(0), UNITS).astype(np.float32)
        word = np.flatnonzero(place >= 0)
        rows, steps = np.zeros(0, np.int64), np.zeros((0, DIM + 1), np.float32)
        if len(word):
            both = np.concatenate([place[word][:, None], inner], 1)
            x = np.concatenate([p[word], np.ones((len(word), 1), np.float32)], 1)
            own = self.words[both]
            z = np.einsum("nd,nkd->nk", x, own) - np.log(INNER * v.noise[both])
            err = (_sigmoid(z) / len(target)).astype(np.float32)
            err[:, 0] -= np.float32(1 / len(target))
            dp[word] += np.einsum("nk,nkd->nd", err, own[:, :, :DIM])
            rows, at = np.unique(both.ravel(), return_inverse=True)
            steps = np.zeros((len(rows), DIM + 1), np.float32)
            _scatter(steps, at, (err[:, :, None] * x[:, None, :]).reshape(-1, DIM + 1))
        for j in range(CONTEXT):
            part = np.zeros_like(self.r)
            _scatter(part, context[:, j], dp)
            grad.r += part @ self.m[j].T
            grad.m[j] += self.r.T @ part
        return grad.flat, rows, steps

    def log10(self, context: np.ndarray, target: np.ndarray, place: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Normalised log10 probability of each target unit, by batched matrix products over all units, and of each learned
        word among the words of its class (0 for other tokens), by one product per class.

        Biases and a bound of each row's largest logit enter as two more dimensions, so the product gives shifted logits
        at once; rows that the bound leaves too small are done again with their own largest logit.
        """
        out, inner = np.zeros(len(target)), np.zeros(len(target))
        tables = [self.r @ self.m[j] for j in range(CONTEXT)]
        p_all = np.take(tables[0], context[:, 0], axis=0)
        for j in range(1, CONTEXT):
            p_all += tables[j][context[:, j]]
        long, top = float(np.sqrt((self.q * self.q).sum(1).max())), float(self.b.max())
        units = np.concatenate([self.q, self.b[:, None], np.ones((UNITS, 1), np.float32)], 1).T.astype(np.float32)
        ones, wide = np.ones(UNITS, np.float32), np.ones((SCORED, DIM + 2), np.float32)
        for at in range(0, len(target), SCORED):
            t, p = target[at : at + SCORED], p_all[at : at + SCORED]
            x = wide[: len(t)]
            x[:, :DIM] = p
            x[:, DIM + 1] = -(np.sqrt(np.einsum("nd,nd->n", p, p)) * long + top)
            z = x @ units
            np.exp(z, out=z)
            total, own = z @ ones, z[np.arange(len(t)), t]
            low = np.flatnonzero(total < 1e-25)
            if len(low):
                again = x[low, : DIM + 1] @ units[: DIM + 1]
                again = np.exp(again - again.max(1, keepdims=True))
                total[low], own[low] = again.sum(1), again[np.arange(len(low)), t[low]]
            out[at : at + SCORED] = (1 - FLOOR) * (own.astype(np.float64) / total) + FLOOR * v.share[t]
        word = np.flatnonzero(place >= 0)
        word = word[np.argsort(place[word], kind="stable")]
        edges = np.searchsorted(place[word], np.arange(0, VOCABULARY + 1, BLOCK))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            mine = self.words[k * BLOCK : (k + 1) * BLOCK]
            for at in range(edges[k], edges[k + 1], SCORED * 4):
                i = word[at : min(at + SCORED * 4, edges[k + 1])]
                z = p_all[i] @ mine[:, :DIM].T + mine[:, DIM]
                z -= z.max(1, keepdims=True)
                np.exp(z, out=z)
                w = place[i]
                share = z[np.arange(len(i)), w - k * BLOCK].astype(np.float64) / z.sum(1)
                inner[i] = np.log10((1 - FLOOR) * share + FLOOR * v.inside[w])
        return np.log10(out), inner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scatter(into: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(place.astype(np.int16), kind="stable")
    there = place[order]
    first = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    into[there[first]] += np.add.reduceat(rows[order], first)


class Learner:
    """A model on its way: Adam for the units, adaptive steps for the rows of words that a batch touches."""

    def __init__(self, start: LogBilinear, v: Vocabulary, seed: int) -> None:
        self.model, self.v, self.r = LogBilinear(start.flat.copy(), start.words.copy()), v, np.random.default_rng(seed)
        self.m, self.s, self.step = np.zeros_like(start.flat), np.zeros_like(start.flat), 0
        self.squares = np.full(VOCABULARY, 1e-8, np.float32)

    def learn(self, context: np.ndarray, target: np.ndarray, place: np.ndarray) -> None:
        order = self.r.permutation(len(target))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step += 1
            own = place[pick]
            own = own[own >= 0] // BLOCK
            inner = self.v.slots[own[:, None], self.r.integers(0, SLOTS, (len(own), INNER))]
            noise = self.r.choice(UNITS, NOISE, p=self.v.share)
            g, rows, steps = self.model.gradient(context[pick], target[pick], place[pick], noise, inner, self.v)
            self.m = 0.9 * self.m + 0.1 * g
            self.s = 0.99 * self.s + 0.01 * g * g
            rate = 0.008 / np.sqrt(1 + self.step / 200)
            self.model.flat -= (rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.s / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)
            if len(rows):
                self.squares[rows] += (steps * steps).mean(1)
                self.model.words[rows] -= 0.05 * steps / np.sqrt(self.squares[rows])[:, None]


def train_round(docs: DataFrame, vocabulary, start: bytes, seed: int, shards: int, text: str) -> DataFrame:
    """(id, w, v): tokens seen and packed model of every shard, fit to its texts from ``start``.

    Documents are dealt to ``shards`` by a hash of the id and read in hashed order, so a model depends on its documents
    and not on how the input was split. Every token is gone over once in a round, whatever the size of the corpus.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = docs.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), F.col(text).cast("string").alias("text"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = vocabulary.value, LogBilinear.unpacked(start)
        shard, learner, seen = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(seen)]), pa.array([learner.model.packed()], pa.binary())], ["id", "w", "v"])

        for b in byte_slices(batches, "text"):
            own = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for i, j in zip(edges, edges[1:], strict=False):
                if own[i] != shard:
                    if learner is not None:
                        yield done()
                    shard, learner, seen = int(own[i]), Learner(model, v, int(own[i])), 0
                code, h, sizes = tokens(b.column("text").slice(i, j - i))
                _, unit, place = v.find(h)
                learner.learn(contexts(unit[code], sizes), unit[code], place[code])
                seen += len(code)
        if learner is not None:
            yield done()

    return rows.mapInArrow(fit, "id int, w double, v binary")


def averaged(models: DataFrame, n: int, fan: int = 16) -> bytes | None:
    """The mean of the packed models, weighted by tokens, over a tree in which no task holds more than ``fan`` of them."""

    def mean(t: pa.Table) -> pa.Table:
        total, w = 0.0, 0.0
        for weight, raw in sorted(zip(t.column("w").to_pylist(), t.column("v").to_pylist(), strict=True)):
            total, w = total + weight * np.frombuffer(raw, np.float32).astype(np.float64), w + weight
        return pa.table({"id": pa.array([t.column("id")[0].as_py() // fan], pa.int32()), "w": [w], "v": pa.array([(total / max(w, 1e-9)).astype(np.float32).tobytes()], pa.binary())})

    models = stored(models, "lm-models")
    while n > 1:
        n = -(-n // fan)
        models = stored(models.groupBy(F.floor(F.col("id") / fan).alias("g")).applyInArrow(mean, "id int, w double, v binary"), "lm-models")
    rows = models.collect()  # one model
    return bytes(rows[0]["v"]) if rows else None


def score_texts(docs: DataFrame, text: str = "text", frequent: int = 1 << 19, rounds: int = 2) -> DataFrame:
    """Return doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Counts come from all training documents. At most ``frequent`` tokens, those above a count threshold, are
    broadcast with their counts; the others are looked up by an equi-join on their hash. The model predicts a unit (the end,
    a very frequent word, a class of learned words, or a class of endings of all other words) from the units before it;
    a learned word (the next VOCABULARY by count) is predicted within its class from the same context, any other by its smoothed
    count. That is a distribution over the known words and, per class of endings, one place for unknown ones. It is
    trained on all training documents in ``rounds`` parts: every shard of about SHARD_TOKENS tokens is fit from the
    common start, and the shards' models are averaged in Spark.

    Null texts are empty (one token, the end), long ones are read whole. Repeated rows each get a row; with a null id a row
    counts as training data. Tokens are told apart by a 64-bit hash. Extra columns are ignored; no rows give none. Scores
    do not depend on how the input is split into partitions, but for the last digits of sums.
    """
    spark = docs.sparkSession
    counts = stored(token_counts(docs, text), "lm-counts")
    low = F.floor(F.log2("c") * 8).cast("int")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    classes = counts.where(F.col("h") != F.lit(END_HASH)).groupBy(F.col("h").bitwiseAND(RARE - 1).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect()
    class_mass, class_types = np.zeros(RARE), np.zeros(RARE)
    for k, c, n in classes:  # one row per class
        class_mass[k], class_types[k] = c, n
    levels = sorted(counts.groupBy(low.alias("level")).count().collect(), reverse=True)  # one row per level of log2(count)
    bound, room = (levels[0][0] + 1 if levels else 0), frequent
    for level, n in levels:
        if n > room:
            break
        bound, room = level, room - n
    top = counts.where(low >= bound).toArrow()
    h, c = (top.column(k).to_numpy() for k in ("h", "c"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(h.view(np.uint64), c, class_mass, class_types, total, types))

    model = LogBilinear.fresh(vocabulary.value).packed()
    learning = docs.where(~is_held_out(F.col("doc_id")))
    shards = max(1, round(total / rounds / SHARD_TOKENS))
    for r in range(rounds if total else 0):
        part = learning.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        model = averaged(train_round(part, vocabulary, model, r + 1, shards, text), shards) or model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lm = vocabulary.value, LogBilinear.unpacked(model)
        log_count, log_mass = np.log10(v.c + 0.5), np.log10(v.mass)
        for b in byte_slices(batches, "text"):
            code, h, sizes = tokens(b.column("text"))
            at, unit, place = v.find(h)
            counted = np.where(at >= 0, log_count[at] if len(log_count) else 0, 0)
            # a learned word has its probability in the class, any other token its share of the unit's mass
            own = np.where(place >= 0, -counted, -log_mass[unit])
            units, places = unit[code], place[code]
            of_unit, of_word = lm.log10(contexts(units, sizes), units, places, v)
            doc, found = np.repeat(np.arange(len(sizes)), sizes), (at >= 0)[code]
            sums = lambda x, doc=doc, n=len(sizes): pa.array(np.bincount(doc, x, n))
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=len(sizes)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(edges), pa.array(h[code[~found]].view(np.int64)))
            known = pa.array(np.bincount(doc, found, len(sizes)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(sizes), known, sums(counted[code]), sums(of_unit + of_word + own[code]), rare],
                ["doc_id", "held_out", "n_tokens", "known", "counted", "model", "rare"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, counted double, model double, rare array<long>"
    scored = _texts(docs, text).mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("k"))
    seldom = counts.where(low < bound)
    c = F.coalesce("c", F.lit(0))
    looked = rare.join(seldom, "h", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("seldom")
    )
    out = scored.drop("rare").join(looked, "row", "left")
    logs = F.col("counted") + F.coalesce("seldom", F.lit(0.0))
    z = float(np.log10(total + 0.5 * (types + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(z)).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
