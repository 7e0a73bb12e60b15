"""Secret scan: exact patterns plus a character convolutional network over every candidate token."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import byte_slices, stored, table

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate for the network: a whole run of at least 6 token characters that is long (16), holds a digit, mixes cases or
#: assigns (=), or that starts at most BEFORE characters after a cue.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")
#: Where a run may start: the search for it looks no further than a cue reaches.
LEAST = 6
START = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6}")
MIXED = re.compile(
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{16}|[A-Za-z+/_=-]*+[0-9]|[A-Za-z0-9+/_-]++=[A-Za-z0-9+/_-]"
    r"|[A-Za-z0-9+/_=-]*?(?:[a-z][A-Z]|[A-Z]{2}[a-z]))[A-Za-z0-9+/_=-]{6,}"
)
CUE = re.compile(r"passw|pwd|secret|token|api|key|auth|cred", re.ASCII | re.IGNORECASE)
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ALNUM = re.compile(r"[A-Za-z0-9]")
CUES = ("passw", "secret", "token", "api")

BEFORE, INSIDE, AFTER = 24, 40, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Characters from one region of a long candidate to the next; the last one ends with the candidate.
STEP = 4
#: Windows of the corpus in one shard of the training, about; every window is in one.
SHARD = 8192
#: Logits are multiples of 1 / GRAIN up to MOST_LOGIT, so that counts of all of them are a table of bounded size.
GRAIN, MOST_LOGIT = 256, 40


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern findings in code points, by start, then kind."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, bool, int, str]]:
    """(start, end, whether a pattern found it too, where its training region starts, text with its surroundings) of every candidate.

    The training region is the one at the pattern's start, or one that a checksum picks.
    """
    runs = {m.span() for m in MIXED.finditer(text)}
    done = 0
    for cue in CUE.finditer(text):
        # starts up to this cue's reach; those that an earlier cue reached are known, and a run of this place ends a reach late
        reach, at = cue.end() + BEFORE, max(cue.end(), done)
        while at <= reach and (start := START.search(text, at, reach + LEAST)):
            run = RUN.match(text, start.start())
            if run:
                runs.add(run.span())
            at = done = run.end() if run else start.start() + 1
    out = []
    for a, b in sorted(runs):
        own = text[a:b]
        if ALNUM.search(own):
            first = None if KEYWORD.fullmatch(own) else next((s for _, s, e in base if s < b and a < e), None)
            last = max(0, b - a - INSIDE)
            at = zlib.crc32(own.encode()) % (last + 1) if first is None else min(max(0, first - a), last)
            left, right = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0"), text[b : b + AFTER].ljust(AFTER, "\0")
            out.append((a, b, first is not None, at, left + own + right))
    return out


def region(whole: str, at: int) -> str:
    """The window of WIDTH characters of a candidate with its surroundings that sees INSIDE characters from ``at`` on."""
    left, own, right = whole[:BEFORE], whole[BEFORE:-AFTER], whole[-AFTER:]
    return left + own[at : at + INSIDE].ljust(INSIDE, "\0") + right


def regions(whole: str) -> Iterator[str]:
    """Windows over the whole candidate."""
    last = max(0, len(whole) - WIDTH)
    for at in range(0, last, STEP):
        yield region(whole, at)
    yield region(whole, last)


def best_probabilities(net: CharCNN, wholes: list[str], block: int = 8192) -> np.ndarray:
    """The highest probability among the regions of each candidate; at most ``block`` windows are held at a time."""
    best = np.zeros(len(wholes))
    every = ((i, w) for i, whole in enumerate(wholes) for w in regions(whole))
    while part := list(islice(every, block)):
        np.maximum.at(best, [i for i, _ in part], net.probability(encode_windows([w for _, w in part])))
    return best


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def encode_windows(windows: list[str]) -> np.ndarray:
    """One code per character: printable ASCII as it is, 1 for other characters, 0 for none."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(-1, WIDTH)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 30, 1)).astype(np.int64)


@dataclass
class CharCNN:
    """Embedding, one convolution of width 5, max pooling per region (before, inside, after), one logistic unit."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    CODES, DIM, FILTERS, REACH = 97, 12, 24, 5

    @classmethod
    def fresh(cls, seed: int = 10) -> CharCNN:
        r = np.random.default_rng(seed)
        return cls({
            "e": r.normal(0, 0.3, (cls.CODES, cls.DIM)), "k": r.normal(0, 0.15, (cls.REACH * cls.DIM, cls.FILTERS)),
            "b": np.zeros(cls.FILTERS), "v": r.normal(0, 0.1, 3 * cls.FILTERS), "c": np.zeros(1),
        })

    def forward(self, x: np.ndarray):
        w = self.weights
        emb = np.pad(w["e"][x], ((0, 0), (2, 2), (0, 0)))
        cols = np.concatenate([emb[:, i : i + WIDTH] for i in range(self.REACH)], axis=2)
        act = cols @ w["k"] + w["b"]
        parts = [(0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH)]
        best = [a + act[:, a:b].argmax(1) for a, b in parts]
        pooled = np.concatenate([np.maximum(np.take_along_axis(act, i[:, None], 1)[:, 0], 0) for i in best], axis=1)
        return cols, best, pooled, pooled @ w["v"] + w["c"][0]

    def logits(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + block])[3] for i in range(0, len(x), block)] or [np.zeros(0)])
        return np.rint(np.clip(z, -MOST_LOGIT, MOST_LOGIT) * GRAIN) / GRAIN

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        cols, best, pooled, z = self.forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        dp = dz[:, None] * w["v"] * (pooled > 0)
        out = {"v": pooled.T @ dz, "c": np.array([dz.sum()]), "k": np.zeros_like(w["k"]), "b": dp.reshape(len(x), 3, -1).sum((0, 1)), "e": np.zeros_like(w["e"])}
        rows = np.arange(len(x))[:, None]
        padded = np.pad(x, ((0, 0), (2, 2)))
        for r, at in enumerate(best):
            d = dp[:, r * self.FILTERS : (r + 1) * self.FILTERS]
            seen = cols[rows, at]
            out["k"] += np.einsum("nfc,nf->cf", seen, d)
            back = d[:, :, None] * w["k"].T[None]
            for i in range(self.REACH):
                np.add.at(out["e"], padded[rows, at + i], back[:, :, i * self.DIM : (i + 1) * self.DIM])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 256, rate: float = 0.01, seed: int = 1) -> None:
        """Adam on the logistic loss, both classes weighing the same; an epoch goes over every window, a rare class several times."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, classes, steps = 0, [np.flatnonzero(y == 1), np.flatnonzero(y == 0)], -(-len(y) // batch)
        for _ in range(epochs):
            orders = [np.array_split(np.resize(r.permutation(c), max(len(c), steps * batch // 4)), steps) for c in classes]
            for parts in zip(*orders, strict=True):
                pick = np.concatenate(parts)
                step += 1
                for k, g in self.gradients(x[pick], y[pick], np.concatenate([np.full(len(i), 0.5 / len(i)) for i in parts])).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = 0.98) -> None:
        self.calibrate_counts(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = 0.98) -> None:
        """Platt scaling on held-out logits, each seen ``n`` times, then the highest threshold that keeps ``recall`` of the positives."""
        a, b, total = 1.0, 0.0, float(n.sum())
        mean = lambda v: float((n * v).sum() / total)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a, b = a - 0.1 * mean((p - y) * z) / (1 + mean(z * z)), b - 0.1 * mean(p - y)
        self.scale, self.shift = max(a, 1e-3), b
        own = y == 1
        p = 1 / (1 + np.exp(-np.clip(self.scale * z[own] + self.shift, -40, 40)))
        order = np.argsort(p, kind="stable")
        below = np.cumsum(n[own][order])
        self.threshold = float(p[order][np.searchsorted(below, int((1 - recall) * below[-1]), "right")]) if len(below) else 1.0

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def replaced(self, flat: np.ndarray) -> CharCNN:
        """A net of the same shape with the weights of ``flat``."""
        parts = np.split(flat, np.cumsum([v.size for v in self.weights.values()])[:-1])
        return CharCNN({k: p.reshape(v.shape).copy() for (k, v), p in zip(self.weights.items(), parts, strict=True)})


def made_up_findings(n: int = 600, seed: int = 5) -> tuple[list[str], list[int]]:
    """Labelled windows by rule: random keys, tokens, passwords and digests against identifiers, numbers, dates, paths and long words."""
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    pick = lambda chars, size: "".join(r.choice(chars, size))
    word = lambda: pick(letters[:26], int(r.integers(2, 9)))
    windows, labels = [], []
    for i in range(n):
        size, kind = int(r.integers(24, 48)), i % 9
        value = [pick(letters[:62], size), pick(letters, size) + "=", pick(letters[52:62], 3) + pick(letters[:62], size), "AKIA" + pick(letters[26:52], 8) + pick(letters[52:62], 8), pick(np.array(list("0123456789abcdef")), 40), "sk_live_" + pick(letters[:62], 24), pick(letters[:52], size), pick(letters[:62], size // 3), "/".join(word() for _ in range(3)) + "/" + pick(letters, 40)][kind]
        plain = ["_".join(word() for _ in range(4)) + "_2", pick(letters[52:62], 16), f"20{pick(letters[52:62], 2)}-0{pick(letters[53:61], 1)}-1{pick(letters[52:62], 1)}-{word()}-{word()}", "/".join(word() for _ in range(5)) + "/v2", word() + "-" + word() + "-" + word() + "-" + pick(letters[52:62], 4), word().upper() * 3 + "1" + word(), word() + word() + word() + word(), word() + word().title() + word().title(), pick(letters[52:62], 3) + "-" + pick(letters[52:62], 4)][kind]
        for text, label in ((value, 1), (plain, 0)):
            lead = " ".join(word() for _ in range(6))[-BEFORE:]
            if label and (i % 2 or kind == 7):
                lead = (lead + " " + ["key: ", "token=", "auth ", "secret ", "password is "][i % 5])[-BEFORE:]
            tail = " " + " ".join(word() for _ in range(4))
            text = text[-INSIDE:] if kind == 8 else text
            windows.append(lead.rjust(BEFORE, "\0") + text[:INSIDE].ljust(INSIDE, "\0") + tail[:AFTER].ljust(AFTER, "\0"))
            labels.append(label)
    return windows, labels


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document doc_id, base (array of kind, start, end) and candidates (start, end, labelled, at, whole); no other text leaves the task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        tokens = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("labelled", pa.bool_()), ("at", pa.int32()), ("whole", pa.string())]))
        for b in byte_slices(batches, "text"):
            base, more = [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t or "")
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                more.append([dict(zip(("start", "end", "labelled", "at", "whole"), c, strict=True)) for c in candidates(t or "", found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, spans), pa.array(more, tokens)], ["doc_id", "base", "candidates"])

    schema = (
        "doc_id long, base array<struct<kind:string,start:int,end:int>>, "
        "candidates array<struct<start:int,end:int,labelled:boolean,at:int,whole:string>>"
    )
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(scan, schema)


def training_windows(found: DataFrame) -> DataFrame:
    """(window, labelled, h) of every candidate: its training window, whether a pattern found it too, and the hash that deals it."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    own, size = F.col("whole"), F.col("end") - F.col("start")
    inside = F.substring(own, F.col("at") + BEFORE + 1, F.least(size - F.col("at"), F.lit(INSIDE)))
    window = F.concat(F.substring(own, 1, BEFORE), F.rpad(inside, INSIDE, "\0"), F.substring(own, size + BEFORE + 1, F.lit(AFTER)))
    return each.select(window.alias("window"), "labelled", F.xxhash64("doc_id", "start", window).alias("h"))


def train_round(windows: DataFrame, net: CharCNN, seed: int, shards: int) -> CharCNN:
    """The mean of the nets that every shard fits from ``net`` to its windows and the made-up ones.

    Windows are dealt by their hash and read in its order, and weights are summed as whole numbers, so the mean depends
    neither on partitions nor on the order of the sums.
    """
    made, labels = made_up_findings()
    learning = np.arange(len(labels)) % 8 < 6
    rows = windows.select(F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), "h", "window", "labelled")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "window", "labelled")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra, known = encode_windows(made)[learning], np.array(labels, float)[learning]

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts)
            x = np.concatenate([extra, encode_windows(own.column("window").to_pylist())])
            y = np.concatenate([known, own.column("labelled").to_numpy().astype(float)])
            mine = net.replaced(net.packed())
            mine.fit(x, y, seed=seed)
            return pa.RecordBatch.from_arrays([pa.array([np.rint(mine.packed() * 2.0**32).astype(np.int64)], pa.list_(pa.int64()))], ["weights"])

        shard, parts = None, []
        for b in batches:
            own = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if parts and own[i] != shard:
                    yield done(parts)
                    parts = []
                shard = own[i]
                parts.append(b.slice(i, j - i))
        if parts:
            yield done(parts)

    fitted = stored(rows.mapInArrow(fit, "weights array<long>"), "secret-nets")
    sums = fitted.select(F.posexplode("weights")).groupBy("pos").agg(F.sum("col").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = sorted(sums.collect())  # one row per weight
    return net.replaced(np.array([r["total"] / r["n"] for r in rows]) / 2.0**32)


def count_logits(windows: DataFrame, net: CharCNN) -> list[tuple[float, float, int]]:
    """(logit, label, how many windows have both), a table bounded by the grain of the logits."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = net.logits(encode_windows(b.column("window").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(z), b.column("labelled")], ["z", "labelled"])

    scored = windows.select("window", "labelled").mapInArrow(score, "z double, labelled boolean")
    return [(r["z"], float(r["labelled"]), r["count"]) for r in scored.groupBy("z", "labelled").count().collect()]


def fit_network(found: DataFrame, rounds: int = 2, shard: int = SHARD) -> CharCNN:
    """Train on every candidate of the corpus, labelled by whether the patterns found it too, and on the made-up windows.

    A quarter, by hash, is held out for the calibration and the threshold, which come from all of it. Each round fits
    a net to every shard of about ``shard`` windows from a common start, each over all its windows, and takes their mean.
    """
    windows = stored(training_windows(found), "secret-windows")
    held = F.pmod("h", F.lit(8)) >= 6
    learning, net = windows.where(~held), CharCNN.fresh()
    n, (made, labels) = learning.count(), made_up_findings()
    made, labels = encode_windows(made), np.array(labels, float)
    kept_out = np.arange(len(labels)) % 8 >= 6
    for r in range(rounds):
        if n:
            net = train_round(learning, net, r + 1, max(1, round(n / shard)))
        else:
            net.fit(made[~kept_out], labels[~kept_out], seed=r + 1)
    seen = count_logits(windows.where(held), net) + [(z, y, 1) for z, y in zip(net.logits(made[kept_out]), labels[kept_out], strict=True)]
    z, y, times = map(np.array, zip(*sorted(seen), strict=True))
    net.calibrate_counts(z, y, times.astype(float))
    return net


def _in_order(spans: list[dict]) -> list[dict]:
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def mask_secrets(docs: DataFrame, net: CharCNN, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that the patterns or the network find replaced by ``mark``; null texts stay null."""
    names = docs.columns

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, text):
            texts = b.column(text).to_pylist()
            spans, open_ = [], []
            for i, t in enumerate(texts):
                base = base_spans(t or "")
                spans.append([(s, e) for _, s, e in base])
                open_ += [(i, s, e, w) for s, e, _, _, w in candidates(t or "", base)]
            if open_:
                p = best_probabilities(net, [w for *_, w in open_])
                for (i, s, e, _), v in zip(open_, p, strict=True):
                    if v >= net.threshold:
                        spans[i].append((s, e))
            new = pa.array([mask(t, x, mark) if x else t for t, x in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else b.column(c) for c in names], names)

    return docs.mapInArrow(cover, docs.schema)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Return doc_id and spans: array of (kind, start, end) in code points, by start, then kind as in KINDS.

    Pattern findings always stay. The network is trained here on every candidate, those that the patterns found and
    those that they did not, and adds, as kind ``learned``, every candidate of the whole text, also those that overlap a pattern finding, one of whose regions reaches the threshold
    with its calibrated probability. Null texts have no spans, long ones are scanned whole, repeated rows each get their own,
    extra columns are ignored, and an empty table gives none.
    """
    found = stored(find_base(docs, text), "secret-candidates")
    net = fit_network(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            base, more = b.column("base").to_pylist(), b.column("candidates").to_pylist()
            open_ = [(i, c) for i, cs in enumerate(more) for c in cs or ()]
            for (i, c), v in zip(open_, best_probabilities(net, [c["whole"] for _, c in open_]), strict=True):
                if v >= net.threshold:
                    base[i].append({"kind": "learned", "start": c["start"], "end": c["end"]})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(_in_order, base)), spans)], ["doc_id", "spans"])

    return found.mapInArrow(score, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def span_text(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    count = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    digest = F.sha2(span_text(base).cast("binary"), 256)
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), digest.alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        count("learned"),
    )


def mask(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every covered stretch replaced by ``mark``; overlapping spans are one stretch."""
    out, at, end = [], 0, 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[at:a] if a >= at else "", mark]
            at = b
        end = max(end, b)
        at = max(at, end)
    return "".join(out) + text[at:]
