"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are laid out in overlapping chunks that cover all of it. Learned filters, eight bytes wide at every
fourth byte, run over each chunk's byte embeddings; each filter is max-pooled within the chunk. Over the chunks their
maximum and mean are combined linearly into one probability. Beside a text's bytes, memory depends on a block of chunks, not on its length.

The fit runs on the driver over a bounded, class-balanced sample of labelled rows; the odds are then corrected to the
labels' true frequencies. The model has a few thousand numbers and is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, filter_texts, labelled_texts, let_go, map_texts, sample_ids

CHUNK, OVERLAP, GROUP, PAD = 512, 64, 4, 256
STEP = CHUNK - OVERLAP
#: Bounds of the fit: rows of each label, characters of a row.
PER_LABEL, MAX_FIT_CHARS = 1200, 20_000


def chunk_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all chunks, one row each, padded; number of chunks of each text). An empty text has one, all padding."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-(len(b) - OVERLAP) // STEP)) for b in raw])
    out = np.full((int(counts.sum()), CHUNK), PAD, dtype=np.int16)
    at = 0
    for b, n in zip(raw, counts):
        line = np.full(STEP * int(n) + OVERLAP, PAD, dtype=np.int16)
        line[:len(b)] = np.frombuffer(b, dtype=np.uint8)
        out[at:at + n] = np.lib.stride_tricks.sliding_window_view(line, CHUNK)[::STEP]
        at += n
    return out, counts


class ByteConvolution:
    """The network's parameters, forward pass and fit."""

    def __init__(self, filters: int = 32, width: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (257, width)).astype(np.float32)
        self.emb[PAD] = 0
        self.w = rng.normal(0, 0.2, (2 * GROUP * width, filters)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        self.v = np.zeros(2 * filters, np.float32)
        self.c = np.zeros(1, np.float32)
        self.shift = 0.0

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(max over positions of each filter, its position, embedded groups) for each chunk."""
        half = len(self.w) // 2
        groups = self.emb[chunks].reshape(len(chunks), CHUNK // GROUP, half)
        both = groups.reshape(-1, half) @ np.concatenate([self.w[:half], self.w[half:]], axis=1)
        both = both.reshape(len(chunks), CHUNK // GROUP, -1)
        n = self.w.shape[1]
        out = both[:, :-1, :n] + both[:, 1:, n:]
        where = out.argmax(axis=1) if self.fitting else None
        return np.maximum(out.max(axis=1) + self.b, 0), where, groups

    fitting = False

    def logits(self, texts: list[str], block: int = 512) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks([len(t) for t in texts], block * STEP):
            if b == a + 1:
                most, mean = self.long_text(texts[a], block)
            else:
                chunks, counts = chunk_rows(texts[a:b])
                top = np.concatenate([self.pooled(chunks[i:i + block])[0] for i in range(0, len(chunks), block)])
                starts = np.concatenate([[0], counts.cumsum()[:-1]])
                most, mean = np.maximum.reduceat(top, starts), np.add.reduceat(top, starts, dtype=np.float64) / counts[:, None]
            out[a:b] = np.concatenate([most, mean], axis=1).astype(np.float64) @ self.v + self.c[0] + self.shift
        return out

    def long_text(self, text: str, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(maximum, mean) over a text's chunks, a block of chunks at a time: beside the text's bytes only a block is held."""
        raw, n = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), self.w.shape[1]
        most, total, count = np.zeros((1, n)), np.zeros((1, n)), max(1, -(-(len(raw) - OVERLAP) // STEP))
        for at in range(0, count, block):
            some = min(block, count - at)
            line = np.full(STEP * some + OVERLAP, PAD, dtype=np.int16)
            part = raw[at * STEP:at * STEP + len(line)]
            line[:len(part)] = part
            top = self.pooled(np.lib.stride_tricks.sliding_window_view(line, CHUNK)[::STEP])[0]
            most, total = np.maximum(most, top.max(0)), total + top.sum(0, dtype=np.float64)
        return most, total / count

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 320, batch: int = 48, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the log loss; gradients flow through the pooled positions only."""
        if not texts:
            return
        rng = np.random.default_rng(seed)
        names = ("emb", "w", "b", "v", "c")
        m1 = {k: np.zeros_like(getattr(self, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in names}
        half, n = len(self.w) // 2, self.w.shape[1]
        self.fitting, order = True, np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(texts))])
            rows, order = order[:batch], order[batch:]
            chunks, counts = chunk_rows([texts[i] for i in rows])
            top, where, groups = self.pooled(chunks)
            starts = np.concatenate([[0], counts.cumsum()[:-1]])
            owner = np.repeat(np.arange(len(rows)), counts)
            most, mean = np.maximum.reduceat(top, starts), np.add.reduceat(top, starts) / counts[:, None]
            h = np.concatenate([most, mean], axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c[0], -30, 30)))
            d = ((p - labels[rows]) / len(rows)).astype(np.float32)
            dh = d[:, None] * self.v[None, :]
            is_most = top == most[owner]
            share = is_most / np.maximum(np.add.reduceat(is_most, starts, dtype=np.float32), 1)[owner]
            dtop = (dh[owner, :n] * share + dh[owner, n:] / counts[owner, None]) * (top > 0)
            row = np.arange(len(chunks))[:, None]
            window = np.concatenate([groups[row, where], groups[row, where + 1]], axis=2)
            grads = {"v": h.T @ d, "c": d.sum(keepdims=True), "b": dtop.sum(0), "w": np.einsum("cf,cfk->kf", dtop, window)}
            spread = (dtop[:, :, None] * self.w.T[None]).reshape(-1, half // GROUP)
            places = (where[:, :, None] * GROUP + np.arange(2 * GROUP)).reshape(len(chunks), -1)
            used = np.take_along_axis(chunks, places, axis=1).ravel().astype(np.int64)
            grads["emb"] = np.stack([np.bincount(used, spread[:, k], 257) for k in range(half // GROUP)], axis=1)
            grads["emb"][PAD] = 0
            speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k in names:
                g = grads[k].astype(np.float32) + 1e-4 * getattr(self, k)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                setattr(self, k, getattr(self, k) - speed * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7))
            self.emb[PAD] = 0
        self.fitting = False


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_FIT_CHARS, steps: int = 320) -> ByteConvolution:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1; at most ``per_label`` rows of each label, no longer than
    ``max_chars``. Without rows of both labels the model stays neutral and predicts by their frequency."""
    usable = labels.where((crc_mod("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    frequency = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    rows = labelled_texts(docs.select("doc_id", "text"), sample_ids(usable, "doc_id", "quality", per_label), max_chars)
    y = np.array([label for _, label in rows], dtype=np.float32)
    model = ByteConvolution()
    if 0 < y.sum() < len(y):
        model.fit([t for t, _ in rows], y, steps)
        model.shift = float(np.log(frequency[1] / frequency[0]) - np.log(y.sum() / (len(y) - y.sum())))
    elif frequency:
        model.shift = float(np.log((frequency.get(1, 0) + 0.5) / (frequency.get(0, 0) + 0.5)))
    return model


def _scorer(docs: DataFrame, model: ByteConvolution):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def start():
        let_go()
        return lambda texts: [1 / (1 + np.exp(-np.clip(shared.value.logits([t or "" for t in texts]), -500, 500)))]

    return start


def score_quality(docs: DataFrame, model: ByteConvolution, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; only the text is an input of the score.

    Null and empty texts are scored as one chunk of padding. Repeated rows and null ids are kept (a null id hashes as the empty
    text), other columns are not carried, an empty table gives no rows. Rows are scored where they stand, without a shuffle.
    """
    scored = map_texts(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), ["doc_id", "held_out"],
                       _scorer(docs, model), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: ByteConvolution, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is at least ``threshold``."""
    scorer = _scorer(docs, model)

    def start():
        work = scorer()
        return lambda texts: work(texts)[0] >= threshold

    return filter_texts(docs, start)
