"""Language identification: averaged hashed subword embeddings with a linear softmax.

A lower-cased text's byte n-grams (2 to 4) are hashed into buckets; the buckets' embeddings are averaged over the whole text
and a linear softmax gives each language's probability. Both layers are learned by stochastic gradient descent in numpy. A held-back part
of the fit's sample sets the temperature of the softmax and the score below which a prediction is marked as rejected.

As the second layer is linear, the product of both layers is one row of logits for each bucket, which is what is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_texts, let_go, map_texts, sample_ids

BUCKETS, GRAMS = 1 << 15, (2, 3, 4)
#: Bounds of the fit: rows of each language, characters of a row.
PER_LANG, MAX_FIT_CHARS = 400, 20_000
UNDETERMINED = "und"


def gram_buckets(raw: bytes) -> list[np.ndarray]:
    """For each n-gram size the bucket of every position of ``raw``."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    h, out = b.copy(), []
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1:]
        if n in GRAMS:
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


class SubwordSoftmax:
    """Languages in order, logits of each bucket (temperature applied), and the rejection score."""

    def __init__(self, langs: list[str], dim: int = 16, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (dim, max(1, len(langs)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(langs)), np.float32)
        self.temperature, self.reject_below = 1.0, 0.0

    @staticmethod
    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = gram_buckets(text.lower().encode("utf-8", "surrogatepass"))
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ids, n = np.unique(ids, return_counts=True)
        return ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)

    def fit(self, texts: list[str], labels: list[str], epochs: int = 6, batch: int = 16, rate: float = 1.0, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        known = {lang: i for i, lang in enumerate(self.langs)}
        y = np.array([known[lang] for lang in labels])
        feats = [self.features(t) for t in texts]
        shuffled = rng.permutation(len(texts))
        held, used = shuffled[:len(texts) // 5], shuffled[len(texts) // 5:]
        epochs = max(epochs, -(-600 // max(1, len(used) // batch)))
        total, done = epochs * -(-len(used) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(used)
            for i in range(0, len(order), batch):
                rows = order[i:i + batch]
                ids = np.concatenate([feats[r][0] for r in rows])
                weight = np.concatenate([feats[r][1] for r in rows])
                owner = np.repeat(np.arange(len(rows)), [len(feats[r][0]) for r in rows])
                h = np.zeros((len(rows), self.emb.shape[1]), np.float32)
                np.add.at(h, owner, self.emb[ids] * weight[:, None])
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                speed = rate * (1 - done / total)
                dh = p @ self.out.T
                self.out -= speed * h.T @ p
                self.bias -= speed * p.sum(0)
                np.add.at(self.emb, ids, -speed * 20 * dh[owner] * weight[:, None])
                done += 1
        self._calibrate([feats[i] for i in held], y[held])

    def _calibrate(self, feats: list, y: np.ndarray) -> None:
        if not len(y):
            return
        z = np.stack([(self.emb[i] * w[:, None]).sum(0) for i, w in feats]) @ self.out + self.bias

        def probabilities(t: float) -> np.ndarray:
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            return p / p.sum(1, keepdims=True)

        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-9).mean())
        p = probabilities(self.temperature)
        top, right = p.max(1), p.argmax(1) == y
        self.reject_below = next((float(c) for c in np.unique(np.concatenate([[0.0], top])) if right[top >= c].mean() >= 0.99), float(top.max()))

    def finish(self) -> "SubwordSoftmax":
        """Fold both layers into one table of logits, and drop them."""
        self.table = ((self.emb @ self.out + self.bias) / self.temperature).astype(np.float32)
        self.prior = (self.bias / self.temperature).astype(np.float32)
        del self.emb, self.out
        return self

    def predict(self, text: str | None, block: int = 1 << 20) -> tuple[str, float]:
        if not isinstance(text, str) or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.langs)), 0
        raw, overlap = text.lower().encode("utf-8", "surrogatepass"), max(GRAMS) - 1
        for i, grams in ((i, gram_buckets(raw[i:i + block + overlap])) for i in range(0, len(raw), block)):
            last = i + block >= len(raw)
            for ids in grams:
                ids = ids if last else ids[:block]
                total += self.table[ids].sum(0, dtype=np.float64)
                n += len(ids)
        z = total / n if n else self.prior.astype(np.float64)
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_FIT_CHARS) -> SubwordSoftmax:
    """Learn from text and non-null lang of rows whose crc32(doc_id) mod 5 is not 0: at most ``per_lang`` rows of a language."""
    usable = docs.select("doc_id", "text", "lang").where((crc_mod("doc_id", 5) != 0) & F.col("text").isNotNull())
    rows = labelled_texts(usable, sample_ids(usable, "doc_id", "lang", per_lang), max_chars)
    model = SubwordSoftmax(sorted({lang for _, lang in rows}))
    if rows:
        model.fit([t for t, _ in rows], [lang for _, lang in rows])
    return model.finish()


def identify(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text.

    A null text, one without a letter, and any text where no language could be learned are ``und`` with score 0 and are
    rejected. Ties go to the language that sorts first. Repeated rows and null ids are kept, other columns are not carried,
    an empty table gives no rows. Rows are scored where they stand; a long text is hashed in overlapping blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each language

    def start():
        let_go()
        model = shared.value

        def work(texts: list[str]) -> list:
            found = [model.predict(t) for t in texts]
            return [[lang for lang, _ in found], [p for _, p in found],
                    [lang == UNDETERMINED or p < model.reject_below for lang, p in found]]

        return work

    return map_texts(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), ["doc_id", "held_out"], start,
                     "lang_pred string, score double, rejected boolean")
