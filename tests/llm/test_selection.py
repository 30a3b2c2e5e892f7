"""Resampling, alignment and sharding against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orgweave.llm import align, interleave, resample

from .test_corpus import AWKWARD

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s" if k % 3 else None, 1, 0, 0.5, 1, "p", "q") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, score double, at long, a string, position string")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, n=10_000):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(words) - k + 1)]


# resampling ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("words", [500_000, 7, 3])
def test_features_are_the_checksums_of_runs(monkeypatch, words):
    monkeypatch.setattr(resample, "_WORDS", words)
    rng = np.random.default_rng(1)
    alphabet = [*"abAB09 .,-éß日\U0001F600\n\t", "x" * 70, "y" * 200, " "]
    texts = ["", None, " ", "a", "a b", "x" * 300 + " " + "é" * 100 + " z", *("".join(rng.choice(alphabet, rng.integers(0, 200))) for _ in range(200))]
    found, n_words = [Counter() for _ in texts], np.zeros(len(texts), int)
    for of_words, bucket, of in resample.features(pa.array(texts, pa.string())):
        n_words += np.bincount(of_words, minlength=len(texts))
        for b, i in zip(bucket.tolist(), of.tolist()):
            found[i][b] += 1
    assert found == [Counter(buckets_of(t)) for t in texts] and n_words.tolist() == [len(words_of(t)) for t in texts]


def resampled_by_hand(docs, target):
    s, t = Counter(b for _, x in docs for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    total_s, total_t = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * total_s / ((s[b] + 1.0) * total_t)))
    rows = []
    for i, text in docs:
        f, h = buckets_of(text), int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[:5 * len(enough) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in rows)))


def test_resampling_against_brute_force(spark, awkward):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve"]
    made = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(1000, 1400)]
    made += [(5000 + i, made[3][1]) for i in range(200)] + [(7, "one two " * 15)] * 30  # copies, and rows that are equal
    target = [" ".join(rng.choice(vocabulary[:40], 30)) for _ in range(50)] + [None, ""]
    docs = awkward.select("doc_id", "text").unionAll(spark.createDataFrame(made, "doc_id long, text string"))
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(list(r)) for r in got) == resampled_by_hand([*AWKWARD, *made], target)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + 5 * sum(len(words_of(t)) >= 20 for _, t in [*AWKWARD, *made]) // 100))


def test_resampling_on_awkward_tables(spark, awkward):
    none = awkward.limit(0)
    assert resample.resample(none, none).collect() == []
    rows = resample.resample(awkward, none).collect()
    assert len(rows) == len(AWKWARD) and all(r["weight"] == 0 == r["n_features"] for r in rows if not words_of(dict(AWKWARD).get(r["doc_id"])))


# alignment -------------------------------------------------------------------------------------------------------------

class ByHand:
    """Whole texts by both libraries, and every pair of tokens compared."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel

        path_a, path_b = align.default_paths()
        self.a, self.b, self.decoder = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), ByteLevel()
        self.a.encode_special_tokens = True
        self.shown = {c: b for b, c in align._byte_letters().items()}

    def spans(self, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    def of(self, text):
        if not text:
            return [], [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts_a = [bytes(self.shown[c] for c in self.a.id_to_token(i)) for i in a]
        parts_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            return [], [], [], []
        spans_a, spans_b = self.spans(parts_a), self.spans(parts_b)
        links = [(i, j) for i, x in zip(a, spans_a) for j, y in zip(b, spans_b) if x[0] < y[1] and y[0] < x[1]]
        groups, start = [], 0
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            groups.append(f"{','.join(str(i) for i, s in zip(a, spans_a) if start <= s[0] < end)}|{','.join(str(j) for j, s in zip(b, spans_b) if start <= s[0] < end)}")
            start = end
        return a, b, links, groups

    def rows(self, docs):
        made = [(i, *self.of(t)) for i, t in docs]
        count = Counter(p for *_, links, _ in made for p in set(links))
        most = Counter()
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        return sorted((str(i), len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), ";".join(groups)) for i, a, b, links, groups in made)


def random_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    alphabet = [*"abAB09 .,-éß日\U0001F600\n\t'", "  ", "   ", " the ", "ing ", "<|endoftext|>", "<s>", "<0x41>", " ", "́", "\x00", "don't"]
    return ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(n)] + ["a▁b", " ", "  ", "x ", " x", "x  ", "\n", "\t \n  y", "▁", "a\n  b", "a\n\n   b\n ", "x \n", "x\n \n", "é\u3000  b \x1c c", "a\x85 b"]


@pytest.mark.parametrize("hot", [1, 40, align.HOT])
def test_alignment_against_brute_force(spark, awkward, monkeypatch, hot):
    docs = [(i, t) for i, t in AWKWARD if not t or len(t) < 9000] + list(enumerate(random_texts(120)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    texts = align.aligned(rows)
    found = align.score_links(texts, align.pair_counts(texts), hot)
    got = texts.join(found, "row", "left").collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"] or 0, r["count_sum"] or 0, r["groups"]) for r in got) == ByHand().rows(docs)


def test_cached_units_are_the_whole_texts(monkeypatch):
    monkeypatch.setattr(align, "_KEPT_UNITS", 50)
    aligner, by_hand, texts = align.Aligner(*align.default_paths()), ByHand(), random_texts(300, 8)
    for at in range(0, len(texts), 20):
        columns = aligner.align(texts[at:at + 20], False)
        assert columns["groups"] == [";".join(by_hand.of(t)[3]) for t in texts[at:at + 20]]
        assert columns["n_links"].tolist() == [len(by_hand.of(t)[2]) for t in texts[at:at + 20]] == [int(x.sum()) for x in columns["times"]]


def test_merge_of_ends():
    at_a, at_b, both = align.merge_ends(np.array([1, 4, 6]), np.array([2, 4, 5, 6]))
    assert list(zip(at_a, at_b)) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)] and both.tolist() == [False, False, True, False, True]


def test_alignment_on_awkward_tables(spark, awkward):
    assert align.align_documents(awkward.limit(0)).collect() == []
    rows = align.align_documents(awkward, digest=True).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in AWKWARD)
    assert {(r["n_a"], r["groups"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, "")} and all(len(r["groups"]) == 64 for r in rows if r["n_a"])
    assert rows[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


# sharding --------------------------------------------------------------------------------------------------------------

def sharded_by_hand(docs, shards=24):
    by_source = {}
    for i, source, text in docs:
        by_source.setdefault("" if source is None else "=" + source, []).append((hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest(), i, text))
    order = sorted(((r + 0.5) / len(rows), own, i, text) for own, rows in by_source.items() for r, (_, i, text) in enumerate(sorted(rows, key=lambda x: x[0])))
    n, out = len(order), []
    for at, (_, own, i, text) in enumerate(order):
        raw, shard = (text or "").encode(), at * shards // n
        out.append((str(i), own, len(raw) + 8, zlib.crc32(raw), "rows", shard, at - (shard * n + shards - 1) // shards, None))
    return sorted(map(str, out))


def as_tuples(df):
    return sorted(str((str(r["doc_id"]), "" if r["source"] is None else "=" + r["source"], r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"])) for r in df.collect())


def test_sharding_against_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{int(rng.integers(12))}", "é" * int(rng.integers(0, 9))) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    out = interleave.interleave(frame)
    assert as_tuples(out) == sharded_by_hand(docs)
    sizes, mixture = Counter(), Counter()
    for r in out.collect():
        sizes[r["shard"]] += 1
        mixture[r["source"], r["shard"]] += 1
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for source, n in Counter(s for _, s, _ in docs).items():
        assert all(abs(mixture[source, k] - n / 24) <= 2 for k in range(24))
    assert as_tuples(interleave.interleave(frame.limit(5), shards=7)) != []


def test_sharding_on_awkward_tables(spark, awkward):
    assert interleave.interleave(awkward.limit(0)).collect() == []
    rows = interleave.interleave(awkward).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 8) for i, t in AWKWARD)
    assert all(r["slot"] == 0 for r in rows) and len({r["shard"] for r in rows}) == len(rows)
    same = interleave.interleave(spark.createDataFrame([(1, "a", "x")] * 100, "doc_id long, source string, text string"), shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in same) == [(k, i) for k, n in enumerate((34, 33, 33)) for i in range(n)]
