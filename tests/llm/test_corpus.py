"""The corpus operators against brute force, exact round trips and held-out labels, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.llm import ann, bpe, langid, licenses, neardup, packing, pii, quality, topk, toxicity
from orgweave.llm.common import blocks, crc_mod, free_name, sample_ids

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
AWKWARD = [(1, "one two three four five six"), (2, None), (3, ""), (4, "   \n\t "), (5, "one two three four five six"), (5, "one two three four five six"), (None, "a null id"),
           (6, "x" * 50_000), (7, "ünïcode ß 日本語 \U0001F600 ́"), (8, "word " * 9_000), (9, "!!! ... ???"), (2**62, "big id")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "p", "q") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, piece string, bands string")


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# common ----------------------------------------------------------------------------------------------------------------

def test_blocks_cover_everything():
    assert list(blocks([3, 3, 9, 1, 1], 5)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert list(blocks([], 5)) == []


def test_sample_is_bounded_and_independent_of_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    a = sorted(map(tuple, sample_ids(df, "doc_id", "quality", 50).collect()))
    b = sorted(map(tuple, sample_ids(df.repartition(7), "doc_id", "quality", 50).collect()))
    assert a == b and max(Counter(y for _, y in a).values()) <= 50


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "_found int, _FOUND_ int"), "found") == "_found__"


# BPE -------------------------------------------------------------------------------------------------------------------

def test_encoding_is_the_librarys(library):
    rng = np.random.default_rng(0)
    alphabet = list("aAbBsS .,!|'\n\tßéÉİΣ<>1２日\x1c") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "́", " ", "क़", "ed ", "ing "]
    texts = ["", " ", "x" * 9000, *("".join(rng.choice(alphabet, rng.integers(0, 300))) for _ in range(400))]
    expected = [ids_of(library, t) for t in texts]
    enc = bpe.ChunkEncoder(bpe.default_vocabulary(), words=400, chunks=50)  # small caches are swapped again and again
    for mean in (8, 64, 256):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts, mean)] == expected
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode_words(texts)] == expected


def test_joins_are_repaired_until_they_agree(library):
    rng = np.random.default_rng(9)
    words = ["re", "joining", "Tokens", "über", "of,", "the", "e.g.", "x" * 30, "42nd", "ed"]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(3)]
    texts += [texts[0] + " " + texts[1], "日本語" * 3000, " ".join(texts) + "\x1c tail"]
    expected = [ids_of(library, t) for t in texts]
    enc = bpe.ChunkEncoder(bpe.default_vocabulary())
    ids = lambda: [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts, 64)]
    assert ids() == expected and enc.joins > 50 and enc.widened == enc.whole == 0
    for key, (raw, ends) in list(enc.chunks.new.items()):  # spoil the word before a chunk's last one: windows disagree, also wider ones, and the whole text tells
        if len(ends) > 3:
            enc.chunks.put(key, (raw[:ends[-3]] + (7).to_bytes(4, "little") + raw[ends[-3] + 4:], ends))
    assert ids() == expected and enc.widened > 0 and enc.whole >= 4


def test_pieces_texts_are_the_librarys(library):
    enc = bpe.ChunkEncoder(bpe.default_vocabulary(), chunks=4, windows=4)
    texts = ["", "one", "a passage that comes again and again, in many documents; " * 40]
    for t, pieces in zip(texts, enc.encode_pieces(texts, 64)):
        ids = ids_of(library, t)
        assert enc.shown(pieces) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    assert enc.decode([1, 2, 10**6, 3]) == library.decode([1, 2, 10**6, 3], skip_special_tokens=False)


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b = "start " + passage, "quite another beginning " + passage
    cut = lambda t: {t[x:y] for x, y in zip([0, *bpe.cut_points(t)], bpe.cut_points(t))}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 3
    assert bpe.cut_points("") == [] and max(np.diff([0, *bpe.cut_points("z" * 20_000)])) <= 4096


def test_encode_and_decode_rows(awkward, library):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(awkward, output="digest").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted((i or -1, len(x := ids_of(library, t)), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, t in AWKWARD)
    assert got == expected
    full = bpe.encode_documents(awkward.where("doc_id < 6"))
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(full).collect()}
    assert all(r["decoded"] == again[r["doc_id"]] for r in full.collect())
    assert bpe.encode_documents(awkward.where("false")).count() == 0


def test_words_of_letters_are_not_taken_up_by_python(library):
    rng = np.random.default_rng(11)
    letters = list("abcdefgxyzAÉÿßÑçŒžяЁΣİ")
    texts = [" ".join("".join(rng.choice(letters[:n], rng.integers(1, 7))) + str(rng.choice(["", "", ",", "...", "$$$)", "'s"])) for _ in range(400)) for n in (12, 16, 22) for _ in range(5)]
    expected = [ids_of(library, t) for t in texts]
    enc = bpe.ChunkEncoder(bpe.default_vocabulary())
    taken, learn = set(), enc.learn
    enc.learn = lambda words: (taken.update(words), learn(words))
    for t, ids in zip(texts, expected):  # with what earlier texts left, then all at once
        assert np.frombuffer(enc.encode_words([t])[0], "<u4").tolist() == ids
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode_words(texts)] == expected
    assert taken and not any(re.fullmatch(r"[A-Za-zÉÿßÑçŒžяЁ]+[.,$)]*", w) for w in taken)


def test_merges_are_held_once():
    enc = bpe.ChunkEncoder(bpe.default_vocabulary())
    enc.bare.model.dropout = 0.5  # shows in the other only if both have the same model
    assert enc.tokenizer.model.dropout == 0.5


def test_kept_words_are_few_and_short(library):
    enc = bpe.ChunkEncoder(bpe.default_vocabulary(), cores=500)
    for start in range(0, 6000, 300):
        texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(start, start + 300)), "z" * 3000 + " " + "7" * 100]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode_words(texts)] == [ids_of(library, t) for t in texts]
        assert 300 <= len(enc.cores.words) <= 500 and max(map(len, enc.cores.words.to_pylist())) <= bpe.KEPT_BYTES and not enc.word_ids


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


# packing ---------------------------------------------------------------------------------------------------------------

def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


def test_subset_sum_is_the_fullest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 40, rng.integers(1, 7))}
        room = int(rng.integers(0, 80))
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(used[n] <= counts[n] for n in used) and sum(n * c for n, c in used.items()) == best_sum(counts, room)


def test_packing_rows(awkward, library):
    rows = packing.pack_documents(awkward, capacity=512).collect()
    expected = Counter()
    for i, t in AWKWARD:
        x = [*ids_of(library, t), 1]
        for at in range(0, len(x), 512):
            part = x[at:at + 512]
            expected[i, at // 512, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 512
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 512) + 1
    assert packing.pack_documents(awkward.where("false")).count() == 0


# near duplicates -------------------------------------------------------------------------------------------------------

def brute_classes(texts, similarity=0.8):
    def sh(t):
        words = re.findall(r"[0-9a-zA-Z\x80-\U0010FFFF]+", (t or "").lower())
        return Counter([tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])), tuple(words)

    sets, up = [sh(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            (a, wa), (b, wb) = sets[i], sets[j]
            if wa == wb or (a and b and (a & b).total() / (a | b).total() >= similarity):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_as_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(3, 200)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            edited = list(base)
            for _ in range(rng.integers(0, 4)):
                edited[rng.integers(0, len(edited))] = str(rng.choice(words))
            texts.append(" ".join(edited))
    texts += [None, "", "!!", texts[0], texts[0].upper() + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, neardup.near_duplicates(df).collect()))
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_texts_are_linked_not_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, a), (None, "c " + b), (None, "x " * 40), (None, "x " * 41), (7, "y " * 40 + a), (8, "y " * 60 + a), (9, "y y y y y " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, 1), (None, None), (None, None), (7, 7), (8, 7), (9, 1)], key=str)
    kept = neardup.keep_one(df, neardup.classified(df)).collect()
    assert sorted(((r["doc_id"], r["text"][:3]) for r in kept), key=str) == sorted([(1, "a0 "), (1, "b0 "), (7, "y y"), (None, "x x")], key=str)
    plain = dict(map(tuple, neardup.near_duplicates(df.where("doc_id > 1"), weighted=False).collect()))
    assert plain[8] == plain[7] == plain[3]  # without weights a repeated shingle counts once


@pytest.mark.parametrize("weighted", [False, True])
def test_near_pairs_in_a_family_of_less_similar_texts(spark, weighted):
    fresh = iter(range(10**6))
    core, texts = [f"c{i}" for i in range(190)], []
    for i in range(500):
        tail = [f"u{next(fresh)}" for _ in range(26)]
        texts.append(" ".join(core + tail))  # any two at 0.78
        if i % 25 == 5:
            texts.append(" ".join(core + tail[:4] + [f"u{next(fresh)}" for _ in range(22)]))  # with the one before at 0.81
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, neardup.near_duplicates(df, weighted=weighted).collect()))
    want = brute_classes(texts)
    assert len(set(want)) == 500 and [got[i] for i in range(len(texts))] == want


def test_rest_pairs_hold_every_near_pair(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(20, 50))) for _ in range(150)]
    sets += [np.unique(np.append(rng.permutation(x)[2:], 60 + i)) for i, x in enumerate(sets[:50])]
    hashed = [np.sort(neardup.mix(x.astype(np.uint64) + np.uint64(1))).tobytes() for x in sets]
    sh = spark.createDataFrame(list(enumerate(map(bytearray, hashed))), "id long, sh binary")
    labels = spark.createDataFrame([(i, i % 7) for i in range(len(sets))], "v long, label long")
    near = {(i, j) for j in range(len(sets)) for i in range(j) if i % 7 != j % 7 and neardup.jaccard(hashed[i], hashed[j]) >= 0.8}
    got = {tuple(r) for r in neardup.rest_pairs(sh, labels, 0.8, False).collect()}
    assert near and near <= got and all(a % 7 != b % 7 for a, b in got)


def test_near_duplicates_awkward(awkward):
    got = defaultdict(set)
    for r in neardup.near_duplicates(awkward).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[5] == {1} and got[1] == {1} and got[2] == got[3] == got[4] == got[9] == {2} and got[None] == {None} and got[2**62] == {2**62}
    kept = neardup.keep_one(awkward, neardup.classified(awkward))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 6, 7, 8, 2**62] and kept.columns == awkward.columns
    assert neardup.near_duplicates(awkward.where("false")).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    ids = neardup.mix(np.arange(300, dtype=np.uint64))
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    wa[250:], wb[:50] = 0, 0
    a, b = wa > 0, wb > 0
    elements, owner = np.concatenate([ids[a], ids[b]]), np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    sig = neardup.dart_minhash(elements, owner, np.concatenate([wa[a], wb[b]]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    assert (sig != 0).all()
    one = neardup.dart_minhash(ids[:1], np.zeros(1, int), np.ones(1), 2, 64)  # a single element fills all coordinates, none stays empty
    assert (one[0] != 0).all() and (one[1] == 0).all()


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = dict(map(tuple, neardup.components(links).collect()))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30


def test_components_follow_links_once(spark, monkeypatch):
    """A family whose texts are each linked with a dozen hubs: what is written in all rounds stays near the links themselves, and links that come later are followed between components alone."""
    rng, rows, real = random.Random(3), [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: (lambda out: (rows.append(out.count()), out)[1])(real(df, name)))
    family = {(rng.randrange(60), v) for v in range(60, 400) for _ in range(12)} | {(1000 + i, 1001 + i) for i in range(0, 40, 2)}
    labels = neardup.components(spark.createDataFrame(sorted(family), "a long, b long"))
    assert sum(rows) < 2 * len(family)
    rows.clear()
    later = [(70, 80), (1000, 1002), (1002, 1004), (3, 1020), (2000, 2001), (2001, 399)]
    got = dict(map(tuple, neardup.relabelled(labels, spark.createDataFrame(later, "a long, b long")).collect()))
    assert sum(rows[:-1]) < 60
    least = {v: v for e in family | set(later) for v in e}
    for _ in range(60):
        for a, b in family | set(later):
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


# searches --------------------------------------------------------------------------------------------------------------

def vectors(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # one very common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0), (1000, None, 0), (1001, [float("nan")] * 16, 0), (1020, [None] * 16, 0), (1040, [0.0] * 16, 0), (None, x[0].tolist(), 0), (1060, [1.0, 2.0], 0)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute_top(x, ids, k, every):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = x @ x[q]
            order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))[:k]
            out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def ranked(rows):
    got = defaultdict(list)
    for r in rows.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(got)


@pytest.mark.parametrize("shard_bytes,block_bytes", [(4096, 1024), (4 << 20, 4 << 20)])
def test_exact_top_k(spark, shard_bytes, block_bytes):
    x, df = vectors(spark)
    q = np.floor(64 * np.vstack([x, np.zeros(16)]))
    assert ranked(topk.exact_top_k(df, 20, 20, shard_bytes, block_bytes)) == brute_top(q, [*range(400), 1040], 20, 20)
    assert topk.exact_top_k(df.where("false")).count() == 0
    assert topk.exact_top_k(df.where("vec_id IN (0, 1)")).count() == 1


@pytest.mark.parametrize("size", [1e5, 3e6, 4e7, 1e16])
def test_exact_top_k_of_large_integers(spark, size):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(-1, 1, size=(60, 8)) * size)
    whole = [[int(v) * 64 for v in row] for row in x]
    hold = lambda n: max(-2**63, min(2**63 - 1, n))
    expected = {}
    for i in range(0, 60, 20):
        scores = [(hold(sum(a * b for a, b in zip(whole[i], row))), j) for j, row in enumerate(whole) if j != i]
        expected[i] = [(j, s) for s, j in sorted(scores, key=lambda t: (-t[0], t[1]))[:20]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ranked(topk.exact_top_k(df, 20, 20, 512)) == expected


def test_rows_that_share_an_id_stay_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (20, [1.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ranked(topk.exact_top_k(df))
    assert got[0] == [(1, 192 * 64), (1, 128 * 64), (20, 64 * 64), (20, 0)]
    assert [i for i, _ in got[20]] == [0, 1, 1]  # [0, 1] sorts first and asks
    near = ranked(ann.nearest(df))
    assert near[0] == [(1, 3.0), (1, 2.0), (20, 1.0), (20, 0.0)] and near[20] == [(0, 0.0), (1, 0.0), (1, 0.0)]


def test_a_vector_that_many_ids_share(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.col("id") / 6000, F.lit(0.5))).alias("embedding"))
    same = [i for i in range(0, 3000, 3)]
    for got in (ranked(topk.exact_top_k(rows)), ranked(ann.nearest(rows))):
        assert len(got) == 150 and all([i for i, _ in got[q]] == [i for i in same if i != q][:20] for q in got)


def test_nearest(spark):
    x, df = vectors(spark)
    got = ranked(ann.nearest(df, 20, 20, keep=120, shard_bytes=2048, block_bytes=1024, rerank_bytes=8192))
    expected = brute_top(x, list(range(400)), 20, 20)
    assert set(got) == set(expected) and 1040 not in got
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected])
    assert recall >= 0.95
    for q, rows in got.items():
        assert all(abs(s - x[i] @ x[q]) < 1e-12 for i, s in rows) and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ann.nearest(df.where("false")).count() == 0


@needs_tables
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_on_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    good = [(i, v) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    got, expected = ranked(ann.nearest(table)), brute_top(np.array([v for _, v in good], dtype=float), [i for i, _ in good], 20, 20)
    assert set(got) == set(expected)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / len(expected[q]) for q in expected]) >= 0.9


@pytest.mark.parametrize("kind", ["weak components", "tight clusters", "lengths"])
def test_recall_on_other_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    if kind == "weak components":
        x /= np.arange(1, 65)
    elif kind == "tight clusters":
        x = rng.normal(size=(20, 64))[rng.integers(0, 20, len(x))] + 0.01 * x
    else:
        x *= rng.lognormal(0, 1.5, (len(x), 1))
    got = ranked(ann.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), keep=80))
    expected = brute_top(x, list(range(len(x))), 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]) >= 0.9


def test_anisotropic_loss_favours_parallel_residuals():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = ann.Quantizer(16, threshold=0.0).fit(x), ann.Quantizer(16, threshold=0.6).fit(x)

    def parallel(q):
        codes = q.encode(x)
        shown = np.stack([q.books[m][codes[:, m]] for m in range(q.spaces)], 1).reshape(len(x), -1)[:, :16]
        return (((x - shown) * x).sum(1) ** 2).mean()

    assert parallel(aware) < 0.5 * parallel(plain)


# licenses and personal data --------------------------------------------------------------------------------------------

WORDS = re.compile(licenses.WORD)


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, starts, labels = WORDS.findall(low), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_and_method(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "x CC BY-NC 4.0 cc by cc by", "GNU General Public License, version 3. ALL RIGHTS RESERVED", "cc-by cc BY", "acc by", "é ñ İ", None, "", "all rights", "cc by " * 3000,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MPL-2.0", "Released under the BSD 3-Clause License and the MIT License"]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows] == [brute_base(t) for t in texts]
    labels = [r["labels"] for r in rows]
    assert labels[0] == "apache-2.0" and labels[1] == "cc-by,cc-by-nc" and labels[2] == "gpl,gpl-3.0,reserved" and labels[10] == "mit" and labels[11] == "mpl-2.0" and labels[12] == "bsd-3-clause,mit" and labels[4] == labels[5] == ""
    assert all(0 <= r["score"] <= 1 for r in rows) and licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(licenses.rules()) > 200 and len(licenses.SENTENCES) + len(licenses.LICENSES) > 250  # hand-written


def brute_labels(text, base=licenses.BASE):
    """(labels, score) by trying all rules on the text, without gates, and comparing all intervals with each other."""
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spaced, hits = " " + " ".join(words) + " ", []
    for place, (priority, label, _, pattern, strength) in enumerate(licenses.rules()):
        hits += [(m.start(), m.end(), priority, place, label, strength) for m in re.finditer(pattern, spaced)]

    def suppressed(h):
        return any(o is not h and o[0] <= h[0] and h[1] <= o[1] and o[2] <= h[2] and ((o[0], o[1]) != (h[0], h[1]) or (o[2], o[3]) < (h[2], h[3])) for o in hits)

    kept = [h for h in hits if not suppressed(h)]
    phrases = {label for phrase, label in base.items() if f" {phrase} " in spaced}
    return ",".join(sorted({h[4] for h in kept} | phrases)), max([h[5] for h in kept] + ([0.9] if phrases else [0.0]))


def test_license_labels_as_brute_force(spark):
    rng = np.random.default_rng(12)
    parts = [" ".join(re.findall(r"[a-z0-9]+", t)) for t in {next(iter(sorted(expanded(re._parser.parse(p))))) for _, _, _, p, _ in licenses.rules()}]
    fill = ["the", "of", "license", "licensed under", "version 2", "and", "terms", "x"]
    texts = [" ".join([str(rng.choice(parts if rng.random() < 0.4 else fill)) for _ in range(rng.integers(1, 14))]) for _ in range(120)] + [None, "", "GPL \u212a CC BY", "(C) 2020. All rights reserved; LICENSED UNDER THE MIT LICENSE!"]
    rows = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(texts))] == [brute_labels(t) for t in texts]


def test_license_rows(spark, awkward):
    rows = licenses.scan_licenses(awkward.unionByName(awkward)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([i for i, _ in AWKWARD] * 2) and all(r["labels"] == "" for r in rows)
    long = "word " * 20_000 + "licensed under the mit license " + "word " * 20_000
    (row,) = licenses.scan_licenses(spark.createDataFrame([(None, long, "x")], "doc_id long, text string, labels string")).collect()
    assert (row["doc_id"], row["labels"], row["n_words"]) == (None, "mit", 40_005)


def expanded(parsed):
    """Texts that a rule matches, one for each alternative and character of a class; what may be left out is left out."""
    out = [""]
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(x)]
        elif name == "BRANCH":
            more = [t for branch in x[1] for t in expanded(branch)]
        elif name == "SUBPATTERN":
            more = expanded(x[3])
        elif name == "MAX_REPEAT":
            more = [t * x[0] for t in expanded(x[2])] if x[0] else [""]
        elif name == "IN":
            more = [chr(v) if str(o) == "LITERAL" else "7" if "DIGIT" in str(v) else "w" if "WORD" in str(v) else chr(v[0]) for o, v in x]
        elif name == "ASSERT":
            more = expanded(x[1])
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in more]
    return set(out)


def test_license_gates_let_every_alternative_through(spark):
    texts = set()
    for _, label, keyword, pattern, _ in licenses.rules():
        for text in expanded(re._parser.parse(pattern)):
            assert re.search(pattern, text), (pattern, text)
            assert keyword in text and any(stem in text for stem in licenses.STEMS), (label, keyword, text)
            texts.add(text)
    assert len(texts) > 1000
    said = {"The code is released under MIT.": "mit", "available under Apache 2.0": "apache-2.0", "distributed under BSD 3-Clause": "bsd-3-clause", "licensed under ASL 2.0": "apache-2.0",
            "licensed under the PSF license": "python", "licensed under BSL 1.0": "boost", "Creative Commons Zero": "cc0", "Creative Commons Attribution NonCommercial NoDerivs": "cc-by-nc-nd",
            "the Common Development and Distribution License": "cddl", "Berkeley Software Distribution License, licensed": "bsd"}
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    assert all(want in rows[i]["labels"].split(",") for i, want in enumerate(said.values())), [r["labels"] for r in rows]


@needs_tables
def test_license_base_on_documents(tables):
    docs = {r["doc_id"]: r["text"] for r in tables("documents").collect()}
    for r in licenses.scan_licenses(tables("documents")).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(docs[r["doc_id"]])


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1


def test_pseudonyms_keep_their_format(spark):
    texts = ["mail ann.68@mail7.example.com now", "card 4111 1111 1111 1111, 9807915762804490.", "+1 (017) 555-7713", "ip 97.51.17.173 999.1.1.1 1.2.3.4.5", "1984-02-29 31/12/1999 2023-02-30 12.05.2001", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
             "123-45-6789 666-12-1234 000-11-2222", "GB82WEST12345698765432 GB83WEST12345698765432", None, "", "no data 12", "again ann.68@mail7.example.com",
             "4111111111111111 4111-1111-1111-1111", "NL91 ABNA 0417 1643 00", "DE89 3704 0044 0532 0130 00 PAID and DE89370400440532013000", "2021-03-04T10:15:00Z 2021/03/04 4.3.2021 3/4/2021 03/04/21 1.2.3", "555 234 4567 (555) 234-4567 555 123 4567 +12 34",
             "f" * 3_000 + "0", "x" * 60_000 + " ann.68@mail7.example.com"]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, _found string, n int")
    rows = pii.pseudonymize(df, "k", count_col="n").orderBy("doc_id").collect()
    out = [r["text"] for r in rows]
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
    for i in (0, 1, 2, 6, 7, 12, 13, 14, 16):
        assert shape(out[i]) == shape(texts[i]) and out[i] != texts[i]
    cards = re.findall(r"[\d ]{16,}", out[1])
    assert luhn(cards[0].replace(" ", "")) and cards[1].strip() == "9807915762804490" and not luhn("9807915762804490")  # no card number, so it stays
    assert {c.replace("-", "") for c in out[12].split()} == {cards[0].strip().replace(" ", "")}
    assert out[0].split()[1] == out[11].split()[1] == out[18].split()[1] and out[0].split()[1].endswith("@mail7.example.com")
    assert "97.51.17.173" not in out[3] and out[3].endswith("999.1.1.1 1.2.3.4.5") and all(int(p) < 256 for p in out[3].split()[1].split("."))
    import datetime as dt

    a, b, c, d = out[4].split()
    dt.date.fromisoformat(a), dt.datetime.strptime(b, "%d/%m/%Y") if int(b[:2]) > 12 else None, dt.datetime.strptime(d, "%d.%m.%Y")
    assert c == "2023-02-30" and a != "1984-02-29"
    stamp, slashed, dotted, american, short, version = out[15].split()
    day = dt.date.fromisoformat(stamp[:10])
    assert stamp[10:] == "T10:15:00Z" and len(dotted) == len("4.3.2021") and day != dt.date(2021, 3, 4) and slashed == day.strftime("%Y/%m/%d") and dotted == f"{day.day}.{day.month}.{day.year}" and american == f"{day.month}/{day.day}/{day.year}"
    assert dt.datetime.strptime(short, "%m/%d/%y") and short != "03/04/21" and version == "1.2.3"
    assert out[6].split()[1:] == ["666-12-1234", "000-11-2222"]
    assert iban_ok(out[7].split()[0]) and out[7].split()[1] == "GB83WEST12345698765432" and iban_ok(out[13])
    spaced, _, plain = out[14].partition(" PAID and ")
    assert iban_ok(spaced) and spaced.replace(" ", "") == plain
    one, two, rest = out[16][:12], out[16][13:27], out[16][28:]
    assert re.sub("[^0-9]", "", one) == re.sub("[^0-9]", "", two) and re.match("[2-9]..[ ][2-9]", one) and rest == "555 123 4567 +12 34"
    assert len(out[17]) == 3_001 and re.fullmatch("[0-9a-f]+", out[17]) and len(set(out[17])) == 16
    assert out[8] is None and out[9] == "" and out[10] == "no data 12" and [r["n"] for r in rows][8:11] == [0, 0, 0]
    assert rows[0]["_found"] == "x" and pii.pseudonymize(df, "other").orderBy("doc_id").first()["text"] != out[0]
    assert pii.pseudonymize(df.where("false"), "k").count() == 0
    twice = pii.pseudonymize(df.union(df), "k").collect()
    assert Counter(r["text"] for r in twice) == Counter(out + out)


def plain_feistel(values, radices, tag, key):
    """The network in plain Python."""
    values, half = list(values), len(values) // 2
    for r in range(1, pii.ROUNDS + 1):
        other = values[half:] if r % 2 else values[:half]
        seed = "|".join([key, tag, str(r), ",".join(map(str, other))])
        for i in range(half) if r % 2 else range(half, len(values)):
            if radices[i] > 1:
                values[i] = (values[i] + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % radices[i]
    return values


def test_phones_are_linked_however_written(spark):
    texts = ["+1 555 223 4567", "+1-555-223-4567", "+15552234567", "(555) 223-4567", "555-223-4567", "+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+380 44 123 4567", "+1 017 555 7713", "+10175557713"]
    out = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    digits = [re.sub("[^0-9]", "", t.replace("(0)", "")) for t in out]
    assert digits[0] == digits[1] == digits[2] == "1" + digits[3] and digits[3] == digits[4] and digits[5] == digits[6] == digits[7] and digits[9] == digits[10]
    assert [re.sub("[0-9]", "9", t) for t in out] == [re.sub("[0-9]", "9", t) for t in texts] and not set(out) & set(texts) and len(set(digits)) == 5
    assert digits[5].startswith("44") and digits[8].startswith("380") and "(0)" in out[7]


def test_dates_keep_their_length_and_stay_linked(spark):
    import datetime as dt

    days = [dt.date(1900, 1, 1) + dt.timedelta(n) for n in (*range(0, 73049, 97), 59, 1520, 73048, 73047)] + [dt.date(2000, 2, 29), dt.date(2096, 2, 29), dt.date(1904, 2, 29)]
    text = lambda d: f"{d.isoformat()} {d:%Y/%m/%d} {d.day}.{d.month}.{d.year} {d:%d.%m.%Y}"
    rows = spark.createDataFrame([(i, text(d)) for i, d in enumerate(days)], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymize(rows, "k").orderBy("doc_id").collect()]
    made = [dt.date.fromisoformat(t.split()[0]) for t in out]
    assert [text(d) for d in made] == out and len(set(made)) == len(set(days))
    assert [len(t) for t in out] == [len(text(d)) for d in days] and sum(a == b for a, b in zip(made, days)) < 8
    short = [r["text"] for r in pii.pseudonymize(spark.createDataFrame([(i, f"{d:%m/%d/%y}") for i, d in enumerate(days) if d.year >= 2000], "doc_id long, text string"), "k").collect()]
    assert all(dt.datetime.strptime(t, "%m/%d/%y") for t in short) and sum(map(len, DAYS := list(pii.DAYS.values()))) == 365 and [len(d) for d in DAYS] == [81, 192, 27, 65]


def test_long_dotted_texts_in_a_cold_session():
    """In a fresh JVM the regular expressions are interpreted, which takes the most stack."""
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession
from orgweave.llm import pii
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
texts = ["x@" + "a." * 2000 + "com", "x@" + "a." * 50000, "1." * 3000, "1 " * 3000, "1-" * 3000, "a@" * 3000, "AB12 " * 2000, "x@" + "a" * 90000 + ".com", "+1 " + "22 " * 3000, "a@b.co"]
out = [r[0] for r in pii.pseudonymize(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
assert out[:2] == texts[:2] and out[-1] != texts[-1], out[-1]
print("whole")
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]


@needs_tables
def test_pseudonyms_as_plain_python(tables):
    def replaced(m):
        local, domain = m[0].rsplit("@", 1)
        alphabet = lambda c: next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c)
        form = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", local)))
        moved = plain_feistel([alphabet(c).index(c) for c in local], [len(alphabet(c)) for c in local], f"email|0|{form}", pii.salted("k"))
        return "".join(alphabet(c)[v] for c, v in zip(local, moved)) + "@" + domain

    docs = {r["doc_id"]: r["text"] for r in tables("documents").collect()}
    found = 0
    for r in pii.pseudonymize(tables("documents").select("doc_id", "text"), "k", count_col="n").collect():
        text = docs[r["doc_id"]] or ""
        mails = re.findall(pii.EMAIL, text)
        found += len(mails)
        assert re.findall(pii.EMAIL, r["text"] or "") == [replaced(re.match(r"(?s).*", m)) for m in mails]
        assert r["n"] > 0 or r["text"] == docs[r["doc_id"]]
        for kind, pattern in (("ipv4", pii.IPV4), ("secret", pii.SECRET)):
            assert len(re.findall(pattern, text)) == len(re.findall(pattern, r["text"] or ""))
        assert not {c for c in re.findall(r"(?<!\w)[0-9]{16}(?!\w)", text) if luhn(c)} & set(re.findall(r"(?<!\w)[0-9]{16}(?!\w)", r["text"] or ""))
    assert found > 0


def test_feistel_has_an_inverse(spark):
    df = spark.range(300).select(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(r)).cast("int") for i, r in enumerate((10, 26, 3, 7))]).alias("v"))
    r = F.array(*map(F.lit, (10, 26, 3, 7)))
    rows = df.select("v", pii.feistel(F.col("v"), r, F.lit("t"), "k").alias("w")).select("v", "w", pii.feistel(F.col("w"), r, F.lit("t"), "k", inverse=True).alias("back")).collect()
    assert all(x["v"] == x["back"] and x["w"] == plain_feistel(x["v"], (10, 26, 3, 7), "t", "k") for x in rows)


def test_feistel_is_a_bijection(spark):
    df = spark.range(17 * 30).select((F.col("id") % 17).cast("int").alias("a"), F.floor(F.col("id") / 17).cast("int").alias("b"))
    got = {tuple(r[0]) for r in df.select(pii.feistel(F.array("a", "b"), F.array(F.lit(17), F.lit(30)), F.lit("t"), "k")).collect()}
    assert len(got) == 17 * 30 and all(x < 17 and y < 30 for x, y in got)


# classifiers -----------------------------------------------------------------------------------------------------------

def test_scoring_awkward_rows(spark, awkward):
    model = quality.ByteConvolution()
    rows = quality.score_quality(awkward, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    tox = toxicity.learn([], {})
    assert toxicity.score_toxicity(awkward, tox).count() == len(AWKWARD)
    lang = langid.train(awkward.where("false"))
    assert {r["lang_pred"] for r in langid.identify(awkward, lang).collect()} == {"und"}
    for kept in (quality.keep_good(awkward, model, 0.0), toxicity.drop_toxic(awkward, tox, 1.1)):
        assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) and kept.where("doc_id IS NULL").count() == 1


def test_chunks_cover_the_whole_document():
    text = "".join(chr(97 + i % 26) for i in range(5000)) + "é"
    chunks, counts = quality.chunk_rows([text, ""])
    body = b"".join(bytes(c[:quality.STEP].astype(np.uint8)) for c in chunks[:counts[0]])
    assert body.startswith(text.encode()[:quality.STEP * counts[0]]) and counts[1] == 1 and (chunks[-1] == quality.PAD).all()
    model = quality.ByteConvolution()
    model.v[:] = 1
    late, plain = "a" * 100_000 + "!!!!!!!!", "a" * 100_008
    assert abs(model.logits([late])[0] - model.logits([plain])[0]) > 1e-6


def separable(n=300):
    rng = np.random.default_rng(7)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "today"], 60)) for _ in range(n)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "###", "WIN!!"], 60)) for _ in range(n)]
    return good, bad


def test_convolution_learns():
    good, bad = separable()
    model = quality.ByteConvolution()
    model.fit(good[:200] + bad[:200], np.array([1.0] * 200 + [0.0] * 200, np.float32), steps=80)
    z = model.logits(good[200:] + bad[200:])
    assert ((z > 0) == ([True] * 100 + [False] * 100)).mean() > 0.97


@pytest.mark.parametrize("disguised,plain", [("stup1d", "stupid"), ("s t u p i d", "stupid"), ("st.upid", "stupid"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("m.o-r_o*n", "moron"), ("stupid!!", "stupid")])
def test_deobfuscation(disguised, plain):
    rng = np.random.default_rng(8)
    clean = [(" ".join(rng.choice(["there", "house", "reading", "is", "open", "window", "of"], 40)), 0) for _ in range(200)]
    toxic = [(" ".join(rng.choice(["there", "house", "reading", "is", "open", "window", "of"], 40)) + " " + str(rng.choice(["stupid", "moron"])), 1) for _ in range(100)]
    model = toxicity.learn(clean + toxic, {0: 200, 1: 100})
    assert set(model.weights) >= {"stupid", "moron"} or {"stu-"} & set(model.weights)
    scorer = toxicity.Scorer(model)
    assert plain in model.words(f"there is {disguised} of") and scorer.score(f"there is {disguised} of") > 0.5 and scorer.score("there is a house of") < 0.5 and scorer.score(None) < 0.5


@needs_tables
def every_path(word):
    """All originals of a word with their channel costs, by exhaustive enumeration of the lattice."""
    T, out, i = toxicity, [(0.0, "")], 0
    while i < len(word):
        c, j = word[i], i + 1
        while j < len(word) and word[j] == c:
            j += 1
        run = j - i
        ways = [(T.SPACED if c == " " else T.KEPT, c * run)]
        for x in T.LOOKALIKES.get(c, ""):
            ways += [(T.LOOKS + (T.REPEATED if n != run else 0), x * n) for n in sorted({1, min(run, 2)})]
        if c in T.APART:
            ways.append((T.KEPT if c == " " else T.SPLIT, ""))
        if c.isalpha() and run > 1:
            ways += [(T.REPEATED, c * n) for n in (1, 2) if n < run]
        out = [(cost + more, path + text) for cost, path in out for more, text in ways]
        i = j
    return out


def test_restore_is_the_best_path_of_the_lattice():
    model = toxicity.CharacterModel(Counter({"idiot": 50, "stupid": 40, "moron": 30, "hello": 60, "the": 90, "see": 20}))

    def total(cost, path):
        a = b = 0
        for ch in path:
            code = toxicity._code(ch)
            cost += model.logp[a][b][code]
            a, b = (0, 0) if code == 0 else (b, code)
        return cost + model.logp[a][b][0]

    for word in ("1d10t", "m0r0n", "s-t-u-p-1-d", "heee11o", "iidd1oot", "t h 3", "s.e.e", "x9$", "stuuupid", "m*r*n", "i d i o t"):
        best = max(total(cost, path) for cost, path in every_path(word))
        assert abs(total(*next((c, p) for c, p in sorted(every_path(word), reverse=True) if p == model.restore(word))) - best) < 1e-9, word


def test_disguises_of_any_length_and_spacing():
    rng = np.random.default_rng(2)
    plain = ["the", "river", "stone", "garden", "window", "letter", "summer", "bottle", "school", "good"]
    text = lambda extra=(): " ".join([*rng.choice(plain, 30), *extra])
    rows = [(text(["idiot"]), 1) for _ in range(40)] + [(text(["stupid"]), 1) for _ in range(40)] + [(text(), 0) for _ in range(200)]
    model = toxicity.learn(rows, {1: 80, 0: 200})
    scorer = toxicity.Scorer(model)
    for word in ("idiot", "1d10t", "i-d-i-o-t", "id" + "i" * 90 + "ot", "-".join("stupid") + "-" * 300, "stuupid", "i  d  i  o  t", "i\nd\ni\no\nt", "you/stupid", "s.t.u.p.1.d", "st" + "u" * 5000 + "pid", "idioot", "_".join("i" * 40 + "diot")):
        assert scorer.score(text([word])) >= 0.5, word
    for word in ("bottle", "good", "a b c d", "- - - - -", "summer/school", "x" * 70_000, "1-2-3-4-5", "a1b2c3" * 2000):
        assert scorer.score(text([word])) < 0.5, word
    assert not any(len(w) > toxicity.CACHED for w in scorer.seen | scorer.hits.keys())


def test_convolution_as_scalars():
    model, text = quality.ByteConvolution(filters=3, width=2, seed=1), "Ünïcode bytes, over and over. " * 45
    model.b[:], model.v[:], model.c[:], model.shift = 0.1, np.arange(6) - 2.0, 0.3, 0.2
    raw, G = text.encode(), quality.GROUP
    tops = []
    for at in range(0, max(1, len(raw) - quality.OVERLAP), quality.STEP):
        chunk = list(raw[at:at + quality.CHUNK]) + [quality.PAD] * (quality.CHUNK - len(raw[at:at + quality.CHUNK]))
        tops.append([max(max(sum(float(model.emb[chunk[g * G + i], k]) * float(model.w[i * 2 + k, f]) for i in range(2 * G) for k in range(2)) for g in range(quality.CHUNK // G - 1)) + 0.1, 0.0) for f in range(3)])
    tops = np.array(tops)
    want = np.concatenate([tops.max(0), tops.mean(0)]) @ (np.arange(6) - 2.0) + 0.5
    for block in (1, 2, 512):
        assert abs(model.logits([text], block)[0] - want) < 1e-3 and abs(model.logits([text, "", text], block)[2] - want) < 1e-3


def test_subword_average_as_scalars():
    model = langid.SubwordSoftmax(["a", "b", "c"], seed=2)
    rng = np.random.default_rng(1)
    model.bias[:] = [0.1, -0.2, 0.3]
    model.temperature, model.reject_below = 0.7, 0.4
    text, grams = "Zwölf Boxkämpfer jagen", []
    raw = text.lower().encode()
    for n in langid.GRAMS:
        for i in range(len(raw) - n + 1):
            h = raw[i]
            for b in raw[i + 1:i + n]:
                h = (h * 0x01000193 ^ b) & 0xFFFFFFFF
            grams.append(((h + n) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BUCKETS.bit_length() + 1))
    z = (np.mean([model.emb[g].astype(float) for g in grams], axis=0) @ model.out + model.bias) / 0.7
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    lang, score = model.finish().predict(text)
    assert lang == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-5
    assert model.predict(text, block=7) == pytest.approx((lang, score)) or model.predict(text, block=7)[0] == lang
    assert rng is not None and model.predict("1234 ?") == ("und", 0.0)


def test_calibration_and_rejection():
    rng = np.random.default_rng(4)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"]}
    texts, labels = [], []
    for _ in range(200):
        lang = "xy"[rng.integers(2)]
        texts.append(" ".join(rng.choice(words[lang], 20)))
        labels.append(lang)
    noise = [" ".join(rng.choice(words["x"] + words["y"], 20)) for _ in range(100)]  # no text to be sure of
    model = langid.SubwordSoftmax(["x", "y"])
    model.fit(texts + noise, labels + ["xy"[rng.integers(2)] for _ in noise])
    model.finish()
    sure, unsure = [model.predict(t)[1] for t in texts], [model.predict(t)[1] for t in noise]
    assert np.mean(sure) > 0.95 and 0 < model.reject_below <= 1 and np.mean(np.array(sure) >= model.reject_below) > 0.9
    assert np.mean(np.array(unsure) < model.reject_below) > 0.5
    tie = langid.SubwordSoftmax(["p", "q"])
    tie.emb[:], tie.bias[:] = 0, 0
    assert tie.finish().predict("any words") == ("p", 0.5)


@needs_tables
def test_fitted_models_on_awkward_rows(awkward, tables):
    docs, labels = tables("documents"), tables("labels")
    for rows in (quality.score_quality(awkward, quality.train(docs, labels)), toxicity.score_toxicity(awkward, toxicity.train(docs, labels))):
        got = rows.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (1, 5)}) == 1
    got = langid.identify(awkward, langid.train(docs)).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4, 9)} == {"und"} and all(r["lang_pred"] != "und" for r in got if r["doc_id"] in (1, 5, 6, 7, 8, None))


def test_held_out_languages(tables):
    docs = tables("documents")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


@needs_tables
def test_held_out_labels(tables):
    docs, labels = tables("documents"), tables("labels")
    q = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    t = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in q]) > 0.75 and np.mean([r["predicted"] == r["toxic"] for r in t]) > 0.8


def test_training_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels).shift == 0.0
    assert labels.where(crc_mod("doc_id", 3) != 1).count() == 0


def test_toxicity_is_learned_from_every_labelled_row(spark):
    rng = np.random.default_rng(4)
    plain = ["the", "river", "stone", "garden", "window", "letter", "summer", "bottle", "school", "good"]
    text = lambda i, *extra: " ".join([*rng.choice(plain, 12), f"x{i}y", *extra])
    rows = [(i, text(i, ("idiot", "st-u-p1d", "m0ron")[i % 3]) if i % 2 else text(i), i % 2) for i in range(5000)]
    rows += [(i, text(i, *["river"] * 4000, "clown"), 1) for i in range(5000, 5080)]  # longer than 20,000 characters
    rows += [(5080 + i, rows[1][1], 1) for i in range(50)] + [(5130, None, 0), (5131, "", 0)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = [(t or "", y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert min(Counter(y for _, y in set(used)).values()) > 1500
    model, whole = toxicity.train(docs, labels), toxicity.learn(used, Counter(y for _, y in used))
    assert model.weights == whole.weights and set(model.weights) >= {"idiot", "clown"} and np.allclose(model.beta, whole.beta) and model.characters.logp == whole.characters.logp
    n, toxic = Counter(y for _, y in set(used)), {t for t, y in used if "clown" in t.split()}
    assert math.isclose(model.weights["clown"], math.log((len(toxic) + 0.5) / (n[1] + 1) / (0.5 / (n[0] + 1))))
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in got) and len(got) == len(rows)


def test_words_told_before_decoding_show_no_entry():
    rng = random.Random(3)
    words = ["idiot", "stupid", "loser", "moron", "f*ool"]
    model = toxicity.ToxicityModel(toxicity.CharacterModel(Counter(dict.fromkeys([*words, "there", "is"], 50))), {w: 1.0 for w in [*words, "sill-", "ass-"]}, np.zeros(5))
    shown = model.shown
    for _ in range(6000):
        word = list(rng.choice([*words, "silly", "assume"]))
        for _ in range(rng.randint(0, 5)):
            word.insert(rng.randrange(len(word) + 1), rng.choice("aeilost01345679$@!|+(*._-~'/#%&·") * rng.randint(1, 3))
        word = "".join(word)
        every = {i for w in model.originals(word) for i in shown.of(w)}
        assert every == {i for w in model.originals(word, shown) for i in shown.of(w)}, word
        run = " ".join(word)
        assert shown.within("".join(run.split())) or not any(shown.of(w) for w in model.spelled(run)), run


# pipeline --------------------------------------------------------------------------------------------------------------

@needs_tables
def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "minhash_near_dedup", "pii", "best_fit_packing"]
    docs, sizes = tables("documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        if name == "minhash_near_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            order = sorted(texts)
            classes = brute_classes([texts[i] for i in order])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({order[c] for c in classes})
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * tables("documents").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


@pytest.mark.parametrize("labelled", [False, True])
def test_pipeline_on_awkward_tables(spark, awkward, library, tmp_path, labelled):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(9000))
    more = [(100 + i, f"good text number {i} about gardens rivers and stones", "en", "s", 1, 0.5, "p", "q") for i in range(30)] + [(200, long, "en", "s", 1, 0.5, "p", "q"), (201, long + " end", "en", "s", 1, 0.5, "p", "q")]
    docs = awkward.unionByName(awkward.where("doc_id = 7")).union(spark.createDataFrame(more, awkward.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(100 + i, 1, 0) for i in range(30)] + [(None, 0, 1), (100, None, None)] if labelled else []
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # exact copies, and 201 beside 200, go; the short texts differ in a word of seven; nothing is toxic or of low quality
    kept = sorted([1, 2, 6, 7, 8, 2**62, *range(100, 130), 200])
    assert sorted({r["doc_id"] for r in got if r["doc_id"] is not None}) == kept and any(r["doc_id"] is None for r in got)
    texts = {i: t for i, t, *_ in [*AWKWARD, *more]}
    sizes, bins = Counter(), defaultdict(list)
    for r in got:
        sizes[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sizes[i] == len(ids_of(library, texts[i])) + 1 for i in kept)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    empty = tmp_path / "empty"
    spark.createDataFrame([], awkward.schema).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_equal_rows_are_dealt_out(spark):
    rows = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string")
    pieces = packing.materialize(packing.cut_pieces(rows.coalesce(1)), "pieces")
    assert pieces.select("salt").distinct().count() == packing.SALTS
    placed = packing.place_pieces(pieces, 4096).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 3000 and len({r["sequence_id"] for r in placed}) == 1


@needs_tables
def test_packing_reaches_the_lower_bound(spark, tables):
    rows = packing.pack_documents(tables("documents")).collect()
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(r["length"] for r in rows) / 4096) * 1.01 + 1
