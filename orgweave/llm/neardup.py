"""Near-duplicate documents by DartMinHash signatures, banding, exact checks and connected components.

1. Words are the lower-cased runs of ASCII letters, digits and non-ASCII characters; a document's elements are its hashed
   five-word shingles (one shingle of all words, if fewer), weighted by their occurrences. Documents of equal word sequences are one text,
   known by the digest of its words, and get a number of their own.
2. DartMinHash: each element's region, weight by rank, is cut into cells of area one; hashes throw a Poisson(1) number of darts
   into each, with a place, a rank and one of k coordinates. About k ln k + 2k darts of lowest rank are enough that each
   coordinate holds one; its earliest dart is the coordinate's value. Two signatures agree in a coordinate with the probability of
   their weighted Jaccard similarity. Where a coordinate stays empty, more darts are thrown.
3. Texts that agree in all rows of a band share a bucket. In each bucket every text is paired with one hub, never with all
   others, and pairs are checked exactly on the shingles. Further rounds pair the texts of a bucket whose components still differ,
   with hubs drawn anew in each bucket, while a round links a hundredth of its pairs or more.
4. Buckets that then still hold several components are finished by an exact prefix filter over their texts: with the rarest shingles
   first, two texts of enough similarity share one early enough in both, so all pairs that can be near are joined by it and checked.
5. Components of the links are the classes. They are found by hanging neighbours on the least of them, and links found later are followed only between
   components that are still apart.

With 24 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 7e-5. Hashes and links stay in Spark: hubs and
labels are map-side-combined minima, and joins on a hot bucket or text are joins that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, free_name, held, map_texts, materialize

BANDS, ROWS, WORDS, SIMILARITY = 24, 5, 5, 0.8
#: The keys of the texts that are checked are broadcast up to so many bytes; beyond, the texts are shuffled to them.
BROADCAST_BYTES = 16 << 20
#: Rounds of hubs go on while more than one in so many pairs is near; what they leave is found exactly all the same.
YIELD = 100
_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
#: Chances that a Poisson(1) count is at most 0, 1, 2, ... on the scale of 32 bits.
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]) * 2**32).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, kept for blocks of the usual size."""
    if n > 2 << 20:
        return _powers(n, int(_P)), _powers(n, pow(int(_P), -1, 2**64))
    up, down = held("powers", lambda: (_powers(2 << 20, int(_P)), _powers(2 << 20, pow(int(_P), -1, 2**64))))
    return up[:n], down[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, number of words of each text)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * _Q)
    firsts = np.cumsum([0, *(len(b) + 1 for b in raw)])
    return hashes, np.diff(np.searchsorted(starts, firsts))


def shingles(texts: list[str], width: int = WORDS, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of all texts, ordered by text and hash: (hash, text number, weight, digest of each text's words).

    The weight is 1, or the shingle's number of occurrences if ``weighted``.
    """
    words, counts = word_hashes(texts)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(firsts, firsts[1:])]
    owner = np.repeat(np.arange(len(texts)), counts)
    h = words.copy()
    for j in range(1, width):
        h = h * _Q
        h[:-j or None] += words[j:]
    left = np.repeat(firsts[1:], counts) - np.arange(len(words))
    h = h[left >= width]
    owner = owner[left >= width]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int.from_bytes(digests[i][:8], "little") for i in short], dtype=np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h))).astype(np.float64) if weighted else np.ones(len(at))
    return h[at], owner[at], weight, digests


def dart_minhash(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, k: int, darts: float = 0.0) -> np.ndarray:
    """Signatures (n x k of 64-bit darts) of n weighted sets; a set without elements has zeros."""
    out = np.zeros((n, k), dtype=np.uint64)
    if not len(elements):
        return out
    darts = darts or k * math.log(k) + 2 * k
    total = np.bincount(owner, weight, n)
    limit = darts / np.maximum(total, 1e-12)
    ranks = np.ceil(limit).astype(np.int64)[owner]
    cells = ranks * np.ceil(weight).astype(np.int64)
    i = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(i)) - np.repeat(np.cumsum(cells) - cells, cells)
    row, column = cell % ranks[i], cell // ranks[i]
    g = mix(elements[i] ^ mix(row.astype(np.uint64) * _Q + column.astype(np.uint64) * _P + np.uint64(1)))
    thrown = np.searchsorted(_POISSON, g >> np.uint64(32), side="right")
    d = np.repeat(np.arange(len(i)), thrown)
    nth = np.arange(len(d)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    dart = mix(g[d] + (nth.astype(np.uint64) + np.uint64(1)) * _P)
    place = mix(dart ^ _Q)
    rank = row[d] + (dart >> np.uint64(32)).astype(np.float64) / 2**32
    set_of = owner[i[d]]
    ok = (rank <= limit[set_of]) & (column[d] + (place >> np.uint64(32)).astype(np.float64) / 2**32 < weight[i[d]])
    dart, rank, key = dart[ok], rank[ok], set_of[ok] * k + (place[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
    order = np.lexsort((rank, key))
    key, dart = key[order], dart[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    out.reshape(-1)[key[first]] = dart[first]
    filled = np.bincount(key[first] // k, minlength=n)
    again = np.flatnonzero((total > 0) & (filled < k))
    if len(again):
        number = np.full(n, -1)
        number[again] = np.arange(len(again))
        mine = number[owner] >= 0
        out[again] = dart_minhash(elements[mine], number[owner[mine]], weight[mine], len(again), k, darts * 2)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _P, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, mark, key1, key2, bands): a hash of the text as it is, the words' digest, and the buckets (empty for a text without words)."""

    def start():
        def work(texts: list[str]) -> list:
            h, owner, weight, digests = shingles([t or "" for t in texts], weighted=weighted)
            keys = band_keys(dart_minhash(h, owner, weight, len(texts), bands * rows), bands, rows)
            some = np.bincount(owner, minlength=len(texts)) > 0
            whole = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            buckets = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32), pa.array(keys[some].reshape(-1)))
            return [whole[:, 0].copy(), whole[:, 1].copy(), buckets]

        return work

    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), ["doc_id", "mark"], start, "key1 long, key2 long, bands array<long>", block_chars=1_000_000, least_chars=4_000)


def _shingled(docs: DataFrame, wanted: DataFrame, few: bool, weighted: bool) -> DataFrame:
    """(id, sh): the shingles of the wanted texts (v, key1, key2, rep), as sorted 64-bit hashes (with weights after them, if weighted).

    Rows are chosen by the id that stands for a text and then by the words' digest, so an id that several texts share gives each its own.
    """
    wanted = F.broadcast(wanted) if few else wanted
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def start():
        def work(texts: list[str]) -> list:
            h, owner, weight, digests = shingles([t or "" for t in texts], weighted=weighted)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            whole = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            return [whole[:, 0].copy(), whole[:, 1].copy(), [h[a:b].tobytes() + (weight[a:b].tobytes() if weighted else b"") for a, b in zip(cut, cut[1:])]]

        return work

    made = map_texts(texts, ["doc_id"], start, "of1 long, of2 long, sh binary", block_chars=1_000_000)
    kept = made.join(wanted, (F.col("of1") == F.col("key1")) & (F.col("of2") == F.col("key2"))).select(F.col("v").alias("id"), "sh")
    return kept.groupBy("id").agg(F.min("sh").alias("sh"))


def jaccard(a: bytes, b: bytes, weighted: bool = False) -> float:
    """(Weighted) Jaccard similarity of two texts' shingles."""
    if not weighted:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if not len(x) or not len(y):
            return 0.0
        at = np.searchsorted(x, y)
        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
        return both / (len(x) + len(y) - both)
    half, other = len(a) // 2, len(b) // 2
    if not half or not other:
        return 0.0
    x, y, wx, wy = np.frombuffer(a[:half], np.uint64), np.frombuffer(b[:other], np.uint64), np.frombuffer(a[half:]), np.frombuffer(b[other:])
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = float(np.minimum(wx[at], wy)[x[at] == y].sum())
    return both / (wx.sum() + wy.sum() - both)


def check_pairs(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float, weighted: bool, sh: DataFrame | None = None) -> DataFrame:
    """Those of the written pairs (a, b) of ``texts`` (v, key1, key2, rep) whose similarity is at least ``similarity``; ``sh`` are their shingles, if known."""
    if sh is None:
        ids = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
        wanted = materialize(texts.join(ids, "v", "left_semi"), "wanted")
        sh = materialize(_shingled(docs, wanted, is_small(wanted), weighted), "shingles")
    both = (pairs.join(sh.select(F.col("id").alias("b"), F.col("sh").alias("sh_b")), "b")
            .join(sh.select(F.col("id").alias("a"), F.col("sh").alias("sh_a")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(x, y, weighted) >= similarity for x, y in zip(batch.column("sh_a").to_pylist(), batch.column("sh_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sh_a", "sh_b").mapInArrow(run, f"a {kind}, b {kind}")


def _elements(sh: DataFrame, weighted: bool) -> DataFrame:
    """(id, size, element): the shingles one by one; each occurrence is an element of its own, if weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("sh").to_pylist()
            for a, b in blocks([len(x) for x in column], 4_000_000):
                sets = []
                for x in column[a:b]:
                    h = np.frombuffer(x[:len(x) // 2] if weighted else x, np.uint64)
                    if weighted:
                        counts = np.frombuffer(x[len(x) // 2:]).astype(np.int64)
                        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        h = mix(np.repeat(h, counts) ^ nth.astype(np.uint64) * _P)
                    sets.append(h)
                sizes = np.array([len(h) for h in sets])
                at = pa.array(np.repeat(np.arange(a, b), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64))],
                                                 names=["id", "size", "element"])

    return sh.mapInArrow(run, f"id {sh.schema['id'].dataType.simpleString()}, size int, element long")


def rest_pairs(sh: DataFrame, labels: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """(a, b): every pair of texts of different labels (v, label) whose similarity may be ``similarity``, by an exact prefix filter.

    Elements are ordered by the number of texts that hold them. If the first element that two texts share stands at places p and q, from 0,
    they share at most min(|a| - p, |b| - q), and s (|a| + |b|) / (1 + s) are needed. So the larger text is met by its elements with
    |a| - p >= s |a|, the smaller one by the fewer with |b| - q >= 2 s |b| / (1 + s): what all texts of a template hold stands behind those
    and is not joined among texts of like size. Sizes differ by a factor of s at most, so they are banded and part of the join's key. Of each
    element's texts those of its most frequent label are not joined with each other. A pair that was met stays if what it shares so far and all
    that is left behind the last shared place would be enough.
    """
    elements = _elements(sh, weighted)
    shared = elements.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    ordered = (elements.join(shared, "element").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("all")))
    # elements of one text alone come first and join nothing
    need = F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-6)).cast("int")
    early = ordered.select("id", "size", (F.col("size") - F.size("all")).alias("alone"), F.slice("all", F.lit(1), F.greatest(F.size("all") - need + 1, F.lit(0))).alias("all"))
    placed = early.select("id", "size", "alone", F.posexplode("all").alias("at", "e")).select("id", "size", (F.col("alone") + F.col("at")).alias("at"), "e.element")
    placed = materialize(placed.join(labels.withColumnRenamed("v", "id"), "id"), "prefixes")
    counts = placed.groupBy("element", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("element").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("element", F.col("most.label").alias("most"))
    scale = F.log("size") / F.lit(math.log(max(1 / similarity, 1.05)))
    live = placed.join(most, "element").withColumn("scale", scale)
    larger = live.withColumn("band", F.explode(F.sequence(F.floor(F.col("scale") - F.lit(1 + 1e-9)), F.floor("scale")))).alias("x")
    smaller = (live.where((F.col("size") - F.col("at")) * F.lit(1 + similarity) >= F.col("size") * F.lit(2 * similarity) - F.lit(1e-6))
               .withColumn("band", F.floor("scale")).alias("y"))
    needed = (F.col("x.size") + F.col("y.size")) * F.lit(similarity) - F.lit(1e-6)
    fits = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) * F.lit(1 + similarity) >= needed
    turned = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") > F.col("y.id")))
    equal = (F.col("x.element") == F.col("y.element")) & (F.col("x.band") == F.col("y.band"))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(y, equal & (F.col("x.label") != F.col("y.label")) & turned & fits)
        return both.select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")).alias("left"), needed.alias("needed"))

    met = meet(larger.where("label <> most"), smaller).unionByName(meet(larger.where("label = most"), smaller.where("label <> most")))
    # places and so what is left fall together: the least of what is left is that of the last shared place, which counts itself
    enough = met.groupBy("id", "other").agg(F.count("*").alias("n"), F.min("left").alias("left"), F.first("needed").alias("needed")).where((F.col("n") - 1 + F.col("left")) * F.lit(1 + similarity) >= F.col("needed"))
    return enough.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(v, label): of each vertex of the links (a, b) the smallest vertex that it is connected with.

    An edge leads from its larger end u to its smaller one v. Each round first hangs a vertex's smaller neighbours and the vertex itself on the
    least of them, then each edge's larger end on the least neighbour of its smaller one, until all edges lead to roots. Either step keeps what is connected and
    makes no more edges than there were: a text that is linked with many hubs links these with each other once, and from then on there are about as many edges
    as vertices. The rounds are few, as many as the squared logarithm of the vertices at worst; edges are written to the shared folder after each step.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("least"))
        others = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        hung = materialize(least.select("u", F.col("least").alias("v")).unionByName(others).distinct(), "edges")
        discard(edges)
        above = hung.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("v"), "least")
        moved = hung.join(above, "v", "left").select("u", F.coalesce("least", "v").alias("v"), F.col("least").isNotNull().alias("moved"))
        edges = materialize(moved.groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
        discard(hung)
        n, starts, moving = edges.agg(F.count("*"), F.count_distinct("u"), F.max("moved")).first()
        edges, written = edges.select("u", "v"), edges
        edges.written_to = written.written_to
        if n == starts and not moving:
            labels = materialize(edges.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(edges.select("v", F.col("v").alias("label")).distinct()), "labels")
            discard(edges)
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (v, label) of ``components`` once further links (a, b) are there: only links between different labels are followed, as edges between the labels."""
    of = lambda end: labels.select(F.col("v").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    tops = components(ends.where("a <> b"))
    every = labels.unionByName(tops.select("v", F.col("v").alias("label"))).distinct()
    out = materialize(every.join(tops.select(F.col("v").alias("label"), F.col("label").alias("top")), "label", "left").select("v", F.coalesce("top", "label").alias("label")), "labels")
    discard(tops)
    return out


def is_small(wanted: DataFrame) -> bool:
    """Whether texts' keys may be broadcast: a bound on their bytes, with ids of any type."""
    size = F.lit(48) + F.coalesce(F.length(F.col("rep").cast("string")), F.lit(0))
    return (wanted.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def classified(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(doc_id, mark, v, class_id) for every row of ``docs``: a hash of its text, its class's number, and the smallest id of the class.

    An element's region is as wide as the number of its occurrences, or 1 with ``weighted=False``; the similarity is the Jaccard similarity of
    the weighted sets. Null texts count as empty, and texts without words are one text. Repeated rows give equal rows. Texts, not ids, are
    linked: different texts with one id are each linked with their own copies. A row with a null id has the class of its copies, or null if
    none of them has an id. Other columns are not carried; an empty table gives no rows.
    """
    sig = materialize(signatures(docs, bands, rows, weighted), "signatures")
    one = sig.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    # a text's number: it is written once, so it is the same for all who read it
    numbered = materialize(one.withColumn("v", F.monotonically_increasing_id()), "texts")
    texts = numbered.select("v", "key1", "key2", "rep")
    buckets = materialize(numbered.select("v", F.explode("bands").alias("bucket")), "buckets")
    shared = buckets.groupBy("bucket").agg(F.min("v").alias("a"), F.max("v").alias("last")).where("a < last").select("bucket", "a")
    pairs = materialize(buckets.join(shared, "bucket").where("v <> a").select("a", F.col("v").alias("b")).distinct(), "pairs")
    links = materialize(check_pairs(docs, texts, pairs, similarity, weighted), "links")
    labels = components(links)
    turn = 0
    live = buckets.join(shared.select("bucket"), "bucket")
    while True:
        turn += 1
        # texts of a bucket that are not yet connected, against a hub drawn for this bucket and round
        named = live.join(labels, "v", "left").select("bucket", "v", F.coalesce("label", "v").alias("label"))
        drawn = F.struct(F.xxhash64("v", "bucket", F.lit(turn)).alias("order"), F.col("v").alias("a"), F.col("label").alias("of"))
        hubs = named.groupBy("bucket").agg(F.min(drawn).alias("hub"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket", "hub.a", "hub.of")
        pairs = materialize(named.join(hubs, "bucket").where("label <> of").select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct(), "pairs")
        new = materialize(check_pairs(docs, texts, pairs, similarity, weighted), "links")
        met, found = pairs.count(), new.count()
        if found:
            before, labels = labels, relabelled(labels, new)
            discard(before)
        if found * YIELD <= met:
            break
    # buckets whose texts are still of several components: every pair that can be near
    named = live.join(labels, "v", "left").select("bucket", "v", F.coalesce("label", "v").alias("label"))
    apart = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    rest = materialize(named.join(apart, "bucket").select("v", "label").distinct(), "rest")
    if not rest.isEmpty():
        wanted = materialize(texts.join(rest, "v", "left_semi"), "wanted")
        sh = materialize(_shingled(docs, wanted, is_small(wanted), weighted), "shingles")
        near = check_pairs(docs, texts, materialize(rest_pairs(sh, rest, similarity, weighted), "pairs"), similarity, weighted, sh)
        labels = relabelled(labels, materialize(near, "links"))
    smallest = labels.join(texts.select("v", "rep"), "v").groupBy("label").agg(F.min("rep").alias("class_id"))
    linked = labels.join(smallest, "label").select("v", "label", "class_id")
    classes = texts.join(linked, "v", "left").select("key1", "key2", F.coalesce("label", "v").alias("v"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"))
    return sig.select("doc_id", "mark", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "mark", "v", "class_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: the smallest id of its class of near duplicates, as ``classified`` tells."""
    return classified(docs, similarity, bands, rows, weighted).select("doc_id", "class_id")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class of ``classified`` one row, all columns: the one with the smallest id (without an id only where the class has none).

    Rows of one id and one text are equal here; any of them stays. Only where there are several are texts shuffled to find that one.
    """
    doc, mark, n = (free_name(docs, x) for x in ("doc", "mark", "n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    counted = classes.groupBy("v", "doc_id", "mark").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("v").agg(F.min_by(F.struct("doc_id", "mark", "n"), place).alias("c")).select(F.col("c.doc_id").alias(doc), F.col("c.mark").alias(mark), F.col("c.n").alias(n))
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)))
    several = kept.where(F.col(n) > 1).dropDuplicates([doc, mark])
    return kept.where(F.col(n) == 1).unionByName(several).select(*docs.columns)
