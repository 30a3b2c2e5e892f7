"""Alignment of two tokenizers over the same texts: which tokens of one lie over which of the other.

A text's tokens of either side end at byte offsets that add up. A merge of both sorted lists of ends, with a pointer into each, gives the links (pairs of
tokens whose bytes overlap) and the groups (what lies between offsets where both sides end). It runs inside ``mapInPandas``, with numpy, for many texts
at a time. Neither tokenizer has a token that runs over a space behind a character other than white space, so a text is cut there into units, whose
tokens don't depend on what stands around them; a task tokenizes and merges each distinct unit once and keeps it in a bounded cache.

Spark counts in how many documents each pair of ids is linked, takes each side's maximum over an id's pairs, and joins both back to the
documents' links. Pairs that many documents have are sent to all tasks: those in at least total / HOT documents are HOT at most, whatever the corpus holds.
So no frequent pair is shuffled; the others, whose numbers are small, are joined by their ids.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Recent
from .common import blocks, give_back, held, materialize

#: Pairs that are sent to all tasks, at most.
HOT = 300_000
#: Characters of a block of texts, characters of a unit that is kept, and units kept in a Python worker.
_BLOCK_CHARS, _KEPT_CHARS, _KEPT_UNITS = 1_500_000, 64, 240_000
#: White space that begins with another character than a space is within a unit.
_UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lists of ends, which rise to the same last one, merged: of each end the token of A and of B that it falls into, and whether both end there.

    Between two ends of the merged list lie parts of one token of either side, and every pair that overlaps does so between just two of them. So the
    merged list's entries are the links, and those where both end are the groups' ends.
    """
    merged = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, merged), np.searchsorted(ends_b, merged)
    return at_a, at_b, ends_a[at_a] == ends_b[at_b]


class Aligner:
    """Tokens, links and groups of units: (tokens of A, tokens of B, number of groups, groups as text, links as 64-bit pairs), None where a side's bytes differ."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if self.a.normalizer is not None or not isinstance(self.a.pre_tokenizer, ByteLevel) or any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("units need a byte-level tokenizer without normalizer, and pieces that have spaces at their beginning alone")
        shown = {c: b for b, c in _byte_letters().items()}
        self.bytes_a = [bytes(shown.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, parts), np.int64, len(parts)) for parts in (self.bytes_a, self.bytes_b))
        self.decimal = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.space = [self.b.piece_to_id("▁")]
        self.kept = Recent(_KEPT_UNITS)

    def units(self, wanted: set[str]) -> dict[str, tuple | None]:
        """What is known of the wanted units; the new ones are tokenized and merged together."""
        get, out = self.kept.get, {}
        for u in wanted:
            out[u] = get(u)
        new = [u for u, made in out.items() if made is None]
        ids_a, raw = self._tokens_a(new)
        # the processor adds a space before a text, and gives none for an empty one
        ids_b = [ids or self.space for ids in self.b.encode([u[1:] for u in new], num_threads=1)]
        # bytes are what A's tokens are made of, so they are the unit's; B's may differ
        spelled = self.bytes_b.__getitem__
        good = [i for i, ids in enumerate(ids_b) if b"".join(map(spelled, ids)) == raw[i]]
        made = self._merged([new[i] for i in good], [ids_a[i] for i in good], [ids_b[i] for i in good])
        out.update(made)
        for u, entry in made.items():
            if len(u) <= _KEPT_CHARS:
                self.kept.put(u, entry)
        return out

    def _tokens_a(self, units: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """The ids and the bytes of each unit. Units without white space at their end are tokenized as one text, which is cut into just these units."""
        raw, together = [u.encode() for u in units], [i for i, u in enumerate(units) if not u[-1].isspace()]
        out: list[list[int]] = [[]] * len(units)
        if together:
            ids = self.a.encode_batch_fast(["".join([units[i] for i in together])], add_special_tokens=False)[0].ids
            sizes = np.fromiter((len(raw[i]) for i in together), np.int64, len(together))
            start = 0
            for i, end in zip(together, (np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum(sizes)) + 1).tolist()):
                out[i] = ids[start:end]
                start = end
        alone = [i for i, u in enumerate(units) if u[-1].isspace()]
        for i, e in zip(alone, self.a.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        return out, raw

    def _merged(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> dict[str, tuple]:
        """One merge for all units, one behind the other: every unit's end is an end of both sides."""
        if not units:
            return {}
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(units)) for ids in (a, b))
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ids_a, ids_b = np.array(flat_a), np.array(flat_b)
        at_a, at_b, both = merge_ends(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        raw = (ids_a[at_a] << 32 | ids_b[at_b]).astype(np.int64).tobytes()
        ends_a, ends_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
        said_a, said_b = list(map(self.decimal.__getitem__, flat_a)), list(map(self.decimal.__getitem__, flat_b))
        groups = [f"{said_a[i] if x - i == 1 else ','.join(said_a[i:x])}|{said_b[j] if y - j == 1 else ','.join(said_b[j:y])}"
                  for i, x, j, y in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]
        last = np.cumsum(n_a) - 1  # of each unit the last token, hence its last link and group
        links_end = (np.searchsorted(at_a, last, side="right") * 8).tolist()
        groups_end = (np.searchsorted(at_a[both], last, side="right")).tolist()
        return {u: (x, y, f - e, ";".join(groups[e:f]), raw[k:m]) for u, x, y, e, f, k, m in
                zip(units, n_a.tolist(), n_b.tolist(), [0, *groups_end], groups_end, [0, *links_end], links_end)}

    def align(self, texts: list[str], digest: bool) -> dict[str, list | np.ndarray]:
        """The columns of ``aligned`` for a block of texts."""
        cut = [_UNIT.findall(" " + t) if t else [] for t in texts]
        known = self.units(set(chain.from_iterable(cut)))
        made = [m for m in known.values() if m is not None]
        number = dict.fromkeys(known, -1) | {u: i for i, u in enumerate(u for u, m in known.items() if m is not None)}
        of = np.repeat(np.arange(len(cut)), list(map(len, cut)))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, len(of))
        whole = np.bincount(of[at < 0], minlength=len(cut))[of] == 0  # a text with one unit that can't be restored has no tokens
        of, at = of[whole], at[whole]
        size_a, size_b, size_groups = (np.fromiter((m[k] for m in made), np.int64, len(made)) for k in range(3))
        flat = np.frombuffer(b"".join([m[4] for m in made]), dtype=np.int64)
        n_links = np.fromiter((len(m[4]) for m in made), np.int64, len(made)) >> 3
        first = np.cumsum(n_links) - n_links
        total = lambda sizes: np.bincount(of, weights=sizes[at], minlength=len(cut)).astype(np.int64)
        columns: dict = {"n_a": total(size_a), "n_b": total(size_b), "n_groups": total(size_groups), "n_links": total(n_links)}
        said, order = [m[3] for m in made].__getitem__, at.tolist()
        ends = np.searchsorted(of, np.arange(len(cut)), side="right").tolist()
        groups = (";".join(map(said, order[x:y])) for x, y in zip([0, *ends], ends))
        columns["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else list(groups)
        # a document's units with how often it has each, then its pairs with how often they are linked there; pairs go by their number in the block
        own, times = np.unique(of * len(made) + at, return_counts=True)
        doc, unit = np.divmod(own, max(len(made), 1))
        sizes = n_links[unit]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs, place = np.unique(flat, return_inverse=True)
        key = np.repeat(doc * len(pairs), sizes) + place[np.repeat(first[unit], sizes) + within]
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, sizes)[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, new) if len(new) else times
        doc, place = np.divmod(key[new], max(len(pairs), 1))
        pair, cuts = pairs[place], np.searchsorted(doc, np.arange(1, len(cut)))
        for name, values in (("a", pair >> 32), ("b", pair & 0xFFFFFFFF), ("times", times)):
            columns[name] = np.split(values.astype(np.int32), cuts) if len(cut) else []
        return columns


def _byte_letters() -> dict[int, str]:
    """The letters in which byte-level tokens spell bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(shown)))}


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, times) for every whole text; written, as it is read several times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (with ``digest``: its SHA-256 in hexadecimal). ``a``, ``b`` and ``times`` are the distinct linked pairs and how often each is linked in the text.
    Texts that are null or empty, or whose joined tokens of a side are other bytes than a space and the text, have no tokens: zeros and the empty text.
    """
    default = default_paths()
    paths = path_a or default[0], path_b or default[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = held(f"aligner {paths}", lambda: Aligner(*paths))
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            for x, y in blocks(list(map(len, texts)), _BLOCK_CHARS):
                columns = aligner.align(texts[x:y], digest)
                yield pd.DataFrame({"row": frame["row"].to_numpy()[x:y], "id": frame["id"].to_numpy()[x:y], **columns})
        give_back()

    kind = docs.schema[id_col].dataType
    # the id goes as text, as pandas would make a long with nulls a double
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = rows.mapInPandas(run, "row long, id string, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>")
    return materialize(made.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", "doc_id"), "aligned")


def _links(texts: DataFrame) -> DataFrame:
    return texts.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select("row", "l.a", "l.b", "l.times")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, docs, best_a, best_b) of ``aligned`` texts: how many documents have a pair linked, and whether that is the most of any pair of its id of A, of B; written."""
    counts = materialize(_links(texts).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    most = {side: counts.groupBy(side).agg(F.max("docs").alias(f"most_{side}")) for side in "ab"}
    return materialize(counts.join(most["a"], "a").join(most["b"], "b").select("a", "b", "docs", (F.col("docs") == F.col("most_a")).alias("best_a"), (F.col("docs") == F.col("most_b")).alias("best_b")), "pair-counts")


def score_links(texts: DataFrame, pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, n_best, count_sum): of each text's links, those whose pair is the best of its id of A, and the sum of the pairs' counts."""
    total = pairs.agg(F.sum("docs")).first()[0] or 0
    is_hot = F.col("docs") >= math.ceil((total + 1) / hot)  # a sum of this many parts at least has no more than ``hot`` of them
    links, scored = _links(texts), pairs.select("a", "b", "docs", "best_a")
    frequent = F.broadcast(scored.where(is_hot))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    found = sums(links.join(frequent, ["a", "b"])), sums(links.join(frequent, ["a", "b"], "left_anti").join(scored.where(~is_hot), ["a", "b"]))
    return found[0].unionAll(found[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document; see ``aligned`` and ``score_links``.

    Null, empty and not restorable texts have zeros; repeated rows each give a row and each count; null ids are kept; other columns are
    not carried, so their names can't clash; an empty table gives no rows.
    """
    texts = aligned(docs, path_a, path_b, id_col, text_col, digest)
    found = score_links(texts, pair_counts(texts))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.drop("a", "b", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
