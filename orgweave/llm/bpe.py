"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks whose places depend on nearby content alone, so a
passage that occurs in many documents gives the same chunks in all of them. A task encodes each distinct chunk once and
keeps it in a bounded cache, which its Python worker carries over to later tasks. A chunk by itself is wrong only near its edges,
where a word may run over them. So every join of two chunks is repaired: the words around it are encoded anew by the library, as one window,
and what the window says of the words that lie whole within a chunk must be what the chunk says of them, on both sides. Where it is not, the window is widened,
and in the end it is the whole text. Windows repeat as chunks do and are kept as well.

Decoding puts the texts of the same pieces together. The vocabulary file is given by path and read by each worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_texts

#: Python's str.split also cuts at these, which the tokenizer doesn't take for white space.
_ODD = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t\n\r\f\v]+")
_WORD = re.compile("[^ \t\n\r\f\v]+")
_BASE = 0x9E3779B1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(text: str, mean: int = 256, longest: int = 4096) -> list[int]:
    """Ends of the content-defined chunks of ``text``: where the hash of the 16 characters before is 0 modulo
    ``mean`` (a power of two); gaps over ``longest`` are cut evenly from their start."""
    if not text:
        return []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint32)
    power, width = np.uint32(_BASE), 1
    while width < 16 and len(h) > width:
        h[width:] = h[width:] + h[:-width] * power
        with np.errstate(over="ignore"):
            power = np.uint32((int(power) * int(power)) & 0xFFFFFFFF)
        width *= 2
    ends = np.flatnonzero(((h >> np.uint32(11)) & np.uint32(mean - 1)) == 0) + 1
    out, last = [], 0
    for end in [*ends.tolist(), len(text)]:
        while end - last > longest:
            last += longest
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


#: The alphabet in which byte-level merges spell bytes: printable ones are themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}

#: The same for words with single spaces between them.
_SPELLED = {ord(chr(b)): c for b, c in _BYTES.items() if b != 32}

#: Marks that end a word and can't be part of a special token or a contraction.
_MARKS = ".,!?;:*#%&$)"

#: Latin and Cyrillic letters whose lower case is one letter, and which the normalizer leaves as they are otherwise.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ]+"

#: Words that are spelled in one call of the library, and bytes up to which a word is kept.
TOGETHER, KEPT_BYTES = 4096, 64


def _stays_letters(word: str) -> bool:
    """Whether all of a word are letters, also after the normalizer; a few letters become a letter and a mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


#: Words of a chunk that a window takes in first, and words that a chunk has at least where it is joined.
WINDOW, LEAST_WORDS = 2, 12


class Recent:
    """The entries used last, at most ``most``: when the newer half is full it becomes the older half, and what is used again moves back."""

    def __init__(self, most: int) -> None:
        self.half, self.new, self.old = max(1, most // 2), {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``first``, one behind the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Cores:
    """Distinct words with their ids, in a few arrays: word ``i`` has ``size[i]`` ids from ``first[i]`` on."""

    def __init__(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.words, self.ids, self.size, self.first = words, ids, size, np.cumsum(size) - size

    @staticmethod
    def joined(some: list[Cores]) -> Cores:
        return Cores(pa.concat_arrays([c.words for c in some]), np.concatenate([c.ids for c in some]), np.concatenate([c.size for c in some]))

    def only(self, mask: np.ndarray) -> Cores:
        return Cores(self.words.filter(pa.array(mask)), gathered(self.ids, self.first[mask], self.size[mask]), self.size[mask])


class ChunkEncoder:
    """Encodes texts as the tokenizers library does, without special tokens, truncation or padding.

    Words, chunks, windows and pieces' texts are kept up to a number of entries each, so memory is bounded.
    """

    def __init__(self, path: str, words: int = 450_000, chunks: int = 30_000, windows: int = 60_000, cores: int = 300_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        if spec.get("decoder") is not None or '"behavior": "Removed"' not in pre or "[^\\\\s\\\\p{L}\\\\p{N}]+" not in pre:
            raise ValueError("chunk reuse needs a tokenizer that drops white space before its merges")
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        suffix = spec["model"].get("end_of_word_suffix") or "</w>"
        del spec  # it is as large as the tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same merges, held once, without normalizer, mark splitting and byte mapping, for words that are given as those would leave them
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.word_ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.chunks, self.windows, self.texts = Recent(chunks), Recent(windows), Recent(chunks + windows)
        self.most_words = words
        self.cores, self.most_cores = Cores(pa.array([], pa.large_string()), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)), cores
        #: Whether words of letters and closing marks are sure not to hold an added token.
        self.lettered = not any(re.fullmatch(f"(?:{_LETTERS})?[{_MARKS}]*", t) for t in self.added)
        #: Joins repaired, those whose window had to be widened, and texts that had to be encoded whole.
        self.joins = self.widened = self.whole = 0
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        #: Of each id its decimal text and its token, as decoding shows it; an id without a token is left out there.
        self.decimal = [str(i) for i in range(len(self.ends_word))]
        self.token = [self.tokenizer.id_to_token(i) for i in range(len(self.ends_word))]

    def learn(self, words: set[str]) -> None:
        """Have the ids of all ``words`` at hand. Those unknown are encoded in one call to the library.

        The tokenizer lower-cases and parts letters from marks itself, so an ASCII word without an added token has the ids of its lower case, and one of
        letters and closing marks those of its two parts. When the newer half of the cache is full it becomes the older half; what is used again moves back.
        """
        new = words.difference(self.word_ids)
        if len(self.word_ids) + len(new) > self.most_words // 2 and self.word_ids:
            self.older, self.word_ids, new = self.word_ids, {}, words
            if len(self.marks) > 10_000:
                self.marks = {}
        known, kept = self.word_ids, self.older.get
        made: list[tuple[str, str, str]] = []
        ask: set[str] = set()
        plain: set[str] = set()  # of them, letters that the normalizer leaves as they are
        for word in new:
            ids = kept(word)
            if ids is not None:
                known[word] = ids
                continue
            core, mark = word, ""
            if word[-1] in _MARKS:
                head = word.rstrip(_MARKS)
                if _stays_letters(head):
                    core, mark = head, word[len(head):]
                    if mark not in self.marks:
                        self.marks[mark] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
            if core.isascii():
                # added tokens are found before letters are made small, so a word that only then would hold one stays as it is
                small = core.lower()
                if not any(t in small for t in self.added):
                    core = small
            elif core.isalpha() and "Σ" not in core:
                lower = unicodedata.normalize("NFC", core).lower()
                if lower.isalpha() and unicodedata.is_normalized("NFC", lower):
                    core = lower
                    plain.add(core)
            if core != word:
                made.append((word, core, mark))
            if core not in known:
                ids = kept(core)
                if ids is None:
                    ask.add(core)
                else:
                    known[core] = ids
        plain &= ask
        plain.update(w for w in ask if w.isascii() and w.isalpha())
        others = list(ask.difference(plain) if self._together(list(plain)) else ask)
        for word, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[word] = array("I", e.ids).tobytes()
        for word, core, mark in made:
            known[word] = known[core] + self.marks[mark] if mark else known[core]

    def _together(self, words: list[str]) -> bool:
        """Encode lower-case words of letters as one text, and part its ids where a word ends. False if the ends don't match the words.

        Such a word is one piece for the merges, spelled in the byte alphabet; so the merges alone are enough.
        """
        if not words:
            return True
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in words]
        ids = np.array(self.bare.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return False
        raw = ids.tobytes()
        self.word_ids.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        return True

    @staticmethod
    def words_of(text: str, odd: bool) -> list[str]:
        return [w for w in _ASCII_SPACE.split(text) if w] if odd else text.split()

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, by reuse of words only.

        Arrow splits the texts, numbers their distinct words, parts closing marks from letters and makes these small; so few words are looked up and
        none is taken up by Python but those that are neither. numpy lays out the ids: of each distinct word, then of each word.
        """
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary
        heads = pc.ascii_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.match_substring_regex(heads, f"^{_LETTERS}$"), self.lettered)
        keys = pc.if_else(plain, pc.utf8_lower(heads), words).dictionary_encode()
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(words), pc.binary_length(heads)))
        marks = pc.replace_substring_regex(words.filter(marked), f"^{_LETTERS}", "").dictionary_encode()

        cores, places = self._cores_of(keys.dictionary)
        closing = self._asked(marks.dictionary)
        # two parts of each distinct word, the second one mostly empty
        pool = np.concatenate([cores.ids, closing.ids])
        first, size = np.zeros((len(words), 2), dtype=np.int64), np.zeros((len(words), 2), dtype=np.int64)
        place, is_marked, mark = places[keys.indices.to_numpy()], marked.to_numpy(zero_copy_only=False), marks.indices.to_numpy()
        first[:, 0], size[:, 0] = cores.first[place], cores.size[place]
        first[is_marked, 1], size[is_marked, 1] = closing.first[mark] + len(cores.ids), closing.size[mark]
        pool, size = gathered(pool, first.ravel(), size.ravel()), size.sum(axis=1)

        at = numbered.indices.to_numpy()
        sizes = size[at]
        flat = gathered(pool, (np.cumsum(size) - size)[at], sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _cores_of(self, keys: pa.Array) -> tuple[Cores, np.ndarray]:
        """Words with their ids, and where each of ``keys`` is among them. Those unknown are encoded; short ones are kept, at last those of this call."""
        kept = self.cores
        places = pc.fill_null(pc.index_in(keys, value_set=kept.words), -1).to_numpy().copy()
        unknown = np.flatnonzero(places < 0)
        new = keys.take(pa.array(unknown))
        plain = pc.and_(pc.match_substring_regex(new, f"^{_LETTERS}$"), self.lettered)
        kind = np.where(plain.to_numpy(zero_copy_only=False), pc.string_is_ascii(new).to_numpy(zero_copy_only=False).astype(np.int8), 2)
        parts = [np.flatnonzero(kind == k) for k in range(3)]
        made = [(self._spelled, self._asked)[k > 1](new.take(pa.array(part))) for k, part in enumerate(parts)]
        both = Cores.joined([kept, *made])
        places[unknown[np.concatenate(parts)]] = np.arange(len(kept.words), len(both.words))
        short = pc.less_equal(pc.binary_length(both.words), KEPT_BYTES).to_numpy(zero_copy_only=False)
        if short.sum() > self.most_cores:
            used = np.zeros(len(short), dtype=bool)
            used[places] = True
            short &= used
            short &= np.cumsum(short) <= self.most_cores
        self.cores = both if short.all() else both.only(short)
        return both, places

    def _spelled(self, words: pa.Array) -> Cores:
        """Lower-case words of letters, by the merges alone: many of them as one text, whose ids are parted where a word ends."""
        starts = [*range(0, len(words), TOGETHER), len(words)]
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        made = []
        for a, b, line in zip(starts, starts[1:], lines):
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(_SPELLED)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == b - a and ends[-1] == len(ids):
                made.append(Cores(words[a:b], ids, np.diff(ends, prepend=0)))
            else:
                made.append(self._asked(words[a:b]))
        return Cores.joined(made) if made else Cores(words, np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))

    def _asked(self, words: pa.Array) -> Cores:
        """Words as ``learn`` has them; they aren't kept twice."""
        some = words.to_pylist()
        self.learn(set(some) - {""})
        ids = [self.word_ids[w] if w else b"" for w in some]
        self.word_ids, self.older, self.marks = {}, {}, {}
        return Cores(words, np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2)

    def _cut(self, text: str, odd: bool, mean: int) -> list[str]:
        """A text's chunks; those with too few words for a join on either side go with the next one."""
        out, held, n, start = [], [], 0, 0
        for end in cut_points(text, mean):
            part = text[start:end]
            start = end
            n += len(self.words_of(part, odd)) - bool(held)
            held.append(part)
            if n >= LEAST_WORDS:
                out.append("".join(held))
                held, n = [], 0
        if held:
            rest = "".join(held)
            out[-1:] = [out[-1] + rest] if out else [rest]
        return out

    def _around(self, left: str, right: str, m: int, odd: bool) -> str:
        """The text from before the last ``m`` words of one chunk to behind the first ``m`` of the next."""
        if odd:
            a, b = ([x.span() for x in _WORD.finditer(c)] for c in (left, right))
            return left[a[-m - 1][1]:] + right[:b[m][0]]
        return left[len(left.rsplit(None, m)[0]):] + right[:len(right) - len(right.split(None, m)[m])]

    def _library(self, texts: set[str]) -> dict[str, bytes]:
        asked = list(texts)
        return {t: array("I", e.ids).tobytes() for t, e in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False))}

    def _chunk_ids(self, chunks: dict[str, bool]) -> dict[str, tuple[bytes, array]]:
        """(ids, where each word's ids end) of chunks (chunk: odd); those not kept are encoded."""
        out = {c: self.chunks.get((odd, c)) for c, odd in chunks.items()}
        words = {c: self.words_of(c, odd) for c, odd in chunks.items() if out[c] is None}
        self.learn({w for some in words.values() for w in some})
        for c, some in words.items():
            ids = [self.word_ids[w] for w in some]
            out[c] = b"".join(ids), array("I", accumulate(map(len, ids)))
            self.chunks.put((chunks[c], c), out[c])
        return out

    def encode_pieces(self, texts: list[str], mean: int = 256) -> list[list[bytes]]:
        """Of each text the ids, little-endian 32-bit, as pieces to be put together: parts of chunks, and windows between them."""
        odds = [bool(_ODD.search(t)) for t in texts]
        cuts = [self._cut(t, odd, mean) for t, odd in zip(texts, odds)]
        known = {odd: self._chunk_ids({c: odd for cut, o in zip(cuts, odds) if o == odd for c in cut}) for odd in set(odds)}
        widths = [[WINDOW] * (len(cut) - 1) for cut in cuts]
        failed: set[int] = set()
        open_ = {(i, j) for i, cut in enumerate(cuts) for j in range(len(cut) - 1)}
        self.joins += len(open_)
        windows: dict[tuple[int, int], bytes] = {}
        while open_:
            asked = {(i, j): self._around(cuts[i][j], cuts[i][j + 1], widths[i][j], odds[i]) for i, j in open_}
            found = {t: self.windows.get(t) for t in set(asked.values())}
            new = self._library({t for t, ids in found.items() if ids is None})
            for t, ids in new.items():
                self.windows.put(t, ids)
            found.update(new)
            again = set()
            for (i, j), t in asked.items():
                (left, a), (right, b), m, ids = known[odds[i]][cuts[i][j]], known[odds[i]][cuts[i][j + 1]], widths[i][j], found[t]
                # the words but the one at the edge, as each chunk has them
                before, after = left[a[-m - 1]:a[-2]], right[b[0]:b[m - 1]]
                if len(ids) >= len(before) + len(after) and ids.startswith(before) and ids.endswith(after):
                    windows[i, j] = ids
                elif 4 * m < LEAST_WORDS:
                    widths[i][j] = 2 * m
                    again.add((i, j))
                else:
                    failed.add(i)
            self.widened += len(again)
            open_ = again
        self.whole += len(failed)
        whole = self._library({texts[i] for i in failed})
        return [[whole[texts[i]]] if i in failed else self._assemble(cut, known[odds[i]], widths[i], [windows[i, j] for j in range(len(cut) - 1)]) for i, cut in enumerate(cuts)]

    @staticmethod
    def _assemble(cut: list[str], known: dict, widths: list[int], windows: list[bytes]) -> list[bytes]:
        out, lo = [], 0
        for j, window in enumerate(windows):
            ids, ends = known[cut[j]]
            out += [ids[lo:ends[-widths[j] - 1]], window]
            lo = known[cut[j + 1]][1][widths[j] - 1]
        if cut:
            out.append(known[cut[-1]][0][lo:])
        return out

    def encode(self, texts: list[str], mean: int = 256) -> list[bytes]:
        """Little-endian 32-bit ids of each text, by reuse of chunks with repaired joins."""
        return [b"".join(pieces) for pieces in self.encode_pieces(texts, mean)]

    def shown(self, pieces: list[bytes]) -> tuple[str, str]:
        """(decimal ids, decoded text) of the ids in pieces, each joined by single spaces; a piece's texts are made once."""
        parts = []
        for piece in pieces:
            if piece:
                both = self.texts.get(piece)
                if both is None:
                    ids = array("I", piece)
                    both = " ".join([self.decimal[i] for i in ids]), " ".join([t for i in ids if (t := self.token[i]) is not None])
                    self.texts.put(piece, both)
                parts.append(both)
        return " ".join([d for d, _ in parts]), " ".join([t for _, t in parts if t])

    def decode(self, ids: list[int]) -> str:
        return " ".join([t for i in ids if 0 <= i < len(self.token) and (t := self.token[i]) is not None])


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary in a Python worker, so its caches outlive a task."""
    return held(f"encoder {path}", lambda: ChunkEncoder(path))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     mean_chunk: int = 256, output: str = "ids") -> DataFrame:
    """Encode every whole text. Returns (doc_id, n_tokens, ids, decoded), or digests with ``output="digest"``:
    (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty: 0 tokens, decoded to the empty text. Repeated rows each give a row; null ids are
    kept; other columns are not carried, so their names can't clash; an empty table gives no rows. Rows are mapped
    where they stand: no shuffle, and memory is bounded by a block of 4 million characters or one text.
    """
    path = path or default_vocabulary()

    def start():
        enc = encoder(path)

        def work(texts: list[str]) -> list:
            rows = []
            for pieces in enc.encode_pieces([t or "" for t in texts], mean_chunk):
                decimal, decoded = enc.shown(pieces)
                n = sum(map(len, pieces)) // 4
                if output == "digest":
                    rows.append((n, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
                else:
                    rows.append((n, np.frombuffer(b"".join(pieces), dtype="<u4").astype(np.int32), decoded))
            return [list(column) for column in zip(*rows)]

        return work

    fields = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if output == "digest" else "ids array<int>, decoded string")
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], start, fields)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode an array of ids for each row: (doc_id, decoded). Null arrays and null ids within count as no ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode([i for i in ids or () if i is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
