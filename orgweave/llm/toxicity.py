"""Toxicity by noisy-channel deobfuscation.

The writer of a disguised word is taken for a noisy channel: letters become look-alikes (leetspeak), are set apart by spaces or
marks, or are repeated. A word's possible originals form a lattice of characters; Viterbi decoding under a character
language model (interpolated trigrams, learned here) finds the likeliest. A word whose lattice has a single path is
restored as it is. Decoding is a stream: a run of one character is one step, and what all paths that are still open have in common is put out, so words of
any length are decoded in little memory. The restored text is then scored against a lexicon of words and stems that is learned from labelled rows.

The lexicon is a greedy cover: the word or stem (a word's first letters) that explains most toxic rows not yet explained, and few other
rows, is taken again and again. So a near copy's other words, which stand beside a word that explains it, are not learned. A
logistic regression on the evidence of the entries found, the number of words that show them and the text's number of words gives the score.

All of it is learned from every labelled row, each different text once, by Spark: characters, words and stems are counted where the rows
stand and added up; a step of the cover counts what is not yet explained, one of the regression adds up its sums over the rows. The
driver sees sums, and the words and stems that enough toxic rows show, which are few whatever the number of rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, discard, filter_texts, give_back, let_go, map_texts, materialize

#: Bounds of what a task of the fit holds: characters of its block of texts (or one text), things counted before they are handed on.
BLOCK_CHARS, MOST_KEYS = 1_000_000, 100_000
#: Letters that a mark may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Marks that may set letters apart.
APART = set(" .-_*~'·,/\\")
#: Log probabilities of the channel: a letter as itself, as a look-alike, set apart, repeated; a space between single letters that
#: ends a word.
KEPT, LOOKS, SPLIT, REPEATED, SPACED = math.log(0.9), math.log(0.05), math.log(0.05), math.log(0.03), math.log(0.01)
_MARKS = "".join(sorted(set("!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~$@…“”‘’«»„¡¿")))
_DISGUISED = re.compile(r"[0-9@$!|+(€£*.\-_~'·/\\]|(.)\1\1")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SIGN = re.compile(r"[a-z0-9@$!|+(€£*]")
_LETTER = re.compile(r"[a-z]")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
#: Marks within a word; what stands between them is looked up as well.
_INNER = re.compile(r"[\W_]+")
#: Steps of a decoding after which the paths' common beginning is put out; longer words are not kept in the cache of words.
STREAM, CACHED = 64, 64


def _code(c: str) -> int:
    """0: a word's edge, 1 to 26: a to z, 27: any other letter, 28: anything else."""
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27 if c.isalpha() else 28


@cache
def _code_table() -> np.ndarray:
    return np.array([_code(chr(i)) for i in range(0x110000)], dtype=np.uint8)


def trigrams(texts: list[str]) -> Counter:
    """How often each three codes a, b, c stand in the texts' words, their edges with them, by 29 * (29 * a + b) + c."""
    words = [w.strip(_MARKS) for text in texts for w in text.lower().split()]
    codes = _code_table()[np.frombuffer("  ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int32)
    found = np.bincount((codes[:-2] * 29 + codes[1:-1]) * 29 + codes[2:], minlength=29**3)
    found.reshape(29, 29, 29)[:, 0, 0] = 0  # from one word to the next
    found[0] = words.count("")
    return Counter({int(i): int(found[i]) for i in found.nonzero()[0]})


class CharacterModel:
    """Interpolated character trigrams over words, from counts of words or of ``trigrams``."""

    def __init__(self, words: Counter) -> None:
        tri = np.zeros((29, 29, 29))
        for word, n in words.items():
            if isinstance(word, int):
                tri.reshape(-1)[word] += n
                continue
            codes = [0, 0, *map(_code, word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                tri[a, b, c] += n
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + 29)
        p2 = (bi + 3 * p1) / (bi.sum(1, keepdims=True) + 3)
        p3 = (tri + 3 * p2[None]) / (tri.sum(2, keepdims=True) + 3)
        self.logp = np.log(p3).tolist()

    def restore(self, word: str) -> str:
        """The likeliest original of a lower-case ``word`` (or of spelled letters with spaces between)."""
        states, done = {(0, 0): (0.0, "")}, []
        i = steps = 0
        while i < len(word):
            c, j = word[i], i + 1
            while j < len(word) and word[j] == c:
                j += 1
            run, literal = j - i, c
            options = [(SPACED if c == " " else KEPT, literal * run)]
            if c in LOOKALIKES:
                options += [(LOOKS + (REPEATED if n != run else 0), x * n) for x in LOOKALIKES[c] for n in {1, min(run, 2)}]
            if c in APART:
                options.append((KEPT if c == " " else SPLIT, ""))
            if c.isalpha() and run > 1:
                options += [(REPEATED, literal * n) for n in {1, 2} if n < run]
            new: dict = {}
            for (a, b), (score, path) in states.items():
                for cost, text in options:
                    x, y, total = a, b, score + cost
                    for letter in text:
                        code = _code(letter)
                        total += self.logp[x][y][code]
                        x, y = (0, 0) if code == 0 else (y, code)
                    if (best := new.get((x, y))) is None or total > best[0]:
                        new[x, y] = (total, path + text)
            states = new
            i, steps = j, steps + 1
            if steps % STREAM == 0:
                common = commonprefix([path for _, path in states.values()])
                done.append(common)
                states = {state: (score, path[len(common):]) for state, (score, path) in states.items()}
        done.append(max(((score + self.logp[a][b][0], path) for (a, b), (score, path) in states.items()), default=(0, ""))[1])
        return "".join(done)


#: Lengths of the stems that may enter the lexicon.
STEMS = range(3, 9)


def entries(word: str) -> set[str]:
    """What a word may be known by: itself, and its stems with a mark that tells them from words."""
    return {word} | {word[:n] + "-" for n in STEMS if n < len(word)}


def collapsed(word: str) -> str:
    """Every run of one character as that character."""
    return _RUN.sub(r"\1", word)


#: What a disguise leaves of a word: look-alikes are one, what may set letters apart is gone, and so are repetitions.
_CLASSES = str.maketrans({c: None for c in APART} | {x: r for r, xs in {"e": "aeiou01!|l3€4@£", "s": "5$", "g": "69", "t": "7+", "b": "8", "c": "("}.items() for x in xs})
_STARS = re.compile(r"\*+")
_FRONT = "".join(sorted(set(_MARKS) | APART))
#: Marks before a word that are taken away one by one; words with more are decoded.
FRONT = 4


def skeleton(word: str) -> str:
    """The same for a word and all its disguises, but for ``*``, which is taken for nothing."""
    return _RUN.sub(r"\1", word.translate(_CLASSES))


class Entries:
    """Entries looked up by what may show them; what can't is told before it is decoded."""

    def __init__(self, known: Iterable[str]) -> None:
        self.names = list(known)
        self.at = {e: i for i, e in enumerate(self.names)}
        self.heads = {e[:3] for e in self.names}
        self.skeletons = {skeleton(e.removesuffix("-").partition("*")[0]) for e in self.names}
        self.sizes = sorted({len(k) for k in self.skeletons})
        self.least = self.sizes[0] if self.sizes else 0
        self.fronts = {k[:self.least] for k in self.skeletons}

    def of(self, word: str) -> tuple[int, ...]:
        """The entries, by their places, that a restored word shows."""
        if word[:3] not in self.heads:
            return ()
        found = map(self.at.get, [word, *[word[:n] + "-" for n in STEMS if n < len(word)]])
        return tuple(i for i in found if i is not None)

    @staticmethod
    def forms(word: str) -> set[str]:
        return {word, _STARS.sub("e", word)}

    def possible(self, word: str) -> bool:
        """Whether any way to restore a word may begin with an entry; marks before it may be letters or not belong to it."""
        front, stars = len(word) - len(word.lstrip(_FRONT)), "*" in word
        if not front and not stars:
            return self.begins(skeleton(word))
        if front > FRONT or stars and len(_STARS.findall(word)) > 1:
            return bool(self.names)
        return any(self.begins(skeleton(w[i:])) for w in (self.forms(word) if stars else (word,)) for i in range(front + 1))

    def begins(self, form: str) -> bool:
        return form[:self.least] in self.fronts and any(form[:n] in self.skeletons for n in self.sizes)

    def within(self, run: str) -> bool:
        """Whether any way to restore spelled words may have an entry in it."""
        if len(_STARS.findall(run)) > 1:
            return bool(self.names)
        return any(k in form for form in map(skeleton, self.forms(run)) for k in self.skeletons)


class ToxicityModel:
    """Lexicon entries with their log evidence, and the regression's coefficients."""

    def __init__(self, characters: CharacterModel, weights: dict[str, float], beta: np.ndarray) -> None:
        self.characters, self.weights, self.beta = characters, weights, beta
        self.longest = max(map(len, weights), default=0)
        #: The entries, words and stems, with their runs collapsed: what a word with doubled letters may be meant for.
        self.meant = {collapsed(e.removesuffix("-")) + ("-" if e.endswith("-") else "") for e in weights}
        self.shown = Entries(weights)

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text = text.lower()
        return set().union(*(self.originals(w) for w in set(text.split())), *map(self.spelled, self.runs(text)))

    def restore(self, text: str) -> str:
        """The text in lower case with every disguised word restored."""
        text = _SPELLED.sub(lambda m: " ".join(sorted(self.spelled(m[0]))) if self.runs(m[0]) else m[0], text.lower())
        return re.sub(r"\S+", lambda m: min(self.originals(m[0]) - {m[0].strip(_MARKS)}, default=m[0]), text)

    @staticmethod
    def runs(text: str) -> set[str]:
        """Letters, or what may stand for them, set apart by white space; one sign again and again is no spelled word."""
        return {m[0] for m in _SPELLED.finditer(text) if len(set(_SIGN.findall(m[0]))) > 1 and _LETTER.search(m[0])}

    def decoded(self, form: str) -> str:
        """The restored form; where letters were repeated with marks between them, that without the repetition."""
        out = self.characters.restore(form)
        return self.characters.restore(out) if self.doubled(out) or re.search(r"([a-z])\1\1", out) else out

    def spelled(self, run: str) -> set[str]:
        return {w.strip(_MARKS) for w in self.decoded(" ".join(run.split())).split()}

    def doubled(self, form: str) -> bool:
        """Whether a word with a doubled letter may be an entry of the lexicon without it."""
        if not self.meant or not _RUN.search(form):
            return False
        short = collapsed(form)
        return short in self.meant or any(short[:n] + "-" in self.meant for n in range(1, min(len(short), self.longest) + 1))

    def originals(self, word: str, shown: Entries | None = None, decode: bool = True) -> set[str]:
        """The word without marks around it, its parts between marks, and their restored forms where they may be disguised (and may show
        one of the entries ``shown``)."""
        if word.isalpha() and not _RUN.search(word):
            return {word}
        core = word.strip(_MARKS)
        out = {core} if core else set()
        parts = [p for p in _INNER.split(core) if len(p) > 2]
        if parts != [core]:
            out.update(parts)
        for form in {core, word, *parts} if decode else ():
            if len(form) >= 3 and _LETTER.search(form) and (_DISGUISED.search(form) or self.doubled(form)) and (shown is None or shown.possible(form)):
                out.add(self.decoded(form).strip(_MARKS))
        return out

    @staticmethod
    def features(evidence: list[float], n_words: int) -> list[float]:
        hits, size = len(evidence), math.log1p(n_words)
        return [1.0, float(hits > 0), max(evidence, default=0.0), math.log1p(hits), math.log1p(hits) - size if hits else 0.0]

    def score(self, evidence: list[float], n_words: int) -> float:
        z = float(np.dot(self.features(evidence, n_words), self.beta))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class Lookup:
    """The entries that texts show; words that were looked up before are kept, up to a number."""

    def __init__(self, model: ToxicityModel, shown: Entries | None = None, decode: bool = True, most: int = 250_000) -> None:
        self.model, self.shown, self.decode, self.most = model, shown or model.shown, decode, most
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, ...]] = {}

    def found(self, text: str) -> tuple[list[tuple[int, ...]], int]:
        """The entries of each word that shows any, and the number of the text's distinct words."""
        text = text.lower()
        words = set(text.split())
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.seen, self.hits, new = set(), {}, words
        for word in new:
            if hit := tuple(chain.from_iterable(map(self.shown.of, self.model.originals(word, self.shown, self.decode)))):
                self.hits[word] = hit
        out = [self.hits[w] for w in words & self.hits.keys()]
        long = {w for w in new if len(w) > CACHED}
        self.seen |= new - long
        for word in long & self.hits.keys():
            del self.hits[word]
        for run in self.model.runs(text) if self.decode else ():
            if self.shown.within("".join(run.split())):
                out += [hit for w in self.model.spelled(run) if (hit := self.shown.of(w))]
        return out, len(words)


class Scorer(Lookup):
    """Scores texts."""

    def __init__(self, model: ToxicityModel, most: int = 250_000) -> None:
        super().__init__(model, most=most)
        self.weights = list(model.weights.values())

    def score(self, text: str | None) -> float:
        return self.model.score(*self.look(text if isinstance(text, str) else ""))

    def look(self, text: str) -> tuple[list[float], int]:
        """The evidence of a text's words, of each the most, and the number of its distinct words."""
        found, n_words = self.found(text)
        return [max(map(self.weights.__getitem__, hit)) for hit in found], n_words


#: A function that begins a task's work and gives another one, from texts to what is counted in them, one part after another.
Counting = Callable[[], Callable[[list[str]], Iterator[Iterable]]]


def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """What a step of the regression adds up over rows: the second derivatives, and below them the first ones."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return np.vstack([(x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (p - y)])


class Listed:
    """Labelled rows of which there are few."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        self.rows = list(dict.fromkeys(rows))

    def texts(self, label: int | None = None) -> list[str]:
        return [text for text, y in self.rows if label is None or int(y == 1) == label]

    def sizes(self) -> dict[int, int]:
        return Counter(int(y == 1) for _, y in self.rows)

    @staticmethod
    def share(thing):
        return lambda: thing

    def counts(self, start: Counting, label: int | None = None, least: int = 1) -> dict:
        total = Counter()
        for part in start()(self.texts(label)):
            total.update(part)
        return {k: n for k, n in total.items() if n >= least}

    def cover(self, start: Counting) -> Callable[[list[int]], dict[int, int]]:
        patterns = [({*map(int, k.split())}, n) for k, n in self.counts(start, 1).items()]

        def gains(taken: list[int]) -> dict[int, int]:
            out = Counter()
            for hits, n in patterns:
                if hits.isdisjoint(taken):
                    out.update(dict.fromkeys(hits, n))
            return out

        return gains

    def derivatives(self, model) -> Callable[[np.ndarray], np.ndarray]:
        scorer = Scorer(model())
        x = np.array([scorer.model.features(*scorer.look(text)) for text, _ in self.rows])
        y = np.array([float(label == 1) for _, label in self.rows])
        return lambda beta: sums(x, y, beta)

    def done(self) -> None:
        pass


class Spread:
    """Labelled rows as a table of text and label, which Spark counts where they stand."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.made = rows, [rows]

    def of(self, label: int | None) -> DataFrame:
        return self.rows if label is None else self.rows.where(F.col("label") == label)

    def sizes(self) -> dict[int, int]:
        return {r["label"]: r["count"] for r in self.rows.groupBy("label").count().collect()}

    def share(self, thing):
        shared = self.rows.sparkSession.sparkContext.broadcast(thing)
        return lambda: shared.value

    def counted(self, start: Counting, label: int | None) -> DataFrame:
        """(key, n); a task hands on its counts when it has many."""

        def batch_of(total: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(map(str, total), pa.string()), pa.array(total.values(), pa.int64())], names=["key", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            count, total = start(), Counter()
            for batch in batches:
                column = batch.column("text")
                for a, b in blocks(pc.utf8_length(column).to_pylist(), BLOCK_CHARS):
                    for part in count(column.slice(a, b - a).to_pylist()):
                        total.update(part)
                        if len(total) > MOST_KEYS:
                            yield batch_of(total)
                            total.clear()
            yield batch_of(total)
            del count, total
            give_back()

        return self.of(label).select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))

    def counts(self, start: Counting, label: int | None = None, least: int = 1) -> dict:
        return {r["key"]: r["n"] for r in self.counted(start, label).where(F.col("n") >= least).collect()}

    def cover(self, start: Counting) -> Callable[[list[int]], dict[int, int]]:
        patterns = materialize(self.counted(start, 1).select(F.split("key", " ").cast("array<int>").alias("hits"), "n"), "toxicity-patterns")
        self.made.append(patterns)

        def gains(taken: list[int]) -> dict[int, int]:
            left = patterns.where(~F.arrays_overlap("hits", F.lit(taken).cast("array<int>"))) if taken else patterns
            return {r["entry"]: r["n"] for r in left.select(F.explode("hits").alias("entry"), "n").groupBy("entry").agg(F.sum("n").alias("n")).collect()}

        return gains

    def derivatives(self, model) -> Callable[[np.ndarray], np.ndarray]:
        def start():
            let_go()
            scorer = Scorer(model())
            return lambda texts: [[scorer.model.features(*scorer.look(text)) for text in texts]]

        features = materialize(map_texts(self.rows, ["label"], start, "features array<double>", block_chars=BLOCK_CHARS), "toxicity-features")
        self.made.append(features)

        def at(beta: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(beta) + 1, len(beta)))
                for batch in batches:
                    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(beta))
                    total += sums(x, batch.column("label").to_numpy(zero_copy_only=False).astype(float), beta)
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

            parts = features.mapInArrow(run, "sums array<double>").collect()
            return sum((np.array(r["sums"]) for r in parts), np.zeros((len(beta) + 1) * len(beta))).reshape(len(beta) + 1, len(beta))

        return at

    def done(self) -> None:
        discard(*self.made)


def regression(derivatives: Callable[[np.ndarray], np.ndarray], size: int = 5, ridge: float = 0.5, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, until it stands still; the intercept is not shrunk."""
    beta, shrink = np.zeros(size), np.full(size, ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        total = derivatives(beta)
        step = np.linalg.solve(total[:-1] + np.diag(shrink), total[-1] + shrink * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn(rows: list[tuple[str, int]], frequency: dict[int, int], least: int = 3, lift: float = 8.0) -> ToxicityModel:
    """``fit`` on a list of rows."""
    return fit(Listed(rows), frequency, least, lift)


def fit(rows: Listed | Spread, frequency: dict[int, int], least: int = 3, lift: float = 8.0) -> ToxicityModel:
    """Fit the character model on the rows' words, the lexicon by greedy cover, and the regression; the odds are then corrected to the
    labels' true frequencies. Without toxic or without clean rows the score is their frequency; without any it is a quarter, so nothing is rejected.

    An entry is shown by one in 200 toxic rows at least, so the cover has no more than 200 steps, and the entries that may be taken are at most 200
    times those of a toxic row, whatever the number of rows.
    """
    characters = CharacterModel(Counter({int(k): n for k, n in rows.counts(lambda: lambda texts: iter([trigrams(texts)])).items()}))
    prior = math.log((frequency.get(1, 0) + 0.5) / (frequency.get(0, 0) + (0.5 if frequency else 1.5)))
    draft = ToxicityModel(characters, {}, np.array([prior, 0, 0, 0, 0]))
    sizes = rows.sizes()
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return draft
    shared = rows.share(draft)

    def bags():
        model = shared()
        known = lru_cache(50_000)(model.originals)

        def of(text: str) -> set[str]:
            words = set().union(*map(known, set(text.lower().split())), *map(model.spelled, model.runs(text.lower())))
            return {e for w in words for e in entries(w) if len(e) > 2}

        return lambda texts: map(of, texts)

    least = max(least, n_toxic // 200)
    in_toxic = rows.counts(bags, 1, least)

    def shown(candidates: Entries, decode: bool, pattern: bool = False) -> Counting:
        those = rows.share(candidates)

        def start():
            lookup = Lookup(shared(), those(), decode)

            def count(texts: list[str]) -> Iterator[Iterable]:
                for text in texts:
                    hits = set(chain.from_iterable(lookup.found(text)[0]))
                    yield hits if not pattern else [" ".join(map(str, sorted(hits)))] if hits else []

            return count

        return start

    # first without decoding, which counts too few clean rows and so keeps too many entries; then whole counts of those that are left
    candidates, in_clean = Entries(sorted(in_toxic)), {}

    def ratio(entry: str) -> float:
        return ((in_toxic[entry] + 0.5) / (n_toxic + 1)) / ((in_clean.get(entry, 0) + 0.5) / (n_clean + 1))

    for decode in (False, True):
        in_clean = {candidates.names[int(i)]: n for i, n in rows.counts(shown(candidates, decode), 0).items()}
        candidates = Entries(e for e in candidates.names if ratio(e) >= lift)
    gains_of, taken = rows.cover(shown(candidates, True, pattern=True)), []
    while len(taken) < len(candidates.names):
        gains = gains_of(taken)
        best = max(gains, key=lambda i: (gains[i] / n_toxic - 2 * in_clean.get(e := candidates.names[i], 0) / n_clean, len(e), e), default=None)
        if best is None or gains[best] < least:
            break
        taken.append(best)
    lexicon = [candidates.names[i] for i in taken]
    # words that are always found beside an entry explain nothing more, but frequent ones without clean rows belong to the lexicon
    lexicon += [e for e in candidates.names if e not in set(lexicon) and not e.endswith("-") and in_toxic[e] >= max(5, n_toxic // 25) and ratio(e) >= 5 * lift]
    model = ToxicityModel(characters, {e: math.log(ratio(e)) for e in lexicon}, draft.beta)
    model.beta = regression(rows.derivatives(rows.share(model)))  # over the features as they will be when texts are scored
    model.beta[0] += prior - math.log(n_toxic / n_clean)
    return model


def labelled_rows(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """(text, label) of every labelled document, each different text of a label once; null texts are empty. Of a document's labels the smallest counts.

    Which row stands for a text is found by hashes, so only those rows' texts meet what is shuffled.
    """
    texts = docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    labels = usable.groupBy("doc_id").agg(F.min("toxic").alias("label"))
    chosen = texts.select("doc_id", "sha").join(labels, "doc_id").groupBy("sha", "label").agg(F.min("doc_id").alias("doc_id"))
    return texts.join(chosen, ["doc_id", "sha"]).groupBy("doc_id", "sha").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from all labelled rows whose crc32(doc_id) mod 5 is not 0, whole texts."""
    usable = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    frequency = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rows = Spread(materialize(labelled_rows(docs, usable), "toxicity-rows"))
    model = fit(rows, frequency)
    rows.done()
    return model


def _scorer(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 29^3 numbers and the lexicon

    def start():
        let_go()
        scorer = Scorer(shared.value)
        return lambda texts: [[scorer.score(t) for t in texts]]

    return start


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; only the text is an input of the score.

    Null and empty texts have the score of a text without any lexicon word. Repeated rows and null ids are kept, other columns are
    not carried, an empty table gives no rows. Rows are scored where they stand, without a shuffle.
    """
    scored = map_texts(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), ["doc_id", "held_out"],
                       _scorer(docs, model), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is under ``threshold``."""
    scorer = _scorer(docs, model)

    def start():
        work = scorer()
        return lambda texts: [p < threshold for p in work(texts)[0]]

    return filter_texts(docs, start)
