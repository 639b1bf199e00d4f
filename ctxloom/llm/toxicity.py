"""Toxicity by a gapped string-kernel machine with Nystrom landmarks.

Two units of text (words, joined runs of spaced-out letters, words with the marks inside them taken out, and the parts
between such marks) are alike
by the subsequences of three letters they share: one that spans r letters counts DECAY^r, spans over SPAN count
nothing.  The normalised kernel, to the power SHARP and 0 under FLOOR, of a unit with the landmarks, times the inverse root of the
landmarks' own kernel matrix, is its Nystrom vector; a sentence's is the sum of its units', which is the convolution
kernel of sentences.  A squared-hinge machine learns on labelled sentences, and a document's score is the logistic,
fitted on the sampled documents, of its greatest sentence margins and of their sum, alone and by its length.

Marked units are those over six times as frequent in toxic training documents whose log-likelihood ratio passes BAR,
which is the same for every size of sample; landmarks are chosen among them, the most marking first, until each marked
unit is alike to one.  A sentence that several documents of a class share counts in the first of them alone, as copies
of a document say no more than the document.
Training takes at most SAMPLE labelled documents of either class, chosen by hash, and of a toxic one the first
TOXIC_SENTENCES sentences with a marked unit; scoring covers all texts whole.  A unit over the kernel's length, and a
run of letters joined over marks or spaces, is scored by overlapping pieces, of which the greatest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import held_out, stage, table
from ctxloom.llm.wordhash import text_buffer, word_bounds, word_hashes

FOLDS, HELD = 5, 0
#: Labelled documents of either class that training takes at most.
SAMPLE = 20_000
#: Least log-likelihood ratio of a marked unit: chance 1 in 5,000.  A unit of toxic documents only passes with 10 of them
#: where the classes are of one size, with 4 where a ninth is toxic.
BAR = 13.8
DECAY, SPAN, SHARP = 0.6, 5, 2.0
#: Likeness under this counts nothing.
FLOOR = 0.6
#: Longest sentence in words.
SENTENCE = 32
#: Words a worker remembers before it forgets them; letters of a run that is a word as well; texts read at a time.
CACHE, SPACED, READ = 2_000_000, 4, 512
#: Units compared with the landmarks at once.
BLOCK = 256
LONGEST = 32
#: Width and step of the pieces that a long unit is scored by.
PIECES = ((4, 1), (6, 1), (9, 2), (13, 3), (19, 4), (31, 4))
#: Sentences of a toxic document that training takes at most, the first with a marked unit.
TOXIC_SENTENCES = 8

# Letters that stand in for others.  Accents but those of e count as their letter.
_STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s", "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y"}
_BEGIN = "\x01"
#: Letters are numbers of BITS bits: 1 to 31 those of Latin-1, from 32 on all others by their code point.
BITS = 6
_LETTERS = np.full(256, 28, np.int32)
_LETTERS[0] = 0
for _c in [_BEGIN, *"abcdefghijklmnopqrstuvwxyz"]:
    _LETTERS[ord(_c)] = 27 if _c == _BEGIN else ord(_c) - 96
for _k, _c in enumerate("éèê"):
    _LETTERS[ord(_c)] = 29 + _k
for _c, _to in _STAND_IN.items():
    _LETTERS[ord(_c)] = _LETTERS[ord(_to)]
_EDGES = re.compile(r"^[^\w@$]+|[^\w]+$")
_MARKS = re.compile(r"[\W_]+")
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def units_of(word: str) -> list[str]:
    """The lower-cased word without marks at its edges; where it has any inside, without those, and the parts between."""
    bare = word if word.isalnum() else _EDGES.sub("", word)
    if bare.isalnum():
        return [bare]
    parts = [part for part in _MARKS.split(bare) if part]
    if not parts:
        return [bare] if bare else []
    return list(dict.fromkeys([bare, "".join(parts), *(part for part in parts if len(part) > 2)]))


def windows(unit: str, width: int, step: int) -> list[str]:
    return [unit[i : i + width] for i in range(0, len(unit) - width, step)] + [unit[-width:]]


def learned_of(word: str) -> list[str]:
    """What a word may be marked by: its units, of those over the kernel's length the widest pieces."""
    units = [u for u in units_of(word) if len(u) > 2]
    return units if len(word) < LONGEST else [part for u in units for part in (windows(u, *PIECES[-1]) if len(u) >= LONGEST else [u])]


def pieces(word: str) -> list[str]:
    """What a word is scored by: its units; of those over the kernel's length, and of joined ones, overlapping pieces."""
    units = units_of(word)
    if len(units) < 2 and len(word) < LONGEST:
        return units
    out = [u for u in units if len(u) < LONGEST]
    for k, u in enumerate(units):
        if len(u) >= LONGEST and (k or len(units) == 1) or k == 1 and len(u) > 8:
            for width, step in PIECES:
                if width < len(u):
                    out += windows(u, width, step)
    return list(dict.fromkeys(out))


def codes(units: list[str]) -> np.ndarray:
    """(units, LONGEST) numbers of letters with a mark of the beginning, 0 beyond the end; units are under LONGEST."""
    text = "".join([(_BEGIN + u).ljust(LONGEST, "\0") for u in units])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _LETTERS[points & 255], 32 + (points & 31)).astype(np.int32).reshape(len(units), LONGEST)


def triples(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of every gapped triple, (units, triples); code 0 is none."""
    width = letters.shape[1]
    found, weights = [np.zeros((len(letters), 1), np.int32)], [np.zeros(1, np.float32)]
    for i, j in _OFFSETS:
        if j < width:
            a, b, c = letters[:, : width - j], letters[:, i : width - j + i], letters[:, j:]
            found.append(np.where(c > 0, (a << 2 * BITS) | (b << BITS) | c, 0))
            weights.append(np.full(width - j, DECAY ** (j + 1), np.float32))
    return np.concatenate(found, axis=1), np.concatenate(weights)


#: The norm of a unit of each length whose triples all differ; no unit of the length has a lesser one.
NORMS = np.sqrt(np.maximum([sum(max(0, n - j) * DECAY ** (2 * j + 2) for _, j in _OFFSETS) for n in range(LONGEST + 1)], 1e-6)).astype(np.float32)


def norms(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows, columns = np.nonzero(found)
    keys, group = np.unique(rows * (1 << 3 * BITS) + found[rows, columns], return_inverse=True)
    sums = np.bincount(group, weights=weights[columns])
    return np.sqrt(np.maximum(np.bincount(keys >> 3 * BITS, weights=sums**2, minlength=len(found)), 1e-6)).astype(np.float32)


class Kernel:
    """Sharpened normalised kernel of units with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = codes(landmarks)
        found, weights = triples(letters)
        rows, columns = np.nonzero(found)
        keys, group = np.unique(found[rows, columns].astype(np.int64) * len(landmarks) + rows, return_inverse=True)
        # By triple: the landmarks that have it, and its weight in each.
        self.code, self.landmark = np.divmod(keys, max(1, len(landmarks)))
        self.weight = (np.bincount(group, weights=weights[columns], minlength=len(keys)) / norms(found, weights)[self.landmark]).astype(np.float32)
        self.begin = np.searchsorted(self.code, np.arange((1 << 3 * BITS) + 1))
        self.most = np.zeros(1 << 3 * BITS, np.float32)
        np.maximum.at(self.most, self.code, self.weight)

    def blocks(self, units: list[str]):
        """(places in units, landmarks, values) of the values other than 0."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(length, kind="stable")
        for low in range(0, len(units), BLOCK):
            at = order[low : low + BLOCK]
            letters = codes([units[i] for i in at])[:, : length[at[-1]] + 1]
            found, weights = triples(letters)
            # The rest are below the floor with every landmark.
            own = np.flatnonzero(self.most[found] @ weights >= FLOOR * NORMS[(letters > 0).sum(axis=1)])
            if not len(own):
                continue
            found = found[own]
            rows, columns = np.nonzero(self.most[found])
            code = found[rows, columns]
            count = self.begin[code + 1] - self.begin[code]
            each = np.repeat(np.arange(len(code)), count)
            place = np.arange(len(each)) - (np.cumsum(count) - count - self.begin[code])[each]
            cells = np.bincount(rows[each] * len(self.landmarks) + self.landmark[place], weights=self.weight[place] * weights[columns][each], minlength=len(found) * len(self.landmarks))
            norm = norms(found, weights)
            row, mark = np.nonzero(cells.reshape(len(found), -1) >= (FLOOR * norm)[:, None])
            yield at[own[row]], mark, ((cells[row * len(self.landmarks) + mark] / norm[row]) ** SHARP).astype(np.float32)

    def __call__(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        for at, mark, value in self.blocks(units):
            out[at, mark] = value
        return out


class Part:
    """Words of several texts: each one's place, sentence and text, and the texts' and sentences' bounds."""

    def __init__(self, words: np.ndarray, sentence: np.ndarray, of: np.ndarray, counts: np.ndarray):
        self.words, self.sentence, self.of, self.counts = words, sentence, of, counts


class Sentences:
    """Values of words, remembered as places and values other than 0, summed over the sentences of texts.  Words are told
    by 64-bit hashes."""

    def __init__(self, kernel: Kernel, weights: np.ndarray | None = None, marked: tuple[str, ...] = ()):
        """Values are the kernel's, or their sum by weights; words with a marked unit are told apart."""
        self.kernel, self.weights, self.width = kernel, weights, len(kernel.landmarks) if weights is None else 1
        self.marked = frozenset(marked)
        self.clear()

    def clear(self) -> None:
        self.names, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.marks, self.values = np.zeros(0, np.int64), np.zeros(0, np.float32)
        #: Whether a word ends a sentence, is a single letter, has a marked unit.
        self.kinds = np.zeros((0, 3), dtype=bool)

    def learn(self, names: np.ndarray, word_of) -> np.ndarray:
        """The words' places; names are sorted and distinct, word_of(i) is the i-th word."""
        if len(self.names) > CACHE:
            self.clear()
        at = np.searchsorted(self.names, names)
        new = np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            words = [word_of(i) for i in new.tolist()]
            first = len(self.kinds)
            self._values([pieces(w) for w in words], len(words))
            marked = [not self.marked.isdisjoint(learned_of(w)) for w in words] if self.marked else [False] * len(words)
            self.kinds = np.concatenate([self.kinds, np.array([[w[-1] in ".!?" for w in words], [len(w) == 1 for w in words], marked], dtype=bool).T])
            self.names, self.at = np.insert(self.names, at[new], names[new]), np.insert(self.at, at[new], first + np.arange(len(new)))
            at = np.searchsorted(self.names, names)
        return self.at[at]

    def _values(self, units: list[list[str]], n: int) -> None:
        marks, values, counts = self.marks[:0], self.values[:0], np.zeros(n, np.int64)
        flat = [u for part in units for u in part]
        owners = np.repeat(np.arange(n), np.fromiter(map(len, units), np.int64, n))
        found = []
        for low in range(0, len(flat), 50_000):
            part = flat[low : low + 50_000]
            found += [(owners[low + at], low + at, mark, value) for at, mark, value in self.kernel.blocks(part)]
        if found:
            owner, at, marks, values = (np.concatenate(part) for part in zip(*found))
            if self.weights is not None:
                at, first, group = np.unique(at, return_index=True, return_inverse=True)
                owner, values = owner[first], np.bincount(group, values * self.weights[marks])
                marks = np.zeros(len(at), np.int64)
            # The greatest value of a word's units; none is under 0.
            keys, group = np.unique(owner * self.width + marks, return_inverse=True)
            best = np.zeros(len(keys), np.float32)
            np.maximum.at(best, group, values.astype(np.float32))
            own, marks = np.divmod(keys, self.width)
            counts, values = np.bincount(own, minlength=n), best
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.marks, self.values = np.concatenate([self.marks, marks]), np.concatenate([self.values, values])

    def read(self, texts: list[str | None]) -> Part:
        data, offsets = text_buffer(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        starts, ends, first = word_bounds(data, offsets)
        names, index, place = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        word = lambda i: data[starts[i] : ends[i]].tobytes().decode()
        words = self.learn(names, lambda i: word(index[i]))[place]
        n, counts = len(words), np.diff(first)
        text, order = np.repeat(np.arange(len(counts)), counts), np.arange(n)
        head = np.zeros(n, dtype=bool)
        head[first[:-1][counts > 0]] = True
        head[1:] |= self.kinds[words[:-1], 0]
        head |= (order - np.maximum.accumulate(np.where(head, order, 0))) % SENTENCE == 0
        sentence = np.cumsum(head) - 1
        # Runs of single letters are words as well, in the sentence of their first letter.
        single = self.kinds[words, 1]
        begin = single & np.r_[True, ~single[:-1] | (text[1:] != text[:-1])][:n]
        stop = single & np.r_[~single[1:] | (text[1:] != text[:-1]), True][-n:] if n else single
        low, high = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = high - low >= SPACED
        runs = {}
        for i, j in zip(low[long].tolist(), high[long].tolist()):
            runs.setdefault(" ".join(word(k) for k in range(i, j)), []).append(sentence[i])
        if runs:
            named = sorted((xxhash.xxh64_intdigest(run), run) for run in runs)
            places = self.learn(np.array([h for h, _ in named], np.uint64), lambda i: named[i][1])
            # Learning may have forgotten the rest.
            words = self.learn(names, lambda i: word(index[i]))[place] if len(self.kinds) <= words.max() else words
            where = [runs[run] for _, run in named]
            words = np.r_[words, np.repeat(places, list(map(len, where)))]
            sentence = np.r_[sentence, np.concatenate(where)]
        return Part(words, sentence, text[head], counts)

    def entries(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Of every value other than 0 of every word: its sentence and its place among the values."""
        count = self.starts[part.words + 1] - self.starts[part.words]
        some = np.flatnonzero(count)
        count = count[some]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.starts[part.words[some]], count)
        return np.repeat(part.sentence[some], count), place


#: A document's evidence: its three greatest sentence margins, the sum of those above 0, and the sum of its distinct marked
#: words' values, at most 1 each; both sums alone and for each thousand words.
EVIDENCE = 7


def evidence(margins: np.ndarray, of: np.ndarray, marked: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: margins and of (their texts, in order), the marked words' sums, the numbers of words."""
    n = len(counts)
    order = np.lexsort((-margins, of))
    at = np.arange(len(of)) - np.searchsorted(of, of)
    best = np.full((n, 3), -1.0)
    best[of[at < 3], at[at < 3]] = margins[order][at < 3]
    sums = np.stack([np.bincount(of, np.maximum(margins, 0), minlength=n), marked], axis=1)
    return np.c_[best.clip(-1, 4), np.log1p(sums), np.log1p(1000 * sums / (counts[:, None] + 10))]


@lru_cache(maxsize=1)
def _memory(landmarks: tuple[str, ...], weights: bytes) -> Sentences:
    return Sentences(Kernel(list(landmarks)), np.frombuffer(weights))


class Model:
    """Landmarks, the machine's weight of each kernel value, its intercept, and the logistic's weights of the evidence."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, intercept: float):
        self.landmarks, self.weights, self.intercept, self.logistic = landmarks, weights, intercept, None

    def scorer(self):
        # A worker's next task finds what this one learned.
        sentences = _memory(tuple(self.landmarks), np.asarray(self.weights, np.float64).tobytes())

        def found(texts: list[str | None]) -> np.ndarray:
            out = [np.zeros((0, EVIDENCE))]
            for low in range(0, len(texts), READ):
                part = sentences.read(texts[low : low + READ])
                n, count = len(part.counts), len(part.of)
                own, place = sentences.entries(part)
                values = sentences.values[place].astype(np.float64)
                margins = self.intercept + np.bincount(own, values, minlength=count)
                _, first = np.unique(part.of[own] * len(sentences.values) + place, return_index=True)
                marked = np.bincount(part.of[own[first]], np.minimum(values[first], 1), minlength=n)
                # A text without words is a sentence without units.
                none = np.flatnonzero(part.counts == 0)
                of = np.r_[part.of, none]
                order = np.argsort(of, kind="stable")
                out.append(evidence(np.r_[margins, np.full(len(none), self.intercept)][order], of[order], marked, part.counts))
            return np.concatenate(out)

        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.logistic, -40, 40)))


def machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, own: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps, both classes of equal weight; y is 1 or -1, a row counts
    times.  own is the landmarks' kernel matrix: its form of the weights is their square in the Nystrom space."""
    width = x.shape[1]
    cost = times * np.where(y > 0, 0.5 / max(1, times[y > 0].sum()), 0.5 / max(1, times[y < 0].sum()))
    form = np.eye(width + 1)
    form[:-1, :-1] = own
    form *= ridge / (width + 1)
    w = np.zeros(width + 1)
    for _ in range(rounds):
        hessian, aim = form.copy(), np.zeros(width + 1)
        for low in range(0, len(x), 4096):
            part = np.c_[x[low : low + 4096], np.ones(len(x[low : low + 4096]))]
            active = y[low : low + 4096] * (part @ w) < 1
            part, c = part[active], cost[low : low + 4096][active]
            hessian += (part.T * c) @ part
            aim += part.T @ (c * y[low : low + 4096][active])
        new = np.linalg.solve(hessian, aim)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a lightly ridged logistic fit, the intercept last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * w)
    return w


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, text, toxic): at most SAMPLE rows of either class, doc a number.  The sample's ids are broadcast: 2 SAMPLE
    rows at most."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int")).filter(~held_out("doc_id", FOLDS, HELD))
    parts = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = stage(parts[0].unionByName(parts[1]), "chosen")
    found = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("doc"), "text", "toxic"), "sample")
    if found.count() <= chosen.count():
        return found
    # Ids that come several times: the sample's size holds for rows as well.
    parts = [found.filter(F.col("toxic") == k).orderBy(F.xxhash64("text"), "doc").limit(SAMPLE) for k in (0, 1)]
    return stage(parts[0].unionByName(parts[1]), "sample")


def cover(units: list[str], batch: int = 256) -> list[str]:
    """Units chosen in order until each one is at the floor or above with one of them."""
    out: list[str] = []
    while units:
        head, units = units[:batch], units[batch:]
        alike, left, chosen = Kernel(head)(head) > 0, np.ones(len(head), dtype=bool), []
        for i, unit in enumerate(head):
            if left[i]:
                chosen.append(unit)
                left &= ~alike[i]
        reached = {int(i) for at, _, _ in Kernel(chosen).blocks(units) for i in at}
        units = [u for i, u in enumerate(units) if i not in reached]
        out += chosen
    return out


def sentences_of(text: str) -> list[list[str]]:
    """Words of each sentence: up to an end mark, SENTENCE at most."""
    out, held = [], []
    for word in text.lower().split():
        held.append(word)
        if word[-1] in ".!?" or len(held) == SENTENCE:
            out.append(held)
            held = []
    return [*out, held] if held else out


def _owned(sample: DataFrame) -> DataFrame:
    """(doc, places): which of its sentences a document is the first of its class to have; no row where none."""

    def cut(frames):
        for pdf in frames:
            for doc, toxic, text in zip(pdf["doc"], pdf["toxic"], pdf["text"]):
                names = [xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63) for words in sentences_of(text or "")]
                yield pd.DataFrame({"name": names, "toxic": toxic, "doc": doc, "place": range(len(names))})

    first = sample.mapInPandas(cut, "name long, toxic int, doc long, place int").groupBy("name", "toxic").agg(F.min(F.struct("doc", "place")).alias("at"))
    return first.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list("at.place").alias("places"))


def _marked(sample: DataFrame) -> list[str]:
    """Marked units, the most marking first."""

    def count(frames):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in frames:
            for text, toxic, places in zip(pdf["text"], pdf["toxic"], pdf["places"]):
                sentences = sentences_of(text)
                found[toxic].update({u for w in set().union(*(sentences[i] for i in places)) for u in learned_of(w)})
        units = list(found[0].keys() | found[1].keys())
        for low in range(0, len(units), 50_000):
            part = units[low : low + 50_000]
            yield pd.DataFrame({"unit": part, "bad": [found[1][u] for u in part], "good": [found[0][u] for u in part]})

    owned = stage(sample.join(_owned(sample), "doc").select("text", "toxic", "places"), "owned")
    bad, good = (owned.filter(F.col("toxic") == k).count() for k in (1, 0))
    if not bad or not good:
        return []
    counts = owned.mapInPandas(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = (F.col("bad") + 0.5) / (bad + 1.0) / ((F.col("good") + 0.5) / (good + 1.0))
    both = F.col("bad") + F.col("good")
    share = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (bad + good) / (both * n))).otherwise(0.0)
    counts = counts.withColumn("rate", rate).filter("rate > 6").filter(2 * (share("bad", bad) + share("good", good)) >= BAR)
    return [r["unit"] for r in counts.orderBy(F.desc(F.col("bad") * F.log("rate")), "unit").select("unit").collect()]


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of places and values other than 0, made whole."""
    out = np.zeros((len(rows), width), np.float32)
    for i, row in enumerate(rows):
        half = len(row) // 8
        out[i, np.frombuffer(row, np.int32, half)] = np.frombuffer(row, np.float32, half, 4 * half)
    return out


def labelled_sentences(held: Sentences, texts: list, labels: list) -> list[tuple[int, bytes]]:
    """Kernel sums of a toxic document's sentences with a marked unit; of a clean one's first sentence and of that most
    like the marked ones."""
    out = []
    for low in range(0, len(texts), READ):
        part = held.read(texts[low : low + READ])
        own, place = held.entries(part)
        keys, group = np.unique(own * held.width + held.marks[place], return_inverse=True)
        sums = np.bincount(group, held.values[place], len(keys)).astype(np.float32)
        valued, marks = np.divmod(keys, held.width)
        marked = np.unique(part.sentence[held.kinds[part.words, 2]])
        bounds = np.searchsorted(part.of, np.arange(len(part.counts) + 1))
        for i, toxic in enumerate(labels[low : low + READ]):
            first, last = int(bounds[i]), int(bounds[i + 1])
            if first == last:
                continue
            if toxic:
                chosen = marked[slice(*np.searchsorted(marked, [first, last]))][:TOXIC_SENTENCES].tolist()
            else:
                a, b = np.searchsorted(valued, [first, last])
                chosen = [first, int(valued[a + sums[a:b].argmax()])] if a < b else [first]
            for k in dict.fromkeys(chosen):
                at = slice(*np.searchsorted(valued, [k, k + 1]))
                out.append((int(toxic), marks[at].astype(np.int32).tobytes() + sums[at].tobytes()))
    return out


def fit(x: np.ndarray, toxic: np.ndarray, times: np.ndarray, landmarks: list[str]) -> Model:
    own = Kernel(landmarks)(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    return Model(landmarks, *machine(x, np.where(toxic == 1, 1.0, -1.0), times, (vector * np.maximum(value, 1e-2)) @ vector.T))


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the share of label 1 (0.5 without labels) where the labels tell nothing apart."""
    sample = _sample(docs, labels)
    marked = _marked(sample)
    if not marked:
        rows = sample.agg(F.avg("toxic")).first()[0]
        return 0.5 if rows is None else float(rows)

    landmarks = cover(marked)

    def sentences(frames):
        held = Sentences(Kernel(landmarks), marked=tuple(marked))
        for pdf in frames:
            yield pd.DataFrame(labelled_sentences(held, pdf["text"].tolist(), pdf["toxic"].tolist()), columns=["toxic", "x"])

    rows = sample.mapInPandas(sentences, "toxic int, x binary").groupBy("toxic", "x").count().orderBy("toxic", "x").toPandas()
    if rows["toxic"].nunique() < 2:
        return float(rows["toxic"].mean()) if len(rows) else 0.5
    times = rows["count"].to_numpy(float)
    model = fit(unpacked(rows["x"].tolist(), len(landmarks)), rows["toxic"].to_numpy(), times, landmarks)
    seen = sample.mapInPandas(_evidence(model), "toxic int, x array<double>").toPandas()
    model.logistic = logistic(np.stack(seen["x"].to_numpy()), seen["toxic"].to_numpy(float))
    return model


def _evidence(model: Model):
    def run(frames):
        found = model.scorer()
        for pdf in frames:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": found(pdf["text"].tolist()).tolist()})

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Null and empty texts have the evidence of a sentence without units; long ones are taken whole; rows that repeat an id
    are scored each.  Where the labels don't tell the classes apart every score is their share of 1, or 0.5.  No rows: no
    rows."""
    model = train(docs, labels)

    def run(batches):
        found = model.scorer() if isinstance(model, Model) else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = model.score(found(texts)) if found else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
