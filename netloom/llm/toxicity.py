"""Scores for abusive, hateful or sexually explicit language, learnt from positive examples and unlabelled text.

Texts are cut into short segments, disguises are undone (look-alike letters, digits for letters, spaced or masked words,
stretched letters, invisible characters, wrong decoding), and word n-grams of a segment are its features.  A
linear classifier is trained in numpy with the non-negative positive-unlabelled risk: with class prior pi,

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]),

where rated harmless samples replace part of the unlabelled term.  The prior is estimated as the least ratio of unlabelled to
rated toxic segments above any score (their scores held out), and the threshold is the lowest at which that prior and the held-out
scores promise the precision asked for.  Unlabelled segments that the classifier is sure of are positives in the next fits, so that wordings
outside the rated samples are learnt; as words alone may drift to other topics, a second view must agree: how a segment is
written (end, case, disguises) must be more frequent among rated toxic samples than in the corpus.
A document's score is that of its worst segment, so that a sentence in a long page is not averaged away.

Segments are counted over all documents, all are candidates for the next fits, and the prior and the threshold come from the scores of all;
only the fitting set is bounded (`Recipe`).
Fitting and scoring are apart: a Classifier can be kept as a table and score any number of corpora.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from netloom.functions.tables import cut as checkpointed
from netloom.functions.tables import written
from netloom.llm.text import FOLLOWS, LEADS, TAG, decoded


@dataclass(frozen=True)
class Recipe:
    """Parameters of the training; `segments` bounds the unlabelled fitting set, `asked` the candidates, `labels` the rated samples (None: all).

    furniture: part of all documents that the words of page furniture stand in, and in `recurs` of them at least: fewer copies
    show nothing.  precision: of the flagged segments, as estimated; texts are to be reviewed, so recall comes first beyond that.  odds: how many times more frequent a way of writing must be among rated toxic samples than in the corpus.
    """

    segments: int = 60_000
    asked: int | None = None
    labels: int | None = None
    prior: float | None = None
    rated: float = 0.5
    steps: int = 100
    again: int = 25
    stiff: int = 50
    rate: float = 0.08
    decay: float = 5e-6
    furniture: float = 0.002
    recurs: int = 12
    rounds: int = 5
    sure: float = 0.3
    odds: float = 4.0
    folds: int = 3
    precision: float = 0.9


# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans("аеосрхуіјѕԁһκνορτυαАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeocpxyijsdhkvoptuaABEKMHOPCTXYIJSABEZHIKMNOPTYX")
LEET = str.maketrans("01345789@$", "oieastbgas")

_HIDDEN = re.compile("[­​-‏⁠﻿\u0080-\u009f�]")
_LOOKS = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]){2,}[^\W\d_](?![^\W_])")
_APART = re.compile(r"[ .\-_·]\w[ .\-_·]\w\b")  # what any spaced word has
_DIGITS = re.compile("[0-9@$]+")
_MIXED = re.compile(r"(?<![^\W_])(?=[^\W_]*[0-9@$])(?=[^\W_@$]*[^\W\d_])[^\W_@$]*[0-9@$][^\W_]*[^\W_]")
_HANDLE = re.compile(r"[^\W\d_]{4,}[0-9]+\Z")
_STRETCH = re.compile(r"([^\W\d_])\1\1+")
_ALPHA = re.compile(r"[^\W\d_]")
_THRICE = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_THRICE_OTHER = re.compile(r"([^\W\d_a-z])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
_ACCENT = re.compile("[̀-ͯ]+")
_CIPHER = re.compile(r"[0-9@$](?:[^\W\d_]|[0-9@$]+[^\W\d_])|[^\W\d_][0-9@$]")
_HUMP = re.compile("[A-Z](?<=[a-z].)")  # capitals are few, so they are looked for first
_TOKEN = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]*)?|[0-9]+")
_RUN = re.compile(r"\w+")
_PIECES = re.compile(r"([.!?…\n](?:(?<!\n)[\"'”’)]*\s+|(?<=\n)\n*))")  # begins with a set, so that the rest is passed over fast
#: A line may begin with a speaker or heading of up to three words and a colon.
_LEAD = re.compile(r"((?:[^\W_]+ ){0,2}[^\W_]+): +")
#: Words of a segment without a sentence end are seen through windows of this length.
WINDOW = 12
#: Sentences and lines, up to a length, that a task keeps, as many recur.
KNOWN, KNOWN_LENGTH = 50_000, 400


def _leet(match: re.Match) -> str:
    word = match.group()
    if _HANDLE.match(word) or word.isdigit():
        return word
    return word.translate(LEET)


#: What a text may hold, seen once for all of it: letters of other scripts or hidden ones, humps, spaced, ciphered and stretched words, stars.
LOOKS, HUMPS, SPACES, CIPHERS, STRETCHES, STARS = 1, 2, 4, 8, 16, 32
#: A piece that a bare line break cut off may go on from the line before, so that lower case at its start says nothing.
WRAPPED = 64


def _stretched(low: str) -> bool:
    """Whether `_STRETCH` is found in a lower-case text; faster, as plain letters are looked for as texts."""
    return any(map(low.__contains__, _THRICE)) or not low.isascii() and _THRICE_OTHER.search(low) is not None


#: Kinds of characters, by UTF-16 units: first and further bytes that were read one by one, digits and signs that stand for letters, letters,
#: what is hidden or looks like a Latin letter, and halves of characters of two units.
FIRST, FURTHER, CODE, LETTER, SHOWN, HALF = (1 << k for k in range(6))


def _kinds() -> np.ndarray:
    every, kinds = [chr(k) for k in range(1 << 16)], np.zeros(1 << 16, np.uint8)
    for kind, is_ in ((FIRST, re.compile(LEADS).match), (FURTHER, re.compile(FOLLOWS).match), (CODE, _DIGITS.match), (LETTER, str.isalpha), (SHOWN, _HIDDEN.match), (SHOWN, _LOOKS.match)):
        kinds |= np.fromiter((bool(is_(c)) for c in every), bool, len(every)) * np.uint8(kind)
    kinds[0xD800:0xE000] = HALF
    return kinds


_KINDS = _kinds()


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _odd(text: str) -> int:
    low = text.lower()
    units = _units(low + "\n")
    kinds = _KINDS.take(units)
    if int(np.bitwise_or.reduce(kinds)) & HALF:
        return _odd_beyond(text, low)
    at = np.flatnonzero(kinds & CODE)
    ciphers = len(at) > 0 and bool(((kinds[at - 1] | kinds[at + 1]) & LETTER).any())
    same = units[1:] == units[:-1]
    thrice = units[2:][same[1:] & same[:-1]]
    stretched = len(thrice) > 0 and any(_ALPHA.match(chr(c)) for c in set(thrice.tolist()))  # as _STRETCH
    return (
        (_HUMP.search(text) is not None) * HUMPS | (_APART.search(low) is not None) * SPACES | ciphers * CIPHERS
        | stretched * STRETCHES | ("*" in text or "_" in text) * STARS
    )


def _odd_beyond(text: str, low: str) -> int:
    """`_odd` where some characters take two units."""
    ciphers = any(low[m.start() - 1 : m.start()].isalpha() or low[m.end() : m.end() + 1].isalpha() for m in _DIGITS.finditer(low))
    return (
        (_HUMP.search(text) is not None) * HUMPS | (_APART.search(low) is not None) * SPACES | ciphers * CIPHERS
        | _stretched(low) * STRETCHES | ("*" in text or "_" in text) * STARS
    )


def _plain(text: str, odd: int) -> tuple[str, int]:
    """Lower-case text without the disguises that it may hold, and how many there were."""
    tricks = 0
    if odd & LOOKS:
        text, n = _HIDDEN.subn("", text)
        other = text.translate(LOOKALIKES)
        tricks += n + (other != text)
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", other))
    if odd & HUMPS and _HUMP.search(text):
        tricks += sum(1 for w in text.split() if len(w) > 4 and w[1:] != w[1:].lower() and w.upper() != w and w[0].upper() + w[1:] != w and w[1:].upper() != w[1:])
    text = text.lower()
    if odd & (SPACES | LOOKS):
        text, n = _SPACED.subn(lambda m: re.sub(r"[ .\-_·]", "", m.group()), text)
        tricks += n
    if odd & (CIPHERS | LOOKS) and _CIPHER.search(text):
        before = text
        text = _MIXED.sub(_leet, text)
        tricks += before != text
    if odd & (STRETCHES | LOOKS | SPACES | CIPHERS) and _STRETCH.search(text):
        text = _STRETCH.sub(r"\1", text)
        tricks += 1
    return text, tricks


class _Words(dict):
    """Words as they count: doubled letters once (masked words keep their length), any number as 9; kept, as most recur."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = "9" if word.isdigit() else word if "*" in word else _DOUBLE.sub(r"\1", word)
        return got


_WORDS = _Words()


def pieces(text: str) -> list[tuple[str, int]]:
    """Sentences and lines, markup and wrong decoding undone and accents gone where they hide nothing; each with what the text may hold."""
    if "<" in text:
        text = TAG.sub(" ", text)
    odd = 0
    if not text.isascii():
        kinds = _KINDS.take(_units(text))
        if (kinds[:-1] << 1 & kinds[1:] & FURTHER).any():  # as MOJIBAKE
            text = decoded(text)
            kinds = _KINDS.take(_units(text))
        if int(np.bitwise_or.reduce(kinds)) & SHOWN:
            odd = LOOKS
        else:
            units = _units(unicodedata.normalize("NFKD", text))
            text = units[(units < 0x300) | (units > 0x36F)].tobytes().decode("utf-16-le", "surrogatepass")  # as _ACCENT
    odd |= _odd(text)
    parts = [*_PIECES.split(text), ""]
    out, how, wrapped = [], odd, odd | WRAPPED
    for piece, end in zip(parts[::2], parts[1::2]):
        if piece := (piece + end).strip():
            out.append((piece, how))
        how = wrapped if end == "\n" else odd
    return out


def segments(text: str, known: dict | None = None) -> list[tuple[list[str], str]]:
    """(words, marks) of each segment; marks tell how it is written: its end, and S lower case at the start, C capitals, O disguised, M masked.

    known: pieces already cut, kept for the caller.
    """
    out: list[tuple[list[str], str]] = []
    for raw, odd in pieces(text):
        out += _piece(raw, odd) if known is None else _known(raw, odd, known, _piece)
    return out


def _known(raw: str, odd: int, known: dict, make: Callable):
    key = "\n" + raw if odd & WRAPPED else raw
    got = known.get(key)
    if got is None:
        got = make(raw, odd)
        if len(raw) <= KNOWN_LENGTH:
            if len(known) >= KNOWN:
                known.clear()
            known[key] = got
    return got


def _piece(raw: str, odd: int, read: dict = _WORDS) -> list[tuple[list, str]]:
    """The segments of a sentence or line.  read: what the words are taken as."""
    if ": " in raw and (lead := _LEAD.match(raw)) and lead.end() < len(raw):
        return _piece(lead.group(1), odd, read) + _piece(raw[lead.end() :], odd & ~WRAPPED, read)
    closed = raw.rstrip(" \"'”’)")
    end = closed[len(closed.rstrip(".!?… ")) :]
    if len(end) > 1 or end == "…":
        end = end.replace(" ", "").replace("…", "...")[:3]
    begin = "S" if raw[0].islower() and not odd & WRAPPED else ""
    marks = "C" if raw.isupper() else ""
    plain, tricks = _plain(raw, odd) if odd & ~WRAPPED else (raw.lower(), 0)
    if tricks:
        marks += "O"
    found = (_TOKEN if odd & (LOOKS | CIPHERS | STARS) else _RUN).findall(plain)
    words = list(map(read.__getitem__, found))
    if odd & STARS and any("*" in w for w in found):
        marks += "M"
    if len(words) < 3:  # style says little about a scrap of text
        return [(words, "M" if "M" in marks else "")] if words else []
    if len(words) <= WINDOW:
        return [(words, end + begin + marks)]
    step = WINDOW // 2
    last = (len(words) - step - 1) // step * step
    return [(words[k : k + WINDOW], (end if k == last else "") + (begin if k == 0 else "") + marks) for k in range(0, len(words) - step, step)]


def _style(marks: str) -> list[str]:
    """Features of the marks: the end of the segment, and each letter."""
    end = marks.rstrip("SCOM")
    return [f"#{end}"] * bool(end) + [f"#{m}" for m in marks[len(end) :]]


def _grams(words: list[str], marks: str) -> Iterator[str]:
    a = b = "^"
    for w in words:
        yield w
        yield f"{b} {w}"
        yield f"{a} {b} {w}"
        a, b = b, w
    yield f"{b} $"
    yield from _style(marks)


class Classifier:
    """Weights of n-grams, the words by which masked words (h****t) are read, and the score from which a text is flagged."""

    def __init__(self, weights: dict[str, float], bias: float, masks: dict[tuple, str], threshold: float = 0.5):
        self.weights, self.bias, self.masks, self.threshold = weights, bias, masks, threshold

    def unmask(self, words: list[str]) -> list[str]:
        return [self.masks.get(_mask_key(w), w) if "*" in w else w for w in words]

    def score(self, words: list[str], marks: str) -> float:
        """Log-odds of a segment."""
        if "M" in marks:
            words = self.unmask(words)
        get, total = self.weights.get, self.bias
        a = b = "^"
        for w in words:  # the n-grams of _grams, without building them as a list
            pair = f"{b} {w}"
            total += get(w, 0.0) + get(pair, 0.0) + get(f"{a} {pair}", 0.0)
            a, b = b, w
        return total + get(f"{b} $", 0.0) + sum(get(x, 0.0) for x in _style(marks))

    def document(self, text: str, known: dict | None = None) -> float:
        """Probability-like score of the worst segment; 0 where there is none.  known: scores of pieces, kept for the caller."""
        known = {} if known is None else known
        worst = max((_known(p, odd, known, self._worst) for p, odd in pieces(text)), default=-50.0)
        return float(_sigmoid(np.array(worst)))

    def _worst(self, raw: str, odd: int) -> float:
        return max((self.score(w, m) for w, m in _piece(raw, odd)), default=-50.0)

    def as_table(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value, word): the model as rows, to be written and read back by `from_table`."""
        rows = [("weight", g, w, None) for g, w in sorted(self.weights.items())] + [("bias", "", self.bias, None), ("threshold", "", self.threshold, None)]
        rows += [("mask", "*".join(map(str, k)), 0.0, w) for k, w in sorted(self.masks.items())]
        return spark.createDataFrame(rows, "kind string, name string, value double, word string")

    @staticmethod
    def from_table(rows: DataFrame) -> Classifier:
        kept = rows.collect()  # as many rows as the fitting set has n-grams, which is bounded
        one = {r["kind"]: r["value"] for r in kept}
        masks = {(k[0], k[1], int(k[2])): r["word"] for r in kept if r["kind"] == "mask" for k in [r["name"].split("*")]}
        return Classifier({r["name"]: r["value"] for r in kept if r["kind"] == "weight"}, one["bias"], masks, one["threshold"])


class _Found:
    """Places of whole numbers in a table of distinct ones."""

    def __init__(self, table: np.ndarray):
        self.table = np.sort(table)
        self.may = np.zeros(1 << 20, bool)
        self.may[self._hash(self.table)] = True

    @staticmethod
    def _hash(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers are there, and their places; most are not, so a filter comes first."""
        which = np.flatnonzero(self.may[self._hash(asked)])
        at = np.searchsorted(self.table, asked[which])
        there = self.table[np.minimum(at, len(self.table) - 1)] == asked[which] if len(self.table) else np.zeros(0, bool)
        return which[there], at[there]


class _Numbers(dict):
    """Numbers of words as written, masked ones read; kept as in `_Words`."""

    def __init__(self, number: dict[str, int], reader: Classifier):
        self.number, self.reader = number, reader

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = self.number.get(self.reader.unmask([_WORDS[word]])[0], 0)
        return got


class _Scorer:
    """Log-odds of many segments at once, by each column of the weights.  once: an n-gram counts once in a segment, as in the fits."""

    BEGIN, END = 1, 2  # 0: a word that no n-gram has

    def __init__(self, grams: list[str], weights: np.ndarray, biases: np.ndarray, masks: dict[tuple, str], once: bool):
        self.weights, self.biases, self.once, self.reader = weights, biases, once, Classifier({}, 0.0, masks)
        self.columns = [np.ascontiguousarray(w) for w in weights.T]
        self.number: dict[str, int] = {"^": self.BEGIN, "$": self.END}
        parts = [([g] if g[0] == "#" else g.split(" "), k) for k, g in enumerate(grams)]
        self.style = {x[0]: k for x, k in parts if x[0][0] == "#"}
        parts = [([self.number.setdefault(w, len(self.number) + 1) for w in x], k) for x, k in parts if x[0][0] != "#"]
        self.words, self.width = pa.array(self.number, pa.string()), len(self.number) + 1  # numbers are 1 and up, in this order
        by = [np.array([(*x, k) for x, k in parts if len(x) == n], np.int64).reshape(-1, n + 1) for n in (1, 2, 3)]
        self.single = np.full(self.width, -1)
        self.single[by[0][:, 0]] = by[0][:, 1]
        pairs, heads = (x[:, 0] * self.width + x[:, 1] for x in by[1:])
        self.pairs = _Found(np.unique(np.concatenate([pairs, heads])))
        self.pair = np.full(len(self.pairs.table), -1)
        self.pair[np.searchsorted(self.pairs.table, pairs)] = by[1][:, 2]
        triples = np.searchsorted(self.pairs.table, heads) * self.width + by[2][:, 2]
        self.triples, self.triple = _Found(triples), by[2][np.argsort(triples), 3]
        self.by_marks: dict[str, np.ndarray] = {}
        self.read = _Numbers(self.number, self.reader)

    @staticmethod
    def of(model: Classifier) -> _Scorer:
        return _Scorer(list(model.weights), np.array(list(model.weights.values()), float).reshape(-1, 1), np.array([model.bias]), model.masks, False)

    def scores(self, flat: np.ndarray, kinds: list[str], marks: np.ndarray) -> np.ndarray:
        """A row for each segment.  flat: of each segment BEGIN twice, its words and END.  marks: of each segment, as places in kinds."""
        end = flat == self.END
        row = np.cumsum(end) - end
        own = self.single[flat]
        which = np.flatnonzero(own >= 0)
        rows, cols = [row[which]], [own[which]]
        which, at = self.pairs(flat[:-1] * self.width + flat[1:])
        own = self.pair[at]
        rows.append(row[which + 1][own >= 0])
        cols.append(own[own >= 0])
        which, at = which[which + 2 < len(flat)], at[which + 2 < len(flat)]
        found, at = self.triples(at * self.width + flat[which + 2])
        rows.append(row[which[found] + 2])
        cols.append(self.triple[at])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        if self.once:
            each = np.sort(rows << 32 | cols)
            each = each[np.append(True, each[1:] != each[:-1])[: len(each)]]
            rows, cols = each >> 32, each & 0xFFFFFFFF
        for m in set(kinds) - self.by_marks.keys():
            self.by_marks[m] = self.biases + self.weights[[self.style[x] for x in _style(m) if x in self.style]].sum(axis=0)
        own = np.array([self.by_marks[m] for m in kinds]).reshape(len(kinds), len(self.biases))[marks]
        return own + np.stack([np.bincount(rows, w[cols], len(marks)) for w in self.columns], axis=1)

    def joined(self, words: pa.Array, marks: pa.Array) -> np.ndarray:
        """Scores of segments whose words are one text each."""
        marks = marks.dictionary_encode()
        kinds, marks = marks.dictionary.to_pylist(), marks.indices.to_numpy()
        masked = pa.array(np.array(["M" in m for m in kinds], bool)[marks])
        if masked.true_count:
            words = pc.replace_with_mask(words, masked, pa.array([" ".join(self.reader.unmask(w.split(" "))) for w in words.filter(masked).to_pylist()], pa.string()))
        flat = pc.split_pattern(pc.binary_join_element_wise("^ ^", words, "$", " "), " ").flatten()
        return self.scores(pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy().astype(np.int64) + 1, kinds, marks)

    def _piece(self, raw: str, odd: int) -> tuple[list[int], list[str]]:
        flat, marks = [], []
        for words, m in _piece(raw, odd, self.read):
            flat += (self.BEGIN, self.BEGIN, *words, self.END)
            marks.append(m)
        return flat, marks

    def documents(self, texts: list[str | None], known: dict) -> np.ndarray:
        """Probability-like score of the worst segment of each text, as `Classifier.document`; 0 for null and empty texts."""
        flat, marks, sizes = [], [], []
        for t in texts:
            before = len(marks)
            for p, odd in pieces(t) if t else ():
                own, kinds = _known(p, odd, known, self._piece)
                flat += own
                marks += kinds
            sizes.append(len(marks) - before)
        worst = np.full(len(texts), -50.0)
        if marks:
            place = {m: k for k, m in enumerate(dict.fromkeys(marks))}
            scores = self.scores(np.array(flat, np.int64), list(place), np.array([place[m] for m in marks]))
            np.maximum.at(worst, np.repeat(np.arange(len(texts)), sizes), scores[:, 0])
        return np.where([bool(t) for t in texts], _sigmoid(worst), 0.0)


def _mask_key(word: str) -> tuple:
    """First letter, last letter and number of hidden letters of a masked word."""
    stars = word.count("*")
    tail = word.rsplit("*", 1)[1]
    return word[: word.index("*")], tail, stars


class _Sparse:
    """Rows of feature numbers below `width`; weights give each row's share in the mean."""

    def __init__(self, rows: list[np.ndarray], width: int, weights: np.ndarray | None = None):
        self.n, self.width = len(rows), width
        weights = np.ones(self.n) if weights is None else weights
        self.share = weights / max(weights.sum(), 1e-12)
        # every row ends in a feature of weight 0, so that none is empty
        self.lengths = np.array([len(r) + 1 for r in rows], np.int64)
        self.cols = np.concatenate([x for r in rows for x in (r, [width])]).astype(np.intp) if rows else np.empty(0, np.intp)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(w, 0.0).take(self.cols), self.starts) if self.n else np.empty(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=np.repeat(g, self.lengths), minlength=self.width + 1)[: self.width]

    def above(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Share of the rows that score at least each of the given values."""
        order = np.argsort(scores)
        upto = np.concatenate([[0.0], np.cumsum(self.share[order])])
        return upto[-1] - upto[np.searchsorted(scores[order], at, "left")]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(pos: _Sparse, neg: _Sparse, unl: _Sparse, r: Recipe, prior: float, steps: int, start: tuple | None = None) -> tuple[np.ndarray, float]:
    """Logistic loss under the corrected risk, by Adam over full batches, from zero or from a fit that is there."""
    w, b = (np.zeros(pos.width), -2.0) if start is None else (start[0].copy(), start[1])
    m, v = np.zeros(pos.width + 1), np.zeros(pos.width + 1)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(pos.dot(w) + b), _sigmoid(unl.dot(w) + b)
        # d loss(+) = s - 1, d loss(-) = s
        log1 = lambda s, part: -(np.log(np.clip(1 - s, 1e-12, 1)) * part.share).sum()
        gp = prior * (sp - 1) * pos.share
        gu = np.zeros(unl.n)
        share = 1 - r.rated if neg.n else 1.0
        if log1(su, unl) >= prior * log1(sp, pos):  # below zero the estimate is noise, and its gradient is left out
            gu = share * su * unl.share
            gp = gp - share * prior * sp * pos.share
        grad = pos.back(gp) + unl.back(gu)
        gb = gp.sum() + gu.sum()
        if neg.n:
            gn = r.rated * (1 - prior) * _sigmoid(neg.dot(w) + b) * neg.share
            grad += neg.back(gn)
            gb += gn.sum()
        full = np.append(grad + r.decay * w, gb)
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full * full
        step = r.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _agreed(rated: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Toxic and harmless samples by majority, each with the number of its wording; samples with the same words, undisguised, are one.  Ties are left out."""
    votes, first = Counter(), {}
    for text, vote in sorted(rated):
        key = tuple(w for words, _ in segments(text) for w in words)
        votes[key] += vote
        first.setdefault(key, []).append(text)
    number = {k: n for n, k in enumerate(sorted(votes))}
    pick = lambda sign: [(t, number[k]) for k, v in sorted(votes.items()) if v * sign > 0 for t in first[k]]
    return pick(1), pick(-1)


def _masks(toxic: list[str], seen: Counter) -> dict[tuple, str]:
    """Words of the toxic samples by what a mask would leave of them; lengths count the letters as written, doubled ones included."""
    masks: dict[tuple, str] = {}
    for t in toxic:
        for w in _TOKEN.findall(_plain(t, -1)[0]):
            if "*" not in w and len(w) > 2:
                for head in (1, 2):
                    if len(w) > head + 1:
                        key = (w[:head], w[-1], len(w) - head - 1)
                        best = _DOUBLE.sub(r"\1", w)
                        if key not in masks or seen[best] > seen[masks[key]]:
                            masks[key] = best
    return masks


def train(
    rated: list[tuple[str, int]], unlabelled: list[tuple[list[str], str]], counts: list[int] | None = None, r: Recipe = Recipe(), thinned: float = 1.0,
    common: list[bool] | None = None, written: dict[str, int] | None = None, ask: Callable | None = None, spread: Callable | None = None,
) -> Classifier:
    """A classifier from rated samples (votes above 0: toxic, below: harmless) and distinct segments of unlabelled text.

    counts: how often each of these occurs, and weighs.  thinned: of how many segments that are not common each stands for one, if only
    some are given.  common: which recur often enough to be furniture (`recurs` times, if not given); those that match or score like
    rated toxic samples are not, and do not weigh as their count.  written: how many segments of the corpus are written in each way (marks).
    ask(model, ways) gives (words, marks) of further segments, written in these ways, for which the first fit is fairly sure.
    spread(grams, weights, biases, masks, at) gives the shares of all distinct segments of the corpus that reach each score, a row for each
    column of the weights; without it the given segments stand for the corpus.
    """
    toxic, harmless = _agreed(rated)
    count = np.array(counts or [1] * len(unlabelled), float)
    common = np.array([c >= r.recurs for c in count] if common is None else common, bool)
    if written is None:
        written = Counter()
        for (_, k), c in zip(unlabelled, count):
            written[k] += c
    cut = lambda part: [(w, k, n) for t, n in part for w, k in segments(t)]
    pos_segments, neg_segments = cut(toxic), cut(harmless)
    reader = Classifier({}, 0.0, _masks([t for t, _ in toxic], Counter(w for ws, _, _ in pos_segments for w in ws if "*" not in w)))
    # ways of writing that are much more frequent among toxic samples than in the corpus; what the samples lack counts as in the corpus
    ways, total = Counter(k for _, k, _ in pos_segments), max(1.0, float(sum(written.values())))
    odds = {k: ((ways[k] + 5 * n / total) / (len(pos_segments) + 5)) / (n / total) for k, n in written.items() if n}
    telling = frozenset(k for k, x in odds.items() if x >= r.odds)

    plain = lambda w, k: tuple(reader.unmask(w) if "M" in k else w)
    grams = lambda part: (set(_grams(plain(w, k), k)) for w, k, *_ in part)
    own = {plain(w, k) for w, k, _ in pos_segments} - {plain(w, k) for w, k, _ in neg_segments}
    same = np.array([plain(w, k) in own for w, k in unlabelled], bool)
    often = Counter(g for part in (pos_segments, neg_segments, unlabelled) for s in grams(part) for g in s)
    # marks that no toxic sample has are no evidence, either way
    shown = {x for _, k, _ in pos_segments for x in _style(k)}
    number = {g: i for i, g in enumerate(sorted(g for g, n in often.items() if n > 1 and (g[0] != "#" or g in shown)))}
    numbers = lambda part: [np.array([number[g] for g in s if g in number], np.int32) for s in grams(part)]
    once = np.sort(np.fromiter((hash(g) for g, n in often.items() if n == 1), np.int64))  # most n-grams, known again by their hashes
    del often
    pos_rows, neg_rows, unl_rows = numbers(pos_segments), numbers(neg_segments), numbers(unlabelled)
    pick = lambda rows, keep: [x for x, yes in zip(rows, keep) if yes]

    def narrowed(*parts: list) -> tuple[np.ndarray, list[list]]:
        """The rows without n-grams that none of the first parts (all but the last) has: enough for fits that don't go beyond the samples."""
        known = np.unique(np.concatenate([np.empty(0, np.int32)] + [r for part in parts[:-1] for r in part]))
        place = np.full(len(number) + 1, -1)
        place[known] = np.arange(len(known))
        return known, [[(x := place[r])[x >= 0] for r in part] for part in parts]

    # a stiff fit cannot learn single samples by heart: ratings that it contradicts are taken as wrong, and what recurs
    # word by word on page after page is furniture, and harmless, unless it scores like a toxic sample
    prior = r.prior or 0.01
    stiff = replace(r, decay=r.decay * 200)
    # for prior and threshold each wording counts once, however often it is copied, and those of the samples too
    whole = np.where(common, 1.0, thinned)
    weights = np.where(same, 0.0, count * whole)
    known, (p, n, u) = narrowed(pos_rows, neg_rows, unl_rows)
    width = len(known)
    p, n, u = _Sparse(p, width), _Sparse(n, width), _Sparse(u, width, weights)
    w, b = _fit(p, n, u, stiff, prior, r.stiff)
    sp, sn, su = p.dot(w) + b, n.dot(w) + b, u.dot(w) + b
    between = (np.median(sp) + np.median(sn if n.n else su)) / 2 if p.n and (n.n or u.n) else 0.0
    alike = (su > between) | same
    keep_pos = sp > between if p.n and n.n else np.ones(p.n, bool)
    keep_neg = sn < between if p.n and n.n else np.ones(n.n, bool)
    fold = np.array([k % r.folds for _, _, k in pos_segments], int)[keep_pos] if pos_segments else np.empty(0, int)
    pos_rows = pick(pos_rows, keep_pos)
    neg_rows = pick(neg_rows, keep_neg) + pick(unl_rows, common & ~alike)
    weights = np.where(alike & common, np.minimum(weights, 1.0), weights)

    def held_out(extra: list, weights: np.ndarray, r: Recipe, also: tuple | None = None) -> tuple[np.ndarray, ...]:
        """Scores from -6 to 8, the shares of toxic samples that the fit did not see, and of segments, that reach each of them, and the share of segments by a further fit."""
        known, (p, e, n, u) = narrowed(pos_rows, extra, neg_rows, unl_rows)
        width = len(known)
        n, rest, every = _Sparse(n, width), _Sparse(u, width, weights), _Sparse(u, width, whole)
        held, fits = [], []
        for f in np.unique(fold) if len(np.unique(fold)) > 1 else ():
            w, b = _fit(_Sparse(pick(p, fold != f) + e, width), n, rest, r, prior, r.stiff)
            held.append(_Sparse(pick(p, fold == f), width).dot(w) + b)
            fits.append((w, b))
        if not held or not every.n:
            return np.empty(0), np.empty(0), np.empty(0), np.empty(0)
        at = np.arange(-60, 81) / 10.0
        if spread is None:
            over = [every.above(every.dot(w) + b, at) for w, b in fits]
            if also:
                over.append((all_ := _Sparse(unl_rows, len(number), whole)).above(all_.dot(also[0]) + also[1], at))
        else:
            columns = np.zeros((len(number), len(fits) + bool(also)))
            for k, (w, _) in enumerate(fits):
                columns[known, k] = w
            if also:
                columns[:, -1] = also[0]
            used = np.abs(columns).max(axis=1, initial=0.0) > 1e-4
            over = spread([g for g, yes in zip(number, used) if yes], columns[used], np.array([b for _, b in [*fits, *([also] if also else [])]]), reader.masks, at)
        return at, (np.concatenate(held)[:, None] >= at[None, :]).mean(axis=0), np.mean(over[: len(fits)], axis=0), over[-1]

    def estimated(hit: np.ndarray, seen: np.ndarray, least: float, otherwise: float) -> float:
        ratio = (seen / np.maximum(hit, 1e-9))[hit >= least]
        return float(np.clip(ratio.min(), 1e-4, 0.2)) if len(ratio) else otherwise

    if r.prior is None:
        _, hit, seen, _ = held_out([], weights, stiff)
        prior = estimated(hit, seen, 0.2, prior)

    width = len(number)
    fitted = _fit(_Sparse(pos_rows, width), _Sparse(neg_rows, width), _Sparse(unl_rows, width, weights), r, prior, r.steps)
    named = lambda fitted, threshold=0.5: Classifier({g: float(fitted[0][i]) for g, i in number.items() if abs(fitted[0][i]) > 1e-4}, float(fitted[1]), reader.masks, threshold)
    marks = [k for _, k in unlabelled]
    if ask is not None and telling:
        there = {(plain(w, k), k) for w, k in unlabelled}
        more = [(w, k) for w, k in ask(named(fitted), telling) if (plain(w, k), k) not in there]
        fresh = Counter(g for s in grams(more) for g in s if g not in number)
        seen_once = lambda g: (i := np.searchsorted(once, hash(g))) < len(once) and once[i] == hash(g)
        for g in sorted(g for g, c in fresh.items() if (c > 1 or seen_once(g)) and (g[0] != "#" or g in shown)):
            number[g] = len(number)
        grown = len(number) - width
        width = len(number)
        fitted = (np.append(fitted[0], np.zeros(grown)), fitted[1])
        unl_rows += numbers(more)
        marks += [k for _, k in more]
        weights, whole = np.append(weights, np.ones(len(more))), np.append(whole, np.zeros(len(more)))
    styled = np.array([k in telling for k in marks], bool) & ~np.append(common, np.zeros(len(marks) - len(common), bool))  # furniture is no candidate
    every = _Sparse(unl_rows, width, weights)
    sure = np.zeros(len(unl_rows), bool)
    for _ in range(r.rounds if unl_rows else 0):
        sure = styled & (_sigmoid(every.dot(fitted[0]) + fitted[1]) > r.sure)
        rest = _Sparse(unl_rows, width, np.where(sure, 0.0, weights))
        fitted = _fit(_Sparse(pos_rows + pick(unl_rows, sure), width), _Sparse(neg_rows, width), rest, r, prior, r.again, fitted)
    threshold = 0.5
    at, hit, seen, own = held_out(pick(unl_rows, sure), np.where(sure, 0.0, weights), r, fitted)
    if len(at):
        # the last fits know more wordings than the samples have, so the prior is estimated anew, where few samples are missed
        good = estimated(hit, seen, 0.9, prior) * hit / np.maximum(seen, 1e-12) >= r.precision
        if good.any():  # the fits without a part differ in scale from the whole one, so the share of segments is what is carried over
            threshold = float(_sigmoid(at[np.argmax(own <= seen[np.argmax(good)])]))
    model = named(fitted, threshold)
    model.prior = prior
    return model


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without garbage collection: what cutting makes is many small parts and has no cycles, so that passes over it find nothing."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _joined(raw: str, odd: int) -> list[tuple[str, str]]:
    return [(" ".join(w), m) for w, m in _piece(raw, odd)]


_SEGMENTS = pa.list_(pa.struct([("words", pa.string()), ("marks", pa.string()), ("times", pa.int32())]))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        for k in range(0, batch.num_rows, 500):  # bounds what is held besides
            b = batch.slice(k, 500)
            texts = b.column(2).to_pylist()
            each, times, ends = [], [], [0]
            with _uncollected():
                for t in texts:
                    own = []
                    for p, odd in pieces(t) if t else ():
                        own += _known(p, odd, known, _joined)
                    if len(set(own)) < len(own):
                        count = Counter(own)
                        each += count.keys()
                        times += count.values()
                    else:
                        each += own
                        times += [1] * len(own)
                    ends.append(len(each))
                columns = [pa.array([w for w, _ in each], pa.string()), pa.array([m for _, m in each], pa.string()), pa.array(times, pa.int32())]
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SEGMENTS.value_type)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bool(t) for t in texts], pa.bool_()), made], names=["doc_id", "source", "filled", "segments"])


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, filled (whether there is any text) and the distinct segments of every row, kept in the shared folder: a text is cut once for fitting and scoring."""
    made = "doc_id long, source string, filled boolean, segments array<struct<words string, marks string, times int>>"
    return written(_documents(documents).mapInArrow(_cut_texts, made))


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")


def _score_segments(model: Classifier):
    scorer = _Scorer.of(model)  # made once, for all tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = scorer.joined(b.column(0), b.column(1))[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["words", "marks", "score"])

    return run


def _count_scores(grams: list[str], weights: np.ndarray, biases: np.ndarray, masks: dict[tuple, str], at: np.ndarray):
    """How many segments of a task score below the first of the given values, from each to the next, and beyond, by each column of the weights."""
    scorer, places = _Scorer(grams, weights, biases, masks, True), len(at) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(biases), places), np.int64)
        for b in batches:
            if b.num_rows:
                scores = scorer.joined(b.column(0), b.column(1))
                for k in range(len(biases)):
                    total[k] += np.bincount(np.searchsorted(at, scores[:, k], "right"), minlength=places)
        k, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(total[k, place], pa.int64())], names=["fit", "place", "n"])

    return run


def train_on(documents: DataFrame, labels: DataFrame, r: Recipe = Recipe()) -> Classifier:
    """Trains on all rated samples, and on `segments` distinct segments, which are counted over all documents.

    Samples with the same words, undisguised, are rated together: toxic if more ratings call them so; ties are left out.  Candidates for
    the further fits are all segments written in a telling way of which the first fit is fairly sure.  The prior and the threshold
    come from the scores of all distinct segments.
    """
    texts = documents.select(F.lit(None).alias("doc_id"), F.lit(None).alias("source"), "text")
    return train_on_cut(cut_documents(texts), labels, r)


def train_on_cut(documents: DataFrame, labels: DataFrame, r: Recipe = Recipe()) -> Classifier:
    """`train_on` for documents that were cut."""
    n = documents.where("filled").count()
    # one exchange serves both sums; what recurs is told by its words, however they are written
    each = documents.select(F.inline("segments")).repartition("words").groupBy("words", "marks").agg(F.sum("times").alias("count"), F.count("*").alias("docs"))
    held = checkpointed(each.withColumn("docs", F.sum("docs").over(W.partitionBy("words"))))
    # what recurs is kept whole, the rest is thinned to the bound, and weighs more for that
    common = F.col("docs") >= max(r.recurs, r.furniture * n)
    ways = held.groupBy("marks").agg(F.count("*").alias("n"), F.count_if(common).alias("common"), F.sum("count").alias("count")).collect()  # a few hundred at most
    total, frequent = sum(x["n"] for x in ways), sum(x["common"] for x in ways)
    share = min(1.0, max(0, r.segments - frequent) / max(1, total - frequent))
    drawn = F.xxhash64("words", "marks").between(F.lit(-(2**63)), F.lit(-(2**63) + min(2**64 - 1, int(2**64 * share))))
    chosen = sorted(held.withColumn("common", common).where(F.col("common") | drawn).collect(), key=lambda x: (not x["common"], x["words"], x["marks"]))
    rare = sum(not x["common"] for x in chosen)
    votes = F.sum(F.when(F.col("label") == "none", -1).otherwise(1)).alias("votes")
    judged = labels.select("sample_text", "label").dropna().groupBy("sample_text").agg(votes)
    judged = judged.orderBy(F.xxhash64("sample_text"), "sample_text")
    judged = (judged if r.labels is None else judged.limit(r.labels)).collect()  # rated by people, so they are few

    def ask(model: Classifier, telling: frozenset[str]) -> list[tuple[list[str], str]]:
        scored = held.where(F.col("marks").isin(*sorted(telling))).select("words", "marks").mapInArrow(_score_segments(model), "words string, marks string, score double")
        top = scored.where(F.col("score") > float(np.log(0.02 / 0.98))).orderBy(F.desc("score"), "words", "marks")
        return [(x["words"].split(" "), x["marks"]) for x in (top if r.asked is None else top.limit(r.asked)).collect()]

    def spread(grams: list[str], weights: np.ndarray, biases: np.ndarray, masks: dict[tuple, str], at: np.ndarray) -> np.ndarray:
        counted = held.select("words", "marks").mapInArrow(_count_scores(grams, weights, biases, masks, at), "fit int, place int, n long")
        counts = np.zeros((len(biases), len(at) + 1))
        for x in counted.groupBy("fit", "place").agg(F.sum("n").alias("n")).collect():
            counts[x["fit"], x["place"]] = x["n"]
        return counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    unlabelled = [(x["words"].split(" "), x["marks"]) for x in chosen]
    return train(
        [(x["sample_text"], x["votes"]) for x in judged], unlabelled, [x["count"] for x in chosen], r, (total - frequent) / rare if rare else 1.0,
        [x["common"] for x in chosen], {x["marks"]: x["count"] for x in ways}, ask, spread,
    )


def _score(model: Classifier):
    scorer = _Scorer.of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for k in range(0, b.num_rows, 500):  # bounds what is held besides
                c = b.slice(k, 500)
                with _uncollected():
                    scores = scorer.documents(c.column(2).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return run


def score_documents(documents: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, source, score (0 to 1) of every row; null and empty texts score 0.  Further columns are ignored."""
    return _documents(documents).mapInArrow(_score(model), "doc_id long, source string, score double")


def _score_cut(model: Classifier):
    scorer = _Scorer.of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):  # bounds what is held besides
                c = b.slice(k, 500)
                each, worst = c.column(3).flatten(), np.full(c.num_rows, -50.0)
                if len(each):
                    rows = np.repeat(np.arange(c.num_rows), pc.list_value_length(c.column(3)).to_numpy())
                    np.maximum.at(worst, rows, scorer.joined(each.field("words"), each.field("marks"))[:, 0])
                scores = np.where(c.column(2).to_numpy(zero_copy_only=False), _sigmoid(worst), 0.0)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return run


def score_cut(documents: DataFrame, model: Classifier) -> DataFrame:
    """`score_documents` for documents that were cut."""
    return documents.select("doc_id", "source", "filled", "segments").mapInArrow(_score_cut(model), "doc_id long, source string, score double")


def rates(scored: DataFrame, threshold: float) -> DataFrame:
    """source (null as a group of its own), documents, flagged and rate."""
    flagged = F.count(F.when(F.col("score") >= threshold, 1)).alias("flagged")
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), flagged)
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))
