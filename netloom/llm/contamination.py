"""Evaluation passages inside a corpus, wholly or in part, in spite of formatting and small changes.

Passages and documents are reduced to words without letter case, punctuation, markup and remains of wrong decoding.
Windows of words are embedded by the CGK random walk, which turns an edit distance of k into a Hamming distance of O(k^2)
with constant probability: an output string of fixed length is written by walking through the window, and at each
step a random function of (step, word) says whether to move on.  Each of several tables samples some positions of its
own embedding, so that windows that are a few edits apart agree in some table.  Windows are as long as the least stretch
that is a leak, up to WIDTHS[-1] words: passages are divided into classes by that length.  Tables are added
until stretches of the least length with the most edits, planted for the purpose, are found with the target recall.

Candidates go through a count of three-word runs that no leak can fail, and are then aligned word by word and judged exactly.

The corpus is read once, whatever the number of passages, and nothing of it is shuffled: the tables are broadcast in blocks
of a bounded number of passages, and a task holds one block at a time for a bounded number of words.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import MOJIBAKE, TAG, decoded

#: Passages in a block, which bounds what a task holds at once (some 60 MB).
BLOCK_PASSAGES = 5_000
#: Words that a task gathers before it goes through the blocks, if there are several.
ROUND_WORDS = 4_000_000
#: Words of a window, by the least stretch that is a leak: the largest that is no more than it.
WIDTHS = (1, 2, 3, 4, 6, 8, 12)
#: Windows embedded at a time.
SLICE = 1 << 18
#: Bits of the hash of three successive words that a passage's own table, and the table of all passages, has.
TRIPLE_BITS, KNOWN_BITS = 13, 22

_REFERENCE = re.compile("&#?[A-Za-z0-9]+")
_BROKEN = re.compile(r"(?<=[a-z0-9])-\s+(?=[a-z0-9])")
_SPACE = re.compile("[   -     　]")
# Latin letters with marks are what wrong decoding loses or leaves, so they vanish wherever they stand; so do signs.
_LATIN = re.compile("[\u0080-ͯḀ-ỿ -⯿︀-️﻿￰-￿]+|'")
_WORD = re.compile(r"[a-z0-9]+")
# scripts without spaces: every character is a word
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_ANY_WORD = re.compile(f"[a-z0-9]+|[{_UNSPACED}]|[^\\W_a-z0-9{_UNSPACED}]+")


@dataclass(frozen=True)
class Leaks:
    """What counts as a leak, and the search.

    share: least part of the passage's words that one stretch must carry; edits: one word in so many may be changed,
    dropped or added; recall: part of the planted stretches that the tables must find, which decides their number, up to `tables`;
    pace: steps of the walk for each word of a window; drawn: part of the steps that a table samples.
    """

    share: float = 0.4
    edits: int = 8
    recall: float = 0.998
    tables: int = 24
    pace: float = 1.5
    drawn: float = 0.5
    seed: int = 20240501

    def least(self, words: int) -> int:
        return max(1, int(np.ceil(self.share * words - 1e-9)))

    def width(self, words: int) -> int:
        return max(w for w in WIDTHS if w <= self.least(words))

    def triples(self, words: int) -> int:
        """Least runs of three words that a leak keeps: e edits leave m matched words in e + 1 runs, and m >= (edits - 1) * e."""
        least = self.least(words)
        return min(m - 2 * (m // (self.edits - 1) + 1) for m in range(least, least + self.edits))


def words_of(text: str) -> list[str]:
    """Words in lower case, without markup, character references, hyphens at line ends and remains of wrong decoding.

    Wrong decoding is undone where it can be; as it often can't for Latin letters with marks, these vanish everywhere.  Other
    letters are kept; in scripts without spaces every character is a word.
    """
    if "&" in text:
        text = _REFERENCE.sub(lambda m: m.group().lower(), text)
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    plain = text.isascii()
    if not plain and MOJIBAKE.search(text):
        text = decoded(text)
    text = text.lower()
    if not plain:
        text = _LATIN.sub("", _SPACE.sub(" ", text))
        plain = text.isascii()
    elif "'" in text:
        text = text.replace("'", "")
    if "-" in text:
        text = _BROKEN.sub("", text)
    return (_WORD if plain else _ANY_WORD).findall(text)


class Index:
    """The tables of one block of passages of one class; plain arrays, so that it can be broadcast."""

    def __init__(self, passages: list[list[str]], how: Leaks):
        """All passages must have the same how.width."""
        self.how, self.window = how, min((how.width(len(p)) for p in passages), default=1)
        vocabulary = sorted({w for p in passages for w in p})
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.end = len(vocabulary) + 1  # stands behind each passage, and in no text
        self.passages = [np.array([self.vocabulary[w] for w in p], np.int32) for p in passages]
        self.sizes = np.array([len(p) for p in passages], np.int64)
        self.least = np.array([how.triples(len(p)) for p in passages], np.int64)
        self.triples = np.zeros((len(passages), 1 << TRIPLE_BITS), bool)
        self.known = np.zeros(1 << KNOWN_BITS, bool)
        for k, p in enumerate(self.passages):
            own, every = self.hashed_triples(p)
            self.triples[k, own[: len(p) - 2]] = True
            self.known[every[: len(p) - 2]] = True
        stream, at, who = self._stream(self.passages, self.end)
        starts = np.flatnonzero(stream != self.end)
        inside = (at + self.sizes)[who[starts]] - starts >= -(-self.window * 2 // 3)
        starts = starts[inside]
        self.tables: list[tuple] = []
        planted = self._planted()
        missing = np.ones(len(planted), bool)
        while not self.tables or (missing.sum() > (1 - how.recall) * len(planted) and len(self.tables) < how.tables):
            self._add_table(stream, starts, at, who)
            missing &= ~self._found(planted, self.tables[-1:])
        self.planted_recall = 1 - missing.sum() / max(1, len(planted))

    def _add_table(self, stream: np.ndarray, starts: np.ndarray, at: np.ndarray, who: np.ndarray) -> None:
        rng = np.random.Generator(np.random.Philox([self.how.seed, len(self.tables)]))
        bits = rng.integers(0, 2**63, self.end + 1, dtype=np.int64)
        marks = rng.integers(1, 2**63, self.end + 1, dtype=np.int64) | 1
        steps = max(1, round(self.how.pace * self.window))
        drawn = np.sort(rng.choice(steps, max(1, round(self.how.drawn * steps)), replace=False))
        sig = self.signatures(stream, starts, (bits, marks, drawn))
        order = np.argsort(sig, kind="stable")
        size = 1 << int(np.clip(np.ceil(np.log2(16 * len(sig) + 1)), 12, 22))
        seen = np.zeros(size, bool)
        seen[sig & (size - 1)] = True
        self.tables.append((bits, marks, drawn, sig[order], who[starts][order].astype(np.int32), (starts - at[who[starts]])[order].astype(np.int32), seen))

    def _planted(self) -> list[tuple[int, np.ndarray]]:
        """(passage, text): at most 400 passages, a stretch of each of the least length with the most edits between strange words."""
        rng = np.random.Generator(np.random.Philox([self.how.seed, 10**6]))
        pool = np.concatenate(self.passages) if self.passages else np.empty(0, np.int32)
        strange = lambda n: np.where(rng.random(n) < 0.4, 0, rng.choice(pool, n))
        out = []
        for k in np.unique(np.linspace(0, len(self.passages) - 1, 400).astype(int)) if self.passages else ():
            p, need = self.passages[k], self.how.least(len(self.passages[k]))
            kinds = rng.integers(0, 3, need // (self.how.edits - 1))
            length = min(len(p), need + int((kinds != 2).sum()))
            begin = rng.integers(0, len(p) - length + 1)
            part = p[begin : begin + length].tolist()
            for place, kind in sorted(zip(rng.integers(1, max(2, length - 1), len(kinds)).tolist(), kinds.tolist()), reverse=True):
                part[place : place + (kind != 2)] = [] if kind == 1 else [int(strange(1)[0])]
            out.append((int(k), np.concatenate([strange(20), part, strange(20)]).astype(np.int32)))
        return out

    def _found(self, planted: list[tuple[int, np.ndarray]], tables: list[tuple]) -> np.ndarray:
        text, passage, *_ = self._candidates([x for _, x in planted], tables)
        hit = np.zeros(len(planted), bool)
        hit[text[np.array([k for k, _ in planted])[text] == passage]] = True
        return hit

    @staticmethod
    def hashed_triples(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the three words there as numbers for the passages' tables and for that of all passages."""
        x = np.concatenate([ids, np.zeros(2, ids.dtype)]).astype(np.int64)
        with np.errstate(over="ignore"):
            mixed = ((x[:-2] * 1_000_003 + x[1:-1]) * 998_244_353 + x[2:]) * np.int64(-7046029254386353131)
        return ((mixed >> 20) & ((1 << TRIPLE_BITS) - 1)).astype(np.int32), ((mixed >> 38) & ((1 << KNOWN_BITS) - 1)).astype(np.int32)

    def _stream(self, texts: list[np.ndarray], between: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts after one another, each followed by a window of the same word; where each begins; whose each place is."""
        gap = self.window + 1
        lengths = np.array([len(x) + gap for x in texts], np.int64)
        at = np.cumsum(lengths) - lengths
        stream = np.full(int(lengths.sum()), between, np.int32)
        for x, a in zip(texts, at):
            stream[a : a + len(x)] = x
        return stream, at, np.repeat(np.arange(len(texts)), lengths)

    def signatures(self, stream: np.ndarray, starts: np.ndarray, table: tuple) -> np.ndarray:
        """The sampled positions of the walk through each window, as one number."""
        bits, marks, drawn = table[:3]
        sampled, last = set(drawn.tolist()), starts + self.window
        place, sig = starts.copy(), np.zeros(len(starts), np.int64)
        with np.errstate(over="ignore"):
            for step in range(int(drawn[-1]) + 1):
                word = stream[np.minimum(place, last)]
                if step in sampled:
                    sig = sig * np.int64(6364136223846793005) + marks[word]
                place += (bits[word] >> (step + 7)) & 1
            sig ^= (sig >> 29) & np.int64(0x7FFFFFFFF)
        return sig

    def _candidates(self, texts: list[np.ndarray], tables: list[tuple]) -> tuple[np.ndarray, ...]:
        """text, passage, low, high of stretches of texts that may carry a passage, as a table has a window of both.

        Windows that begin with three words that no passage has in a row are passed over; planted stretches
        meet the same rule, so that the tables make up for it.
        """
        stream, at, who = self._stream(texts, 0)
        own, every = self.hashed_triples(stream)
        common = self.known[every] & (stream != 0)
        starts = np.flatnonzero(common if self.window >= 4 else stream != 0)
        keys = [np.empty(0, np.int64)]
        for k in range(0, len(starts), SLICE):
            part = starts[k : k + SLICE]
            for table in tables:
                _, _, _, ordered, owner, place, seen = table
                sig = self.signatures(stream, part, table)
                hit = np.flatnonzero(seen[sig & (len(seen) - 1)])
                lo, hi = np.searchsorted(ordered, sig[hit], "left"), np.searchsorted(ordered, sig[hit], "right")
                some = hi > lo
                hit, lo, n = hit[some], lo[some], (hi - lo)[some]
                entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                start = np.repeat(part[hit], n)
                text = who[start]
                # how much later the passage stands in the text, in steps of 16 words
                cell = ((start - at[text] - place[entry]) >> 4) + (1 << 34)
                keys.append(np.unique(((text * BLOCK_PASSAGES + owner[entry]) << 36) | cell))
        key = np.unique(np.concatenate(keys))
        cell, pair = (key & ((1 << 36) - 1)) - (1 << 34), key >> 36
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (cell[1:] - cell[:-1] > 1)])) if len(key) else np.empty(0, np.int64)
        last = np.concatenate([first[1:], [len(key)]])[: len(first)] - 1
        text, passage = pair[first] // BLOCK_PASSAGES, pair[first] % BLOCK_PASSAGES
        n = self.sizes[passage]
        slack = n // (self.how.edits - 1) + 1
        lengths = np.array([len(x) for x in texts], np.int64)
        low = np.maximum(0, (cell[first] << 4) - slack)
        high = np.minimum(lengths[text], (cell[last] << 4) + 16 + n + slack)
        # a leak keeps runs of three words: first all passages' together, then the passage's own
        begin, stop = at[text] + low, at[text] + np.maximum(low, high)
        upto = np.concatenate([[0], np.cumsum(common)])
        keep = np.flatnonzero(upto[stop] - upto[begin] >= self.least[passage])
        keep = keep[self._own_triples(own, begin[keep], stop[keep], passage[keep]) >= self.least[passage[keep]]]
        return text[keep], passage[keep], low[keep], high[keep]

    def _own_triples(self, own: np.ndarray, begin: np.ndarray, stop: np.ndarray, passage: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), np.int64)
        lengths = stop - begin
        group = np.cumsum(lengths) >> 21
        for g in np.unique(group):
            part = np.flatnonzero(group == g)
            n = lengths[part]
            ends = np.cumsum(n)
            place = np.repeat(begin[part] - (ends - n), n) + np.arange(int(ends[-1]))
            upto = np.concatenate([[0], np.cumsum(self.triples[np.repeat(passage[part], n), own[place]])])
            out[part] = upto[ends] - upto[ends - n]
        return out

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, passage) of all leaks."""
        done: set[tuple[int, int]] = set()
        for text, passage, low, high in zip(*(x.tolist() for x in self._candidates(texts, self.tables))):
            if (text, passage) not in done and self.leaks(texts[text][low:high], passage):
                done.add((text, passage))
        return sorted(done)

    def leaks(self, part: np.ndarray, passage: int) -> bool:
        """Whether this part of a text carries enough of the passage; exact local alignment."""
        p, need = self.passages[passage], self.how.least(len(self.passages[passage]))
        if aligned(p, part, self.how.edits) >= need:
            return True
        return may_carry(p, part, self.how.edits, need) and longest_carried(p, part, self.how.edits) >= need


def longest_carried(passage: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Most words of the passage that one stretch of the text carries in order with at most 1/edits of the stretch edited.

    Any piece of the passage may meet any stretch: for each number of edits up to the most that can be allowed, the most words
    matched by an alignment that ends at a pair of places, begun anywhere.
    """
    n, m = len(passage), len(text)
    if not n or not m:
        return 0
    most = min(n, m) // max(1, edits - 1)
    best = np.zeros(most + 1, np.int32)
    old = np.zeros((most + 1, m + 1), np.int32)
    for word in passage:
        new = np.zeros_like(old)
        new[:, 1:] = (old[:, :-1] + 1) * (text == word)
        np.maximum(new[1:, 1:], old[:-1, :-1], out=new[1:, 1:])
        np.maximum(new[1:], old[:-1], out=new[1:])
        for e in range(1, most + 1):
            np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
        np.maximum(best, new.max(axis=1), out=best)
        old = new
    return int(max(x for e, x in enumerate(best.tolist()) if x >= (edits - 1) * e))


def may_carry(passage: np.ndarray, text: np.ndarray, edits: int, need: float) -> bool:
    """False only where longest_carried is less than need.

    A stretch with m words matched and e edits, m >= need and m >= (edits - 1) * e, has m - x * (edits - 1) * e >= (1 - x) * need
    for every x from 0 to 1, so the best local alignment at such a price of an edit must reach that.
    """
    x = np.array([[0.125], [0.25], [0.5]])
    price = x * (edits - 1)
    along = price * np.arange(len(text) + 1)
    best, row = np.zeros((3, 1)), np.zeros_like(along)
    for word in passage:
        new = np.maximum(row - price, 0.0)
        np.maximum(new[:, 1:], row[:, :-1] + np.where(text == word, 1.0, -price), out=new[:, 1:])
        row = np.maximum.accumulate(new + along, axis=1) - along
        np.maximum(best, row.max(axis=1, keepdims=True), out=best)
    return bool((best >= (1 - x) * need - 1e-6).all())


def aligned(passage: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Words carried in the one alignment of the whole passage with the fewest edits (ends of the text are free).

    Never more than longest_carried, and quicker.
    """
    n, m = len(passage), len(text)
    if not n or not m:
        return 0
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    columns = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (text != passage[i - 1]))
        row = np.concatenate(([i], row)).astype(np.int32)
        cost[i] = np.minimum.accumulate(row - columns) + columns
    i, j = n, int(cost[n].argmin())
    moves = []
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (text[j - 1] != passage[i - 1]):
            moves.append(1 if text[j - 1] == passage[i - 1] else 0)
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            moves.append(0)
            i -= 1
        else:
            moves.append(0)
            j -= 1
    # longest run with matches >= (edits - 1) * changes
    same = np.array(moves[::-1])
    matched = np.concatenate(([0], np.cumsum(same)))
    worth = np.concatenate(([0], np.cumsum(np.where(same == 1, 1, 1 - edits))))
    best = 0
    lowest: list[tuple[int, int]] = []
    for k in range(len(worth)):
        if not lowest or worth[k] < lowest[-1][0]:
            lowest.append((int(worth[k]), k))
    for k in range(len(worth) - 1, 0, -1):
        while lowest and (lowest[-1][1] >= k or worth[k] >= lowest[-1][0]):
            w, s = lowest[-1]
            if s < k and worth[k] >= w:
                best = max(best, int(matched[k] - matched[s]))
            lowest.pop()
        if not lowest:
            break
    return best


def _keyed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, key and words of each passage that has words; passages with the same words share the key."""
    for batch in batches:
        rows = [(i, " ".join(words_of(p))) for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows = [(i, hashlib.blake2b(w.encode(), digest_size=16).digest(), w) for i, w in rows if w]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "key", "words"])


def _search(blocks: list):
    """Texts in, (key, doc_id) out; blocks: broadcasts of (index, keys of its passages)."""

    def found(ids: list[int], words: list[list[str]]) -> pa.RecordBatch:
        keys, docs = [], []
        for block in blocks:
            index, names = block.value
            if len(blocks) > 1:  # one block at a time in memory; its file stays
                vars(block).pop("_value", None)
            get = index.vocabulary.get
            for t, p in index.search([np.array([get(w, 0) for w in ws], np.int32) for ws in words]):
                keys.append(names[p])
                docs.append(ids[t])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    ids.append(i)
                    words.append(words_of(t))
                    held += len(words[-1])
                if held >= (ROUND_WORDS if len(blocks) > 1 else ROUND_WORDS // 8):
                    yield found(ids, words)
                    ids, words, held = [], [], 0
        if ids:
            yield found(ids, words)

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    passage: str = "passage", how: Leaks = Leaks(), block: int = BLOCK_PASSAGES,
) -> DataFrame:
    """(item_id, doc_id), each once: the documents that carry enough of an item's passage.

    Items with the same passage come out together.  Passages and texts that are null or hold no word match nothing,
    and so do rows with a null id; repeated rows change nothing; whole texts are searched, however long; empty tables
    give no rows; further columns are ignored.  block: passages in a block, BLOCK_PASSAGES at most.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).dropna()
    keyed = asked.mapInArrow(_keyed_words, "item_id long, key binary, words string")
    blocks, open_blocks = [], {}

    def close(part: list[tuple[bytes, list[str]]]) -> None:
        part = sorted(part)
        blocks.append(spark.sparkContext.broadcast((Index([w for _, w in part], how), [k for k, _ in part])))

    for row in keyed.select("key", "words").distinct().toLocalIterator():  # the driver holds a block of each class at most
        words = row["words"].split(" ")
        part = open_blocks.setdefault(how.width(len(words)), [])
        part.append((bytes(row["key"]), words))
        if len(part) >= min(block, BLOCK_PASSAGES):
            close(open_blocks.pop(how.width(len(words))))
    for _, part in sorted(open_blocks.items()):
        close(part)
    if not blocks:
        return spark.createDataFrame([], "item_id long, doc_id long")
    found = docs.mapInArrow(_search(blocks), "key binary, doc_id long")
    return found.join(keyed.select("key", "item_id"), "key").select("item_id", "doc_id").distinct()
