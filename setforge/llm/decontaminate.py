"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words, ``[^\\W_]+`` in lower case. A passage matches an item of n words if some stretch
of the text has a word edit distance of at most floor((1 - SIMILARITY) n) to it.

CGK embeds a window: a walk reads the window's current word at every step and moves on to the next word or not, as a
random bit of the step and the word says. Edit distance thus becomes a Hamming distance between walks. Each of
``ROUNDS`` repetitions has a walk of its own and samples the words read at ``SAMPLED`` steps. The samples of the items
are a hash index, one bucket for each length, repetition and sampled words; a window whose samples meet an item's in any
repetition makes a candidate, and nothing else does. Candidates are verified by dynamic programming over all starts
near the meeting. Walks pass over words of no item as they do over others, so that a passage may be edited with them.

The longer a window, the less its walk agrees with that of an edited copy. So items over ``PART`` words are indexed as
parts of equal length: of the parts of a matching passage one has its share of the edits at most. ROUNDS is set from
measurements for a recall of 0.99 at the full number of edits (see README; the tests measure it against exact search).

Windows are embedded where a match of an indexed length can be at all: each edit breaks two pairs of neighbouring words
at most, so a window must hold as many pairs known from items of that length as are left then. (Where one word is
repeated on and on, equal pairs in a row count as its first and last one, in items as one.) Such windows are all
that can match any of those items; which one, if any, the index says.

Items are a stated query set: they are read in blocks of ``BLOCK_WORDS`` words, each block of that size broadcast and
run against all documents. Null or wordless items match nothing; null or empty texts hold nothing; equal items are all
reported; of equally good places the first is; repeated documents are reported once per row. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SIMILARITY, SAMPLED, SEED = 0.8, 2, 11
#: Words of the longest windows.
PART = 32
#: Repetitions. Of 1,680 copies with all the edits allowed (lengths of 15 to 64 words, replacements, insertions and deletions,
#: evenly spread or random) 0.991 met within 12 repetitions, 0.995 within 16, 0.997 within 20 and all within 24.
ROUNDS = 24
BLOCK_WORDS = 500_000
_words = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table that rules out most pairs of words.
_BITS = 20


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@dataclass
class Item:
    item_id: int
    ids: np.ndarray  # word numbers, 1 and up
    edits: int
    pairs: np.ndarray  # its pairs of neighbouring words, sorted

    def possible(self, pairs: np.ndarray) -> bool:
        """Whether these pairs of a text hold as many of the item's different pairs as a match must."""
        least = len(self.pairs) - 2 * self.edits
        if least < 1 or len(pairs) < least:
            return least < 1
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        held = np.zeros(len(self.pairs), bool)
        held[at[self.pairs[at] == pairs]] = True
        return int(held.sum()) >= least


@dataclass
class Bucket:
    """Indexed parts of one length: sorted keys of their samples, and of each key its item and the part's place in it.

    A window holds ``least`` known pairs, of a word that goes on and on the first and the last one.
    """

    edits: int
    least: int
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray


class Items:
    """One block of items, ready to be looked up in texts."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, sampled: int = SAMPLED, rounds: int = ROUNDS):
        self.vocab: dict[str, int] = {}
        split = [(i, words(t)) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        for _, w in split:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.codes = np.full(len(self.vocab) + 1, _code(""), np.uint64)  # 0: a word of no item, and what follows the end
        for x, k in self.vocab.items():
            self.codes[k] = _code(x)
        self.rounds, self.sampled = rounds, sampled
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(0, 1 << 63, (rounds, 2 * PART), np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = rng.random((rounds, sampled))
        most = lambda n: int((1 - similarity) * n + 1e-9)
        self.items: list[Item] = []
        parts: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item_id, w in split:
            ids = np.array([self.vocab[x] for x in w], np.int64)
            for at in np.array_split(np.arange(len(ids)), -(-len(ids) // PART)):
                parts.setdefault(len(at), []).append((ids[at], len(self.items), int(at[0])))
            self.items.append(Item(item_id, ids, most(len(ids)), np.unique(self._pairs(ids))))
        self.buckets: dict[int, Bucket] = {}
        pairs, lengths = [], []
        for n, of in sorted(parts.items()):
            ids = np.array([x[0] for x in of])
            keys = self._keys(ids)
            order = np.argsort(keys, axis=None, kind="stable")
            owner = order // rounds
            pair = self._pairs(ids)
            runs = int((pair[:, 1:] != pair[:, :-1]).sum(axis=1).min()) + 1  # an edit breaks two runs of equal pairs at most
            self.buckets[n] = Bucket(most(n), runs - 2 * most(n), keys.ravel()[order], np.array([x[1] for x in of])[owner], np.array([x[2] for x in of])[owner])
            own = np.unique(pair if n > 1 else ids)
            pairs.append(own)
            lengths.append(np.full(len(own), n))
        #: Pairs of neighbouring words (of one-word items the words) with the lengths that they stand in, by pair.
        both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        order = np.argsort(both, kind="stable")
        self.pairs, self.lengths = both[order], (np.concatenate(lengths) if lengths else both)[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.pairs)] = True

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        return ids[..., :-1] * (len(self.vocab) + 1) + ids[..., 1:]

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)

    def _signs(self, windows: np.ndarray) -> np.ndarray:
        """(windows, rounds, sampled): the words that each repetition's walk reads at its sampled steps."""
        m, n = windows.shape
        out = np.zeros((m, self.rounds, self.sampled), np.int64)
        padded = np.concatenate([windows, np.zeros((m, 1), np.int64)], axis=1)
        rows = np.arange(m)[:, None]
        at = np.zeros((m, self.rounds), np.int64)
        wanted = (self.steps * 2 * n).astype(np.int64)  # walks move at half of the steps: 2n of them see the window
        for t in range(int(wanted.max()) + 1):
            now = padded[rows, at]
            for r, s in zip(*np.nonzero(wanted == t)):
                out[:, r, s] = now[:, r]
            at += ((self.codes[now] * self.odd[:, t]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, n, out=at)
        return out

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, rounds): hashes of a repetition and its samples, 0 where a sample lies behind the end or is a word of no item."""
        signs = self._signs(windows)
        key = np.broadcast_to(np.arange(1, self.rounds + 1, dtype=np.uint64), (len(windows), self.rounds))
        for column in np.moveaxis(signs, 2, 0):
            key = (key ^ column.astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
        return np.where((signs > 0).all(axis=2), key, np.uint64(0))

    def _distance(self, item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
        """Least edit distance of the item and any beginning of ``text``, and the shortest such beginning's length."""
        n = len(text)
        row = np.arange(n + 1)
        steps = np.arange(n + 1)
        for x in item:
            new = row + 1
            np.minimum(new[1:], row[:-1] + (text != x), out=new[1:])
            row = np.minimum.accumulate(new - steps) + steps  # insertions
            if row.min() > most:
                return most + 1, 0
        end = int(row.argmin())
        return int(row[end]), end

    def _starts(self, item: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
        """At each place of ``text``, the least edit distance of the item and any stretch that starts there, from the ends backwards; more than ``most`` everywhere if no start has less."""
        back = text[::-1]
        row, steps = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
        for x in item[::-1]:
            new = row + 1
            np.minimum(new[1:], row[:-1] + (back != x), out=new[1:])
            row = np.minimum.accumulate(new - steps) + steps
            if row.min() > most:
                break
        return row[::-1]

    def _windows(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows with enough known pairs."""
        pair = self._pairs(ids)
        if 1 in self.buckets:  # one-word items: their numbers are below all pairs
            single = np.flatnonzero(np.isin(ids, self.pairs[self.lengths == 1]) & (ids > 0))
            if len(single):
                yield 1, single
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        at = at[(pair[at] != pair[at - 1]) | (pair[at] != pair[np.minimum(at + 1, len(pair) - 1)])]
        at = at[self.maybe[self._slot(pair[at])]]
        lo, hi = np.searchsorted(self.pairs, pair[at], "left"), np.searchsorted(self.pairs, pair[at], "right")
        of = np.repeat(np.arange(len(at)), hi - lo)
        length = self.lengths[lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        order = np.argsort(length, kind="stable")
        length, place = length[order], at[of[order]]
        for n, bucket in self.buckets.items():
            least = bucket.least
            if n == 1:
                continue
            if least < 1:
                yield n, np.arange(len(ids))
                continue
            p = place[np.searchsorted(length, n, "left") : np.searchsorted(length, n, "right")]
            if len(p) < least:
                continue
            reach = n + bucket.edits - 2
            first, last = p[: len(p) - least + 1], p[least - 1 :]
            near = last - first <= reach
            if near.any():
                lo, hi = np.maximum(last[near] - reach, 0), first[near]
                lo[1:] = np.maximum(lo[1:], hi[:-1] + 1)  # both rise, so the stretches are joined as they come
                n_of = np.maximum(hi - lo + 1, 0)
                yield n, np.repeat(lo, n_of) + np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)

    def candidates(self, ids: np.ndarray, begin: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Of each item that a window's samples meet, the (text number, first, last) of places where it may start."""
        padded = np.r_[ids, np.zeros(2 * PART, np.int64)]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for n, starts in self._windows(ids):
            bucket = self.buckets[n]
            for at in range(0, len(starts), 512):
                some = starts[at : at + 512]
                keys = self._keys(padded[some[:, None] + np.arange(n)]).ravel()
                lo, hi = np.searchsorted(bucket.keys, keys, "left"), np.searchsorted(bucket.keys, keys, "right")
                met = np.flatnonzero((hi > lo) & (keys > 0))
                many = (hi - lo)[met]
                entry = np.repeat(lo[met], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                window = np.repeat(some[met // self.rounds], many)
                text = np.searchsorted(begin, window + 2 * PART - 1, "right") - 1  # a window may begin before its text
                found = np.unique(np.stack([bucket.item[entry], text, window - bucket.place[entry]], axis=1), axis=0)
                for k, d, s in found.tolist():  # the window that meets need not be the one that matches
                    slack = self.items[k].edits + n
                    out.setdefault(k, []).append((d, s - slack, s + slack))
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word, end word, edits): the best place of each item in each text."""
        get = self.vocab.get
        found = [[get(w, 0) for w in words(t)] for t in texts]
        gap = [0] * (2 * PART)
        flat: list[int] = []
        starts = []
        for f in found:
            starts.append(len(flat))
            flat += f
            flat += gap
        if not flat or not self.items:
            return []
        ids = np.array(flat, np.int64)
        pairs = self._pairs(ids)
        begin = np.array(starts)
        end = begin + np.array([len(f) for f in found])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, stretches in self.candidates(ids, begin).items():
            item = self.items[k]
            n = len(item.ids)
            done: tuple[int, int] = (-1, 0)  # the last text looked at and how far
            for d, lo, hi in sorted(stretches):
                lo = max(lo, int(begin[d]), done[1] if done[0] == d else 0)
                done = (d, max(lo, min(hi + 1, int(end[d]))))
                for first in range(lo, done[1], 2 * n):
                    last = min(first + 2 * n, done[1])
                    if not item.possible(pairs[first : min(last + n + item.edits, end[d]) - 1]):
                        continue
                    least = self._starts(item.ids, ids[first : min(last + n + item.edits, end[d])], item.edits)[: last - first]
                    if least.min() <= item.edits:
                        s = first + int(least.argmin())
                        edits, length = self._distance(item.ids, ids[s : min(s + n + item.edits, end[d])], item.edits)
                        new = (edits, int(s - begin[d]), int(s - begin[d]) + length)
                        best[d, k] = min(best.get((d, k), new), new)
        return sorted((d, self.items[k].item_id, s, e, edits) for (d, k), (edits, s, e) in best.items())


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Items in order of their ids, in blocks of at most BLOCK_WORDS words (or one item); read one partition at a time."""
    held, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        n = len(words(row["text"]))
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, first_word, end_word, edits): each item found in each document, at its best place."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, item_id long, first_word int, end_word int, edits int"
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(items.select(F.col("item_id").cast("long"), "text").dropna()):
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block], similarity))  # built once, its size bound by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ready = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    hits = ready.find(batch.column(1).to_pylist())
                    if hits:
                        d, *rest = zip(*hits)
                        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                        cols = [batch.column(0).take(pa.array(d))] + [pa.array(c, t) for c, t in zip(rest, types)]
                        yield pa.RecordBatch.from_arrays(cols, names=[id_col, "item_id", "first_word", "end_word", "edits"])

        out = out.union(texts.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are; decided row by row, without a join."""
    spark = docs.sparkSession
    columns = docs.columns
    place = columns.index(text_col)
    for block in _blocks(items.select(F.col("item_id").cast("long"), "text").dropna()):
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block], similarity))  # built once, its size bound by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ready = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    hit = {h[0] for h in ready.find(batch.column(place).to_pylist())}
                    yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
