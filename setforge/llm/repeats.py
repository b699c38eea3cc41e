"""Passages that repeat across documents, by sparse suffix arrays.

A suffix of a text is retained where the hash of its first ``HEAD`` words is the least of all that a stretch of
``LEAST`` words holds (a minimiser): equal stretches retain the same place, whatever surrounds them. Each retained
suffix answers for the stretches that chose it, a range of starts around it; its context goes from the first word of
the first of them to the last word of the last one.

Suffixes with equal contexts are one entry of the array, and an entry found in several documents is repeated throughout.
The entries that share their head with others are sorted, by head and then by the words that follow: a run. Neighbours
in a run are compared word by word. Where their common beginnings are long enough, matches are extended to the left:
the entries between which every common beginning reaches the end of a stretch, and whose words before the suffix agree
back to the stretch's start, hold the same stretch. So each entry is compared with its neighbours only, once for each
of the at most 31 splits of a stretch by the suffix, and no pairs are formed.

A task holds one run of up to ``RUN`` entries. Longer ones (a passage that very many documents share, each with text of
its own around it) are not sorted: the fingerprints of their stretches are grouped instead, which Spark can spread and
sum up. Elsewhere 128 bits of fingerprints tell heads and contexts apart.

The result covers exactly the words in stretches of LEAST words or more that also stand in another document. Words are
what white space separates, in lower case (A-Z). Null, empty and shorter texts have none; rows that repeat a document
id count as the same document, and if their texts differ the spans of all are given. Of rows without an id those with the
same text are one document, and the result has a null id for each; ids are whole numbers above -2^62. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import scanned, stored

LEAST, HEAD = 50, 20
#: From here down are the numbers of documents without an id.
UNNAMED = -(1 << 62)
#: Heads a stretch holds.
SPAN = LEAST - HEAD + 1
#: Entries of a run that one task sorts.
RUN = 1024
_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(2 * n, _BASE, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step)
            step[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(step)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Prints:
    """Fingerprints of any stretch of one text's words."""

    def __init__(self, text: bytes):
        digest = xxhash.xxh64_intdigest
        codes = np.array([digest(w) for w in text.lower().split()], np.uint64)
        self.n = len(codes)
        up, self.down = _powers.to(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def suffixes(p: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, first start, last start) of the retained suffixes of a text with LEAST words or more."""
    at = np.arange(p.n - HEAD + 1)
    heads = p.of(at, at + HEAD)
    rank = _mixed(heads ^ np.uint64(0x5851F42D4C957F2D))
    chosen = np.arange(p.n - LEAST + 1) + np.lib.stride_tricks.sliding_window_view(rank, SPAN).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    place = chosen[first]
    return heads[place], place, first, last


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _retained(docs: DataFrame) -> DataFrame:
    """(doc_id, t, head, context, spot): t is a hash of the text; a spot holds place, a and b, where stretches that start from place - a to place - b chose the suffix."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, parts = [], []
                for k, text in enumerate(batch.column(2).to_pylist()):
                    if text and len(text) >= 2 * LEAST - 1:
                        p = Prints(text)
                        if p.n >= LEAST:
                            head, place, first, last = suffixes(p)
                            rows.append(np.full(len(head), k))
                            parts.append((head, p.of(first, last + LEAST), (place << 16 | (place - first) << 8 | (place - last)).astype(np.uint64)))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    cols = [batch.column(0).take(take), batch.column(1).take(take), *(_signed(np.concatenate(x)) for x in zip(*parts))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "head", "context", "spot"])

    return docs.select("doc_id", "t", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {id_type}, t long, head long, context long, spot long")


ENTRY = "head long, context long, n long, lo {id}, hi {id}, before binary, after binary"


def _entries(texts: DataFrame) -> DataFrame:
    """The words before and after the suffix of each listed place; texts: doc_id, text, places(head, context, n, hi, spot)."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                w = whole.column(1)[k].as_py().lower().split()
                every = whole.column(2).slice(k, 1).flatten()
                for at in range(0, len(every), 2048):
                    listed = every.slice(at, 2048)
                    head, context, n, hi, spot = (listed.field(x) for x in range(5))
                    lo = whole.column(0).slice(k, 1).take(pa.array(np.zeros(len(listed), np.int64)))
                    spots = [(s >> 16, s >> 8 & 255, s & 255) for s in spot.to_pylist()]
                    before = [b" ".join(w[p - a : p]) for p, a, _ in spots]
                    after = [b" ".join(w[p : p + LEAST - b]) + b" " for p, _, b in spots]  # so every word ends with a space
                    yield pa.RecordBatch.from_arrays([head, context, n, lo, hi, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["head", "context", "n", "lo", "hi", "before", "after"])

    return texts.select("doc_id", F.col("text").cast("binary"), "places").mapInArrow(run, ENTRY.format(id=id_type))


def repeated_in_run(entries: list[tuple]) -> list[list[int]]:
    """Of each entry (lo, hi, before, after), in the order of ``after``, the numbers of words before it at which repeated stretches start."""
    before = [e[2].split() for e in entries]
    after = [e[3].split() for e in entries]
    common = []  # words that an entry shares with the one before it
    for x, y in zip([[], *after], after):
        n = 0
        for p, q in zip(x, y):
            if p != q:
                break
            n += 1
        common.append(n)
    out: list[list[int]] = [[] for _ in entries]
    for left in range(max(LEAST - max(map(len, after)), 0), max(map(len, before)) + 1):
        group, found = 0, {}
        for k in range(len(entries)):
            if common[k] < LEAST - left:
                group += 1
            if len(before[k]) >= left and len(after[k]) >= LEAST - left:
                found.setdefault((group, *before[k][len(before[k]) - left :]), []).append(k)
        for of in found.values():
            if min(entries[k][0] for k in of) != max(entries[k][1] for k in of):
                for k in of:
                    out[k].append(left)
    return out


def _compared(entries: DataFrame) -> DataFrame:
    """(head, context, far, near): ranges of repeated starts before the suffixes of an entry, from sorted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            if len(held) > 1:
                for e, lefts in zip(held, repeated_in_run([x[1:] for x in held])):
                    first = None
                    for here, following in zip(lefts, [*lefts[1:], None]):
                        first = here if first is None else first
                        if following != here + 1:
                            rows.append((key, e[0], here, first))
                            first = None
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["head", "context", "far", "near"])

        for batch in batches:
            for head, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if head != key:
                    yield from out()
                    held, key = [], head
                if not held or held[-1][0] != entry[0]:  # else a repeated row
                    held.append(tuple(entry))
        yield from out()

    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    array = entries.select("head", "context", "lo", "hi", "before", "after").repartition(n, "head").sortWithinPartitions("head", "after", "context")
    return array.mapInArrow(run, "head long, context long, far int, near int")


def _grouped(entries: DataFrame) -> DataFrame:
    """The same from fingerprints of the stretches, for runs of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows, lefts, prints = [], [], []
                for k, (before, after) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                    a = len(before.split())
                    start = np.arange(len(after.split()) + a - LEAST + 1)
                    prints.append(Prints(before + b" " + after).of(start, start + LEAST))
                    lefts.append(a - start)
                    rows.append(np.full(len(start), k))
                take = pa.array(np.concatenate(rows))
                cols = [*(c.take(take) for c in batch.columns[:4]), _signed(np.concatenate(prints)), pa.array(np.concatenate(lefts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["head", "context", "lo", "hi", "stretch", "far"])

    id_type = entries.schema["lo"].dataType.simpleString()
    split = entries.select("head", "context", "lo", "hi", "before", "after").mapInArrow(run, f"head long, context long, lo {id_type}, hi {id_type}, stretch long, far int")
    shared = split.groupBy("head", "stretch").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("head", "stretch")
    return split.filter("lo = hi").join(shared, ["head", "stretch"]).select("head", "context", "far", F.col("far").alias("near"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans of words (start, end), end exclusive, in order and apart, of the documents that have any."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna(subset=["text"]).withColumn("t", F.xxhash64("text"))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(UNNAMED) - F.shiftrightunsigned("t", 2)))
    kept = stored(_retained(docs))
    entries = kept.groupBy("head", "context").agg(F.min(F.struct("doc_id", "t", "spot")).alias("rep"), F.max("doc_id").alias("hi"))
    # a head with one entry in one document needs no more looking at
    heads = entries.groupBy("head").agg(F.count("*").alias("n"), F.min("rep.doc_id").alias("lo"), F.max("hi").alias("hi")).filter("n > 1 or lo <> hi").select("head", "n")
    entries = stored(entries.join(heads, "head").withColumn("whole", F.col("rep.doc_id") != F.col("hi")))
    place, a, b = F.shiftright("spot", 16).cast("int"), F.shiftright("spot", 8).bitwiseAND(255).cast("int"), F.col("spot").bitwiseAND(255).cast("int")
    met = stored(kept.join(entries.select("head", "context", "whole"), ["head", "context"]).select("doc_id", "head", "context", "whole", place.alias("place"), a.alias("a"), b.alias("b")))
    full = met.filter("whole").select("doc_id", (F.col("place") - F.col("a")).alias("start"), (F.col("place") - F.col("b") + LEAST).alias("end"))
    listed = entries.filter("n > 1").groupBy("rep.doc_id", "rep.t").agg(F.collect_list(F.struct("head", "context", "n", "hi", "rep.spot")).alias("places"))
    array = stored(_entries(docs.join(listed, ["doc_id", "t"])))
    found = _compared(array.filter(F.col("n") <= RUN)).union(_grouped(array.filter(F.col("n") > RUN)))
    partial = met.filter("not whole").join(found, ["head", "context"]).select("doc_id", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + LEAST).alias("end"))
    spans = full.union(partial).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"))
    reach = spans.select("doc_id", "all", scanned(F.transform("all", lambda s: s["end"]), F.greatest).alias("reach"))
    # spans begin where nothing before reaches to and end where nothing goes on
    starts = F.filter(F.transform("all", lambda s, i: F.when((i == 0) | (s["start"] > F.get("reach", i - 1)), s["start"])), lambda x: x.isNotNull())
    ends = F.filter(F.transform("reach", lambda e, i: F.when((i == F.size("all") - 1) | (F.get("all", i + 1)["start"] > e), e)), lambda x: x.isNotNull())
    return reach.select(F.when(F.col("doc_id") > UNNAMED, F.col("doc_id")).alias("doc_id"), F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per document with repeated passages their number, their words, and start:end of each."""
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return repeated(docs).select("doc_id", F.size("spans").cast("long").alias("n_passages"), words.alias("n_words"), text.alias("passages"))
