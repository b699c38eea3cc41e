"""Near copies by SimHash fingerprints and deletion variants of their segments: candidates, exact Jaccard check, components.

As in :mod:`setforge.llm.simhash` a fingerprint of 64 bits is cut into three segments, and rows meet by equality of a
segment with a part blanked out. Texts that share 0.8 of their 5-word shingles differ in 15 % of the bits, too many for
one fingerprint with one bit blanked. So a text has ``PRINTS`` fingerprints over its set of shingles, and a third of a
segment (seven or eight bits) is blanked: by the angle of such sets, 0.148 to 0.152 of pi, a pair of similarity 0.8
shares a variant of a fingerprint with probability 0.56, of any of the six with 0.993; at 0.85 it is 0.999.

Rows that meet are verified on all bits of the fingerprint and of the next one: those with no other row within ``BITS``
of 128 leave the group. Texts with equal sets are one row of the index. Groups with the same texts are looked at once,
through 128 bits of their hashes. Within a group the components are searched breadth first, each text against those not
yet reached, by the exact similarity of sets of 32-bit hashes, and a spanning forest leaves the task. A group with more
than ``BLOCK`` texts is dealt out as pairs of blocks.

Null texts and texts without words have the empty set and are linked; shorter texts than a shingle have one. Words, and
rows without an id or repeated, are treated as in :mod:`setforge.llm.simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import stored
from setforge.llm.components import components
from setforge.llm.simhash import CUTS, shingles

SHINGLE, SIMILARITY = 5, 0.8
PRINTS, SEED = 6, 42
#: Differing bits of two fingerprints up to which rows that meet are candidates: 17 is the mean at 0.8, 57 of unlike texts.
BITS = 36
#: Texts of one group that are compared in one piece, and rows up to which a group is compared by shifting.
BLOCK, SMALL = 2048, 64
_odd = np.random.default_rng(SEED).integers(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)
_mix = np.uint64(0x9E3779B97F4A7C15)


def _kept_bits() -> list[int]:
    """The bits that each variant keeps: of every segment with one of its thirds blanked."""
    out = []
    for lo, hi in zip(CUTS, CUTS[1:]):
        ends = [lo + (hi - lo) * k // 3 for k in range(4)]
        out += [((1 << hi) - (1 << lo)) & ~((1 << b) - (1 << a)) for a, b in zip(ends, ends[1:])]
    return out


_kept = np.array(_kept_bits(), np.uint64)


def prints(hashes: np.ndarray) -> np.ndarray:
    """The PRINTS SimHash fingerprints of a set of 64-bit hashes: a bit is 1 if it is set in over half the mixed hashes."""
    over = np.zeros(PRINTS * 64, np.int64)
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ _odd) * _mix
        x = (x ^ (x >> np.uint64(32))) * _odd
        x ^= x >> np.uint64(29)
        over += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(over * 2 > len(hashes), bitorder="little").view(np.uint64)


def variants(found: np.ndarray) -> np.ndarray:
    """The keys of the variants of rows of fingerprints, (rows, PRINTS, 9)."""
    place = np.arange(PRINTS * len(_kept), dtype=np.uint64).reshape(PRINTS, len(_kept)) + np.uint64(1)
    key = ((found[:, :, None] & _kept) ^ (place * _mix)) * _mix
    return (key ^ (key >> np.uint64(29))) * _odd[0]


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, node, set, prints) of every row, node a hash of the set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [np.unique(np.array(shingles(t, shingle), np.uint64)) for t in batch.column(1).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64).view(np.int64)
                sets = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in found]
                keys = [prints(h).view(np.int64) for h in found]
                cols = [batch.column(0), pa.array(node), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "node", "set", "prints"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {id_type}, node long, set binary, prints array<long>")


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, without repeats) that are as similar as that."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    starts = np.r_[0, np.cumsum(size)]
    at = [flat[starts[k] : starts[k + 1]] for k in range(len(sets))]
    left, out, queue = np.arange(len(sets)), [], []
    held, bounds = flat, starts[:-1]  # of the rows in left
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            bounds = bounds[1:]
            if not len(left):
                break
        k = queue.pop()
        marks[at[k]] = True
        sums = np.r_[0, np.cumsum(marks[held])]
        common = sums[bounds + size[left]] - sums[bounds]
        marks[at[k]] = False
        near = common >= similarity * (size[left] + size[k] - common) - 1e-9
        if near.any():
            new = left[near].tolist()
            out += [(k, j) for j in new]
            queue += new
            left = left[~near]
            if len(left):
                held = np.concatenate([at[j] for j in left])
                bounds = np.r_[0, np.cumsum(size[left])[:-1]]
    return out


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): per group (band, pair) of ``rows`` (node, band, pair, set) a spanning forest of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        key = None

        def out() -> Iterator[pa.RecordBatch]:
            nodes = list(held)
            if found := forest(list(held.values()), similarity) if len(nodes) > 1 else []:
                a, b = (np.array([nodes[p[x]] for p in found], np.int64) for x in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for node, band, pair, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != (band, pair):
                    yield from out()
                    held, key = {}, (band, pair)
                held[node] = np.frombuffer(s, np.uint32)
        yield from out()

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("node", "band", "pair", "set").repartition(n, "band", "pair").sortWithinPartitions("band", "pair")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_rows(key: np.ndarray, prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which rows, sorted by key, have another one of their key within that many bits. ``prints``: (rows, words)."""
    def far(a, b):
        return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)

    near = np.zeros(len(key), bool)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for i in range(s, s + n):  # near copies of a row are told by it, however many there are
            if not near[i]:
                met = np.flatnonzero(far(slice(i, i + 1), slice(s, s + n)) <= bits) + s
                near[met] = len(met) > 1
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for shift in range(1, SMALL):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        met = at[far(at, at + shift) <= bits]
        near[met] = near[met + shift] = True
    return near


def met(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, band): texts (node, prints, without repeats) that share a variant, band, with one within ``bits`` of them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = np.array(b.column(1).to_pylist(), np.int64).view(np.uint64)
                each = (b.num_rows, PRINTS, len(_kept))
                cols = [np.broadcast_to(b.column(0).to_numpy()[:, None, None], each), variants(found).view(np.int64)]
                cols += [np.broadcast_to(np.roll(found, -k, axis=1).view(np.int64)[:, :, None], each) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in cols], names=["node", "band", "f", "g"])

    def out(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(pieces)
        near = near_rows(rows[:, 1], rows[:, 2:].view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(rows[near, k]) for k in (0, 1)], names=["node", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                rows = np.column_stack([c.to_numpy() for c in b.columns])
                cut = int(np.searchsorted(rows[:, 1], rows[-1, 1]))
                if held and (cut or held[-1][-1, 1] != rows[-1, 1]):
                    yield from out([*held, rows[:cut]])
                    held = []
                elif cut:
                    yield from out([rows[:cut]])
                held.append(rows[cut:])
        if held:
            yield from out(held)

    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select("node", "prints").mapInArrow(deal, "node long, band long, f long, g long")
    return rows.repartition(n, "band").sortWithinPartitions("band").mapInArrow(run, "node long, band long")


def links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) with a < b: links that connect what all links of candidates connect. ``sets``: node, set, prints, rows repeated or not."""
    rows = stored(met(sets.groupBy("node").agg(F.first("prints").alias("prints"))))
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"x{k}") for k in (0, 1)]
    groups = rows.groupBy("band").agg(F.count("*").alias("n"), *same).filter("n > 1")
    groups = groups.groupBy("n", "x0", "x1").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = stored(rows.join(groups, "band").select("node", "band", "blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    members = members.select("node", "band", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    members = members.select("node", "band", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("pair"))
    some = sets.groupBy("node").agg(F.max("set").alias("set"))  # summed up before the shuffle, however many copies a text has
    return _linked(members.join(some, "node"), similarity)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(id, component_id): component_id is the smallest id that links of ``similarity`` or more reach."""
    sets = stored(_sets(docs, id_col, text_col, shingle))
    roots = components(links(sets, similarity))
    distinct = sets.groupBy("node").agg(F.min(id_col).alias("least"))
    labelled = stored(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(least, "root").select("node", "component_id")
    return sets.select(id_col, "node").join(of, "node").select(id_col, "component_id")
