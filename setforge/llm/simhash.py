"""SimHash near-duplicates through deletion variants of few segments.

A fingerprint of 64 bits is cut into three segments. Two fingerprints that differ in at most four bits have a segment
in which they differ in at most one, so they share that segment with one position blanked out. Each distinct
fingerprint is indexed under all its 64 one-wildcard variants, rows meet by equality of (position, rest of segment)
and are verified on all bits. Copies share a fingerprint and are one row of the index.

Rows that meet under one variant are compared in blocks, and only a spanning forest of the verified links leaves the
task: fewer links than rows. A variant with more than ``BLOCK`` fingerprints is dealt out as pairs of blocks, each
pair a group of its own, so that no task holds an unbounded group.

Null text and text without words have fingerprint zero and are linked like any other. Repeated rows get the same
component. Rows with a null id keep a null id and count as larger than any other. An empty table gives no rows.
Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import drop_stored, stored
from setforge.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit of each segment, and the end of the last.
CUTS = (0, 21, 42, 64)
#: With one bit blanked in each segment, the most bits at which one of them must still agree.
MOST_BITS = 2 * (len(CUTS) - 1) - 1
#: Fingerprints of one variant that are compared in one piece.
BLOCK = 4096
#: Variants over BLOCK that may be broadcast; with more, a plain join deals them.
BROADCAST_ROWS = 50_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> list[int]:
    """The hash of every shingle of a UTF-8 text, in order; of all words where there are fewer, none where there is none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer: a bit is 1 if it is set in over half the shingles' hashes."""
    hashes = shingles(text, shingle)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, fp the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                fp = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def _mask(lo: int, hi: int) -> int:
    """Bits lo to hi - 1 as a signed long."""
    m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return m - (1 << 64) if m >= 1 << 63 else m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segment(s: int):
    """The value of segment s, shifted to bit 0."""
    return F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_mask(CUTS[s], CUTS[s + 1]))), CUTS[s])


def _variants(fps: DataFrame, segments: int = 3) -> DataFrame:
    """(fp, key) with a key of the blanked position and the rest of its segment: 64 rows a fingerprint."""
    keys = []
    for s in range(segments):
        for w in range(CUTS[s], CUTS[s + 1]):
            rest = _segment(s).bitwiseAND(F.lit(~(1 << (w - CUTS[s]))))
            keys.append(rest.bitwiseOR(F.lit(w << 22)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _full_variants(fps: DataFrame) -> DataFrame:
    """(key, n) of the variants that hold more than BLOCK fingerprints.

    A variant's rows are those of at most two segment values, so those over half of BLOCK are looked at and no others.
    """
    counted = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(s).alias("v")) for s in range(3)])).alias("x")).groupBy("x.s", "x.v").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK // 2)
    out = None
    for s in range(3):
        wild = F.explode(F.array(*[F.lit(w) for w in range(CUTS[s], CUTS[s + 1])]))
        part = counted.filter(F.col("s") == s).select("v", "n", wild.alias("w"))
        bit = F.expr(f"shiftleft(1L, w - {CUTS[s]})")
        part = part.select(F.col("v").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(cast(w as bigint), 22)")).alias("key"), "n")
        out = part if out is None else out.union(part)
    # the half that was at or below BLOCK / 2 adds at most that much
    return out.groupBy("key").agg((F.sum("n") + F.lit(BLOCK // 2)).alias("n")).filter(F.col("n") > BLOCK)


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; no more than one row of distances is held at a time."""
    n = len(fp)
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= max_bits) + i + 1
        for r in np.unique(root[near]) if len(near) else ():
            if r != root[i]:
                j = near[root[near] == r][0]
                out.append((i, int(j)))
                root[root == r] = root[i]
    return out


def _linked(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): per group (key, pair) of ``rows`` a spanning forest of its links.

    Small groups, nearly all of them, are compared by shifting the sorted column against itself.
    """

    def emit(fp: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(fp)])
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
            part = np.unique(fp[s : s + n])
            if found := _forest(part, max_bits):
                i, j = np.array(found).T
                yield part[i].view(np.int64), part[j].view(np.int64)
        small = np.repeat(sizes <= 64, sizes)
        fp, group = fp[small], group[small]
        for shift in range(1, min(64, len(fp))):
            same = group[shift:] == group[:-shift]
            if not same.any():
                break
            at = np.flatnonzero(same)
            at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= max_bits]
            yield fp[at].view(np.int64), fp[at + shift].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        done: set[tuple[int, int]] = set()

        def out(fp: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in emit(fp, group):
                keep = a != b
                lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
                new = []
                for pair in zip(lo.tolist(), hi.tolist()):  # a link is met under several variants
                    if pair not in done:
                        if len(done) > 200_000:
                            done.clear()
                        done.add(pair)
                        new.append(pair)
                if new:
                    yield pa.RecordBatch.from_pydict({"a": [p[0] for p in new], "b": [p[1] for p in new]})

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.r_[held_fp, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
            keys = np.r_[held, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)])]
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from out(fp[:cut], keys[:cut])
            held_fp, held = fp[cut:], keys[cut:]
        if len(held_fp):
            yield from out(held_fp, held)

    dealt = rows.select("fp", "key", "pair")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: links at ``max_bits`` bits or fewer that connect what all links connect. ``fps`` holds distinct fingerprints."""
    if max_bits > MOST_BITS:
        raise ValueError(f"the segments find all links up to {MOST_BITS} bits, not {max_bits}")
    spark = fps.sparkSession
    full = stored(_full_variants(fps).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = _variants(fps)
    n_full = full.count()
    if not n_full:
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        rows = rows.join(F.broadcast(full) if n_full <= BROADCAST_ROWS else full, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
        other = F.expr("explode(case when blocks is null then array(0L) else transform(sequence(0, blocks - 1), x -> cast(x as bigint)) end)")
        rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).select("fp", "key", "own", other.alias("other"))
        rows = rows.select("fp", "key", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("pair"))
    return _linked(rows, max_bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links of ``max_bits`` bits or fewer reach."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = links(distinct.select("fp"), max_bits)
    roots = components(found)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(id_col, "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The near-duplicate classes of ``documents``, fingerprints as 16 hex digits."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
