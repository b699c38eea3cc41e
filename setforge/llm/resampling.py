"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target texts.

Features are all runs of one to two consecutive words. Their probabilities are those of hashed buckets. The hash is taken
once for each distinct string, in a dictionary of all features:

1. Blocks of documents count their features, each string once a block with the documents that hold it and how often.
   A block's strings are sent to the tasks that are their homes.
2. A home has a dictionary of the strings that are dealt to it, counts each over all blocks, hashes each once, and sums up
   its counts by bucket. It keeps, for each block, buckets with their documents and counts: the per-document counts.
3. Sums of all homes give the gains of the buckets, a table of fixed size.
4. Gains are joined to the per-document counts, summed up by document in each home, then by block.

A document's weight is the floored mean of its features' gains. Documents are drawn without replacement by the largest
of weight plus Gumbel noise from a hash of the id. Ranks are ordinals over ranges of scores, so no task holds all rows.

Strings travel in packed columns, some thousands a row. A home holds the distinct ones of about ``HOME`` bytes of text;
there are as many homes as the text needs. A text of over ``BLOCK`` characters is a block of its own.

A-Z is lowered, nothing else. Words are runs of letters a-z, digits and characters beyond U+007F. Null and empty texts,
and texts without words, have no features and weight 0. Rows without an id are drawn as if it were the empty text and lose
ties; rows that repeat an id have equal noise, and repeated rows take ranks of their own. No rows give no rows; without
target texts T is 0. Other columns are ignored. Input that is no plain scan should be stored first: a task that runs again
must meet its documents in the same order.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setforge.llm.common import crc32_sql, stored, total_cores
from setforge.operators.ordinals import running

_LONGS = T.ArrayType(T.LongType())
BUCKETS, SEED = 10_000, 7
#: Draws are this share of the documents with so many words, in percent.
PERCENT, LEAST_WORDS = 25, 20
#: Characters of a block at most, unless it is one document, and its documents; bytes of text whose features share a home.
BLOCK, DOCS, HOME = 2_000_000, 1_000_000, 8_000_000

_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(text: str | None) -> list[bytes]:
    return _words((text or "").encode("utf-8", "replace").lower())  # of bytes: A-Z alone


def _packed(values: np.ndarray, kind: type) -> bytes:
    """Integers as planes of equal bytes, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(docs: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Documents of features as small numbers: the first one's distance from that of the feature before, others' from the one before."""
    begins = np.cumsum(runs) - runs
    out = np.diff(docs, prepend=0)
    out[begins] = np.diff(docs[begins], prepend=0)
    return out


def _unstepped(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    begins = np.cumsum(runs) - runs
    steps = steps.astype(np.int64)
    firsts = np.cumsum(steps[begins])
    whole = np.cumsum(steps)
    return whole + np.repeat(firsts - whole[begins], runs)


def _dictionary() -> defaultdict[bytes, int]:
    """Strings to numbers in the order in which they are first looked up."""
    out: defaultdict[bytes, int] = defaultdict()
    out.default_factory = out.__len__
    return out


class _Block:
    """Counts of the features of some documents. A feature is a pair of word numbers from 1, the second one 0 for single words."""

    def __init__(self) -> None:
        self.index, self.found, self.ids, self.size = _dictionary(), [], [], 0

    def add(self, doc_id: object, text: str | None) -> None:
        held = words(text)
        self.found.append(np.fromiter(map(self.index.__getitem__, held), np.uint64, len(held)) + np.uint64(1))
        self.ids.append(doc_id)
        self.size += len(text or "")

    def by_home(self, homes: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(home, strings, number of documents of each string, those documents (as steps), counts)."""
        if not self.index:
            return
        # one number for (first word, second word, document); BLOCK, DOCS and long documents alone keep it below 2^64
        doc_bits, bits = np.uint64(len(self.found).bit_length()), np.uint64((len(self.index) + 1).bit_length())
        first, of = np.concatenate(self.found), np.repeat(np.arange(len(self.found), dtype=np.uint64), [len(x) for x in self.found])
        second = np.append(first[1:], np.uint64(0))
        two = np.append(of[1:] == of[:-1], False)
        single = first << bits + doc_bits | of
        found = np.sort(np.concatenate([single, (single | second << doc_bits)[two]]))
        del first, second, two, single, of
        self.found.clear()
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        pairs, n = found[starts], np.diff(np.append(starts, len(found)))
        doc, feature = pairs & ((np.uint64(1) << doc_bits) - np.uint64(1)), pairs >> doc_bits
        doc = doc.astype(np.int64)
        del found, starts
        begins = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
        docs_of = np.diff(np.append(begins, len(pairs)))
        a, b = (feature[begins] >> bits).astype(np.int64), (feature[begins] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, self.index), np.uint64, len(self.index))
        hashes = np.append(np.uint64(0), hashes)  # a feature's home follows from its words'
        home = ((hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((doc[begins], home))  # by home, then by first document, so that numbers compress well
        # a string is two pieces: the first word with a space and the second, or nothing and the one word
        pieces = [b"", *(w + b" " for w in self.index), *(w + b"\n" for w in self.index)]
        before, after = np.where(b > 0, a, 0), np.where(b > 0, b, a) + len(self.index)
        ends = np.cumsum(np.bincount(home, minlength=homes))
        for h in np.unique(home).tolist():
            own = order[ends[h - 1] if h else 0 : ends[h]]
            runs = docs_of[own]
            at = np.repeat(begins[own] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            held = b"".join(itemgetter(*np.stack([before[own], after[own]], axis=1).ravel().tolist())(pieces))
            yield h, zstandard.compress(held, 3), _packed(runs, np.uint32), _packed(_steps(doc[at], runs), np.uint32), _packed(n[at], np.uint32)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many bytes of packed columns."""
    some, size = [], 0
    for row in itertools.chain(rows, [None]):
        if row is not None:
            some.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, bytes | list))
        if some and (row is None or size > most or len(some) == 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, size = [], 0


def counted(docs: DataFrame) -> DataFrame:
    """The stored dictionary, by home: for each block (ids, words) of its documents; buckets with documents and counts; (bucket, n) sums.

    ``docs`` is (id, text). Columns: block, ids, words, n_features, buckets, runs, docs, ns, sums.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // HOME))
    id_type = docs.schema["id"].dataType
    ids, longs = pa.list_(to_arrow_type(id_type)), pa.list_(pa.int64())
    base = T.StructType().add("block", "long").add("ids", T.ArrayType(id_type)).add("words", _LONGS).add("n_features", _LONGS)
    sent = T.StructType([T.StructField("home", T.IntegerType()), *base]).add("strings", "binary").add("runs", "binary").add("docs", "binary").add("ns", "binary")
    kept = T.StructType(list(base)).add("buckets", "binary").add("runs", "binary").add("docs", "binary").add("ns", "binary").add("sums", _LONGS)
    head = [("block", pa.int64()), ("ids", ids), ("words", longs), ("n_features", longs)]
    packed = [(c, pa.binary()) for c in ("runs", "docs", "ns")]
    sent_pa = pa.schema([("home", pa.int32()), *head, ("strings", pa.binary()), *packed])
    kept_pa = pa.schema([*head, ("buckets", pa.binary()), *packed, ("sums", longs)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32

        def blocks() -> Iterator[_Block]:
            b = _Block()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    for doc_id, text in zip(*(c.to_pylist() for c in some.columns)):
                        if b.ids and (b.size + len(text or "") > BLOCK or len(b.ids) == DOCS):
                            yield b
                            b = _Block()
                        b.add(doc_id, text)
            if b.ids:
                yield b

        def rows():
            for k, b in enumerate(blocks(), first):
                n = [len(x) for x in b.found]  # by_home() clears them
                yield k % homes, k, b.ids, n, [max(2 * x - 1, 0) for x in n], None, None, None, None
                for home, *columns in b.by_home(homes):
                    yield home, k, None, None, None, *columns

        yield from _batches(rows(), sent_pa)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            index, bucket_of, n_of = _dictionary(), np.zeros(1024, np.uint16), np.zeros(1024, np.int64)
            for batch in batches:
                for _, block, ids, n_words, n_features, strings, runs, docs, ns in zip(*(c.to_pylist() for c in batch.columns)):
                    if strings is None:
                        yield block, ids, n_words, n_features, None, None, None, None, None
                        continue
                    held, known = zstandard.decompress(strings).split(b"\n")[:-1], len(index)
                    at = np.fromiter(map(index.__getitem__, held), np.int64, len(held))
                    if len(index) > len(n_of):
                        bucket_of, n_of = (np.concatenate([x, np.zeros(len(index), x.dtype)]) for x in (bucket_of, n_of))
                    fresh = [zlib.crc32(held[k]) for k in np.flatnonzero(at >= known).tolist()]  # numbered in this order
                    bucket_of[known : len(index)] = np.array(fresh, np.int64) % BUCKETS
                    each = _unpacked(runs, np.uint32).astype(np.int64)
                    n_of[at] += np.add.reduceat(_unpacked(ns, np.uint32).astype(np.int64), np.cumsum(each) - each)
                    yield block, None, None, None, _packed(bucket_of[at], np.uint16), runs, docs, ns, None
            sums = np.zeros(BUCKETS, np.int64)
            np.add.at(sums, bucket_of[: len(index)], n_of[: len(index)])
            yield None, None, None, None, None, None, None, None, sums.tolist()

        yield from _batches(rows(), kept_pa)

    return stored(docs.select("id", F.col("text").cast("string")).mapInArrow(send, sent).repartition(homes, "home").mapInArrow(keep, kept))


def bucket_counts(dictionary: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets that have features; the homes' sums are added up in a task for each core first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for sums in b.column(0):
                total += sums.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"sums": [total]}, pa.schema([("sums", pa.list_(pa.int64()))]))

    sums = dictionary.filter("sums is not null").select("sums").coalesce(total_cores(dictionary.sparkSession)).mapInArrow(add, "sums array<long>")
    return sums.select(F.posexplode("sums").alias("bucket", "n")).filter("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket, from the dictionaries of documents and target."""
    s, t = (bucket_counts(d).withColumnRenamed("n", c) for d, c in ((own, "s"), (target, "t")))
    every = own.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    whole = both.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t"))).scalar()
    ratio = (F.col("t") + 1) * (whole["s"] + BUCKETS) / ((F.col("s") + 1) * (whole["t"] + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs`` (id, text); ``target`` is (id, text) too."""
    dictionary = counted(docs)
    gain = np.array([r[0] for r in gains(dictionary, counted(target)).orderBy("bucket").select("gain").collect()], np.int64)  # BUCKETS numbers
    id_type = docs.schema["id"].dataType
    base = T.StructType([dictionary.schema[c] for c in ("block", "ids", "words", "n_features")])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows():
            for batch in batches:
                for block, ids, words, n_features, buckets, runs, docs, ns in zip(*(c.to_pylist() for c in batch.columns)):
                    if buckets is None:
                        yield block, ids, words, n_features, None, None
                        continue
                    each = _unpacked(runs, np.uint32).astype(np.int64)
                    g = np.repeat(gain[_unpacked(buckets, np.uint16)], each) * _unpacked(ns, np.uint32).astype(np.int64)
                    of, at = np.unique(_unstepped(_unpacked(docs, np.uint32), each), return_inverse=True)
                    sums = np.bincount(at, g).astype(np.int64)  # exact up to 2^53
                    yield block, None, None, None, _packed(of, np.uint32), _packed(sums, np.int64)

        first = next(batches, None)
        if first is not None:
            batches = itertools.chain([first], batches)
            schema = pa.schema([*list(first.schema)[:4], ("docs", pa.binary()), ("sums", pa.binary())])
            yield from _batches(rows(), schema)

    def by_document(t: pa.Table) -> pa.Table:
        ids = words = n_features = None
        parts = []
        for _, i, w, n, docs, sums in zip(*(c.to_pylist() for c in t.columns)):
            if docs is None:
                ids, words, n_features = i, w, np.array(n, np.int64)
            else:
                parts.append((_unpacked(docs, np.uint32), _unpacked(sums, np.int64)))
        out = np.zeros(len(ids), np.int64)
        for docs, sums in parts:  # a document stands once in each
            out[docs] += sums
        mean = out // np.maximum(n_features, 1)
        return pa.table([pa.array(ids, t.schema.field("ids").type.value_type), pa.array(words, pa.int64()), pa.array(n_features), pa.array(mean)], names=["id", "n_words", "n_features", "weight"])

    rows = dictionary.filter("block is not null").drop("sums").mapInArrow(summed, T.StructType(list(base)).add("docs", "binary").add("sums", "binary"))
    return rows.groupBy("block").applyInArrow(by_document, T.StructType().add("id", id_type).add("n_words", "long").add("n_features", "long").add("weight", "long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for those that are not drawn."""
    pair = lambda df, i, t: df.select(i.alias("id"), F.col(t).cast("string").alias("text"))
    made = weights(pair(docs, F.col(id_col), text_col), pair(target, F.lit(None).cast("long"), target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(made.withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least)
    draws = able.count() * percent // 100
    ranked = running(able, [], [F.desc("score"), F.asc_nulls_last("id")], {"rank": F.lit(1)})
    rank = F.when(F.col("rank") <= draws, F.col("rank"))
    every = ranked.withColumn("rank", rank).unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def _counted_sql(table: str, name: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""{name}w as (select *, {words} as w from {table}),
{name}f as (select nr, n_words, unnest(w || list_transform(range(1, n_words), lambda i: w[i] || ' ' || w[i + 1])) as f from (select row_number() over () as nr, w, len(w) as n_words from {name}w))"""


SQL = f"""
with dd as (select row_number() over () as nr, doc_id, text from documents),
{_counted_sql("dd", "d").replace("select row_number() over () as nr, w,", "select nr, w,")},
{_counted_sql("benchmark", "b")},
fd as (select f, count(*) as n from df group by f),
fb as (select f, count(*) as n from bf group by f),
x as (select f, {crc32_sql("f")} % {BUCKETS} as bucket from (select f from fd union select f from fb)),
s as (select bucket, sum(n) as n from fd join x using (f) group by bucket),
t as (select bucket, sum(n) as n from fb join x using (f) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double
        / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double))) as bigint) as gain from s left join t using (bucket)),
m as (select nr, count(*) as n_features, cast(sum(gain) as bigint) as total from df join x using (f) join g using (bucket) group by nr),
w as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(cast(floor(total / n_features) as bigint), 0) as weight,
        cast(('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as h from dw left join m using (nr)),
v as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) as score from w),
r as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id nulls last) as k, count(*) filter (n_words >= {LEAST_WORDS}) over () as n from v)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and k <= n * {PERCENT} // 100 then k end as rank from r
"""
