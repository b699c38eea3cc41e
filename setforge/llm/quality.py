"""Quality of texts by the perplexity of an interpolated modified Kneser-Ney model of characters.

The model counts the ``ORDER``-grams of all trusted text (labels of quality 1), and from them the continuation counts
of lower orders, the discounts and the context sums, by Spark groupings over packed 64-bit grams.

Scoring joins counts by gram. Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash; a block asks once
for each gram that occurs in it, whatever the number of its documents, the requests meet the counts in an equality join
sharded by gram, and the replies return to the block, where the probabilities are put together and summed up for each
document. So the shuffled requests follow the number of blocks and not that of characters, and the text is shuffled
once: the exchange serves both the requests and the scoring.

A document is kept if its perplexity is at most its language's ``QUANTILE`` of trusted documents. The mean over few
characters varies more than over many, so the quantile is one of standardised log-perplexities: (log p - m) / sqrt(u +
v / n) for n characters, m being the language's mean over all characters and u, v the least-squares fit to the squared
deviations. All of it comes from trusted documents that the model has not counted, as the perplexity of counted text
would be too low: one in ``HELD_OUT``, chosen by a hash of its id. Languages with fewer than ``ENOUGH`` of them take the
fit and quantile of all languages. A null or empty text has a null perplexity and isn't kept. Without any trusted text
there is no model: perplexity and threshold are null and every text with a character is kept; without any held out,
the threshold is infinite.
Repeated rows get equal results, null ids and languages are kept as they are (null is a language
of its own), and columns besides id, text and language are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setforge.llm.common import stored

#: Four characters of 16 bits fill a long; orders below leave the high bits empty, so one key tells the order as well.
ORDER = 4
BLOCK_BYTES = 20 << 20
#: Blocks that a task works on, one after the other.
BLOCKS_A_TASK = 8
#: Share of the trusted documents that is kept: the higher, the more clean and the more junk documents stay.
QUANTILE = 0.999
#: One trusted document in so many is left out of the counts and sets the thresholds instead.
HELD_OUT = 5
#: Held-out documents from which on a language has a threshold of its own.
ENOUGH = 30
#: Labels up to this number are broadcast (16 MB of ids); more are joined by shuffling both sides.
BROADCAST_LABELS = 2_000_000
BEGIN = 2
#: Characters that a task looks at in one piece.
PORTION = 1 << 20
_ONE = np.uint64(16)


def _codes(text: str) -> np.ndarray:
    """16-bit numbers of the characters after ORDER - 1 begin marks. Those beyond 16 bits share the private-use numbers, 0 and the mark give 1."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c > 0xFFFF, 0xE000 + c % 0x1900, c)
    c = np.where((c == 0) | (c == BEGIN), 1, c)
    return np.r_[np.full(ORDER - 1, BEGIN, np.uint64), c.astype(np.uint64)]


def grams(text: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ORDER-gram that ends at each character (from ``start`` to before ``end``), packed."""
    first = max(0, start - ORDER + 1)
    c = _codes(text[first:end])[start - first :]
    n = len(c) - ORDER + 1
    out = c[:n].copy()
    for k in range(1, ORDER):
        out = (out << _ONE) | c[k : k + n]
    return out


def portions(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grams of the texts in order, about PORTION at a time, long texts in pieces: (grams, the text that each is of)."""
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for start in range(0, len(text or ""), PORTION):
            held.append(grams(text, start, start + PORTION))
            rows.append(k)
            size += len(held[-1])
            if size >= PORTION:
                yield np.concatenate(held), np.repeat(rows, [len(g) for g in held])
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(rows, [len(g) for g in held])


def _suffix(g: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of grams."""
    return g & np.uint64((1 << (16 * n)) - 1)


def requests(unique: np.ndarray) -> np.ndarray:
    """All keys that the probabilities of the given ORDER-grams need: grams and contexts of every order."""
    keys = [unique, np.zeros(1, np.uint64)]  # 0 is the empty context
    for n in range(1, ORDER):
        g = _suffix(unique, n + 1)
        keys += [g >> _ONE, _suffix(unique, n)]
    return pd.unique(np.concatenate(keys))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ORDER-grams, summed up in the task as far as a million of them go."""
    held = pd.Series(dtype="int64")

    def out(s: pd.Series) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s.index.to_numpy().astype(np.uint64).view(np.int64)), pa.array(s.to_numpy(), pa.int64())], names=["g", "c"])

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            for g, _ in portions(whole.column(0).slice(at, 256).to_pylist()):
                u, c = np.unique(g, return_counts=True)
                held = held.add(pd.Series(c, index=u), fill_value=0).astype("int64") if len(held) else pd.Series(c, index=u)
                if len(held) > 1_000_000:
                    yield out(held)
                    held = held.iloc[:0]
    if len(held):
        yield out(held)


def train(trusted: DataFrame) -> tuple[DataFrame, list[list[float]], int]:
    """(table, discounts, characters): the table has key, c (count or continuation count), s and gamma (as a context).

    discounts[n - 1] are those of order n for counts of 1, 2 and more.
    """
    top = trusted.select(F.col("text").cast("string")).mapInArrow(_count_task, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    orders = [stored(top.withColumn("n", F.lit(ORDER)))]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << (16 * n)) - 1))
        orders.append(orders[-1].select(shorter.alias("g")).groupBy("g").agg(F.count("*").alias("c")).withColumn("n", F.lit(n)))
    rows = stored(orders[0].unionByName(orders[1]).unionByName(orders[2]).unionByName(orders[3]))
    seen = {(r["n"], r["k"]): r["m"] for r in rows.filter("c <= 4").groupBy("n", F.col("c").alias("k")).agg(F.count("*").alias("m")).collect()}
    discounts = []
    for n in range(1, ORDER + 1):
        m = [max(1, seen.get((n, k), 0)) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        discounts.append([min(k, max(0.0, k - (k + 1) * y * m[k] / m[k - 1])) for k in (1, 2, 3)])
    chars = rows.filter("n = 1").count()
    cut = F.element_at(F.array(*[F.array(*map(F.lit, d)) for d in discounts]), F.col("n"))
    off = F.element_at(cut, F.least(F.col("c"), F.lit(3)).cast("int"))
    # the empty context of order 1 has key 0
    contexts = rows.groupBy(F.shiftrightunsigned("g", 16).alias("key"), "n").agg(F.sum("c").alias("s"), F.sum(off).alias("taken"))
    contexts = contexts.select("key", F.col("s").cast("double").alias("s"), (F.col("taken") / F.col("s")).alias("gamma"))
    table = rows.select(F.col("g").alias("key"), "c").join(contexts, "key", "full_outer")
    return table, discounts, chars


def log_probabilities(unique: np.ndarray, keys: np.ndarray, c: np.ndarray, s: np.ndarray, gamma: np.ndarray, discounts: list[list[float]], chars: int) -> np.ndarray:
    """Natural logarithms of p(last character | those before) of packed ORDER-grams; keys are sorted and have counts, sums and weights."""

    def at(wanted: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[k] == wanted, k, -1)

    p = np.full(len(unique), 1.0 / (chars + 1))
    for n in range(1, ORDER + 1):
        g = _suffix(unique, n)
        own, ctx = at(g), at(g >> _ONE)
        count = np.where(own >= 0, c[own], 0)
        total = np.where(ctx >= 0, s[ctx], 0)
        d = np.array([0.0, *discounts[n - 1]])[np.minimum(count, 3).astype(int)]
        known = total > 0
        p = np.where(known, np.maximum(count - d, 0) / np.where(known, total, 1) + np.where(known, gamma[ctx], 1) * p, p)
    return np.log(p)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key) of all that the texts of a block need, each once; blocks come one after the other."""
    block, found = None, np.empty(0, np.uint64)

    def out() -> Iterator[pa.RecordBatch]:
        keys = np.sort(requests(found)).view(np.int64) if len(found) else np.empty(0, np.int64)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part)], names=["block", "key"])

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts, blocks = batch.column("text").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if blocks[lo] != block:
                    yield from out()
                    block, found = int(blocks[lo]), np.empty(0, np.uint64)
                for g, _ in portions(texts[lo:hi]):
                    found = pd.unique(np.concatenate([found, pd.unique(g)]))
    yield from out()


#: Repeated rows that a task holds back to count further copies of.
HELD = 1000


def combined(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, text) that repeat, once for each task (or for each of its batches, if very many repeat), with the number of ``copies``."""
    schema = T.StructType([*docs.schema, T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang", "text"]
        held: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*((*k, n) for k, n in held.items()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*names, "copies"])

        for batch in batches:
            kinds = [*batch.schema.types, pa.int64()]
            t = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")]).rename_columns([*names, "copies"])
            one = pc.equal(t.column("copies"), 1)
            yield from t.filter(one).combine_chunks().to_batches()
            for *k, n in zip(*(c.to_pylist() for c in t.filter(pc.invert(one)).columns)):
                if len(held) == HELD and tuple(k) not in held:
                    yield out()
                    held.clear()
                held[tuple(k)] = held.get(tuple(k), 0) + n
        if held:
            yield out()

    return docs.mapInArrow(run, schema)


def perplexities(docs: DataFrame, table: DataFrame, discounts: list[list[float]], chars: int, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n, perplexity) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = combined(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks / BLOCKS_A_TASK))
    dealt = dealt.repartition(tasks, "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_ask, "block long, key long")
    replies = asked.join(table, "key").select("block", "key", "c", "s", "gamma")

    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        keys = model.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        cols = [np.nan_to_num(model.column(x).to_numpy().astype(float))[order] for x in ("c", "s", "gamma")]
        keys = keys[order]
        column = texts.column("text")
        n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
        for at in range(0, len(column), 256):
            for g, rows in portions(column.slice(at, 256).to_pylist()):
                codes, unique = pd.factorize(g)
                logs = log_probabilities(unique, keys, *cols, discounts, chars)[codes] if len(keys) else np.zeros(len(g))
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                n[at + rows[starts]] += np.diff(np.r_[starts, len(rows)])
                total[at + rows[starts]] += np.add.reduceat(logs, starts)
        ppl = np.exp(-total / np.maximum(n, 1))
        return pa.table({"doc_id": texts.column("doc_id"), "lang": texts.column("lang"), "n": pa.array(n, pa.int64()), "perplexity": pa.array(np.round(ppl, 4), pa.float64(), mask=n == 0), "copies": texts.column("copies")})

    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, lang string, n long, perplexity double, copies long")
    return scored.select("doc_id", "lang", "n", "perplexity", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(every, lang, m, u, v, z): fit and quantile of trusted scores (lang, n, perplexity), each language's and, with every = true, those of all.

    z is exact on hundredths. Languages with fewer than ENOUGH scores have no row.
    """
    y, n = F.log("perplexity"), F.col("n").cast("double")
    some = scores.filter("perplexity is not null").select("lang", n.alias("n"), y.alias("y"))
    both = some.withColumn("every", F.lit(False)).unionByName(some.select("n", "y", F.lit(None).cast("string").alias("lang"), F.lit(True).alias("every")))
    key = ["every", "lang"]
    joined = lambda df, other: df.join(F.broadcast(other.withColumnsRenamed({k: f"__{k}" for k in key})), (F.col("every") == F.col("__every")) & F.col("lang").eqNullSafe(F.col("__lang"))).drop("__every", "__lang")
    means = both.groupBy(*key).agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("m"), F.count("*").alias("many")).filter((F.col("many") >= ENOUGH) | F.col("every")).drop("many")
    square = F.pow(F.col("y") - F.col("m"), 2)
    sums = joined(both, means).groupBy(*key, "m").agg(F.sum("n").alias("w"), F.count("*").alias("k"), F.sum(1 / F.col("n")).alias("x"), F.sum(F.col("n") * square).alias("r"), F.sum(square).alias("q"))
    spread = F.col("w") * F.col("x") - F.col("k") * F.col("k")  # 0 where all texts are equally long
    slope = F.when(spread > 1e-9 * F.col("w") * F.col("x"), (F.col("w") * F.col("q") - F.col("k") * F.col("r")) / spread).otherwise(0.0)
    v = F.least(F.greatest(slope, F.lit(0.0)), F.col("r") / F.col("k"))  # neither part of the variance is negative
    fits = sums.withColumn("v", v).select(*key, "m", F.greatest((F.col("r") - F.col("v") * F.col("k")) / F.col("w"), F.lit(1e-9)).alias("u"), "v")
    z = (F.col("y") - F.col("m")) / F.sqrt(F.col("u") + F.col("v") / F.col("n"))
    bins = joined(both, fits).groupBy(*key, "m", "u", "v", F.ceil(z * 100).alias("bin")).agg(F.count("*").alias("c"))
    up, whole = W.partitionBy(*key).orderBy("bin"), W.partitionBy(*key)
    counted = bins.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(whole))
    return counted.filter(F.col("upto") >= F.col("all") * quantile).groupBy(*key, "m", "u", "v").agg((F.min("bin") / 100).alias("z"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n, perplexity, threshold, keep) of every document; labels: doc_id and quality."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    small = labels.count() <= BROADCAST_LABELS
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    with_text = docs.filter(~held_out).join(F.broadcast(trusted) if small else trusted, "doc_id", "left_semi")
    table, discounts, chars = train(with_text)
    if not chars:
        n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
        return docs.select("doc_id", "lang", n.alias("n"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (n > 0).alias("keep"))
    scores = stored(perplexities(docs, table, discounts, chars))
    fits = stored(thresholds(scores.filter(held_out).join(trusted, "doc_id", "left_semi"), quantile))
    own = fits.filter("not every").select(F.col("lang").alias("__lang"), F.struct("m", "u", "v", "z").alias("fit"))
    every = fits.filter("every").select("m", "u", "v", "z").first()  # one row
    rest = F.struct(*[F.lit(x).alias(c) for c, x in zip("muvz", every or (float("inf"), 0.0, 0.0, 0.0))])
    out = scores.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("fit", F.coalesce("fit", rest))
    f = F.col("fit")
    bar = F.round(F.exp(f["m"] + f["z"] * F.sqrt(f["u"] + f["v"] / F.greatest("n", F.lit(1)))), 4)
    return out.select("doc_id", "lang", "n", "perplexity", bar.alias("threshold"), F.coalesce(F.col("perplexity") <= bar, F.lit(False)).alias("keep"))
