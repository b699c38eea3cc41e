"""Prefix trie of conversations, from the Cartesian tree over the common prefixes of sorted conversations.

Every conversation is rebuilt: it takes the first h turns of the first conversation of its group of twenty, h being a hash
of its id modulo 4, then its own turns from the h-th on. A turn is a digest of role and text. Then:

1. Equal conversations are one sequence with a count. Sequences are sorted over ranges (blocks), and each has the length
   of the prefix it shares with the one before it, the LCP array.
2. Each block finds the nearest smaller values of its own array with a stack. Entries of equal value with no smaller one
   between are one node, the interval of sequences between the smaller ones. What a block can't close looks up the
   nearest block with a smaller minimum, of which one number a block is known everywhere, and joins that block's staircase
   of minima. The parts of a node in several blocks then merge.
3. A node stands for all depths between its parent's and its own, and is expanded to a row for each. Members, leaves and
   words are differences of running sums at its ends; the smallest member is a minimum over rows, blocks, and rows.

The digests of the members that end at a node are hashed from pieces that were joined by ranges of ids.

A null turn comes first; rows of one turn are in the order of role, then of the digest. Rows without a conv_id take no
part; null roles and texts are empty; repeated rows are turns of their own. No rows give no nodes. Other columns are
ignored. A conversation is one row of 16 bytes a turn, a block holds some numbers for each of its sequences, and the
ranges are told apart by the first ``RANGED`` bytes of sequences.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setforge.llm.common import crc32_sql, stored

GROUP, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest; of a sequence, those by which ranges are told apart; ids joined in one piece.
KEY, RANGED, PIECE = 16, 64 * 16, 5_000


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, words): digests of all turns of each conversation as rebuilt, and the number of words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    listed = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stored(listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")))
    first = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("first"))
    c, h = F.col("conv_id"), borrowed(F.col("conv_id"))
    head = F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", 1, 0))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    whole = own.join(first, c - c % GROUP == F.col("base"), "left").select("conv_id", F.concat(head, tail).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))


def ends(members: DataFrame) -> DataFrame:
    """(sid, ends): of each sequence the SHA-256 of the ids of its conversations, ascending, joined by commas; members: sid, conv_id."""
    joined = pa.schema([("sid", pa.string()), ("part", pa.int32()), ("nr", pa.int64()), ("ids", pa.string())])
    hashed = pa.schema([("sid", pa.string()), ("ends", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nr = TaskContext.get().partitionId(), itertools.count()

        def rows():
            for sid, of in itertools.groupby(_rows(batches), lambda r: r[0]):
                while some := ",".join(str(i) for _, i in itertools.islice(of, PIECE)):
                    yield sid, part, next(nr), some

        yield from _batched(rows(), joined, 100)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for sid, of in itertools.groupby(_rows(batches), lambda r: r[0]):
                h = hashlib.sha256()
                for k, (_, ids) in enumerate(of):
                    h.update((("," if k else "") + ids).encode())
                yield sid, h.hexdigest()

        yield from _batched(rows(), hashed)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("sid", "conv_id").repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    made = dealt.mapInArrow(pieces, "sid string, part int, nr long, ids string")
    return made.repartition(n, "sid").sortWithinPartitions("sid", "part", "nr").select("sid", "ids").mapInArrow(digests, "sid string, ends string")


def lcp(a: bytes, b: bytes) -> int:
    """Number of digests at which two sequences begin alike."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * KEY] == b[: mid * KEY] else (lo, mid)
    return lo


SORTED = "block int, at long, lcp int, len int, n long, least long, ends string, before long, leaf boolean, cum array<long>, first binary, last binary"


def lcp_array(sequences: DataFrame) -> DataFrame:
    """Stored rows (see SORTED) of sorted sequences: their place, LCP with the one before in the block (-1 for a block's
    first), turns, members, smallest member, words up to the LCP, whether no later one in the block begins with it, words up
    to each turn. A block's first and last row have their sequence."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int32()), ("at", pa.int64()), ("lcp", pa.int32()), ("len", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("before", pa.int64()), ("leaf", pa.bool_()), ("cum", longs), ("first", pa.binary()), ("last", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()

        def rows():
            held = last = None
            for at, (seq, n, least, digest, words) in enumerate(_rows(batches)):
                cum = [0, *itertools.accumulate(words)]
                alike = -1 if held is None else lcp(last, seq)
                if held:
                    yield *held[:8], alike != held[3], *held[8:], None
                held = (block, at, alike, len(words), n, least, digest, cum[max(alike, 0)], cum, seq if last is None else None)
                last = seq
            if held:
                yield *held[:8], True, *held[8:], last

        yield from _batched(rows(), schema)

    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sequences.select("seq", "n", "least", "ends", "words").repartitionByRange(parts, F.substring("seq", 1, RANGED)).sortWithinPartitions("seq")
    return stored(dealt.mapInArrow(run, SORTED))


class Blocks:
    """What is known of all blocks everywhere: a few numbers each. Blocks are numbered without gaps; sums stand before a block."""

    def __init__(self, rows: list[dict]):
        self.names = [r["block"] for r in rows]
        self.nr = {x: k for k, x in enumerate(self.names)}
        self.start = [r["start"] for r in rows] + [-1]  # LCP at its first row; nothing follows the last block
        self.known = [r["known"] for r in rows]  # words up to there
        self.low = np.array([r["low"] for r in rows], np.int64)  # its least LCP
        self.least = [np.array([r["least"] for r in rows], np.int64)]  # its smallest member; of 2, 4, 8, ... blocks from it on
        self.sums = np.cumsum([[0] * len(SUMS), *([r[c] for c in SUMS] for r in rows)], axis=0)
        while len(self.least[-1]) > (reach := 1 << (len(self.least) - 1)):
            self.least.append(np.minimum(self.least[-1][:-reach], self.least[-1][reach:]))

    def smallest(self, a: int, b: int) -> int | None:
        """The smallest member of blocks a to b - 1."""
        if a >= b:
            return None
        k = (b - a).bit_length() - 1
        return int(min(self.least[k][a], self.least[k][b - (1 << k)]))


def blocks(rows: DataFrame) -> Blocks:
    """One row a block comes to the driver: LCP with the block before it, least LCP, smallest member, sums."""
    schema = pa.schema([("block", pa.int32()), ("start", pa.int32()), ("known", pa.int64())])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for block, first, previous, cum in _rows(batches):
                start = -1 if previous is None else lcp(previous, first)
                yield block, start, cum[max(start, 0)]

        yield from _batched(found(), schema)

    ended = rows.filter("last is not null").select("block", "last")
    began = rows.filter("first is not null").select("block", "first", "cum")
    both = began.join(ended, "block").select("block", "first", F.lag("last").over(W.orderBy("block")).alias("previous"), "cum")  # a row a block
    words = F.element_at("cum", -1)
    summed = rows.groupBy("block").agg(
        F.min(F.when(F.col("at") > 0, F.col("lcp"))).alias("low"), F.min("least").alias("least"), F.sum("n").alias("n"), F.sum(F.col("n") * words).alias("words"),
        F.sum(words - F.col("before")).alias("fresh"), F.count_if("leaf").alias("leaves"), F.max(F.when(F.col("last").isNotNull(), F.col("len"))).alias("end"),
    )
    out = [r.asDict() for r in summed.join(both.mapInArrow(starts, "block int, start int, known long"), "block").orderBy("block").collect()]  # a row a block
    for r, after in itertools.zip_longest(out, out[1:]):
        r["fresh"] -= r["known"]
        r["low"] = r["start"] if r["low"] is None else min(r["low"], r["start"])
        if after and after["start"] == r["end"]:
            r["leaves"] -= 1  # the last sequence begins the next block's first
    return Blocks(out)


NODES = "kind string, block int, at long, depth int, above int, n_same long, least long, n long, words long, fresh long, leaves long, own_block int, own_at long, ref_block int, ref_at long, p_block int, q_block int, p_least long, q_least long, p_n long, p_words long, p_fresh long, p_leaves long, q_n long, q_words long, q_fresh long, q_leaves long, p_lcp int, q_lcp int, p_ref long, q_ref long, q_name int, upper int"
#: What is summed up over the sequences of a node: members, their words, words that are new in a sequence, leaves.
SUMS = ("n", "words", "fresh", "leaves")


def closed(pdf: pd.DataFrame, known: Blocks) -> list[dict]:
    """The nodes of one block: whole ones, the parts of those that go on in other blocks, and the staircases of its minima.

    kind node: (block, at) of its first sequence, depth, depth of its parent (above), n_same equal LCP values, sums;
    least its smallest member, ref the part that is its parent, or own_* unused. kind part: own_* names it; p_* and q_*
    are what stands at its left and right end, or p_block and q_block alone where those blocks' staircases have it.
    kinds left and right: steps of the staircases, at values from depth (excluded) to upper.
    """
    pdf = pdf.sort_values("at", ignore_index=True)
    block = int(pdf["block"].iloc[0])
    b = known.nr[block]
    m = len(pdf)
    heights = [known.start[b], *pdf["lcp"].tolist()[1:], known.start[b + 1]]
    length, least, n = pdf["len"].tolist(), pdf["least"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    words, before = pdf["words"].to_numpy(np.int64), pdf["before"].to_numpy(np.int64, copy=True)
    before[0] = known.known[b]
    leaf = np.array([heights[k + 1] != length[k] for k in range(m)], np.int64)
    sums = np.zeros((m + 1, 4), np.int64)
    np.cumsum(np.stack([n, n * words, words - before, leaf], axis=1), axis=0, out=sums[1:])
    to_left, to_right = np.minimum.accumulate(least), np.minimum.accumulate(least[::-1])[::-1]
    base = known.sums[b]
    following = known.names[b + 1] if b + 1 < len(known.names) else None
    rep_of, smallest, out, stack = [0] * m, {}, [], []  # smallest: of nodes closed here, by their first entry

    def between(p: int, q: int) -> dict:
        """Sums over sequences p to q - 1; words that are new in p itself are left out."""
        s = sums[q] - sums[p]
        return dict(zip(SUMS, (int(s[0]), int(s[1]), int(sums[q][2] - sums[p + 1][2]), int(s[3]))))

    def node(p: int, q: int, depth: int, above: int, same: int, low: int) -> dict:
        return {"kind": "node", "block": block, "at": p, "depth": depth, "above": above, "n_same": same, "least": low, **between(p, q), "parent": None if above < 0 else (p if heights[p] == above else q)}

    for k in range(m + 1):
        height, left, low = heights[k], k - 1 if k else None, int(least[k - 1]) if k else None
        while stack and stack[-1]["depth"] > height:
            top = stack.pop()
            low = low if top["low"] is None else top["low"] if low is None else min(low, top["low"])
            left = top["p"]
            if left is not None:
                smallest[top["rep"]] = low
                out.append(node(left, k, top["depth"], max(heights[left], height), top["same"], low))
            else:
                out.append({"kind": "part", "rep": top["rep"], "depth": top["depth"], "n_same": top["same"], "q": k})
        if stack and stack[-1]["depth"] == height:
            top = stack[-1]
            top["low"] = low if top["low"] is None else top["low"] if low is None else min(low, top["low"])
            if k < m:
                top["same"] += 1
        elif k < m:
            stack.append({"depth": height, "p": left, "rep": k, "same": 1, "low": low})
        if k < m:
            rep_of[k] = stack[-1]["rep"]
    out += [{"kind": "part", "rep": top["rep"], "depth": top["depth"], "n_same": top["same"], "p": top["p"]} for top in stack if top["depth"] >= 0]
    for k in range(m):
        above = max(heights[k], heights[k + 1])
        if length[k] > above:
            out.append(node(k, k + 1, length[k], above, 0, int(least[k])))

    def at_left(p: int) -> dict:
        s = base + sums[p]
        return {"block": block, "at": p, "p_least": int(to_right[p]), "p_n": int(s[0]), "p_words": int(s[1]), "p_fresh": int(base[2] + sums[p + 1][2]), "p_leaves": int(s[3]), "p_lcp": heights[p], "p_ref": rep_of[p]}

    def at_right(q: int) -> dict:
        """The end before place q, which may be the place behind the block."""
        s = base + sums[q]
        return {"q_least": int(to_left[q - 1]) if q else None, "q_n": int(s[0]), "q_words": int(s[1]), "q_fresh": int(s[2]), "q_leaves": int(s[3]), "q_lcp": heights[q], "q_ref": rep_of[q] if q < m else 0, "q_name": block if q < m else following}

    rows = []
    for r in out:
        if r["kind"] == "node":
            j = r.pop("parent")
            if j is not None:
                if j < m and rep_of[j] in smallest:
                    r["p_least"] = smallest[rep_of[j]]  # the parent's smallest member
                else:
                    r |= {"ref_block": block, "ref_at": rep_of[j]} if j < m else {"ref_block": following, "ref_at": 0}
            rows.append(r)
            continue
        p, q, depth = r.pop("p", None), r.pop("q", None), r["depth"]
        r |= {"own_block": block, "own_at": r.pop("rep"), "p_block": b, "q_block": b}
        if p is not None:
            r |= at_left(p)
        else:
            r["p_block"] = int(np.flatnonzero(known.low[:b] < depth)[-1])
        if q is not None:
            r |= at_right(q)
            if q == m:
                r["q_block"] = b + 1  # the entry is the next block's first; the rows are this block's
        else:
            smaller = np.flatnonzero(known.low[b + 1 :] < depth)
            if len(smaller):
                r["q_block"] = b + 1 + int(smaller[0])
            else:
                r |= dict(zip(("q_n", "q_words", "q_fresh", "q_leaves"), map(int, known.sums[-1]))) | {"q_block": len(known.low), "q_lcp": -1}
        rows.append(r)
    upper = np.iinfo(np.int32).max
    for k in range(m - 1, -1, -1):
        if heights[k] < upper:
            rows.append({"kind": "left", "p_block": b, "depth": heights[k], "upper": upper, **at_left(k)})
            upper = heights[k]
    upper = np.iinfo(np.int32).max
    for k in range(m):
        if heights[k] < upper:
            rows.append({"kind": "right", "q_block": b, "depth": heights[k], "upper": upper, **at_right(k)})
            upper = heights[k]
    return rows


def nodes(rows: DataFrame, known: Blocks) -> DataFrame:
    """(block, at, above, depth, n_same, least, n, words, fresh, leaves, parent): one row for each node of the Cartesian tree;
    parent is the smallest member of its parent's interval."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in NODES.split(", "))])

    def close(t: pa.Table) -> pa.Table:
        found = closed(t.to_pandas(), known)
        return pa.table({c: [r.get(c) for r in found] for c in schema.names}, schema=schema)

    @F.pandas_udf("long")
    def amid(a: pd.Series, b: pd.Series) -> pd.Series:
        """The smallest member of the blocks between two."""
        return pd.Series([known.smallest(x + 1, y) for x, y in zip(a, b)], dtype="Int64")

    numbers = rows.select("block", "at", "lcp", "len", "n", "least", F.element_at("cum", -1).alias("words"), "before")
    found = stored(numbers.groupBy("block").applyInArrow(close, NODES))
    whole = found.filter("kind = 'node'").select("block", "at", "above", "depth", "n_same", "least", *SUMS, F.col("p_least").alias("parent"), "ref_block", "ref_at")

    def filled(part: DataFrame, kind: str, side: str, fields: list[str]) -> DataFrame:
        """Parts whose end lies in another block, with what that block's staircase has for their depth."""
        names = [side, "depth", "upper", *fields]
        s = found.filter(F.col("kind") == kind).select(*[F.col(c).alias(f"s_{c}") for c in names])
        on = (F.col(side) == F.col(f"s_{side}")) & (F.col("s_depth") < F.col("depth")) & (F.col("depth") <= F.col("s_upper")) & F.col(fields[0]).isNull()
        return part.join(s, on, "left").withColumns({c: F.coalesce(c, f"s_{c}") for c in fields}).drop(*[f"s_{c}" for c in names])

    part = filled(found.filter("kind = 'part'").drop("upper"), "left", "p_block", ["p_lcp", "block", "at", "p_least", *[f"p_{c}" for c in SUMS], "p_ref"])
    part = filled(part, "right", "q_block", ["q_lcp", "q_least", *[f"q_{c}" for c in SUMS], "q_ref", "q_name"])
    above = F.greatest("p_lcp", "q_lcp")
    up = lambda p, q: F.when(above >= 0, F.when(F.col("p_lcp") == above, F.col(p)).otherwise(F.col(q)))
    parts = stored(
        part.select(
            "own_block", "own_at", "block", "at", above.alias("above"), "depth", "n_same", F.least("p_least", "q_least", amid("p_block", "q_block")).alias("least"),
            *[(F.col(f"q_{c}") - F.col(f"p_{c}")).alias(c) for c in SUMS], up("block", "q_name").alias("ref_block"), up("p_ref", "q_ref").alias("ref_at"),
        )
    )
    merged = parts.groupBy("block", "at", "depth").agg(F.sum("n_same").alias("n_same"), *[F.first(c).alias(c) for c in ("above", "least", *SUMS, "ref_block", "ref_at")])
    both = whole.unionByName(merged.withColumn("parent", F.lit(None).cast("long")))
    parents = parts.select(F.col("own_block").alias("ref_block"), F.col("own_at").alias("ref_at"), F.col("least").alias("of_part"))
    return both.join(parents, ["ref_block", "ref_at"], "left").select("block", "at", "above", "depth", "n_same", "least", *SUMS, F.coalesce("parent", "of_part").alias("parent"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    every = stored(rebuilt(conversations).withColumn("sid", F.substring(F.sha2("seq", 256), 1, 2 * KEY)))
    distinct = every.groupBy("sid").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    rows = lcp_array(distinct.join(ends(every), "sid"))
    tree = nodes(rows, blocks(rows)).join(rows.select("block", "at", "len", "ends", "cum"), ["block", "at"])
    # a struct for each depth, so that the words up to each turn aren't repeated for each
    depths = F.transform(F.sequence(F.col("above") + 1, F.col("depth")), lambda d: F.struct(d.alias("d"), F.when(d > 0, F.element_at("cum", d)).otherwise(0).alias("earlier")))
    each = tree.select("depth", "above", "n_same", "least", *SUMS, "parent", "len", "ends", F.element_at("cum", -1).alias("own"), F.inline(depths))
    d, deepest = F.col("d"), F.col("d") == F.col("depth")
    return each.select(
        F.col("least").alias("conv_id"),
        d.cast("long").alias("depth"),
        F.when(d > F.col("above") + 1, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(deepest, F.col("n_same") + (F.col("len") > d).cast("long")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("words") - F.col("n") * F.col("earlier") - (F.col("own") - F.col("earlier")) - F.col("fresh")).alias("saved_tokens"),
        F.when(d == F.col("len"), F.col("ends")).otherwise(F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _sql() -> str:
    """The same nodes from all prefixes of all conversations, written out."""
    turns = r"cast(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) as bigint)"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select conv_id, turn, role, substr(sha256(length(role) || ':' || role || text), 1, {2 * KEY}) as key, {turns} as words from t),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, key) as pos from k),
c as (select conv_id, {crc32_sql("cast(conv_id as varchar)")} % {SHARED} as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, o.pos, key, words from c join o on o.conv_id = c.conv_id - c.conv_id % {GROUP} and o.pos <= h
      union all select c.conv_id, 1, o.pos, key, words from c join o on o.conv_id = c.conv_id and o.pos > h),
p as (select conv_id, words, row_number() over w as depth, string_agg(key, '') over w as prefix from r window w as (partition by conv_id order by own, pos)),
m as (select conv_id, depth, prefix, words from p union all select conv_id, 0, '', 0 from c),
l as (select conv_id, max(depth) as len from m group by conv_id),
n as (select prefix, any_value(m.depth) as depth, any_value(words) as words, min(m.conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id) filter (len = m.depth), '')) as ends_sha256
      from m join l using (conv_id) group by prefix),
s as (select n.*, left(prefix, greatest(length(prefix) - {2 * KEY}, 0)) as above from n),
f as (select a.prefix, count(b.prefix) as n_children, any_value(b.prefix) is null as leaf from s a left join s b on b.above = a.prefix and b.depth > 0 group by a.prefix),
u as (select left(s.prefix, {2 * KEY} * d) as top, (n_convs - 1) * words as saved, leaf from s join f using (prefix), lateral unnest(range(0, s.depth + 1)) as x(d)),
g as (select top as prefix, cast(sum(saved) as bigint) as saved_tokens, count(*) filter (leaf) as n_leaves from u group by top)
select s.conv_id, s.depth, case when s.depth > 0 then q.conv_id end as parent_conv_id, s.n_convs, n_children, n_leaves, saved_tokens, s.ends_sha256
from s join f using (prefix) join g using (prefix) left join s q on q.prefix = s.above
"""


SQL = _sql()
