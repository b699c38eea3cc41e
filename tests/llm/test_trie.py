"""The conversation trie against all prefixes written out, over one block and over many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from setforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, lcp int, block int"


def plain(rows):
    """All nodes from the definition; rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, role, key), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        group = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = turns.get(group, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, saved, leaves = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(whole[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = trie.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_over_blocks(spark, parts):
    """Shared beginnings of all kinds: copies, prefixes of others, deep chains, and intervals over several blocks."""
    rng = random.Random(parts)
    rows = []
    for c in range(240):
        n = rng.choice([0, 1, 2, 3, 5, 9]) if c % 20 else 4
        same = rng.randrange(3)
        for k in range(n):
            text = f"turn {k} " * (k + 1) if same == 0 else f"{same} {k % 2}" if same == 1 else f"own {rng.randrange(3)}"
            rows.append((c, k, "user" if k % 2 else "assistant", text))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_odd_conversations(spark):
    long = "word " * 50_000
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, None, "user"),  # nulls, repeated rows, ties
        (1, 5, "a", long), (1, None, "a", long + "x"), (21, 0, "a", " \t\n\x0b\x0c\r "), (22, 0, "a", "b c d"), (None, 1, "a", "b"), (None, None, None, None),
        (-5, 0, "a", "b"), (-5, 1, "a", "b"), (-40, 1, "a", "b"), (2, 1, "us", "erx"), (2, 2, "user", "x"), (3, 1, "user", "x"), (2**62, 1, "a", "b"),
        *((7, k, "a", f"t{k}") for k in range(300)), *((27, k, "a", f"t{k}") for k in range(299)),  # a long chain and its beginning
    ]
    check(spark, rows)


def test_turnless_conversations(spark):
    """Ids whose conversation is all borrowed from one that isn't there."""
    rows = [(c, 0, "a", "b") for c in range(100, 120)]
    check(spark, rows)
    check(spark, rows[1:])


def test_no_conversations(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1)], SCHEMA)).count() == 0


def test_ends_of_many_members(spark, monkeypatch):
    """Ids are joined in pieces over ranges, in order."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [("s", 1000 - k) for k in range(100)] + [("t", -3)]
    got = {r.sid: r.ends for r in trie.ends(spark.createDataFrame(rows, "sid string, conv_id long")).collect()}
    assert got == {"s": hashlib.sha256(",".join(map(str, range(901, 1001))).encode()).hexdigest(), "t": hashlib.sha256(b"-3").hexdigest()}


def test_lcp():
    a = bytes(range(160))
    for n in range(11):
        b = a[: 16 * n] + b"\xff" * (160 - 16 * n)
        assert trie.lcp(a, b) == trie.lcp(b, a) == n
        assert trie.lcp(a, a[: 16 * n]) == n
