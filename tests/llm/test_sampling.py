"""Importance resampling and mixing against plain versions; odd rows, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from setforge.llm import mixing, resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)[0]))
    for text in target:
        t.update(map(bucket, plain_features(text)[0]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    out = []
    for i, text in docs:
        f, words = plain_features(text)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def small_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 3000)
    monkeypatch.setattr(resampling, "HOME", 20_000)


def test_resampling_of_documents(spark, small, monkeypatch):
    small_blocks(monkeypatch)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resample(small, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    docs, target = [(r.doc_id, r.text) for r in small.collect()], [r.text for r in bench.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target)


def test_resampling_of_odd_rows(spark, odd, none, monkeypatch):
    small_blocks(monkeypatch)
    more = spark.createDataFrame([(100 + k, f"Ä {k} näïve Straße 1a2B x_y {chr(0x1F389)} " * (k % 7)) for k in range(40)] + [(100, None), (None, "z " * 30), (101, "again " * 25)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", F.lit(1).alias("weight"), F.lit(2).alias("home"), F.lit(3).alias("block")).unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("näïve Straße",), (None,), ("",)], "text string")
    got = resampling.resample(docs, target)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], ["näïve Straße", None, ""])
    assert resampling.resample(none, target).count() == 0
    without = resampling.resample(more, target.limit(0))
    assert sorted(map(tuple, without.collect()), key=repr) == plain_resample([(r.doc_id, r.text) for r in more.collect()], [])


def test_packing():
    import numpy as np

    for kind in (np.uint16, np.uint32, np.int64):
        v = np.array([0, 1, 255, 256, 65535, 7], kind)
        assert (resampling._unpacked(resampling._packed(v, kind), kind) == v).all()
        assert len(resampling._unpacked(resampling._packed(v[:0], kind), kind)) == 0


def plain_targets(sizes):
    """Targets by resharing, over and over, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over
        if len(capped) == len(names):
            return {s: float(3 * sizes[s]) for s in names}


def check_mix(rows, got):
    """rows: (doc_id, text, source); got: rows of the report."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = plain_targets(sizes)
    exp = sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), sizes[s], target[s]) for i, text, s in rows), key=repr)
    found = sorted(((r.doc_id, r["size"], r.source_size, r.target) for r in got), key=repr)
    assert [x[:3] for x in found] == [x[:3] for x in exp]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in exp])
    assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0 for r in got)
    return target


def test_mixing_of_small_and_large_sources(spark):
    """Caps that others' excess pushes further sources to; a hot source; null and empty ones."""
    rows = [(k, "w " * (1 + k % 9), ["a", "b", "c", "d", None, "e"][0 if k % 3 else k % 6]) for k in range(6000)]
    rows += [(10_000 + k, "x y z", f"s{k % 40}") for k in range(80)] + [(20_000, "", "empty"), (20_001, None, "empty"), (20_002, " \x0b", "nbsp")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.report(df).collect()
    target = check_mix(rows, got)
    taken = Counter()
    of = {i: s for i, _, s in rows}
    for r in got:
        taken[of[r.doc_id]] += r.taken
    for s, t in target.items():
        if t > 1000:
            assert abs(taken[s] - t) < 0.08 * t
    assert sorted(map(tuple, mixing.report(df.repartition(7)).collect())) == sorted(map(tuple, got))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r.doc_id: r.taken // r["size"] for r in got if r.taken}


def test_mixing_of_odd_rows(spark, odd, none):
    df = odd.withColumn("source", F.when(F.col("doc_id") > 3, "s").when(F.col("doc_id").isNull(), "").otherwise(F.lit(None)))
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    check_mix(rows, mixing.report(df).collect())
    assert mixing.report(none).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.report(nothing).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("sizes", [[5], [1, 1000], [10, 10, 10], [1, 2, 3, 1000, 5000, 7], [0, 4], [3, 100, 3, 100, 1, 1, 1, 1, 900]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k:02d}", n) for k, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets({f"s{k:02d}": n for k, n in enumerate(sizes)}))
