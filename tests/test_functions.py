"""Column functions, parsers and profile operators."""

import hashlib
import re

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setforge.functions import hashing, paths, rules, text
from setforge.operators import admission, catalogue, profile, reports
from setforge.sources import catalog, profiles


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[1] for r in df.select("k", column(F.col("x"))).orderBy("k").collect()]


def test_names(spark):
    bad = ["", ".", "..", "a/b", "a\\b", "a\0b", "C:x", None]
    assert values(spark, paths.safe_file_name, bad) == [False] * 8 and values(spark, paths.safe_file_name, ["a.zip", ".x", "ä b"]) == [True] * 3
    assert values(spark, paths.safe_entry_name, ["a/b.rom", "/a", "a/", "a//b", "a/../b", "./a", "c:/x", "a\\b"]) == [True] + [False] * 7
    assert values(spark, paths.extension, ["/a.b/c", "/x/y.ZIP", ".hidden", "a.tar.gz"]) == ["", "ZIP", "", "gz"]
    assert values(spark, paths.stem, ["/a.b/c.d.e", ".x", "n"]) == ["c.d", ".x", "n"]
    assert values(spark, lambda c: paths.under(c, "/s"), ["/s", "/s/a", "/s-other", "/"]) == [True, True, False, False]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(min_size=1, max_size=12).filter(lambda s: "\0" not in s), min_size=1, max_size=20))
def test_safe_file_names_are_single_components(spark, names):
    for name, ok in zip(names, values(spark, paths.safe_file_name, names)):
        assert ok == (name not in (".", "..") and not set(name) & set("/\\") and not re.match("[A-Za-z]:", name))


def test_text(spark):
    assert values(spark, text.html_unescape, ["&amp;quot; &lt;a&gt; &#39;"]) == ["\" <a> '"]
    assert values(spark, text.xml_escape_attribute, ["<a & 'b' \"c\">"]) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]
    assert values(spark, text.safe_name, ["..a b/c--", "ok", "###"]) == ["a_b_c", "ok", "_".strip("_")]
    assert values(spark, text.truncated and (lambda c: text.truncated(c, 5)), ["abcdef", "abc"]) == ["ab...", "abc"]
    assert values(spark, text.url_segment, ["a b/ä~", None]) == ["a%20b%2F%C3%A4~", None]
    assert values(spark, text.json_string, ['a"b\n']) == ['"a\\"b\\n"']


@pytest.mark.parametrize("bad", ["abc", "zz", None])
def test_hex_is_strict(spark, bad):
    assert bytes(values(spark, lambda c: text.from_hex(c, "x"), ["00fF"])[0]) == b"\x00\xff"
    with pytest.raises(Exception, match="not hex"):
        values(spark, lambda c: text.from_hex(c, "x"), [bad])


def test_digests(spark):
    assert bytes(values(spark, hashing.xxh3_64, [b"abc"], "binary")[0]) == xxhash.xxh3_64_digest(b"abc")
    with pytest.raises(Exception, match="has 3 bytes"):
        values(spark, lambda c: text.checked_sha1(c, F.lit("row")), [b"abc"], "binary")
    sha = hashlib.sha1(b"abc").hexdigest()
    assert values(spark, lambda c: text.verified_sha1(F.lit(sha), c), [sha.upper(), "", None]) == [True] * 3
    with pytest.raises(Exception, match="mismatch"):
        values(spark, lambda c: text.verified_sha1(F.lit(sha), c), ["00"])


def test_categories(spark):
    names = ["sha1_block", "__x64_sys_read", "entry_SYSCALL_64", "std::thread::spawn", "zip::Inflate", "nothing", "XXHash"]
    assert values(spark, rules.category, names) == ["Hashing", "Disk I/O", "Syscall", "Disk I/O", "Archive/Compression", "Other", "Hashing"]


PERF = """my app 10/11 [003] 12.5: cycles:
\tffff leaf+0x10 (/lib/a.so)
\tfff0 mid<T>::f+0x1 (b (c).so)
\tffe0 root (d)

main 7 13.0: cycles:
\tffff leaf+0x10 (/lib/a.so)
\tffe0 root+ab (d)

broken header
\tffff x (y)

old 1 1.0: c:
\taaaa lost (d)
new 2 2.0: c:
\tbbbb kept (d)

empty 3 3.0: c:
"""

SVG = "<svg><title>all (1,000 samples, 100%)</title><title>f &lt;g&gt; (x) (1,234 samples, 12.50%)</title><title>g (5 samples, 0.40%)</title><title>nonsense</title><title>__x64_sys_read (9 samples, 3.00%)</title></svg>"


def test_samples_and_reports(spark, tmp_path):
    (tmp_path / "perf.txt").write_text(PERF)
    s = profiles.read_samples(spark, str(tmp_path / "perf.txt"))
    rows = sorted((r.comm, r.tid, r.time, tuple(r.stack)) for r in s.collect())
    assert rows == [("main", 7, 13.0, ("leaf", "root")), ("my app", 11, 12.5, ("leaf", "mid<T>::f", "root")), ("new", 2, 2.0, ("kept",))]
    leaf = profile.with_leaf(s)
    assert [(r.function, r.n) for r in profile.top_functions(leaf).collect()] == [("leaf", 2), ("kept", 1)]
    assert {(r.caller, r.callee): r.n for r in profile.callee_edges(s).collect()} == {("root", "leaf"): 1, ("mid<T>::f", "leaf"): 1, ("root", "mid<T>::f"): 1}
    t = profile.timeline(leaf, "time", "function", 10).orderBy("bucket").collect()
    assert [r.n for r in t] == [1] + [0] * 8 + [2] and t[0].mode == "kept" and t[1].mode is None
    assert [r.n for r in profile.timeline(leaf.filter("tid = 7"), "time", "function", 3).orderBy("bucket").collect()] == [1, 0, 0]
    assert profile.thread_breakdown(s.limit(0)).count() == 0


def test_frames_and_diff(spark, tmp_path):
    (tmp_path / "a.svg").write_text(SVG)
    f = profiles.read_frames(spark, str(tmp_path / "a.svg"))
    assert sorted((r.name, r.samples, r.percent) for r in f.collect()) == [("__x64_sys_read", 9, 3.0), ("f <g> (x)", 1234, 12.5), ("g", 5, 0.4)]
    assert [r.name for r in profile.frame_top(f).collect()] == ["f <g> (x)", "__x64_sys_read"]
    assert [r.syscall for r in profile.frame_syscalls(f).collect()] == ["read"] and profile.frame_search(f, "").count() == 3
    frame = "name string, percent double, seq long"
    before = spark.createDataFrame([("a", 5.0, 0), ("a", 2.0, 1), ("b", 1.0, 2), ("same", 1.0, 3)], frame)
    after = spark.createDataFrame([("a", 4.0, 0), ("new", 1.5, 1), ("new", 0.5, 2), ("same", 1.004, 3)], frame)
    d = profile.frame_diff(before, after)
    assert sorted((r.name, r.before, r.after, r.delta) for r in d.collect()) == [("a", 2.0, 4.0, 2.0)] * 2 + [("b", 1.0, 0.0, -1.0)] + [("new", 0.0, 0.5, 0.5)] * 2
    assert tuple(profile.diff_totals(d).first()) == (5.0, -1.0, 5)


@pytest.mark.parametrize("most", [1, 30, 1000])
def test_edges_of_keys_that_are_dealt_out(spark, most):
    rows = [(k % 3 if k % 5 else 0, None if k < 2 else (k * k) % 97, k, f"f{k}" if k % 11 else None) for k in range(120)] + [(9, 5, 500, "alone")]
    got = profile.sequence_edges(spark.createDataFrame(rows, "tid int, t int, seq int, f string"), "tid", ["t", "seq"], "f", most)
    exp = []
    for tid in {r[0] for r in rows}:
        f = [r[3] for r in sorted((r for r in rows if r[0] == tid), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        exp += [(a, b) for a, b in zip(f, f[1:]) if a is not None]
    assert sorted(((r.caller, r.callee) for r in got.collect()), key=repr) == sorted(exp, key=repr)


def test_catalogue_steps(spark):
    g = spark.createDataFrame([(1, "p", None, 1, None), (2, "c", "p", 1, None), (3, "c", "p", 2, None)], "id long, name string, clone_of string, data_file_id long, parent_id long")
    assert {r.id: r.parent_id for r in catalogue.parent_links(g).collect()} == {1: None, 2: 1, 3: None}
    u = catalogue.unique_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, n string"), F.col("n"), ["k"])
    assert [r.unique_name for r in u.orderBy("k").collect()] == ["a", "a_2", "b"]
    long = catalogue.unique_names(spark.createDataFrame([(k, "n" * 80 if k < 12 else None if k == 12 else "") for k in range(14)], "k int, n string"), F.col("n"), ["k"])
    assert [r.unique_name for r in long.orderBy("k").collect()] == ["n" * 80, *["n" * 78 + f"_{k}" for k in range(2, 10)], *["n" * 77 + f"_{k}" for k in (10, 11, 12)], "rom", "rom_2"]


def test_admission(spark, tmp_path):
    (tmp_path / "c.txt").write_text("metadata|archive|one|f.zip|0|0|text | not split\n".replace(" | ", " - ") + "curated|direct|two|g|1|0|e\n")
    c = catalog.read_catalog(spark, str(tmp_path / "c.txt"))
    assert admission.selected_catalog(c, "metadata").count() == 1 and admission.selected_catalog(c, "curated").count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.metadata.json").write_text('{"metadata":{"licenseurl":"http://CreativeCommons.org/publicdomain/zero/1.0/"},"files":[{"name":"f.zip","sha1":"aa"}]}')
    (tmp_path / "m" / "two.metadata.json").write_text('{"metadata":{"title":"Homebrew"},"files":[{"name":"g"}]}')
    m = catalog.read_metadata(spark, str(tmp_path / "m"))
    assert sorted((r.identifier, r.expected_sha1) for r in admission.checked_sources(c, m).collect()) == [("one", "aa"), ("two", "")]
    with pytest.raises(Exception, match="refused"):
        admission.checked_sources(c.withColumn("tier", F.lit("metadata")), m).collect()
    with pytest.raises(Exception, match="not listed"):
        admission.checked_sources(c.withColumn("file_name", F.lit("h")), m).collect()
    assert values(spark, admission.is_rom_name, ["a.NES", "b.txt", "nes"]) == [True, False, False]
    assert values(spark, admission.is_disallowed, ["Super Tetris 2", "pong", None]) == [True, False, False]


def test_written_reports(spark, tmp_path):
    rows = spark.createDataFrame([("g&1", "s.zip", "curated", 'r"1', 3, "aa", "bb")], "game_name string, source string, evidence_tier string, rom_name string, size long, sha1 string, md5 string")
    assert reports.write_dat(rows, ["game_name"], str(tmp_path / "d.dat"), {"name": "N & M"}) == 1
    from setforge.sources import dat

    d = dat.read_dat(spark, f"file://{tmp_path}/d.dat").first().datafile
    assert d.header.name == "N & M" and d.game[0]["_name"] == "g&1" and d.game[0].rom[0]["_name"] == 'r"1'
    reports.write_manifest({"metadata": "x"}, rows.select("source"), rows, ["game_name"], str(tmp_path / "m.json"))
    import json

    m = json.loads((tmp_path / "m.json").read_text())
    assert m["roms"][0]["rom_name"] == 'r"1' and m["sources"] == [{"source": "s.zip"}]
    stats = profile.run_stats(spark.createDataFrame([(1.0,), (2.0,)], "t double"), "t").first()
    assert "| mean | 1.500 s |" in reports.benchmark_report(stats, {"cores": 4})
