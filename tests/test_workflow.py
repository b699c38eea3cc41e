"""The file workflow end to end: catalogue, scan, plan, ZIP files, store, command line."""

import hashlib
import io
import os
import shutil
import subprocess
import sys
import tarfile
import zipfile

import pytest

from setforge import api, cli
from setforge.errors import ArchiveError, CatalogueError, InvalidPath, PlanError
from setforge.operators import zip_sink
from setforge.sources import archives, dat, filetree
from make_7z import CODERS, archive

ABC = hashlib.sha1(b"abc").hexdigest()
EMPTY = hashlib.sha1(b"").hexdigest()
LOST = "0f" * 20


def rom(name, sha1):
    return f'<rom name="{name}" size="8192" md5="{"0" * 32}" sha1="{sha1}" crc="00000000"/>'


def game(name, roms, extra=""):
    return f'<game name="{name}" {extra}>{"".join(roms)}</game>'


def write_dat(path, games, name="Test Set"):
    path.write_text(f'<?xml version="1.0"?><!DOCTYPE datafile><datafile build="b"><header><name>{name}</name><version>1</version></header>{"".join(games)}</datafile>')
    return str(path)


CLONES = [
    game("parent", [rom("parent.rom", ABC)]),
    game("clone1", [rom("clone1.rom", LOST)], 'cloneof="parent"'),
    game("clone2", [rom("clone2.rom", EMPTY)], 'cloneof="parent"'),
]


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.rom").write_bytes(b"abc")
    (src / "sub" / "_empty.rom").write_bytes(b"")
    (src / ".hidden").write_bytes(b"abc")
    (src / ".dir").mkdir()
    (src / ".dir" / "x").write_bytes(b"abc")
    return src


def test_scan_has_empty_underscored_and_archived_files(spark, tree):
    with zipfile.ZipFile(tree / "z.zip", "w") as z:
        z.writestr("dir/", b"")
        z.writestr("dir/one.rom", b"one")
        z.writestr("two.rom", b"two")
    rows = {(os.path.basename(r.path), r.name): r for r in filetree.read_tree(spark, str(tree)).collect()}
    assert set(rows) == {("a.rom", "a.rom"), ("_empty.rom", "_empty.rom"), ("z.zip", "dir/one.rom"), ("z.zip", "two.rom")}
    assert bytes(rows["_empty.rom", "_empty.rom"].sha1).hex() == EMPTY
    assert bytes(rows["z.zip", "two.rom"].sha1) == hashlib.sha1(b"two").digest() and rows["z.zip", "two.rom"].kind == "zip"


@pytest.mark.parametrize("body", [b"PK\x03\x04broken", b"7z\xbc\xaf\x27\x1cbroken", b"Rar!\x1a\x07\x00broken"])
def test_broken_archives_end_the_scan(spark, tree, body):
    (tree / "bad.bin").write_bytes(body)
    with pytest.raises(Exception, match="bad.bin|bsdtar"):
        filetree.read_tree(spark, str(tree)).collect()


def test_unsafe_entry_ends_the_scan(spark, tree):
    with zipfile.ZipFile(tree / "z.zip", "w") as z:
        z.writestr("../evil", b"x")
    with pytest.raises(Exception, match="unsafe entry name"):
        filetree.read_tree(spark, str(tree)).collect()


@pytest.mark.parametrize("packed_header", [False, True])
@pytest.mark.parametrize("coder", [c for c in CODERS if c != "ppmd"])
def test_seven_zip(tmp_path, coder, packed_header):
    files = [("dir/a", b"AAAA" * 40_000), ("b", bytes(range(256)) * 9), ("b", b"once more")]
    path = tmp_path / "a.bin"
    path.write_bytes(archive([(coder, files), ("copy", [("one", b"1")])], [("empty", False), ("folder", True)], packed_header))
    exp = [*files, ("one", b"1"), ("empty", b"")]
    rows = list(filetree.scan_file(str(path)))
    assert [(r[2], r[3], r[6], r[8], r[9]) for r in rows] == [(n, hashlib.sha1(b).digest(), len(b), "archive", k) for k, (n, b) in enumerate(exp)]
    with archives.open_entry(str(path), "7z", "one") as f:  # others are passed over
        assert f.read() == b"1"
    with pytest.raises(ArchiveError), archives.open_entry(str(path), "7z", "none"):
        pass


def test_seven_zip_that_is_none(tmp_path):
    good = archive([("lzma2", [("a", b"x" * 9000), ("b", b"y")])], packed_header=True)
    path = tmp_path / "a.bin"
    path.write_bytes(archive([]))
    assert list(filetree.scan_file(str(path))) == []
    bad = [good[:-5], good[:100], good[:60] + b"!" + good[61:], archive([("lzma2", [("a", b"x"), ("b", b"y")])], wrong=True), archive([("ppmd", [("a", b"x")])])]
    for body in bad:
        path.write_bytes(body)
        with pytest.raises(ArchiveError, match="a.bin"):
            list(filetree.scan_file(str(path)))
    path.write_bytes(archive([("copy", [("../a", b"x")])]))
    with pytest.raises(InvalidPath):
        list(filetree.scan_file(str(path)))


@pytest.fixture
def tar_tool(tmp_path, monkeypatch):
    """A stand-in for bsdtar that takes the tar stream from beside the archive; a second word there makes it fail."""
    (tmp_path / "bin").mkdir()
    tool = tmp_path / "bin" / "bsdtar"
    tool.write_text(f"#!{sys.executable}\nimport sys\np = sys.argv[-1][1:]\nassert sys.argv[1:5] == ['-cf', '-', '--format', 'pax']\nsys.stdout.buffer.write(open(p, 'rb').read()[8:])\nif 'bad' in p: sys.exit('it is bad')\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path / 'bin'}{os.pathsep}{os.environ['PATH']}")


def tarred(*entries) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, body in entries:
            info = tarfile.TarInfo(name)
            info.type, info.size = (tarfile.DIRTYPE, 0) if body is None else (tarfile.REGTYPE, len(body))
            t.addfile(info, io.BytesIO(body or b""))
    return out.getvalue()


def test_rar_entries_in_one_pass(tmp_path, tar_tool):
    magic = b"Rar!\x1a\x07\0\0"
    path = tmp_path / "a.bin"
    path.write_bytes(magic + tarred(("dir/", None), ("dir/a", b"AAAA"), ("dir/a", b"BBBB"), ("line\u2028break", b"x"), ("./b", b"")))
    rows = list(filetree.scan_file(str(path)))
    assert [(r[2], r[3], r[6], r[8], r[9]) for r in rows] == [(n, hashlib.sha1(b).digest(), len(b), "archive", k) for k, (n, b) in enumerate([("dir/a", b"AAAA"), ("dir/a", b"BBBB"), ("line\u2028break", b"x"), ("b", b"")])]
    with archives.open_entry(str(path), "rar", "b") as f:
        assert f.read() == b""
    with archives.open_entry(str(path), "rar", "dir/a") as f:
        assert f.read() == b"AAAA"
    with pytest.raises(ArchiveError), archives.open_entry(str(path), "rar", "none"):
        pass
    zip_sink.write_zip(str(tmp_path / "o.zip"), iter([("x", str(path), "dir/a", "archive")]), zipfile.ZIP_STORED)
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.read("x") == b"AAAA"
    for name, body, error in (("bad", tarred(("a", b"1")), ArchiveError), ("short", tarred(("a", b"1" * 9000))[:5000], ArchiveError), ("evil", tarred(("../a", b"1")), InvalidPath), ("odd", tarred(("a\udcff", b"1")), InvalidPath)):
        (tmp_path / name).write_bytes(magic + body)
        with pytest.raises(error):
            list(filetree.scan_file(str(tmp_path / name)))


def test_scan_of_wide_and_deep_trees(spark, tmp_path):
    """More folders than the driver opens, a flat one, and a chain."""
    exp = set()
    for k in range(90):
        d = tmp_path / f"d{k}" / "e"
        d.mkdir(parents=True)
        (d / "f").write_bytes(b"%d" % k)
        (tmp_path / f"flat{k}").write_bytes(b"")
        exp |= {str(d / "f"), str(tmp_path / f"flat{k}")}
    deep = tmp_path.joinpath(*"abcdefgh")
    deep.mkdir(parents=True)
    (deep / "x").write_bytes(b"x")
    rows = filetree.read_tree(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in rows) == sorted(exp | {str(deep / "x")})


def test_tree_in_rounds(spark, tmp_path):
    """A chain and a flat folder are listed by several tasks."""
    flat, deep = tmp_path / "flat", tmp_path.joinpath(*["d"] * 30)
    flat.mkdir()
    deep.mkdir(parents=True)
    for k in range(70):
        (flat / f"n{k}").write_bytes(b"")
    (flat / "in").mkdir()
    (flat / "in" / "x").write_bytes(b"x")
    (deep / "y").write_bytes(b"y")
    (tmp_path / "link").symlink_to(flat)
    (tmp_path / "file-link").symlink_to(deep / "y")
    (tmp_path / ".hidden").write_bytes(b"")
    exp = sorted([*(str(flat / f"n{k}") for k in range(70)), str(flat / "in" / "x"), str(deep / "y"), str(tmp_path / "file-link")])
    for folders, entries in ((1, 10), (5, 40), (1000, 1000)):
        found = filetree.list_tree(spark, str(tmp_path), [], folders, entries)
        assert sorted(r.path for r in found.collect()) == exp
    first = list(filetree.walk(iter([(str(tmp_path), 0, 1)]), 1, 10))
    assert sorted(first) == sorted([(str(tmp_path / "file-link"), 0, 0), (str(flat), 0, 1), (str(tmp_path / "d"), 0, 1)])
    shares = list(filetree.walk(iter([(str(flat), 0, 1)]), 10, 10))
    assert shares == [(str(flat), k, filetree.SHARES) for k in range(filetree.SHARES)]
    parts = [list(filetree.walk(iter([s]), 10, 10)) for s in shares]
    assert sorted(p for part in parts for p, _, n in part if not n) == [str(flat / f"n{k}") for k in sorted(range(70), key=lambda k: f"n{k}")] and max(map(len, parts)) < 20
    assert [r.path for r in filetree.list_tree(spark, str(deep / "y")).collect()] == [str(deep / "y")]
    assert filetree.list_tree(spark, str(tmp_path), [str(deep / "y")]).filter("path like '%y'").count() == 0


def test_store_keeps_files_for_readers_and_refuses_lost_updates(spark, tree, tmp_path):
    store = api.open_store(spark, str(tmp_path / "store"))
    api.scan_source(store, str(tree))
    before, stale = store.table("rom_files"), store._state()
    api.scan_source(store, str(tree))
    assert before.count() == 2  # planned on files that are not current any more
    with pytest.raises(CatalogueError, match="another writer"):
        store.replace(stale, rom_files=store.table("rom_files").limit(0))
    assert store.table("rom_files").count() == 2
    store.retain = 0
    api.scan_source(store, str(tree))
    api.scan_source(store, str(tree))
    assert len([n for n in os.listdir(store.path) if n.startswith("rom_files-")]) == 2 and store.table("rom_files").count() == 2


def test_build_parent_bundles_and_rerun(spark, tree, tmp_path):
    store = api.open_store(spark, str(tmp_path / "store"))
    d = write_dat(tmp_path / "set.dat", CLONES)
    r = api.run(store, d, str(tree), str(tmp_path / "out"))
    assert (r.matched, r.missing, r.exit_code, [os.path.basename(f.path) for f in r.files.collect()]) == (2, 1, 0, ["parent.zip"])
    with zipfile.ZipFile(r.files.first().path) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"parent.rom": b"abc", "clone2.rom": b""}
    # the second run replaces catalogue and scan; nothing is doubled
    (tree / "a.rom").write_bytes(b"changed")
    r = api.run(store, d, str(tree), str(tmp_path / "out2"), layout="per-game", compression="store")
    assert (r.matched, [os.path.basename(f.path) for f in r.files.collect()]) == (1, ["clone2.zip"])
    assert store.table("rom_files").count() == 2 and store.table("data_files").count() == 1 and store.table("games").count() == 3


def test_strict_dry_run_and_by_name(spark, tree, tmp_path):
    store = api.open_store(spark, str(tmp_path / "store"))
    api.scan_source(store, str(tree))
    api.import_dat(store, write_dat(tmp_path / "set.dat", CLONES))
    r = api.build(store, "Test Set", str(tree), str(tmp_path / "o1"), strict=True)
    assert (r.exit_code, r.written, r.matched) == (2, 0, 2) and not (tmp_path / "o1").exists()
    r = api.build(store, "Test Set", str(tree), str(tmp_path / "o2"), dry_run=True)
    assert (r.exit_code, r.bundles) == (0, 1) and not (tmp_path / "o2").exists()
    games = {g.name: g for g in store.table("games").collect()}
    assert games["clone1"].parent_id == games["parent"].id and games["parent"].clone_of is None and games["parent"].rom_of == ""
    with pytest.raises(CatalogueError):
        api.build(store, "Unknown", str(tree), str(tmp_path / "o3"))
    with pytest.raises(InvalidPath):
        api.build(store, "Test Set", str(tmp_path / "nowhere"), str(tmp_path / "o3"))


def test_same_name_in_a_bundle_fails_before_writing(spark, tree, tmp_path):
    store = api.open_store(spark, str(tmp_path / "store"))
    d = write_dat(tmp_path / "set.dat", [game("p", [rom("x.rom", ABC)]), game("c", [rom("x.rom", EMPTY)], 'cloneof="p"')])
    with pytest.raises(PlanError, match="twice"):
        api.run(store, d, str(tree), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("body", ['<rom name="r" size="1" md5="00" sha1="zz" crc="00"/>', '<rom name="r" size="1" md5="00" crc="00"/>', '<rom name="r" md5="00" sha1="00" crc="00"/>'])
def test_bad_catalogues_are_errors(spark, tmp_path, body):
    store = api.open_store(spark, str(tmp_path / "store"))
    with pytest.raises(CatalogueError):
        api.import_dat(store, write_dat(tmp_path / "bad.dat", [f'<game name="g">{body}</game>']))
    assert store.table("data_files").count() == 0


def test_prefix_roots_do_not_mix(spark, tmp_path):
    store = api.open_store(spark, str(tmp_path / "store"))
    for n in ("source", "source-other"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "f").write_bytes(n.encode())
        api.scan_source(store, str(tmp_path / n))
    api.scan_source(store, str(tmp_path / "source"))
    assert store.table("rom_files").count() == 2


def test_write_nothing_makes_no_folder(spark, tmp_path):
    empty = spark.createDataFrame([], "zip string, rom_name string, canonical_path string, entry_name string, kind string")
    assert zip_sink.write_bundles(empty, str(tmp_path / "o")).count() == 0 and not (tmp_path / "o").exists()


def test_command_line(spark, tree, tmp_path, capsys):
    d = write_dat(tmp_path / "set.dat", CLONES)
    cache = ["--cache", str(tmp_path / "c")]
    assert cli.main([*cache, "build", d, str(tree), str(tmp_path / "o"), "--missing", "fail"], spark) == 2
    assert cli.main([*cache, "cache", "build", d, str(tree), str(tmp_path / "o")], spark) == 0
    assert cli.main([*cache, "cache", "import", str(tmp_path / "none.dat")], spark) == 1
    assert (tmp_path / "o" / "parent.zip").exists()
    assert cli.default_cache(None, {"XDG_CACHE_HOME": "/x"}) == "/x/setforge/store" and cli.default_cache(None, {"HOME": "/h"}) == "/h/.cache/setforge/store"


def test_parse_from_a_string(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('<datafile><header><name>N</name></header><game name="g" cloneof=""/></datafile>',)], "x string")
    r = df.select(dat.parse_dat(F.col("x")).alias("d")).first().d
    assert r.header.name == "N" and r.game[0]["_cloneof"] == "" and r.game[0].rom is None


def test_catalogue_from_public_sources(spark, tmp_path):
    import json

    from setforge.operators import fetch

    (tmp_path / "in").mkdir()
    for name, body in (("game.nes", b"1"), ("GAME.rom", b"22"), ("readme.txt", b"x"), ("plain", b"3"), ("tetris.nes", b"4"), ("bad.zip", b"PK\x03\x04nothing")):
        (tmp_path / "in" / name).write_bytes(body)
    with zipfile.ZipFile(tmp_path / "in" / "game.zip", "w") as z:
        z.writestr("game.nes", b"in zip")
        z.writestr("sonic.nes", b"no")
        z.writestr("note.txt", b"no")
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("one.gb", b"one")
    roots = [str(tmp_path / "in")]
    if shutil.which("bsdtar"):
        roots.append(fetch.prepare_source("archive", str(tmp_path / "pack.zip"), str(tmp_path / "prepared")))
    sources = [{"prepared_root": r, "tier": "curated", "evidence": "says so", "allow_extensionless": 1, "exclude_disallowed": 0} for r in roots]
    n = fetch.write_catalogue(spark, sources, str(tmp_path / "work"), {"name": "Smoke"}, {"metadata": "m"}, 0)
    m = json.loads((tmp_path / "work" / "manifest.json").read_text())
    got = [(r["game_name"], r["rom_name"], r["size"]) for r in m["roms"]]
    assert got[:4] == [("GAME", "GAME.rom", 2), ("game", "game.nes", 1), ("game_2", "game.nes", 6), ("plain", "plain", 1)] and n == len(got) == 3 + len(roots)
    store = api.open_store(spark, str(tmp_path / "store"))
    os.remove(tmp_path / "in" / "bad.zip")  # a build's own scan is strict
    r = api.run(store, str(tmp_path / "work" / "catalogue.dat"), roots[0], str(tmp_path / "out"))
    assert r.matched >= 4


def test_fetch_command(spark, tmp_path, capsys):
    """A direct file and a git bundle, in order; options that make no sense; files that lack or have another digest."""
    import json

    down, meta, work = tmp_path / "down", tmp_path / "meta", tmp_path / "work"
    down.mkdir()
    meta.mkdir()
    (down / "item_one__pong_v1.nes").write_bytes(b"pong")
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "life.gb").write_bytes(b"life")
    (repo / "notes.txt").write_bytes(b"no")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@example.com", *a], cwd=repo, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-q", "-m", "m")
    git("bundle", "create", str(down / "two__life.bundle"), "HEAD", "main")
    (tmp_path / "list").write_text("metadata|direct|item one|pong (v1).nes|0|0|says so\ncurated|git_bundle|two|life.bundle|0|1|README says so\n")
    (meta / "item one.metadata.json").write_text(json.dumps({"metadata": {"licenseurl": "http://creativecommons.org/publicdomain/mark/1.0/"}, "files": [{"name": "pong (v1).nes", "sha1": hashlib.sha1(b"pong").hexdigest()}]}))
    (meta / "two.metadata.json").write_text(json.dumps({"metadata": {"title": "homebrew"}, "files": [{"name": "life.bundle"}]}))
    args = ["fetch", str(tmp_path / "list"), str(meta), str(down), "--work-dir", str(work)]
    assert cli.main([*args, "--layout", "per-game"], spark) == 0
    assert sorted(p.name for p in (work / "out").iterdir()) == ["item_one__pong_v1.zip", "life.zip"]
    m = json.loads((work / "manifest.json").read_text())
    assert [(s["identifier"], s["kind"]) for s in m["sources"]] == [("item one", "direct"), ("two", "git_bundle")] and len(m["roms"]) == 2
    assert cli.main([*args, "--catalog-tier", "metadata", "--skip-run", "--max-roms", "1"], spark) == 0 and "1 games" in capsys.readouterr().out
    for wrong in (["--max-roms", "-1"], ["--jobs", "x"], ["--layout", "flat"], ["--catalog-tier", "all"]):
        with pytest.raises(SystemExit):
            cli.main([*args, *wrong], spark)
    (down / "item_one__pong_v1.nes").write_bytes(b"other")
    assert cli.main(args, spark) == 1 and "SHA-1" in capsys.readouterr().err
    assert cli.main(args, spark) == 1 and "https://archive.org/download/item%20one/pong%20%28v1%29.nes" in capsys.readouterr().err


def test_tables_of_an_older_version_are_read(spark, tmp_path):
    """Columns that came later are null."""
    import json

    spark.sql("select 1L as id, 'p' as path, 'n' as name, X'00' as sha1, false as in_archive").write.parquet(str(tmp_path / "rom_files-old"))
    (tmp_path / "state-3.json").write_text(json.dumps({"version": 0, "number": 3, "tables": {"rom_files": "rom_files-old"}, "retired": []}))
    r = api.open_store(spark, str(tmp_path)).table("rom_files").first()
    assert (r.path, r.kind, r.entry_seq) == ("p", None, None)
    (tmp_path / "state-4.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(CatalogueError):
        api.open_store(spark, str(tmp_path))


def test_stream_refreshes_the_store(spark, tree, tmp_path):
    from setforge import schemas
    from setforge.streaming.refresh import refresh

    store = api.open_store(spark, str(tmp_path / "store"))
    filetree.read_tree(spark, str(tree)).write.parquet(str(tmp_path / "scans"))
    for _ in range(2):
        q = refresh(spark.readStream.schema(schemas.SCANNED).parquet(str(tmp_path / "scans")), store, str(tree), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert store.table("rom_files").count() == 2
