"""What one task can't hold: documents read and written in parts, hot keys, stores whose segments stay, migrations."""

import itertools
import json
import os
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from setforge.errors import ArchiveError, CatalogueError
from setforge.operators import catalogue, joined, migrations, profile, reports, zip_sink
from setforge.operators.ordinals import followed, ordinals, running
from setforge.operators.store import Store
from setforge.plans import planner
from setforge.sources import archives, catalog, dat, filetree

GAMES = [f'<game name="g&amp;{k}" cloneof="p{k % 3}"><year>19{k % 90 + 10}</year><rom name="r{k}" size="{k}" md5="0a" sha1="0b" crc="0c"/></game>' if k % 7 else f'<game name="g&amp;{k}"/>' for k in range(400)]
HEAD = '<?xml version="1.0"?>\n<!DOCTYPE datafile SYSTEM "x.dtd">\n<datafile build="b">\n <header><name>All</name><author>me</author></header>\n'


@pytest.fixture
def small_parts(spark):
    """Files are cut into parts of a few thousand bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_catalogue_in_parts(spark, tmp_path, small_parts):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c.dat").write_text(HEAD + "\n".join(GAMES) + "\n</datafile>\n<!-- end -->\n")
    (tmp_path / "in" / "none.dat").write_text("﻿" + HEAD.replace("All", "None") + "</datafile>")
    path = f"file://{tmp_path}/in"
    got, exp = dat.read_catalogues(spark, path), dat.flatten(dat.read_dat(spark, path))
    rows = lambda df: sorted(map(tuple, df.select(*exp.games.columns[:3]).collect())) if "is_bios" in df.columns else sorted(map(repr, df.collect()))
    for a, b in ((got.header, exp.header), (got.games, exp.games), (got.roms, exp.roms)):
        assert rows(a.select(*b.columns)) == rows(b)
    assert got.games.count() == 400 and got.roms.count() == sum(1 for k in range(400) if k % 7)
    whole = spark.read.option("lineSep", "<game").text(path)
    assert whole.rdd.getNumPartitions() > 5


@pytest.mark.parametrize("text", [HEAD + GAMES[1], HEAD + GAMES[1] + "</datafile>" + GAMES[2], HEAD + '<game name="x"><rom</game></datafile>', HEAD + "<gamelist/></datafile>", "<other/>", ""])
def test_catalogues_that_are_none(spark, tmp_path, text):
    (tmp_path / "bad.dat").write_text(text or " ")
    with pytest.raises(Exception):  # noqa: B017
        found = dat.read_catalogues(spark, f"file://{tmp_path}/bad.dat")
        found.games.collect()
        assert found.header.collect()


def test_files_written_in_parts(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("é<"), F.col("id")).alias("s"))
    lines = [f"é<{k}" for k in sorted(range(1000), reverse=True)]
    n = joined.write_joined(spark, str(tmp_path / "f"), ["head\n", joined.Rows(rows.withColumn("neg", -F.col("id")), F.col("s"), ["neg"], ";\n"), "\ntail", joined.Rows(rows.limit(0), F.col("s"), []), "."])
    assert n == 1000 and (tmp_path / "f").read_text() == "head\n" + ";\n".join(lines) + "\ntail."
    assert os.listdir(tmp_path) == ["f"]
    assert joined.write_joined(spark, str(tmp_path / "e"), [joined.Rows(rows.limit(0), F.col("s"), ["id"])]) == 0 and (tmp_path / "e").read_text() == ""


def test_manifest_in_parts(spark, tmp_path, small_parts):
    roms = spark.range(500).select(F.concat(F.lit('"name" \\ '), F.col("id")).alias("name"), "id")
    listed = spark.createDataFrame([("z",), ("a",)], "root string").coalesce(1)
    reports.write_manifest({"metadata": "m, x"}, listed, roms, ["id"], str(tmp_path / "m.json"))
    doc = json.loads((tmp_path / "m.json").read_text())
    assert [r["root"] for r in doc["sources"]] == ["z", "a"] and [r["id"] for r in doc["roms"]] == list(range(500))
    policy, sources, back = catalog.read_manifest(spark, f"file://{tmp_path}/m.json", "root string", "name string, id long")
    assert json.loads(policy.first().policy) == {"metadata": "m, x"} and [r.root for r in sources.orderBy("nr").collect()] == ["z", "a"]
    assert [(r.name, r.id) for r in back.orderBy("nr").collect()] == [(r["name"], r["id"]) for r in doc["roms"]]
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text()[:-5])
    with pytest.raises(CatalogueError):
        catalog.read_manifest(spark, f"file://{tmp_path}/m.json", "root string", "name string")


def test_one_bundle_by_many_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"f{k}").write_text(f"body {k} " * k)
    rows = [("big.zip" if k < 190 else f"ü{k}.zip", f"e/né{k:04d}", f"{tmp_path}/f{k}", None, "bare") for k in range(200)]
    entries = spark.createDataFrame(rows, "zip string, rom_name string, canonical_path string, entry_name string, kind string")
    for compression in ("deflate", "store"):
        made = zip_sink.write_bundles(entries, str(tmp_path / compression), compression)
        assert {(os.path.basename(r.path), r.n) for r in made.collect()} == {("big.zip", 190), *((f"ü{k}.zip", 1) for k in range(190, 200))}
        assert sorted(os.listdir(tmp_path / compression)) == sorted({r[0] for r in rows})
        with zipfile.ZipFile(tmp_path / compression / "big.zip") as z:
            assert z.testzip() is None and z.comment == zip_sink.COMMENT and z.namelist() == sorted(r[1] for r in rows[:190])
            assert all(z.read(f"e/né{k:04d}") == (f"body {k} " * k).encode() for k in range(190))
            assert {i.compress_type for i in z.infolist()} == {zip_sink.COMPRESSION[compression]}
        offsets = [zip_sink.central_header(i, 0, False) for i in zipfile.ZipFile(tmp_path / compression / "big.zip").infolist()]
        assert len(offsets) == 190


def test_places_of_eight_bytes(tmp_path):
    """A directory whose places, sizes and numbers have their wide form is read as well."""
    target, at, directory, n = tmp_path / "t.zip", 0, b"", 0
    segments = []
    for s in range(2):
        with zipfile.ZipFile(tmp_path / f"s{s}", "w") as z:
            for k in range(3):
                z.writestr(f"{s}-{k}", f"text {s} {k}")
        with zipfile.ZipFile(tmp_path / f"s{s}") as z:
            segments.append((tmp_path / f"s{s}", z.start_dir))
    target.write_bytes(bytes(sum(size for _, size in segments)))
    for path, size in segments:
        joined.copy_range(str(path), size, str(target), at)
        with zipfile.ZipFile(path) as z:
            headers = [zip_sink.central_header(i, at, True) for i in z.infolist()]
            assert sum(map(len, headers)) == sum(len(zip_sink.central_header(i, at, False)) + 12 for i in z.infolist())
        directory, at, n = directory + b"".join(headers), at + size, n + len(headers)
    wide = zip_sink.end_records(0xFFFF, len(directory), at)[:-len(zip_sink.end_records(1, 0, 0))]
    assert wide[:4] == b"PK\x06\x06" and struct.unpack("<Q", wide[24:32]) == (0xFFFF,)
    with open(target, "ab") as f:
        f.write(directory + zip_sink.end_records(n, len(directory), at))
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None and {x: z.read(x) for x in z.namelist()} == {f"{s}-{k}": f"text {s} {k}".encode() for s in range(2) for k in range(3)}


ROWS = [(k % 3 if k % 5 else None, None if k % 11 == 0 else (k * k) % 17, k, None if k % 13 == 0 else f"v{k}") for k in range(150)] + [(9, 1, 500, "alone")]


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_ordinals_of_hot_keys(spark, most):
    df = spark.createDataFrame(ROWS, "k int, o int, id int, v string")
    exp_nr, exp_before, exp_sum = {}, {}, {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for k in {r[0] for r in ROWS}:
        total, before = 0, None
        for nr, r in enumerate(sorted((r for r in ROWS if r[0] == k), key=order), 1):
            total += r[2]
            exp_nr[r[2]], exp_before[r[2]], exp_sum[r[2]] = nr, before, total
            before = r[3]
    assert {r.id: r.nr for r in ordinals(df, ["k"], ["o", "id"], "nr", most).collect()} == exp_nr
    assert {r.id: r.before for r in followed(df, ["k"], ["o", "id"], "v", "before", most).collect()} == exp_before
    assert {r.id: r.total for r in running(df, ["k"], ["o", "id"], {"total": F.col("id")}).collect()} == exp_sum
    clash = df.withColumnsRenamed({"o": "__part", "v": "__total"})  # names that are used inside
    assert {r.id: r.total for r in running(clash, ["k"], ["__part", "id"], {"total": F.col("id")}).collect()} == exp_sum
    assert [r.nr for r in running(df, [], ["id"], {"nr": F.lit(1)}).orderBy("id").collect()] == list(range(1, len(ROWS) + 1))
    assert running(df.limit(0), [], ["id"], {"nr": F.lit(1)}).count() == 0


def test_no_task_has_all_rows_of_a_hot_name(spark):
    df = spark.range(2000).select("id", F.lit("n").alias("name"))
    out = catalogue.unique_names(df, F.col("name"), ["id"], hot=100)
    shares = sorted(r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    assert out.filter("unique_name = 'n_2000'").count() == 1 and len(shares) > 1


def test_lists_of_a_hot_digest_are_bounded(spark):
    s = spark.range(1000).select(F.lit("/r").alias("source_root"), F.concat(F.lit("/r/"), F.col("id")).alias("canonical_path"), F.lit(None).cast("string").alias("entry_name"), F.lit("bare").alias("kind"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sha1"), F.col("id").alias("seq"))
    chunks = planner.candidate_chunks(s, most=25, hot=50)
    hot = chunks.filter("sha1 = 'hot'").orderBy("chunk").collect()
    assert [r.chunk for r in hot] == list(range(14)) and max(len(r.candidates) for r in hot) == 25
    whole = planner.candidate_lists(s).filter("sha1 = 'hot'").first().candidates
    assert [c for r in hot for c in r.candidates] == whole


def test_many_roots_without_a_nested_loop(spark):
    s = spark.createDataFrame([("/a", "/a/b/c"), ("/a", "/a/bb"), ("/x", "/x"), ("/other", "/y/z")], "source_root string, canonical_path string")
    roots = ["/a", "/a/b", "/a/b/", "/x", "/", "/other", "/none", "/a/bb"]
    found = planner.sources_of_roots(s, spark.createDataFrame([(r,) for r in roots], "root string"))
    exp = {(r.rstrip("/") or "/", x.canonical_path) for r in roots for x in planner.scope_sources(s, r.rstrip("/") or "/").collect()} | {("/", p) for p in ("/a/b/c", "/a/bb", "/x", "/y/z")}
    assert {(r.root, r.canonical_path) for r in found.collect()} == exp
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_edges_of_one_instant(spark):
    rows = [(1, 0.0 if k else 5.0, k, f"f{k}") for k in range(400)]
    got = profile.sequence_edges(spark.createDataFrame(rows, "tid int, t double, seq int, f string"), "tid", ["t", "seq"], "f", most=10)
    f = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert sorted(map(tuple, got.collect())) == sorted(itertools.pairwise(f))


def catalogues(spark, names, games=3, tag=""):
    header = spark.createDataFrame([(f"{n}.dat", n) for n in names], "file_name string, name string")
    g = spark.createDataFrame([(f"{n}.dat", k, f"{n}{k}{tag}", "s", None) for n in names for k in range(games)], "file_name string, game_seq int, name string, source_file string, clone_of string")
    r = spark.createDataFrame([(f"{n}.dat", k, 0, f"r{n}{k}{tag}", 1, f"{n}{k}".encode().ljust(20, b"-")) for n in names for k in range(games)], "file_name string, game_seq int, rom_seq int, name string, size int, sha1 binary")
    return dat.Catalogue(header, g, r)


def scanned(spark, root, names):
    rows = [(root, f"{root}/{n}", n, n.encode().ljust(20, b"-"), b"x", False, "bare", 0) for n in names]
    return spark.createDataFrame(rows, "parent_path string, path string, name string, sha1 binary, xxhash3 binary, in_archive boolean, kind string, entry_seq int")


def test_changes_leave_other_segments(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    names = [f"c{k}" for k in range(12)]
    assert store.import_catalogue(catalogues(spark, names)) == list(range(1, 13))
    for root in ("/r/a", "/r/b", "/r"):
        store.replace_scanned(scanned(spark, root, ["c10", "none"]), root)
    assert len(store._state()["tables"]["rom_files"]) == 1  # /r took in the others
    assert store.replace_scanned(scanned(spark, "/r/b", ["c20"]), "/r/b") == (1, 1)
    store.append_scanned(scanned(spark, "/q", ["c30", "c31"]))
    before = {name: {tuple(s) for s in some} for name, some in store._state()["tables"].items()}
    files = {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, found in os.walk(store.path) for p in found if p.endswith(".parquet")}
    assert store.import_catalogue(catalogues(spark, ["c3"], games=2, tag="new")) == [13]
    after = {name: {tuple(s) for s in some} for name, some in store._state()["tables"].items()}
    assert before["rom_files"] == after["rom_files"]  # an import leaves scanned files alone
    assert all(1 <= len(before[name] - after[name]) <= 2 for name in ("data_files", "games", "roms"))  # the bucket of the old id and that of the new one
    assert len(before["games"] & after["games"]) >= len(before["games"]) - 2 > 3
    now = {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, found in os.walk(store.path) for p in found if p.endswith(".parquet")}
    assert files.items() <= now.items()  # files that are not current any more stay for a while, others for good
    assert store.table("games").count() == 11 * 3 + 2 and store.table("roms").count() == 11 * 3 + 2 and store.table("data_files").count() == 12
    assert {r.name for r in store.entries(13, "c3").select(F.col("game_name").alias("name")).collect()} == {"c30new", "c31new"}
    known = {r.path: r.rom_id is not None for r in store.table("rom_files").collect()}
    assert known == {"/r/c10": True, "/r/none": False, "/r/b/c20": True, "/q/c30": True, "/q/c31": True}
    assert store.replace_scanned(scanned(spark, "/q", ["c32"]), "/q") == (1, 0)  # rows without a key give way too
    assert {r.path for r in store.table("rom_files").collect()} == {"/r/c10", "/r/none", "/r/b/c20", "/q/c32"}
    assert store.find_catalogue("c3.dat") == (13, "c3") and store.find_catalogue("c4") == (7, "c4")
    asked = spark.createDataFrame([("c3.dat",), ("c4",), ("zzz",), (None,)], "selector string")
    assert sorted(map(tuple, store.find_catalogues(asked).collect())) == [("c3.dat", 13, "c3"), ("c4", 7, "c4")]


def test_migrations_there_and_back(spark, tmp_path):
    path = str(tmp_path / "s")
    for version in range(migrations.LATEST + 1):  # a store of every step opens
        at = f"{path}{version}"
        old = Store(spark, at, version=version)
        assert old._state()["version"] == version
        made = catalogues(spark, ["a", "b"])
        if version >= 3:
            games = made.games.withColumn("id", F.xxhash64("file_name", "name")).withColumn("data_file_id", F.when(F.col("file_name") == "a.dat", 1).otherwise(2).cast("long"))
            roms = made.roms.join(games.select("file_name", "game_seq", F.col("id").alias("game_id")), ["file_name", "game_seq"]).withColumn("id", F.xxhash64("name"))
            fill = lambda df, name: df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in migrations.schema(name, version)])  # noqa: B023, E731
            header = made.header.withColumn("id", F.when(F.col("name") == "a", 1).otherwise(2).cast("long"))
            old.replace(old._state(), data_files=fill(header, "data_files"), games=fill(games, "games"), roms=fill(roms, "roms"))
        new = Store(spark, at)
        assert new._state()["version"] == migrations.LATEST
        assert new.table("roms").count() == (6 if version >= 3 else 0) and new.table("roms").columns == migrations.TABLES["roms"].names
        if version != 5:
            continue
        new.import_catalogue(catalogues(spark, ["a"], games=2, tag="x"))  # replaces the old one, wherever its rows are
        assert new.table("games").count() == 5 and new.table("roms").count() == 5
    store = Store(spark, f"{path}9")
    store.replace_scanned(scanned(spark, "/r", ["x"]), "/r")
    store.migrate(8)
    assert "kind" not in store.read("rom_files").columns and store.read("rom_files").count() == 1
    store.migrate(9)
    assert store.read("rom_files").first().kind is None  # going forward doesn't bring old values back
    store.import_catalogue(catalogues(spark, ["b"], games=1, tag=""))
    z = catalogues(spark, ["z"], games=1)
    store.import_catalogue(dat.Catalogue(z.header, z.games.withColumn("name", F.lit("b0")), z.roms))
    store.migrate(8)
    with pytest.raises(CatalogueError, match="more than once"):
        store.migrate(7)
    assert store._state()["version"] == 8
    with pytest.raises(CatalogueError, match="later version"):
        state = store._state()
        store.commit(state, {}, version=migrations.LATEST + 1)
        Store(spark, store.path)


def test_store_of_one_folder_a_table(spark, tmp_path):
    """What the store was before it had segments still opens, and its rows give way to new ones."""
    path = tmp_path / "s"
    path.mkdir()
    c = catalogues(spark, ["a"])
    games = c.games.withColumn("id", F.col("game_seq").cast("long")).withColumn("data_file_id", F.lit(4).cast("long"))
    c.header.withColumn("id", F.lit(4).cast("long")).write.parquet(str(path / "data_files-1"))
    games.select("id", "name", "data_file_id").write.parquet(str(path / "games-1"))
    c.roms.select("name", "size", "sha1", F.col("game_seq").cast("long").alias("game_id")).write.parquet(str(path / "roms-1"))
    scanned(spark, "/r", ["a0", "zz"]).write.parquet(str(path / "rom_files-1"))
    (path / "state-7.json").write_text(json.dumps({"version": 1, "number": 7, "tables": {n: f"{n}-1" for n in ("data_files", "games", "roms", "rom_files")}, "retired": []}))
    store = Store(spark, str(path))
    assert store.table("games").count() == 3 and store.find_catalogue("a") == (4, "a")
    assert {r.name: r.rom_id is None for r in store.table("rom_files").collect()} == {"a0": True, "zz": True}  # those roms have no id
    assert store.import_catalogue(catalogues(spark, ["a"], games=2)) == [5]
    assert store.table("games").count() == 2 and store.table("roms").count() == 2 and store.entries(5, "a").count() == 2
    assert {r.name: r.rom_id is None for r in store.table("rom_files").collect()} == {"a0": False, "zz": True}
    assert store.replace_scanned(scanned(spark, "/r", ["a1"]), "/r") == (1, 1) and store.table("rom_files").count() == 1


def odd_zip(path, n, before=b""):
    """A ZIP file, after foreign bytes or not: folders, names twice, names with safe forms, names of another encoding."""
    with open(path, "wb") as f:
        f.write(before)
    with zipfile.ZipFile(path, "a") as z:
        with pytest.warns(UserWarning):
            for k in range(n):
                z.writestr(("a/", f"{k // 8}/x", "./s/t", "b\\c", f"é{k}", "twice", f"p{k}/", "up")[k % 8], b"" if k % 8 in (0, 6) else f"body {k}")
    return str(path)


def test_zip_by_parts_and_by_name(tmp_path):
    path = odd_zip(tmp_path / "o.zip", 100, b"what stands before")
    data = open(path, "rb").read()
    for mark in (rb"(PK\x03\x04.{2})", rb"(PK\x01\x02.{4})"):  # another encoding for some of the names, by their flag
        data = re.sub(mark + rb"\x00\x08", lambda m: m[1] + b"\0\0", data, count=6, flags=re.S)
    with open(path, "wb") as f:
        f.write(data)
    with zipfile.ZipFile(path) as z:
        exp = [(archives.safe_name(i.filename), z.read(i)) for i in z.infolist() if not i.is_dir()]
        names = z.namelist()
        safe = lambda n: archives.safe_name(n) if not n.endswith("/") else None
        last = {n: z.read(n) for n in names}
        first = {s: last[n] for n in reversed(names) if (s := safe(n))}
    with archives.Zip(path) as z:
        parts = list(z.parts(7))
        assert sum(p.n for p in parts) == 100 and len(parts) == 15 and len(list(z.parts(7, 1))) > 15
        assert [(n, f.read()) for p in parts for n, f in z.read(p)] == exp == [(n, f.read()) for n, f in archives.entries(path, "zip")]
        assert [p.first for p in parts] == [sum(not n.endswith("/") for n in names[: 7 * k]) for k in range(15)]
    with archives.Opened() as opened:
        for name in {*last, *first}:
            with opened.entry(path, name, "zip") as f:
                assert f.read() == last.get(name, first.get(name))
        with pytest.raises(ArchiveError), opened.entry(path, "none", "zip"):
            pass


def test_copied_entries_do_not_read_the_directory_again(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        for k in range(1500):
            z.writestr(f"e{k}", str(k))
    made = []

    class Counted(zipfile.ZipInfo):
        def __init__(self, *a, **k):
            made.append(1)
            super().__init__(*a, **k)

    monkeypatch.setattr(zipfile, "ZipInfo", Counted)
    zip_sink.write_zip(str(tmp_path / "o.zip"), iter([(f"e{k}", str(tmp_path / "i.zip"), f"e{k}", "zip") for k in range(1500)]), zipfile.ZIP_STORED)
    assert len(made) < 5 * 1500  # 1500 for every entry before
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == {f"e{k}": str(k).encode() for k in range(1500)}


def test_large_zip_scanned_in_parts(spark, tmp_path, monkeypatch):
    """A ZIP file is read by several tasks with the rows that one gives; one that is broken ends the scan or is passed over as before."""
    path = odd_zip(tmp_path / "o.zip", 100)
    parts = archives.Zip.parts
    monkeypatch.setattr(archives.Zip, "parts", lambda self: parts(self, 7))
    assert len(filetree.parts(path, 0)) == 15 and filetree.parts(path, 1 << 20) == [None]
    files = spark.createDataFrame([(path,)], "path string")
    exp = [tuple(r) for r in filetree.scan_file(path)]
    for permissive in (False, True):
        got = filetree.scan(files, permissive, 0)
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[-1]) == exp
    (tmp_path / "b.zip").write_bytes(open(path, "rb").read()[:-60])
    assert filetree.parts(str(tmp_path / "b.zip"), 0) == [None]


def test_large_zip_is_dealt_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        for k in range(3 * archives.PART_ENTRIES):
            z.writestr(f"e{k}", str(k))
    rows = filetree.scan(spark.createDataFrame([(str(tmp_path / "l.zip"),)], "path string"), large=0)
    assert rows.groupBy(F.spark_partition_id()).count().count() > 1  # one task before
    got = {r.name: (r.entry_seq, r.size) for r in rows.collect()}
    assert got == {f"e{k}": (k, len(str(k))) for k in range(3 * archives.PART_ENTRIES)}


def test_plan_of_bundles_is_evaluated_once(spark, tmp_path):
    (tmp_path / "f").write_text("body")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("b.zip", f"e{k}", f"{tmp_path}/f", None, "bare") for k in range(50)], "zip string, rom_name string, canonical_path string, entry_name string, kind string")
    zip_sink.write_bundles(rows.mapInArrow(count, rows.schema), str(tmp_path / "o"))
    assert seen.value == 50  # 250 before


def test_listing_ends_after_many_entries(tmp_path):
    """A task that has listed as many entries as it may leaves the other folders to the next round."""
    for k in range(5):
        (tmp_path / str(k)).mkdir()
        for j in range(10):
            (tmp_path / str(k) / f"f{j}").write_text("")
    found = list(filetree.walk(iter([(str(tmp_path), 0, 1)]), 256, 20))
    assert [s for *_, s in found].count(0) == 20 and [s for *_, s in found].count(1) == 3
