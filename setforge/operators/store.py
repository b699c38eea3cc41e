"""The cache: catalogues, games, roms and scanned files as Parquet datasets in one folder.

A table is a list of segments, each a folder with the rows of one key: catalogues by a hash of their name, games and roms
by a hash of their catalogue's id, scanned files by the root they were scanned from. A change reads and rewrites the
segments that it touches; the others stay as they are. A segment without a key may hold any rows. The rom of a scanned
file is not stored but joined by digest when it is asked for, so that an import leaves the files alone.

New segments are written beside the current ones, then a small state file with the next number, which exists wholly or not
at all: a reader sees all of a change or nothing, a change that fails leaves the store as it was, and of two writers that
began at one state the second fails instead of undoing what the first did. Segments that are not current any more stay for
``RETAIN`` seconds, for readers that have planned on them, and go with a later change. The folder must be on a file system
that all machines share. Catalogues are numbered on; games, roms and files, which may be very many, get a hash of what
identifies them, so no task counts them.

The version of a store is the number of steps of :mod:`setforge.operators.migrations` that it has taken; opening it takes
those that it lacks.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge import schemas
from setforge.errors import CatalogueError
from setforge.functions import paths, text
from setforge.operators import catalogue, migrations
from setforge.operators.ordinals import running
from setforge.sources.dat import Catalogue

TABLES = migrations.TABLES
#: Segments of catalogues, and of games and roms.
BUCKETS = 64
KEY = "__key"
#: Seconds for which files stay that are not current any more.
RETAIN = 86_400

Segment = tuple[str | None, str]  # key and folder


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("string")


def is_under(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


class Store:
    def __init__(self, spark: SparkSession, path: str, retain: float = RETAIN, version: int = migrations.LATEST):
        self.spark, self.path, self.retain = spark, os.path.abspath(path), retain
        os.makedirs(self.path, exist_ok=True)
        if self._state()["version"] > migrations.LATEST:
            raise CatalogueError(f"{path}: made by a later version")
        if self._state()["version"] < version:
            self.migrate(version)

    # --- states ------------------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in os.listdir(self.path) if (m := re.fullmatch(r"state-(\d+)\.json", n)))

    def _state(self) -> dict:
        """The current state: its number and version, each table's segments, and those not current any more with the time since."""
        if not (numbers := self._numbers()):
            return {"version": 0, "number": 0, "tables": {}, "retired": [], "next": 1}
        with open(os.path.join(self.path, f"state-{numbers[-1]}.json"), encoding="utf-8") as f:
            state = json.load(f)
        if "next" not in state and state["version"] <= 1:  # of the time before segments: one folder a table
            state["tables"] = {name: [(None, at)] for name, at in state["tables"].items()}
            state |= {"version": migrations.BEFORE_SEGMENTS, "next": 1}
            state["next"] = (self.read("data_files", state=state).agg(F.max("id")).first()[0] or 0) + 1
        return state

    def read(self, name: str, keys: set | None = None, state: dict | None = None) -> DataFrame:
        """The stored rows of a table, of all segments or of those with the given keys (None: those without one)."""
        state = state or self._state()
        schema = migrations.schema(name, state["version"])
        found = [at for key, at in state["tables"].get(name, []) if keys is None or key in keys]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[os.path.join(self.path, at) for at in found])

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """The rows of a table; scanned files with their roms."""
        state = state or self._state()
        rows = self.read(name, state=state)
        return catalogue.associate(rows, self.read("roms", state=state)).select(*rows.columns) if name == "rom_files" else rows

    def write(self, name: str, df: DataFrame, key: Column | str | None, version: int = migrations.LATEST) -> list[Segment]:
        """Write rows as segments: by a column of keys, or all under one key, or without one."""
        columns = [F.col(c.name).cast(c.dataType).alias(c.name) for c in migrations.schema(name, version)]
        at = f"{name}-{uuid.uuid4().hex}"
        whole = os.path.join(self.path, at)
        if not isinstance(key, Column):
            df.select(*columns).write.parquet(whole)
            return [(key, at)]
        df.withColumn(KEY, key).select(*columns, KEY).hint("rebalance", KEY).write.partitionBy(KEY).parquet(whole)
        return [(n.removeprefix(f"{KEY}="), f"{at}/{n}") for n in sorted(os.listdir(whole)) if n.startswith(KEY)]

    def commit(self, state: dict, changed: dict[str, tuple[list[Segment], list[Segment]]], **values) -> None:
        """Make the next state of ``state``: of each changed table, segments that go and segments that come."""
        number, now = state["number"] + 1, time.time()
        part = os.path.join(self.path, f"{uuid.uuid4().hex}.part")
        tables, old = {name: [tuple(s) for s in some] for name, some in state["tables"].items()}, []
        for name, (gone, come) in changed.items():
            tables[name] = [s for s in tables.get(name, []) if s not in gone] + come
            old += [(now, at) for _, at in gone]
        stay = [(t, at) for t, at in state["retired"] if now - t < self.retain]
        try:
            with open(part, "w", encoding="utf-8") as f:
                json.dump(state | values | {"number": number, "tables": {k: v for k, v in tables.items() if v}, "retired": stay + old}, f)
            os.link(part, os.path.join(self.path, f"state-{number}.json"))  # fails if it exists
        except FileExistsError as e:
            self.discard([at for _, come in changed.values() for _, at in come])
            raise CatalogueError(f"{self.path}: changed by another writer meanwhile") from e
        finally:
            if os.path.exists(part):
                os.remove(part)
        self.discard([at for t, at in state["retired"] if now - t >= self.retain])
        for k in self._numbers()[:-2]:
            os.remove(os.path.join(self.path, f"state-{k}.json"))

    def discard(self, folders: list[str]) -> None:
        for at in folders:
            shutil.rmtree(os.path.join(self.path, at), ignore_errors=True)
            above = os.path.join(self.path, at.split("/")[0])
            if "/" in at and os.path.isdir(above) and not any(n.startswith(KEY) for n in os.listdir(above)):
                shutil.rmtree(above, ignore_errors=True)

    @contextlib.contextmanager
    def writing(self):
        """A list for segments that are written; if what follows fails, they are deleted."""
        made: list[list[Segment]] = []
        try:
            yield made
        except BaseException:
            self.discard([at for some in made for _, at in some])
            raise

    def replace(self, state: dict, **tables: DataFrame) -> None:
        """Write whole tables anew, made from those of ``state``, as segments without a key."""
        with self.writing() as made:
            changed = {}
            for name, df in tables.items():
                made.append(self.write(name, df, None, state["version"]))
                changed[name] = ([tuple(s) for s in state["tables"].get(name, [])], made[-1])
            self.commit(state, changed)

    def migrate(self, version: int = migrations.LATEST) -> None:
        """Take steps forward or back until the store has the given version; each is a change of its own."""
        while (now := (state := self._state())["version"]) != version:
            step = migrations.STEPS[now if version > now else now - 1]
            with self.writing() as made:
                changed = step.forward(self, state, made) if version > now else step.back(self, state, made)
                self.commit(state, changed, version=now + 1 if version > now else now - 1)

    # --- changes -----------------------------------------------------------------------------------------------------

    @staticmethod
    def _files(scanned: DataFrame) -> DataFrame:
        """Scanned rows as rows of rom_files."""
        rows = scanned.withColumn("id", F.xxhash64("path", "name", "entry_seq"))
        return rows.select(*[(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schemas.ROM_FILES])

    def _touched(self, state: dict, name: str, keys: set[str]) -> list[Segment]:
        return [tuple(s) for s in state["tables"].get(name, []) if s[0] is None or s[0] in keys]

    def import_catalogue(self, dat: Catalogue) -> list[int]:
        """Store catalogues, replacing those with the same header name with all their games and roms; the new ids.

        Of catalogues, games and roms only the segments of the names and ids concerned are read and rewritten.
        """
        state = self._state()
        distinct = lambda c, df: {r[0] for r in df.select(bucket(c)).distinct().collect()}
        latest = catalogue.latest_by(dat.header, ["name"], "file_name")
        header = running(latest, [], ["name"], {"nr": F.lit(1)}).withColumn("id", (F.col("nr") + state["next"] - 1).cast("long")).drop("nr").cache()  # a row a catalogue
        n = header.count()
        by_name = distinct(F.col("name"), header)
        old_files = self.read("data_files", {None, *by_name}, state)
        gone = old_files.join(header.select("name"), "name", "left_semi")
        by_id = distinct(F.col("id"), gone.select("id").union(header.select("id")))
        old_games, old_roms = (self.read(name, {None, *by_id}, state) for name in ("games", "roms"))
        gone_games = old_games.join(gone.select(F.col("id").alias("data_file_id")), "data_file_id", "left_semi")
        of_file = header.select("file_name", F.col("id").alias("data_file_id"))
        games = catalogue.latest_by(dat.games.join(of_file, "file_name").drop("source_file"), ["data_file_id", "name"], "game_seq")
        games = games.withColumn("id", F.xxhash64("data_file_id", "name"))
        game_ids = games.select("file_name", "game_seq", F.col("id").alias("game_id"), "data_file_id")
        roms = catalogue.latest_by(dat.roms.join(game_ids, ["file_name", "game_seq"]), ["game_id", "name"], "rom_seq")
        roms = roms.withColumn("id", F.xxhash64("game_id", "name")).withColumn("date", F.lit(None).cast("date"))

        def fill(df: DataFrame, name: str, *more: str) -> DataFrame:
            return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in TABLES[name]], *more)

        catalogue_of = old_games.select(F.col("id").alias("game_id"), "data_file_id")
        kept_roms = catalogue.without_children(old_roms, gone_games, "game_id").join(catalogue_of, "game_id", "left")
        kept_games = catalogue.without_children(old_games, gone, "data_file_id")
        with self.writing() as made:
            made.append(self.write("data_files", catalogue.upsert(old_files, fill(header, "data_files"), ["name"]), bucket(F.col("name"))))
            made.append(self.write("games", kept_games.unionByName(catalogue.parent_links(fill(games, "games"))), bucket(F.col("data_file_id"))))
            made.append(self.write("roms", fill(kept_roms, "roms", "data_file_id").unionByName(fill(roms, "roms", "data_file_id")), bucket(F.col("data_file_id"))))
            names = ("data_files", "games", "roms")
            going = [self._touched(state, name, by_name if name == "data_files" else by_id) for name in names]
            self.commit(state, dict(zip(names, zip(going, made))), next=state["next"] + n)
        ids = [r[0] for r in header.select("id").orderBy("id").collect()]
        header.unpersist()
        return ids

    def replace_scanned(self, scanned: DataFrame, root: str) -> tuple[int, int]:
        """Replace all files under a root by the rows of a scan; numbers of files, and of those that belong to a rom.

        Segments of roots under this one go. Those of roots above it, and those without a key, are rewritten if they hold
        files under it. All others stay as they are.
        """
        state = self._state()
        going, changed = [], []
        for s in map(tuple, state["tables"].get("rom_files", [])):
            if s[0] is not None and is_under(s[0], root):
                going.append(s)
            elif s[0] is None or is_under(root, s[0]):
                rows = self.spark.read.schema(schemas.ROM_FILES).option("recursiveFileLookup", "true").parquet(os.path.join(self.path, s[1]))
                if not rows.filter(paths.under(F.col("path"), root)).isEmpty():
                    going.append(s)
                    changed.append((s[0], rows.filter(~paths.under(F.col("path"), root))))
        with self.writing() as made:
            made.append(self.write("rom_files", self._files(scanned), root))
            for key, rows in changed:
                made.append(self.write("rom_files", rows, key))
            self.commit(state, {"rom_files": (going, [s for some in made for s in some])})
        new = self.spark.read.schema(schemas.ROM_FILES).parquet(os.path.join(self.path, made[0][0][1]))
        found = catalogue.associate(new, self.read("roms")).agg(F.count("*"), F.count("rom_id")).first()
        return found[0], found[1]

    def append_scanned(self, scanned: DataFrame) -> None:
        """Add rows of a scan without replacing any."""
        state = self._state()
        with self.writing() as made:
            made.append(self.write("rom_files", self._files(scanned), None))
            self.commit(state, {"rom_files": ([], made[0])})

    # --- questions ---------------------------------------------------------------------------------------------------

    def find_catalogues(self, selectors: DataFrame) -> DataFrame:
        """(selector, id, name) of the catalogues with these file names, else with these header names; the newest of several."""
        files = self.read("data_files").select("id", "file_name", "name")
        asked = selectors.select("selector").distinct()
        met = [asked.join(files.withColumn("selector", F.col(c)).withColumn("rank", F.lit(k)), "selector") for k, c in enumerate(("file_name", "name"))]
        first = met[0].unionByName(met[1]).groupBy("selector").agg(F.min_by(F.struct("id", "name"), F.struct("rank", -F.col("id"))).alias("c"))
        return first.select("selector", "c.id", "c.name")

    def find_catalogue(self, selector: str) -> tuple[int, str]:
        """(id, name) of one catalogue."""
        found = self.find_catalogues(self.spark.createDataFrame([(selector,)], "selector string")).collect()
        if not found:
            raise CatalogueError(f"no catalogue {selector!r} in {self.path}")
        return found[0]["id"], found[0]["name"]

    def entries(self, data_file_id: int, dat_name: str) -> DataFrame:
        """The planner's entries of one catalogue; a digest that is not 20 bytes long is an error."""
        key = {None, self.spark.range(1).select(bucket(F.lit(data_file_id).cast("long"))).first()[0]}
        rows = catalogue.join_roms(self.read("games", key), self.read("roms", key), data_file_id)
        return rows.select(F.lit(dat_name).alias("dat_name"), F.col("g.name").alias("game_name"), F.col("g.clone_of").alias("parent_name"), F.col("r.name").alias("rom_name"), text.checked_sha1(F.col("r.sha1"), F.col("r.name")).alias("sha1"))

    def sources(self) -> DataFrame:
        """The planner's sources: all scanned files, each digest checked before any filter."""
        rows = self.read("rom_files")
        kind = F.coalesce("kind", paths.source_kind(F.col("in_archive"), F.col("path")))
        return rows.select(F.col("parent_path").alias("source_root"), F.col("path").alias("canonical_path"), F.when(F.col("in_archive"), F.col("name")).alias("entry_name"), kind.alias("kind"), text.checked_sha1(F.col("sha1"), F.col("path")).alias("sha1"), F.col("entry_seq").cast("long").alias("seq"))
