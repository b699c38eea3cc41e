"""The steps by which the tables of a store came to be what they are, each with its way back.

A step's ``forward`` and ``back`` write what must change and give, for each table, the segments that go and those that
come; the store makes them current as one change, which fails if another writer was faster. Columns that a step adds read
as null in older files; going back writes the tables without them, so that going forward again does not bring old values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from setforge import schemas
from setforge.errors import CatalogueError

ARCHIVE_FILES = T.StructType().add("id", T.LongType()).add("path", T.StringType()).add("sha1", T.BinaryType())
TABLES = {"data_files": schemas.DATA_FILES, "games": schemas.GAMES, "roms": schemas.ROMS, "rom_files": schemas.ROM_FILES, "archive_files": ARCHIVE_FILES}

Change = dict[str, tuple[list, list]]


@dataclass(frozen=True)
class Step:
    """tables and columns that it adds; tables that it lays out by key, with the column of the key; a rule that holds before it."""

    name: str
    tables: tuple[str, ...] = ()
    columns: tuple[tuple[str, str], ...] = ()
    keyed: tuple[str, ...] = ()
    before: Callable | None = None

    def forward(self, store, state: dict, made: list) -> Change:
        return {name: _laid_out(store, state, name, made, state["version"] + 1) for name in self.keyed}

    def back(self, store, state: dict, made: list) -> Change:
        if self.before:
            self.before(store, state)
        version = state["version"] - 1
        out = {name: ([tuple(s) for s in state["tables"].get(name, [])], []) for name in self.tables}
        for name in dict.fromkeys([*(t for t, _ in self.columns), *self.keyed]):
            old, come = [tuple(s) for s in state["tables"].get(name, [])], []
            if not old:
                continue
            for key in {None} if name in self.keyed else dict.fromkeys(s[0] for s in old):  # without keys, or key by key
                made.append(store.write(name, store.read(name, None if name in self.keyed else {key}, state), key, version))
                come += made[-1]
            out[name] = (old, come)
        return out


def _laid_out(store, state: dict, name: str, made: list, version: int) -> tuple[list, list]:
    """The segments without a key, and the same rows by key."""
    from pyspark.sql import functions as F

    from setforge.operators.store import bucket

    old = [tuple(s) for s in state["tables"].get(name, []) if s[0] is None]
    if not old:
        return [], []
    rows = store.read(name, {None}, state)
    if name == "roms":
        games = store.read("games", None, state).select(F.col("id").alias("game_id"), "data_file_id")
        rows = rows.join(games, "game_id", "left")
    made.append(store.write(name, rows, bucket(F.col({"data_files": "name"}.get(name, "data_file_id"))), version))
    return old, made[-1]


def _names_are_unique(store, state: dict) -> None:
    """Before names were scoped, those of games and of roms had to differ in the whole store."""
    from pyspark.sql import functions as F

    for name in ("games", "roms"):
        twice = store.read(name, None, state).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name").limit(1).collect()
        if twice:
            raise CatalogueError(f"{store.path}: {name}: {twice[0][0]!r} stands more than once, which the earlier version forbids")


#: In their order; a store of version k has taken the first k.
STEPS = (
    Step("catalogues", tables=("data_files",)),
    Step("games", tables=("games",)),
    Step("roms", tables=("roms",)),
    Step("lookups", keyed=("games", "roms")),  # instead of indices
    Step("scanned files", tables=("rom_files",)),
    Step("archives", tables=("archive_files",), columns=(("roms", "archive_file_id"),)),
    Step("lookups of relations", keyed=("data_files",)),
    Step("names by catalogue and game", before=_names_are_unique),
    Step("kinds of files and order of entries", columns=(("rom_files", "kind"), ("rom_files", "entry_seq"))),
)
LATEST = len(STEPS)
#: The version of stores with one folder a table: all tables and columns are there, keys come with the next change.
BEFORE_SEGMENTS = LATEST


def schema(name: str, version: int) -> T.StructType:
    """A table's columns in a version; none before the step that adds it."""
    if not any(name in s.tables for s in STEPS[:version]):
        return T.StructType()
    later = {c for s in STEPS[version:] for t, c in s.columns if t == name}
    return T.StructType([f for f in TABLES[name] if f.name not in later])
