"""Workflows: import a catalogue, scan a source, build bundles, or all at once."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from setforge.errors import CatalogueError, InvalidPath
from setforge.operators import reports, zip_sink
from setforge.operators.store import Store
from setforge.plans import planner
from setforge.sources import dat
from setforge.sources.filetree import canonical, read_tree

#: Rows of missing and doubled entries that are logged; the relations themselves are complete.
LOGGED = 50


@dataclass
class BuildReport:
    matched: int
    missing: int
    duplicates: int
    exit_code: int
    bundles: int = 0
    written: int = 0
    files: DataFrame | None = None  #: path and number of entries of each bundle written


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path)


def import_dat(store: Store, path: str) -> int:
    """The id under which the catalogue of a file is stored."""
    where = canonical(path)
    try:
        ids = store.import_catalogue(dat.read_catalogues(store.spark, f"file://{where}"))
    except Exception as e:
        raise CatalogueError(f"{path}: {str(e).splitlines()[0]}") from e
    return ids[-1]


def scan_source(store: Store, path: str) -> tuple[int, int]:
    """(files, files that belong to a known rom) of a tree, which replace all stored rows under it."""
    root = canonical(path)
    files, known = store.replace_scanned(read_tree(store.spark, root, exclude=[store.path]), root)
    if files and not known:
        reports.log.warning("%d files scanned under %s, none of them belongs to a known catalogue", files, root)
    return files, known


def build(store: Store, selector: str, source: str, destination: str, layout: str = planner.PARENT_BUNDLES, compression: str = "deflate", strict: bool = False, dry_run: bool = False) -> BuildReport:
    """Plan and write the bundles of one catalogue, named by its file or its header, from one source tree."""
    root = canonical(source)
    if os.path.exists(selector):
        selector = canonical(selector)
    data_file_id, name = store.find_catalogue(selector)
    entries = store.entries(data_file_id, name).cache()
    sources = planner.scope_sources(store.sources(), root)
    try:
        s = planner.summary(entries, sources, strict, dry_run).first()
        missing = planner.missing(entries, sources).orderBy("game_name", "rom_name").limit(LOGGED).collect() if s["missing"] else []
        doubled = planner.duplicate_matches(entries, sources).orderBy("rom_name").limit(LOGGED).collect() if s["duplicates"] else []
        reports.log_outcome(s, missing, doubled)
        out = BuildReport(s["matched"], s["missing"], s["duplicates"], s["exit_code"])
        rows = planner.bundle_entries(entries, sources, layout)
        if out.exit_code == 0:
            out.bundles = rows.select("zip").distinct().count()
        if s["writes_files"]:
            out.files = zip_sink.write_bundles(rows, destination, compression)
            out.written = out.files.count()
        return out
    finally:
        entries.unpersist()


def run(store: Store, dat_path: str, source: str, destination: str, **options) -> BuildReport:
    """Import, scan and build."""
    if not os.path.exists(dat_path):
        raise InvalidPath(f"{dat_path}: no such file")
    import_dat(store, dat_path)
    scan_source(store, source)
    return build(store, dat_path, source, destination, **options)
