"""A catalogue made from public sources: prepared trees are scanned, filtered, named and written as XML and JSON."""

from __future__ import annotations

import os
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.errors import ArchiveError, PlanError
from setforge.functions import paths, text
from setforge.operators import admission, catalogue, reports
from setforge.sources import catalog
from setforge.sources.filetree import canonical, digests, read_tree

#: Longest game name, and how many games a catalogue has unless told otherwise (0: all).
NAME_LENGTH, MAX_ROMS = 80, 128
#: Where the files of a source lie: below it, identifier and file name. A fixed value.
ADDRESS = "https://archive.org/download"


#: A hidden name, so that no scan sees it: the source was prepared wholly.
_DONE = ".prepared"


def _tool(*command: str) -> None:
    if not shutil.which(command[0]):
        raise PlanError(f"{command[0]} is not installed")
    done = subprocess.run(command, capture_output=True, text=True)
    if done.returncode:
        raise ArchiveError(f"{' '.join(command)}: {done.stderr.strip()}")


def prepare_source(kind: str, downloaded: str, root: str, refresh: bool = True) -> str:
    """Make a tree of a downloaded file: an archive is unpacked, a git bundle checked out, another file copied.

    Without ``refresh`` a tree that was prepared before stays. Any other kind is an error.
    """
    mark = os.path.join(root, _DONE)
    if not refresh and os.path.exists(mark):
        return root
    shutil.rmtree(root, ignore_errors=True)
    os.makedirs(root)
    if kind == "archive":
        _tool("bsdtar", "-xf", downloaded, "-C", root)
    elif kind == "git_bundle":
        _tool("git", "clone", "--quiet", downloaded, root)
    elif kind == "direct":
        shutil.copy(downloaded, root)
    else:
        raise PlanError(f"cannot prepare a source of kind {kind}")
    with open(mark, "w", encoding="utf-8"):
        pass
    return root


def tree_roms(spark: SparkSession, root: str, source: dict) -> DataFrame:
    """Admitted files of one tree, archives exploded as far as they can be read.

    source: tier, evidence, allow_extensionless and exclude_disallowed (0 or 1), seq (its place in the list).
    Archives other than ZIP are not looked into here, as files they have no admitted ending.
    """
    root = canonical(root)
    rows = read_tree(spark, root, permissive=True)
    relative = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    tier, extra, strict = F.lit(source["tier"]), F.lit(source["allow_extensionless"]), F.lit(source["exclude_disallowed"])
    rows = rows.withColumn("source", relative).filter(~F.col("source").startswith(".git/"))
    of_zip = F.col("kind") == "zip"
    taken = F.when(of_zip, admission.is_rom_name(F.col("name"))).when(F.col("in_archive"), False).otherwise(admission.takes_file(F.col("name"), extra))
    refused = admission.excluded(tier, strict, F.col("source")) | (of_zip & admission.excluded(tier, strict, F.col("name")))
    return rows.filter(taken & ~refused).select(
        F.lit(source["seq"]).alias("source_seq"), "source", "entry_seq", F.col("name").alias("rom_name"), "size",
        F.lower(F.hex("sha1")).alias("sha1"), F.lower(F.hex("md5")).alias("md5"), F.lit("00000000").alias("crc"),
        tier.alias("evidence_tier"), F.lit(source["evidence"]).alias("evidence"),
    )


ORDER = ["source_seq", "source", "entry_seq"]


def named(roms: DataFrame, most: int = MAX_ROMS) -> DataFrame:
    """The first ``most`` roms in order (0: all) with unique game names."""
    first = catalogue.capped(roms, ORDER, most)
    stem = lambda c: text.safe_name(paths.stem(F.col(c)))
    base = text.safe_name(text.game_name(stem("source"), stem("rom_name")))
    return catalogue.unique_names(first, base, ORDER, NAME_LENGTH).withColumnRenamed("unique_name", "game_name").drop("base", "occurrence")


def write_catalogue(spark: SparkSession, sources: list[dict], work_dir: str, header: dict[str, str], policy: dict, most: int = MAX_ROMS) -> int:
    """Write ``catalogue.dat`` and ``manifest.json`` from prepared sources (each with prepared_root); the number of games."""
    roms = None
    for k, s in enumerate(sources):
        part = tree_roms(spark, s["prepared_root"], {**s, "seq": k})
        roms = part if roms is None else roms.unionByName(part)
    if roms is None:
        raise PlanError("no sources")
    games = named(roms, most).cache()
    try:
        os.makedirs(work_dir, exist_ok=True)
        n = reports.write_dat(games, ORDER, os.path.join(work_dir, "catalogue.dat"), header)
        if not n:
            raise PlanError("no files of the sources are admitted")
        fields = ["game_name", "rom_name", "size", "crc", "md5", "sha1", "source", "evidence_tier", "evidence"]
        listed = spark.createDataFrame([{k: str(v) for k, v in s.items()} for s in sources])
        reports.write_manifest(policy, listed, games.select(*ORDER, *[f for f in fields if f not in ORDER]), ORDER, os.path.join(work_dir, "manifest.json"))
        return n
    finally:
        games.unpersist()


def gather(spark: SparkSession, listed: str, metadata: str, downloads: str, work_dir: str, policy: dict, tier: str = "curated", most: int = MAX_ROMS, refresh: bool = False) -> int:
    """Catalogue and manifest (in ``work_dir``) of the listed sources of a tier; the number of games.

    listed: the file of sources; metadata: a folder of their JSON documents; downloads: a folder with the files, named
    identifier__stem.ending in safe characters. Nothing is downloaded: a file that lacks is an error with its address,
    one whose SHA-1 is not the listed one is removed and an error. Trees are prepared below ``work_dir``/sources.
    """
    rows = catalog.read_catalog(spark, f"file://{canonical(listed)}").withColumn("place", F.monotonically_increasing_id())
    known = catalog.read_metadata(spark, f"file://{canonical(metadata)}")
    stem, ending = text.safe_name(paths.stem(F.col("file_name"))), paths.extension(F.col("file_name"))
    checked = admission.checked_sources(admission.selected_catalog(rows, tier), known)
    checked = checked.withColumn("own", F.concat_ws("__", text.safe_name(F.col("identifier")), stem)).withColumn("ending", F.when(ending == "", "").otherwise(F.concat(F.lit("."), ending)))
    checked = checked.withColumn("address", text.download_url(ADDRESS, F.col("identifier"), F.col("file_name")))
    sources = []
    for r in checked.orderBy("place").collect():  # the list of sources is short
        file = os.path.join(downloads, r["own"] + r["ending"])
        if not os.path.exists(file):
            raise PlanError(f"{file} is not there; it comes from {r['address']}")
        with open(file, "rb") as f:
            sha1 = digests(f)[0].hex()
        if r["expected_sha1"] and r["expected_sha1"].lower() != sha1:
            os.remove(file)
            raise PlanError(f"{file}: SHA-1 {sha1} instead of {r['expected_sha1']}")
        root = prepare_source(r["kind"], file, os.path.join(work_dir, "sources", r["own"]), refresh)
        sources.append({**{k: r[k] for k in ("identifier", "file_name", "kind", "tier", "evidence", "allow_extensionless", "exclude_disallowed")}, "downloaded_file": file, "downloaded_sha1": sha1, "prepared_root": root})
    return write_catalogue(spark, sources, work_dir, {"name": "Public sources", "description": "Files of public sources"}, policy, most)
