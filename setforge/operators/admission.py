"""Which files and sources of a public catalogue are admitted: extension lists, name filters, licence and signal predicates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions.paths import extension

# What counts as a ROM or an archive, which names are refused, which texts are evidence.
ROM_EXTENSIONS = ("bin", "ch8", "chip8", "gb", "gba", "gbc", "n64", "nes", "rom", "sfc", "smc", "v64", "z64")
ARCHIVE_EXTENSIONS = ("zip", "7z")
DISALLOWED = ("donkey kong", "goldeneye", "nintendo", "quake", "sonic", "spice girls", "super bomberman", "tetris", "topgun", "virtual springfield")
LICENCES = ("creativecommons.org/publicdomain/mark", "creativecommons.org/publicdomain/zero")
SIGNALS = ("public domain", "pd rom", "pdrom", "homebrew")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return reduce(or_, [lower.contains(n) for n in needles])


def is_rom_name(name: Column) -> Column:
    return F.lower(extension(name)).isin(*ROM_EXTENSIONS)


def is_archive_name(name: Column) -> Column:
    return F.lower(extension(name)).isin(*ARCHIVE_EXTENSIONS)


def is_disallowed(name: Column) -> Column:
    return contains_any(name, DISALLOWED)


def has_licence(url: Column) -> Column:
    return contains_any(url, LICENCES)


def has_signal(title: Column, description: Column, subject: Column) -> Column:
    return contains_any(F.concat_ws(" ", title, description, subject), SIGNALS)


def admitted(tier: Column, licence: Column, signal: Column) -> Column:
    return licence | ((tier == "curated") & signal)


def excluded(tier: Column, exclude_disallowed: Column, name: Column) -> Column:
    """Disallowed names are left out of curated sources, and of others whose row says so."""
    return ((tier == "curated") | (exclude_disallowed == 1)) & is_disallowed(name)


def takes_file(name: Column, allow_extensionless: Column) -> Column:
    return is_rom_name(name) | ((allow_extensionless == 1) & (extension(name) == ""))


def selected_catalog(catalog: DataFrame, tier: str) -> DataFrame:
    """The metadata tier only, or every row for the curated tier."""
    return catalog.filter(F.col("tier") == "metadata") if tier == "metadata" else catalog


def listed_sha1(files: Column, name: Column) -> Column:
    """Digest of the named file in a metadata file list; empty if it has none, null if it is not listed."""
    hit = F.get(F.filter(files, lambda f: f["name"] == name), 0)
    return F.when(hit.isNotNull(), F.coalesce(hit["sha1"], F.lit("")))


def checked_sources(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Catalogue rows with their expected digest; an error for a row whose file is not listed or whose evidence is too weak.

    metadata: identifier, metadata, files. The errors stand in a column that is used, so no plan can prune them.
    """
    rows = catalog.join(metadata, "identifier", "left")
    expected = listed_sha1(F.col("files"), F.col("file_name"))
    m = F.col("metadata")
    ok = admitted(F.col("tier"), has_licence(m["licenseurl"]), has_signal(m["title"], m["description"], m["subject"]))
    said = F.concat_ws(" ", F.lit("refused:"), "identifier", "file_name")
    sha1 = F.when(expected.isNull(), F.raise_error(F.concat_ws(" ", F.lit("not listed:"), "identifier", "file_name"))).when(~ok, F.raise_error(said)).otherwise(expected)
    return rows.select(*catalog.columns, sha1.cast("string").alias("expected_sha1"))
