"""The build plan: which source file serves which catalogue entry, what is missing, what is doubled, what goes where.

Pure functions over two relations, evaluated lazily by Spark:

* entries: dat_name, game_name, parent_name, rom_name, sha1
* sources: source_root, canonical_path, entry_name, kind (bare, zip, archive), sha1, and a last tie-breaker seq

Content is matched by SHA-1 alone. The choice among several sources of one digest is an aggregate (a minimum of
structs), which Spark sums up before its shuffle, so a digest with very many copies is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions import paths
from setforge.operators.ordinals import MOST, ordinals

PARENT_BUNDLES, PER_GAME = "parent-bundles", "per-game"
#: Items of a list that is cut into chunks.
CHUNK = 1000


def priority(kind: Column) -> Column:
    return F.when(kind == "bare", 0).when(kind == "zip", 1).otherwise(2)


def display_name(path: Column, entry: Column) -> Column:
    return F.concat_ws(":", path, entry)


def bundle_name(mode: str) -> Column:
    """Parent (the raw text of the entry, one level) or game, with the ending."""
    name = F.coalesce("parent_name", "game_name") if mode == PARENT_BUNDLES else F.col("game_name")
    return F.concat(name, F.lit(".zip"))


def scope_entries(entries: DataFrame, dat_name: str) -> DataFrame:
    return entries.filter(F.col("dat_name") == dat_name)


def scope_sources(sources: DataFrame, root: str) -> DataFrame:
    return sources.filter((F.col("source_root") == root) | paths.under(F.col("canonical_path"), root))


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, the root folder too."""
    n = F.size(F.split(path, "/"))
    up = F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", path, F.lit("/"), k))
    return F.transform(up, lambda p: F.when(p == "", "/").otherwise(p))


def sources_of_roots(sources: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ...) of the sources that lie under each of many roots, or were scanned from it: an equality join with all folders above a path."""
    names = F.array_distinct(F.array_append(ancestors(F.col("canonical_path")), F.col("source_root")))
    asked = roots.select(F.when(F.col("root") == "/", "/").otherwise(F.rtrim(F.col("root"), F.lit("/"))).alias("root")).distinct()
    return sources.withColumn("root", F.explode(names)).join(asked, "root").select("root", *sources.columns)


def _candidate() -> Column:
    """A source as a struct whose order is the order of choice; a null entry comes first, seq settles full ties."""
    return F.struct(priority(F.col("kind")).alias("prio"), F.col("canonical_path"), F.col("entry_name"), F.col("seq"), F.col("kind"))


def best_sources(sources: DataFrame) -> DataFrame:
    """(sha1, best, n_candidates): the chosen source of every digest."""
    return sources.groupBy("sha1").agg(F.min(_candidate()).alias("best"), F.count("*").alias("n_candidates"))


def candidate_lists(sources: DataFrame) -> DataFrame:
    """(sha1, candidates) in order of choice. A list holds all copies of a digest; use candidate_chunks where they are very many."""
    return sources.groupBy("sha1").agg(F.sort_array(F.collect_list(_candidate())).alias("candidates"))


def chunked(rows: DataFrame, key: str, order: list, item: Column, name: str, most: int, hot: int) -> DataFrame:
    """(key, chunk, name): the items of each key in order as lists of at most ``most``, numbered from 0; a key may have any number of rows."""
    ranked = ordinals(rows.withColumn("__item", item), [key], order, "__nr", hot)
    one = F.struct("__nr", "__item")
    lists = ranked.groupBy(key, F.floor((F.col("__nr") - 1) / most).alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("l"))
    return lists.select(key, "chunk", F.transform("l", lambda x: x["__item"]).alias(name))


def candidate_chunks(sources: DataFrame, most: int = CHUNK, hot: int = MOST) -> DataFrame:
    """(sha1, chunk, candidates): the candidates of a digest in order of choice, in lists of bounded length."""
    c = _candidate()
    return chunked(sources, "sha1", [c], c, "candidates", most, hot)


def resolve(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every entry with its best source (null if missing) and the number of candidates."""
    return entries.join(best_sources(sources), "sha1", "left")


def missing(entries: DataFrame, sources: DataFrame) -> DataFrame:
    return entries.join(sources.select("sha1").distinct(), "sha1", "left_anti").select("game_name", "rom_name", "sha1")


def matched(entries: DataFrame, sources: DataFrame) -> DataFrame:
    return entries.join(sources.select("sha1").distinct(), "sha1", "left_semi")


def duplicate_matches(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(rom_name, sha1, selected, n_candidates) of entries with several candidates."""
    found = resolve(entries, sources).filter(F.col("n_candidates") > 1)
    return found.select("rom_name", "sha1", display_name(F.col("best.canonical_path"), F.col("best.entry_name")).alias("selected"), "n_candidates")


def candidate_rows(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each candidate of the duplicate matches: (rom_name, sha1, candidate)."""
    found = duplicate_matches(entries, sources).select("rom_name", "sha1")
    return found.join(sources, "sha1").select("rom_name", "sha1", display_name(F.col("canonical_path"), F.col("entry_name")).alias("candidate"))


def bundle_entries(entries: DataFrame, sources: DataFrame, mode: str = PARENT_BUNDLES) -> DataFrame:
    """(zip, rom_name, source, ...) of all matched entries, one row each."""
    found = resolve(entries, sources).filter(F.col("best").isNotNull())
    return found.select(
        bundle_name(mode).alias("zip"), "dat_name", "game_name", "parent_name", "rom_name", "sha1",
        F.col("best.canonical_path").alias("canonical_path"), F.col("best.entry_name").alias("entry_name"), F.col("best.kind").alias("kind"),
    )


def bundles(entries: DataFrame, sources: DataFrame, mode: str = PARENT_BUNDLES) -> DataFrame:
    """(zip, entries): bundles that have a match, their entries in catalogue order. One bundle's list is the content of one file."""
    rows = bundle_entries(entries, sources, mode)
    entry = F.struct("dat_name", "game_name", "parent_name", "rom_name", "sha1", "canonical_path", "entry_name", "kind")
    return rows.groupBy("zip").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def bundle_chunks(entries: DataFrame, sources: DataFrame, mode: str = PARENT_BUNDLES, most: int = CHUNK, hot: int = MOST) -> DataFrame:
    """(zip, chunk, entries): the entries of a bundle in catalogue order, in lists of bounded length."""
    names = ["dat_name", "game_name", "parent_name", "rom_name", "sha1", "canonical_path", "entry_name", "kind"]
    return chunked(bundle_entries(entries, sources, mode), "zip", names, F.struct(*names), "entries", most, hot)


def summary(entries: DataFrame, sources: DataFrame, strict: bool = False, dry_run: bool = False) -> DataFrame:
    """One row: matched, missing and duplicate entries, the exit code, and whether files are to be written."""
    counts = resolve(entries, sources).agg(
        F.count_if(F.col("best").isNotNull()).alias("matched"),
        F.count_if(F.col("best").isNull()).alias("missing"),
        F.count_if(F.col("n_candidates") > 1).alias("duplicates"),
    )
    code = F.when(F.lit(strict) & (F.col("missing") > 0), 2).otherwise(0)
    return counts.withColumn("exit_code", code).withColumn("writes_files", F.lit(not dry_run) & (F.col("matched") > 0) & (F.col("exit_code") == 0))


def bundle_summary(entries: DataFrame, sources: DataFrame, mode: str = PARENT_BUNDLES) -> DataFrame:
    """(zip, roms, matched, missing, duplicates) of every bundle name."""
    return (
        resolve(entries, sources)
        .groupBy(bundle_name(mode).alias("zip"))
        .agg(
            F.count("*").alias("roms"),
            F.count_if(F.col("best").isNotNull()).alias("matched"),
            F.count_if(F.col("best").isNull()).alias("missing"),
            F.count_if(F.col("n_candidates") > 1).alias("duplicates"),
        )
    )
