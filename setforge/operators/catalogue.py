"""Relational steps of the catalogue store: joins, upserts, parent links, association, and checks before writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions import paths
from setforge.operators.ordinals import MOST, ordinals


def join_roms(games: DataFrame, roms: DataFrame, data_file_id: int | None = None) -> DataFrame:
    """Games with their roms, of one catalogue if given; the filter reaches the scan of games."""
    if data_file_id is not None:
        games = games.filter(F.col("data_file_id") == data_file_id)
    return games.alias("g").join(roms.alias("r"), F.col("r.game_id") == F.col("g.id"))


def latest_by(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq, an aggregate that is summed up before its shuffle."""
    row = F.struct(seq, *[c for c in rows.columns if c not in (seq, *key)])
    return rows.groupBy(*key).agg(F.max(row).alias("__row")).select(*key, "__row.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without_children(rows: DataFrame, parents: DataFrame, column: str, parent_id: str = "id") -> DataFrame:
    """Rows that do not belong to any of the given parents."""
    return rows.join(parents.select(F.col(parent_id).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def parent_links(games: DataFrame) -> DataFrame:
    """``games`` with parent_id: the game of the same catalogue whose name is this one's clone_of."""
    parents = games.select(F.col("data_file_id").alias("p_file"), F.col("name").alias("p_name"), F.col("id").alias("p_id"))
    on = (games["data_file_id"] == F.col("p_file")) & (games["clone_of"] == F.col("p_name"))
    return games.join(parents, on, "left").select(*[games[c] for c in games.columns if c != "parent_id"], F.col("p_id").alias("parent_id"))


def associate(files: DataFrame, roms: DataFrame) -> DataFrame:
    """``files`` with rom_id, the least id of the roms with the same digest."""
    least = roms.groupBy("sha1").agg(F.min("id").alias("rom_id"))
    return files.drop("rom_id").join(least, "sha1", "left")


def replace_under_root(old: DataFrame, new: DataFrame, root: str, path: str = "path") -> DataFrame:
    """All rows of ``old`` that are not under the root, and ``new``."""
    return old.filter(~paths.under(F.col(path), root)).unionByName(new)


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def numbered(rows: DataFrame, base: Column, order: list[str], hot: int = MOST) -> DataFrame:
    """``rows`` with occurrence, the ordinal of a row among those of the same base; bases of over ``hot`` rows are dealt out."""
    return ordinals(rows.withColumn("base", base), ["base"], order, "occurrence", hot)


def unique_names(rows: DataFrame, base: Column, order: list[str], most: int = 80, hot: int = MOST) -> DataFrame:
    """``rows`` with unique_name: bases cut to ``most`` characters, ``rom`` where empty; of those that repeat, the second and
    later ones are numbered ``_2``, ``_3``, ..., cut so that the whole name keeps to ``most``."""
    cut = F.substring(base, 1, most)
    out = numbered(rows, F.when(F.coalesce(cut, F.lit("")) == "", "rom").otherwise(cut), order, hot)
    suffix = F.concat(F.lit("_"), F.col("occurrence"))
    name = F.concat(F.left("base", F.lit(most) - F.length(suffix)), suffix)
    return out.withColumn("unique_name", F.when(F.col("occurrence") == 1, F.col("base")).otherwise(name))


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in order, all of them for 0."""
    return rows.orderBy(*order).limit(most) if most else rows
