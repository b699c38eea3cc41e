"""Catalogues in XML: one ``datafile`` a file, games with their roms, digests in hex.

:func:`read_catalogues` reads a file in parts, one record for each game, by as many tasks as the file has ranges. It cuts
at ``<game``, which must therefore not stand in a comment or a CDATA section. :func:`read_dat` has whole documents, and
:func:`parse_dat` those in a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge import schemas
from setforge.functions.text import from_hex
from setforge.sources import parts


@dataclass
class Catalogue:
    """header: one row a file; games: (file_name, game_seq, ...); roms: (file_name, game_seq, rom_seq, ...)."""

    header: DataFrame
    games: DataFrame
    roms: DataFrame


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha1, datafile) of the catalogues at a path; unreadable XML is an error."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    doc = F.from_xml(F.decode("content", "UTF-8"), schemas.DATAFILE, {"mode": "FAILFAST", "attributePrefix": "_"})
    return files.select(name.alias("file_name"), F.unhex(F.sha1("content")).alias("sha1"), doc.alias("datafile"))


def read_dat_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same documents through Spark's XML reader, which splits large inputs by files; without name and digest."""
    return spark.read.format("xml").option("rowTag", "datafile").option("attributePrefix", "_").option("mode", "FAILFAST").schema(schemas.DATAFILE).load(path)


END = r"</datafile\s*>\s*(<!--[\s\S]*?-->\s*)*$"
XML = {"mode": "FAILFAST", "attributePrefix": "_"}


def read_catalogues(spark: SparkSession, path: str) -> Catalogue:
    """The catalogues at a path, each read by many tasks. XML that can't be read, or that ends early, is an error."""
    ended = lambda text: text.rlike(END)
    body = lambda text: F.regexp_replace(text, END, "")
    is_game = lambda text: text.rlike(r"^[\s/>]") & ~text.rlike(r"<datafile[\s>]")

    def game(text: Column) -> Column:
        return F.when(is_game(text), F.from_xml(F.concat(F.lit("<game"), body(text)), schemas.GAME, XML))

    def head(text: Column) -> Column:
        whole = F.concat(F.regexp_replace(body(text), "^\ufeff", ""), F.lit("</datafile>"))
        wrong = F.raise_error(F.lit("catalogue: neither a game nor the beginning of a datafile")).cast(schemas.HEAD.simpleString())
        return F.when(is_game(text), F.lit(None)).when(text.rlike(r"<datafile[\s>]"), F.from_xml(whole, schemas.HEAD, XML)).otherwise(wrong)

    found = parts.records(spark, path, "<game", ended=ended, game=game, head=head)
    parts.require_ends(found, "no whole datafile")
    heads = found.filter("head is not null").select("file_name", F.col("head").alias("datafile"))
    headers = _headers(heads.join(parts.sha1_of(heads.repartition("file_name")), "file_name"))
    games = parts.numbered(found).filter("game is not null").select("file_name", (F.col("nr") - 1).cast("int").alias("game_seq"), F.col("game").alias("g"))
    return Catalogue(headers, *_of_games(games))


def parse_dat(text: Column) -> Column:
    """A catalogue in a string column as a struct."""
    return F.from_xml(text, schemas.DATAFILE, {"mode": "FAILFAST", "attributePrefix": "_"})


def _required(c: Column, what: str) -> Column:
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"catalogue: {what} is missing")).cast("string"))


def _headers(dats: DataFrame) -> DataFrame:
    d = F.col("datafile")
    return dats.select(
        d["_build"].alias("build"), d["_debug"].alias("debug"), "file_name", _required(d["header"]["name"], "header name").alias("name"),
        *[d["header"][c].alias(c) for c in ("description", "version", "author", "homepage", "url")], "sha1",
    )


def flatten(dats: DataFrame) -> Catalogue:
    """Headers, games and roms of whole documents."""
    games = dats.select("file_name", F.posexplode_outer(F.col("datafile")["game"]).alias("game_seq", "g")).filter(F.col("g").isNotNull())
    return Catalogue(_headers(dats), *_of_games(games))


def _of_games(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games and roms of (file_name, game_seq, g); absent text is empty, only clone_of stays null. Required values that lack are errors."""
    text = lambda c: F.coalesce(c, F.lit(""))
    g = F.col("g")
    flat = games.select(
        "file_name", "game_seq", _required(g["_name"], "game name").alias("name"), text(g["_isbios"]).alias("is_bios"), g["_cloneof"].alias("clone_of"),
        text(g["_romof"]).alias("rom_of"), text(g["_sampleof"]).alias("sample_of"), text(g["_board"]).alias("board"), text(g["_rebuildto"]).alias("rebuildto"),
        text(g["year"]).alias("year"), text(g["manufacturer"]).alias("manufacturer"), text(g["_sourcefile"]).alias("source_file"),
    )
    roms = games.select("file_name", "game_seq", g["_name"].alias("game_name"), F.posexplode(g["rom"]).alias("rom_seq", "r"))
    r = F.col("r")
    size = F.when(r["_size"].isNotNull(), r["_size"]).otherwise(F.raise_error(F.lit("catalogue: rom size is missing")).cast("int"))
    rows = roms.select(
        "file_name", "game_seq", "game_name", "rom_seq", _required(r["_name"], "rom name").alias("name"), size.alias("size"),
        *[from_hex(r[f"_{c}"], f"rom {c}").alias(c) for c in ("md5", "sha1", "crc")],
        *[text(r[f"_{c}"]).alias(c) for c in ("merge", "status", "serial", "date")],
    )
    return flat, rows
