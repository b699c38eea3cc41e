"""Text results: catalogue XML, the manifest in JSON, the benchmark report, log lines of a build."""

from __future__ import annotations

import json
import logging
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from setforge.functions.text import xml_escape_attribute, xml_escape_text
from setforge.operators.joined import Rows, write_joined

log = logging.getLogger("setforge")


def game_xml() -> Column:
    """One game element of the columns game_name, source, evidence_tier, rom_name, size, sha1, md5 (hex)."""
    a = lambda c: xml_escape_attribute(F.col(c).cast("string"))
    x = lambda c: xml_escape_text(F.col(c))
    return F.concat(
        F.lit('  <game name="'), a("game_name"), F.lit('" sourcefile="'), a("source"), F.lit('">\n    <description>'), x("game_name"),
        F.lit("</description>\n    <year>unknown</year>\n    <manufacturer>"), x("evidence_tier"), F.lit('</manufacturer>\n    <rom name="'), a("rom_name"),
        F.lit('" size="'), a("size"), F.lit('" sha1="'), a("sha1"), F.lit('" md5="'), a("md5"), F.lit('" crc="00000000"/>\n  </game>'),
    )


def write_dat(games: DataFrame, order: list[str], path: str, header: dict[str, str]) -> int:
    """Write one catalogue file, its games in order, by many tasks; the number of games."""
    head = "".join(f"    <{k}>{escape(v)}</{k}>\n" for k, v in header.items())
    games = Rows(games, game_xml(), order)
    return write_joined(games.df.sparkSession, path, [f'<?xml version="1.0"?>\n<datafile>\n  <header>\n{head}  </header>\n', games, "\n</datafile>\n"])


def write_manifest(policy: dict, sources: DataFrame, roms: DataFrame, order: list[str], path: str) -> None:
    """Write policy, sources and roms as one JSON document, by many tasks; every row is serialised by Spark."""
    rows = lambda df, by: Rows(df, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), by, ",\n")
    head = '{"policy": ' + json.dumps(policy) + ', "sources": [\n'
    write_joined(roms.sparkSession, path, [head, rows(sources, []), '\n], "roms": [\n', rows(roms, order), "\n]}\n"])


def benchmark_report(stats: Row, settings: dict[str, object]) -> str:
    """Run statistics and settings as Markdown tables."""
    table = lambda head, rows: "\n".join([f"| {head} | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in rows)])
    numbers = [(k, f"{stats[k]:.3f} s" if stats[k] is not None else "-") for k in ("mean", "stddev", "min", "max")]
    return "# Benchmark\n\n" + table("statistic", numbers) + "\n\n" + table("setting", settings.items()) + "\n"


def log_outcome(summary: Row, missing: list[Row], duplicates: list[Row]) -> None:
    """Log what a build found; the lists are the first rows of each, for reading."""
    log.info("matched %d, missing %d, several candidates %d", summary["matched"], summary["missing"], summary["duplicates"])
    for r in missing:
        log.warning("missing %s in %s (%s)", r["rom_name"], r["game_name"], bytes(r["sha1"]).hex())
    for r in duplicates:
        log.info("%s: took %s of %d", r["rom_name"], r["selected"], r["n_candidates"])
