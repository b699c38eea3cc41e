"""The list of public sources, pipe-separated, and their metadata in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge import schemas
from setforge.sources import parts


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).csv(path, sep="|", quote="", mode="FAILFAST")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, metadata, files): one JSON document a file, its name before ``.metadata.json`` is the identifier."""
    rows = spark.read.schema(schemas.METADATA).json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.metadata\.json$", 1)
    return rows.select(F.url_decode(name).alias("identifier"), "metadata", "files")


def read_manifest(spark: SparkSession, path: str, source: str, rom: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policies (file_name, policy as JSON), sources and roms of manifests as write_manifest() makes them, a row a line; read by many tasks.

    source and rom are the schemas of their rows. A manifest that ends early is an error.
    """
    found = parts.records(spark, path, "\n", line=lambda text: text, ended=lambda text: text == "]}")
    parts.require_ends(found, "no whole manifest")
    lines = parts.numbered(found)
    cut = lines.filter(F.col("line") == '], "roms": [').select("file_name", F.col("nr").alias("cut"))  # a row a manifest
    row = lines.join(cut, "file_name").filter(F.col("line").startswith("{") & (F.col("nr") > 0))
    made = lambda rows, schema: rows.select("file_name", "nr", F.from_json(F.rtrim("line", F.lit(",")), schema, {"mode": "FAILFAST"}).alias("r")).select("file_name", "nr", "r.*")
    policy = lines.filter("nr = 0").select("file_name", F.regexp_extract("line", r'^\{"policy": (.*), "sources": \[$', 1).alias("policy"))
    return policy, made(row.filter("nr < cut"), source), made(row.filter("nr > cut"), rom)
