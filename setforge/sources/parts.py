"""Large single documents read in parts: records between separators, by ranges of bytes, with their order.

Spark's text source cuts a file at byte ranges and reads on to the next separator, so one file is read by as many tasks as
it has ranges. A record's place is its file, the range it begins in, and its number among those that the task read. Places
are written down with the records, as another reading could cut the file elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.errors import CatalogueError
from setforge.scratch import passing_path

CHUNK = 1 << 20


def local_name(uri: Column) -> Column:
    """The path of a file URI."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:(//)?(?=/)", "")


def records(spark: SparkSession, path: str, separator: str, **columns: Callable[[Column], Column]) -> DataFrame:
    """(file_name, block, at, ...): the records of the files at a path, each column made from their text, written once.

    What follows the last separator is a record too, unless it is empty.
    """
    text = spark.read.option("lineSep", separator).text(path)
    place = [local_name(F.col("_metadata.file_path")).alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    made = text.select(*place, *[f(F.col("value")).alias(c) for c, f in columns.items()])
    out = passing_path(spark)
    made.write.parquet(out)
    return spark.read.schema(made.schema).parquet(out)


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``nr``, the number of a record in its file from 0. Records of a block are numbered without gaps."""
    blocks = found.groupBy("file_name", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.expr("coalesce(sum(n) over (partition by file_name order by block rows between unbounded preceding and 1 preceding), 0)")
    places = blocks.select("file_name", "block", "first", earlier.alias("earlier"))  # a row for each range of a file
    return found.join(places, ["file_name", "block"]).withColumn("nr", F.col("earlier") + F.col("at") - F.col("first")).drop("first", "earlier")


def sha1_of(files: DataFrame) -> DataFrame:
    """(file_name, sha1) of whole files, each read by one task piece by piece; they must be on a mounted file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = b.column(0).to_pylist(), []
            for name in names:
                h = hashlib.sha1(usedforsecurity=False)
                with open(name, "rb") as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                out.append(h.digest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["file_name", "sha1"])

    return files.select("file_name").mapInArrow(run, "file_name string, sha1 binary")


def require_ends(found: DataFrame, what: str) -> None:
    """Raise CatalogueError if a file's last record hasn't ``ended``, or another one has."""
    last = F.max(F.struct("block", "at", "ended"))["ended"]
    bad = found.groupBy("file_name").agg(last.alias("ended"), F.count_if("ended").alias("n")).filter(~F.col("ended") | (F.col("n") != 1)).select("file_name").limit(1).collect()
    if bad:
        raise CatalogueError(f"{bad[0][0]}: {what}")
