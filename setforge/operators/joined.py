"""One text file from the rows of tables in order, written by many tasks.

Tasks write ranges of rows as files of their own. Their sizes, one number a range, come to the driver, which adds them up
to places in the whole file; tasks then copy each range to its place. No row passes through the driver. A task that runs
again writes the same bytes to the same place. Nothing is seen under the final name before the file is whole. The folder
must be on a file system that all machines share.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.scratch import passing_folder

CHUNK = 1 << 20


@dataclass
class Rows:
    """The lines of a table in order, with what stands between two of them."""

    df: DataFrame
    line: Column
    order: list[str]
    between: str = "\n"


def copy_range(source: str, size: int, target: str, at: int) -> None:
    """The first ``size`` bytes of a file, to a place in another one that exists."""
    with open(source, "rb") as f, open(target, "r+b") as out:
        out.seek(at)
        while size > 0:
            chunk = f.read(min(CHUNK, size))
            if not chunk:
                raise EOFError(f"{source} is too short")
            out.write(chunk)
            size -= len(chunk)


def pieces(rows: Rows, folder: str) -> list[tuple[str, int, int]]:
    """(file, bytes, rows) of the ranges of a table, in order; ranges without rows are left out."""
    spark = rows.df.sparkSession
    between = rows.between.encode()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        path, n = os.path.join(folder, f"{c.partitionId():08d}"), 0
        part = f"{path}.{c.taskAttemptId()}.part"
        with open(part, "wb") as f:
            for batch in batches:
                for line in batch.column(batch.num_columns - 1).to_pylist():
                    f.write((between if n else b"") + line.encode())
                    n += 1
            size = f.tell()
        os.replace(part, path)
        yield pa.RecordBatch.from_pydict({"part": [c.partitionId()], "size": [size], "n": [n]}, pa.schema([("part", pa.int32()), ("size", pa.int64()), ("n", pa.int64())]))

    lines = rows.df.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(rows.order)], rows.line.alias("line"))
    keys = lines.columns[:-1]
    dealt = lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if keys else lines
    found = dealt.mapInArrow(write, "part int, size long, n long").filter("n > 0").orderBy("part").collect()  # a row a range
    return [(os.path.join(folder, f"{r['part']:08d}"), r["size"], r["n"]) for r in found]


def assemble(spark: SparkSession, moves: list[tuple[str, int, int]], target: str) -> None:
    """Copy files (path, bytes, place) into one that exists, by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, at in zip(*(c.to_pylist() for c in b.columns)):
                copy_range(path, size, target, at)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    if moves:
        dealt = spark.createDataFrame(moves, "path string, size long, at long").repartition(min(len(moves), 10_000), "at")
        dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()


def write_joined(spark: SparkSession, path: str, parts: list[str | Rows]) -> int:
    """Write a file from texts and tables one after the other; the number of rows."""
    scratch, at, total, moves, texts = passing_folder(spark), 0, 0, [], []
    for k, p in enumerate(parts):
        if isinstance(p, str):
            texts.append((at, p.encode()))
            at += len(texts[-1][1])
            continue
        folder = os.path.join(scratch, str(k))
        os.makedirs(folder)
        for j, (name, size, n) in enumerate(pieces(p, folder)):
            if j:
                texts.append((at, p.between.encode()))
                at += len(texts[-1][1])
            moves.append((name, size, at))
            at, total = at + size, total + n
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            f.truncate(at)
        assemble(spark, moves, part)
        with open(part, "r+b") as f:
            for where, text in texts:
                f.seek(where)
                f.write(text)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return total
