"""Writing of bundles: one ZIP file each, checked as a whole before the first byte.

Entries are dealt out by ranges of (bundle, order), so a large bundle is written by many tasks. A task writes the bundles
that lie within its range as whole files, and those at the ends of its range as segments, which are small ZIP files. Of
segments, two a task at most, the driver adds up sizes to places: entries first, then one central directory. Tasks copy
entries and write each its own part of the directory. A task that runs again writes the same bytes to the same place.
"""

from __future__ import annotations

import itertools
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from setforge.errors import PlanError
from setforge.functions import paths
from setforge.operators.joined import copy_range
from setforge.scratch import passing_path
from setforge.sources import archives

COMPRESSION = {"deflate": zipfile.ZIP_DEFLATED, "store": zipfile.ZIP_STORED}
COMMENT = b"Created by setforge"


def problems(entries: DataFrame) -> DataFrame:
    """(zip, rom_name, problem) of the rows of a plan (zip, rom_name, ...) that must not be written."""
    unsafe = entries.select(
        "zip", "rom_name",
        F.when(~paths.safe_file_name(F.col("zip")), "unsafe file name").when(~paths.safe_entry_name(F.col("rom_name")), "unsafe entry name").alias("problem"),
    ).dropna(subset=["problem"])
    twice = entries.groupBy("zip", "rom_name").agg(F.count("*").alias("n")).filter("n > 1").select("zip", "rom_name", F.lit("entry twice in a bundle").alias("problem"))
    return unsafe.union(twice)


def kept(entries: DataFrame) -> DataFrame:
    """The plan written down once: it is checked, sampled and dealt out, and may come from a scan of all files."""
    path = passing_path(entries.sparkSession)
    entries.write.parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def validate(entries: DataFrame) -> None:
    """Raise PlanError with the first problems, if there are any."""
    found = problems(entries).orderBy("zip", "rom_name").limit(10).collect()
    if found:
        raise PlanError("; ".join(f"{r['zip']}: {r['rom_name']}: {r['problem']}" for r in found))


def _copy(z: zipfile.ZipFile, name: str, source, compression: int) -> None:
    with z.open(zipfile.ZipInfo(name) if compression == zipfile.ZIP_STORED else _info(name, compression), "w", force_zip64=True) as out:
        shutil.copyfileobj(source, out, archives.CHUNK)


def _info(name: str, compression: int) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name)
    info.compress_type = compression
    return info


def write_zip(path: str, rows: Iterator[tuple[str, str, str | None, str]], compression: int) -> tuple[int, int, int, int]:
    """Write one ZIP file; rows: entry name, path, entry in it, kind. Bytes of its entries and of its directory, entries, those of over 4 GB."""
    with zipfile.ZipFile(path, "w", compression) as z, archives.Opened() as opened:
        z.comment = COMMENT
        for entry, source, inner, kind in rows:
            if kind == "bare":
                with open(source, "rb") as f:
                    _copy(z, entry, f, compression)
            else:
                with opened.entry(source, inner) as f:  # an archive with a misleading ending is read as what it is
                    _copy(z, entry, f, compression)
        infos, data = z.infolist(), z.start_dir
    return data, sum(len(central_header(i, 0, False)) for i in infos), len(infos), sum(map(_large, infos))


LIMIT = 0xFFFFFFFF  # of fields of four bytes; at it, the value stands in a further field of eight


def _large(info: zipfile.ZipInfo) -> bool:
    return info.file_size >= LIMIT or info.compress_size >= LIMIT


def central_header(info: zipfile.ZipInfo, shift: int, wide: bool) -> bytes:
    """An entry of the central directory; wide: its place has eight bytes."""
    name, large = info.filename.encode(), _large(info)
    more = [info.file_size, info.compress_size] * large + [info.header_offset + shift] * wide
    extra = struct.pack(f"<HH{len(more)}Q", 1, 8 * len(more), *more) if more else b""
    y, mo, d, h, mi, sec = info.date_time
    flags = info.flag_bits | (0 if name.isascii() else 0x800)
    sizes = (LIMIT, LIMIT) if large else (info.compress_size, info.file_size)
    head = (b"PK\x01\x02", 45, info.create_system, 45 if more else info.extract_version, flags, info.compress_type, h << 11 | mi << 5 | sec // 2, (y - 1980) << 9 | mo << 5 | d, info.CRC, *sizes)
    return struct.pack("<4sBBHHHHHIII", *head) + struct.pack("<HHHHHII", len(name), len(extra), 0, 0, info.internal_attr, info.external_attr, LIMIT if wide else info.header_offset + shift) + name + extra


def end_records(n: int, size: int, at: int) -> bytes:
    """What ends a ZIP file of n entries whose directory has that size and place."""
    out = b""
    if n >= 0xFFFF or max(size, at) >= LIMIT:
        out = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, at + size, 1)
    return out + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, LIMIT), min(at, LIMIT), len(COMMENT)) + COMMENT


def place_segment(segment: str, size: int, target: str, at: int, directory_at: int, wide: bool) -> None:
    """The entries of a segment and its part of the directory, to their places in the bundle."""
    copy_range(segment, size, target, at)
    with zipfile.ZipFile(segment) as z, open(target, "r+b") as out:
        out.seek(directory_at)
        for info in z.infolist():
            out.write(central_header(info, at, wide))


SEGMENTS = pa.schema([("zip", pa.string()), ("segment", pa.string()), ("part", pa.int32()), ("nr", pa.int32()), ("size", pa.int64()), ("directory", pa.int64()), ("n", pa.int64()), ("large", pa.int64())])
ORDER = ("dat_name", "game_name", "parent_name", "rom_name", "sha1")


def write_bundles(entries: DataFrame, destination: str, compression: str = "deflate") -> DataFrame:
    """(path, n) of the bundles written; entries: zip, rom_name, canonical_path, entry_name, kind and the order.

    Nothing is made if the plan has no rows or a problem. The destination must be a folder that all machines share.
    """
    spark = entries.sparkSession
    schema = "path string, n long"
    keys = ["zip", *[c for c in ORDER if c in entries.columns]]
    entries = kept(entries.select(*dict.fromkeys([*keys, "rom_name", "canonical_path", "entry_name", "kind"])))
    if entries.isEmpty():
        return spark.createDataFrame([], schema)
    validate(entries)
    destination = os.path.abspath(destination)
    scratch = os.path.join(destination, f".{uuid.uuid4().hex}.part")
    os.makedirs(scratch)
    kind = COMPRESSION[compression]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition sorted by bundle. Its first and its last one may go on in other partitions, those between are whole."""
        from pyspark import TaskContext

        c = TaskContext.get()

        def made() -> Iterator[tuple]:
            before = None
            rows = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
            for k, (name, of) in enumerate(itertools.groupby(rows, lambda r: r[0])):
                if k > 1:
                    os.replace(before[1], os.path.join(destination, before[0]))
                    before = (before[0], None, *before[2:])
                if k:
                    yield before
                path = os.path.join(scratch, f"{c.partitionId():08d}-{k}")
                sizes = write_zip(part := f"{path}.{c.taskAttemptId()}", (r[1:] for r in of), kind)
                os.replace(part, path)
                before = (name, path, c.partitionId(), k, *sizes)
            if before:
                yield before

        found = made()
        while some := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), SEGMENTS)], schema=SEGMENTS)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    try:
        out = passing_path(spark)
        rows = dealt.select("zip", "rom_name", "canonical_path", "entry_name", "kind")
        rows.mapInArrow(write, "zip string, segment string, part int, nr int, size long, directory long, n long, large long").write.parquet(out)
        written = spark.read.parquet(out)
        ends = written.filter("segment is not null").orderBy("zip", "part", "nr").collect()  # two rows a task at most
        joined = [(name, list(of)) for name, of in itertools.groupby(ends, lambda r: r["zip"])]
        for name, of in joined:
            if len(of) == 1:
                os.replace(of[0]["segment"], os.path.join(destination, name))
        join_segments(spark, [x for x in joined if len(x[1]) > 1], scratch, destination)
        whole = written.filter("segment is null").select("zip", "n").unionByName(spark.createDataFrame([(name, sum(r["n"] for r in of)) for name, of in joined], "zip string, n long"))
        return whole.select(F.concat(F.lit(destination + "/"), "zip").alias("path"), "n")
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def join_segments(spark: SparkSession, bundles: list[tuple[str, list[Row]]], scratch: str, destination: str) -> None:
    """Make one file of the segments of each bundle."""
    moves, ends = [], []
    for k, (name, segments) in enumerate(bundles):
        target, at, places = os.path.join(scratch, f"bundle-{k}"), 0, []
        for r in segments:
            wide = at + r["size"] > LIMIT
            places.append((r["segment"], r["size"], target, at, wide, r["directory"] + wide * (12 * (r["n"] - r["large"]) + 8 * r["large"])))
            at += r["size"]
        directory_at = at
        for segment, size, _, where, wide, directory in places:
            moves.append((segment, size, target, where, directory_at, wide))
            directory_at += directory
        end = end_records(sum(r["n"] for r in segments), directory_at - at, at)
        ends.append((target, directory_at, end, os.path.join(destination, name)))
        with open(target, "wb") as f:
            f.truncate(directory_at + len(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                place_segment(*row)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    if moves:
        dealt = spark.createDataFrame(moves, "segment string, size long, target string, at long, directory_at long, wide boolean")
        dealt.repartition(len(moves), "segment").mapInArrow(run, "n long").agg(F.sum("n")).first()
    for target, at, end, final in ends:
        with open(target, "r+b") as f:
            f.seek(at)
            f.write(end)
        os.replace(target, final)
