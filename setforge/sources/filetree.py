"""Files of a directory tree, archives exploded, with their digests: listed in rounds, then read.

In each round the folders that are known are dealt out to tasks. A task lists its folders and walks down from them until it
has opened ``FOLDERS``; the folders that are left are dealt out in the next round, so neither a wide nor a deep tree stays
with one task. Folders are streamed: one with more than ``ENTRIES`` entries is listed by several tasks in the next round,
each of which keeps the names that a hash gives it. The driver opens none. The paths are then dealt out anew to be read, a
file in one pass for all digests, and a ZIP file of over ``LARGE`` bytes in parts, each with its piece of the directory. Unlike Spark's binaryFile it has empty files and names with a leading underscore. Names
with a leading dot are skipped below the root, links are files, not folders, and whatever cannot be read ends the scan.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from setforge import schemas
from setforge.errors import InvalidPath
from setforge.scratch import passing_path
from setforge.sources import archives

#: Folders that a task opens in a round, entries of a folder that one task lists, and tasks for every core when files are read.
FOLDERS, ENTRIES, PER_CORE = 256, 100_000, 4
#: Tasks that list one large folder.
SHARES = 16
#: Bytes of a ZIP file beyond which it may be read by several tasks.
LARGE = 1 << 20
#: What a database file may have beside it.
SIDECARS = ("", "-wal", "-shm", "-journal")


def canonical(path: str) -> str:
    try:
        return os.path.realpath(path, strict=True)
    except OSError as e:
        raise InvalidPath(f"{path}: {e.strerror}") from e


def _readable_name(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return not name.startswith(".")


def entries(folder: str, share: int, shares: int) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of what lies right in a folder, without hidden names and links to folders; one of several shares of it. A folder that cannot be listed counts as empty."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                if _readable_name(e.name) and (shares == 1 or zlib.crc32(e.name.encode()) % shares == share):
                    is_folder = e.is_dir(follow_symlinks=False)
                    if is_folder or not (e.is_symlink() and e.is_dir()):
                        yield e.path, is_folder
    except OSError:
        return


def walk(folders: Iterator[tuple[str, int, int]], most_folders: int, most_entries: int) -> Iterator[tuple[str, int, int]]:
    """(path, share, shares) below the folders: shares is 0 for files; others are folders, or shares of large ones, that are left for later."""
    left, opened, seen = collections.deque(folders), 0, 0
    while left:
        folder, share, shares = left.popleft()
        if opened >= most_folders or seen > most_entries:
            yield folder, share, shares
            continue
        opened += 1
        found = entries(folder, share, shares)
        held = list(itertools.islice(found, most_entries + 1)) if shares == 1 else []
        seen += len(held)
        if len(held) > most_entries:
            yield from ((folder, k, SHARES) for k in range(SHARES))
            continue
        for path, is_folder in itertools.chain(held, found):
            if not is_folder:
                yield path, 0, 0
            elif shares == 1:
                left.append((path, 0, 1))
            else:
                yield path, 0, 1


def digests(stream) -> tuple[bytes, bytes, bytes, int]:
    """SHA-1, XXH3-64, MD5 and the size, in one pass."""
    sha1, xxh3, md5, size = hashlib.sha1(), xxhash.xxh3_64(), hashlib.md5(usedforsecurity=False), 0
    while chunk := stream.read(archives.CHUNK):
        for h in (sha1, xxh3, md5):
            h.update(chunk)
        size += len(chunk)
    return sha1.digest(), xxh3.digest(), md5.digest(), size


def scan_file(path: str, permissive: bool = False, part: archives.Part | None = None) -> Iterator[tuple]:
    """Rows (see schemas.SCANNED) of one file or a part of one. permissive: an archive that cannot be read ends quietly."""
    kind = archives.sniff(path)
    parent, name = os.path.split(path)
    if kind == "bare":
        with open(path, "rb") as f:
            yield (parent, path, name, *digests(f), False, "bare", 0)
        return
    try:
        for k, (entry, stream) in enumerate(archives.entries(path, kind, part), part.first if part else 0):
            yield (parent, path, entry, *digests(stream), True, "zip" if kind == "zip" else "archive", k)
    except (archives.ArchiveError, *archives.READ_ERRORS) as e:
        if not permissive:
            raise e if str(e).startswith(path) else archives.ArchiveError(f"{path}: {e}") from e


def list_tree(spark: SparkSession, path: str, exclude: list[str] = (), most_folders: int = FOLDERS, most_entries: int = ENTRIES) -> DataFrame:
    """(path) of the files below a folder, or the file itself, without those of ``exclude`` and what lies beside them."""
    root = canonical(path)
    if not os.path.isdir(root):
        return spark.createDataFrame([(root,)], "path string")
    without = {os.path.realpath(own) + s for own in exclude for s in SIDECARS}
    schema = pa.schema([("path", pa.string()), ("share", pa.int32()), ("shares", pa.int32())])
    n = PER_CORE * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = (r for r in walk(given, most_folders, most_entries) if r[2] or r[0] not in without)
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    rounds, left = [], spark.createDataFrame([(root, 0, 1)], "path string, share int, shares int")
    while True:
        out = passing_path(spark)
        left.repartition(n, "path", "share").mapInArrow(run, left.schema).write.parquet(out)
        made = spark.read.schema(left.schema).parquet(out)
        rounds.append(made.filter("shares = 0").select("path"))
        left = made.filter("shares > 0")
        if left.isEmpty():
            return functools.reduce(DataFrame.union, rounds)


def _on_disk(path: str) -> int:
    """Files are read in the order of their inodes, which follows their places on many file systems."""
    try:
        return os.stat(path).st_ino
    except OSError:
        return 0


def parts(path: str, large: int) -> list[archives.Part | None]:
    """The parts of a large ZIP file. Of others, and of those whose directory cannot be read, the whole."""
    try:
        if os.stat(path).st_size > large and archives.sniff(path) == "zip":
            with archives.Zip(path) as z:
                return list(z.parts()) or [None]
    except archives.ZIP_ERRORS:
        pass
    return [None]


def scan(files: DataFrame, permissive: bool = False, large: int = LARGE) -> DataFrame:
    """Rows (schemas.SCANNED) of the files with the given ``path``, dealt out by it.

    With ``permissive`` one task reads an archive, as what it gives ends at the first entry that cannot be read.
    """
    spark = files.sparkSession
    names, types = schemas.SCANNED.names, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32())
    places = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in archives.Part._fields]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (None,) * len(archives.Part._fields)
        rows = ((p, *(x or whole)) for b in batches for p in b.column(0).to_pylist() for x in ([None] if permissive else parts(p, large)))
        while some := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), places)], schema=places)

    def read(b: pa.RecordBatch) -> Iterator[tuple]:
        for p, *x in sorted(zip(*(c.to_pylist() for c in b.columns)), key=lambda r: (_on_disk(r[0]), r[1] or 0)):
            yield from scan_file(p, permissive, archives.Part(*x) if x[0] is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in read(b))
        while some := list(itertools.islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_CORE * spark.sparkContext.defaultParallelism)
    dealt = files.select("path").repartition(n, "path").mapInArrow(cut, "path string, at long, size long, n long, first long")
    return dealt.repartition(n, "path", "at").mapInArrow(run, schemas.SCANNED)


def read_tree(spark: SparkSession, path: str, exclude: list[str] = (), permissive: bool = False) -> DataFrame:
    """The scanned rows of a tree or of a single file. The tree must be on a file system that all machines share."""
    return scan(list_tree(spark, path, exclude), permissive)
