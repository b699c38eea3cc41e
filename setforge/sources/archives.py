"""Reading of single archives inside a task: what format a file has, and its entries as byte streams.

ZIP goes through the standard library, which is shown a piece of the archive's directory at a time (:class:`Zip`), so that
neither the memory of a task nor the time to find one entry grows with the archive; 7z goes through :mod:`setforge.sources.sevenzip`; RAR, and 7z archives with coders
unknown there, through ``bsdtar`` where the machine has it, which turns the archive into one tar stream. Each is
decompressed once, and entries that repeat a name are entries of their own.
"""

from __future__ import annotations

import contextlib
import functools
import io
import os
import shutil
import struct
import subprocess
import tarfile
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import xxhash

from setforge.errors import ArchiveError, InvalidPath
from setforge.sources import sevenzip

CHUNK = 1 << 16
# The bytes that formats begin with.
MAGIC = ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"PK\x07\x08", "zip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!\x1a\x07", "rar"))

#: Most entries of a part of a ZIP file, and bytes of its entries beyond which it takes no further one.
PART_ENTRIES, PART_BYTES = 4096, 1 << 26
#: ZIP files that a writer keeps open, and directories whose places a Python worker keeps, of 16 bytes an entry.
KEPT = 4
#: What the stream of an entry may raise while it is read.
READ_ERRORS = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError)


def sniff(path: str) -> str:
    """zip, 7z, rar or bare, by the first bytes."""
    with open(path, "rb") as f:
        head = f.read(8)
    return next((kind for magic, kind in MAGIC if head.startswith(magic)), "bare")


def safe_name(name: str) -> str:
    """The entry name if all its parts are normal; leading ``./`` is dropped."""
    parts = [p for p in name.replace("\\", "/").split("/") if p != "."]
    if not parts or name.startswith("/") or "\0" in name or any(p in ("", "..") for p in parts) or (len(name) > 1 and name[1] == ":" and name[0].isalpha()):
        raise InvalidPath(f"unsafe entry name: {name!r}")
    try:
        name.encode()
    except UnicodeEncodeError as e:
        raise InvalidPath(f"entry name that is no UTF-8: {name!r}") from e
    return "/".join(parts)


def _tar_entries(path: str) -> Iterator[tuple[str, BinaryIO]]:
    """(raw name, stream) of each entry that is a file, in one pass."""
    if not (tool := shutil.which("bsdtar")):
        raise ArchiveError(f"{path}: bsdtar is not installed, which reads RAR and rare 7z coders")
    with tempfile.TemporaryFile() as said:
        p = subprocess.Popen([tool, "-cf", "-", "--format", "pax", f"@{path}"], stdout=subprocess.PIPE, stderr=said)
        done = False
        try:
            try:
                with tarfile.open(fileobj=p.stdout, mode="r|", encoding="utf-8", errors="surrogateescape") as t:
                    for info in t:
                        if info.isfile():
                            yield info.name, t.extractfile(info)
                done = True
            except tarfile.TarError as e:
                raise ArchiveError(f"{path}: {_said(said) or e}") from e
            while p.stdout.read(CHUNK):
                pass
            if p.wait():
                raise ArchiveError(f"{path}: {_said(said)}")
        finally:
            if not done:
                p.kill()
            p.stdout.close()
            p.wait()


def _said(stderr: BinaryIO) -> str:
    stderr.seek(0)
    return stderr.read().decode(errors="replace").strip()


# An entry of a ZIP file's directory, of which are read: mark, flags, packed size, lengths of name, extra, comment.
_HEADER = struct.Struct("<4s4xH10xL4xHHH12x")
_PIECE = 1 << 20


class Part(NamedTuple):
    """Successive entries of a ZIP file: place and size of their directory, their number, and that of the files before them."""

    at: int
    size: int
    n: int
    first: int


class _Window(io.RawIOBase):
    """A ZIP file as if its directory were but a piece of it: the bytes before the directory, then ``tail``."""

    def __init__(self, file: BinaryIO, start: int, tail: bytes):
        self.file, self.start, self.all, self.pos = file, start, start + len(tail), 0
        self.end = tail

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.pos

    def seek(self, offset: int, whence: int = 0) -> int:
        self.pos = max(0, offset + (0, self.pos, self.all)[whence])
        return self.pos

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(n if n >= 0 else self.all, self.all - self.pos))
        if self.pos < self.start:
            self.file.seek(self.pos)
            out = self.file.read(min(n, self.start - self.pos))
            if len(out) == self.start - self.pos:
                out += self.end[: n - len(out)]
        else:
            out = self.end[self.pos - self.start : self.pos - self.start + n]
        self.pos += len(out)
        return out


class Zip:
    """A ZIP file that is read by parts, or by names."""

    def __init__(self, path: str):
        self.path = path
        self.file = open(path, "rb")
        try:
            end = zipfile._EndRecData(self.file)
            if not end:
                raise zipfile.BadZipFile("File is not a zip file")
            self.size, offset = end[zipfile._ECD_SIZE], end[zipfile._ECD_OFFSET]
            self.start = end[zipfile._ECD_LOCATION] - self.size
            if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
                self.start -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
            self.before = self.start - offset  # bytes before the archive proper
            if self.start < 0:
                raise zipfile.BadZipFile("Bad offset for central directory")
        except BaseException:
            self.file.close()
            raise

    def __enter__(self) -> Zip:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _entries(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(place and size in the directory, packed size, name as UTF-8) of each entry, in order."""
        held, base, at, end = b"", self.start, 0, self.start + self.size
        while base + at < end:
            if len(held) - at < 46 + 3 * 0xFFFF and base + len(held) < end:
                self.file.seek(base + len(held))
                more = self.file.read(min(_PIECE, end - base - len(held)))
                if not more:
                    raise zipfile.BadZipFile("Truncated central directory")
                held, base, at = held[at:] + more, base + at, 0
                continue
            if len(held) - at < 46:
                raise zipfile.BadZipFile("Truncated central directory")
            mark, flags, packed, name, extra, comment = _HEADER.unpack_from(held, at)
            if mark != b"PK\x01\x02":
                raise zipfile.BadZipFile("Bad magic number for central directory")
            size, raw = 46 + name + extra + comment, held[at + 46 : at + 46 + name]
            if b"\0" in raw or (b"up" in held[at + 46 + name : at + 46 + name + extra]) or not (flags & 0x800 or raw.isascii()):
                with self.window(base + at, size, 1) as z:  # names that are not as they stand
                    raw = z.infolist()[0].filename.encode(errors="surrogatepass")
            yield base + at, size, packed, raw
            at += size

    def parts(self, most: int = PART_ENTRIES, most_bytes: int = PART_BYTES) -> Iterator[Part]:
        """The whole directory in parts."""
        begin, n, first, files, held = self.start, 0, 0, 0, 0
        for at, size, packed, name in self._entries():
            n, held, files = n + 1, held + packed, files + (not name.endswith(b"/"))
            if n == most or held >= most_bytes:
                yield Part(begin, at + size - begin, n, first)
                begin, n, first, held = at + size, 0, files, 0
        if n:
            yield Part(begin, self.start + self.size - begin, n, first)

    def window(self, at: int, size: int, n: int) -> zipfile.ZipFile:
        """The archive with these entries of its directory and no others."""
        self.file.seek(at)
        directory = self.file.read(size)
        offset, after = self.start - self.before, self.start - self.before + size
        end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<4sIQI", b"PK\x06\x07", 0, after, 1)
        end += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0)
        return zipfile.ZipFile(_Window(self.file, self.start, directory + end))

    def read(self, part: Part) -> Iterator[tuple[str, BinaryIO]]:
        """(safe name, stream) of each entry of a part that is no folder."""
        with self.window(part.at, part.size, part.n) as z:
            for info in z.infolist():
                if not info.is_dir():
                    name = safe_name(info.filename)
                    with z.open(info) as f:
                        yield name, f

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the names and the places of their entries; the same of safe forms that differ from the name."""
        names, at, safe, safe_at = array("Q"), array("q"), array("Q"), array("q")
        for place, _, _, name in self._entries():
            names.append(xxhash.xxh64_intdigest(name))
            at.append(place)
            if name.startswith(b"./") or b"\\" in name or b"/./" in name or name.endswith(b"/."):
                with contextlib.suppress(InvalidPath):
                    form = safe_name(name.decode(errors="replace"))
                    if not name.endswith(b"/"):
                        safe.append(xxhash.xxh64_intdigest(form.encode()))
                        safe_at.append(place)
        out = ()
        for hashes, where in ((names, at), (safe, safe_at)):
            h = np.frombuffer(hashes, np.uint64)
            order = np.argsort(h, kind="stable")
            out += (h[order], np.frombuffer(where, np.int64)[order])
        return out

    def _named(self, at: int) -> zipfile.ZipFile:
        self.file.seek(at)
        head = self.file.read(46)
        return self.window(at, 46 + sum(_HEADER.unpack(head)[3:]), 1)

    def find(self, name: str) -> zipfile.ZipFile:
        """The archive with one entry: the last one of that name, or else the last one that has the name of the first with that safe form."""
        s = os.fstat(self.file.fileno())
        hashes, at, safe, safe_at = _places(self.path, s.st_ino, s.st_size, s.st_mtime_ns)
        for h, places, back in ((hashes, at, True), (safe, safe_at, False)):
            key = np.uint64(xxhash.xxh64_intdigest(name.encode(errors="surrogatepass")))
            met = places[np.searchsorted(h, key) : np.searchsorted(h, key, "right")].tolist()
            for place in reversed(met) if back else met:
                z = self._named(place)
                found = z.infolist()[0].filename
                if back and found == name:
                    return z
                z.close()
                if not back and _matches(found, name):
                    return self.find(found)
        raise ArchiveError(f"{self.path} has no entry {name}")


@functools.lru_cache(KEPT)
def _places(path: str, inode: int, size: int, changed: int) -> tuple[np.ndarray, ...]:
    """What :meth:`Zip.places` gives, for as long as the file stays as it is."""
    with Zip(path) as z:
        return z.places()


ZIP_ERRORS = (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, RuntimeError)


def entries(path: str, kind: str, part: Part | None = None) -> Iterator[tuple[str, BinaryIO]]:
    """(safe name, stream) of each entry that is no folder, or of those of one part of a ZIP file; a stream is valid until the next one is asked for."""
    if kind == "zip":
        try:
            with Zip(path) as z:
                for some in [part] if part else list(z.parts()):  # a broken directory gives no entry
                    yield from z.read(some)
        except ZIP_ERRORS as e:
            raise ArchiveError(f"{path}: {e}") from e
        return
    for raw, f in _streamed(path, kind):
        yield safe_name(raw), f


def _streamed(path: str, kind: str) -> Iterator[tuple[str, BinaryIO]]:
    """(raw name, stream) of the entries of a 7z or RAR archive."""
    if kind != "7z":
        yield from _tar_entries(path)
        return
    try:
        every = sevenzip.entries(path)
        first = next(every, None)
    except ArchiveError as e:
        if "not supported" not in str(e) or not shutil.which("bsdtar"):
            raise
        yield from _tar_entries(path)
        return
    if first:
        yield first
        yield from every


class Opened:
    """Archives that are kept open from one entry to the next, the last ``KEPT`` ZIP files at most."""

    def __init__(self):
        self.zips: dict[str, Zip] = {}

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        for z in self.zips.values():
            z.file.close()

    def _zip(self, path: str) -> Zip:
        if path in self.zips:
            self.zips[path] = self.zips.pop(path)  # the last one used
            return self.zips[path]
        if len(self.zips) >= KEPT:
            self.zips.pop(next(iter(self.zips))).file.close()
        try:
            self.zips[path] = Zip(path)
        except (zipfile.BadZipFile, OSError) as e:
            raise ArchiveError(f"{path}: {e}") from e
        return self.zips[path]

    @contextlib.contextmanager
    def entry(self, path: str, name: str, kind: str | None = None) -> Iterator[BinaryIO]:
        """The stream of one entry, found by its exact name or else by its safe form; of several the first, in ZIP files the last. Without a kind it is sniffed."""
        kind = "zip" if path in self.zips else kind or sniff(path)
        if kind == "bare":
            raise ArchiveError(f"{path} is no archive any more")
        if kind == "zip":
            z = self._zip(path)
            try:
                found = z.find(name)
            except zipfile.BadZipFile as e:
                raise ArchiveError(f"{path}: {e}") from e
            with found, found.open(found.infolist()[0]) as f:
                yield f
            return
        with contextlib.closing(_streamed(path, kind)) as every:
            for raw, f in every:
                if _matches(raw, name):
                    yield f
                    return
        raise ArchiveError(f"{path} has no entry {name}")


@contextlib.contextmanager
def open_entry(path: str, kind: str, name: str) -> Iterator[BinaryIO]:
    """One entry of an archive that is opened for it alone."""
    with Opened() as archives, archives.entry(path, name, kind) as f:
        yield f


def _matches(raw: str, wanted: str) -> bool:
    try:
        return safe_name(raw) == wanted
    except InvalidPath:
        return False
