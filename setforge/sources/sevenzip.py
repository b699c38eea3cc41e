"""Reading of 7z archives with the standard library: the container's headers, and the coders that Python's lzma, bz2 and zlib have.

An archive holds packed streams, folders (chains of coders that turn one packed stream into one unpacked one) and files,
which are consecutive parts of folders. Coders known here: copy, LZMA, LZMA2, Deflate, BZip2, and the filters for deltas and
for branches of x86, ARM, ARM Thumb, PowerPC, IA-64 and SPARC. Others (PPMd, BCJ2, encryption) are an error that names them.
Folders are decompressed once, piece by piece; checksums of headers, files and folders are verified.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from setforge.errors import ArchiveError

CHUNK = 1 << 16
# The signature, the numbers of properties and of coders in the format's description.
SIGNATURE = b"7z\xbc\xaf\x27\x1c"
END, HEADER, ARCHIVE_PROPERTIES, ADDITIONAL, MAIN_STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, UNPACK_SIZES, N_STREAMS, EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES = range(18)
ENCODED_HEADER = 23
COPY, LZMA, LZMA2, DEFLATE, BZIP2 = b"\x00", b"\x03\x01\x01", b"\x21", b"\x04\x01\x08", b"\x04\x02\x02"
FILTERS = {
    b"\x03": lzma.FILTER_DELTA, b"\x04": lzma.FILTER_X86, b"\x05": lzma.FILTER_POWERPC, b"\x06": lzma.FILTER_IA64, b"\x07": lzma.FILTER_ARM, b"\x08": lzma.FILTER_ARMTHUMB, b"\x09": lzma.FILTER_SPARC,
    b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x03\x03\x04\x01": lzma.FILTER_IA64, b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC,
}


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes]]  # (method, properties), the one that reads the packed stream last
    order: list[int]  # their numbers in the header
    sizes: list[int] = field(default_factory=list)  # of what each coder gives
    crc: int | None = None
    parts: list[tuple[int, int | None]] = field(default_factory=list)  # (size, checksum) of its files

    @property
    def size(self) -> int:
        return self.sizes[0]


@dataclass
class Streams:
    at: int = 0  # of the first packed stream, behind the signature header
    packed: list[int] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)


class _Reader:
    """Numbers and bytes of a header."""

    def __init__(self, data: bytes):
        self.f = io.BytesIO(data)

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) != n:
            raise ArchiveError("7z header ends early")
        return data

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """As many leading ones in the first byte as bytes follow, low bytes first; the first one's rest is the highest."""
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def defined(self, n: int) -> list[bool]:
        """Flags, left out where all of them are set."""
        return [True] * n if self.byte() else self.bits(n)

    def checksums(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if d else None for d in self.defined(n)]

    def want(self, kind: int, found: int) -> None:
        if kind != found:
            raise ArchiveError(f"7z header has property {found} where {kind} belongs")


def _folder(r: _Reader) -> Folder:
    coders, n_in, n_out = [], 0, 0
    for _ in range(r.number()):
        flags = r.byte()
        method = r.take(flags & 0x0F)
        ins, outs = (r.number(), r.number()) if flags & 0x10 else (1, 1)
        coders.append((method, r.take(r.number()) if flags & 0x20 else b""))
        n_in, n_out = n_in + ins, n_out + outs
    if n_in != len(coders) or n_out != len(coders):
        raise ArchiveError("7z coders of several streams are not supported: " + ", ".join(m.hex() for m, _ in coders))
    below = {}  # a coder's input is the output of which one
    for _ in range(n_out - 1):
        into, out = r.number(), r.number()
        below[into] = out
    start = next((k for k in range(len(coders)) if k not in below.values()), 0)  # whose output nothing reads
    chain = [start]
    while chain[-1] in below and len(chain) < len(coders):
        chain.append(below[chain[-1]])
    if len(chain) != len(coders):
        raise ArchiveError("7z coders are no chain")
    return Folder([coders[k] for k in chain], chain)


def _streams(r: _Reader) -> Streams:
    out = Streams()
    kind = r.byte()
    if kind == PACK:
        out.at, n = r.number(), r.number()
        while (kind := r.byte()) != END:
            if kind == SIZE:
                out.packed = [r.number() for _ in range(n)]
            elif kind == CRC:
                r.checksums(n)
            else:
                r.want(SIZE, kind)
        kind = r.byte()
    if kind == UNPACK:
        r.want(FOLDER, r.byte())
        n = r.number()
        if r.byte():
            raise ArchiveError("7z headers with external parts are not supported")
        out.folders = [_folder(r) for _ in range(n)]
        r.want(UNPACK_SIZES, r.byte())
        for f in out.folders:
            sizes = [r.number() for _ in f.coders]
            f.sizes = [sizes[k] for k in f.order]
        while (kind := r.byte()) != END:
            r.want(CRC, kind)
            for f, crc in zip(out.folders, r.checksums(n)):
                f.crc = crc
        kind = r.byte()
    for f in out.folders:
        f.parts = [(f.size, f.crc)]
    if kind == SUBSTREAMS:
        counts = [1] * len(out.folders)
        if (kind := r.byte()) == N_STREAMS:
            counts = [r.number() for _ in out.folders]
            kind = r.byte()
        for f, n in zip(out.folders, counts):
            sizes = [r.number() for _ in range(n - 1)] if kind == SIZE else []
            if n > 1 and kind != SIZE:
                raise ArchiveError("7z header lacks sizes of files")
            f.parts = [(s, None) for s in [*sizes, f.size - sum(sizes)]] if n else []
            if n == 1:
                f.parts = [(f.size, f.crc)]
        if kind == SIZE:
            kind = r.byte()
        unknown = [(f, k) for f in out.folders for k, (_, crc) in enumerate(f.parts) if crc is None]
        while kind != END:
            r.want(CRC, kind)
            for (f, k), crc in zip(unknown, r.checksums(len(unknown))):
                f.parts[k] = (f.parts[k][0], crc)
            kind = r.byte()
        kind = r.byte()
    r.want(END, kind)
    return out


def _files(r: _Reader) -> list[tuple[str, bool, bool]]:
    """(name, has a stream, is a folder) of all entries."""
    n = r.number()
    names, empty, empty_files = [""] * n, [False] * n, []
    while (kind := r.byte()) != END:
        data = _Reader(r.take(r.number()))
        if kind == EMPTY_STREAM:
            empty = data.bits(n)
        elif kind == EMPTY_FILE:
            empty_files = data.bits(sum(empty))
        elif kind == NAMES:
            if data.byte():
                raise ArchiveError("7z headers with external parts are not supported")
            names = data.f.read().decode("utf-16-le", "surrogatepass").split("\0")[:n]
    rest = iter(empty_files + [False] * n)
    return [(name, not e, e and not next(rest)) for name, e in zip(names, empty, strict=True)]


def _decoder(chain: list[tuple[bytes, bytes]]) -> Callable[[BinaryIO, int], Iterator[bytes]]:
    """What turns so many packed bytes of a file into unpacked ones, for coders of which the last one reads the packed stream."""
    method, properties = chain[-1]
    filters = []
    for m, p in chain[:-1]:
        if m not in FILTERS:
            raise ArchiveError(f"7z coder {m.hex()} is not supported here")
        if method == LZMA and FILTERS[m] != lzma.FILTER_DELTA:
            raise ArchiveError("7z branch filters over LZMA (not LZMA2) are not supported")  # without an end mark the last bytes stay in the filter
        filters.append({"id": FILTERS[m]} | ({"dist": p[0] + 1} if FILTERS[m] == lzma.FILTER_DELTA else {}))
    if method == LZMA:
        d, dict_size = struct.unpack("<BI", properties)
        filters.append({"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(dict_size, 4096)})
    elif method == LZMA2:
        bits = properties[0]
        filters.append({"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << (bits // 2 + 11)})
    elif filters:
        raise ArchiveError("7z filters without LZMA are not supported")
    elif method not in (COPY, DEFLATE, BZIP2):
        raise ArchiveError(f"7z coder {method.hex()} is not supported here")

    def unpacked(f: BinaryIO, left: int) -> Iterator[bytes]:
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters) if filters else zlib.decompressobj(-15) if method == DEFLATE else bz2.BZ2Decompressor() if method == BZIP2 else None
        while left > 0:
            chunk = f.read(min(CHUNK, left))
            if not chunk:
                raise ArchiveError("7z archive ends early")
            left -= len(chunk)
            if d is None:
                yield chunk
            elif method == DEFLATE:
                while chunk:
                    yield d.decompress(chunk, CHUNK)
                    chunk = d.unconsumed_tail
            else:
                yield d.decompress(chunk, CHUNK)
                while not d.eof and not d.needs_input:
                    yield d.decompress(b"", CHUNK)

    return unpacked


class _Part(io.RawIOBase):
    """One file of an unpacked folder, as a stream; its checksum is verified at its end."""

    def __init__(self, rest: _Unpacked, size: int, crc: int | None):
        self.rest, self.left, self.crc, self.seen = rest, size, crc, 0

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.rest.take(min(len(b), self.left)) if self.left else b""
        self.left -= len(data)
        self.seen = zlib.crc32(data, self.seen)
        if not self.left and self.crc is not None and self.seen != self.crc:
            raise ArchiveError("7z checksum of an entry is wrong")
        b[: len(data)] = data
        return len(data)


class _Unpacked:
    """The unpacked bytes of a folder, taken one after the other."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def take(self, n: int) -> bytes:
        while not self.held:
            try:
                self.held = next(self.pieces, None)
            except (lzma.LZMAError, zlib.error, OSError, EOFError) as e:
                raise ArchiveError(f"7z stream can't be unpacked: {e}") from e
            if self.held is None:
                raise ArchiveError("7z stream ends early")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _header(f: BinaryIO) -> _Reader | None:
    """The header, unpacked if it is packed; none of an archive without entries."""
    head = f.read(32)
    if len(head) < 32 or head[:6] != SIGNATURE:
        raise ArchiveError("no 7z archive")
    start_crc, at, size, crc = struct.unpack("<IQQI", head[8:])
    if zlib.crc32(head[12:]) != start_crc:
        raise ArchiveError("7z checksum of the first header is wrong")
    if not size:
        return None
    f.seek(32 + at)
    data = f.read(size)
    while True:
        if zlib.crc32(data) != crc:
            raise ArchiveError("7z checksum of the header is wrong")
        r = _Reader(data)
        if (kind := r.byte()) == HEADER:
            return r
        r.want(ENCODED_HEADER, kind)
        s = _streams(r)
        if len(s.folders) != 1 or not s.packed:
            raise ArchiveError("7z header is packed in an unknown way")
        f.seek(32 + s.at)
        rest = _Unpacked(_decoder(s.folders[0].coders)(f, s.packed[0]))
        data = b""
        while len(data) < s.folders[0].size:
            data += rest.take(s.folders[0].size - len(data))
        crc = s.folders[0].crc if s.folders[0].crc is not None else zlib.crc32(data)


def entries(path: str) -> Iterator[tuple[str, BinaryIO]]:
    """(raw name, stream) of each entry that is no folder, in the archive's order; a stream is valid until the next one is asked for."""
    with open(path, "rb") as f:
        try:
            r = _header(f)
            if r is None:
                return
            streams, files = Streams(), []
            while (kind := r.byte()) != END:
                if kind == ARCHIVE_PROPERTIES:
                    while r.byte() != END:
                        r.take(r.number())
                elif kind == ADDITIONAL:
                    _streams(r)
                elif kind == MAIN_STREAMS:
                    streams = _streams(r)
                elif kind == FILES:
                    files = _files(r)
                else:
                    r.want(FILES, kind)
            if sum(len(x.parts) for x in streams.folders) != sum(has for _, has, _ in files) or len(streams.packed) < len(streams.folders):
                raise ArchiveError("7z header has other numbers of files and of streams")
            at, parts = 32 + streams.at, iter(())
            folders = iter(zip(streams.folders, streams.packed))
            rest, part = None, None
            for name, has, is_folder in files:
                if not has:
                    if not is_folder:
                        yield name, io.BytesIO()
                    continue
                if part is not None:
                    while part.read(CHUNK):
                        pass
                while (next_part := next(parts, None)) is None:
                    folder, size = next(folders)
                    f.seek(at)
                    at += size
                    rest, parts = _Unpacked(_decoder(folder.coders)(f, size)), iter(folder.parts)
                part = io.BufferedReader(_Part(rest, *next_part), CHUNK)
                yield name, part
        except ArchiveError as e:
            raise ArchiveError(f"{path}: {e}") from e
        except (struct.error, IndexError, ValueError, UnicodeDecodeError) as e:
            raise ArchiveError(f"{path}: 7z header can't be read: {e}") from e
