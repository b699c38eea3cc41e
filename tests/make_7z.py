"""A writer of small 7z archives, for tests of the reader."""

import bz2
import lzma
import struct
import zlib


def number(n: int) -> bytes:
    for k in range(9):
        if n < 1 << (7 * (k + 1)) or k == 8:
            if k == 8:
                return b"\xff" + n.to_bytes(8, "little")
            first = (0xFF00 >> k & 0xFF) | n >> 8 * k
            return bytes([first]) + (n & ((1 << 8 * k) - 1)).to_bytes(k, "little")
    raise AssertionError


LZMA2 = {"id": lzma.FILTER_LZMA2, "preset": 6}
LZMA1 = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}


def raw(data: bytes, *filters) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=list(filters))


def deflated(data: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


#: By name: what packs, and the coders as (method, properties), the packing one last; the order in the header may differ.
CODERS = {
    "copy": (lambda d: d, [(b"\0", b"")]),
    "lzma": (lambda d: raw(d, LZMA1), [(b"\x03\x01\x01", struct.pack("<BI", (2 * 5 + 0) * 9 + 3, 1 << 16))]),
    "lzma2": (lambda d: raw(d, LZMA2), [(b"\x21", b"\x18")]),
    "deflate": (deflated, [(b"\x04\x01\x08", b"")]),
    "bzip2": (bz2.compress, [(b"\x04\x02\x02", b"")]),
    "x86": (lambda d: raw(d, {"id": lzma.FILTER_X86}, LZMA2), [(b"\x03\x03\x01\x03", b""), (b"\x21", b"\x18")]),
    "delta": (lambda d: raw(d, {"id": lzma.FILTER_DELTA, "dist": 2}, LZMA2), [(b"\x03", b"\x01"), (b"\x21", b"\x18")]),
    "ppmd": (lambda d: d, [(b"\x03\x04\x01", b"12345")]),
}


def folder(coders) -> bytes:
    """Coders in the order of the header: the one that packs comes first in it."""
    out = number(len(coders))
    for method, properties in reversed(coders):
        out += bytes([len(method) | (0x20 if properties else 0)]) + method + (number(len(properties)) + properties if properties else b"")
    for k in range(len(coders) - 1, 0, -1):
        out += number(k) + number(k - 1)  # the input of the later one is the output of the earlier one
    return out


def streams(at: int, packed: list[bytes], folders: list[tuple[list, int, int]]) -> bytes:
    """folders: coders, unpacked size, checksum."""
    out = b"\x06" + number(at) + number(len(packed)) + b"\x09" + b"".join(number(len(p)) for p in packed) + b"\0"
    out += b"\x07\x0b" + number(len(folders)) + b"\0" + b"".join(folder(c) for c, _, _ in folders)
    out += b"\x0c" + b"".join(number(size) * len(c) for c, size, _ in folders)
    return out + b"\x0a\x01" + b"".join(struct.pack("<I", crc) for _, _, crc in folders) + b"\0"


def archive(folders: list[tuple[str, list[tuple[str, bytes]]]], empty: list[tuple[str, bool]] = (), packed_header: bool = False, wrong: bool = False) -> bytes:
    """folders: (coder, files as (name, bytes)); empty: (name, is a folder). wrong: the last file's checksum."""
    bodies, infos, names = [], [], []
    for coder, files in folders:
        pack, coders = CODERS[coder]
        data = b"".join(b for _, b in files)
        bodies.append(pack(data))
        infos.append((coders, len(data), zlib.crc32(data)))
        names += [n for n, _ in files]
    header = b"\x01"
    if folders:
        crcs = [zlib.crc32(b) for _, files in folders for _, b in files if len(files) > 1]
        if wrong:
            crcs[-1] ^= 1
        header += b"\x04" + streams(0, bodies, infos)
        header += b"\x08\x0d" + b"".join(number(len(files)) for _, files in folders)
        if any(len(files) > 1 for _, files in folders):
            header += b"\x09" + b"".join(number(len(b)) for _, files in folders for _, b in files[:-1])
        if crcs:
            header += b"\x0a\x01" + b"".join(struct.pack("<I", c) for c in crcs)
        header += b"\0\0"
    n = len(names) + len(empty)
    bits = lambda flags: sum(1 << (7 - k % 8) + 8 * (len(flags) // 8 - k // 8 if len(flags) % 8 else len(flags) // 8 - 1 - k // 8) for k, x in enumerate(flags) if x).to_bytes((len(flags) + 7) // 8, "big")
    header += b"\x05" + number(n)
    if empty:
        flags = bits([False] * len(names) + [True] * len(empty))
        header += b"\x0e" + number(len(flags)) + flags
        flags = bits([not is_folder for _, is_folder in empty])
        header += b"\x0f" + number(len(flags)) + flags
    text = b"\0" + b"".join(x.encode("utf-16-le") + b"\0\0" for x in [*names, *(x for x, _ in empty)])
    header += b"\x11" + number(len(text)) + text + b"\0\0"
    body = b"".join(bodies)
    if packed_header:
        pack, coders = CODERS["lzma"]
        at, crc, size = len(body), zlib.crc32(header), len(header)
        packed = pack(header)
        body += packed
        header = b"\x17" + streams(at, [packed], [(coders, size, crc)]) + b"\0"
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + header
