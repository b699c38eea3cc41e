"""Explicit schemas of the relations; nothing is ever inferred."""

from pyspark.sql import types as T

_S, _I, _L, _B, _BIN = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.BinaryType()


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DATA_FILES = _of(
    id=_L, build=_S, debug=_S, file_name=_S, name=_S, description=_S, category=_S, version=_S, author=_S, email=_S, homepage=_S, url=_S, sha1=_BIN
)
GAMES = _of(
    id=_L, name=_S, is_bios=_S, clone_of=_S, rom_of=_S, sample_of=_S, board=_S, rebuildto=_S, year=_S, manufacturer=_S, data_file_id=_L, parent_id=_L
)
ROMS = _of(
    id=_L, name=_S, size=_I, md5=_BIN, sha1=_BIN, crc=_BIN, date=T.DateType(), updated_at=T.TimestampNTZType(), inserted_at=T.TimestampNTZType(), game_id=_L, archive_file_id=_L
)
ROM_FILES = _of(
    id=_L, parent_path=_S, parent_game_name=_S, path=_S, name=_S, crc=_BIN, sha1=_BIN, md5=_BIN, xxhash3=_BIN, in_archive=_B, kind=_S, entry_seq=_I, rom_id=_L
)
#: What a scan of a tree yields before ids are given.
SCANNED = _of(parent_path=_S, path=_S, name=_S, sha1=_BIN, xxhash3=_BIN, md5=_BIN, size=_L, in_archive=_B, kind=_S, entry_seq=_I)
DAT_ROMS = _of(dat_name=_S, game_name=_S, parent_name=_S, rom_name=_S, sha1=_BIN)
SOURCE_FILES = _of(source_root=_S, canonical_path=_S, entry_name=_S, kind=_S, sha1=_BIN, seq=_L)
SAMPLES = _of(comm=_S, tid=_L, time=T.DoubleType(), stack=T.ArrayType(_S))
FRAMES = _of(name=_S, samples=_L, percent=T.DoubleType(), seq=_L)
CATALOG = _of(tier=_S, kind=_S, identifier=_S, file_name=_S, allow_extensionless=_I, exclude_disallowed=_I, evidence=_S)
METADATA = T.StructType(
    [
        T.StructField("metadata", _of(licenseurl=_S, title=_S, description=_S, subject=_S)),
        T.StructField("files", T.ArrayType(_of(name=_S, sha1=_S))),
    ]
)
#: The catalogue document; attributes carry a leading underscore.
_ROM = _of(_name=_S, _size=_I, _md5=_S, _sha1=_S, _crc=_S, _merge=_S, _status=_S, _serial=_S, _date=_S)
GAME = T.StructType(
    [T.StructField(f, _S) for f in ("_name", "_sourcefile", "_isbios", "_cloneof", "_romof", "_sampleof", "_board", "_rebuildto", "year", "manufacturer")]
    + [T.StructField("rom", T.ArrayType(_ROM))]
)
#: The document without its games.
HEAD = T.StructType(
    [
        T.StructField("_build", _S),
        T.StructField("_debug", _S),
        T.StructField("header", _of(name=_S, description=_S, version=_S, author=_S, homepage=_S, url=_S)),
    ]
)
DATAFILE = T.StructType([*HEAD, T.StructField("game", T.ArrayType(GAME))])
