"""Ordered rules that put names into categories; the rules are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    needles: tuple[str, ...]
    #: Prefixes of the name as it is, instead of substrings of the lower-cased name.
    prefix: bool = False


# The categories of profiler frames, first match wins.
PROFILE_RULES = (
    Rule("Hashing", ("sha1", "sha1_asm", "xxh3", "xxhash", "digest")),
    Rule("Scan/Walk", ("operations::scan", "walkdir", "infer", "scan_zip", "scan_7z", "scan_rar", "walk_for_files")),
    Rule("Planner", ("build::planner", "plan_build", "sources_for_root", "selected_dat_roms", "btreemap")),
    Rule("Writer", ("build::writer", "zipwriter", "copy_from_archive", "copy_from_archive_entry", "copy_from_zip_entry", "copy_from_7z_archive", "copy_from_rar_archive", "copy_bare_file")),
    Rule("Archive/Compression", ("zip", "r7z", "unrar", "compress_tools", "libarchive", "inflate", "deflate", "zstd", "bzip", "lzma", "decompress")),
    Rule("SQLite/Diesel", ("diesel", "sqlite", "libsqlite3", "storage::repositories", "storage::db")),
    Rule("DAT/XML", ("serde_xml_rs", "xml", "logiqx")),
    Rule("Rayon/Threading", ("rayon", "crossbeam", "thread_pool")),
    Rule("Disk I/O", ("read", "write", "pread", "pwrite", "open", "vfs", "ext4", "xfs", "btrfs", "zfs", "io_uring")),
    Rule("Memory", ("alloc", "malloc", "free", "rawvec", "realloc", "memcpy", "memmove", "mmap", "brk")),
    Rule("Syscall", ("__x64_sys_", "syscall", "do_syscall", "entry_SYSCALL"), prefix=True),
)
OTHER = "Other"


def category(name: Column, rules: tuple[Rule, ...] = PROFILE_RULES, other: str = OTHER) -> Column:
    """Label of the first rule that the name meets."""
    lower = F.lower(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        hit = F.lit(False)
        for n in r.needles:
            hit = hit | (name.startswith(n) if r.prefix else lower.contains(n))
        out = out.when(hit, r.label)
    return out.otherwise(other)


def category_order(label: Column, rules: tuple[Rule, ...] = PROFILE_RULES) -> Column:
    """Place of a label in the rules, beyond them for others."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, r in enumerate(rules):
        out = out.when(label == r.label, k)
    return out.otherwise(len(rules))
