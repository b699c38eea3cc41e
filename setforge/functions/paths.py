"""Column functions over paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one or if the only dot leads the name."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(file_name(name), r"^(.+)\.[^.]*$", "$1")


def under(path: Column, root: str | Column) -> Column:
    """Component-wise: the root itself, or below it; ``/src/a`` does not hold ``/src/ab``."""
    if isinstance(root, str):
        return (path == root) | path.startswith(root.rstrip("/") + "/")
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def source_kind(in_archive: Column, path: Column) -> Column:
    """bare, zip or archive, from the extension of the containing file."""
    return F.when(~in_archive, "bare").when(F.lower(extension(path)) == "zip", "zip").otherwise("archive")


def has_drive_prefix(name: Column) -> Column:
    return name.rlike("^[A-Za-z]:")


def _plain_part(part: Column) -> Column:
    return (part != "") & ~part.isin(".", "..")


def safe_file_name(name: Column) -> Column:
    """One normal path component: nothing that could leave the destination folder."""
    bad = name.contains("/") | name.contains("\\") | name.contains("\u0000") | has_drive_prefix(name)
    return F.coalesce(_plain_part(name) & ~bad, F.lit(False))


def safe_entry_name(name: Column) -> Column:
    """Every part between slashes is a normal component; neither absolute nor a folder."""
    bad = name.contains("\\") | name.contains("\u0000") | has_drive_prefix(name)
    return F.coalesce(F.forall(F.split(name, "/"), _plain_part) & ~bad, F.lit(False))
