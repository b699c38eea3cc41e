"""Column functions over text: escapes, names, the two profile formats, hex."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Replacements in the order in which they apply.
UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))
ATTRIBUTE_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
TEXT_ESCAPES = ATTRIBUTE_ESCAPES[:3]


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def html_unescape(c: Column) -> Column:
    return _replaced(c, UNESCAPES)


def xml_escape_attribute(c: Column) -> Column:
    return _replaced(c, ATTRIBUTE_ESCAPES)


def xml_escape_text(c: Column) -> Column:
    return _replaced(c, TEXT_ESCAPES)


def json_string(c: Column) -> Column:
    """The text as a quoted JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r"^\{\"x\":(.*)\}$", 1)


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; Spark's own trim knows spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def safe_name(c: Column) -> Column:
    """Runs of anything but letters, digits, dot, underscore and hyphen become one underscore; ends lose ``._-``."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def game_name(source_stem: Column, rom_stem: Column) -> Column:
    return F.when(source_stem == rom_stem, source_stem).otherwise(F.concat_ws("_", source_stem, rom_stem))


@F.pandas_udf(StringType())
def url_segment(s: pd.Series) -> pd.Series:
    """Percent-encoding of one path segment by UTF-8 bytes; url_encode would write spaces as plus signs."""
    return s.map(lambda x: None if x is None else quote(x, safe="~"))


def download_url(base: str, identifier: Column, name: Column) -> Column:
    """The address of one file; segments of the name keep their slashes."""
    return F.concat_ws("/", F.lit(base), url_segment(identifier), url_segment(name))


def from_hex(c: Column, what: str) -> Column:
    """Bytes of a hex text; anything else is an error, not a null or a padded value as with unhex alone."""
    ok = c.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(ok, F.unhex(c)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: not hex: "), F.coalesce(c, F.lit("null")))).cast("binary"))


def checked_sha1(c: Column, label: Column) -> Column:
    """The digest itself if it has 20 bytes, else an error that names the row and the length."""
    said = F.concat(F.lit("sha1 of "), F.coalesce(label, F.lit("?")), F.lit(" has "), F.coalesce(F.octet_length(c).cast("string"), F.lit("no")), F.lit(" bytes instead of 20"))
    return F.when(F.octet_length(c) == 20, c).otherwise(F.raise_error(said).cast("binary"))


def verified_sha1(actual: Column, expected: Column) -> Column:
    """True where the expectation is empty or equals the digest (hex, in any case); an error otherwise."""
    ok = (F.coalesce(expected, F.lit("")) == "") | (F.lower(expected) == F.lower(actual))
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("sha1 mismatch: expected"), expected, F.lit("got"), actual)).cast("boolean"))


def title_name(title: Column) -> Column:
    """Name in a flamegraph title ``name (1,234 samples, 5.6%)``: what stands before the last parenthesis."""
    return stripped(html_unescape(F.regexp_extract(title, r"^(.*)\(", 1)))


def title_samples(title: Column) -> Column:
    inner = F.regexp_extract(title, r"^.*\((.*)$", 1)
    return F.replace(F.regexp_extract(inner, r"^([0-9,]+) sample", 1), F.lit(","), F.lit("")).try_cast("long")


def title_percent(title: Column) -> Column:
    inner = F.regexp_extract(title, r"^.*\((.*)$", 1)
    return F.regexp_extract(inner, r"^.*, ([^%]*)%", 1).try_cast("double")


#: comm, thread id and time of a sample header; group 1 is lazy, an optional process id stands before the thread's.
SAMPLE_HEADER = r"^([^:]*?)\s+(?:\d+/)?(\d+)\s*(?:\[[^\]]*\])?\s+([0-9.]+):"


def header_comm(h: Column) -> Column:
    return stripped(F.regexp_extract(h, SAMPLE_HEADER, 1))


def header_tid(h: Column) -> Column:
    return F.regexp_extract(h, SAMPLE_HEADER, 2).try_cast("long")


def header_time(h: Column) -> Column:
    return F.regexp_extract(h, SAMPLE_HEADER, 3).try_cast("double")


def frame_function(line: Column) -> Column:
    """Function of a stack line ``address function+0xoffset (object)``."""
    c = F.regexp_replace(stripped(line), r"^\S+ ", "")
    c = F.regexp_replace(c, r" \((?!.* \().*$", "")
    return stripped(F.regexp_replace(c, r"\+(0x[^+]*|[0-9A-Fa-f]*)$", ""))
