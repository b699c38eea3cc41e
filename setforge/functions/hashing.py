"""Digests beyond Spark's built-in ones (sha1 and md5 are built in)."""

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def xxh3_64(s: pd.Series) -> pd.Series:
    """XXH3-64 of bytes, big-endian; Spark's xxhash64 is another function."""
    return s.map(lambda x: None if x is None else xxhash.xxh3_64_digest(x))
