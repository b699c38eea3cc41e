"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.scratch import passing_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores (small files can't be split) dealt out to all of them, for work on every row."""
    cores = total_cores(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Tables stored since a call of :func:`settled` began, for each call that is under way.
_under_way: list[list[DataFrame]] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and every later use reads the files.

    The files go when the application ends, or earlier by :func:`drop_stored` or :func:`settled`.
    """
    path = passing_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._setforge_path = path
    if _under_way:
        _under_way[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, stored; what it stored on the way is deleted."""
    _under_way.append([])
    try:
        out = stored(make())
    finally:
        passing = _under_way.pop()
    for df in passing:
        if df is not out:
            drop_stored(df)
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_setforge_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def total_cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def scanned(values: Column, op, back: bool = False) -> Column:
    """At each place ``op`` over all values up to it, or from it on (``back``); each round reaches twice as far as the last one."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    rounds = F.when(F.size(values) > 1, F.ceil(F.log2(F.size(values)))).otherwise(0).cast("int")
    return F.aggregate(F.slice(steps, F.lit(1), rounds), values, lambda a, step: F.transform(a, lambda x, i: F.coalesce(op(x, F.get(a, i + step if back else i - step)), x)))


def crc32_sql(text: str) -> str:
    """CRC-32 of a string in DuckDB: the halves of its bytes, low ones first, through the polynomial's 16 remainders."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    halves = f"list_filter(string_split(regexp_replace(hex({text}), '(.)(.)', '\\2,\\1,', 'g'), ','), lambda x: x <> '')"
    step = f"lambda c, n: xor(c >> 4, {table}[((xor(c, n) & 15) + 1)::bigint])"
    return f"xor(list_reduce(list_transform({halves}, lambda x: ('0x' || x)::bigint), {step}, 4294967295::bigint), 4294967295::bigint)"
