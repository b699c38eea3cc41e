"""Ordinals and running sums over sorted rows, however many rows a key has.

Rows are dealt out by ranges of (key, order), so that one key may lie in many partitions; each partition sums up its own
rows, and what stands before it is a running sum over the partitions' totals, of which there is one row for each key and
partition that holds some of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setforge.scratch import passing_path

#: Rows of one key up to which a window sorts them in one task.
MOST = 1_000_000


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def _cut(rows: DataFrame, key: list[str], order: list[Column | str], part: str) -> DataFrame:
    """``rows`` with the number of their range, written down: another evaluation could sample other ranges."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *key, *order).withColumn(part, F.spark_partition_id())
    path = passing_path(spark)
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _on(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns))


def running(rows: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of a key's rows up to each row, itself included; ``F.lit(1)`` sums up to the ordinal.

    Rows that are equal in all of the order are taken in any order. The key may be empty: all rows are one.
    """
    part, *adds = free_names([*rows.columns, *sums], "__part", *[f"__{c}" for c in sums])
    cut = _cut(rows.withColumns(dict(zip(adds, sums.values()))), key, order, part)
    totals = cut.groupBy(*key, part).agg(*[F.sum(c).alias(c) for c in adds])
    earlier = W.partitionBy(*key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*key, part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in adds]).alias("b")
    own = W.partitionBy(*key, part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = cut.withColumns({c: F.sum(c).over(own) for c in adds}).alias("i")
    every = inside.join(before, _on("i", "b", [*key, part]))
    return every.select(*[F.col(f"i.`{c}`") for c in rows.columns], *[(F.col(f"i.`{a}`") + F.col(f"b.`{a}`")).alias(c) for a, c in zip(adds, sums)])


def _by_heat(rows: DataFrame, key: list[str], most: int, plain: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of keys with over ``most`` rows through ``dealt``, the others through ``plain``."""
    count, *own = free_names(rows.columns, "__n", *[f"__{c}" for c in key])
    counted = rows.groupBy(*key).agg(F.count("*").alias(count)).filter(F.col(count) > most)
    hot = counted.select(*[F.col(c).alias(o) for c, o in zip(key, own)]).cache()  # a row for each key of so many rows
    if hot.isEmpty():
        return plain(rows)
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(key, own)))
    return plain(rows.join(F.broadcast(hot), on, "left_anti")).unionByName(dealt(rows.join(F.broadcast(hot), on, "left_semi")))


def ordinals(rows: DataFrame, key: list[str], order: list[Column | str], name: str, most: int = MOST) -> DataFrame:
    """``rows`` with the ordinal of each among those of its key, from 1; keys of over ``most`` rows are sorted by many tasks."""

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("int"))

    def dealt(df: DataFrame) -> DataFrame:
        return running(df, key, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))

    return _by_heat(rows, key, most, plain, dealt)


def followed(rows: DataFrame, key: list[str], order: list[Column | str], value: str, name: str, most: int = MOST) -> DataFrame:
    """``rows`` with the value of the row before in its key, null for the first; keys of over ``most`` rows are sorted by many tasks."""

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumn(name, F.lag(value).over(W.partitionBy(*key).orderBy(*order)))

    def dealt(df: DataFrame) -> DataFrame:
        part, nr, last = free_names([*df.columns, name], "__part", "__nr", "__last")
        cut = _cut(df, key, order, part)
        own = W.partitionBy(*key, part).orderBy(*order)
        inside = cut.withColumns({name: F.lag(value).over(own), nr: F.row_number().over(own)}).alias("i")
        ends = cut.groupBy(*key, part).agg(F.max_by(F.struct(value), F.struct(*order)).alias(last))  # a row for each key and range
        before = ends.withColumn(last, F.lag(last).over(W.partitionBy(*key).orderBy(part))).alias("b")
        every = inside.join(before, _on("i", "b", [*key, part]))
        held = F.when(F.col(f"i.`{nr}`") == 1, F.col(f"b.`{last}`.`{value}`")).otherwise(F.col(f"i.`{name}`"))
        return every.select(*[F.col(f"i.`{c}`") for c in df.columns], held.alias(name))

    return _by_heat(rows, key, most, plain, dealt)
