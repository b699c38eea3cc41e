"""Profiler output as relations: samples from text, frames from flamegraph pictures; and benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setforge.functions import text


def parse_samples(records: DataFrame, column: str = "value") -> DataFrame:
    """(comm, tid, time, stack) of records, the leaf first. Of several headers in a record the last counts, with the
    lines after it; records without a header, a name or a frame are dropped."""
    lines = F.split(column, "\r?\n")
    is_frame = lambda x: x.rlike(r"^[ \t]")
    is_header = lambda x: ~is_frame(x) & x.rlike(text.SAMPLE_HEADER)
    last = F.expr("aggregate(sequence(0, size(l) - 1), -1, (a, i) -> if(h[i], i, a))")
    rows = records.select(lines.alias("l")).withColumn("h", F.transform("l", is_header)).withColumn("at", last).filter("at >= 0")
    header = F.get("l", F.col("at"))
    frames = F.filter(F.slice("l", F.col("at") + 2, F.size("l")), lambda x: is_frame(x) & (text.stripped(x) != ""))
    out = rows.select(text.header_comm(header).alias("comm"), text.header_tid(header).alias("tid"), text.header_time(header).alias("time"), F.filter(F.transform(frames, text.frame_function), lambda x: x != "").alias("stack"))
    return out.filter((F.col("comm") != "") & (F.size("stack") > 0))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Records are separated by blank lines, which Spark's text reader splits at any size of file."""
    return parse_samples(spark.read.text(path, lineSep="\n\n"))


def parse_frames(pictures: DataFrame, column: str = "value") -> DataFrame:
    """(name, samples, percent, seq) of the titles in SVG texts; seq is the place in the picture."""
    titles = F.regexp_extract_all(column, F.lit(r"(?s)<title>(.*?)</title>"), F.lit(1))
    t = F.col("t")
    rows = pictures.select(F.posexplode(titles).alias("seq", "t"))
    rows = rows.select(text.title_name(t).alias("name"), text.title_samples(t).alias("samples"), text.title_percent(t).alias("percent"), F.col("seq").cast("long").alias("seq"))
    return rows.filter(F.col("samples").isNotNull() & F.col("percent").isNotNull() & ~F.col("name").isin("", "all"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return parse_frames(spark.read.text(path, wholetext=True))


_RESULTS = T.StructType([T.StructField("results", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean", "stddev", "min", "max")])))])


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(mean, stddev, min, max) of the first result of a benchmark file."""
    return spark.read.schema(_RESULTS).json(path, multiLine=True).select(F.get("results", 0).alias("r")).select("r.*")
