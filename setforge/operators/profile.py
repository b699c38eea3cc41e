"""Analytics over profiler samples (comm, tid, time, stack with the leaf first) and flamegraph frames (name, samples, percent, seq).

Every ranking has its key as a last tie-breaker, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setforge.operators.ordinals import MOST, followed
from setforge.functions.rules import OTHER, PROFILE_RULES, Rule, category, category_order

PERCENT = 100.0


def share(n: Column, total: Column) -> Column:
    """Percentage of a total, zero of none."""
    return F.when(total > 0, PERCENT * n / total).otherwise(0.0)


def with_leaf(samples: DataFrame) -> DataFrame:
    return samples.withColumn("function", F.get("stack", 0))


def group_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Count of each key and its percentage of all rows."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    return counted.withColumn("pct", share(F.col("n"), total))


def thread_breakdown(samples: DataFrame) -> DataFrame:
    return group_counts(samples, "tid", "comm")


def top_functions(rows: DataFrame, n: int = 40) -> DataFrame:
    """The n most frequent leaf functions with their share of all samples."""
    return group_counts(rows, "function").orderBy(F.desc("n"), "function").limit(n)


def top_functions_per_thread(rows: DataFrame, n: int = 15, threads: int | None = 8) -> DataFrame:
    """The n most frequent functions of each of the busiest threads, with their share of the thread."""
    counted = rows.groupBy("tid", "comm", "function").agg(F.count("*").alias("n"))
    totals = counted.groupBy("tid", "comm").agg(F.sum("n").alias("thread_n"))
    if threads is not None:
        totals = totals.orderBy(F.desc("thread_n"), "tid", "comm").limit(threads)
    ranked = counted.join(totals, ["tid", "comm"]).withColumn("rank", F.row_number().over(W.partitionBy("tid", "comm").orderBy(F.desc("n"), "function")))
    return ranked.filter(F.col("rank") <= n).select("tid", "comm", "rank", "function", "n", share(F.col("n"), F.col("thread_n")).alias("pct"))


def stack_edges(samples: DataFrame) -> DataFrame:
    """(caller, callee) of all adjacent frames."""
    pairs = F.expr("transform(slice(stack, 1, greatest(size(stack) - 1, 0)), (x, i) -> struct(get(stack, i + 1) as caller, x as callee))")
    return samples.select(F.inline(pairs))


def callee_edges(samples: DataFrame, n: int = 30) -> DataFrame:
    """The n most frequent edges; percentages are of samples, not of edges."""
    counted = stack_edges(samples).groupBy("caller", "callee").agg(F.count("*").alias("n"))
    total = samples.agg(F.count("*")).scalar()
    out = counted.select("caller", "callee", "n", share(F.col("n"), total).alias("pct"))
    return out.orderBy(F.desc("n"), "caller", "callee").limit(n)


def sequence_edges(rows: DataFrame, key: str, order: list[str], item: str, most: int = MOST) -> DataFrame:
    """Edges between rows that follow one another within a key: the form for stacks kept as rows.

    Keys of over ``most`` rows are dealt out by ranges of the rows' order, whatever its values are.
    """
    pairs = followed(rows.select(key, *order, F.col(item).alias("callee")), [key], order, "callee", "caller", most)
    return pairs.select("caller", "callee").dropna(subset=["caller"])


def time_range(rows: DataFrame, time: str) -> DataFrame:
    return rows.agg(F.min(time).alias("first"), F.max(time).alias("last"), (F.max(time) - F.min(time)).alias("duration"))


def bucketed(rows: DataFrame, time: str, buckets: int = 10) -> DataFrame:
    """``rows`` with ``bucket``: equal widths between the least and the largest time, which falls into the last bucket."""
    ends = rows.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    lo, span = ends["lo"], ends["hi"] - ends["lo"]
    raw = F.when(span > 0, F.floor((F.col(time) - lo) * buckets / span)).otherwise(0)
    return rows.withColumn("bucket", F.least(raw, F.lit(buckets - 1)).cast("int"))


def timeline(rows: DataFrame, time: str, item: str, buckets: int = 10) -> DataFrame:
    """(bucket, n, mode): size of each bucket, empty ones too, and its most frequent item."""
    counted = bucketed(rows, time, buckets).groupBy("bucket", item).agg(F.count("*").alias("n"))
    # the most frequent item: among equals the least, hence the minimum of (-n, item)
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), F.col(item).alias("i"))).alias("best"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.col("best.i").alias("mode"))


def timeline_by(rows: DataFrame, time: str, key: str, keys: list, buckets: int = 10) -> DataFrame:
    """Counts of each bucket for the given values of a key, a column each."""
    return bucketed(rows, time, buckets).filter(F.col(key).isin(keys)).groupBy("bucket").pivot(key, keys).count().na.fill(0)


def first_names(samples: DataFrame, seq: str) -> DataFrame:
    """(tid, comm): the name that each thread had first."""
    return samples.groupBy("tid").agg(F.min_by("comm", seq).alias("comm"))


def category_counts(rows: DataFrame, name: str = "function", rules: tuple[Rule, ...] = PROFILE_RULES, other: str = OTHER) -> DataFrame:
    return group_counts(rows.select(category(F.col(name), rules, other).alias("category")), "category")


# --- flamegraph frames -----------------------------------------------------------------------------------------------


def frame_top(frames: DataFrame, n: int = 30, min_pct: float = 1.0) -> DataFrame:
    return frames.filter(F.col("percent") >= min_pct).orderBy(F.desc("percent"), "seq").limit(n)


def frame_search(frames: DataFrame, pattern: str) -> DataFrame:
    """Frames whose name holds the pattern in any case; the empty pattern is in every name."""
    return frames.filter(F.lower("name").contains(pattern.lower()))


# How kernel entry points are named.
SYSCALLS = ("__x64_sys_", "__x86_sys_")


def frame_syscalls(frames: DataFrame) -> DataFrame:
    """(syscall, percent, ...) of frames that are system calls, without their prefix."""
    hit, name = F.lit(False), F.col("name")
    for p in SYSCALLS:
        hit = hit | F.col("name").startswith(p)
        name = F.when(F.col("name").startswith(p), F.substring("name", len(p) + 1, 1 << 20)).otherwise(name)
    return frames.filter(hit).withColumn("syscall", name)


def totals(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("n"), F.coalesce(F.sum("percent"), F.lit(0.0)).alias("percent"))


def category_percents(frames: DataFrame, rules: tuple[Rule, ...] = PROFILE_RULES) -> DataFrame:
    """Percentages are inclusive of callees, so their sums may exceed 100."""
    out = frames.groupBy(category(F.col("name"), rules).alias("category")).agg(F.sum("percent").alias("percent"), F.count("*").alias("n"))
    return out.orderBy(F.desc("percent"), "category")


def category_top(frames: DataFrame, n: int = 5, min_pct: float = 0.5, rules: tuple[Rule, ...] = PROFILE_RULES) -> DataFrame:
    """The heaviest frames of each category, categories in the order of the rules."""
    rows = frames.filter(F.col("percent") >= min_pct).withColumn("category", category(F.col("name"), rules))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(F.desc("percent"), "seq")))
    return ranked.filter(F.col("rank") <= n).orderBy(category_order(F.col("category"), rules), "rank")


def frame_diff(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """(name, before, after, delta): one row for each frame of ``before`` and each of ``after`` under a new name.

    A name that stands more than once counts with its last frame, the one of least percent; its rows are repeated as
    often as the name stands on the left (or on the right, if only there).
    """

    def last(frames: DataFrame, side: str) -> DataFrame:
        return frames.groupBy("name").agg(F.min_by("percent", F.struct("percent", -F.col("seq"))).alias(side), F.count("*").alias(f"n_{side}"))

    met = last(before, "before").join(last(after, "after"), "name", "full_outer")
    met = met.select("name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("before", "after")], F.coalesce("n_before", "n_after").alias("copies"))
    rows = met.withColumn("delta", F.col("after") - F.col("before")).filter(F.abs("delta") >= least)
    return rows.select("name", "before", "after", "delta", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def ranked_diff(diff: DataFrame, n: int = 30) -> DataFrame:
    """The n largest changes of either sign."""
    side = F.when(F.col("delta") > 0, "regression").otherwise("improvement")
    ranked = diff.withColumn("side", side).withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("delta")), "name")))
    return ranked.filter(F.col("rank") <= n)


def diff_totals(diff: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), zero).alias("regressions"),
        F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("delta"))), zero).alias("improvements"),
        F.count("*").alias("n"),
    )


def run_stats(rows: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation, least and largest of run times."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"))
