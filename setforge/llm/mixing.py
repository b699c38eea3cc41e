"""Mixing of sources to target weights: every document is taken a whole number of times, and perhaps once more.

Words are summed up by source. Sources have weights; a source's target is its share by weight of all words, but at most
``MOST`` times its own: what exceeds that goes to the other sources by their weights, until none is above. The rate of
a source is its target over its words. A document is taken floor(rate) times, and once more if a hash of the seed and
its id, as a number from 0 to 1, is below the rest of the rate: the same in every run, whatever the partitions.

Resharing ends where every source has the lesser of its cap and its weight times one level, so the level is found
directly: with sources in the order of cap over weight, the first ones have their caps, and the level is what is left of
all words over what is left of all weights. Both orders (names for weights, caps for the level) are running sums over
ranges of sources, so sources may be as many as documents; the table of sources is broadcast only if Spark finds it small.

Words are runs of characters other than space and U+0009 to U+000D. Null texts have no words. A null source is one
source, the last. Sources without words have a target of 0. Rows that repeat an id have the same draw; of rows without
an id the text stands in for it. No rows give no rows. Other columns are kept by :func:`mix` and ignored by :func:`report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import stored
from setforge.operators.ordinals import free_names, running

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1, one excluded, from the first 32 bits of a hash."""
    what = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(F.sha2(what, 256), 1, 8), 16, 10).cast("double") / 2**32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of the rows (source, size); weights go to sources by code point, repeating, a null source being last."""
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(summed, [], [F.col("source").asc_nulls_last()], {"nr": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nr") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    # in the order of cap over weight: source k has its cap if the level of those from it on would give it more
    level = [(F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()]
    summed_up = stored(running(capped, [], level, {"caps": F.col("cap"), "weights": F.col("weight")}))
    whole = summed_up.agg(F.struct(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))).scalar()
    rest_words = whole["words"] - (F.col("caps") - F.col("cap"))
    rest_weights = whole["weights"] - (F.col("weights") - F.col("weight"))
    judged = summed_up.withColumn("over", F.col("weight") * rest_words >= F.col("cap") * rest_weights)
    taken = judged.filter("over").agg(F.struct(F.coalesce(F.sum("cap"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights"))).scalar()
    by_weight = F.try_divide((F.col("weight") * (whole["words"] - taken["words"])).cast("double"), (whole["weights"] - taken["weights"]).cast("double"))
    out = judged.withColumn("target", F.when(F.col("over"), F.col("cap").cast("double")).otherwise(by_weight))
    return out.select("source", "source_size", "target")


def copies(docs: DataFrame, name: str, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with the struct ``name``: size, source_size, target of the source, n copies."""
    own_size, own_draw, of = free_names(docs.columns, "__size", "__draw", "__source")
    sized = docs.withColumns({own_size: size(F.col("text")), own_draw: draw(seed, F.col("doc_id"), F.col("text"))})
    rates = stored(targets(docs.select("source", size(F.col("text")).alias("size")), weights, most)).withColumnRenamed("source", of)
    joined = sized.join(rates.select(of, F.struct("source_size", "target").alias(name)), F.col("source").eqNullSafe(F.col(of)), "left")
    rate = F.when(F.col(f"{name}.source_size") > 0, F.col(f"{name}.target") / F.col(f"{name}.source_size")).otherwise(0.0)
    n = (F.floor(rate) + (F.col(own_draw) < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.withColumn(name, F.struct(F.col(own_size).alias("size"), f"{name}.source_size", f"{name}.target", n.alias("n"))).select(*docs.columns, name)


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    name, copy = free_names(docs.columns, "__mix", "__copy")
    made = copies(docs, name, seed, weights, most).filter(F.col(f"{name}.n") > 0)
    return made.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.n").cast("int")))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    made = copies(docs.select("doc_id", "text", "source"), "m")
    return made.select("doc_id", "m.size", "m.source_size", "m.target", (F.col("m.n") * F.col("m.size")).alias("taken"))


SQL = f"""
with d as (
  select doc_id, text, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) as bigint) as size,
         cast(('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), ':' || coalesce(text, ''))), 1, 8)) as bigint) / 4294967296.0 as u
  from documents
),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [{", ".join(map(str, WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight, {MOST} * source_size as cap from s),
r as (select *, sum(cap) over o - cap as caps, sum(weight) over o - weight as weights, sum(source_size) over () as words, sum(weight) over () as all_weights
      from w window o as (order by cap / weight, source nulls last)),
j as (select *, weight * (words - caps) >= cap * (all_weights - weights) as over from r),
l as (select *, sum(case when over then cap else 0 end) over () as tc, sum(case when over then weight else 0 end) over () as tw from j),
t as (select source, source_size, case when over then cast(cap as double) else cast(weight * (words - tc) as double) / cast(all_weights - tw as double) end as target from l),
c as (select doc_id, size, source_size, target, u, case when source_size > 0 then target / source_size else 0.0 end as rate
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end) as taken from c
"""
