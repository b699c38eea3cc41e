"""Secret scans with DataFrame functions only: fixed patterns, and strings that a character Markov model calls random.

Base spans come from three patterns (``BASE``). Beyond them, every run of ``LEAST`` or more token characters is scored
by two first-order Markov models, one of random strings and one of ordinary identifiers: the mean log-likelihood ratio
of its transitions. Runs above ``MEAN_RATIO`` that no base span overlaps become spans of kind ``markov``.

The models are counted from labelled samples of the corpus itself: what the base patterns caught is random, runs of
letters are ordinary. Counting reads the share of about ``SAMPLE_ROWS`` rows, a documented bound, chosen by a hash of
the text, each different text once; the table of ratios has one entry for each pair of token characters and thus a
fixed size. Scanning reads every whole text.

A match's place is the length of what stands before it, from the gaps that a split at the same pattern leaves. Sums and
extremes along the matches of a text are scans of log2(n) rounds over its array (:func:`setforge.llm.common.scanned`), so a text with very
many matches takes time n log n. Null texts count as empty and have no spans. Without any random sample the ratios are those of the empty counts, zero, and
no ``markov`` span appears. Repeated rows are scanned like others; columns besides the text are kept or ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import scanned

#: (kind, pattern, group whose length counts, least length). The order is that of kinds at equal starts.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KIND = "markov"
LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{8,}(?![A-Za-z0-9+/_=-])"
MEAN_RATIO = 0.7
SAMPLE_ROWS = 20_000
#: Characters of a piece in redaction.
CUT = 1024
#: Token characters lie between "+" and "z".
FIRST, SIZE, LETTERS = 43, 80, 67


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it in other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, ord, end, kind, value) of the pattern's non-overlapping matches in code points, end exclusive."""
    if kind == "hex":  # a run fails or passes as a whole; the engine may skip short ones itself
        pattern = rf"[0-9a-f]{{{least},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms))
        ends = scanned(F.zip_with(gaps, ms, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y)
        value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
        return F.zip_with(ends, ms, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(order).alias("ord"), e.alias("end"), F.lit(kind).alias("kind"), value(m).alias("value")))

    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value:string>>)")
    return F.when(text.rlike(pattern), F.filter(let(found, placed), lambda s: F.length(s["value"]) >= least)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of all base patterns, by start and then kind."""
    return F.array_sort(F.concat(*[_spans(text, kind, k, p, g, n) for k, (kind, p, g, n) in enumerate(BASE)]))


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratios of all pairs of token characters, random over ordinary, with one added to every count."""
    total = max(1, docs.count())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    few = docs.select(text.alias("text")).filter(place < int((1 << 32) * min(1.0, rows / total))).distinct()
    samples = few.select(
        F.explode(
            F.concat(
                F.transform(base_spans(F.col("text")), lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("v"))),
                F.transform(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), lambda v: F.struct(F.lit(0).alias("random"), v.alias("v"))),
            )
        ).alias("x")
    ).select("x.random", F.split(F.regexp_replace("x.v", "[^A-Za-z0-9+/_=-]", ""), "").alias("c"))
    pairs = samples.select("random", F.explode(F.expr("transform(sequence(0, greatest(size(c) - 2, 0)), i -> struct(get(c, i) as a, get(c, i + 1) as b))")).alias("p"))
    counts = pairs.select("random", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).filter("a >= 43 and b >= 43").groupBy("random", "a", "b").count()
    found = {(r["random"], r["a"], r["b"]): r["count"] for r in counts.collect()}  # two rows a pair of characters at most
    sums = {(k, a): sum(n for (kk, aa, _), n in found.items() if (kk, aa) == (k, a)) for k in (0, 1) for a in range(FIRST, FIRST + SIZE)}
    if not any(k for k, _, _ in found):
        return [0.0] * (SIZE * SIZE)
    p = lambda k, a, b: (found.get((k, a, b), 0) + 1) / (sums[k, a] + LETTERS)
    return [round(math.log(p(1, a, b) / p(0, a, b)), 6) for a in range(FIRST, FIRST + SIZE) for b in range(FIRST, FIRST + SIZE)]


def _mean_ratio(value: Column, ratios: Column) -> Column:
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST)
    return let(
        codes,
        lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(c, i) * SIZE + F.get(c, i + 1))) / (F.size(c) - 1),
    )


def markov_spans(text: Column, base: Column, ratios: list[float], least: float = MEAN_RATIO) -> Column:
    """Runs of token characters that look random and that no base span overlaps."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    runs = _spans(text, KIND, len(BASE), RUN, 0, LEAST)
    is_base = lambda s: s["ord"] < len(BASE)

    def free(both: Column) -> Column:
        """The runs among all spans, in order, that no base span before them reaches into and none begins in."""
        reached = scanned(F.transform(both, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), F.greatest)
        following = scanned(F.transform(both, lambda s: F.when(is_base(s), s["start"]).otherwise((1 << 31) - 1)), F.least, back=True)
        marked = F.zip_with(both, F.arrays_zip(reached.alias("reached"), following.alias("following")), lambda s, x: F.struct(s.alias("s"), (~is_base(s) & (x["reached"] <= s["start"]) & (x["following"] >= s["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: x["s"])

    own = lambda r: F.filter(let(F.array_sort(F.concat(base, r)), free), lambda s: _mean_ratio(s["value"], table) > least)
    return let(runs, lambda r: F.when(F.size(r) > 0, own(r)).otherwise(r))


def scan(docs: DataFrame, ratios: list[float] | None = None, text_col: str = "text", names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two arrays of (start, ord, end, kind, value) by start and kind: base spans, and all spans.

    Columns of ``docs`` that bear these names are replaced; give other names to keep them.
    """
    ratios = train(docs, text_col) if ratios is None else ratios
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(names[0], base_spans(text))
    return out.withColumn(names[1], F.array_sort(F.concat(names[0], markov_spans(text, F.col(names[0]), ratios))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans (in order) cover replaced by the mark.

    What stays is taken out of pieces of CUT characters, as a substring counts from the beginning of its text.
    """

    def between(cuts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        some = F.slice(cuts, first + 1, F.floor(b / CUT).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), a - first * CUT + 1, b - a)

    def done(x: Column) -> Column:
        cuts, at = x["cuts"], x["at"]
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1))
        new = lambda s, i: (i == 0) | (s["start"] > before(i))
        parts = F.transform(spans, lambda s, i: F.when(new(s, i), F.concat(between(cuts, before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(cuts, F.element_at(at, -1), F.length(text)))

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    ends = scanned(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(F.struct(cuts.alias("cuts"), ends.alias("at")), done)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""
    found = scan(docs).select("doc_id", "base", "spans")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(b[0]) for b in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_HEX, _ACCESS, _RUN = "[0-9a-f]{16,}", "AKIA[A-Z0-9]+", f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SQL = f"""
with texts as (select row_number() over () as nr, doc_id, coalesce(text, '') as text from documents),
docs as (
  select nr, text, row_number() over (partition by text order by nr) = 1
    and cast('0x' || substr(md5(text), 1, 8) as bigint) < floor(4294967296.0 * least(1, {SAMPLE_ROWS} / (select count(*) from texts))) as few
  from texts
),
m as (
  select nr, few, 0 as ord, 'assign' as kind, 12 as least, regexp_extract_all(text, '{_ASSIGN}') as ms, regexp_extract_all(text, '{_ASSIGN}', 1) as vs, string_split_regex(text, '{_ASSIGN}') as gs from docs
  union all select nr, few, 1, 'access', 18, regexp_extract_all(text, '{_ACCESS}'), regexp_extract_all(text, '{_ACCESS}'), string_split_regex(text, '{_ACCESS}') from docs
  union all select nr, few, 2, 'hex', 16, regexp_extract_all(text, '{_HEX}'), regexp_extract_all(text, '{_HEX}'), string_split_regex(text, '{_HEX}') from docs
  union all select nr, few, 3, '{KIND}', {LEAST}, regexp_extract_all(text, '{_RUN}'), regexp_extract_all(text, '{_RUN}'), string_split_regex(text, '{_RUN}') from docs
),
u as (select nr, few, ord, kind, least, unnest(range(1, len(ms) + 1)) as i, ms, vs, gs from m where len(ms) > 0),
s as (
  select nr, few, ord, kind, vs[i] as v, length(ms[i]) as n, least,
    cast(list_sum(list_transform(gs[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) as bigint) as b
  from u
),
spans as (select nr, few, ord, kind, v, b, b + n as e from s where length(v) >= least),
base as (select * from spans where ord < 3),
tokens as (
  select 1 as random, regexp_replace(v, '[^A-Za-z0-9+/_=-]', '', 'g') as v from base where few
  union all
  select 0, x from (select unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]+')) as x from docs where few) where regexp_full_match(x, '[A-Za-z_]{{8,}}')
),
pairs as (select random, v, unnest(range(1, length(v))) as i from tokens where length(v) > 1),
counts as (select random, substr(v, i, 1) as a, substr(v, i + 1, 1) as z, count(*) as n from pairs group by 1, 2, 3),
sums as (select random, a, sum(n) as n from counts group by 1, 2),
runs as (
  select * from spans r where ord = 3 and (select count(*) from base where few) > 0
    and not exists (select 1 from base x where x.nr = r.nr and x.b < r.e and r.b < x.e)
),
steps as (select nr, b, v, unnest(range(1, length(v))) as i from runs),
scored as (
  select t.nr, t.b, sum(round(ln(((coalesce(c1.n, 0) + 1.0) / (coalesce(s1.n, 0) + {LETTERS})) / ((coalesce(c0.n, 0) + 1.0) / (coalesce(s0.n, 0) + {LETTERS}))), 6)) / count(*) as mean
  from steps t
  left join counts c1 on c1.random = 1 and c1.a = substr(v, i, 1) and c1.z = substr(v, i + 1, 1)
  left join counts c0 on c0.random = 0 and c0.a = substr(v, i, 1) and c0.z = substr(v, i + 1, 1)
  left join sums s1 on s1.random = 1 and s1.a = substr(v, i, 1)
  left join sums s0 on s0.random = 0 and s0.a = substr(v, i, 1)
  group by 1, 2
),
every as (
  select * from base
  union all
  select r.* from runs r join scored using (nr, b) where mean > {MEAN_RATIO}
),
agg as (
  select nr, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' order by b, ord) filter (ord < 3) as base, string_agg(kind || ':' || b || ':' || e, ',' order by b, ord) as spans
  from every group by 1
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join agg using (nr)
"""
