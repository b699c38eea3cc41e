"""Tool-call linking for chats: calls meet results, follow one another in topological order, and are checked and serialised.

Relations, one row each:

* calls: call_id, after (id of the call it follows, or null), name, arguments (JSON text)
* results: call_id, content
* schemas: name, field, type (string, integer, number, boolean, object, array, any), required

Everything is done by equality joins on identifiers and groupings, with DataFrame functions only.

Depth in the order comes from pointer doubling: each round joins a call to the one its pointer has reached and adds up
the distance, so chains of n calls need log2(n) rounds. A call's result follows the call directly, hence the places
2 * depth and 2 * depth + 1 of a thread, the thread being named by its first call. Calls on a cycle, and those after
one, have neither thread nor place and the problem ``cycle``.

Null ids take part in nothing and are dropped. An id that several calls bear counts once, by the least of its rows in
the order (name, arguments, after), and has the problem ``repeated call`` if those rows differ; of several results the
least content is taken, with the problem ``several results`` if they differ. An ``after`` that names no call is a
problem ``unknown predecessor`` and the call begins a thread. Arguments that are no JSON object have the problem
``arguments``. A field that a schema lists several times has the first of
its types and is required if any row says so. Results without a call are not part of the output. Empty tables give no rows.

Canonical JSON has sorted keys and no white space; absent parts (no result, unreadable arguments) are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm.common import stored

#: Schemas up to this many rows are broadcast.
BROADCAST_FIELDS = 10_000


def _print(*columns: str):
    """A hash that tells apart rows of other values, nulls included."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def _one_call_each(calls: DataFrame) -> DataFrame:
    """(call_id, name, arguments, after, repeated): one row an id, summed up before it is shuffled; of the other rows only a hash moves."""
    row = F.struct("name", "arguments", "after")
    own = calls.dropna(subset=["call_id"]).select("call_id", row.alias("row"), _print("name", "arguments", "after").alias("print"))
    least = own.groupBy("call_id").agg(F.min("row").alias("x"), F.min("print").alias("p"), F.max("print").alias("q"))
    return least.select("call_id", "x.name", "x.arguments", "x.after", (F.col("p") != F.col("q")).alias("repeated"))


def _one_result_each(results: DataFrame) -> DataFrame:
    own = results.dropna(subset=["call_id"]).select("call_id", "content", _print("content").alias("print"))
    least = own.groupBy("call_id").agg(F.min("content").alias("result"), F.min("print").alias("p"), F.max("print").alias("q"), F.count("*").alias("n_results"))
    return least.select("call_id", "result", "n_results", (F.col("p") != F.col("q")).alias("several"))


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, thread, depth, dangling) by pointer doubling over call_id and after; thread and depth are null on a cycle."""
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("is_call"))
    linked = calls.select("call_id", "after").join(known, "after", "left")
    pointer = F.when(F.col("is_call"), F.col("after"))
    state = stored(
        linked.select(
            "call_id",
            pointer.alias("pointer"),
            pointer.isNotNull().cast("long").alias("depth"),
            F.coalesce(pointer, F.col("call_id")).alias("thread"),
            (F.col("after").isNotNull() & F.col("is_call").isNull()).alias("dangling"),
        )
    )
    most = math.ceil(math.log2(max(2, state.count()))) + 1
    done, open_ = state.filter("pointer is null"), state.filter("pointer is not null")
    for _ in range(most):  # only calls whose pointer has not reached a first call take part; the others are looked up
        if open_.isEmpty():
            break
        known = done.union(open_)
        ahead = known.select(F.col("call_id").alias("pointer"), F.col("pointer").alias("next"), F.col("depth").alias("more"), F.col("thread").alias("first"))
        new = stored(open_.join(ahead, "pointer").select("call_id", F.col("next").alias("pointer"), (F.col("depth") + F.col("more")).alias("depth"), F.col("first").alias("thread"), "dangling"))
        done, open_ = done.union(new.filter("pointer is null")), new.filter("pointer is not null")
    cyclic = open_.select("call_id", F.lit(None).cast("string").alias("thread"), F.lit(None).cast("long").alias("depth"), "dangling")
    return done.select("call_id", "thread", "depth", "dangling").union(cyclic)


def _json_type(kind):
    """The JSON type of a variant, from the beginning of its schema."""
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def outlines(calls: DataFrame) -> DataFrame:
    """(call_id, after, name, kinds): of the arguments only each field's name and type, null where they are no JSON object."""
    v = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    kinds = F.transform_values(F.expr("cast(v as map<string, variant>)"), lambda _, x: F.substring(F.schema_of_variant(x), 1, 7))
    return calls.select("call_id", "after", "name", v.alias("v")).select("call_id", "after", "name", F.when(is_object, kinds).alias("kinds"))


def problems(outlined: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, argument_problems): what the :func:`outlines` of calls lack against the schema of the call's name, sorted and comma-joined.

    Given and expected fields meet in a full outer join on (call_id, field).
    """
    fields = schemas.dropna(subset=["name", "field"]).groupBy("name", "field").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    small = fields.count() <= BROADCAST_FIELDS
    deal = F.broadcast if small else (lambda df: df)
    names = fields.select(F.col("name").alias("schema_name")).distinct()
    parsed = outlined.select("call_id", "name", "kinds", F.col("kinds").isNotNull().alias("readable"))
    given = parsed.filter("readable").select("call_id", F.explode("kinds").alias("field", "kind"))
    given = given.select("call_id", "field", _json_type(F.col("kind")).alias("given"))
    wanted = parsed.filter("readable").select("call_id", "name").join(deal(fields), "name").select("call_id", "field", "type", F.coalesce("required", F.lit(False)).alias("required"))
    met = given.join(wanted, ["call_id", "field"], "full_outer")
    wrong = (
        F.when(F.col("type").isNull(), F.concat(F.lit("unexpected "), "field"))
        .when(F.col("given").isNull() & F.col("required"), F.concat(F.lit("missing "), "field"))
        .when(F.col("given").isNull() | (F.col("type") == "any") | (F.col("type") == F.col("given")) | ((F.col("type") == "number") & (F.col("given") == "integer")), None)
        .otherwise(F.concat(F.lit("type of "), "field"))
    )
    of_fields = met.select("call_id", wrong.alias("problem"))
    named = parsed.join(deal(names), parsed["name"].eqNullSafe(names["schema_name"]), "left")
    of_calls = named.select("call_id", F.explode(F.array_compact(F.array(F.when(F.col("schema_name").isNull(), "unknown tool"), F.when(~F.col("readable"), "arguments")))).alias("problem"))
    unknown = of_calls.filter("problem = 'unknown tool'").select("call_id", F.lit(True).alias("unknown"))
    found = of_fields.dropna().join(unknown, "call_id", "left").filter("unknown is null").select("call_id", "problem").union(of_calls)
    return found.groupBy("call_id").agg(F.array_join(F.sort_array(F.collect_set("problem")), ",").alias("argument_problems"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call: call_id, thread, place (of the call; its result has the next one), name, n_results, problems, canonical."""
    each = _one_call_each(calls)
    outlined = stored(outlines(each))  # without the long texts, which move once more for the result alone
    whole = each.drop("after").join(_one_result_each(results), "call_id", "left")
    linked = whole.join(depths(outlined), "call_id", "left").join(problems(outlined, schemas), "call_id", "left")
    found = F.array_compact(
        F.array(
            F.col("argument_problems"),
            F.when(F.col("thread").isNull(), "cycle"),
            F.when(F.col("n_results").isNull(), "no result"),
            F.when(F.col("repeated"), "repeated call"),
            F.when(F.col("several"), "several results"),
            F.when(F.col("dangling"), "unknown predecessor"),
        )
    )
    arguments = F.try_parse_json("arguments")
    canonical = F.to_json(F.struct(arguments.alias("arguments"), "call_id", "name", "result"))
    return linked.select("call_id", "thread", (F.col("depth") * 2).alias("place"), "name", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.array_join(found, ",").alias("problems"), canonical.alias("canonical"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a system turn is a call of ``setup``, a user turn one of ``reply``, an
    assistant turn the result of the turn before. A call follows the one two turns earlier, turn 1 the one before it.

    The arguments are JSON as others write it, with white space and unsorted keys. By the length of the text some lack
    a field, have one too many or one of another type, or are cut off, so that the checks have something to find.
    """
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    rows = conversations.dropna(subset=["conv_id", "turn"])
    asked = rows.filter(F.col("role").isin("system", "user"))
    after = F.when(F.col("turn") > 1, name(F.col("turn") - 2)).when(F.col("turn") == 1, name(F.lit(0)))
    text = F.coalesce("text", F.lit(""))
    quoted = F.to_json(F.struct(text.alias("prompt")))
    kind = F.length(text) % 8
    turn = F.when(kind == 4, F.concat(F.lit('"'), "turn", F.lit('"'))).otherwise(F.col("turn").cast("string"))
    role = F.when(kind == 2, "").otherwise(F.concat(F.lit(',"role":  "'), "role", F.lit('" ')))
    extra = F.when(kind == 3, ', "extra":[ null,{} ]').otherwise("")
    whole = F.concat(F.lit('{ "turn" : '), turn, F.lit(" ,\n\t"), F.expr("substring(quoted, 2, length(quoted) - 2)"), role, extra, F.lit("}"))
    arguments = F.when(kind == 5, F.lit('{ "turn" : ')).otherwise(whole)
    calls = asked.withColumn("quoted", quoted).select(name("turn").alias("call_id"), after.alias("after"), F.when(F.col("role") == "user", "reply").otherwise("setup").alias("name"), arguments.alias("arguments"))
    results = rows.filter(F.col("role") == "assistant").select(name(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def conversation_schemas(spark: SparkSession) -> DataFrame:
    fields = [(n, f, t, True) for n in ("reply", "setup") for f, t in (("prompt", "string"), ("role", "string"), ("turn", "integer"))]
    values = ", ".join(f"('{n}', '{f}', '{t}', {str(r).lower()})" for n, f, t, r in fields)
    return spark.sql(f"select * from values {values} as s(name, field, type, required)")


def report(conversations: DataFrame) -> DataFrame:
    calls, results = from_conversations(conversations)
    return link(calls, results, conversation_schemas(conversations.sparkSession))


SQL = """
with recursive
t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
c as (
  select conv_id || ':' || turn as call_id,
         case when turn > 1 then conv_id || ':' || (turn - 2) when turn = 1 then conv_id || ':0' end as after,
         case when role = 'user' then 'reply' else 'setup' end as name, turn, role, text
  from t where role in ('system', 'user')
),
r as (select conv_id || ':' || (turn - 1) as call_id, min(text) as result, count(*) as n_results from t where role = 'assistant' group by 1),
d as (
  select call_id, call_id as thread, 0 as depth from c where after is null or after not in (select call_id from c)
  union all
  select c.call_id, d.thread, d.depth + 1 from c join d on c.after = d.call_id
)
select c.call_id, d.thread, cast(2 * d.depth as bigint) as place, c.name, cast(coalesce(r.n_results, 0) as bigint) as n_results,
  concat_ws(',', case length(c.text) % 8 when 2 then 'missing role' when 3 then 'unexpected extra' when 4 then 'type of turn' when 5 then 'arguments' end,
            case when r.call_id is null then 'no result' end,
            case when c.after is not null and c.after not in (select call_id from c) then 'unknown predecessor' end) as problems,
  '{' || concat_ws(',',
    case length(c.text) % 8
      when 2 then '"arguments":' || json_object('prompt', c.text, 'turn', c.turn)
      when 3 then '"arguments":' || json_object('extra', json('[null,{}]'), 'prompt', c.text, 'role', c.role, 'turn', c.turn)
      when 4 then '"arguments":' || json_object('prompt', c.text, 'role', c.role, 'turn', cast(c.turn as varchar))
      when 5 then null
      else '"arguments":' || json_object('prompt', c.text, 'role', c.role, 'turn', c.turn)
    end,
    '"call_id":' || to_json(c.call_id), '"name":' || to_json(c.name), '"result":' || to_json(r.result)) || '}' as canonical
from c join d using (call_id) left join r on c.call_id = r.call_id
"""
