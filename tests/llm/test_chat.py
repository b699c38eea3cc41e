import json

from setforge.llm import chat

CALLS = "call_id string, after string, name string, arguments string"
FIELDS = "name string, field string, type string, required boolean"


def linked(spark, calls, results, fields=(("f", "a", "integer", True), ("f", "b", "string", False))):
    out = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "call_id string, content string"), spark.createDataFrame(list(fields), FIELDS))
    return {r.call_id: r for r in out.collect()}


def test_order_validation_and_json(spark):
    r = linked(
        spark,
        [("c1", None, "f", '{"b":"x", "a": 1}'), ("c2", "c1", "f", '{"a":"no"}'), ("c3", "c2", "f", '{"z":1}'), ("c4", "gone", "g", "[1]"), ("c5", "c6", "f", '{"a":1}'), ("c6", "c5", "f", '{"a":1.5}'), ("c7", "c3", "f", "not json"), (None, None, "f", "{}")],
        [("c1", "ok"), ("c2", "b"), ("c2", "a"), ("c9", "orphan"), (None, "x")],
    )
    assert set(r) == {f"c{k}" for k in range(1, 8)}
    assert [(r[c].thread, r[c].place) for c in ("c1", "c2", "c3", "c7")] == [("c1", 0), ("c1", 2), ("c1", 4), ("c1", 6)]
    assert r["c1"].problems == "" and r["c1"].canonical == '{"arguments":{"a":1,"b":"x"},"call_id":"c1","name":"f","result":"ok"}'
    assert r["c2"].problems == "type of a,several results" and json.loads(r["c2"].canonical)["result"] == "a"
    assert r["c3"].problems == "missing a,unexpected z,no result"
    assert r["c4"].problems == "arguments,unknown tool,no result,unknown predecessor" and r["c4"].place == 0
    assert r["c5"].thread is None and "cycle" in r["c5"].problems and r["c6"].problems == "type of a,cycle,no result"
    assert r["c7"].problems == "arguments,no result" and "arguments" not in json.loads(r["c7"].canonical)


def test_long_chains_repeats_and_ties(spark):
    n = 300
    calls = [(f"k{k}", f"k{k - 1}" if k else None, "f", '{"a":1}') for k in range(n)]
    r = linked(spark, calls + calls[:5] + [("k7", None, "e", "{}")], [(f"k{k}", "") for k in range(n)])
    assert len(r) == n and r["k299"].place == r["k8"].place + 2 * 291 and "repeated call" in r["k7"].problems and r["k3"].problems == ""


def test_empty(spark):
    assert linked(spark, [], []) == {}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, call_id string")
    assert chat.report(empty).count() == 0


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "system", None, "x"), (1, 1, "user", "q", "x"), (1, 2, "assistant", None, "x"), (1, 3, "user", "", "x"), (None, 0, "user", "q", "x"), (2, None, "user", "q", "x"), (3, 0, None, "q", "x")]
    out = {r.call_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string")).collect()}
    assert {k: (v.place, v.problems) for k, v in out.items()} == {"1:0": (0, "no result"), "1:1": (2, ""), "1:3": (4, "no result")}


def test_foreign_json_clashing_columns_long_texts_and_ties(spark):
    """White space and key order go; extra columns don't matter; of several types for a field the first counts."""
    long = "x" * 300_000
    calls = [("1", None, "f", '{ "b" :\t"é\\n" ,\n "a": 1 }'), ("2", "1", "f", json.dumps({"a": 2, "b": long})), ("3", "2", "g", '{"t": 1}'), ("4", "3", "g", '{"t": "s"}')]
    extra = "call_id string, after string, name string, arguments string, thread string, depth int, result string, problems string, row string, v string"
    c = spark.createDataFrame([(*x, "t", 1, "r", "p", "w", "v") for x in calls], extra)
    r = spark.createDataFrame([("1", long, "n", 5), ("2", "b", "n", 5), ("2", "a", "n", 5), ("3", "", "n", 5), ("4", None, "n", 5)], "call_id string, content string, name string, n_results int")
    f = spark.createDataFrame([("f", "a", "integer", True, "x"), ("f", "b", "string", None, "x"), ("g", "t", "string", False, "x"), ("g", "t", "integer", None, "x")], "name string, field string, type string, required boolean, call_id string")
    got = {x.call_id: x for x in chat.link(c, r, f).collect()}
    assert json.loads(got["1"].canonical) == {"arguments": {"a": 1, "b": "é\n"}, "call_id": "1", "name": "f", "result": long}
    assert got["1"].canonical.startswith('{"arguments":{"a":1,"b":"é\\n"},"call_id"') and got["1"].problems == ""
    assert got["2"].problems == "several results" and json.loads(got["2"].canonical)["result"] == "a" and len(got["2"].canonical) > 300_000
    assert (got["3"].problems, got["4"].problems) == ("", "type of t")
    assert [got[k].place for k in "1234"] == [0, 2, 4, 6] and {x.thread for x in got.values()} == {"1"}


def test_long_chains_and_forks(spark):
    calls = [(str(k), str(k - 1) if k else None, "f", "{}") for k in range(70)] + [(f"b{k}", "30", "f", "{}") for k in range(40)] + [("c1", "c2", "f", "{}"), ("c2", "c1", "f", "{}"), ("c3", "c2", "f", "{}")]
    got = linked(spark, calls, [], fields=())
    assert [got[str(k)].place for k in range(70)] == [2 * k for k in range(70)] and {got[f"b{k}"].place for k in range(40)} == {62}
    assert all("cycle" in got[f"c{k}"].problems and got[f"c{k}"].thread is None for k in (1, 2, 3))
