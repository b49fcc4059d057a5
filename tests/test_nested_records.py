import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evolvent.operators import nested_records as N

SCHEMA = "rec_id bigint, written_at timestamp, payload string, pre string"
T0 = dt.datetime(2020, 1, 1)
B = lambda q: {"refKind": "TypeReference", "qualifiedName": q}
TREE = {
    "library": {},
    "allTypes": [
        None,
        {
            "nestedTypes": {"typeKind": "EnumDecl", "formalTypeParameters": {"name": "E", "bounds": B("n.N")}},
            "methods": [None, {"formalTypeParameters": [None, {"name": "M", "bounds": [None, "x.Y<Z>", B("q.Q")]}]}],
            "typeKind": "ClassDecl",
            "formalTypeParameters": [{"name": "T", "bounds": [B("a.A")]}, {"name": "U"}, {"name": "V", "bounds": None}],
        },
        {"typeKind": None, "formalTypeParameters": [{"bounds": "plain"}], "methods": None},
    ],
}
EXPECT = [
    (1, "1", "ClassDecl", -1, 0, 0, "a.A"),
    (1, "1", "ClassDecl", 1, 1, 1, "x.Y"),
    (1, "1", "ClassDecl", 1, 1, 2, "q.Q"),
    (1, "1.0", "EnumDecl", -1, 0, 0, "n.N"),
    (1, "2", "", -1, 0, 0, "plain"),
]


def found(spark, rows):
    return sorted(map(tuple, N.bounds_of_parameters(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_bounds_with_positions(spark):
    assert found(spark, [(1, T0, json.dumps(TREE), "x")]) == EXPECT


def test_json_in_string_repeats_and_older_rows(spark):
    rows = [(1, T0, json.dumps(json.dumps(TREE)), "x")] * 3 + [(1, T0 - dt.timedelta(days=1), json.dumps({"allTypes": TREE["allTypes"][2]}), "y")]
    assert found(spark, rows) == EXPECT


def test_unreadable_payloads_give_nothing(spark):
    bad = [None, "", " ", "null", "[]", "17", '"x"', "<html>", json.dumps(TREE)[:200], '{"allTypes": "x"}', '{"allTypes": [[1]]}', "{}"]
    assert found(spark, [(i, T0, p, None) for i, p in enumerate(bad)]) == []
    assert found(spark, []) == []


def test_depth_is_not_bounded_by_recursion(spark):
    deep = {"formalTypeParameters": {"bounds": "d"}}
    for _ in range(2000):
        deep = {"nestedTypes": [deep]}
    nodes = list(N.walk({"allTypes": [deep]}))
    assert max(n[2] for n in nodes) == 2003
    assert len({n[0] for n in nodes} | {n[1] for n in nodes}) == 2 * len(nodes)


def test_flat_tables_link_by_containment(spark):
    nodes = N.node_table(spark.createDataFrame([(1, T0, json.dumps(TREE), "x")], SCHEMA))
    tps = N.flat_table(nodes, "tp")
    linked = N.containers(tps, N.flat_table(nodes, "type"))
    assert sorted(r["name"] or "" for r in linked.collect()) == ["", "E", "T", "U", "V"]
    assert N.containers(N.flat_table(nodes, "bound"), tps).count() == 5


def test_lone_surrogates(spark):
    t = {"allTypes": [{"typeKind": "\ud800", "formalTypeParameters": [{"bounds": ["b\udfff"]}]}]}
    assert found(spark, [(1, T0, json.dumps(t), None)]) == [(1, "0", "?", -1, 0, 0, "b?")]


def test_any_depth_and_any_number_of_wraps(spark):
    """10 000 levels of nested types, deep values in names, and JSON in 12 JSON strings."""
    deep = '{"typeKind":"C","qualifiedName":"a","nestedTypes":[' * 10_000 + "]}" * 10_000
    name = "[" * 20_000 + "]" * 20_000
    wrapped = '{"allTypes":{"qualifiedName":"w"}}'
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    rows = [(1, '{"allTypes":[' + deep + "]}", T0), (2, '{"allTypes":{"qualifiedName":' + name + "}}", T0), (3, wrapped, T0), (4, '{"allTypes":[' + deep, T0)]
    n = N.node_table(spark.createDataFrame(rows, "rec_id bigint, payload string, written_at timestamp"), ("type",))
    got = {r["rec_id"]: (r["n"], r["l"]) for r in n.groupBy("rec_id").agg(F.count("*").alias("n"), F.max("level").alias("l")).collect()}
    assert got == {1: (10_000, 10_000), 2: (1, 1), 3: (1, 1)}
    assert n.where("rec_id = 2").first()["name"] == name


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n", {}, []], "b": {"c": [[[]]]}}', " [] ", '"s"', "12", "[1,]", "{,}", '{"a" 1}', '{"a":1,}', "[1 2]", "", "nul", "[1]]", '{"a":"\\ud800"}', "[01]", "NaN"])
def test_the_reader_of_any_depth_reads_what_json_does(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            N.read_json(text)
    else:
        assert repr(N.read_json(text)) == repr(want)
