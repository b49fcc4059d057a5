import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from evolvent.llm.term_frequency import term_frequency

SCHEMA = "bc_id bigint, report_id bigint, kind string, found_at timestamp, term string, n bigint, g bigint, u string"
T0 = dt.datetime(2020, 1, 1)


def rows(*r):
    return [(i, g, k, T0 + dt.timedelta(days=d), "clash", 1, 2, "z") for i, g, k, d in r]


def run(spark, data, **kw):
    df = term_frequency(spark.createDataFrame(data, SCHEMA), "bc_id", "report_id", "kind", "found_at", **kw)
    return {r["term"]: (r["n_occurrences"], r["n_groups"], r["mark"]) for r in df.collect()}


def test_terms_repeats_and_marks(spark):
    data = rows(
        (1, 1, "Type-removed", 0), (1, 1, "Type-removed", 5), (2, 1, " type  removed ;FIELD.removed", 0), (3, 2, "[TYPE_REMOVED]|type removed", 0),
        (4, 3, "type_removed", 0), (5, 4, None, 0), (6, 5, "", 0), (7, 4, " ; ,|--", 0), (8, None, "odd", 0), (9, 3, "old", 0), (9, 3, "new", 1),
    )
    assert run(spark, data) == {
        "TYPE_REMOVED": (5, 3, "common"), "FIELD_REMOVED": (1, 1, "rare"), "ODD": (1, 0, "rare"), "NEW": (1, 1, "rare"),
    }


def test_empty(spark):
    assert run(spark, []) == {}


def test_rows_without_id_are_told_apart_by_value(spark):
    assert run(spark, rows((None, 1, "a", 0), (None, 1, "a", 1), (None, 2, "a", 0), (None, 2, "b", 0)))["A"] == (2, 2, "rare")


@pytest.mark.parametrize("kw", [{}, {"spill_rows": 5, "hold_rows": 3}, {"spill_rows": 1, "hold_rows": 1}])
def test_against_counter_when_spilling_and_with_a_hot_term(spark, kw):
    r = random.Random(1)
    data = [(i, r.randrange(40), "HOT" if r.random() < 0.4 else f"t{r.randrange(60)};x,HOT", 0) for i in range(600)]
    n, groups = Counter(), defaultdict(set)
    for _, g, k, _ in data:
        for t in k.replace(";", ",").upper().split(","):
            n[t] += 1
            groups[t].add(g)
    got = run(spark, rows(*data), **kw)
    assert {t: x[:2] for t, x in got.items()} == {t: (n[t], len(groups[t])) for t in n}


def test_object_stores_by_their_hadoop_names(monkeypatch):
    """A task that does not spill never opens the shared folder; one that does maps the store's name."""
    import pyarrow as pa

    import evolvent.llm.term_frequency as TF

    asked = []
    rows = pa.RecordBatch.from_pydict({"th": pa.array([1, 1, 2], pa.int64()), "term": ["a", "a", "b"], "n": pa.array([1, 2, 3], pa.int64()), "g": pa.array([1, 1, 1], pa.int64())})
    got = {r["term"]: (r["n"], r["g"]) for b in TF._task(iter([rows]), "s3a://nowhere/x", 10, 10) for r in b.to_pylist()}
    assert got == {"a": (3, 2), "b": (3, 1)}
    monkeypatch.setattr(TF, "pyarrow", type("P", (), {"fs": type("F", (), {"FileSystem": type("S", (), {"from_uri": staticmethod(lambda u: asked.append(u))})})}))
    for uri in ("s3a://b/x", "wasbs://c@a/x", "hdfs://n/x", "file:///x", "/x"):
        TF.shared_filesystem(uri)
    assert asked == ["s3://b/x", "abfss://c@a/x", "hdfs://n/x", "file:///x", "/x"]
