"""Supertype closure and visibility fixpoint by rounds of distributed joins, for snapshots too large for one task.

The results equal those of the in-task forms in :mod:`api_model`; each round writes its frontier, so that the plan of
the next one starts from a table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolvent.functions.typealg import instantiation, parse, render, substitute
from evolvent.model import PLATFORM
from evolvent.session import Stages

KEY = ["lib", "ver"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def step_args(text: pd.Series, names: pd.Series, args: pd.Series) -> pd.Series:
    """Arguments in a supertype's text, with the declaring type's variables replaced by the arguments given to it."""

    def one(t, ns, given):
        if t is None:
            return None
        ns = list(ns) if ns is not None else []
        r = parse(str(t), frozenset(ns))
        if given is not None:
            r = substitute(r, instantiation(ns, [parse(str(a)) for a in given]))
        return [render(a) for a in r[2]] if r[0] == "C" and r[2] else None

    return pd.Series([one(*x) for x in zip(text, names, args)])


def ancestor_rounds(stages: Stages, types: DataFrame) -> DataFrame:
    """``lib, ver, fqn, ancestor, depth, in_library, args`` of the given types, breadth first.

    ``args`` are those of the nearest path, of equally near ones of the first in the order of declaration: each path
    brings the places of its steps in their declarations, and the least of them counts.
    """
    spark = types.sparkSession
    tp_names = F.transform("tps", lambda t: t["name"])
    own = types.select(*KEY, F.col("fqn").alias("ancestor"), tp_names.alias("names"), F.posexplode("supers").alias("ord", "s"))
    own = own.select(*KEY, "ancestor", "names", "ord", F.col("s.target").alias("up"), F.col("s.text").alias("text"))
    pairs = [(t, s.split("<")[0]) for t, v in PLATFORM.items() for s in v[2]]
    outside = F.broadcast(spark.createDataFrame(pairs, "ancestor string, up string"))  # the platform's fixed table
    declared = types.select(*KEY, F.col("fqn").alias("ancestor"))
    none = F.lit(None).cast("array<string>")

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY, "fqn", "ancestor").agg(F.min(F.struct("path", "args")).alias("m")).select(*KEY, "fqn", "ancestor", "m.*")

    here = F.array(F.col("ord"))
    front = own.select(*KEY, F.col("ancestor").alias("fqn"), F.col("up").alias("ancestor"), here.alias("path"), step_args("text", "names", none).alias("args"))
    front = stages.put(nearest(front), "front")
    seen, out, depth = front.select(*KEY, "fqn", "ancestor"), [], 1
    while not front.isEmpty():
        out.append(front.drop("path").withColumn("depth", F.lit(depth)))
        depth += 1
        longer = F.concat("path", here).alias("path")
        inside = front.join(own, [*KEY, "ancestor"]).select(*KEY, "fqn", F.col("up").alias("ancestor"), longer, step_args("text", "names", F.coalesce("args", F.array().cast("array<string>"))).alias("args"))
        leaves = front.join(declared, [*KEY, "ancestor"], "left_anti").join(outside, "ancestor").select(*KEY, "fqn", F.col("up").alias("ancestor"), "path", none.alias("args"))
        nxt = nearest(inside.unionByName(leaves).where("fqn <> ancestor"))
        front = stages.put(nxt.join(seen, [*KEY, "fqn", "ancestor"], "left_anti"), "front")
        seen = stages.put(seen.unionByName(front.select(*KEY, "fqn", "ancestor")), "seen")
    every = out[0] if out else front.withColumn("depth", F.lit(1))
    for x in out[1:]:
        every = every.unionByName(x)
    generic = types.where("size(tps) > 0").select(*KEY, F.col("fqn").alias("ancestor"), F.lit(True).alias("generic"))
    j = every.join(declared.withColumn("here", F.lit(True)), [*KEY, "ancestor"], "left").join(generic, [*KEY, "ancestor"], "left")
    return j.select(*KEY, "fqn", "ancestor", "depth", F.coalesce("here", F.lit(False)).alias("in_library"), F.when(F.col("generic"), F.col("args")).alias("args"))


def visibility_rounds(stages: Stages, nodes: DataFrame, supers: DataFrame) -> DataFrame:
    """``lib, ver, fqn, exported, direct_subtypable, subtypable`` of ``nodes``.

    ``nodes`` are ``lib, ver, fqn, enclosing, visibility, open, package_ok``, ``supers`` are ``lib, ver, fqn, super_fqn``.
    Facts only ever become true, so the rounds end when their number stands still.
    """
    known = nodes.select(*KEY, F.col("fqn").alias("enclosing"), F.lit(True).alias("inner"))
    base = stages.put(nodes.join(known, [*KEY, "enclosing"], "left"), "nodes")
    no = F.lit(False)
    state = stages.put(base.select(*KEY, "fqn", no.alias("exported"), no.alias("subtypable")), "state")
    count = -1
    while True:
        now = state.agg(F.count_if("exported") + F.count_if("subtypable")).first()[0]
        if now == count:
            break
        count = now
        around = state.select(*KEY, F.col("fqn").alias("enclosing"), F.col("exported").alias("e_exported"), F.col("subtypable").alias("e_subtypable"))
        below = supers.join(state.where("subtypable").select(*KEY, "fqn"), [*KEY, "fqn"], "left_semi")
        below = below.select(*KEY, F.col("super_fqn").alias("fqn")).distinct().withColumn("below", F.lit(True))
        x = base.join(around, [*KEY, "enclosing"], "left").join(below, [*KEY, "fqn"], "left").join(state.select(*KEY, "fqn", "subtypable"), [*KEY, "fqn"])
        top = F.col("inner").isNull()
        exported = (
            F.col("package_ok")
            & (top | F.coalesce("e_exported", no))
            & ((F.col("visibility") == "PUBLIC") | ((F.col("visibility") == "PROTECTED") & (top | F.coalesce("e_subtypable", no))))
        )
        x = x.withColumn("exported", F.coalesce(exported, no))
        subtypable = F.col("subtypable") | (F.col("open") & F.col("exported")) | F.coalesce("below", no)
        state = stages.put(x.select(*KEY, "fqn", "exported", subtypable.alias("subtypable")), "state")
    return base.select(*KEY, "fqn", "open").join(state, [*KEY, "fqn"]).select(*KEY, "fqn", "exported", (F.col("open") & F.col("exported")).alias("direct_subtypable"), "subtypable")
