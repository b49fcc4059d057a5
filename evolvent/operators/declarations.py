"""Rows of declaration tables in their latest state, and the references they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.functions.refs import target

#: The columns of a type that name other types.
REF_FIELDS = ("super_ref", "interface_refs", "enclosing")


def latest_types(types: DataFrame, *values: str) -> DataFrame:
    """One row for each (lib, ver, fqn): of its rows the one with the greatest ``loaded_at``.

    Rows with a null key column are no types. Rows of equal ``loaded_at`` are told apart by their values, so that the
    choice is the same in every run; a null ``loaded_at`` is older than any other.
    """
    best = F.max(F.struct("loaded_at", *values)).alias("b")
    ok = types.where("lib IS NOT NULL AND ver IS NOT NULL AND fqn IS NOT NULL")
    return ok.groupBy("lib", "ver", "fqn").agg(best).select("lib", "ver", "fqn", *[F.col(f"b.{v}").alias(v) for v in values])


def references(types: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``lib, ver, fqn, ref_field, target``: each distinct non-blank reference of the latest state of each type.

    With ``keep_empty`` a type without references has one row, of null ``ref_field`` and ``target``.
    """
    t = latest_types(types, *REF_FIELDS)
    each = F.flatten(
        F.array(
            F.array(F.struct(F.lit("super_ref").alias("ref_field"), F.col("super_ref").alias("ref"))),
            F.transform(
                F.coalesce("interface_refs", F.array().cast("array<string>")),
                lambda r: F.struct(F.lit("interface_refs").alias("ref_field"), r.alias("ref")),
            ),
            F.array(F.struct(F.lit("enclosing").alias("ref_field"), F.col("enclosing").alias("ref"))),
        )
    )
    named = F.array_distinct(
        F.filter(
            F.transform(each, lambda x: F.struct(x["ref_field"].alias("ref_field"), target(x["ref"]).alias("target"))),
            lambda x: x["target"].isNotNull(),
        )
    )
    return t.select("lib", "ver", "fqn", (F.explode_outer if keep_empty else F.explode)(named).alias("r")).select("lib", "ver", "fqn", "r.ref_field", "r.target")
