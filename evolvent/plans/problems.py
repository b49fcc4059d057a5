"""The pN queries of the core: each runs its operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.operators.nested_records import bounds_of_parameters, containers, flat_table, nested_types, node_table, type_parameters
from evolvent.operators.orphans import orphan_references, orphan_report
from evolvent.operators.snapshot_diff import changed_values, field_fingerprint, method_fingerprint, snapshot_changes
from evolvent.operators.type_hierarchy import type_ancestors, type_places
from evolvent.session import Stages
from evolvent.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    changes = snapshot_changes(t("api_snapshot"), t("type_decl"), t("exec_decl"), t("field_decl"))
    return changes.select("lib", "ver", "fqn", "change")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The members in which changed types differ, fetched for these types only: the side that has each, and its name."""
    t = lambda n: table(spark, d, n)
    changes = Stages(spark, "changes").put(snapshot_changes(t("api_snapshot"), t("type_decl"), t("exec_decl"), t("field_decl")), "found")
    methods = t("exec_decl").where("exec_kind IS NULL OR exec_kind <> 'CONSTRUCTOR'")
    parts = [
        changed_values(changes, t("api_snapshot"), m, "owner", h, F.concat(F.lit(f"{sort}:"), F.coalesce("name", F.lit("~"))))
        for m, h, sort in ((methods, method_fingerprint(), "m"), (t("field_decl"), field_fingerprint(), "f"))
    ]
    return parts[0].unionByName(parts[1]).select("lib", "ver", "fqn", "side", F.col("value").alias("member"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "type_decl"), table(spark, d, "known_type"), table(spark, d, "api_snapshot"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where("level = 0").select("lib", "ver", "fqn", "ref_field", "target", "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), table(spark, d, "api_snapshot"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return type_ancestors(table(spark, d, "type_decl"))


def p4_trees(spark: SparkSession, d: str) -> DataFrame:
    return type_places(table(spark, d, "type_decl"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return bounds_of_parameters(table(spark, d, "api_json"))


def p5_methods(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of methods, each tied to its type's row."""
    nodes = Stages(spark, "nested").put(node_table(table(spark, d, "api_json"), ("type", "method")), "nodes")
    types = flat_table(nodes, "type")
    rows = containers(flat_table(nodes, "method"), types)
    tied = rows.join(types.select("rec_id", F.col("pre").alias("outer_pre"), "type_path", "type_kind"), ["rec_id", "outer_pre"])
    return tied.select("rec_id", "type_path", "type_kind", "method_no", "qualified_name", "pre", "post", "parent_pre")


def p5_types(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of types, each tied to the type around it."""
    return nested_types(table(spark, d, "api_json"))


def p5_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of formal type parameters, each tied to its type and method."""
    return type_parameters(table(spark, d, "api_json"))


def p4_loops(spark: SparkSession, d: str) -> DataFrame:
    """The types that reach themselves, with the length of the shortest loop of each."""
    return type_ancestors(table(spark, d, "type_decl")).where("ancestor = descendant").select("lib", "ver", "link", F.col("ancestor").alias("fqn"), F.col("depth").alias("length"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_values": p2_values,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_trees": p4_trees,
    "p4_loops": p4_loops,
    "p5_found": p5_found,
    "p5_types": p5_types,
    "p5_parameters": p5_parameters,
    "p5_methods": p5_methods,
}
