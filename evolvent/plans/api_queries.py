"""Queries over the operators of API analysis, each over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.functions.refs import package_name, simple_name, target
from evolvent.functions.typealg import Scope, World, parse
from evolvent.model import BOXES, WIDENING
from evolvent.operators import incremental, mutations, report
from evolvent.operators.api_diff import ApiDiff
from evolvent.operators.api_model import KEY, ApiModel, has
from evolvent.operators.declarations import references
from evolvent.operators.library_diff import LibraryDiff
from evolvent.operators.snapshot_diff import snapshot_order
from evolvent.operators.type_hierarchy import type_ancestors
from evolvent.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def model(spark: SparkSession, d: str) -> ApiModel:
    return ApiModel(table(spark, d, "type_decl"), table(spark, d, "exec_decl"), table(spark, d, "field_decl"), table(spark, d, "api_snapshot"))


def diff(spark: SparkSession, d: str) -> ApiDiff:
    return ApiDiff(model(spark, d))


def libraries(spark: SparkSession, d: str) -> LibraryDiff:
    return LibraryDiff(table(spark, d, "type_decl"), table(spark, d, "exec_decl"), table(spark, d, "field_decl"), table(spark, d, "api_snapshot"))


# -- model and closures -------------------------------------------------------------------------------------------


@query
def snapshot_sequence(spark, d):
    """Delivered snapshots in the order of each library."""
    return snapshot_order(table(spark, d, "api_snapshot"))


@query
def type_state(spark, d):
    """The latest state of each type, with simple and package name and completed modifiers."""
    t = model(spark, d).types
    return t.select(*KEY, "fqn", "simple", "pkg", "kind", "visibility", F.array_join("modifiers", ",").alias("modifiers"), "enclosing")


@query
def reference_providers(spark, d):
    """Where each reference resolves: the library first, then what is known outside, else nowhere."""
    types = table(spark, d, "type_decl")
    refs = references(types)
    own = types.where("fqn IS NOT NULL").select("lib", "ver", F.col("fqn").alias("target")).distinct().withColumn("own", F.lit(True))
    known = table(spark, d, "known_type").where("fqn IS NOT NULL").groupBy(F.col("fqn").alias("target")).agg(F.min("origin").alias("origin"))
    j = refs.join(own, ["lib", "ver", "target"], "left").join(known, "target", "left")
    provider = F.when(F.col("own"), "library").otherwise(F.coalesce("origin", F.lit("unresolved")))
    return j.select("lib", "ver", "fqn", "ref_field", "target", provider.alias("provider"))


@query
def supertype_edges(spark, d):
    return model(spark, d).supertype_edges().select(*KEY, "fqn", "super_fqn").distinct()


@query
def direct_subtypes(spark, d):
    return model(spark, d).direct_subtypes()


@query
def ancestor_closure(spark, d):
    return model(spark, d).ancestors.select(*KEY, "fqn", "ancestor", "depth")


@query
def superclass_chain(spark, d):
    return model(spark, d).superclasses().select(*KEY, "fqn", "ancestor")


@query
def implemented_interfaces(spark, d):
    return model(spark, d).implemented_interfaces().select(*KEY, "fqn", "ancestor")


@query
def enclosing_chain(spark, d):
    return type_ancestors(table(spark, d, "type_decl")).where("link = 'enclosing'").select("lib", "ver", "ancestor", "descendant", "depth")


@query
def exported_types(spark, d):
    """The joint fixpoint of exported and subtypable."""
    return model(spark, d).props


@query
def checked_exceptions(spark, d):
    return model(spark, d).exceptions.where("checked OR unchecked")


@query
def method_erasure(spark, d):
    """Erasure and symbol of every executable."""
    return model(spark, d).executables.select(*KEY, "owner", "exec_kind", "erasure").distinct()


@query
def thrown_types(spark, d):
    return model(spark, d).executables.select(*KEY, "owner", "erasure", F.explode("thrown_types").alias("thrown")).distinct()


@query
def effective_fields(spark, d):
    return model(spark, d).effective_fields.select(*KEY, "fqn", "name", "owner")


@query
def effective_methods(spark, d):
    return model(spark, d).effective_methods.select(*KEY, "fqn", "erasure", "owner", "visibility", "return_ref")


@query
def methods_to_implement(spark, d):
    return model(spark, d).methods_to_implement().select(*KEY, "fqn", "erasure", "owner")


@query
def concrete_blockers(spark, d):
    return model(spark, d).blockers


@query
def exported_constructors(spark, d):
    return model(spark, d).exported_constructors().select(*KEY, "owner", "erasure", "visibility").distinct()


@query
def api_card(spark, d):
    return model(spark, d).api_card()


@query
def entity_counts(spark, d):
    """Types of each kind and members of each sort per library."""
    m = model(spark, d)
    t = m.types.groupBy("lib", F.col("kind").alias("entity"))
    x = m.executables.groupBy("lib", F.col("exec_kind").alias("entity"))
    return t.agg(F.count("*").alias("n")).unionByName(x.agg(F.count("*").alias("n")))


@query
def duplicate_types(spark, d):
    """Types that a snapshot holds in several rows."""
    t = table(spark, d, "type_decl").where("fqn IS NOT NULL").groupBy("lib", "ver", "fqn")
    return t.agg(F.count("*").alias("n_rows"), F.countDistinct("loaded_at").alias("n_states")).where("n_rows > 1")


@query
def module_cardinality(spark, d):
    """How many modules a snapshot names: none (unnamed), one, or an error."""
    s = table(spark, d, "api_snapshot").groupBy("lib", "ver").agg(F.countDistinct("module_name").alias("n"))
    return s.select("lib", "ver", "n", F.when(F.col("n") == 0, "unnamed").when(F.col("n") == 1, "named").otherwise("error").alias("state"))


@query
def primitive_assignability(spark, d):
    """Assignment between all primitive types and their boxes."""
    names = [*WIDENING, *BOXES.values()]
    w, s = World({}), Scope()
    rows = [(a, b, w.assignable(s, parse(a), parse(b))) for a in names for b in names]
    return spark.createDataFrame(rows, "source string, target string, assignable boolean")


@query
def annotated_types(spark, d):
    """Types that carry an annotation whose simple name is Beta, with any values."""
    t = model(spark, d).types
    beta = F.exists("annotations", lambda a: simple_name(a["fqn"]) == "Beta")
    return t.where(F.coalesce(beta, F.lit(False))).select(*KEY, "fqn")


@query
def excluded_types(spark, d):
    """Types annotated Beta and all that is nested in them, at any depth."""
    t = annotated_types(spark, d)
    inner = type_ancestors(table(spark, d, "type_decl")).where("link = 'enclosing'")
    nested = inner.join(t.withColumnRenamed("fqn", "ancestor"), ["lib", "ver", "ancestor"], "left_semi").select("lib", "ver", F.col("descendant").alias("fqn"))
    return t.unionByName(nested).distinct()


# -- matching and rules -------------------------------------------------------------------------------------------


@query
def type_match(spark, d):
    return diff(spark, d).type_match.select("lib", "ver", "fqn", "status")


@query
def type_removed(spark, d):
    return diff(spark, d).type_match.where("status = 'REMOVED'").select("lib", "ver", "fqn")


@query
def type_kind_changed(spark, d):
    return diff(spark, d).type_match.where("status = 'KIND_CHANGED'").select("lib", "ver", "fqn", F.col("o.kind").alias("old_kind"), F.col("n.kind").alias("new_kind"))


def _findings(spark, d, of: str, *kinds: str) -> DataFrame:
    """What the rules of one scope find, of some kinds."""
    found = getattr(diff(spark, d), of)()
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


@query
def type_flag_changes(spark, d):
    """Rules over visibility and modifiers of matched types."""
    kinds = ("TYPE_NOW_PROTECTED", "TYPE_NOW_SEALED", "CLASS_NOW_FINAL", "CLASS_NOW_STATIC", "CLASS_NO_LONGER_STATIC", "CLASS_NOW_ABSTRACT", "CLASS_NOW_CHECKED_EXCEPTION")
    return _findings(spark, d, "type_findings", *kinds).select("lib", "ver", F.col("impacted_type").alias("fqn"), "kind")


@query
def supertypes_removed(spark, d):
    """The nearest of the exported supertypes that a type lost."""
    return diff(spark, d).supertypes_removed()


@query
def field_match(spark, d):
    return diff(spark, d).field_match.select("lib", "ver", "fqn", "name", "status")


@query
def field_changes(spark, d):
    f = _findings(spark, d, "field_findings", "FIELD_NOW_PROTECTED", "FIELD_NOW_FINAL", "FIELD_NOW_STATIC", "FIELD_NO_LONGER_STATIC")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.substring_index("impacted_symbol", ".", -1).alias("name"), "kind")


@query
def constructor_match(spark, d):
    return diff(spark, d).constructor_match.select("lib", "ver", "fqn", "erasure", "status").distinct()


@query
def annotation_element_match(spark, d):
    m = diff(spark, d).annotation_method_match
    return m.select("lib", "ver", "fqn", "name", "status")


@query
def annotation_targets_removed(spark, d):
    f = _findings(spark, d, "_type_details", "ANNOTATION_TARGET_REMOVED")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.col("detail_old").alias("target")).distinct()


@query
def formal_parameter_counts(spark, d):
    """Formal type parameters that a type lost or gained at the end of its list."""
    f = libraries(spark, d).findings("type_parameters").where("kind IN ('FORMAL_TYPE_PARAMETER_REMOVED', 'FORMAL_TYPE_PARAMETER_ADDED')")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), "kind", F.coalesce("detail_old", "detail_new").alias("tp"))


@query
def method_match(spark, d):
    return libraries(spark, d).method_match()


def _told(found: DataFrame) -> DataFrame:
    return found.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.col("impacted_symbol").alias("symbol"), "kind").distinct()


@query
def method_changes(spark, d):
    """Methods removed, hidden, and changed in their modifiers."""
    return _told(libraries(spark, d).findings("methods"))


@query
def constructor_changes(spark, d):
    return _told(_findings(spark, d, "constructor_findings"))


@query
def annotation_element_changes(spark, d):
    return _told(_findings(spark, d, "annotation_method_findings"))


@query
def new_obligations(spark, d):
    """Abstract methods and annotation elements without default that clients must now implement or give."""
    f = libraries(spark, d).findings("added")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.col("new_symbol").alias("symbol"), "kind").distinct()


@query
def no_longer_extensible(spark, d):
    """Classes of which clients can write no concrete subclass any more, with the methods that keep them from it."""
    f = _findings(spark, d, "_type_details", "CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.col("detail_new").alias("blocker")).distinct()


@query
def thrown_changes(spark, d):
    """Checked exceptions that executables throw no longer, or throw now."""
    f = libraries(spark, d).findings("thrown")
    return f.select("lib", "ver", F.col("impacted_type").alias("fqn"), F.col("impacted_symbol").alias("symbol"), "kind", F.coalesce("detail_old", "detail_new").alias("exc")).distinct()


#: Kinds whose rules ask for generic subtyping, which SQL cannot state.
GENERIC_KINDS = (
    "FIELD_TYPE_ERASURE_CHANGED", "FIELD_TYPE_CHANGED_INCOMPATIBLE", "METHOD_RETURN_TYPE_ERASURE_CHANGED", "METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE",
    "EXECUTABLE_PARAMETER_GENERICS_CHANGED", "FORMAL_TYPE_PARAMETER_ADDED", "FORMAL_TYPE_PARAMETER_REMOVED", "FORMAL_TYPE_PARAMETER_CHANGED",
)


@query
def breaking_changes_plain(spark, d):
    """The findings of ``breaking_changes`` of all kinds whose rules need no generic subtyping, 30 of 38."""
    b = libraries(spark, d).breaking_changes().where(~F.col("kind").isin(*GENERIC_KINDS))
    return b.select("lib", "ver", "kind", "impacted_type", "impacted_symbol", "nature", "binary_breaking", "source_breaking").distinct()


@query
def breaking_changes(spark, d):
    """All rules over all pairs of consecutive snapshots."""
    return libraries(spark, d).breaking_changes().drop("kind_ordinal")


@query
def breaking_summary(spark, d):
    b = libraries(spark, d).breaking_changes()
    return b.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("lib").alias("n_libs"))


# -- reports ------------------------------------------------------------------------------------------------------


def _report(spark, d):
    return report.normal_report(table(spark, d, "bc_report"))


@query
def report_normal(spark, d):
    """Stored findings with one valid kind a row."""
    return _report(spark, d).select("bc_id", "report_id", "lib", "kind", "kind_ordinal", "nature", "binary_breaking", "source_breaking")


@query
def report_findings(spark, d):
    return report.distinct_findings(_report(spark, d))


@query
def report_by_type(spark, d):
    return report.by_type(_report(spark, d))


@query
def report_by_package(spark, d):
    return report.by_package(_report(spark, d))


@query
def report_by_member(spark, d):
    return report.by_member(_report(spark, d))


@query
def report_summary(spark, d):
    return report.summary(_report(spark, d))


@query
def report_rollup(spark, d):
    return report.rollup(_report(spark, d))


@query
def report_binary_only(spark, d):
    return _report(spark, d).where("binary_breaking").select("bc_id", "kind")


@query
def report_source_only(spark, d):
    return _report(spark, d).where("source_breaking").select("bc_id", "kind")


@query
def report_impacted_types(spark, d):
    return _report(spark, d).select("lib", "ver_new", "impacted_type", package_name(F.col("impacted_type")).alias("pkg")).distinct()


EXCLUDED_NAMES = [r".*\.internal\..*", r".*\.[A-Za-z]+Helper"]


@query
def report_without_names(spark, d):
    return report.exclude_by_name(_report(spark, d), EXCLUDED_NAMES).select("bc_id", "kind")


@query
def report_without_annotated(spark, d):
    return report.exclude_types(_report(spark, d), excluded_types(spark, d)).select("bc_id", "kind")


@query
def report_not_accepted(spark, d):
    """Findings that no earlier report of the library has: what was reported once is accepted."""
    r = _report(spark, d)
    keys = ["lib", "impacted_type", "impacted_symbol", "kind"]
    first = r.groupBy(*keys).agg(F.min("report_id").alias("first_id"))
    return r.join(first, keys).where("report_id = first_id").select("bc_id", "kind")


# -- incremental, mutations, metrics ------------------------------------------------------------------------------


@query
def changed_files(spark, d):
    old, new = incremental.snapshot_files(table(spark, d, "type_decl"), table(spark, d, "api_snapshot"))
    return incremental.changed_files(old, new, ["lib", "ver", "file"])


@query
def changed_since(spark, d):
    """Files of each snapshot by load time: in both snapshots and loaded after the older one was taken."""
    t = table(spark, d, "type_decl").where("file IS NOT NULL").groupBy("lib", "ver", "file").agg(F.max("loaded_at").alias("modified"))
    order = snapshot_order(table(spark, d, "api_snapshot"))
    taken = table(spark, d, "api_snapshot").where("state = 'DELIVERED'").groupBy("lib", "ver").agg(F.min("taken_at").alias("since"))
    f = t.join(order, ["lib", "ver"])
    old = f.where("next_ver IS NOT NULL").join(taken, ["lib", "ver"]).select("lib", F.col("next_ver").alias("ver"), "file", "since")
    new = f.where("seq > 1").select("lib", "ver", "file", "modified")
    j = old.withColumn("in_old", F.lit(True)).join(new.withColumn("in_new", F.lit(True)), ["lib", "ver", "file"], "full_outer")
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "created").when(F.col("modified") > F.col("since"), "updated")
    return j.select("lib", "ver", "file", status.alias("status")).where("status IS NOT NULL")


@query
def incremental_rebuild(spark, d):
    return _rebuilt_types(spark, d).select("lib", "ver", "fqn", "kind", "visibility")


def _declared(spark, d):
    return [table(spark, d, n) for n in ("type_decl", "exec_decl", "field_decl", "api_snapshot")]


def _rebuilt_types(spark, d):
    return incremental.rebuilt_types(*_declared(spark, d))


@query
def changed_declarations(spark, d):
    """Files of each snapshot that differ from the one before in anything their types and members declare."""
    return incremental.changed_files(*incremental.declaration_files(*_declared(spark, d)), ["lib", "ver", "file"])


@query
def rebuilt_types(spark, d):
    """The types of ``incremental_rebuild`` with all their columns."""
    return _rebuilt_types(spark, d)


@query
def rebuilt_methods(spark, d):
    return incremental.rebuilt_members(*_declared(spark, d))[0]


@query
def rebuilt_fields(spark, d):
    return incremental.rebuilt_members(*_declared(spark, d))[1]


@query
def strategy_outcomes(spark, d):
    return mutations.strategy_outcomes(mutations.mutation_space(table(spark, d, "type_decl"), table(spark, d, "exec_decl"), table(spark, d, "field_decl")))


@query
def strategy_uniform(spark, d):
    """Possible changes by the pattern of their long names."""
    space = mutations.mutation_space(table(spark, d, "type_decl"), table(spark, d, "exec_decl"), table(spark, d, "field_decl")).where("outcome = 'ok'")
    named = space.select(mutations.long_name(F.col("strategy"), F.col("symbol")).alias("name"))
    return named.withColumn("pattern", mutations.uniform_name(F.col("name"))).groupBy("pattern").agg(F.count("*").alias("n"))


@query
def tool_metrics(spark, d):
    """How well the stored binary flags agree with what each kind breaks, by nature."""
    raw = table(spark, d, "bc_report").groupBy("bc_id").agg(F.max(F.struct("found_at", F.coalesce("binary_breaking", F.lit(False)).alias("said"))).alias("m"))
    r = _report(spark, d).join(raw.select("bc_id", "m.said"), "bc_id")
    return mutations.confusion(r, "nature", "binary_breaking", "said")


@query
def change_themes(spark, d):
    r = _report(spark, d).withColumn("theme", mutations.uniform_theme(F.col("kind")))
    return r.groupBy("theme").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("n_kinds"))


@query
def mutation_benchmark(spark, d):
    """Every possible atomic change of the generated API, made and compared: cases of each change and how many are found."""
    cases, types, execs, fields = mutations.mutated_libraries(*mutations.small_api(spark))
    snaps = cases.select(F.col("case").alias("lib"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("ver"))
    snaps = snaps.select("lib", "ver", F.timestamp_seconds(F.col("ver").cast("int")).alias("taken_at"), F.lit("DELIVERED").alias("state"))
    found = ApiDiff(ApiModel(types, execs, fields, snaps)).breaking_changes
    hits = found.groupBy(F.col("lib").alias("case")).agg(F.bool_or("binary_breaking").alias("binary"), F.bool_or("source_breaking").alias("source"))
    return cases.join(hits, "case", "left").groupBy("symbol_kind", "strategy").agg(
        F.count("*").alias("n_cases"), F.count_if(F.coalesce("binary", F.lit(False))).alias("n_binary"), F.count_if(F.coalesce("source", F.lit(False))).alias("n_source")
    )
