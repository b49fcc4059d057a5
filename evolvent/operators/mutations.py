"""Atomic changes of an API: which apply to which symbol, what they give, and how tools score on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.functions.refs import target
from evolvent.model import EXEC_SCHEMA, FIELD_SCHEMA, TYPE_SCHEMA

# Fixed values: (symbol, atomic change, SQL condition under which the change is possible).
STRATEGIES: list[tuple[str, str, str]] = [
    ("type", "RemoveType", "true"),
    ("type", "ReduceVisibilityType", "visibility <> 'PACKAGE_PRIVATE'"),
    ("type", "AddModifierAbstractType", "NOT array_contains(modifiers, 'ABSTRACT') AND NOT array_contains(modifiers, 'FINAL')"),
    ("type", "AddModifierFinalType", "NOT array_contains(modifiers, 'FINAL') AND NOT array_contains(modifiers, 'ABSTRACT')"),
    ("type", "RemoveModifierFinalType", "array_contains(modifiers, 'FINAL')"),
    ("type", "RemoveModifierAbstractType", "array_contains(modifiers, 'ABSTRACT')"),
    ("type", "AddAbstractMethodType", "kind IN ('CLASS', 'INTERFACE')"),
    ("type", "AddImplementedInterfaceType", "kind <> 'ANNOTATION'"),
    ("type", "RemoveImplementedInterfaceType", "size(interface_refs) > 0"),
    ("type", "AddSuperClassClass", "kind = 'CLASS' AND super_name = 'java.lang.Object'"),
    ("type", "RemoveSuperClassClass", "kind = 'CLASS' AND super_name <> 'java.lang.Object'"),
    ("type", "AddRecordComponent", "kind = 'RECORD'"),
    ("type", "ChangeRecordComponent", "kind = 'RECORD'"),
    ("type", "RemoveRecordComponent", "kind = 'RECORD'"),
    ("constructor", "RemoveConstructor", "true"),
    ("constructor", "ChangeVisibilityConstructor", "visibility <> 'PACKAGE_PRIVATE'"),
    ("constructor", "AddParameterConstructor", "true"),
    ("constructor", "ChangeParameterConstructor", "size(params) > 0"),
    ("constructor", "RemoveParameterConstructor", "size(params) > 0"),
    ("constructor", "AddExceptionConstructor", "true"),
    ("constructor", "RemoveExceptionConstructor", "size(thrown) > 0"),
    ("method", "RemoveMethod", "true"),
    ("method", "ChangeVisibilityMethod", "visibility <> 'PACKAGE_PRIVATE'"),
    ("method", "AddModifierFinalMethod", "NOT array_contains(modifiers, 'FINAL') AND NOT array_contains(modifiers, 'ABSTRACT')"),
    ("method", "AddModifierStaticMethod", "NOT array_contains(modifiers, 'STATIC') AND NOT array_contains(modifiers, 'ABSTRACT')"),
    ("method", "RemoveModifierFinalMethod", "array_contains(modifiers, 'FINAL')"),
    ("method", "RemoveModifierStaticMethod", "array_contains(modifiers, 'STATIC')"),
    ("method", "ChangeTypeMethod", "return_ref <> 'java.lang.Thread'"),
    ("method", "AddParameterMethod", "true"),
    ("method", "ChangeParameterMethod", "size(params) > 0"),
    ("method", "RemoveParameterMethod", "size(params) > 0"),
    ("method", "AddExceptionMethod", "true"),
    ("method", "RemoveExceptionMethod", "size(thrown) > 0"),
    ("field", "RemoveField", "true"),
    ("field", "ChangeVisibilityField", "visibility <> 'PACKAGE_PRIVATE'"),
    ("field", "AddModifierFinalField", "NOT array_contains(modifiers, 'FINAL') AND NOT array_contains(modifiers, 'VOLATILE')"),
    ("field", "AddModifierStaticField", "NOT array_contains(modifiers, 'STATIC')"),
    ("field", "RemoveModifierFinalField", "array_contains(modifiers, 'FINAL')"),
    ("field", "RemoveModifierStaticField", "array_contains(modifiers, 'STATIC')"),
    ("field", "ChangeTypeField", "type_ref <> 'java.lang.Thread'"),
    ("field", "RemoveEnumValue", "of_enum AND type_ref = owner AND array_contains(modifiers, 'STATIC') AND array_contains(modifiers, 'FINAL')"),
]

# The long name of each change of a symbol; {0} is the symbol, {1} what declares it. "Thread" and the like are what the change brings.
LONG_NAMES: dict[str, str] = {
    "RemoveType": "RemoveType{0}",
    "ReduceVisibilityType": "Reduce{0}VisibilityToPackagePrivate",
    "AddModifierAbstractType": "AddAbstractModifierTo{0}",
    "AddModifierFinalType": "AddFinalModifierTo{0}",
    "RemoveModifierFinalType": "RemoveFinalModifierIn{0}",
    "RemoveModifierAbstractType": "RemoveAbstractModifierIn{0}",
    "AddAbstractMethodType": "AddMethodToType{0}",
    "AddImplementedInterfaceType": "AddImplementedInterfaceToType{0}",
    "RemoveImplementedInterfaceType": "RemoveImplementedInterfaceRunnableFromType{0}",
    "AddSuperClassClass": "AddSuperClassToClass{0}",
    "RemoveSuperClassClass": "RemoveSuperClassFromClass{0}",
    "AddRecordComponent": "AddRecordComponentIntToRecord{0}",
    "ChangeRecordComponent": "ChangeRecordComponentP0ToThreadFromRecord{0}",
    "RemoveRecordComponent": "RemoveRecordComponentP0FromRecord{0}",
    "RemoveConstructor": "RemoveConstructor{0}In{1}",
    "ChangeVisibilityConstructor": "ReduceConstructor{0}In{1}VisibilityToPackagePrivate",
    "AddParameterConstructor": "AddParameterIntToConstructor{0}In{1}",
    "ChangeParameterConstructor": "ChangeParameterP0ToThreadFromConstructor{0}In{1}",
    "RemoveParameterConstructor": "RemoveParameterP0FromConstructor{0}In{1}",
    "AddExceptionConstructor": "AddExceptionInterruptedExceptionToConstructor{0}In{1}",
    "RemoveExceptionConstructor": "RemoveExceptionFirstFromConstructor{0}In{1}",
    "RemoveMethod": "RemoveMethod{0}In{1}",
    "ChangeVisibilityMethod": "ReduceMethod{0}In{1}VisibilityToPackagePrivate",
    "AddModifierFinalMethod": "AddModifierFinalToMethod{0}In{1}",
    "AddModifierStaticMethod": "AddModifierStaticToMethod{0}In{1}",
    "RemoveModifierFinalMethod": "RemoveModifierFinalToMethod{0}In{1}",
    "RemoveModifierStaticMethod": "RemoveModifierStaticToMethod{0}In{1}",
    "ChangeTypeMethod": "ChangeMethod{0}In{1}TypeToThread",
    "AddParameterMethod": "AddParameterIntToMethod{0}In{1}",
    "ChangeParameterMethod": "ChangeParameterP0ToThreadFromMethod{0}In{1}",
    "RemoveParameterMethod": "RemoveParameterP0FromMethod{0}In{1}",
    "AddExceptionMethod": "AddExceptionInterruptedExceptionToMethod{0}In{1}",
    "RemoveExceptionMethod": "RemoveExceptionFirstFromMethod{0}In{1}",
    "RemoveField": "RemoveField{0}In{1}",
    "ChangeVisibilityField": "ReduceField{0}In{1}VisibilityToPackagePrivate",
    "AddModifierFinalField": "AddModifierFinalToField{0}In{1}",
    "AddModifierStaticField": "AddModifierStaticToField{0}In{1}",
    "RemoveModifierFinalField": "RemoveModifierFinalToField{0}In{1}",
    "RemoveModifierStaticField": "RemoveModifierStaticToField{0}In{1}",
    "ChangeTypeField": "ChangeField{0}In{1}TypeToThread",
    "RemoveEnumValue": "RemoveEnumValue{0}In{1}",
}

# Patterns of long names; the first that a name matches is its uniform name.
PATTERNS: list[str] = [
    "^Add.+ModifierTo.+$",
    "^AddException.+ToConstructor.+In.+$",
    "^AddException.+ToMethod.+In.+$",
    "^AddImplementedInterfaceToType.+$",
    "^AddMethodToType.+$",
    "^AddModifier.+ToField.+In.+$",
    "^AddModifier.+ToMethod.+In.+$",
    "^AddParameter.+ToConstructor.+In.+$",
    "^AddParameter.+ToMethod.+In.+$",
    "^AddRecordComponent.+ToRecord.+$",
    "^AddSuperClassToClass.+$",
    "^ChangeField.+In.+TypeTo.+$",
    "^ChangeMethod.+In.+TypeTo.+$",
    "^ChangeParameter.+To.+FromConstructor.+In.+$",
    "^ChangeParameter.+To.+FromMethod.+In.+$",
    "^ChangeRecordComponent.+To.+FromRecord.+$",
    "^ReduceConstructor.+In.+VisibilityTo.+$",
    "^ReduceField.+In.+VisibilityTo.+$",
    "^ReduceMethod.+In.+VisibilityTo.+$",
    "^Reduce.+VisibilityTo.+$",
    "^Remove.+ModifierIn.+$",
    "^RemoveConstructor.+In.+$",
    "^RemoveEnumValue.+In.+$",
    "^RemoveException.+FromConstructor.+In.+$",
    "^RemoveException.+FromMethod.+In.+$",
    "^RemoveField.+In.+$",
    "^RemoveImplementedInterface.+FromType.+$",
    "^RemoveMethod.+In.+$",
    "^RemoveModifier.+ToField.+In.+$",
    "^RemoveModifier.+ToMethod.+In.+$",
    "^RemoveParameter.+FromConstructor.+In.+$",
    "^RemoveParameter.+FromMethod.+In.+$",
    "^RemoveRecordComponent.+FromRecord.+$",
    "^RemoveSuperClassFromClass.+$",
    "^RemoveType.+$",
]


def long_name(strategy, symbol):
    """The name of a change of one symbol: letters and digits of the symbol and of what declares it."""
    bare = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    name = F.regexp_replace(symbol, r"\(.*$", "")
    own, owner = bare(F.substring_index(name, ".", -1)), bare(F.regexp_replace(name, r"\.[^.]*$", ""))
    parts = {}
    for s, text in LONG_NAMES.items():
        head, _, rest = text.partition("{0}")
        mid, _, tail = rest.partition("{1}")
        parts[s] = (head, mid, "{1}" if "{1}" in text else "", tail)
    known = F.create_map(*[x for s, p in parts.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in p]))])
    p = F.element_at(known, strategy)
    return F.concat(p[0], own, p[1], F.when(p[2] != "", owner).otherwise(""), p[3])


def uniform_name(name):
    """The first of the patterns that a long name matches, null if none does."""
    out = None
    for p in PATTERNS:
        # The letters that a pattern begins with rule out most names before it is tried.
        fits = F.startswith(name, F.lit(p[1 : p.index(".")])) & name.rlike(p)
        out = F.when(fits, p) if out is None else out.when(fits, p)
    return out


def _outcomes(symbols: DataFrame, of: str) -> DataFrame:
    """Each symbol with each change of its sort: one pass, one row for each pair, no join."""
    each = [F.struct(F.lit(name).alias("strategy"), F.when(F.coalesce(F.expr(ok), F.lit(False)), "ok").otherwise("impossible").alias("outcome")) for s, name, ok in STRATEGIES if s == of]
    return symbols.select("lib", "ver", F.lit(of).alias("symbol_kind"), F.col("symbol"), F.explode(F.array(*each)).alias("x")).select("lib", "ver", "symbol_kind", "symbol", "x.*")


def mutation_space(types: DataFrame, execs: DataFrame, fields: DataFrame) -> DataFrame:
    """``lib, ver, symbol_kind, symbol, strategy, outcome`` of every atomic change of every symbol.

    Symbols are distinct by name and by the values that decide what applies; ``outcome`` is ok or impossible.
    """
    none = F.array().cast("array<string>")
    lists = {"modifiers": F.coalesce("modifiers", none)}
    sup = F.coalesce(target(F.col("super_ref")), F.lit("java.lang.Object"))
    t = types.where("fqn IS NOT NULL").withColumns(lists | {"interface_refs": F.coalesce("interface_refs", none), "super_name": sup, "symbol": F.col("fqn")})
    shape = F.array_join(F.transform(F.coalesce("params", F.array().cast(execs.schema["params"].dataType)), lambda p: p["ref"]), ",")
    x = execs.withColumns(
        lists | {"thrown": F.coalesce("thrown", none), "params": F.coalesce("params", F.array().cast(execs.schema["params"].dataType)), "symbol": F.concat("owner", F.lit("."), "name", F.lit("("), shape, F.lit(")"))}
    )
    enums = types.where("kind = 'ENUM' AND fqn IS NOT NULL").select("lib", "ver", F.col("fqn").alias("owner"), F.lit(True).alias("of_enum")).distinct()
    f = fields.withColumns(lists | {"symbol": F.concat("owner", F.lit("."), "name")}).join(enums, ["lib", "ver", "owner"], "left")
    f = f.withColumn("of_enum", F.coalesce("of_enum", F.lit(False)))
    parts = [
        _outcomes(t, "type"),
        _outcomes(x.where("exec_kind = 'CONSTRUCTOR'"), "constructor"),
        _outcomes(x.where("exec_kind = 'METHOD'"), "method"),
        _outcomes(f, "field"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def strategy_outcomes(space: DataFrame) -> DataFrame:
    return space.groupBy("strategy").agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") == "impossible").alias("n_impossible"))


def confusion(rows: DataFrame, by: str, truth: str, said: str) -> DataFrame:
    """Confusion counts by group, with accuracy, precision, recall and F1."""
    t, s = F.col(truth), F.col(said)
    c = rows.groupBy(by).agg(
        F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn")
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


# Theme of a kind of change by the first pattern that is found in its name.
THEMES: list[tuple[str, str]] = [
    ("_REMOVED$", "removal"),
    ("^TYPE_NEW|_NEW_METHOD|_ADDED$", "addition"),
    ("PROTECTED", "visibility"),
    ("STATIC|FINAL|ABSTRACT|SEALED", "modifier"),
    ("THROWS|EXCEPTION", "exception"),
    ("GENERICS|FORMAL_TYPE", "generics"),
    ("TYPE_(ERASURE_)?CHANGED|KIND", "type"),
    ("ANNOTATION", "annotation"),
]


def uniform_theme(kind):
    """The theme of the first matching pattern; other if there is none."""
    out = None
    for pattern, theme in THEMES:
        out = F.when(kind.rlike(pattern), theme) if out is None else out.when(kind.rlike(pattern), theme)
    return out.otherwise("other")


def synthetic_api(spark: SparkSession, lib: str = "gen:api", ver: str = "1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, executables, fields) of every legal mix of kind, visibility and modifiers, each class with every member mix.

    A cross product of small fixed dimensions, generated from a range; it serves as a test bed of known size.
    """
    kinds = F.array(*[F.lit(k) for k in ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION")])
    bit = lambda c, i, name: F.when(F.shiftright(c, i).bitwiseAND(1) == 1, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    i = F.col("id")
    vis = F.when((i % 2) == 0, "PUBLIC").otherwise("PACKAGE_PRIVATE")
    m = F.shiftright(i, 1)
    t = spark.range(5 * 2 * 8).select(
        F.concat(F.lit("gen.T"), i).alias("fqn"), F.element_at(kinds, ((i / 16).cast("int") + 1)).alias("kind"), vis.alias("visibility"),
        F.concat(bit(m, 0, "ABSTRACT"), bit(m, 1, "FINAL"), bit(m, 2, "STATIC")).alias("modifiers"),
    ).where("NOT (array_contains(modifiers, 'ABSTRACT') AND array_contains(modifiers, 'FINAL'))").where(
        "kind = 'CLASS' OR size(modifiers) = 0"
    )
    at = {"org": F.lit("gen"), "lib": F.lit(lib), "ver": F.lit(ver)}
    types = t.withColumns(at)
    mods = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    visible = F.explode(F.array(F.lit("PUBLIC"), F.lit("PROTECTED"), F.lit("PACKAGE_PRIVATE"))).alias("visibility")
    refs = F.explode(F.array(*[F.lit(r) for r in ("void", "int", "java.lang.String", "java.util.List<java.lang.String>", "long[]")])).alias("return_ref")
    classes = types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*at, F.col("fqn").alias("owner"))
    x = classes.select("*", mods).select("*", visible).select("*", refs)
    ms = F.concat(bit(F.col("k"), 0, "STATIC"), bit(F.col("k"), 1, "FINAL"), bit(F.col("k"), 2, "SYNCHRONIZED"))
    execs = x.select(*at, "owner", F.concat(F.lit("m"), F.abs(F.xxhash64("k", "visibility", "return_ref"))).alias("name"), F.lit("METHOD").alias("exec_kind"), "visibility", ms.alias("modifiers"), "return_ref")
    y = classes.select("*", mods).select("*", visible)
    fs = F.concat(bit(F.col("k"), 0, "STATIC"), bit(F.col("k"), 1, "FINAL"), bit(F.col("k"), 2, "TRANSIENT"))
    fields = y.select(*at, "owner", F.concat(F.lit("f"), F.abs(F.xxhash64("k", "visibility"))).alias("name"), "visibility", fs.alias("modifiers"), F.lit("int").alias("type_ref"))
    return types, execs, fields


def small_api(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A generated API in the full schemas: every type of :func:`synthetic_api` with one method, field and constructor
    for each mix of modifiers, the methods with a parameter and an exception."""
    types, execs, fields = synthetic_api(spark)
    none = F.lit(None)
    of = lambda ddl: {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in _columns(ddl)}

    def full(df: DataFrame, ddl: str) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in of(ddl).items()])

    param = F.array(F.struct(F.lit("p0").alias("name"), F.lit("java.lang.String").alias("ref"), F.lit(False).alias("varargs")))
    methods = execs.where("visibility = 'PUBLIC' AND return_ref = 'void'").withColumns({"params": param, "thrown": F.array(F.lit("java.io.IOException")), "line": F.lit(1)})
    classes = types.where("kind IN ('CLASS', 'RECORD')").select("org", "lib", "ver", F.col("fqn").alias("owner"))
    ctor = {"name": F.lit("<init>"), "exec_kind": F.lit("CONSTRUCTOR"), "visibility": F.lit("PUBLIC"), "return_ref": F.lit("void"), "params": param, "thrown": F.array(F.lit("java.io.IOException")), "line": F.lit(1)}
    both = full(methods, EXEC_SCHEMA).unionByName(full(classes.withColumns(ctor), EXEC_SCHEMA))
    on = {"name": F.lit("ON"), "visibility": F.lit("PUBLIC"), "modifiers": F.array(F.lit("STATIC"), F.lit("FINAL")), "type_ref": F.col("owner")}
    constants = types.where("kind = 'ENUM'").select("org", "lib", "ver", F.col("fqn").alias("owner")).withColumns(on)
    shown = fields.where("visibility = 'PUBLIC'").unionByName(constants)
    return full(types.withColumn("interface_refs", F.array(F.lit("java.lang.Cloneable"))), TYPE_SCHEMA), both, full(shown, FIELD_SCHEMA)


def _columns(ddl: str) -> list[str]:
    """Column definitions of a schema, nested types kept whole."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def mutated_libraries(types: DataFrame, execs: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cases, types, executables, fields): a library for each possible change of each symbol, before and after it.

    A library is named ``strategy#symbol`` and holds the symbol's type with its members, as version 1 and, with the one
    change made, as version 2. The change is an expression over the rows of the symbol; nothing loops over symbols.
    """
    shape = F.array_join(F.transform(F.coalesce("params", F.array().cast(execs.schema["params"].dataType)), lambda p: p["ref"]), ",")
    x = execs.withColumn("symbol", F.concat("owner", F.lit("."), "name", F.lit("("), shape, F.lit(")")))
    f = fields.withColumn("symbol", F.concat("owner", F.lit("."), "name"))
    owners = (
        types.select(F.col("fqn").alias("symbol"), F.col("fqn").alias("owner"))
        .unionByName(x.select("symbol", "owner"))
        .unionByName(f.select("symbol", "owner"))
        .distinct()
    )
    cases = mutation_space(types, execs, fields).where("outcome = 'ok'").join(owners, "symbol")
    cases = cases.select(F.concat("strategy", F.lit("#"), "symbol").alias("case"), "strategy", "symbol_kind", F.col("symbol").alias("changed"), "owner")
    s = F.col("strategy")
    part = F.regexp_extract(s, "^(?:Add|Remove)Modifier([A-Z][a-z]+)", 1)
    mods = (
        F.when(s.startswith("AddModifier"), F.array_union(F.coalesce("modifiers", F.array().cast("array<string>")), F.array(F.upper(part))))
        .when(s.startswith("RemoveModifier"), F.array_remove("modifiers", F.upper(part)))
        .otherwise(F.col("modifiers"))
    )
    hidden = F.when(s.contains("Visibility"), "PACKAGE_PRIVATE").otherwise(F.col("visibility"))

    def versions(rows: DataFrame, symbol: str, change: dict) -> DataFrame:
        j = rows.join(cases.withColumnRenamed("owner", "at"), rows["fqn" if "fqn" in rows.columns else "owner"] == F.col("at")).drop("at")
        hit = F.col(symbol) == F.col("changed")
        after = {c: F.when(hit, e).otherwise(F.col(c)) for c, e in change.items()}
        gone = hit & s.isin("RemoveType", "RemoveMethod", "RemoveConstructor", "RemoveField", "RemoveEnumValue")
        cols = [c for c in rows.columns if c != "symbol"]
        old = j.withColumns({"lib": F.col("case"), "ver": F.lit("1")}).select(*cols)
        return old.unionByName(j.where(~gone).withColumns(after).withColumns({"lib": F.col("case"), "ver": F.lit("2")}).select(*cols))

    faces = (
        F.when(s == "AddImplementedInterfaceType", F.array_union(F.coalesce("interface_refs", F.array().cast("array<string>")), F.array(F.lit("java.lang.Runnable"))))
        .when(s == "RemoveImplementedInterfaceType", F.slice("interface_refs", 2, F.greatest(F.lit(0), F.size("interface_refs") - 1)))
        .otherwise(F.col("interface_refs"))
    )
    sup = F.when(s == "AddSuperClassClass", "java.lang.Thread").when(s == "RemoveSuperClassClass", F.lit(None)).otherwise(F.col("super_ref"))
    t = versions(types, "fqn", {"visibility": hidden, "modifiers": mods, "interface_refs": faces, "super_ref": sup})
    item = F.struct(F.lit("more").alias("name"), F.lit("int").alias("ref"), F.lit(False).alias("varargs"))
    other = F.struct(F.lit("other").alias("name"), F.lit("java.lang.Thread").alias("ref"), F.lit(False).alias("varargs"))
    rest = lambda c: F.slice(c, 2, F.greatest(F.lit(0), F.size(c) - 1))
    params = (
        F.when(s.startswith("AddParameter"), F.concat("params", F.array(item)))
        .when(s.startswith("ChangeParameter"), F.concat(F.array(other), rest("params")))
        .when(s.startswith("RemoveParameter"), rest("params"))
        .otherwise(F.col("params"))
    )
    thrown = F.when(s.startswith("AddException"), F.array_union("thrown", F.array(F.lit("java.lang.InterruptedException")))).when(s.startswith("RemoveException"), rest("thrown")).otherwise(F.col("thrown"))
    ret = F.when(s == "ChangeTypeMethod", "java.lang.Thread").otherwise(F.col("return_ref"))
    xs = versions(x, "symbol", {"visibility": hidden, "modifiers": mods, "params": params, "thrown": thrown, "return_ref": ret})
    component = F.col("strategy").isin("AddRecordComponent", "ChangeRecordComponent", "RemoveRecordComponent")
    canon = x.where("exec_kind = 'CONSTRUCTOR'").join(cases.where(component).withColumnRenamed("owner", "at"), F.col("owner") == F.col("at"))
    changed = F.when(s.startswith("Add"), F.concat("params", F.array(item))).when(s.startswith("Change"), F.concat(F.array(other), rest("params"))).otherwise(rest("params"))
    canon = canon.withColumns({"lib": F.col("case"), "ver": F.lit("2"), "params": changed}).select(*execs.columns)
    # A record's components are its canonical constructor: there the changed one stands for the old one.
    untouched = xs.where(~((F.col("ver") == "2") & (F.col("exec_kind") == "CONSTRUCTOR") & F.col("lib").rlike("^(Add|Change|Remove)RecordComponent#")))
    added = cases.where("strategy = 'AddAbstractMethodType'").select(
        *[
            {
                "lib": F.col("case"), "ver": F.lit("2"), "owner": F.col("owner"), "name": F.lit("added"), "exec_kind": F.lit("METHOD"), "visibility": F.lit("PUBLIC"),
                "modifiers": F.array(F.lit("ABSTRACT")), "return_ref": F.lit("void"),
            }.get(c, F.lit(None)).cast(execs.schema[c].dataType).alias(c)
            for c in execs.columns
        ]
    )
    fs = versions(f, "symbol", {"visibility": hidden, "modifiers": mods, "type_ref": F.when(s == "ChangeTypeField", "java.lang.Thread").otherwise(F.col("type_ref"))})
    return cases, t, untouched.unionByName(canon).unionByName(added), fs
