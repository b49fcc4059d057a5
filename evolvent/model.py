"""Fixed values of the domain: kinds of breaking changes, facts of the Java platform, table schemas."""

from __future__ import annotations

# Each kind of breaking change in report order, with its nature, and whether it breaks binaries and sources.
BC_KINDS: list[tuple[str, str, bool, bool]] = [
    ("TYPE_REMOVED", "DELETION", True, True),
    ("TYPE_NOW_PROTECTED", "MUTATION", True, True),
    ("TYPE_KIND_CHANGED", "MUTATION", True, True),
    ("TYPE_SUPERTYPE_REMOVED", "MUTATION", True, True),
    ("TYPE_NOW_SEALED", "MUTATION", True, True),
    ("TYPE_NEW_ABSTRACT_METHOD", "ADDITION", False, True),
    ("CLASS_NOW_ABSTRACT", "MUTATION", True, True),
    ("CLASS_NOW_FINAL", "MUTATION", True, True),
    ("CLASS_NOW_CHECKED_EXCEPTION", "MUTATION", False, True),
    ("CLASS_NOW_STATIC", "MUTATION", True, True),
    ("CLASS_NO_LONGER_STATIC", "MUTATION", True, True),
    ("CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE", "MUTATION", True, True),
    ("ANNOTATION_TARGET_REMOVED", "MUTATION", False, True),
    ("ANNOTATION_NEW_METHOD_WITHOUT_DEFAULT", "ADDITION", False, True),
    ("ANNOTATION_NO_LONGER_REPEATABLE", "MUTATION", False, True),
    ("ANNOTATION_METHOD_NO_LONGER_DEFAULT", "MUTATION", False, True),
    ("FIELD_REMOVED", "DELETION", True, True),
    ("FIELD_NOW_PROTECTED", "MUTATION", True, True),
    ("FIELD_TYPE_ERASURE_CHANGED", "MUTATION", True, False),
    ("FIELD_TYPE_CHANGED_INCOMPATIBLE", "MUTATION", False, True),
    ("FIELD_NOW_FINAL", "MUTATION", True, True),
    ("FIELD_NOW_STATIC", "MUTATION", True, False),
    ("FIELD_NO_LONGER_STATIC", "MUTATION", True, True),
    ("EXECUTABLE_REMOVED", "DELETION", True, True),
    ("EXECUTABLE_NOW_PROTECTED", "MUTATION", True, True),
    ("EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION", "MUTATION", False, True),
    ("EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION", "MUTATION", False, True),
    ("EXECUTABLE_PARAMETER_GENERICS_CHANGED", "MUTATION", False, True),
    ("METHOD_NOW_ABSTRACT", "MUTATION", True, True),
    ("METHOD_NOW_FINAL", "MUTATION", True, True),
    ("METHOD_NOW_STATIC", "MUTATION", True, False),
    ("METHOD_OVERRIDABLE_NOW_STATIC", "MUTATION", False, True),
    ("METHOD_NO_LONGER_STATIC", "MUTATION", True, True),
    ("METHOD_RETURN_TYPE_ERASURE_CHANGED", "MUTATION", True, False),
    ("METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE", "MUTATION", False, True),
    ("FORMAL_TYPE_PARAMETER_ADDED", "MUTATION", False, True),
    ("FORMAL_TYPE_PARAMETER_REMOVED", "MUTATION", False, True),
    ("FORMAL_TYPE_PARAMETER_CHANGED", "MUTATION", False, True),
]

# Some types of the Java platform: kind, formal type parameters, direct supertypes.
PLATFORM: dict[str, tuple[str, list[str], list[str]]] = {
    "java.lang.Object": ("CLASS", [], []),
    "java.io.Serializable": ("INTERFACE", [], ["java.lang.Object"]),
    "java.lang.Cloneable": ("INTERFACE", [], ["java.lang.Object"]),
    "java.lang.Comparable": ("INTERFACE", ["T"], ["java.lang.Object"]),
    "java.lang.CharSequence": ("INTERFACE", [], ["java.lang.Object"]),
    "java.lang.Runnable": ("INTERFACE", [], ["java.lang.Object"]),
    "java.lang.AutoCloseable": ("INTERFACE", [], ["java.lang.Object"]),
    "java.io.Closeable": ("INTERFACE", [], ["java.lang.Object", "java.lang.AutoCloseable"]),
    "java.lang.Iterable": ("INTERFACE", ["T"], ["java.lang.Object"]),
    "java.lang.annotation.Annotation": ("INTERFACE", [], ["java.lang.Object"]),
    "java.lang.String": ("CLASS", [], ["java.lang.Object", "java.io.Serializable", "java.lang.Comparable<java.lang.String>", "java.lang.CharSequence"]),
    "java.lang.Number": ("CLASS", [], ["java.lang.Object", "java.io.Serializable"]),
    "java.lang.Boolean": ("CLASS", [], ["java.lang.Object", "java.io.Serializable", "java.lang.Comparable<java.lang.Boolean>"]),
    "java.lang.Character": ("CLASS", [], ["java.lang.Object", "java.io.Serializable", "java.lang.Comparable<java.lang.Character>"]),
    "java.lang.Byte": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Byte>"]),
    "java.lang.Short": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Short>"]),
    "java.lang.Integer": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Integer>"]),
    "java.lang.Long": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Long>"]),
    "java.lang.Float": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Float>"]),
    "java.lang.Double": ("CLASS", [], ["java.lang.Number", "java.lang.Comparable<java.lang.Double>"]),
    "java.lang.Enum": ("CLASS", ["E"], ["java.lang.Object", "java.lang.Comparable<E>", "java.io.Serializable"]),
    "java.lang.Record": ("CLASS", [], ["java.lang.Object"]),
    "java.lang.Thread": ("CLASS", [], ["java.lang.Object", "java.lang.Runnable"]),
    "java.lang.Throwable": ("CLASS", [], ["java.lang.Object", "java.io.Serializable"]),
    "java.lang.Exception": ("CLASS", [], ["java.lang.Throwable"]),
    "java.lang.Error": ("CLASS", [], ["java.lang.Throwable"]),
    "java.lang.RuntimeException": ("CLASS", [], ["java.lang.Exception"]),
    "java.lang.IllegalArgumentException": ("CLASS", [], ["java.lang.RuntimeException"]),
    "java.lang.IllegalStateException": ("CLASS", [], ["java.lang.RuntimeException"]),
    "java.lang.UnsupportedOperationException": ("CLASS", [], ["java.lang.RuntimeException"]),
    "java.lang.ReflectiveOperationException": ("CLASS", [], ["java.lang.Exception"]),
    "java.lang.ClassNotFoundException": ("CLASS", [], ["java.lang.ReflectiveOperationException"]),
    "java.lang.InterruptedException": ("CLASS", [], ["java.lang.Exception"]),
    "java.io.IOException": ("CLASS", [], ["java.lang.Exception"]),
    "java.io.FileNotFoundException": ("CLASS", [], ["java.io.IOException"]),
    "java.io.UncheckedIOException": ("CLASS", [], ["java.lang.RuntimeException"]),
    "java.io.InputStream": ("CLASS", [], ["java.lang.Object", "java.io.Closeable"]),
    "java.io.FileInputStream": ("CLASS", [], ["java.io.InputStream"]),
    "java.io.OutputStream": ("CLASS", [], ["java.lang.Object", "java.io.Closeable"]),
    "java.util.Iterator": ("INTERFACE", ["E"], ["java.lang.Object"]),
    "java.util.Comparator": ("INTERFACE", ["T"], ["java.lang.Object"]),
    "java.util.Collection": ("INTERFACE", ["E"], ["java.lang.Object", "java.lang.Iterable<E>"]),
    "java.util.List": ("INTERFACE", ["E"], ["java.lang.Object", "java.util.Collection<E>"]),
    "java.util.Set": ("INTERFACE", ["E"], ["java.lang.Object", "java.util.Collection<E>"]),
    "java.util.Map": ("INTERFACE", ["K", "V"], ["java.lang.Object"]),
    "java.util.AbstractCollection": ("CLASS", ["E"], ["java.lang.Object", "java.util.Collection<E>"]),
    "java.util.AbstractList": ("CLASS", ["E"], ["java.util.AbstractCollection<E>", "java.util.List<E>"]),
    "java.util.ArrayList": ("CLASS", ["E"], ["java.util.AbstractList<E>", "java.util.List<E>", "java.lang.Cloneable", "java.io.Serializable"]),
    "java.util.AbstractMap": ("CLASS", ["K", "V"], ["java.lang.Object", "java.util.Map<K,V>"]),
    "java.util.HashMap": ("CLASS", ["K", "V"], ["java.util.AbstractMap<K,V>", "java.util.Map<K,V>", "java.lang.Cloneable", "java.io.Serializable"]),
    "java.util.HashSet": ("CLASS", ["E"], ["java.util.AbstractCollection<E>", "java.util.Set<E>", "java.lang.Cloneable", "java.io.Serializable"]),
    "java.util.concurrent.Callable": ("INTERFACE", ["V"], ["java.lang.Object"]),
    "java.util.function.Function": ("INTERFACE", ["T", "R"], ["java.lang.Object"]),
    "java.util.function.Supplier": ("INTERFACE", ["T"], ["java.lang.Object"]),
    "java.util.function.Consumer": ("INTERFACE", ["T"], ["java.lang.Object"]),
    "java.util.function.Predicate": ("INTERFACE", ["T"], ["java.lang.Object"]),
}

# Primitive types, to which a value of each widens, and their boxes.
WIDENING: dict[str, list[str]] = {
    "byte": ["short", "int", "long", "float", "double"],
    "short": ["int", "long", "float", "double"],
    "char": ["int", "long", "float", "double"],
    "int": ["long", "float", "double"],
    "long": ["float", "double"],
    "float": ["double"],
    "double": [],
    "boolean": [],
}
BOXES: dict[str, str] = {
    "boolean": "java.lang.Boolean",
    "byte": "java.lang.Byte",
    "short": "java.lang.Short",
    "char": "java.lang.Character",
    "int": "java.lang.Integer",
    "long": "java.lang.Long",
    "float": "java.lang.Float",
    "double": "java.lang.Double",
}
# Where an annotation without a target may stand.
DEFAULT_TARGETS = [
    "ANNOTATION_TYPE", "CONSTRUCTOR", "FIELD", "LOCAL_VARIABLE", "METHOD", "MODULE", "PACKAGE", "PARAMETER", "RECORD_COMPONENT", "TYPE", "TYPE_PARAMETER",
]

PLATFORM_PREFIX = "java."

_TPS = "array<struct<name:string,bounds:array<string>>>"
TYPE_SCHEMA = (
    "org string, lib string, ver string, fqn string, kind string, visibility string, modifiers array<string>, super_ref string, interface_refs array<string>, "
    f"tps {_TPS}, enclosing string, permitted array<string>, annotations array<struct<fqn:string,values:map<string,string>>>, targets array<string>, "
    "file string, line int, origin string, loaded_at timestamp"
)
EXEC_SCHEMA = (
    "org string, lib string, ver string, owner string, name string, exec_kind string, visibility string, modifiers array<string>, return_ref string, "
    f"params array<struct<name:string,ref:string,varargs:boolean>>, tps {_TPS}, thrown array<string>, has_default boolean, line int"
)
FIELD_SCHEMA = (
    "org string, lib string, ver string, owner string, name string, visibility string, modifiers array<string>, type_ref string, is_const boolean, file string, line int"
)
SNAPSHOT_SCHEMA = "org string, lib string, ver string, taken_at timestamp, state string, module_name string, n_types int"


def platform_ancestors() -> dict[str, dict[str, int]]:
    """Nominal supertypes of each platform type with the least number of links."""
    out: dict[str, dict[str, int]] = {}
    for t in PLATFORM:
        front, depth, seen = [t], 0, {}
        while front:
            depth += 1
            front = [s.split("<")[0] for x in front for s in PLATFORM.get(x, ("", [], []))[2]]
            front = [s for s in dict.fromkeys(front) if s not in seen and s != t]
            seen |= {s: depth for s in front}
        out[t] = seen
    return out
