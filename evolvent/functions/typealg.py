"""Algebra of Java type references: reading, substitution, subtyping and assignment.

A reference is a tuple: ``("P", name)`` a primitive, ``("V", name)`` a type variable, ``("C", name, args)`` a class or
interface, ``("A", component, dimensions)`` an array, ``("W", is_upper, bounds)`` a wildcard. What a rule needs of the
hierarchy comes with the row as headers, so a question is answered without looking anything up.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Sequence
from functools import lru_cache

from evolvent.model import BOXES, PLATFORM, WIDENING

OBJECT = ("C", "java.lang.Object", ())
UNBOXES = {b: p for p, b in BOXES.items()}
PRIMITIVES = frozenset(WIDENING) | {"void"}
_VARIABLE = re.compile(r"[A-Z][A-Z0-9]?")
_TOKEN = re.compile(r"\s*([A-Za-z_$][\w$.]*|\?|<|>|,|&|\[\]|\.\.\.)")


@lru_cache(maxsize=50_000)
def parse(text: str, variables: frozenset[str] = frozenset()) -> tuple:
    """A reference from its text; ``variables`` are names in scope that stand for type variables."""
    tokens = _TOKEN.findall(text.replace("/", "."))
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def ref() -> tuple:
        name = take()
        if name == "?":
            if peek() in ("extends", "super"):
                upper = take() == "extends"
                bounds = [ref()]
                while peek() == "&":
                    take()
                    bounds.append(ref())
                return ("W", upper, tuple(bounds))
            return ("W", True, (OBJECT,))
        args: list[tuple] = []
        if peek() == "<":
            take()
            while peek() and peek() != ">":
                args.append(ref())
                if peek() == ",":
                    take()
            take()
        if name in PRIMITIVES:
            out: tuple = ("P", name)
        elif not args and (name in variables or _VARIABLE.fullmatch(name)):
            out = ("V", name)
        else:
            out = ("C", name, tuple(args))
        dims = 0
        while peek() in ("[]", "..."):
            take()
            dims += 1
        return ("A", out, dims) if dims else out

    return ref()


def render(r: tuple) -> str:
    match r[0]:
        case "C":
            return r[1] + (f"<{','.join(map(render, r[2]))}>" if r[2] else "")
        case "A":
            return render(r[1]) + "[]" * r[2]
        case "W":
            return "?" if r[1:] == (True, (OBJECT,)) else f"? {'extends' if r[1] else 'super'} {'&'.join(map(render, r[2]))}"
    return r[1]


def substitute(r: tuple, by: dict[str, tuple]) -> tuple:
    """``r`` with its type variables replaced."""
    if not by:
        return r
    match r[0]:
        case "V":
            return by.get(r[1], r)
        case "C":
            return ("C", r[1], tuple(substitute(a, by) for a in r[2]))
        case "A":
            c = substitute(r[1], by)
            return ("A", c[1], c[2] + r[2]) if c[0] == "A" else ("A", c, r[2])
        case "W":
            return ("W", r[1], tuple(substitute(b, by) for b in r[2]))
    return r


def instantiation(names: Sequence[str], args: Sequence[tuple]) -> dict[str, tuple]:
    """What each variable of a type stands for; all that a raw reference leaves open is Object."""
    return {n: args[i] if i < len(args) else OBJECT for i, n in enumerate(names)}


Tps = list[tuple[str, list[str]]]


def names_of(*tps: Tps) -> frozenset[str]:
    return frozenset(n for t in tps for n, _ in t)


class Scope:
    """Bounds of the type variables in view; those of earlier lists hide those of later ones."""

    def __init__(self, *tps: Tps):
        self.names = names_of(*tps)
        self.bounds: dict[str, tuple[tuple, ...]] = {}
        for t in reversed(tps):
            for n, b in t:
                self.bounds[n] = tuple(parse(x, self.names) for x in b) or (OBJECT,)

    def first(self, name: str) -> tuple | None:
        return self.bounds[name][0] if name in self.bounds else None

    def end(self, name: str, stop: tuple | None = None) -> tuple:
        """The first bound of a variable that is no variable (or is ``stop``), through all bounds.

        Object for a variable of no bound; the variable itself where bounds lead back to it."""
        seen = {name}
        while True:
            bound = self.first(name) or OBJECT
            if bound[0] != "V" or bound == stop:
                return bound
            if bound[1] in seen:
                return ("V", name)
            name = bound[1]
            seen.add(name)


class World:
    """Type headers ``name -> (variable names, texts of direct supertypes)`` beside those of the platform."""

    def __init__(self, headers: dict[str, tuple[list[str], list[str]]]):
        self.headers = headers

    def header(self, name: str) -> tuple[list[str], list[str]] | None:
        if name in self.headers:
            return self.headers[name]
        return PLATFORM[name][1:] if name in PLATFORM else None

    def supers(self, r: tuple) -> list[tuple]:
        """All supertypes of a class reference, with the arguments that ``r`` gives them.

        A type that turns up again on its own way up is not followed, so wrong hierarchies come to an end too.
        """
        seen: dict[tuple, None] = {}
        front: deque[tuple[tuple, frozenset[str]]] = deque([(r, frozenset((r[1],)))])
        while front:
            x, way = front.popleft()
            if (h := self.header(x[1])) is None:
                continue
            variables = frozenset(h[0])
            by = dict(zip(h[0], x[2]))
            for text in h[1]:
                s = parse(text, variables)
                if s[0] != "C" or s[1] in way:
                    continue
                if x[2] or not h[0]:
                    s = substitute(s, by)
                if s not in seen:
                    seen[s] = None
                    front.append((s, way | {s[1]}))
        return list(seen)

    def nominal(self, a: str, b: str) -> bool:
        return a == b or any(s[1] == b for s in self.supers(("C", a, ())))

    def contains(self, scope: Scope, to: tuple, a: tuple, asked: frozenset = frozenset()) -> bool:
        """Whether type argument ``to`` contains type argument ``a``."""
        if to[0] != "W":
            return to == a
        if to[1] and to[2] == (OBJECT,):
            return True
        if a[0] != "W":
            return all(self.subtype(scope, a, b, asked) for b in to[2]) if to[1] else self.subtype(scope, to[2][0], a, asked)
        if (a[1] and a[2] == (OBJECT,)) or a[1] != to[1]:
            return False
        if to[1]:
            return all(any(self.subtype(scope, x, b, asked) for x in a[2]) for b in to[2])
        return self.subtype(scope, to[2][0], a[2][0], asked)

    def subtype(self, scope: Scope, a: tuple, b: tuple, asked: frozenset = frozenset()) -> bool:
        """Whether ``a`` is a subtype of ``b`` where ``scope`` binds the type variables.

        A question that comes up within its own answer (``asked``) is answered no. Questions about wildcards can grow
        without end where a type extends larger instances of itself: :func:`whether` answers no to these.
        """
        while True:
            if a == b:
                return True
            if (a, b) in asked:
                return False
            asked |= {(a, b)}
            if a[0] != "V":
                break
            bound = scope.first(a[1])
            if bound is None or (b[0] == "V" and bound[0] != "V"):
                return False
            a = bound
        if b[0] == "V" or a[0] == "P":
            return False
        if a[0] == "A":
            if b[0] == "C":
                return b[1] in ("java.lang.Object", "java.lang.Cloneable", "java.io.Serializable")
            if b[0] != "A":
                return False
            x, y = (r[1] if r[2] == 1 else ("A", r[1], r[2] - 1) for r in (a, b))
            return x == y if "P" in (x[0], y[0]) else self.subtype(scope, x, y, asked)
        if a[0] == "W":
            return b[0] == "W" and self.contains(scope, b, a, asked)
        if b[0] == "W":
            return self.contains(scope, b, a, asked)
        if b[0] != "C":
            return False

        def fits(s: tuple) -> bool:
            if not b[2]:
                return True
            return len(s[2]) == len(b[2]) and all(self.contains(scope, y, x, asked) for x, y in zip(s[2], b[2]))

        if a[1] == b[1]:
            return fits(a)
        return any(s[1] == b[1] and fits(s) for s in self.supers(a))

    def assignable(self, scope: Scope, a: tuple, b: tuple) -> bool:
        """Whether a value of type ``a`` can be assigned to a variable of type ``b``."""
        if a == b:
            return True
        if a[0] == "V":
            end = scope.end(a[1], b)
            return end == b or (end[0] != "V" and self.assignable(scope, end, b))
        if b[0] == "V":
            return False
        if a[0] == "P" and b[0] == "P":
            return b[1] in WIDENING.get(a[1], ())
        if a[0] == "P":
            return b[0] == "C" and a[1] in BOXES and self.reference_assignable(scope, ("C", BOXES[a[1]], ()), b)
        if b[0] == "P":
            p = UNBOXES.get(a[1]) if a[0] == "C" else None
            return p is not None and (p == b[1] or b[1] in WIDENING[p])
        if a[0] == b[0] == "C":
            return self.reference_assignable(scope, a, b)
        return self.subtype(scope, a, b)

    def reference_assignable(self, scope: Scope, a: tuple, b: tuple) -> bool:
        # Between a raw and a parameterised type only the names count.
        return self.subtype(scope, a, b) if a[2] and b[2] else self.nominal(a[1], b[1])

    def source_compatible(self, scope: Scope, old: tuple, new: tuple) -> bool:
        """Whether expressions of type ``old`` may become of type ``new`` without harm to those who use their value."""
        if old == ("P", "void"):
            return True
        if not self.assignable(scope, new, old):
            return False
        return old[0] != "P" or old[1] not in BOXES or self.assignable(scope, new, ("C", BOXES[old[1]], ()))


class Normalizer:
    """Old references in the names of the new version, new ones without the type variables that were added."""

    def __init__(self, *levels: tuple[Tps, Tps]):
        self.forward: dict[str, tuple] = {}
        self.added: dict[str, tuple] = {}
        for old, new in reversed(levels):  # the first level hides the others
            before, after = names_of(*(o for o, _ in levels)), names_of(*(n for _, n in levels))
            for i, (name, bounds) in enumerate(old):
                self.forward.pop(name, None)
                if i >= len(new):
                    self.forward[name] = parse(bounds[0], before) if bounds else OBJECT
                elif new[i][0] != name:
                    self.forward[name] = ("V", new[i][0])
            for name, bounds in new[len(old) :]:
                self.added[name] = parse(bounds[0], after) if bounds else OBJECT

    def old(self, r: tuple) -> tuple:
        return substitute(r, self.forward)

    def new(self, r: tuple) -> tuple:
        return substitute(r, self.added)


def erased(scope: Scope, r: tuple) -> tuple:
    """The erasure of a reference: variables by their first bound, through all bounds, no type arguments."""
    if r[0] == "V":
        end = scope.end(r[1])
        return OBJECT if end[0] == "V" else erased(scope, end)
    if r[0] == "A":
        c = erased(scope, r[1])
        return ("A", c[1], c[2] + r[2]) if c[0] == "A" else ("A", c, r[2])
    return ("C", r[1], ()) if r[0] == "C" else r


def whether(question: Callable[[], bool]) -> bool:
    """The answer to a question of subtyping; no where it grows without end.

    Subtyping with wildcards is undecidable; only types that extend ever larger instances of themselves, which compilers
    refuse, lead to such questions.
    """
    try:
        return question()
    except RecursionError:
        return False
