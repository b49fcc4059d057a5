import datetime as dt
import random

import numpy as np
import pytest

from evolvent.operators import type_hierarchy as H
from evolvent.operators.forest import NestedSets, closure

TYPE = "lib string, ver string, fqn string, super_ref string, interface_refs array<string>, enclosing string, loaded_at timestamp, node string, depth string"
T0 = dt.datetime(2020, 1, 1)


def row(lib, fqn, sup=None, ifs=None, enc=None):
    return (lib, "1", fqn, sup, ifs, enc, T0, "n", "d")


def brute(rows):
    out = {}
    names = {}
    for r in rows:
        names.setdefault((r[0], r[1]), {})[r[2]] = r
    for (lib, ver), byname in names.items():
        for link, of in (("super_ref", lambda r: [r[3]]), ("interface_refs", lambda r: r[4] or []), ("enclosing", lambda r: [r[5]])):
            for d in byname:
                front, depth, seen = {d}, 0, set()
                while front:
                    depth += 1
                    front = {p for x in front for p in of(byname[x]) if p in byname} - seen
                    seen |= front
                    for a in front:
                        out[lib, ver, link, a, d] = depth
    return out


def graph(seed):
    r = random.Random(seed)
    rows = []
    for lib in "abc":
        n = 25
        for i in range(n):
            pick = lambda: r.choice([None, "ext.X", *[f"T{r.randrange(max(1, i))}"] * 4, f"T{r.randrange(n)}" if lib == "c" else None])
            ifs = [p for p in (pick(), pick()) if p] if lib != "a" else [p for p in (pick(),) if p]
            rows.append(row(lib, f"T{i}", pick(), ifs or None, pick()))
    return rows


@pytest.mark.parametrize("group", [1000, 0])
def test_against_brute_force_with_loops_and_several_parents(spark, group):
    rows = graph(3)
    df = H.type_ancestors(spark.createDataFrame(rows * 2, TYPE), group)
    got = [tuple(r) for r in df.select("lib", "ver", "link", "ancestor", "descendant", "depth").collect()]
    assert len(got) == len(set(got))
    assert {g[:5]: g[5] for g in got} == brute(rows)


@pytest.mark.parametrize("group", [1000, 0])
def test_trees_path_root_and_ranges(spark, group):
    rows = [row("l", "R"), row("l", "A", "R"), row("l", "B", "R"), row("l", "C", "A"), row("l", "X", "X"), row("l", "Y", "X"), row("l", "Alone")]
    got = {r["fqn"]: r for r in H.type_trees(spark.createDataFrame(rows, TYPE), group).where("link = 'super_ref'").collect()}
    assert set(got) == {"R", "A", "B", "C"}
    assert (got["C"]["path"], got["C"]["root"], got["C"]["depth"], got["R"]["n_descendants"]) == ("R/A/C", "R", 2, 3)
    lo = {k: (v["lo"], v["lo"] + v["size"]) for k, v in got.items()}
    assert lo["R"] == (0, 4) and lo["A"][0] < lo["C"][0] < lo["A"][1] and not lo["B"][0] < lo["C"][0] < lo["B"][1]


@pytest.mark.parametrize("group", [1000, 0])
def test_empty_and_no_links(spark, group):
    assert H.type_ancestors(spark.createDataFrame([], TYPE), group).collect() == []
    assert H.type_ancestors(spark.createDataFrame([row("l", "A"), (None,) * 9, row("l", "B", "", [None, ""], " ")], TYPE), group).collect() == []


def test_long_chain_and_wide_star():
    n = 3000
    chain = NestedSets(np.arange(-1, n - 1))
    assert sum(len(a) for a, _, _ in chain.pairs()) == n * (n - 1) // 2
    star = NestedSets(np.concatenate([[-1], np.zeros(n, dtype=int)]))
    a, d, depth = (np.concatenate(x) for x in zip(*star.pairs()))
    assert len(d) == n and set(depth.tolist()) == {1} and set(a.tolist()) == {0}


def test_loops_are_left_over():
    s = NestedSets(np.array([1, 0, 0, -1]))
    assert s.looped.tolist() == [True, True, False, False] and s.ranged.tolist() == [False, False, False, True]
    got = {(int(a), int(d)): int(k) for x in closure(3, np.array([0, 1, 2]), np.array([1, 0, 0])) for a, d, k in zip(*x)}
    assert got == {(1, 0): 1, (0, 1): 1, (0, 2): 1, (0, 0): 2, (1, 1): 2, (1, 2): 2}


def brute_places(rows):
    """Rows of every linked type, from the closure and a search for each path."""
    pairs, above, names = brute(rows), {}, {}
    for r in rows:
        for link, refs in (("super_ref", [r[3]]), ("interface_refs", r[4] or []), ("enclosing", [r[5]])):
            names[r[0], r[1], link, r[2]] = refs
    for (lib, ver, link, a, d), k in pairs.items():
        above.setdefault((lib, ver, link, d), {})[a] = k
    linked = set(above) | {(lib, ver, link, a) for lib, ver, link, a, _ in pairs}
    up = lambda x: set(above.get(x, ()))
    out = {}
    for x in linked:
        g = x[:3]
        on = lambda n: n in up((*g, n))
        root = lambda n: not up((*g, n)) or (on(n) and min(up((*g, n))) == n and all(n in up((*g, m)) for m in up((*g, n))))

        def path(n, to, k):
            if not k:
                return n
            near = [p for p in names[*g, n] if p and (p == to if k == 1 else p != to and above.get((*g, p), {}).get(to) == k - 1)]
            return f"{path(min(near), to, k - 1)}/{n}"

        loop = "on" if on(x[3]) else "below" if any(map(on, up(x))) else ""
        below = sum(p[:4] == x for p in pairs)
        for to, k in ({x[3]: 0} if root(x[3]) else {}).items() | {(a, k) for a, k in above.get(x, {}).items() if a != x[3] and root(a)}:
            out[*x, to] = (k, below, path(x[3], to, k), loop)
    assert {k[:4] for k in out} == linked
    return out


@pytest.mark.parametrize(("group", "seed"), [(1000, 3), (1000, 4), (0, 3)])
def test_every_linked_type_has_its_places(spark, group, seed):
    rows = graph(seed)
    got = H.type_places(spark.createDataFrame(rows * 2, TYPE), group).select("lib", "ver", "link", "fqn", "root", "depth", "n_descendants", "path", "loop").collect()
    want = brute_places(rows)
    assert len(got) == len(want) and {tuple(r[:5]): tuple(r[5:]) for r in got} == want
    assert {r[3] for r in want.values()} == {"", "on", "below"}


def test_places_of_two_parents_and_loops(spark):
    rows = [row("l", "R"), row("l", "A", None, ["R"]), row("l", "B", None, ["R"]), row("l", "C", None, ["B", "A"]), row("l", "X", "Y"), row("l", "Y", "X"), row("l", "Z", "Y")]
    got = {(r["link"], r["fqn"]): r for r in H.type_places(spark.createDataFrame(rows, TYPE)).collect()}
    assert {k[1]: (r["root"], r["depth"], r["path"], r["n_descendants"], r["loop"]) for k, r in got.items()} == {
        "R": ("R", 0, "R", 3, ""), "A": ("R", 1, "R/A", 1, ""), "B": ("R", 1, "R/B", 1, ""), "C": ("R", 2, "R/A/C", 0, ""),
        "X": ("X", 0, "X", 3, "on"), "Y": ("X", 1, "X/Y", 3, "on"), "Z": ("X", 2, "X/Y/Z", 0, "below"),
    }


def test_p4_trees_has_every_type_of_p4_found(spark, sf):
    from evolvent.plans import problems

    pairs = problems.p4_found(spark, sf)
    linked = {tuple(r) for c in ("ancestor", "descendant") for r in pairs.select("lib", "ver", "link", c).collect()}
    assert {tuple(r) for r in problems.p4_trees(spark, sf).select("lib", "ver", "link", "fqn").collect()} == linked
