"""Command line: compare two libraries, or export the tables of one.

    python -m evolvent diff --v1 old.jar --v2 new.jar [--report FORMAT=FILE]... [--ignore FILE] [--binary-only|--source-only] [--fail-on any|binary|source|none]
    python -m evolvent api --v1 lib.jar --out FOLDER [--json FILE]

Libraries are archives or folders of class files, JSON snapshots (``.json``), or folders of Java sources.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.model import SNAPSHOT_SCHEMA
from evolvent.operators import report as R
from evolvent.operators.api_diff import ApiDiff
from evolvent.operators.api_model import ApiModel
from evolvent.operators.incremental import incremental_sources
from evolvent.session import get_session
from evolvent.sources import options as O
from evolvent.sources.classfile import declaration_tables, scan_classes
from evolvent.sources.json_snapshot import read_snapshots, write_snapshot


def read_library(spark: SparkSession, path: str, ver: str) -> dict[str, DataFrame]:
    p = Path(path)
    if path.endswith(".json"):
        decoded = read_snapshots(spark, path)
    elif p.is_dir() and next(p.rglob("*.java"), None) is not None and next(p.rglob("*.class"), None) is None:
        from evolvent.sources.javasource import scan_sources

        decoded = scan_sources(spark, path)
    elif p.exists():
        decoded = scan_classes(spark, path)
    else:
        raise SystemExit(f"no such library: {path}")
    return declaration_tables(decoded, "local", "lib", ver)


def compare(spark: SparkSession, v1: str, v2: str) -> DataFrame:
    """All findings between two libraries."""
    return comparison(spark, v1, v2).breaking_changes


def comparison(spark: SparkSession, v1: str, v2: str, classpath: tuple[Sequence[str], Sequence[str]] = ((), ()), incremental: bool = False) -> ApiDiff:
    """The comparison of two libraries, each with the class files of its classpath.

    ``incremental`` is for folders of sources: of the second only files that changed are read.
    """
    if incremental:
        old, new, _ = incremental_sources(spark, v1, v2)
        a, b = declaration_tables(old, "local", "lib", "1"), declaration_tables(new, "local", "lib", "2")
    else:
        a, b = read_library(spark, v1, "1"), read_library(spark, v2, "2")
    outside = None
    for ver, jars in zip("12", classpath):
        if jars:
            t = declaration_tables(scan_classes(spark, list(jars)), "local", "lib", ver)
            t = tuple(t[k] for k in ("type_decl", "exec_decl", "field_decl"))
            outside = t if outside is None else tuple(x.unionByName(y) for x, y in zip(outside, t))
    both = {k: a[k].unionByName(b[k]) for k in a}
    rows = [("local", "lib", v, None, "DELIVERED", None, 0) for v in "12"]
    snaps = spark.createDataFrame(rows, SNAPSHOT_SCHEMA).withColumn("taken_at", F.timestamp_seconds(F.col("ver").cast("int")))
    model = ApiModel(both["type_decl"], both["exec_decl"], both["field_decl"], snaps, both["module_export"], outside=outside)
    return ApiDiff(model)


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser(prog="evolvent", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="mode", required=True)
    d = sub.add_parser("diff")
    d.add_argument("--v1")
    d.add_argument("--v2")
    d.add_argument("--options", help="YAML file")
    d.add_argument("--report", action="append", default=[], metavar="FORMAT=FILE")
    d.add_argument("--ignore", help="accepted changes, type;symbol;kind")
    d.add_argument("--exclude", action="append", default=[], metavar="PATTERN")
    d.add_argument("--classpath", action="append", default=[], metavar="JAR", help="class files that both libraries are compiled against")
    d.add_argument("--incremental", action="store_true", help="read only changed files of the second folder of sources")
    d.add_argument("--binary-only", action="store_true", default=None)
    d.add_argument("--source-only", action="store_true", default=None)
    d.add_argument("--fail-on", choices=["any", "binary", "source", "none"], default="none")
    a = sub.add_parser("api")
    a.add_argument("--v1", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--json", help="one snapshot file of all types too")
    args = ap.parse_args(argv)
    spark = get_session("evolvent", **{"spark.ui.showConsoleProgress": "false"})
    if args.mode == "api":
        tables = read_library(spark, args.v1, "1")
        for name, df in tables.items():
            df.orderBy(*[c for c in ("fqn", "owner", "name", "pkg") if c in df.columns]).write.mode("overwrite").parquet(f"{args.out}/{name}.parquet")
        if args.json:
            write_snapshot(tables, args.v1, args.json)
        return 0
    given = {"v1": {"location": args.v1}, "v2": {"location": args.v2}, "diff": {"ignore": args.ignore, "binaryOnly": args.binary_only, "sourceOnly": args.source_only}}
    o = O.overlay(given, O.load(args.options) if args.options else O.DEFAULTS)
    if not o["v1"]["location"] or not o["v2"]["location"]:
        ap.error("two libraries are needed")
    if o["diff"]["binaryOnly"] and o["diff"]["sourceOnly"]:
        ap.error("binary only and source only exclude each other")
    sides = [O.effective(o, v) for v in ("v1", "v2")]
    compared = comparison(spark, o["v1"]["location"], o["v2"]["location"], tuple([*x["classpath"]["jars"], *args.classpath] for x in sides), args.incremental)
    without = sides[0]["excludes"]
    found = compared.reported([*without["names"], *args.exclude], [(x["name"], x.get("args") or {}) for x in without["annotations"]])
    for v, side in zip("12", ("v1", "v2")):
        if o[side]["apiReport"]:
            write_snapshot(read_library(spark, o[side]["location"], v), o[side]["location"], o[side]["apiReport"])
    if o["diff"]["ignore"]:
        found = R.accept(found, R.read_accepted(spark, o["diff"]["ignore"]))
    if o["diff"]["binaryOnly"]:
        found = found.where("binary_breaking")
    if o["diff"]["sourceOnly"]:
        found = found.where("source_breaking")
    found = found.persist()
    sys.stdout.writelines(R.as_text(found))
    for x in [f"{r['format']}={r['file']}" for r in o["reports"]] + args.report:
        format_, _, file = x.partition("=")
        R.write_report(found, format_, file)
    return R.exit_code(found, args.fail_on)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
