"""Reports of breaking changes: normal form, exclusions, accepted changes, summaries, writers."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.functions.refs import package_name
from evolvent.model import BC_KINDS

REPORT_COLUMNS = ("type", "symbol", "kind", "nature", "location", "newSymbol", "binaryBreaking", "sourceBreaking")


def kind_dimension(spark: SparkSession) -> DataFrame:
    """The kinds of breaking changes: ``kind, kind_ordinal, nature, binary_breaking, source_breaking`` (38 rows)."""
    rows = [(k, i, n, b, s) for i, (k, n, b, s) in enumerate(BC_KINDS)]
    return spark.createDataFrame(rows, "kind string, kind_ordinal int, nature string, binary_breaking boolean, source_breaking boolean")


def normal_kind(kind: Column) -> Column:
    """A kind's name in upper case with ``_`` between words, however it was written."""
    return F.btrim(F.regexp_replace(F.upper(kind), "[^A-Z0-9]+", "_"), F.lit("_"))


def normal_report(raw: DataFrame) -> DataFrame:
    """Findings of stored reports, each once, with one valid kind a row and what that kind breaks.

    Rows of one ``bc_id`` count once (the latest found); a cell with several kinds gives a row for each; kinds that are
    none are left out.
    """
    cols = ("found_at", "report_id", "lib", "ver_old", "ver_new", "impacted_type", "impacted_symbol", "new_symbol", "file", "line", "kind")
    one = raw.where("bc_id IS NOT NULL").groupBy("bc_id").agg(F.max(F.struct(*cols)).alias("m")).select("bc_id", "m.*")
    pieces = F.array_distinct(F.transform(F.split("kind", "[;|,]"), normal_kind))
    each = one.withColumn("kind", F.explode(pieces))
    return each.join(F.broadcast(kind_dimension(raw.sparkSession)), "kind")


def distinct_findings(report: DataFrame) -> DataFrame:
    """Findings without the ids of their rows: equal in type, symbol, kind, new symbol and place means the same."""
    return report.select("report_id", "lib", "ver_new", "impacted_type", "impacted_symbol", "kind", "new_symbol", "file", "line").distinct()


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy("impacted_type", "impacted_symbol", "kind_ordinal")


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    """Whether a whole name matches one of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(name.rlike(f"^(?:{p})$"), F.lit(False))
    return out


def exclude_by_name(report: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Findings whose type and symbol match none of the patterns; nested types go with what encloses them."""
    patterns = list(patterns)
    nested = [f"(?:{p})[$].*" for p in patterns]
    hit = matches_any(F.col("impacted_type"), patterns + nested) | matches_any(F.col("impacted_symbol"), patterns)
    return report.where(~hit)


def has_annotation(annotations: Column, fqn: Column, values: dict[str, str] | None = None) -> Column:
    """Whether there is an annotation of that name with all the given values (``annotations`` hold sorted entries)."""

    def fits(a: Column) -> Column:
        ok = a["fqn"] == fqn
        for k, v in (values or {}).items():
            ok = ok & F.exists(F.coalesce(a["entries"], F.array()), lambda e: (e["key"] == k) & (e["value"] == v))
        return ok

    return F.coalesce(F.exists(annotations, fits), F.lit(False))


def exclude_types(report: DataFrame, excluded: DataFrame) -> DataFrame:
    """Findings on none of the excluded types (``lib, ver, fqn`` of the older version)."""
    x = excluded.select("lib", F.col("ver").alias("ver_old"), F.col("fqn").alias("impacted_type")).distinct()
    return report.join(x, ["lib", "ver_old", "impacted_type"], "left_anti")


def accept(report: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings that are not accepted: no row of ``accepted`` has their type, symbol and kind."""
    keys = ["impacted_type", "impacted_symbol", "kind"]
    return report.join(accepted.select(*keys).distinct(), keys, "left_anti")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """An accepted-changes file: ``type;symbol;kind`` and further columns, so a full report can serve as one.

    Blank lines, ``#`` comments and the header are skipped; a row of fewer columns or an unknown kind is an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#') AND NOT startswith(lower(v), 'type;')")
    p = F.split("v", ";")
    rows = lines.select(
        F.when(F.size(p) >= 3, F.trim(F.get(p, F.lit(0)))).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), "v"))).alias("impacted_type"),
        F.trim(F.get(p, F.lit(1))).alias("impacted_symbol"),
        F.trim(F.get(p, F.lit(2))).alias("kind"),
    )
    known = [k for k, *_ in BC_KINDS]
    return rows.withColumn("kind", F.when(F.col("kind").isin(known), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit(""))))))


def by_type(report: DataFrame) -> DataFrame:
    """Per library version and type: findings, and whether any breaks binaries or sources."""
    return report.groupBy("lib", "ver_new", "impacted_type").agg(
        F.count("*").alias("n"), F.bool_or("binary_breaking").alias("binary_breaking"), F.bool_or("source_breaking").alias("source_breaking")
    )


def by_package(report: DataFrame) -> DataFrame:
    pkg = package_name(F.col("impacted_type")).alias("pkg")
    return report.groupBy("lib", "ver_new", pkg).agg(F.countDistinct("impacted_type").alias("n_types"), F.count("*").alias("n"))


def by_member(report: DataFrame) -> DataFrame:
    """Findings of each symbol with their kinds in report order."""
    kinds = F.transform(F.array_sort(F.collect_set(F.struct("kind_ordinal", "kind"))), lambda x: x["kind"])  # at most one of each kind
    return report.groupBy("lib", "ver_new", "impacted_symbol").agg(F.count("*").alias("n"), F.array_join(kinds, ",").alias("kinds"))


def summary(report: DataFrame) -> DataFrame:
    """Per library version: all, binary-breaking and source-breaking findings."""
    return report.groupBy("lib", "ver_new").agg(
        F.count("*").alias("total"), F.count_if("binary_breaking").alias("n_binary"), F.count_if("source_breaking").alias("n_source")
    )


def rollup(report: DataFrame) -> DataFrame:
    """Totals over package, type and kind, and over each prefix of these; an extension."""
    r = report.withColumn("pkg", package_name(F.col("impacted_type")))
    return r.rollup("pkg", "impacted_type", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


# -- writers ------------------------------------------------------------------------------------------------------


def report_rows(report: DataFrame) -> DataFrame:
    """The eight columns of written reports, as text, in report order."""
    place = F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise("")
    cols = {
        "type": F.col("impacted_type"), "symbol": F.col("impacted_symbol"), "kind": F.col("kind"), "nature": F.col("nature"), "location": place,
        "newSymbol": F.coalesce("new_symbol", F.lit("")), "binaryBreaking": F.col("binary_breaking").cast("string"), "sourceBreaking": F.col("source_breaking").cast("string"),
    }
    return in_report_order(report).select(*[c.alias(k) for k, c in cols.items()])


def write_csv(report: DataFrame, path: str) -> None:
    """One folder of ``;`` files, written in parallel."""
    report_rows(report).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    place = F.when(F.col("file").isNotNull(), F.struct(F.col("file").alias("path"), "line"))
    cols = (
        F.col("impacted_type").alias("type"), F.col("impacted_symbol").alias("symbol"), "kind", "nature", place.alias("location"),
        F.col("new_symbol").alias("newSymbol"), F.col("binary_breaking").alias("binaryBreaking"), F.col("source_breaking").alias("sourceBreaking"),
    )
    in_report_order(report).select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _rows(report: DataFrame) -> Iterator[dict]:
    for r in report_rows(report).toLocalIterator():
        yield r.asDict()


def as_csv(report: DataFrame) -> Iterator[str]:
    """A report's lines; like all text writers it reads the rows one partition at a time."""
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator="\n")
    yield ";".join(REPORT_COLUMNS) + "\n"
    for r in _rows(report):
        w.writerow(r[c] for c in REPORT_COLUMNS)
        yield out.getvalue()
        out.seek(0)
        out.truncate()


def as_json(report: DataFrame) -> Iterator[str]:
    yield "["
    for i, r in enumerate(_rows(report)):
        file, _, line = r["location"].rpartition(":")
        r |= {"location": {"path": file, "line": int(line)} if file else None, "newSymbol": r["newSymbol"] or None}
        r |= {k: r[k] == "true" for k in ("binaryBreaking", "sourceBreaking")}
        yield (",\n" if i else "\n") + json.dumps(r)
    yield "\n]\n"


def _counts(report: DataFrame) -> tuple[int, int, int]:
    r = report.agg(F.count("*"), F.count_if("binary_breaking"), F.count_if("source_breaking")).first()
    return r[0], r[1], r[2]


def as_markdown(report: DataFrame) -> Iterator[str]:
    total, binary, source = _counts(report)
    yield "## Breaking changes\n\n"
    if not total:
        yield "None.\n"
        return
    yield f"{total} in all, {binary} break binaries, {source} break sources.\n\n"
    yield "| Type | Symbol | Kind | Nature | Location | New symbol | Binary | Source |\n|---|---|---|---|---|---|---|---|\n"
    for r in _rows(report):
        yield "| " + " | ".join((r[c] or "").replace("|", "\\|") for c in REPORT_COLUMNS) + " |\n"


def as_text(report: DataFrame) -> Iterator[str]:
    total, binary, source = _counts(report)
    if not total:
        yield "No breaking changes.\n"
        return
    yield f"{total} breaking changes ({binary} binary, {source} source)\n"
    for r in _rows(report):
        local = r["symbol"] == r["type"] or r["symbol"].startswith(r["type"] + ".")
        mark = {"ADDITION": "+", "DELETION": "-"}.get(r["nature"], "~")
        yield f"{mark} {r['symbol']} {r['kind']}" + ("" if local else f" in {r['type']}") + (f" ({r['location']})" if r["location"] else "") + "\n"


def as_html(report: DataFrame, cards: DataFrame | None = None) -> Iterator[str]:
    """A page: totals, the APIs that were compared (``cards``: label, n_types, n_exported, n_methods, n_fields), impacted types by
    package with their numbers of findings, then each type's findings by symbol."""
    e = lambda x: html.escape(str(x or ""))
    total, binary, source = _counts(report)
    yield "<!doctype html><meta charset=utf-8><title>Breaking changes</title>\n<h1>Breaking changes</h1>\n"
    yield f"<p>{total} in all, {binary} binary, {source} source.</p>\n"
    for c in cards.toLocalIterator() if cards is not None else ():
        yield f"<section class=api><h3>{e(c['label'])}</h3><p>{c['n_exported']} of {c['n_types']} types exported, {c['n_methods']} methods, {c['n_fields']} fields</p></section>\n"
    if not total:
        yield "<p>None.</p>\n"
        return
    types = report.groupBy("impacted_type").agg(F.count("*").alias("n"), F.bool_or("binary_breaking").alias("b"), F.bool_or("source_breaking").alias("s"))
    last = None
    for t in types.withColumn("pkg", package_name(F.col("impacted_type"))).orderBy("pkg", "impacted_type").toLocalIterator():
        if t["pkg"] != last:
            yield ("</ul>\n" if last is not None else "") + f"<h2>{e(t['pkg'])}</h2>\n<ul>\n"
            last = t["pkg"]
        yield f"<li><a href='#{e(t['impacted_type'])}'>{e(t['impacted_type'])}</a> {t['n']}{' binary' if t['b'] else ''}{' source' if t['s'] else ''}</li>\n"
    yield "</ul>\n"
    shown = None, None
    for r in _rows(report):
        if r["type"] != shown[0]:
            yield ("</table>\n" if shown[0] is not None else "") + f"<h2 id='{e(r['type'])}'>{e(r['type'])}</h2>\n<table>\n"
        if (r["type"], r["symbol"]) != shown:
            yield f"<tr><th colspan=8>{e(r['symbol'])}</th></tr>\n"
        shown = r["type"], r["symbol"]
        yield "<tr>" + "".join(f"<td>{e(r[c])}</td>" for c in REPORT_COLUMNS) + "</tr>\n"
    yield "</table>\n"


WRITERS = {"CLI": as_text, "CSV": as_csv, "HTML": as_html, "JSON": as_json, "MD": as_markdown}


def write_report(report: DataFrame, format: str, path: str) -> None:
    """A report as one file, in report order; the folders above it are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as f:
        f.writelines(WRITERS[format.upper()](report))


def exit_code(report: DataFrame, fail_on: str = "any") -> int:
    """0 if nothing fails the build, 1 if a finding does; ``fail_on`` is any, binary, source or none."""
    if fail_on == "none":
        return 0
    rows = report if fail_on == "any" else report.where(f"{fail_on}_breaking")
    return 0 if rows.isEmpty() else 1
