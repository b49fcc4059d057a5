"""The pN queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.llm.bpe import encode_corpus
from evolvent.llm.leakage import leaked_passages
from evolvent.llm.stuffing import stuffed_documents
from evolvent.llm.term_frequency import term_frequency
from evolvent.sources.tables import table

#: Where the rank files of the public tokenizers are, unless the session names another place.
TOKENIZERS = "/opt/tokenizers"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency(table(spark, d, "bc_report"), "bc_id", "report_id", "kind", "found_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "n_occurrences", "n_groups", F.coalesce("mark", F.lit("")).alias("mark"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    folder = spark.conf.get("evolvent.tokenizers", TOKENIZERS)
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{folder}/byte_bpe_50k.tiktoken")


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages with their length in words and place in the original text."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "test_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_documents(table(spark, d, "documents"), table(spark, d, "doc_label")).where("stuffed").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_found": p8_found,
}

_TERMS = r"""
WITH one AS (SELECT report_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY bc_id ORDER BY found_at DESC NULLS LAST, report_id DESC NULLS LAST, kind DESC NULLS LAST) AS rn
  FROM bc_report) WHERE rn = 1),
pieces AS (SELECT report_id, unnest(string_split_regex(kind, '[;|,]')) AS piece FROM one WHERE kind IS NOT NULL),
terms AS (SELECT report_id, trim(regexp_replace(upper(piece), '[^A-Z0-9]+', '_', 'g'), '_') AS term FROM pieces),
counted AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT report_id) AS n_groups FROM terms WHERE term <> '' GROUP BY term),
marked AS (SELECT *, CASE WHEN n_groups <= 2 THEN 'rare'
                          WHEN n_groups > 0.5 * (SELECT count(DISTINCT report_id) FROM bc_report) THEN 'common' END AS mark FROM counted)
"""

ORACLE = {
    "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT term, n_occurrences, n_groups, coalesce(mark, '') AS mark FROM marked",
}
