"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlens.llm.abuse import THRESHOLD, scored_documents, source_rates
from loamlens.llm.docpairs import code_and_description, documented_functions
from loamlens.llm.packing import packed, packing_report
from loamlens.llm.provenance import handwritten, not_handwritten
from loamlens.llm.syntax import parse_rates, unparsable
from loamlens.llm.tokenizer import encoded, token_counts
from loamlens.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no valid text of their language."""
    return unparsable(table(spark, sf_dir, "files"))


def p2_parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of such files per repo and language."""
    return parse_rates(table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with a documentation that tells more than name and signature."""
    return documented_functions(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), described=False).select("symbol_id").distinct()


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their code and description."""
    return code_and_description(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand for their repo."""
    return not_handwritten(table(spark, sf_dir, "files")).select("file_id")


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the reason of each."""
    return not_handwritten(table(spark, sf_dir, "files"))


def p4_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains, each file once."""
    return handwritten(table(spark, sf_dir, "files")).select("file_id", "repo", "path").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of each kind."""
    return packed(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p7_packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and unused room of each kind of container."""
    return packing_report(p7_packed(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of abuse."""
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual sentence."""
    return p8_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents per source."""
    return source_rates(p8_scores(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_parse_rates": p2_parse_rates, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_reasons": p4_reasons, "p4_handwritten": p4_handwritten, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_packing_report": p7_packing_report, "p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates}
SQL: dict[str, str] = {}
