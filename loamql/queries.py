"""The core's registered queries, and SQL with the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamql import source_queries
from loamql.api import query_tables
from loamql.language_queries import QUERIES
from loamql.operators import keychunks, rejects
from loamql.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "raw_records"), table(spark, folder, "csv_unit_tests"))


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    out = rejects.load_records(table(spark, folder, "raw_records"), table(spark, folder, "csv_unit_tests"))
    return out.filter(F.col("reason").isNull()).select("record_id", "case_id", "record_no", "fields")


def p1_case_report(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.case_report(table(spark, folder, "raw_records"), table(spark, folder, "csv_unit_tests"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return keychunks.heavy_keys(table(spark, folder, "university_ranking"), "country", 4).select("country")


def p2_country_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct universities and the sum of sound scores of every country value as stored."""
    score = F.col("total_score")
    sound = F.when(~F.isnan(score) & score.between(0, 100), score.cast("decimal(18,3)"))
    out = keychunks.key_summary(table(spark, folder, "university_ranking"), "country", "university_name", {"score_sum": sound, "n_scored": sound.isNotNull().cast("long")})
    return out.select("country", "n", F.col("n_members").alias("n_universities"), F.col("score_sum").cast("double").alias("score_sum"), "n_scored")


P2_FOUND_SQL = """
SELECT country FROM university_ranking WHERE country IS NOT NULL GROUP BY country
HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM university_ranking)
"""
P2_SUMMARY_SQL = """
SELECT country, count(*) AS n, count(DISTINCT university_name) AS n_universities,
       CAST(sum(s) AS DOUBLE) AS score_sum, count(s) AS n_scored
FROM (SELECT *, CASE WHEN NOT isnan(total_score) AND total_score BETWEEN 0 AND 100 THEN CAST(total_score AS DECIMAL(18, 3)) END AS s FROM university_ranking)
GROUP BY country
"""

PROBLEMS: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_loaded, p1_case_report, p2_found, p2_country_summary)}
PROBLEMS_SQL = {"p2_found": P2_FOUND_SQL, "p2_country_summary": P2_SUMMARY_SQL}


def _language(text: str) -> Query:
    return lambda spark, folder: query_tables(spark, text, folder)


def queries() -> dict[str, Query]:
    return PROBLEMS | source_queries.QUERIES | {name: _language(text) for name, (text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return PROBLEMS_SQL | source_queries.SQL | {name: sql for name, (_, sql) in QUERIES.items()}
