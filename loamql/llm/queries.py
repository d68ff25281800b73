"""The registered queries of this subpackage, and SQL with the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamql.llm import canonical, leakage, mixing, quantiles, sentences, topn
from loamql.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_top_universities(spark, folder).select("ranking_id")


def p3_top_universities(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_universities(table(spark, folder, "university_ranking"), table(spark, folder, "countries"))


P3_SQL = """
SELECT ranking_id, list_id, country, university_name, total_score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY list_id, country ORDER BY total_score DESC, university_name, ranking_id) AS INTEGER) AS rank
  FROM university_ranking WHERE country IN (SELECT country FROM countries) AND university_name IS NOT NULL
    AND total_score IS NOT NULL AND NOT isnan(total_score) AND total_score BETWEEN 0 AND 100)
WHERE rank <= 3
"""


def _stats(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "country_stats"), table(spark, folder, "countries")


def p4_region_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.region_percentiles(*_stats(spark, folder))


def p4_feed_digests(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.feed_digests(*_stats(spark, folder))


def p4_percentiles_checked(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.region_percentiles_checked(*_stats(spark, folder))


def p4_country_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.country_percentiles(table(spark, folder, "country_stats"))


# the least and greatest number of the code that holds the exact percentile; exact below 3200 values a country
P4_COUNTRY_SQL = """
WITH once AS (SELECT DISTINCT feed_id, country_id, snapshot_day, gdp_per_capita, population FROM country_stats WHERE country_id IS NOT NULL),
     long AS (SELECT country_id, 'gdp_per_capita' AS field, CAST(gdp_per_capita AS BIGINT) AS v FROM once WHERE gdp_per_capita BETWEEN 1 AND 1000000
              UNION ALL SELECT country_id, 'population', population FROM once WHERE population BETWEEN 1 AND 20000000000),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY country_id, field ORDER BY v) AS r, count(*) OVER (PARTITION BY country_id, field) AS n FROM long),
     asked AS (SELECT country_id, field, n, share, v, greatest(length(format('{:b}', v)) - 11, 0) AS shift
               FROM ranked, (SELECT CAST(unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS DOUBLE) AS share) WHERE r = greatest(ceil(share * n), 1))
SELECT country_id, field, n, share, (v >> shift) << shift AS low, ((v >> shift) << shift) + (1::BIGINT << shift) - 1 AS high FROM asked
"""


def p4_error_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each answer is within the stated rank error, beside the number of values it stands for."""
    return p4_percentiles_checked(spark, folder).select("region", "field", "n", "share", "within")


P4_BOUND_SQL = """
WITH home AS (SELECT country_id, min(nullif(upper(trim(regexp_replace(region, '\\s+', ' ', 'g'))), '')) AS home FROM countries GROUP BY 1),
     once AS (SELECT DISTINCT feed_id, country_id, snapshot_day, coalesce(nullif(upper(trim(regexp_replace(region, '\\s+', ' ', 'g'))), ''), home) AS region,
                     gdp_per_capita, population
              FROM country_stats LEFT JOIN home USING (country_id)),
     long AS (SELECT region, 'gdp_per_capita' AS field FROM once WHERE gdp_per_capita BETWEEN 1 AND 1000000
              UNION ALL SELECT region, 'population' FROM once WHERE population BETWEEN 1 AND 20000000000)
SELECT region, field, n, CAST(share AS DOUBLE) AS share, true AS within
FROM (SELECT region, field, count(*) AS n FROM long WHERE region <> '' GROUP BY 1, 2), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS share)
"""


def p4_countries_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = quantiles.measured(table(spark, folder, "countries"), [])
    return quantiles.percentiles(quantiles.digests(rows, ["region", "field"], "value"), ["region", "field"], quantiles.SHARES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    out = canonical.map_countries(table(spark, folder, "university_ranking"), table(spark, folder, "countries"))
    return out.select("ranking_id", "country_id")


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that mean no entry, with their rows."""
    out = canonical.map_countries(table(spark, folder, "university_ranking"), table(spark, folder, "countries"))
    return out.filter("country_id = 0").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_item_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, folder, "documents")), table(spark, folder, "source_targets"))[1]


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, folder, "documents")), table(spark, folder, "source_targets"))[0]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


def p7_mix_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The mix with the texts' characters as sizes and keys that SQL can make: of an md5 and the length as weight."""
    unit = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = F.greatest(F.least(F.length("text") / 200.0, F.lit(1.0)), F.lit(0.01))
    docs = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    sized = docs.select("doc_id", mixing.source_label("source").alias("source"), F.length("text").cast("long").alias("tokens"), (-F.log(unit) / weight).alias("key"))
    return mixing.mix(sized, table(spark, folder, "source_targets"))[0]


P7_LENGTH_SQL = """
WITH docs AS (SELECT doc_id, lower(trim(source)) AS source, length(text) AS tokens,
                     -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
                     / greatest(least(length(text) / 200.0::DOUBLE, 1), 0.01) AS key
              FROM documents WHERE text IS NOT NULL),
     goals AS (SELECT source, max_repeats, CAST(floor(target_share * (SELECT sum(tokens) FROM docs)) AS BIGINT) AS budget FROM source_targets),
     held AS (SELECT source, sum(tokens) AS available FROM docs GROUP BY 1),
     plan AS (SELECT source, least(budget // available, max_repeats) AS epochs,
                     CASE WHEN budget // available < max_repeats THEN budget - (budget // available) * available ELSE 0 END AS rest
              FROM goals JOIN held USING (source) WHERE available > 0),
     runs AS (SELECT doc_id, source, tokens, epochs, rest, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id) AS run
              FROM docs JOIN plan USING (source) WHERE tokens > 0)
SELECT doc_id, source, tokens, CAST(epochs + (run <= rest)::INT AS INTEGER) AS copies FROM runs WHERE epochs + (run <= rest)::INT > 0
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p3_found, p3_top_universities, p4_region_percentiles, p4_feed_digests, p4_percentiles_checked, p4_error_bound, p4_country_percentiles, p4_countries_percentiles, p5_found, p5_unmatched, p6_found, p6_item_report, p7_mix, p7_report, p7_mix_by_length, p8_found)
}
SQL = {"p3_found": f"SELECT ranking_id FROM ({P3_SQL})", "p3_top_universities": P3_SQL, "p4_error_bound": P4_BOUND_SQL, "p4_country_percentiles": P4_COUNTRY_SQL, "p7_mix_by_length": P7_LENGTH_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
