"""The N highest rows of every group, with a total order among ties, whatever the groups' sizes.

Hot-cold split by exact counts:

* Rows are counted per hash of the group. The HOT_GROUPS largest groups of more than ``heavy_rows`` rows
  are heavy; so any other group holds less than a HOT_GROUPS-th of all rows and goes through an ordinary
  window.
* The rows of heavy groups are counted per range of the leading sort value. From these counts, taken from
  the top range down, follows the range below which no row of the group can be among its first N. Rows below it are dropped where they are read. What is left, a large
  tie perhaps, is cut into salts by the rows' identity; each (group, salt) is sorted for its own first N,
  and the survivors are ranked once more per group.

Only (hash of 128 bits, range, salts) of heavy groups is sent to all tasks: 28 bytes each, whatever the
keys are. Spark prunes each window to N rows per key before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamql.session import pin

HEAVY_ROWS = 20_000  # a group of more rows is heavy
PART_ROWS = 20_000  # rows of a heavy group for one salt
HOT_GROUPS = 100_000  # heavy groups at most: 2.8 MB


def top_n(df: DataFrame, groups: list[str], order: list[Column], identity: list[str], n: int, leading_range: Column, heavy_rows: int = HEAVY_ROWS, part_rows: int = PART_ROWS, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """Rows of ``df`` with ``rank`` (from 1, up to ``n``) in each group by ``order``.

    ``order`` has to settle every tie that matters: rows equal in all of it rank in either order.
    ``leading_range`` is an integer that never rises along ``order`` and takes few values, as the floor of
    a score that is sorted downwards, null last; ``identity`` spreads rows of one range. A null in
    ``groups`` is a group of its own; groups of fewer than ``n`` rows come out whole; an empty table gives
    no row; every repeated row counts.
    """
    columns, ids = df.columns, ["__h1", "__h2"]
    parts = [x for g in groups for x in (F.col(g).isNull(), F.col(g))]  # a hash passes over nulls
    hashes = {h: F.xxhash64(F.lit(seed), *parts) for seed, h in enumerate(ids)}
    marked = df.withColumns(hashes | {"__range": F.coalesce(leading_range.cast("long"), F.lit(-(2**63)))})
    sizes = marked.groupBy(*ids).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > heavy_rows)
    hot = pin(sizes.orderBy(F.desc("__size"), *ids).limit(hot_groups).select(*ids))
    # ranges of heavy groups only: a group has as many rows here as leading_range takes values in it
    upto = F.sum("__n").over(Window.partitionBy(*ids).orderBy(F.desc("__range")))
    ranges = marked.select(*ids, "__range").join(F.broadcast(hot), ids).groupBy(*ids, "__range").agg(F.count(F.lit(1)).alias("__n"))
    ranges = ranges.withColumn("__upto", upto).filter(F.col("__upto") >= n)
    cuts = pin(ranges.groupBy(*ids).agg(F.max("__range").alias("__least"), F.ceil(F.min("__upto") / F.lit(part_rows)).cast("int").alias("__salts")))

    joined = marked.join(F.broadcast(cuts), ids, "left")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    light = joined.filter(F.col("__least").isNull()).select(*columns)
    heavy = joined.filter(F.col("__range") >= F.col("__least")).withColumn("__salt", F.pmod(F.xxhash64(*identity), F.col("__salts")))
    part = F.row_number().over(Window.partitionBy(*groups, "__salt").orderBy(*order))
    survivors = heavy.withColumn("__part", part).filter(F.col("__part") <= n).select(*columns)
    ranked = [x.withColumn("rank", rank).filter(F.col("rank") <= n) for x in (light, survivors)]
    return ranked[0].unionByName(ranked[1])


def top_universities(ranking: DataFrame, countries: DataFrame, n: int = 3, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The ``n`` best rows of each (list_id, country), of rows whose country is a countries entry as
    stored, with a name and a score from 0 to 100; score downwards, then name, then ranking_id."""
    score = F.col("total_score")
    rows = ranking.select("ranking_id", "list_id", "country", "university_name", "total_score").filter(
        F.col("university_name").isNotNull() & score.isNotNull() & ~F.isnan(score) & score.between(0, 100)
    )
    known = rows.join(countries.select("country").distinct(), "country", "left_semi")
    order = [F.col("total_score").desc(), F.col("university_name").asc(), F.col("ranking_id").asc()]
    out = top_n(known, ["list_id", "country"], order, ["ranking_id"], n, F.floor("total_score"), heavy_rows)
    return out.select("ranking_id", "list_id", "country", "university_name", "total_score", "rank")
