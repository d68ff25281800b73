"""Percentiles per group from summaries that can be combined, with a deterministic rank error.

A q-digest over a bounded universe. Values are quantised to ordered codes of ``UNIVERSE_BITS`` bits:
exact below 2**MANTISSA_BITS, above that the leading MANTISSA_BITS bits of the value, so a code's
values differ by less than 2**-(MANTISSA_BITS - 1) of themselves. A digest holds counts on nodes of
the dyadic tree over the codes (root 1, children 2i and 2i+1, leaves 2**UNIVERSE_BITS + code). Nodes
whose count with sibling and parent is at most n / k move to the parent; so a digest has at most
about 3k nodes, and the rank of any answer is off by at most UNIVERSE_BITS / k of n. Digests are
merged by adding counts of equal nodes and compressing again; the bound holds for the sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANTISSA_BITS = 11
UNIVERSE_BITS = 16  # with 11 mantissa bits enough for the codes of all 63-bit numbers
COMPRESSION = 3200  # k: rank error at most 16 / 3200 = 0.5 %


def code_of(value: Column) -> Column:
    """The code of a non-negative whole number of up to 63 bits."""
    v = value.cast("long")
    shifted = lambda by: F.call_function("shiftright", v, by.cast("int"))
    top = F.least(F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))), F.lit(62))  # the highest bit, or one off by rounding
    top = top + (shifted(top + 1) > 0).cast("int") - (shifted(top) == 0).cast("int")
    bits = F.when(v <= 0, F.lit(0)).otherwise(top + 1)
    shift = F.greatest(bits - F.lit(MANTISSA_BITS), F.lit(0)).cast("int")
    return shift.cast("long") * F.lit(1 << (MANTISSA_BITS - 1)) + F.call_function("shiftright", v, shift)


def values_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole number of each code."""
    code = np.asarray(code, np.int64)
    half = 1 << (MANTISSA_BITS - 1)
    shift = np.maximum(code // half - 1, 0)
    mantissa = code - shift * half
    return mantissa << shift, (mantissa << shift) + ((1 << shift) - 1)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """The digest of node counts (repeated nodes are added), nodes ascending."""
    order = np.argsort(nodes, kind="stable")
    nodes, counts = np.asarray(nodes, np.int64)[order], np.asarray(counts, np.int64)[order]
    keep = np.r_[True, nodes[1:] != nodes[:-1]] if len(nodes) else np.zeros(0, bool)
    counts = np.add.reduceat(counts, np.flatnonzero(keep)) if len(nodes) else counts
    nodes = nodes[keep]
    limit = int(counts.sum()) // k
    if not limit:  # fewer than k values stay as they are
        return nodes, counts
    done_nodes, done_counts = [], []
    for level in range(UNIVERSE_BITS, 0, -1):
        at = nodes >> level == 1
        low, low_counts = nodes[at], counts[at]
        nodes, counts = nodes[~at], counts[~at]
        if not len(low):
            continue
        parents, index = np.unique(low >> 1, return_inverse=True)
        pair = np.bincount(index, weights=low_counts, minlength=len(parents)).astype(np.int64)
        place = np.searchsorted(nodes, parents)
        there = (place < len(nodes)) & (nodes[np.minimum(place, max(len(nodes) - 1, 0))] == parents) if len(nodes) else np.zeros(len(parents), bool)
        own = np.where(there, counts[np.minimum(place, max(len(nodes) - 1, 0))] if len(nodes) else 0, 0)
        up = pair + own <= limit
        stay = ~up[index]
        done_nodes.append(low[stay])
        done_counts.append(low_counts[stay])
        old = np.isin(nodes, parents[up], invert=True)
        nodes = np.r_[nodes[old], parents[up]]
        counts = np.r_[counts[old], (pair + own)[up]]
        order = np.argsort(nodes, kind="stable")
        nodes, counts = nodes[order], counts[order]
    nodes, counts = np.concatenate([nodes, *done_nodes]), np.concatenate([counts, *done_counts])
    order = np.argsort(nodes, kind="stable")
    return nodes[order], counts[order]


def quantile(nodes: np.ndarray, counts: np.ndarray, shares: Iterable[float]) -> list[tuple[int, int]]:
    """The least and greatest value of the code that answers each share, the lower median for 0.5."""
    nodes, counts = np.asarray(nodes, np.int64), np.asarray(counts, np.int64)
    level = np.frexp(nodes.astype(np.float64))[1] - 1
    depth = UNIVERSE_BITS - level
    right = ((nodes - (1 << level) + 1) << depth) - 1
    order = np.lexsort((depth, right))
    right, total = right[order], np.cumsum(counts[order])
    answers = []
    for share in shares:
        rank = max(int(np.ceil(share * total[-1])), 1)
        code = right[np.searchsorted(total, rank)]
        low, high = values_of(code)
        answers.append((int(low), int(high)))
    return answers


def digests(df: DataFrame, groups: list[str], value: str, k: int = COMPRESSION) -> DataFrame:
    """(*groups, node, n): one digest of the non-null, non-negative ``value`` per group.

    Equal codes are counted before the shuffle, so a task gets at most 2**UNIVERSE_BITS rows of a
    group, however many rows the group has. Negative values and nulls are left out; a group without
    a value has no digest.
    """
    leaves = df.filter(F.col(value) >= 0).select(*groups, (code_of(F.col(value)) + F.lit(1 << UNIVERSE_BITS)).alias("node")).groupBy(*groups, "node").agg(F.count(F.lit(1)).alias("n"))
    return _compressed(leaves, groups, k)


def merge(parts: DataFrame, groups: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digests of fewer, larger groups from the digests ``parts``: counts of equal nodes are added."""
    return _compressed(parts.groupBy(*groups, "node").agg(F.sum("n").alias("n")), groups, k)


def _compressed(counts: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Each group's nodes are listed, at most 2**(UNIVERSE_BITS + 1) of them, compressed and spread again."""
    schema = counts.select(*groups, F.col("node").cast("long"), F.col("n").cast("long")).schema
    keys = [f"__k{i}" for i in range(len(groups))]
    listed = counts.groupBy(*(F.col(g).alias(x) for g, x in zip(groups, keys))).agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("n").cast("long").alias("n"))).alias("__nodes"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(keys))
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            nodes, sums = flat.field("node").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            parts = [compress(nodes[a:b], sums[a:b], k) for a, b in zip(ends[:-1], ends[1:])]
            at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts]), pa.int64())
            made = [np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.array(made[0]), pa.array(made[1])], names=schema.names)

    return listed.mapInArrow(work, schema)


def percentiles(digest: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(*groups, n, share, low, high): ``low`` to ``high`` is the code that holds the percentile."""
    fields = digest.select(*groups).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n long, share double, low long, high long"])

    def work(pdf):  # noqa: ANN001, ANN202
        out = pdf[groups].iloc[np.zeros(len(shares), int)].reset_index(drop=True)
        found = quantile(pdf["node"].to_numpy(), pdf["n"].to_numpy(), shares)
        return out.assign(n=int(pdf["n"].sum()), share=shares, low=[a for a, _ in found], high=[b for _, b in found])

    return digest.groupBy(*groups).applyInPandas(work, schema)


def region_label(column: str) -> Column:
    """A region in one form: blanks trimmed and joined, upper case; null if nothing is left."""
    text = F.upper(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")))
    return F.when(text != "", text)


# The least and greatest value that each field can have.
BOUNDS = {"gdp_per_capita": (1, 1_000_000), "population": (1, 20_000_000_000)}


def measured(stats: DataFrame, extra: list[str], countries: DataFrame | None = None) -> DataFrame:
    """(region, *extra, field, value): values that the field can have, each delivery once.

    A row without a region has that of its country in ``countries``; a row without either is in no region
    and left out.

    Rows of one (feed_id, country_id, snapshot_day) with the same figures and region are one row
    that was delivered again; it counts once. Corrections with other figures count by themselves.
    """
    keys = [c for c in ("feed_id", "country_id", "snapshot_day") if c in stats.columns]
    rows = stats.select(*keys, region_label("region").alias("region"), *BOUNDS)
    if countries is not None:
        home = countries.select("country_id", region_label("region").alias("__home")).groupBy("country_id").agg(F.min("__home").alias("__home"))
        rows = rows.join(home, "country_id", "left").withColumn("region", F.coalesce("region", "__home")).select(*keys, "region", *BOUNDS)
    once = rows.filter(F.col("region").isNotNull()).distinct()
    fields = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).between(*b), F.col(f).cast("long")).alias("value")) for f, b in BOUNDS.items()]
    return once.select("region", *extra, F.inline(F.array(*fields))).filter(F.col("value").isNotNull())


SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def feed_digests(stats: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """One digest per (region, feed_id, year of snapshot_day, field)."""
    rows = measured(stats, ["feed_id", F.year("snapshot_day").alias("year")], countries)
    return digests(rows, ["region", "feed_id", "year", "field"], "value")


def region_percentiles(stats: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Percentiles of each field per region, from the digests of its feeds and years."""
    merged = merge(feed_digests(stats, countries), ["region", "field"])
    return percentiles(merged, ["region", "field"], SHARES)


def country_percentiles(stats: DataFrame) -> DataFrame:
    """Percentiles of each field per country_id, whatever the region; exact but for the width of a code
    where a country has fewer than COMPRESSION values."""
    keys = ["feed_id", "country_id", "snapshot_day", *BOUNDS]
    once = stats.filter(F.col("country_id").isNotNull()).select(*keys).distinct()
    fields = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).between(*b), F.col(f).cast("long")).alias("value")) for f, b in BOUNDS.items()]
    rows = once.select("country_id", F.inline(F.array(*fields))).filter(F.col("value").isNotNull())
    return percentiles(digests(rows, ["country_id", "field"], "value"), ["country_id", "field"], SHARES)


def region_percentiles_checked(stats: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Each answer beside its true rank: ``below`` values are less than its code and ``upto`` not above
    it, and ``within`` says whether the rank asked for is within the stated error of those."""
    answers = region_percentiles(stats, countries)
    counts = measured(stats, [], countries).withColumn("code", code_of(F.col("value"))).groupBy("region", "field", "code").agg(F.count(F.lit(1)).alias("c"))
    # at most 2**UNIVERSE_BITS codes of a region and field
    upto = F.sum("c").over(Window.partitionBy("region", "field").orderBy("code"))
    ranks = counts.select("region", "field", "code", upto.alias("upto"), (upto - F.col("c")).alias("below"))
    spread = ranks.groupBy("region", "field").agg(F.collect_list(F.struct("code", "below", "upto")).alias("ranks"))
    asked = answers.withColumn("code", code_of(F.col("low"))).join(spread, ["region", "field"])
    here = F.filter("ranks", lambda r: r["code"] <= F.col("code"))
    less = F.filter("ranks", lambda r: r["code"] < F.col("code"))
    asked = asked.withColumn("upto", F.coalesce(F.array_max(F.transform(here, lambda r: r["upto"])), F.lit(0)))
    asked = asked.withColumn("below", F.coalesce(F.array_max(F.transform(less, lambda r: r["upto"])), F.lit(0)))
    slack = F.col("n") * F.lit(UNIVERSE_BITS / COMPRESSION) + 1
    rank = F.col("n") * F.col("share")
    return asked.select("region", "field", "n", "share", "low", "high", "below", "upto", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("within"))
