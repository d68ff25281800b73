import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamql.llm import quantiles as q
from loamql.llm import topn

RANKING = "ranking_id bigint, list_id bigint, country string, university_name string, total_score double, rank int, __size int"


def ranking(seed=1):
    rng = random.Random(seed)
    rows = []
    for n in range(4000):
        score = rng.choice([None, float("nan"), 100.0, 99.5, -1.0, 101.0, round(rng.random() * 100, 1)])
        rows.append((n, rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["A"] * 9 + ["B", "c", None]), rng.choice(["u", "U", "é", None, "u2"]), score, 0, 0))
    return rows + rows[:50]


@pytest.mark.parametrize("heavy", [1, 30, 10**9])
def test_top_n_is_the_same_for_light_and_heavy_groups(spark, heavy):
    rows = ranking()
    ranked = spark.createDataFrame(rows, RANKING).drop("rank", "__size")
    countries = spark.createDataFrame([("A",), ("B",), (None,), ("B",)], "country string")
    got = topn.top_universities(ranked, countries, 3, heavy)
    groups = {}
    for ident, lst, country, name, score, *_ in rows:
        if country in ("A", "B") and name is not None and score is not None and 0 <= score <= 100:
            groups.setdefault((lst, country), []).append((-score, name, ident))
    want = sorted((i, r + 1) for g in groups.values() for r, (_, _, i) in enumerate(sorted(g)[:3]))
    assert sorted((r.ranking_id, r["rank"]) for r in got.collect()) == want


def test_heavy_parts_are_small(spark):
    rows = [(n, 1, "A", "u", 50.0) for n in range(3000)]
    df = spark.createDataFrame(rows, "ranking_id bigint, list_id bigint, country string, university_name string, total_score double")
    order = [F.col("total_score").desc(), F.col("ranking_id").asc()]
    got = topn.top_n(df, ["list_id", "country"], order, ["ranking_id"], 5, F.floor("total_score"), heavy_rows=100, part_rows=50)
    assert [r.ranking_id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("hot_groups", [1, 2, 100])
def test_any_number_of_heavy_groups(spark, hot_groups):
    """However few groups may be treated as heavy, the rows are the same; hashes tell nulls apart."""
    rng = random.Random(9)
    rows = [(n, g, h, rng.choice([None, 1.0, 2.0, 2.0])) for n, (g, h) in enumerate([(None, "a"), ("a", None), ("a", "a"), (None, None)] * 200)]
    df = spark.createDataFrame(rows, "i bigint, g string, h string, s double")
    order = [F.col("s").desc_nulls_last(), F.col("i").asc()]
    got = topn.top_n(df, ["g", "h"], order, ["i"], 4, F.floor("s"), heavy_rows=10, part_rows=20, hot_groups=hot_groups)
    want = set()
    for key in {r[1:3] for r in rows}:
        best = sorted((r for r in rows if r[1:3] == key), key=lambda r: (-(r[3] or 0.0), r[0]))[:4]
        want |= {(r[0], n + 1) for n, r in enumerate(best)}
    assert {(r.i, r["rank"]) for r in got.collect()} == want


def test_rows_below_the_range_that_matters_are_not_moved(spark):
    """Of a heavy group only rows of its top ranges reach a window."""
    df = spark.range(0, 40_000).selectExpr("id as i", "1 as g", "cast(id % 100 as double) as s")
    out = topn.top_n(df, ["g"], [F.col("s").desc(), F.col("i").asc()], ["i"], 3, F.floor("s"), heavy_rows=1000)
    assert [r.i for r in out.orderBy("rank").collect()] == [99, 199, 299]
    assert "__least" in out._jdf.queryExecution().optimizedPlan().toString()


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], RANKING).drop("rank", "__size")
    assert topn.top_universities(empty, spark.createDataFrame([], "country string")).collect() == []


def codes(spark, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v bigint")
    return [r[0] for r in df.select("n", q.code_of(F.col("v")).alias("c")).orderBy("n").select("c").collect()]


def test_codes_keep_order_and_bound_values(spark):
    rng = random.Random(2)
    values = sorted({0, 1, 2047, 2048, 4095, 4096, 2**62, 2**63 - 1, *(rng.randrange(2 ** rng.randrange(1, 63)) for _ in range(3000))})
    got = codes(spark, values)
    assert got == sorted(got) and got[-1] < 1 << q.UNIVERSE_BITS
    low, high = q.values_of(np.array(got))
    assert all(a <= v <= b and b - a <= a >> (q.MANTISSA_BITS - 1) for v, a, b in zip(values, low.tolist(), high.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 55_000), st.integers(1, 60)), min_size=1, max_size=300), st.sampled_from([10, 50, 400]))
def test_rank_error(pairs, k):
    def digest(part):
        leaves = np.array([c for c, _ in part]) + (1 << q.UNIVERSE_BITS)
        return q.compress(leaves, np.array([n for _, n in part]), k)

    third = max(1, len(pairs) // 3)
    parts = [digest(pairs[i : i + third]) for i in range(0, len(pairs), third)]
    nodes, counts = q.compress(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)
    total = sum(n for _, n in pairs)
    assert counts.sum() == total and len(nodes) <= 3 * k + q.UNIVERSE_BITS
    values = np.sort(np.repeat([c for c, _ in pairs], [n for _, n in pairs]))
    # each merge may lose as much as one compression
    slack = 2 * q.UNIVERSE_BITS / k * total + 1
    for share, (low, _) in zip((0.0, 0.1, 0.5, 0.9, 1.0), q.quantile(nodes, counts, (0.0, 0.1, 0.5, 0.9, 1.0))):
        code = next(c for c in range(1 << 16) if q.values_of(c)[0] == low) if low < 2048 else int(codes_of(low))
        below, upto = np.searchsorted(values, code, "left"), np.searchsorted(values, code, "right")
        assert below <= share * total + slack and upto >= share * total - slack


def codes_of(value):
    shift = max(int(value).bit_length() - q.MANTISSA_BITS, 0)
    return shift * (1 << (q.MANTISSA_BITS - 1)) + (int(value) >> shift)


def test_small_digests_are_exact(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 1, 9, 3, None, -4]] + [("h", None)], "g string, v bigint")
    got = q.percentiles(q.digests(df, ["g"], "v"), ["g"], [0.25, 0.5, 1.0]).orderBy("share").collect()
    assert [(r.g, r.n, r.low, r.high) for r in got] == [("g", 4, 1, 1), ("g", 4, 3, 3), ("g", 4, 9, 9)]


STATS = "stat_id bigint, feed_id int, country_id int, snapshot_day date, region string, population bigint, area_square_miles int, gdp_per_capita int"


def test_regions_in_any_form_and_deliveries(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    rows = [
        (1, 1, 1, day, "INNER  SHELF ", 100, 1, 10), (2, 1, 1, day, "Inner Shelf", 100, 1, 10), (3, 1, 2, day, " inner shelf", 300, 1, 20),
        (4, 2, 1, day, "INNER SHELF", -99, 1, 999999999), (5, 2, 2, day, None, 5, 1, 5), (6, 2, 2, day, "  ", 5, 1, 5), (7, 2, 3, day, "X", None, 1, None),
    ]
    out = q.region_percentiles(spark.createDataFrame(rows, STATS))
    got = {(r.region, r.field, r.share): (r.n, r.low) for r in out.collect()}
    assert got["INNER SHELF", "gdp_per_capita", 0.5] == (2, 10) and got["INNER SHELF", "population", 0.75] == (2, 300)
    assert {k[0] for k in got} == {"INNER SHELF"}
    assert q.region_percentiles(spark.createDataFrame([], STATS)).collect() == []


def test_answers_are_within_the_stated_error(spark):
    rng = random.Random(4)
    import datetime

    rows = [(n, n % 7, n, datetime.date(2011 + n % 9, 1, 1), "R", int(rng.lognormvariate(14, 3)) + 1, 1, rng.randrange(1, 90000)) for n in range(30_000)]
    checked = q.region_percentiles_checked(spark.createDataFrame(rows, STATS)).collect()
    assert len(checked) == 12 and all(r.within for r in checked)
