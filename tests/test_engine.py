import random
import statistics
import pytest

from loamql.api import error_info, query, query_table, query_tables
from loamql.plans.lexer import IOHandlingError, ParsingError, QueryError, RuntimeQueryError

PEOPLE = [["Ann", 1990, "x"], ["Bob", 1985, "y"], ["Cid", 1990, "x"], ["Dan", None, "z"], ["Ann", 1990, "x"]]


def rows(spark, text, table=PEOPLE, **options):
    return query_table(spark, text, table, **options).rows()


def test_header_inference(spark):
    r = query_table(spark, "select a1, a.year, NR, a2 + 1, len(a1) as n, a['k'] where a2 is not None", PEOPLE, header=["name", "year", "k"])
    assert r.header == ["name", "year", "NR", "col4", "n", "k"]
    assert r.rows()[0] == ["Ann", 1990, 1, 1991, 3, "x"]
    assert query_table(spark, "select a1, a2", PEOPLE).header is None
    assert query_table(spark, "select a1 as q, a2", PEOPLE).header == ["q", "col2"]


def test_last_of_equal_names_wins(spark):
    r = query_table(spark, "select a.d, a['']", [[1, 2, 3, 4]], header=["d", "", "d", ""])
    assert r.rows() == [[3, 4]]


def test_star_with_alias_needs_a_header(spark):
    with pytest.raises(ParsingError, match="star"):
        rows(spark, "select *, a1 as x")


def test_truthiness_and_python_fallback(spark):
    assert rows(spark, "select NR where a2") == [[1], [2], [3], [5]]
    assert rows(spark, "select a1.title() + str(a2) where NR == 1") == [["Ann1990"]]
    r = query_table(spark, "select a1.swapcase(), udf.twice(a1), helper(NR)", PEOPLE[:2], init_code="def helper(x):\n  return x * 10\n", namespace={"twice": lambda v: v * 2})
    assert r.rows() == [["aNN", "AnnAnn", 10], ["bOB", "BobBob", 20]]
    assert len(r.python_expressions) == 3


def test_python_can_be_switched_off(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ParsingError, match="switched off"):
        query("select a.x.title()", df, allow_python=False)
    assert [list(r) for r in query("select a.x.upper()", df, allow_python=False).df.collect()] == [["A"]]


def test_init_code_error(spark):
    with pytest.raises(RuntimeQueryError, match="init code"):
        rows(spark, "select foo(a1)", init_code="1 / 0")


def test_sort_is_stable_and_desc_reverses_ties(spark):
    assert rows(spark, "select NR where a2 order by a2") == [[2], [1], [3], [5]]
    assert rows(spark, "select NR where a2 order by a2 desc") == [[5], [3], [1], [2]]
    assert rows(spark, "select top 2 a1 where a2 order by a2 desc, limit 3".replace(", limit", " limit")) == [["Ann"], ["Cid"], ["Ann"]]


def test_distinct_keeps_first_occurrence(spark):
    assert rows(spark, "select distinct a1, a3") == [["Ann", "x"], ["Bob", "y"], ["Cid", "x"], ["Dan", "z"]]
    assert rows(spark, "select distinct count a3") == [[3, "x"], [1, "y"], [1, "z"]]
    assert rows(spark, "select distinct a3 order by a1 desc limit 2") == [["z"], ["x"]]


def test_aggregates(spark):
    got = rows(spark, "select a3, count(a2), min(a2), max(a2), sum(a2), avg(a2), median(a2), variance(a2), any_value(a1), array_agg(a1) group by a3")
    assert got == [
        ["x", 3, 1990, 1990, 5970, 1990.0, 1990.0, 0.0, "Ann", ["Ann", "Cid", "Ann"]],
        ["y", 1, 1985, 1985, 1985, 1985.0, 1985.0, 0.0, "Bob", ["Bob"]],
        ["z", 1, None, None, 0, None, None, None, "Dan", ["Dan"]],
    ]


def test_array_agg_keeps_nulls_and_takes_a_callback(spark):
    assert rows(spark, "select array_agg(a2, lambda v: len(v)), array_agg(a1, lambda v: '|'.join(sorted(v)))") == [[5, "Ann|Ann|Bob|Cid|Dan"]]
    assert rows(spark, "select ARRAY_AGG(a2) group by a3")[2] == [[None]]


def test_numbers_in_text(spark):
    assert rows(spark, "select max(a1), sum(a1), min(a1)", [["9"], ["10"], ["-3"]]) == [[10, 16, -3]]
    assert rows(spark, "select max(a1), sum(a1)", [["9"], ["10.5"]]) == [[10.5, 19.5]]
    with pytest.raises(Exception):  # noqa: B017, PT011
        rows(spark, "select max(a1)", [["9"], ["x"]])


def test_empty_aggregate_has_no_row(spark):
    assert rows(spark, "select count(*), max(a2) where a1 == 'none'") == []


def test_overloaded_builtins(spark):
    assert rows(spark, "select max(a2, 1988), min(5, 3) where a2 and NR < 3") == [[1990, 3], [1988, 3]]
    assert rows(spark, "select sum([1, 2]), max([3, 4]) limit 1") == [[3, 4]]


def test_group_checks(spark):
    with pytest.raises(Exception, match="non-constant"):
        rows(spark, "select a3, a1, count(1) group by a3")
    assert rows(spark, "select a1, a3, count(1) group by a1")[0] == ["Ann", "x", 2]
    for bad in ("select max(a2) order by a1", "select distinct max(a2)", "select max(a2) / 2", "select a1, [max(a2)]"):
        with pytest.raises(ParsingError):
            rows(spark, bad)


B = [["x", 1, "p"], ["x", 2, "q"], ["y", 3, "r"]]


def test_joins(spark):
    assert rows(spark, "select a1, b2, bNR join b on a3 == b1", join_rows=B)[:3] == [["Ann", 1, 1], ["Ann", 2, 2], ["Bob", 3, 3]]
    left = rows(spark, "select a1, b2, bNR, bNF left join B on b1 == a3", join_rows=B)
    assert left[5] == ["Dan", None, None, 3] and len(left) == 8
    with pytest.raises(Exception, match="STRICT LEFT JOIN"):
        rows(spark, "select a1 strict left join b on a3 == b1", join_rows=B)
    assert rows(spark, "select a1, b2 strict left join b on a3 == b1 where a3 == 'y'", [["Bob", 1, "y"]], join_rows=B) == [["Bob", 3]]


def test_join_keys(spark):
    assert rows(spark, "select a1 join b on a1 == b1", [[None], ["k"]], join_rows=[[None]]) == [[None]]
    assert rows(spark, "select a1 join b on a1 == b1", [[1], [2]], join_rows=[[1.0]]) == [[1]]
    assert rows(spark, "select a1 join b on a1 == b1", [["1"]], join_rows=[[1]]) == []
    assert rows(spark, "select a1, b1 join b on NR == bNR", [["u"], ["v"]], join_rows=[["p"], ["q"], ["r"]]) == [["u", "p"], ["v", "q"]]
    nan = float("nan")
    assert rows(spark, "select a1 join b on a1 == b1", [[nan], [2.0]], join_rows=[[nan], [2.0]]) == [[2.0]]


def test_join_errors(spark):
    with pytest.raises(ParsingError, match="not supported"):
        rows(spark, "select a1 join b on a1 == b1")
    with pytest.raises(ParsingError, match="Unable to find join table"):
        rows(spark, "select a1 join c on a1 == b1", join_rows=B)
    with pytest.raises(IOHandlingError, match="Inconsistent modes"):
        query_table(spark, "select a1 join b on a1 == b1", PEOPLE, B, header=["n", "y", "k"])


def test_update(spark):
    assert rows(spark, "update a1 = a3, a3 = a1 where NR < 3 limit 1")[:3] == [["x", 1990, "Ann"], ["y", 1985, "Bob"], ["Cid", 1990, "x"]]
    assert rows(spark, "update set a2 = 'old' where a2 == 1985")[:2] == [["Ann", "1990", "x"], ["Bob", "old", "y"]]
    got = rows(spark, "update a1 = b3 join b on a3 == b1 where NR > 0", [["n", 0, "y"], ["m", 0, "w"]], join_rows=B)
    assert got == [["r", 0, "y"], ["m", 0, "w"]]
    got = rows(spark, "update a1 = b3 left join b on a3 == b1", [["n", 0, "y"], ["m", 0, "w"]], join_rows=B)
    assert got == [["r", 0, "y"], [None, 0, "w"]]
    with pytest.raises(Exception, match="More than one record"):
        rows(spark, "update a1 = b3 join b on a3 == b1", join_rows=B)
    with pytest.raises(QueryError, match="a7"):
        rows(spark, "update a7 = 1")


def test_unnest(spark):
    assert rows(spark, "select NR, unnest(a1.split('n')) where NR < 3") == [[1, "A"], [1, ""], [1, ""], [2, "Bob"]]
    assert rows(spark, "select UNNEST([x for x in a1.split('n') if x == 'q'])") == []
    with pytest.raises(ParsingError, match="Only one UNNEST"):
        rows(spark, "select unnest([1]), unnest([2])")
    assert rows(spark, "select b2, unnest(b3.split(',')) join b on a3 == b1", [["n", 0, "x"]], join_rows=B) == [[1, "p"], [2, "q"]]


def test_except_and_spread(spark):
    r = query_table(spark, "select * except a2", PEOPLE[:1], header=["n", "y", "k"])
    assert r.header == ["n", "k"] and r.rows() == [["Ann", "x"]]
    assert rows(spark, "select *a1.split(':'), NR", [["p:q"], ["r"]]) == [["p", "q", "1"], ["r", "2"]]


def test_pipes(spark):
    r = query_table(spark, "select a3 as k, count(1) as n group by a3 | select a.k where a.n > 1 |> select NR, a.k", PEOPLE)
    assert r.rows() == [[1, "x"]] and r.header == ["NR", "k"]
    assert rows(spark, "select a1 where a2 order by a2 desc | select NR, a1")[0] == [1, "Ann"]


def test_ragged_records(spark):
    ragged = [["a", "1"], ["b"], ["c", "3", "z"]]
    assert rows(spark, "select NF, a2, a3", ragged) == [[2, "1", None], [1, None, None], [3, "3", "z"]]
    assert rows(spark, "update a1 = 'k' where NF == 1", ragged) == [["a", "1"], ["k"], ["c", "3", "z"]]
    assert rows(spark, "select * except a1", ragged) == [["1"], [], ["3", "z"]]
    with pytest.raises(Exception, match="a2"):
        rows(spark, "select a1 join b on a2 == b1", ragged, join_rows=[["1"]])
    assert "not consistent" in query_table(spark, "select a1", ragged).warnings[0]


def test_record_numbers_over_several_files(spark, tmp_path):
    spark.range(0, 1000, 1, 5).selectExpr("id", "id % 7 as k").write.parquet(str(tmp_path / "t.parquet"))
    got = query_tables(spark, "SELECT NR AS nr, a.id AS id FROM t WHERE a.k == 3", str(tmp_path))
    assert got.filter("nr != id + 1").count() == 0 and got.count() == 143
    got = query_tables(spark, "SELECT a.id AS id FROM t WHERE a.k == 3 | SELECT NR AS nr, a.id AS id", str(tmp_path))
    assert [tuple(r) for r in got.orderBy("nr").limit(3).collect()] == [(1, 3), (2, 10), (3, 17)]


def test_frames_with_equal_names_decimals_and_random_order(spark):
    df = spark.sql("select 1 as x, 'p' as x, cast(2.5 as decimal(10,2)) as d, timestamp'2020-01-02 03:04:05' as t, array(1, 2) as l")
    r = query("select a.x, a1, a.d * 2 as d, a.t.year, len(a.l), a.l[0]", df)
    assert [list(x) for x in r.df.collect()] == [["p", 1, 5.0, 2020, 2, 1]] and r.header == ["x", "x", "d", "col4", "col5", "col6"]
    assert sorted(x[0] for x in query("select a.id order by random.random()", spark.range(20)).df.collect()) == list(range(20))
    clash = spark.sql("select 1 as __nr, 2 as c1, 3 as a1, 4 as __o0")
    assert [list(x) for x in query("select a1, a2, a3, a4, NR", clash).df.collect()] == [[1, 2, 3, 4, 1]]


def test_empty_tables(spark):
    assert rows(spark, "select a1, NR where a1 order by a1", []) == []
    assert query_table(spark, "select a.x, max(a.x) group by a.x", [], header=["x"]).rows() == []


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 2 as z").write.parquet(str(tmp_path / "t.parquet"))
    df = query_tables(spark, "SELECT a.id AS i FROM t WHERE a.id > 50 and a.s == '77'", str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "z:bigint" not in plan and "GreaterThan(id,50)" in plan
    assert "Python" not in plan and "Exchange" not in plan


def test_errors_name_the_record(spark):
    with pytest.raises(RuntimeQueryError, match="At record 3, Details: .*zero"):
        rows(spark, "select NR, [10 / (3 - NR), {1: 2}][0]")


def test_hints(spark):
    for text, hint in (("select a1 group by a1 having a1 > 2", "no HAVING"), ("select a1 where a1 like 'x%'", "LIKE is a function"), ("select a1 from t", "FROM names")):
        with pytest.raises(ParsingError, match=hint):
            rows(spark, text)


def test_error_kinds():
    assert error_info(ParsingError("x"))[0] == "query parsing"
    assert error_info(RuntimeQueryError("x"))[0] == "query execution"
    assert error_info(IOHandlingError("x"))[0] == "IO handling"
    assert error_info(SyntaxError("x"))[0] == "syntax error"
    assert error_info(ValueError("x"))[0] == "unexpected"


def test_types_of_python_expressions_over_all_rows(spark):
    df = spark.createDataFrame([(n, n % 2) for n in range(200)], "n int, g int").coalesce(1)
    late = "select a.n, udf.f(a.n) as v order by udf.f(a.n) desc limit 2"
    numbers = query(late, df, namespace={"f": lambda n: None if n < 100 else n}).df.collect()
    assert [list(r) for r in numbers] == [[199, 199], [198, 198]]
    floats = query("select udf.f(a.n) as v", df, namespace={"f": lambda n: n if n < 100 else n + 0.5}).rows()
    assert floats == [[float(n)] if n < 100 else [n + 0.5] for n in range(200)]
    texts = query("select udf.f(a.n) as v", df, namespace={"f": lambda n: n if n < 100 else "x"}).rows()
    assert texts == [[str(n)] if n < 100 else ["x"] for n in range(200)]
    lists = query("select udf.f(a.n) as v", df, namespace={"f": lambda n: [] if n < 100 else [[n], [0.5]]}).rows()
    assert lists[0] == [[]] and lists[150] == [[[150.0], [0.5]]]


def test_types_of_array_agg_callbacks_over_all_groups(spark):
    df = spark.createDataFrame([(n, n // 100) for n in range(200)], "n int, g int").coalesce(1)
    r = query("select a.g as g, ARRAY_AGG(a.n, udf.f) as v group by a.g", df, namespace={"f": lambda v: len(v) if v[0] < 100 else sum(v) / 7})
    assert r.rows() == [[0, 100.0], [1, sum(range(100, 200)) / 7]]


@pytest.mark.parametrize("aggregate", ["MIN", "MAX", "SUM", "AVG", "VARIANCE", "MEDIAN"])
def test_strict_nulls(spark, aggregate):
    df = spark.createDataFrame([(1, 1.5, "1"), (2, None, None), (None, 2.5, "2")], "n int, x double, t string")
    for field in "nxt":
        text = f"select {aggregate}(a.{field}) as v"
        assert query(text, df).rows()[0][0] is not None
        with pytest.raises(Exception, match=f"{aggregate} of a null value"):
            query(text, df, strict_nulls=True).rows()
        assert query(text, df.dropna(), strict_nulls=True).rows()[0][0] is not None


def test_limit_without_order_reads_the_first_tasks_only(spark, tmp_path):
    spark.range(0, 400_000).selectExpr("id", "if(id < 1000, '7', 'x') as v").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.option("maxPartitionBytes", 100_000).parquet(str(tmp_path / "t"))
    r = query("select a.id, int(a.v) where a.id >= 5 limit 3", df)  # a later v is no number
    assert r.rows() == [[5, 7], [6, 7], [7, 7]]
    assert query("select a.id limit 2 | select a1 * 2", df).rows() == [[0], [2]]


def test_median_keeps_whole_numbers(spark):
    assert query_table(spark, "select a1, median(a2) group by a1", [["x", 1], ["x", 2], ["x", 3], ["y", 5], ["y", 5], ["z", None]]).rows() == [["x", 2], ["y", 5], ["z", None]]
    assert query_table(spark, "select median(a2), median(a2 * 0.5), median(a1), count(*)", [["1", 1], ["2", 2], ["4", 4], ["10", 9]]).rows() == [[3.0, 1.5, 3.0, 4]]
    rng = random.Random(2)
    rows = [[rng.choice("abc"), rng.randrange(50)] for _ in range(500)]
    want = {k: statistics.median([v for g, v in rows if g == k]) for k in "abc"}
    assert {k: v for k, v in query_table(spark, "select a1, median(a2) group by a1", rows).rows()} == want


def test_constant_columns_are_told_apart(spark):
    for rows, good in (([["x", 1], ["x", 1]], True), ([["x", 1], ["x", 2]], False), ([["x", 1], ["x", None]], False), ([["x", None], ["x", None]], True)):
        run = lambda rows=rows: query_table(spark, "select a1, count(*), a2 group by a1", rows).rows()
        if good:
            assert run() == [["x", 2, rows[0][1]]]
        else:
            with pytest.raises(Exception, match="non-constant values in output column 3"):  # noqa: PT011
                run()


def test_decimals_stay_exact(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("0.1"),), (Decimal("0.2"),)], "d decimal(38,18)")
    assert query("select sum(a.d), max(a.d), avg(a.d)", df).rows() == [[Decimal("0.3"), Decimal("0.2"), pytest.approx(0.15)]]
    assert query("select a.d, a.d * 2 limit 1", df).rows() == [[Decimal("0.1"), 0.2]]


def test_numbers_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception) as e:  # noqa: PT011
        query_table(spark, "select a1 * a1", [[2**40]]).rows()
    assert error_info(e.value) == ("query execution", "a whole number is beyond 64 bits")


def test_keys_twice_in_the_other_table(spark):
    many = [["k", n] for n in range(50)]
    with pytest.raises(Exception, match="exactly one match"):  # noqa: PT011
        query_table(spark, "select a1, b2 strict left join b on a1 == b1", [["k"]], many).rows()
    assert query_table(spark, "select a1, b2 strict left join b on a1 == b1", [["j"], [None]], [*many, ["j", 7], [None, 8]]).rows() == [["j", 7], [None, 8]]


def test_texts_as_numbers_take_one_pass(spark):
    rows = [["1", "1.5", "2"], ["3", "2", "x"[:0] or "4"]]
    assert query_table(spark, "select sum(a1), sum(a2), max(a3), avg(a1)", rows).rows() == [[4, 3.5, 4, 2.0]]
