"""The core's data operators against plain versions."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from loamql.operators import keychunks, rejects

CASES = "case_id bigint, csv_policy string, csv_separator string, column_spec string, with_headers boolean, expected_warnings array<string>, country string"
RECORDS = "record_id bigint, case_id bigint, record_no int, raw_text string, country string"


def sound(kind, text):
    text = text.strip(" ")
    if not text or kind not in rejects.TYPE_PATTERNS:
        return True
    if not re.fullmatch(rejects.TYPE_PATTERNS[kind], text):
        return False
    if kind == "date":
        try:
            datetime.date.fromisoformat(text)
        except ValueError:
            return False
    return True


def expected(records, cases):
    cases = {c[0]: c for c in cases}
    out = {}
    for ident, case, no, text, *_ in records:
        if case not in cases:
            continue
        _, policy, sep, spec, headed, *_ = cases[case]
        if headed and no == 1:
            continue
        columns = rejects.parse_spec(spec)
        fields = rejects.split_exactly(text or "", (policy or "").strip(" ").lower(), sep or "")
        if fields is None:
            out[ident] = "quoting"
        elif len(fields) != len(columns):
            out[ident] = "column_count"
        elif not all(sound(k, f) for (_, k), f in zip(columns, fields)):
            out[ident] = "value"
    return out


def test_exact_splitter():
    s = rejects.split_exactly
    assert s('a, "b,""c""" ,d', "quoted", ",") == ["a", 'b,"c"', "d"]
    assert s('"a" b,c', "quoted", ",") is None and s('a"b', "quoted", ",") is None and s('"a', "quoted_rfc", ",") is None
    assert s('"a"\xa0,b', "quoted", ",") is None
    assert s('"a\n,b",c', "quoted_rfc", ",") == ["a\n,b", "c"]
    assert s('"a"~#~b', "simple", "~#~") == ['"a"', "b"]
    assert s("  a  b ", "whitespace", " ") == ["a", "b"] and s("", "whitespace", " ") == []
    assert s('a,"', "monocolumn", "") == ['a,"'] and s("", "simple", ",") == [""]
    assert s("a,", "quoted", ",") == ["a", ""] and s('a," ', "quoted", ",") is None


@pytest.fixture(scope="module")
def fuzz():
    import random

    rng = random.Random(3)
    spec = "a:string,b:int,c:decimal"
    cases = [
        (1, "quoted", ",", spec, True, ["inconsistent double quote escaping"], "x"), (2, " Quoted_RFC ", ";", spec, False, None, "x"), (3, "simple", "~#~", spec, False, [], None),
        (4, "WHITESPACE", " ", "p:int,q:percent", None, None, "x"), (5, "monocolumn", "", "line:date", False, None, "x"), (6, None, None, "t:time", False, None, "x"), (7, "quoted", "\t", "n:grouped_int,m:time", False, None, "x"),
    ]
    records, n = [], 0
    for case, policy, sep, columns, *_ in cases:
        for k in range(400):
            n += 1
            bits = [rng.choice(['"', '""', sep or "", " ", "12", "-3.5", "x", "\n", "\r\n", "1,234", "50%", "101%", "2020-02-30", "2020-02-29", "23:59", "24:00", "é", " ", "", "", "\x00", "\x01", "\ue000"]) for _ in range(rng.randrange(7))]
            records.append((n, case, k % 50 + 1, rng.choice(["".join(bits), (sep or "").join(["a", "5", "1.5"]), f'"q{sep}"{sep}7{sep}'])))
    records += [(n + 1, 1, 5, None), (n + 2, 99, 1, "a"), (n + 3, 3, 2, ""), (n + 4, 4, 2, "   "), (n + 5, 1, 7, 'x,"' + "y" * 50_000 + '",'), (n + 6, 1, 8, "z," * 30_000)]
    return [(*r, "c") for r in records], cases


def test_rejects_match_a_plain_version(spark, fuzz):
    records, cases = fuzz
    got = rejects.load_records(spark.createDataFrame(records, RECORDS), spark.createDataFrame(cases, CASES)).collect()
    want = expected(records, cases)
    assert {r.record_id: r.reason for r in got if r.reason and r.reason != "unknown_case"} == want
    assert sum(r.reason == "unknown_case" for r in got) == 1
    headers = sum(r[1] == 1 and r[2] == 1 for r in records)
    assert len(got) == len(records) - headers
    texts, by_case = {r[0]: r for r in records}, {c[0]: c for c in cases}
    for r in got:
        if r.reason is None:
            case = by_case[r.case_id]
            fields = rejects.split_exactly(texts[r.record_id][3] or "", (case[1] or "").strip(" ").lower(), case[2] or "")
            assert [f.text for f in r.fields] == fields
            assert [(f.name, f.type) for f in r.fields] == rejects.parse_spec(case[3])


def test_typed_fields(spark):
    cases = [(1, "quoted", ",", "a:int,b:decimal,c:grouped_int,d:percent,e:date,f:string", False, None, "x")]
    records = [(1, 1, 1, ' 7 ,-2.50,"1,234",9%,2021-03-04,"x""y"', "c"), (2, 1, 2, ",,,,,", "c"), (3, 1, 3, f"{'9' * 30},1,1,1%,0001-01-01,", "c")]
    out = {r.record_id: r.fields for r in rejects.load_records(spark.createDataFrame(records, RECORDS), spark.createDataFrame(cases, CASES)).collect()}
    assert [int(f.whole) if f.whole is not None else None for f in out[1]] == [7, None, 1234, 9, None, None]
    assert out[1][1].number == -2.5 and out[1][4].day == datetime.date(2021, 3, 4) and out[1][5].text == 'x"y'
    assert all(f.whole is None and f.number is None and f.day is None for f in out[2])
    assert int(out[3][0].whole) == int("9" * 30)


def test_case_report(spark, fuzz):
    records, cases = fuzz
    rows = {r.case_id: r for r in rejects.case_report(spark.createDataFrame(records, RECORDS), spark.createDataFrame(cases, CASES)).collect()}
    assert set(rows) == {c[0] for c in cases}
    assert rows[1].quoting_foretold and rows[1].quoting_as_foretold and rows[2].quoting_foretold is None and rows[3].quoting_foretold is False
    assert all(r.n_records == r.n_loaded + r.n_quoting + r.n_column_count + r.n_value for r in rows.values())


def test_rejects_of_empty_tables(spark):
    assert rejects.rejected(spark.createDataFrame([], RECORDS), spark.createDataFrame([], CASES)).collect() == []


KEYED = [("a", "u1", 1.0)] * 50 + [("a", "u2", None)] * 7 + [("b", None, 2.0)] * 3 + [(None, "u1", 5.0)] * 4 + [("", "z", 1.0), ("ä", "z", 1.0), ("a ", "u1", 1.0)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_chunks_give_what_a_plain_group_by_gives(spark, tmp_path, chunk):
    df = spark.createDataFrame(KEYED, "country string, name string, score double").withColumn("__extra", F.lit(1))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    for source in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = keychunks.key_summary(source, "country", "name", {"total": F.col("score")}, chunk_rows=chunk)
        want = df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_members"), F.sum("score").alias("total"))
        assert sorted(map(str, got.select("country", "n", "n_members", "total").collect())) == sorted(map(str, want.collect()))


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", None)], "n string, total string, last bigint")
    got = keychunks.key_summary(df, "n", "total", {"s": F.col("last")}).collect()
    assert sorted(tuple(r) for r in got) == [("a", 2, 2, 3), ("b", 1, 1, None)]
    assert sorted(tuple(r) for r in keychunks.heavy_keys(df, "n", 50).collect()) == [("a", 2, 3)]


def test_numbering_is_dense_ordered_and_chunks_are_equal(spark):
    df = spark.createDataFrame(KEYED, "country string, name string, score double")
    rows = keychunks.chunked(df, ["country", "name"], chunk_rows=10).orderBy("__pos").collect()
    assert [r["__pos"] for r in rows] == list(range(len(KEYED)))
    keys = [(r["country"] is not None, r["country"] or "", r["name"] is not None, r["name"] or "") for r in rows]
    assert keys == sorted(keys)
    sizes = [sum(r["__chunk"] == c for r in rows) for c in range(rows[-1]["__chunk"] + 1)]
    assert set(sizes[:-1]) == {10}


def test_heavy_keys_at_the_edge(spark):
    df = spark.createDataFrame([(k,) for k in ["a"] * 4 + ["b"] * 3 + [None] * 50 + [f"x{n}" for n in range(43)]], "country string")
    assert [r.country for r in keychunks.heavy_keys(df, "country", 4).collect()] == ["a"]
    assert keychunks.heavy_keys(spark.createDataFrame([], "country string"), "country", 4).collect() == []


def test_pinned_tables_are_kept_until_released(spark):
    import os

    from loamql import session

    pinned = session.pin(spark.range(5))
    assert sorted(r.id for r in pinned.collect()) == list(range(5))
    path = pinned.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    session.release(spark)
    assert not os.path.exists(path)


def test_records_of_any_length():
    spec = [("a", "int"), ("b", "string")]
    reader = rejects._Reader()
    long = "x" * 17_000_000
    for policy, text in (("simple", f"1,{long}"), ("quoted", f'1,"{long}"'), ("quoted", f"1,{long}")):
        assert [r[0] for r in rejects._load_group(reader, [text, "z,y", "1"], policy, ",", spec, False)] == [None, "value", "column_count"]


def test_without_the_reader_everything_is_the_same(monkeypatch):
    """What the reader can't read is split and typed exactly, with the same results."""
    spec = [("a", "int"), ("b", "percent"), ("c", "date"), ("d", "decimal"), ("e", "grouped_int"), ("f", "time"), ("g", "string")]
    texts = ['1, 5% ,2020-02-29,-1.50,"1,234",23:59,"x""y"', "1,5%,2021-02-29,1,1,00:00,s", "1,101%,2020-01-01,1,1,00:00,s", '"1",,,,,,', 'a"b,,,,,,', "1,2", "007,007%,2020-01-01,1.,1,00:00,s", " 12 ,,,,,24:00,"]
    reader = rejects._Reader()
    want = rejects._load_group(reader, texts, "quoted", ",", spec, True)

    class Failing:
        error = ValueError

        def read(self, *_):
            raise ValueError("no")

    got = rejects._load_group(Failing(), texts, "quoted", ",", spec, True)
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]
    assert [r[0] for r in want] == [None, "value", "value", None, "quoting", "column_count", "value", "value"]


def test_pinned_tables_are_deleted(spark):
    import os

    from loamql import session

    def there():
        return {p for p in session._pinned if os.path.exists(p.removeprefix("file://"))}

    before = there()
    with session.scratch(spark):
        df = session.pin(spark.range(3).toDF("a"))
        assert df.count() == 3 and len(there()) == len(before) + 1
    assert there() == before
