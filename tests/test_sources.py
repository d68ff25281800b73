import io
import random
import sqlite3
import tracemalloc

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamql import api, cli, source_queries
from loamql.api import query_csv, query_dataframe, query_json, query_sqlite
from loamql.plans.lexer import IOHandlingError, ParsingError
from loamql.sinks import writers
from loamql.sources import delimited
from loamql.sources.others import from_lists
from loamql.streaming import query_stream


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def run(spark, tmp_path, text, query="select *", out=None, **options):
    path = put(tmp_path / "in.csv", text, options.pop("encoding_written", "utf-8"))
    result = query_csv(spark, query, path, output_path=str(tmp_path / "out.csv") if out else None, **options)
    return (tmp_path / "out.csv").read_bytes().decode(options.get("encoding", "utf-8")) if out else result


def test_line_ends_and_empty_lines(spark, tmp_path):
    assert run(spark, tmp_path, "a,b\r\nc\rd,\n\ne").rows() == [["a", "b"], ["c"], ["d", ""], [""], ["e"]]


def test_quoted(spark, tmp_path):
    text = '"a,1", "b ""x""" ,c\n"open,d\nx"y,"z" w,""\n'
    r = run(spark, tmp_path, text)
    assert r.rows() == [["a,1", 'b "x"', "c"], ['"open', "d"], ['x"y', '"z" w', ""]]
    assert any("quote" in w for w in r.warnings) and any("not consistent" in w for w in r.warnings)


def test_simple_with_long_delimiter(spark, tmp_path):
    assert run(spark, tmp_path, 'a~#~"b~#~c"\n', delim="~#~").rows() == [["a", '"b', 'c"']]


def test_whitespace_and_monocolumn(spark, tmp_path):
    assert run(spark, tmp_path, "  a   b c \n", delim=" ").rows() == [["a", "b", "c"]]
    assert run(spark, tmp_path, "a, b;c\n", delim="", policy="monocolumn").rows() == [["a, b;c"]]


def test_rfc_records_over_lines(spark, tmp_path):
    text = '# c"\r\nid,"two\r\nlines"\r\n#not "a, comment\r\n# x"\r\n"#in",q\n'
    r = run(spark, tmp_path, 'k,"a\r\n#b\nc",1\n#skip "this\nm,"""",2\n', "select NR, a1, a2", policy="quoted_rfc", comment_prefix="#")
    assert r.rows() == [[1, "k", "a\n#b\nc"], [2, "m", '"']]
    with pytest.raises(Exception, match="quote escaping.*record 1"):
        run(spark, tmp_path, 'a"b,c\n', policy="quoted_rfc").rows()
    assert run(spark, tmp_path, text, policy="quoted_rfc", comment_prefix="#").rows() == [["id", "two\nlines"], ["#in", "q"]]


def test_comments_header_and_strip(spark, tmp_path):
    text = "#x\nname, v\n#y\n Ann ,1\nBob, 2\n"
    r = run(spark, tmp_path, text, "select a.name, a['v'], NR", with_headers=True, comment_prefix="#", strip_whitespaces=True)
    assert r.header == ["name", "v", "NR"] and r.rows() == [["Ann", "1", 1], ["Bob", "2", 2]]
    r = run(spark, tmp_path, text, "select a1 where NR > 1 with (noheader)", with_headers=True, comment_regex="^#.$")
    assert r.rows() == [[" Ann "], ["Bob"]]
    assert run(spark, tmp_path, text, "select a.name WITH (header)", comment_prefix="#").rows() == [[" Ann "], ["Bob"]]


def test_byte_order_mark_and_encodings(spark, tmp_path):
    r = run(spark, tmp_path, "\ufeffa,é\n")
    assert r.rows() == [["a", "é"]] and any("Byte Order Mark" in w for w in r.warnings)
    assert run(spark, tmp_path, "a,é\n", "select a2 + 'x'", encoding_written="latin-1", encoding="latin-1", out=True) == "éx\n"
    with pytest.raises(Exception, match="UTF-8"):
        run(spark, tmp_path, "a,é\n", encoding_written="latin-1").rows()


def test_guards(spark, tmp_path):
    for options in ({"delim": '"', "policy": "quoted"}, {"delim": ",", "policy": "whitespace"}, {"policy": "odd"}, {"encoding": "cp1"}, {"encoding": "latin-1", "query": "select 'é'"}):
        with pytest.raises(IOHandlingError):
            run(spark, tmp_path, "a\n", **options)
    with pytest.raises(IOHandlingError):
        query_csv(spark, "select a1", str(tmp_path / "none.csv"))


def test_header_width_and_monocolumn_output(spark, tmp_path):
    with pytest.raises(Exception, match="Inconsistent number of columns"):
        run(spark, tmp_path, "x,y\n1,2\n3\n", with_headers=True, out=True)
    with pytest.raises(Exception, match="monocolumn"):
        run(spark, tmp_path, "x,y\n", out=True, output_delim="", output_policy="monocolumn")


def test_rendering(spark, tmp_path):
    got = run(spark, tmp_path, "3,x\n", "select int(a1), int(a1) / 2, 1e10, 1e-7, a1 == '3', None, [a1, a2], a2 * 2", out=True)
    assert got == "3,1.5,10000000000.0,1e-07,True,,3|x,xx\n"
    r = run(spark, tmp_path, "3,x\n", "select None, 'p q'")
    assert writers.output_warnings(r.table, " ", "whitespace") == ["null values in output were replaced by empty strings", "Some output fields contain separator"]


def test_duplicate_header_names(spark, tmp_path):
    assert run(spark, tmp_path, "d,,d\n1,2,3\n", "select a.d, a['']", with_headers=True).rows() == [["3", "2"]]
    assert run(spark, tmp_path, "d,,d\n1,2,3\n", "select *", with_headers=True, out=True) == "d,,d\n1,2,3\n"


def test_join_paths_and_missing_key(spark, tmp_path):
    put(tmp_path / "b.csv", "k,9\n")
    assert run(spark, tmp_path, "k,1\nm,2\n", "select a2, b2 join b.csv on a1 == b1").rows() == [["1", "9"]]
    with pytest.raises(ParsingError, match="Unable to find join table"):
        run(spark, tmp_path, "k,1\n", "select a1 join zzz.csv on a1 == b1")
    with pytest.raises(Exception, match='No "a2" field'):
        run(spark, tmp_path, "k\n", "select a1 join b.csv on a2 == b1").rows()
    with pytest.raises(Exception, match='in "B" table'):
        run(spark, tmp_path, "k,1\n", "select a1 join b.csv on a2 == b5").rows()


def test_order_behind_a_join(spark, tmp_path):
    put(tmp_path / "b.csv", "".join(f"{k % 10},{k}\n" for k in range(40)))
    got = run(spark, tmp_path, "".join(f"{k % 10}\n" for k in range(50)), "select NR, b2 join b.csv on a1 == b1").rows()
    assert got == [[n + 1, str(k)] for n in range(50) for k in range(40) if k % 10 == n % 10]


FIELD = st.text(alphabet='ab ",;\n\r|é1', max_size=6)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=2, max_size=4), min_size=1, max_size=6), st.sampled_from([",", ";", "\t", "~#~"]))
def test_rfc_round_trip(spark, tmp_path_factory, table, delim):
    path = tmp_path_factory.mktemp("rt") / "t.csv"
    with path.open("w", newline="", encoding="utf-8") as out:
        writers.write_stream(from_lists(spark, [[x or "" for x in r] for r in table] + [["x"]]), out, delim, "quoted_rfc")
    got = query_csv(spark, "select *", str(path), delim, "quoted_rfc").rows()
    assert got[:-1] == [[x.replace("\r\n", "\n").replace("\r", "\n") for x in r] for r in table]


@pytest.mark.parametrize("policy", ["quoted", "simple"])
def test_random_round_trip(spark, tmp_path, policy):
    rng = random.Random(5)
    table = [["".join(rng.choice('ab ",x') if policy == "quoted" else rng.choice('ab "x') for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 6))] for _ in range(200)]
    with (tmp_path / "t.csv").open("w", newline="") as out:
        writers.write_stream(from_lists(spark, table), out, ",", policy)
    got = query_csv(spark, "select *", str(tmp_path / "t.csv"), ",", policy).rows()
    assert got == table


def test_dialects(spark, tmp_path):
    assert delimited.detect_dialect(spark, put(tmp_path / "t", "a;b\n1;2\n")) == (";", "quoted")
    assert delimited.detect_dialect(spark, put(tmp_path / "u.tsv", "a\n")) == ("\t", "simple")
    assert delimited.detect_dialect(spark, put(tmp_path / "v", "a\n")) is None
    assert [delimited.default_policy(d) for d in (",", ";", " ", "\t")] == ["quoted", "quoted", "whitespace", "simple"]
    assert delimited.named_format("tsv") == ("\t", "simple")


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "t.jsonl", '{"n": "x", "d": {"k": 2}}\n\n{"n": "y", "d": {"k": 5}, "e": null}\n')
    out = str(tmp_path / "o.jsonl")
    query_json(spark, "select a1['n'], int(a1['d']['k']) * 2 where a1['d']['k'] > 1", path, out)
    assert open(out).read() == '{"col0":"x","col1":4}\n{"col0":"y","col1":10}\n'
    query_json(spark, "select a1['n'] where a1['n'] == 'y'", path, out)
    assert open(out).read() == '"y"\n'
    with pytest.raises(Exception, match="JSON"):
        query_json(spark, "select a1", put(tmp_path / "bad.jsonl", "{x\n")).rows()
    with pytest.raises(ParsingError, match="not supported"):
        query_json(spark, "select a1 join b on a1 == b1", path)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("create table q(id integer, t text, r real)")
        db.executemany("insert into q values (?, ?, ?)", [(1, "a", 0.5), (2, None, 2), (3, "c", None)])
    r = query_sqlite(spark, "select a.id, a.t, a.r, NR where a.id > 1", path, "q")
    assert r.header == ["id", "t", "r", "NR"] and r.rows() == [[2, None, 2.0, 2], [3, "c", None, 3]]
    assert query_sqlite(spark, "select a.t, b.r from q join q on a.id == b.id where a.t is not None", path).rows() == [["a", 0.5], ["c", None]]
    for bad in ("q;drop", "none"):
        with pytest.raises(IOHandlingError):
            query_sqlite(spark, "select *", path, bad)


def test_pandas(spark):
    pdf = pd.DataFrame({"kind": ["x", "y", None], "speed": [1, 2, 3], "w": [0.5, float("nan"), 2.0]})
    got = query_dataframe(spark, "select a.kind, a.speed * 2 as s, NR where a.speed > 1", pdf)
    assert list(got.columns) == ["kind", "s", "NR"] and got.values.tolist() == [["y", 4, 2], [None, 6, 3]]
    got = query_dataframe(spark, "select a1, b.kind left join b on a1 == b.speed", pd.DataFrame({"n": [2, 9]}), pdf)
    assert got.values.tolist() == [[2, "y"], [9, None]]
    assert list(query_dataframe(spark, "select a2, a1", pd.DataFrame([[1, 2]])).columns) == [0, 1]


def test_colour_and_broken_pipe(spark):
    class Gone(io.StringIO):
        def write(self, text):
            raise BrokenPipeError

    table = from_lists(spark, [["a", 1], ["b", 2]], ["x", "y"])
    out = io.StringIO()
    assert writers.write_stream(table, out, ",", "quoted", colour=True)
    assert out.getvalue().splitlines()[1] == "\x1b[0ma,\x1b[31m1\x1b[0m"
    assert not writers.write_stream(table, Gone(), ",", "quoted")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = put(tmp_path / "t.csv", "n,v\nx,1\ny,2\n")
    assert cli.main(["csv", "--input", path, "--with-headers", "--query", "select a.n, int(a.v) + 1", "--out-format", "tsv"]) == 0
    assert capsys.readouterr().out == "n\tcol2\nx\t2\ny\t3\n"
    assert cli.main(["csv", "--input", path, "--query", "select a.q", "--error-format", "json"]) == 1
    assert '"error_type": "query parsing"' in capsys.readouterr().err
    assert cli.main(["csv", "--input", path, "--delim", ",", "--query", "select None", "--output", str(tmp_path / "o")]) == 0
    assert "null values" in capsys.readouterr().err
    replies = iter(["select a1 where a2 == '2'", ""])
    monkeypatch.setattr("builtins.input", lambda _: next(replies))
    monkeypatch.setattr(cli, "HISTORY", str(tmp_path / "history"))
    assert cli.main(["csv", "--input", path, "--delim", ","]) == 0
    assert capsys.readouterr().out == "n,v\nx,1\ny,2\ny\n"


def test_magic(spark):
    from loamql.magic import run_magic

    frames = {"t": pd.DataFrame({"x": [1, 2]}), "s": spark.createDataFrame([(5,)], "y int"), "twice": lambda v: v * 2}
    assert run_magic("select udf.twice(a.x) as d from t", frames).d.tolist() == [2, 4]
    assert [tuple(r) for r in run_magic("select a.y + 1 from s", frames).collect()] == [(6,)]


def test_streams(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 k").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "k bigint, name string")
    stream = spark.readStream.schema("id bigint, k bigint").parquet(str(tmp_path / "in"))
    out = query_stream("select a.id, b.name as n join names on a.k == b.k where a.id > 10 | update a.n = a.n.upper()", stream, {"names": names})
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("streamed").collect())
    assert got == [(n, ["ZERO", "ONE"][n % 3]) for n in range(11, 20) if n % 3 < 2]
    for bad in ("select NR", "select a1 order by a1", "select count(1) group by a1", "select distinct a1", "select a1 limit 2"):
        with pytest.raises(ParsingError):
            query_stream(bad, stream)


def test_split_matches_the_exact_splitter(spark):
    from loamql.operators.rejects import split_exactly

    rng = random.Random(11)
    lines = ["".join(rng.choice('ab", ') for _ in range(rng.randrange(12))) for _ in range(800)]
    fields, bad = delimited.split_fields(F.col("value"), ",", "quoted")
    got = spark.createDataFrame([(x,) for x in lines], "value string").select("value", fields.alias("f"), bad.alias("b")).collect()
    for r in got:
        want = split_exactly(r["value"], "quoted", ",")
        assert r["b"] == (want is None), r
        if want is not None:
            assert r["f"] == [w if '"' in r["value"] else w for w in want], r


def test_python_expressions_over_text(spark, tmp_path):
    text = "name,v\nann lee,3\nbob,x\ncy\n"
    r = run(spark, tmp_path, text, "select a.name.title() + str(NR), {'k': a.v}['k'], a['name'][::-1]", with_headers=True)
    assert r.rows() == [["Ann Lee1", "3", "eel nna"], ["Bob2", "x", "bob"], ["Cy3", None, "yc"]] and len(r.python_expressions) == 3
    assert run(spark, tmp_path, text, "update a.name = a.name.title() where NR > 1", with_headers=True).rows() == [["ann lee", "3"], ["Bob", "x"], ["Cy"]]
    assert run(spark, tmp_path, text, "select NR where a1.swapcase() == 'BOB' or a2.isalpha() if a2 else False").rows() == [[1], [3]]
    assert run(spark, tmp_path, text, "select a1 order by a1.swapcase() desc limit 1", with_headers=True).rows() == [["cy"]]
    assert run(spark, tmp_path, text, "select datetime.date(2020, 2, 1).year, random.random() < 2 limit 1").rows() == [[2020, True]]
    with pytest.raises(Exception, match="name 'n' is not defined") as failure:
        run(spark, tmp_path, text, "select len(a1) as n where n > 2").rows()
    from loamql.api import error_info

    assert error_info(failure.value)[0] == "query execution"


def folder_of(tmp_path, n=3, header=False):
    for i in range(n):
        put(tmp_path / f"{i}.csv", ("h1,h2\n" if header else "") + "".join(f"{i}{j},{j}\n" for j in range(4)))
    return str(tmp_path)


def test_folders_are_not_sorted_where_no_order_is_asked_for(spark, tmp_path):
    source = delimited.read_delimited(spark, folder_of(tmp_path), ",", "quoted")
    df = api.run("select a1 where a2 == '3'", source, None, api.Options()).df
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in df.collect()) == ["03", "13", "23"]


def test_order_and_numbers_over_a_folder(spark, tmp_path):
    path = folder_of(tmp_path)
    assert query_csv(spark, "select a1 where a2 == '3'", path).rows() == [["03"], ["13"], ["23"]]
    assert [r[0] for r in query_csv(spark, "select NR", path).rows()] == list(range(1, 13))
    assert query_csv(spark, "select a1 limit 5", path).rows() == [["00"], ["01"], ["02"], ["03"], ["10"]]


def test_header_of_every_file(spark, tmp_path):
    r = query_csv(spark, "select NR, a.h1, a2", folder_of(tmp_path, header=True), with_headers=True)
    assert r.header == ["NR", "h1", "h2"] and r.rows() == [[4 * i + j + 1, f"{i}{j}", str(j)] for i in range(3) for j in range(4)]


def raised(call):
    with pytest.raises(Exception) as e:  # noqa: PT011
        call()
    return api.error_info(e.value)


def test_errors_of_inputs(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xfe,c\n")
    assert raised(lambda: query_csv(spark, "select *", str(tmp_path / "bad.csv")).rows()) == ("IO handling", "Unable to decode input table as UTF-8. Use binary (latin-1) encoding instead")
    rfc = put(tmp_path / "r.csv", 'a,"b\nc"\nd,e\nx,y"z\n')
    assert raised(lambda: query_csv(spark, "select *", rfc, policy="quoted_rfc", output_path=str(tmp_path / "o")).rows()) == ("IO handling", "Inconsistent double quote escaping in input table at record 3, line 4")
    lines = put(tmp_path / "j.jsonl", '{"a": 1}\n\n[2]\n{"a": \n3\n')
    kind, text = raised(lambda: api.query_json(spark, "select a1", lines).rows())
    assert kind == "IO handling" and text.startswith("Error decoding JSON in input table at record 3, line 4: Expecting value")
    assert raised(lambda: api.query_json(spark, "select a1", lines, str(tmp_path / "o2")))[1] == text


def test_warnings_of_inputs_and_outputs(spark, tmp_path):
    path = put(tmp_path / "t.csv", '# c\na,b\n"x"y,b\nc,d"e\n')
    r = query_csv(spark, "select a1, None, 'p|q'", path, ",", "quoted", comment_prefix="#", output_delim="|", output_policy="simple")
    assert r.warnings == ["Inconsistent double quote escaping in input table. E.g. at line 3", "null values in output were replaced by empty strings", "Some output fields contain separator"]


def test_sqlite_to_text(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a, b, c)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, 1.5, "x;y"), (2, 3, 4), (None, None, None)])
    api.query_sqlite(spark, "select a.a, a.b, a.c where a.a", path, "t", output_path=str(tmp_path / "o"), output_delim=";", output_policy="quoted")
    assert open(tmp_path / "o", encoding="utf-8").read() == 'a;b;c\n1;1.5;"x;y"\n2;3.0;4\n'


def test_command_line_from_standard_input(spark, tmp_path, capsys, monkeypatch):
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b"x,1\ny,2\n")))
    assert cli.main(["csv", "--delim", ",", "--query", "select a1 where int(a2) > 1"]) == 0
    assert capsys.readouterr().out == "y\n"
    with pytest.raises(Exception, match="a.q|column"):  # noqa: PT011
        cli.main(["csv", "--input", put(tmp_path / "t.csv", "n\n1\n"), "--delim", ",", "--debug-mode", "--with-headers", "--query", "select a.q"])
    api.set_debug_mode(False)


def test_result_shown_from_its_file(spark, tmp_path, capsys, monkeypatch):
    typed = iter(["select a1", ""])
    monkeypatch.setattr("builtins.input", lambda _: next(typed))
    monkeypatch.setattr(cli, "HISTORY", str(tmp_path / "history"))
    assert cli.main(["csv", "--input", put(tmp_path / "t.csv", "p,1\nq,2\n"), "--delim", ",", "--output", str(tmp_path / "o")]) == 0
    assert capsys.readouterr().out.endswith("it begins with:\np\nq\n")


def test_first_bad_record(spark, tmp_path, capsys):
    path = put(tmp_path / "t.csv", "".join(f"{n if n not in (37, 60) else 'x'},a\n" for n in range(1, 80)))
    assert query_csv(spark, "select int(a1)", path).first_bad_record()[0] == 37
    assert query_csv(spark, "select int(a1) where NR > 40 | select a1 + 1", path).first_bad_record()[0] == 60
    assert query_csv(spark, "select a1", path).first_bad_record() is None
    assert cli.main(["csv", "--input", path, "--delim", ",", "--query", "select int(a1) + 1"]) == 1
    assert "At record 37, Details: " in capsys.readouterr().err


def test_lists_a_part_at_a_time(spark, tmp_path):
    path = put(tmp_path / "t.csv", "".join(f"{n % 7},{'x,' * (n % 3)}y\n" for n in range(3000)))
    for text in ("select *", "select int(a1), NR order by int(a1) desc", "select a1 where a1 == '9'", "select NR limit 5"):
        result = query_csv(spark, text, path)
        assert list(result.iterate_rows()) == result.rows()
    lines = put(tmp_path / "j.jsonl", '1\n{"a": \n3\n')
    kind, text = raised(lambda: list(query_json(spark, "select a1", lines).iterate_rows()))
    assert kind == "IO handling" and text.startswith("Error decoding JSON in input table at record 2, line 2")


def test_frames_and_lists_in_bounded_memory(spark, tmp_path):
    orders = spark.range(0, 600_000, 1, 8).selectExpr("id as o_orderkey", "if(id % 2 = 0, 'F', 'O') as o_orderstatus", "id / 8 as o_totalprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    tracemalloc.start()
    try:
        out = source_queries.out_frames_and_lists(spark, str(tmp_path))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.agg(F.count("*"), F.countDistinct("k"), F.sum("k"), F.sum("p")).first() == (300_000, 300_000, 299_999 * 300_000, 299_999 * 300_000 / 8)
    assert most < 70e6, most
    orders.limit(0).write.parquet(str(tmp_path / "none" / "orders.parquet"))
    assert source_queries.out_frames_and_lists(spark, str(tmp_path / "none")).collect() == []
