"""Registered queries over sources, sinks, user functions, errors and entry points.

Text, JSON Lines and SQLite inputs are written from the Parquet tables into the shared folder and read
back through the source; outputs are compared as the lines that are written. Each has SQL that gives
the same rows from the tables themselves.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import os
import sqlite3
import types
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamql import api, cli, magic
from loamql.api import Options, Result, error_info, query, query_csv, query_dataframe, query_json, query_sqlite, query_table, query_tables, run
from loamql.plans.lexer import QueryError
from loamql.session import scratch_path
from loamql.sinks import writers
from loamql.sources import delimited
from loamql.sources.others import from_any
from loamql.sources.tables import from_frame
from loamql.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LISTS_AT_ONCE = 100_000  # rows that the driver holds as lists


def registered(sql: str) -> Callable[[Query], Query]:
    def put(function: Query) -> Query:
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return put


def _lines(df: DataFrame, line: str, **options: str) -> str:
    """The folder that one text line per row of ``df`` was written to."""
    path = scratch_path(df.sparkSession, "lines")
    df.select(F.expr(line).alias("value")).write.options(**options).text(path)
    return path


def _written(df: DataFrame, delim: str, policy: str) -> str:
    """The folder that ``df`` was written to by the text sink."""
    path = scratch_path(df.sparkSession, "text")
    writers.write_folder(from_frame(df), path, delim, policy)
    return path


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- text sources --------------------------------------------------------------------------------


@registered("SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice * 2 AS p, CAST(3 AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F'")
def src_simple(spark: SparkSession, folder: str) -> DataFrame:
    path = _written(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "|", "simple")
    return query_csv(spark, "select int(a1) as k, a2 as s, float(a3) * 2 as p, NF as n where a2 != 'F'", path, "|").df


@registered("""SELECT c_custkey AS k, c_name || ', "' || c_custkey || '"' AS v, c_nationkey AS n FROM customer""")
def src_quoted(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").selectExpr("c_custkey", "concat(c_name, ', \"', c_custkey, '\"') as v", "c_nationkey")
    return query_csv(spark, "select int(a1) as k, a2 as v, int(a3) as n", _written(df, ",", "quoted"), ",", "quoted").df


@registered("SELECT doc_id AS k, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents")
def src_quoted_rfc(spark: SparkSession, folder: str) -> DataFrame:
    path = _written(table(spark, folder, "documents").select("doc_id", "text"), ",", "quoted_rfc")
    return query_csv(spark, "select int(a1) as k, a2 as t", path, ",", "quoted_rfc").df


@registered("SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS w, p_size AS z, CAST(2 + len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part")
def src_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "part"), "concat('  ', p_partkey, '   ', replace(p_name, ' ', '  '), ' ', p_size, '  ')")
    out = query_csv(spark, "select int(a1) as k, a2 as w, a[NF] as z, NF as n", path, " ").df
    return out.withColumn("z", F.col("z").cast("int"))


@registered("SELECT n_name || ', and so on' AS line, CAST(1 AS BIGINT) AS n FROM nation")
def src_monocolumn(spark: SparkSession, folder: str) -> DataFrame:
    return query_csv(spark, "select a1 as line, NF as n", _lines(table(spark, folder, "nation"), "concat(n_name, ', and so on')"), "", "monocolumn").df


@registered("SELECT r_regionkey AS k, 'x' AS v, CAST(CASE r_regionkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS BIGINT) AS n FROM region WHERE r_regionkey % 3 <> 1 UNION ALL SELECT r_regionkey, NULL, 1 FROM region WHERE r_regionkey % 3 = 1")
def src_line_ends_and_ragged(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that end in CR LF, with one to three fields."""
    path = _lines(table(spark, folder, "region"), "case r_regionkey % 3 when 0 then concat(r_regionkey, ',x') when 1 then string(r_regionkey) else concat(r_regionkey, ',x,') end", lineSep="\r\n")
    return query_csv(spark, "select int(a1) as k, a2 as v, NF as n", path).df


@registered("SELECT n_nationkey AS k, n_name || 'éü' AS v FROM nation")
def src_latin1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "latin")
    table(spark, folder, "nation").selectExpr("n_nationkey", "concat(n_name, 'éü')").write.option("encoding", "ISO-8859-1").option("sep", ";").csv(path)
    return query_csv(spark, "select int(a1) as k, a2 as v", path, ";", "simple", encoding="latin-1").df


@registered("SELECT r_regionkey AS k, true AS told FROM region")
def src_byte_order_mark(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "region").orderBy("r_regionkey").coalesce(1), "concat(if(r_regionkey = 0, '\ufeff', ''), r_regionkey, ',', r_name)")
    result = query_csv(spark, "select int(a1) as k", path)
    return result.df.withColumn("told", F.lit(any("Byte Order Mark" in w for w in result.warnings)))


@registered("SELECT p_partkey AS k, p_name AS v FROM part")
def src_comments(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "part").selectExpr("p_partkey", "p_name", "explode(array(0, 1, 2)) as x"), "case x when 0 then '#remark, of no field' when 1 then concat('// ', p_name) else concat(p_partkey, ';', p_name) end")
    return query_csv(spark, "select int(a1) as k, a2 as v", path, ";", comment_prefix="#", comment_regex="^//").df


@registered("SELECT c_custkey AS k, c_name AS v FROM customer")
def src_strip(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "customer"), "concat('  ', c_custkey, ' ,\t', c_name, '   ')")
    return query_csv(spark, "select int(a1) as k, a2 as v", path, strip_whitespaces=True).df


@registered("SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey > 3")
def src_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Several files, each with a header."""
    path = scratch_path(spark, "headed")
    table(spark, folder, "supplier").select("s_suppkey", "s_name").repartition(3).write.option("header", "true").csv(path)
    return query_csv(spark, "select int(a.s_suppkey) as k, a['s_name'] as v where int(a.s_suppkey) > 3", path, with_headers=True).df


@registered("SELECT s_suppkey AS k, s_name AS v FROM supplier")
def src_header_modifier(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "headed")
    table(spark, folder, "supplier").select("s_suppkey", "s_name").coalesce(1).write.option("header", "true").csv(path)
    return query_csv(spark, "select int(a.s_suppkey) as k, a.s_name as v with (header)", path).df


@registered("SELECT n_nationkey AS k, n_name AS v, ';' AS delim, 'quoted' AS policy FROM nation")
def src_detected(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "nation"), "concat(n_nationkey, ';', n_name, ';\"a\"')")
    delim, policy = delimited.detect_dialect(spark, path)
    return query_csv(spark, f"select int(a1) as k, a2 as v, '{delim}' as delim, '{policy}' as policy", path, delim, policy).df


@registered("SELECT * FROM (VALUES (',', 'quoted'), (';', 'quoted'), (' ', 'whitespace'), (chr(9), 'simple'), ('|', 'simple'), ('csv', ', quoted'), ('tsv', chr(9) || ' simple'), ('monocolumn', ' monocolumn')) t(name, policy)")
def src_policies(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(d, delimited.default_policy(d)) for d in (",", ";", " ", "\t", "|")]
    return _values(spark, rows + [(n, " ".join(delimited.named_format(n))) for n in ("csv", "tsv", "monocolumn")], "name string, policy string")


@registered("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_table_beside(spark: SparkSession, folder: str) -> DataFrame:
    """A join table that is named by its file beside the input."""
    base = scratch_path(spark, "beside")
    for name in ("nation", "region"):
        writers.write_folder(from_frame(table(spark, folder, name)), f"{base}/{name}", ",", "quoted")
    local = base.removeprefix("file://")
    return query_csv(spark, "select a2 as n, b2 as r join region on a3 == b1", f"{local}/nation").df


# -- other sources -------------------------------------------------------------------------------


@registered("SELECT event_id AS k, user_id AS u, props AS p FROM events")
def src_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    table(spark, folder, "events").select("event_id", "user_id", "props").write.json(path)
    out = query_json(spark, "select int(a1['event_id']) as k, int(a1['user_id']) as u, str(a1['props']) as p", path)
    return out.df


@registered("SELECT n_name AS n, n_nationkey + 1 AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_pandas(spark: SparkSession, folder: str) -> DataFrame:
    """Pandas frames in and out, b being the second."""
    frames = [table(spark, folder, n).toPandas() for n in ("nation", "region")]
    made = query_dataframe(spark, "select a.n_name as n, a.n_nationkey + 1 as k, b.r_name as r join b on a.n_regionkey == b.r_regionkey", *frames)
    return spark.createDataFrame(made)


@registered("SELECT c_custkey AS k, c_name AS v, c_acctbal AS b, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def src_sqlite(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "db").removeprefix("file://") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        for name in ("customer", "nation"):
            frame = table(spark, folder, name)
            db.execute(f"CREATE TABLE {name} ({', '.join(frame.columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(frame.columns))})", (tuple(r) for r in frame.toLocalIterator()))
    return query_sqlite(spark, "select a.c_custkey as k, a.c_name as v, a.c_acctbal as b, b.n_name as n join nation on a.c_nationkey == b.n_nationkey where a.c_acctbal > 0", path, "customer").df


@registered("SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows, others = ([list(r) for r in table(spark, folder, n).collect()] for n in ("nation", "region"))
    return query_table(spark, "select a1 as k, a2 as n, b2 as r join b on a3 == b1", rows, others).df


@registered("SELECT n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_notebook(spark: SparkSession, folder: str) -> DataFrame:
    """The line magic, with frames by their variables' names."""
    held: dict[str, Callable] = {}
    shell = types.SimpleNamespace(
        user_ns={n: table(spark, folder, n) for n in ("nation", "region")}, register_magic_function=lambda f, kind, name: held.__setitem__(name, f), set_hook=lambda *a, **k: None
    )
    magic.load_ipython_extension(shell)
    return held["loamql"]("select a.n_nationkey as k, b.r_name as r from nation join region on a.n_regionkey == b.r_regionkey")


# -- sinks ---------------------------------------------------------------------------------------


def _out(spark: SparkSession, folder: str, text: str, delim: str, policy: str) -> DataFrame:
    result = run(text, None, lambda name, _: from_frame(table(spark, folder, name)), Options())
    return writers.text_lines(result.table, delim, policy).withColumnRenamed("value", "line")


@registered('''SELECT c_custkey || ',"' || c_name || ', Esq. ""' || c_custkey || '"""' AS line FROM customer''')
def out_quoted(spark: SparkSession, folder: str) -> DataFrame:
    return _out(spark, folder, "select a1 as k, a.c_name + ', Esq. \"' + str(a1) + '\"' as v from customer", ",", "quoted")


@registered("""SELECT p_partkey || ',"' || p_name || chr(10) || 'x"' AS line FROM part""")
def out_quoted_rfc(spark: SparkSession, folder: str) -> DataFrame:
    return _out(spark, folder, "select a1, a.p_name + '\\nx' from part", ",", "quoted_rfc")


@registered("SELECT n_nationkey || chr(9) || n_name AS line FROM nation")
def out_simple(spark: SparkSession, folder: str) -> DataFrame:
    return _out(spark, folder, "select a1, a2 from nation", "\t", "simple")


@registered("SELECT r_name AS line FROM region")
def out_monocolumn(spark: SparkSession, folder: str) -> DataFrame:
    return _out(spark, folder, "select a2 from region", "", "monocolumn")


@registered("SELECT n_nationkey || '.5,True,,' || n_name || '|x,1e-07' AS line FROM nation")
def out_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """Floats, truth values, nulls and lists as text."""
    return _out(spark, folder, "select a1 + 0.5, a1 >= 0, None, [a2, 'x'], 1e-7 from nation", ",", "quoted")


@registered("""SELECT chr(27) || '[0m' || r_regionkey || ',' || chr(27) || '[31m' || r_name || chr(27) || '[0m' AS line FROM region""")
def out_colour(spark: SparkSession, folder: str) -> DataFrame:
    held = io.StringIO()
    writers.write_stream(from_frame(table(spark, folder, "region").toDF("k", "v"), []), held, ",", "quoted", colour=True)
    return _values(spark, [(x,) for x in held.getvalue().splitlines()], "line string")


@registered("""SELECT '{"k":' || n_nationkey || ',"v":"' || n_name || '","z":null}' AS line FROM nation UNION ALL SELECT '"' || r_name || '"' FROM region""")
def out_json(spark: SparkSession, folder: str) -> DataFrame:
    find = lambda name, _: from_frame(table(spark, folder, name))
    whole, single = (run(t, None, find, Options()).table for t in ("select a1 as k, a2 as v, None as z from nation", "select a2 as v from region"))
    return writers.json_lines(whole).unionAll(writers.json_lines(single)).withColumnRenamed("value", "line")


@registered("SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'")
def out_frames_and_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The result as a frame that any Spark sink takes, and as lists, of which the driver holds some at a time."""
    result = query("select a.o_orderkey as k, a.o_totalprice as p where a.o_orderstatus == 'F'", table(spark, folder, "orders"))
    schema = result.df.schema
    whole, lists = scratch_path(spark, "sink"), scratch_path(spark, "lists")
    result.df.write.parquet(whole)
    for rows in itertools.chain([()], itertools.batched(result.iterate_rows(), LISTS_AT_ONCE)):  # the empty one makes the folder
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(lists)
    return spark.read.schema(schema).parquet(lists).intersectAll(spark.read.schema(schema).parquet(whole))


@registered("SELECT false AS whole, 2 AS lines")
def out_broken_pipe(spark: SparkSession, folder: str) -> DataFrame:
    class Pipe(io.StringIO):
        def write(self, text: str) -> int:
            if len(self.getvalue().splitlines()) == 2:
                raise BrokenPipeError
            return super().write(text)

    pipe = Pipe()
    whole = writers.write_stream(from_frame(table(spark, folder, "nation"), []), pipe, ",", "quoted")
    return _values(spark, [(whole, len(pipe.getvalue().splitlines()))], "whole boolean, lines int")


# -- projections, joins and aggregates that have no query of their own -------------------------------


@registered("SELECT CAST(1 + len(string_split(p_name, ' ')) AS BIGINT) AS nf, CAST(p_partkey AS VARCHAR) AS k, string_split(p_name, ' ')[1] AS w FROM part")
def project_unpack(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1, *a.p_name.split(' ') FROM part | SELECT NF AS nf, a1 AS k, a2 AS w", folder)


@registered("SELECT r_regionkey AS k, 'SELECT * FROM x WHERE | # \"b1\"' AS s, r_name || ' and ORDER BY' AS t FROM region")
def project_literals(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1 AS k, 'SELECT * FROM x WHERE | # \"b1\"' AS s, a.r_name + \" and ORDER BY\" AS t FROM region", folder)


@registered("SELECT n_name || '-' || r_name AS s, r_name || r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_concatenation(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a.n_name + '-' + b.r_name AS s, b2 * 2 AS t FROM nation JOIN region ON a3 == b1", folder)


@registered("SELECT row_number() OVER (ORDER BY n_nationkey) AS nr, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_keeps_order(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a2 AS n, b2 AS r FROM nation JOIN region ON a3 == b1 | SELECT NR AS nr, a1 AS n, a2 AS r", folder)


@registered("SELECT row_number() OVER (ORDER BY lang NULLS FIRST, item_id) AS nr, item_id AS k FROM eval_items")
def order_nulls_first(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a.item_id AS k FROM eval_items ORDER BY a.lang, a.item_id | SELECT NR AS nr, a1 AS k", folder)


@registered("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation")
def order_random(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1 AS k FROM nation ORDER BY random.random() | SELECT COUNT(*) AS n, SUM(a.k) AS s", folder)


@registered("SELECT l_returnflag AS f, min(l_quantity) AS a, max(l_quantity) AS b, sum(l_quantity) AS c, count(*) AS d, median(l_quantity) AS e, round_even(avg(l_quantity), 6) AS g FROM lineitem GROUP BY 1")
def group_spellings(spark: SparkSession, folder: str) -> DataFrame:
    text = "SELECT a.l_returnflag AS f, Min(a.l_quantity) AS a, max(a.l_quantity) AS b, Sum(a.l_quantity) AS c, Count(*) AS d, Median(a.l_quantity) AS e, Avg(a.l_quantity) AS g FROM lineitem GROUP BY a.l_returnflag"
    return query_tables(spark, f"{text} | SELECT a.f AS f, a.a AS a, a.b AS b, a.c AS c, a.d AS d, a.e AS e, round(a.g, 6) AS g", folder)


@registered("SELECT p_brand AS b, quantile_disc(p_size, 0.5) AS m FROM part GROUP BY p_brand HAVING count(*) % 2 = 1")
def group_median_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Medians of groups of an odd number of whole numbers."""
    out = query_tables(spark, "SELECT a.p_brand AS b, COUNT(*) AS n, MEDIAN(a.p_size) AS m FROM part GROUP BY a.p_brand | SELECT a.b AS b, int(a.m) AS m WHERE a.n % 2 == 1", folder)
    return out.withColumn("m", F.col("m").cast("int"))


@registered("SELECT r_regionkey AS k, true AS r, true AS t, true AS s, r_name AS o, true AS p FROM region")
def clock_chance_and_system(spark: SparkSession, folder: str) -> DataFrame:
    text = "SELECT a1 AS k, 0 <= random.random() < 1 AS r, time.time() > 1000 AS t, sys.maxsize > 1000 AS s, os.path.basename('x/' + a2) AS o, len(os.getcwd()) > 0 AS p FROM region"
    return query_tables(spark, text, folder)


# -- user functions ----------------------------------------------------------------------------------

INIT = """
def shout(text):
    return text.upper() + '!'
def bits(n):
    return [n % 2, n // 2 % 2]
"""


def _last_letter(text: str) -> str:
    return text[-1]


@registered("SELECT n_nationkey AS k, upper(n_name) || '!' AS s FROM nation")
def udf_init_code(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1 AS k, shout(a2) AS s FROM nation", folder, init_source=INIT)


@registered("SELECT n_nationkey AS k, upper(n_name) || '!' AS s FROM nation WHERE upper(n_name) || '!' < 'J'")
def udf_init_file(spark: SparkSession, folder: str) -> DataFrame:
    """The user's init file, as it is read where no init code is given."""
    path = scratch_path(spark, "init").removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(INIT)
    kept, api.INIT_FILE = api.INIT_FILE, path
    try:
        return query_tables(spark, "SELECT a1 AS k, shout(a2) AS s FROM nation WHERE shout(a2) < 'J'", folder, init_source=api.default_init_code())
    finally:
        api.INIT_FILE = kept


@registered("SELECT n_nationkey AS k, right(n_name, 1) AS s FROM nation")
def udf_namespace(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1 AS k, udf.last(a2) AS s FROM nation", folder, user={"last": _last_letter})


@registered("SELECT n_nationkey AS k, CAST(unnest([n_nationkey % 2, n_nationkey // 2 % 2]) AS BIGINT) AS b FROM nation")
def udf_unnest(spark: SparkSession, folder: str) -> DataFrame:
    return query_tables(spark, "SELECT a1 AS k, UNNEST(bits(a1)) AS b FROM nation", folder, init_source=INIT)


# -- errors and warnings -----------------------------------------------------------------------------

LISTS = [["x", 1], ["y", None], ["y", 3]]
# case -> (query, more options of query_table, kind, what the message holds)
ERRORS: dict[str, tuple[str, dict, str, str]] = {
    "no join tables": ("select * join b on a1 == b1", {}, "query parsing", "JOIN operations are not supported"),
    "unknown join table": ("select * join c on a1 == b1", {"join_rows": [["x"]]}, "query parsing", 'Unable to find join table: "c"'),
    "short record": ("select * join b on a1 == b2", {"join_rows": [["x"], ["y", "z"]]}, "query execution", 'No field with index 2 at record 1 in "B" table'),
    "two matches": ("select * strict left join b on a1 == b1", {"join_rows": [["x"], ["y"], ["y"]]}, "query execution", "must have exactly one match in B"),
    "update with two matches": ("update set a1 = b1 join b on a1 == b1", {"join_rows": [["y"], ["y"]]}, "query execution", "More than one record in UPDATE query matched"),
    "unequal column": ("select a1, count(*), a2 group by a1", {}, "query execution", "non-constant values in output column 3"),
    "aggregate in an expression": ("select 1 + max(a2)", {}, "query parsing", "Aggregate functions can't be used inside other expressions"),
    "aggregate with order": ("select count(*) order by a1", {}, "query parsing", "are not allowed in aggregate queries"),
    "having": ("select a1, count(*) group by a1 having count(*) > 1", {}, "query parsing", "There is no HAVING"),
    "no select": ("where a1 == 'x'", {}, "query parsing", "SELECT"),
    "two where": ("select a1 where a1 where a2", {}, "query parsing", "WHERE"),
    "bad limit": ("select a1 limit x", {}, "query parsing", "LIMIT"),
    "unknown field": ("select a['q']", {"header": ["n", "v"]}, "query execution", 'No "q" field at record 1'),
    "unknown attribute": ("select a.q", {"header": ["n", "v"]}, "query parsing", 'Unable to find column "q"'),
    "no number": ("select int(a1)", {}, "query execution", ""),
    "beyond 64 bits": ("select a2 * 2 ** 62 * 2 where a2 == 3", {}, "query execution", "beyond 64 bits"),
    "init code": ("select a1", {"init_code": "1 / 0"}, "query execution", "Exception while executing user-provided init code"),
}


@registered("SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{kind}', true)" for case, (_, _, kind, _) in ERRORS.items()) + ") t(name, kind, told)")
def errors_of_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of each error, and whether its message says what it should."""
    rows = []
    for case, (text, options, _, said) in ERRORS.items():
        try:
            more = {"init_code": "select = 1"} | options if "init_code" in options else options
            query_table(spark, f"select fail(a1) | {text}" if case == "init code" else text, LISTS, **more).rows()
            rows.append((case, "none", False))
        except Exception as e:  # noqa: BLE001 - its kind is the result
            kind, message = error_info(e)
            rows.append((case, kind, said in message and "SQLSTATE" not in message))
    return _values(spark, rows, "name string, kind string, told boolean")


@registered("SELECT * FROM (VALUES ('MIN', 'query execution'), ('MAX', 'query execution'), ('SUM', 'query execution'), ('AVG', 'query execution'), ('VARIANCE', 'query execution'), ('MEDIAN', 'query execution')) t(name, kind)")
def errors_of_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over eval_items.lang's lengths where nulls are errors."""
    rows = []
    for name in ("MIN", "MAX", "SUM", "AVG", "VARIANCE", "MEDIAN"):
        try:
            query(f"select {name}(a2)", spark.createDataFrame([(1, 2), (2, None)], "k int, v int"), strict_nulls=True).rows()
            rows.append((name, "none"))
        except Exception as e:  # noqa: BLE001
            rows.append((name, error_info(e)[0]))
    return _values(spark, rows, "name string, kind string")


@registered(
    "SELECT * FROM (VALUES ('delimiter', 'Double quote delimiter is incompatible with \"quoted\" policy'), ('whitespace', 'Only whitespace \" \" delim is supported with \"whitespace\" policy'),"
    " ('latin-1', 'To use non-ascii characters in query or delimiter choose utf-8 encoding instead of latin-1'), ('policy', 'Unknown policy: odd'),"
    " ('json', 'Error decoding JSON in input table at record 2, line 3'), ('utf-8', 'Unable to decode input table as UTF-8. Use binary (latin-1) encoding instead'),"
    " ('rfc', 'Inconsistent double quote escaping in input table at record 2, line 3'), ('monocolumn', 'Unable to use monocolumn output format: some records have more than one column')) t(name, message)"
)
def errors_of_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of kind "IO handling"."""
    region = table(spark, folder, "region").orderBy("r_regionkey").coalesce(1)
    text = lambda line: _lines(region, line)
    binary = scratch_path(spark, "latin")
    region.selectExpr("concat(r_name, 'é')").write.option("encoding", "ISO-8859-1").csv(binary)
    cases: dict[str, Callable[[], object]] = {
        "delimiter": lambda: query_csv(spark, "select *", "x", '"', "quoted"),
        "whitespace": lambda: query_csv(spark, "select *", "x", ",", "whitespace"),
        "latin-1": lambda: query_csv(spark, "select 'é'", "x", encoding="latin-1"),
        "policy": lambda: query_csv(spark, "select *", "x", ",", "odd"),
        "json": lambda: query_json(spark, "select a1", text("case r_regionkey when 0 then '1' when 1 then '' when 2 then '{' else '2' end")).rows(),
        "utf-8": lambda: query_csv(spark, "select a1", binary).rows(),
        "rfc": lambda: query_csv(spark, "select a1", text("case r_regionkey when 0 then '\"a' when 1 then 'b\"' when 2 then 'x\"y\"' else 'z' end"), policy="quoted_rfc").rows(),
        "monocolumn": lambda: writers.text_lines(query("select a1, a2", table(spark, folder, "region")).table, "", "monocolumn"),
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, "no error"))
        except Exception as e:  # noqa: BLE001
            kind, message = error_info(e)
            rows.append((name, message.split(": Expecting")[0] if kind == "IO handling" else f"{kind}: {message}"))
    return _values(spark, rows, "name string, message string")


@registered(
    "SELECT * FROM (VALUES ('Inconsistent double quote escaping in input table. E.g. at line 2'), ('Number of fields in input table is not consistent: e.g. 2 and 3'),"
    " ('null values in output were replaced by empty strings'), ('Some output fields contain separator')) t(warning)"
)
def warnings_of_a_query(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "region").orderBy("r_regionkey").coalesce(1), "case r_regionkey when 1 then 'a\"b,c' when 2 then 'a,b,c' else 'a,b' end")
    result = query_csv(spark, "select a1, a3, 'p|q'", path, ",", "quoted", output_delim="|", output_policy="simple")
    return _values(spark, [(w,) for w in result.warnings], "warning string")


# -- the command line --------------------------------------------------------------------------------


def _command(spark: SparkSession, lines: str, *arguments: str) -> DataFrame:
    held, told = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(held), contextlib.redirect_stderr(told):
        code = cli.main([*arguments, "--input", lines])
    return _values(spark, [(code, line) for line in [*held.getvalue().splitlines(), *told.getvalue().splitlines()]], "code int, line string")


@registered("SELECT 0 AS code, CAST(n_nationkey + 1 AS VARCHAR) || chr(9) || n_name AS line FROM nation")
def command_line(spark: SparkSession, folder: str) -> DataFrame:
    path = _written(table(spark, folder, "nation"), ",", "quoted")
    return _command(spark, path, "csv", "--delim", ",", "--out-format", "tsv", "--query", "select int(a1) + 1, a2")


@registered("SELECT 0 AS code, upper(n_name) || '!' AS line FROM nation")
def command_line_init_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "init").removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(INIT)
    return _command(spark, _written(table(spark, folder, "nation"), ",", "quoted"), "csv", "--delim", ",", "--init-source-file", path, "--query", "select shout(a2)")


@registered("""SELECT 1 AS code, '{"error_type": "query parsing", "error": "Unable to find column \\"q\\" in input header"}' AS line""")
def command_line_error(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(table(spark, folder, "region").coalesce(1), "concat(r_regionkey, ',', r_name)")
    return _command(spark, path, "csv", "--delim", ",", "--with-headers", "--error-format", "json", "--query", "select a.q")
