"""The public entry points."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loamql.operators.engine import Options, Planner, depends_on_order
from loamql.plans.lexer import ParsingError, QueryError, stages
from loamql.plans.stage import parse_stage
from loamql.sinks import writers
from loamql.sources import delimited, others
from loamql.sources.tables import NR, Table, from_frame

Finder = Callable[[str, "str | None"], "Table | None"]


@dataclass
class Result:
    """A query's rows, header and warnings; the rows are lazy."""

    table: Table
    python_expressions: list[str]
    output_checks: list[Callable[[], list[str]]] = field(default_factory=list)
    replay: Callable[[int], Result] | None = None  # the same query over the first so many records
    n_records: Callable[[], int] = int  # of the input

    @property
    def df(self) -> DataFrame:
        return self.table.frame()

    @property
    def header(self) -> list[str] | None:
        return self.table.header

    @property
    def warnings(self) -> list[str]:
        """What was unusual in the inputs, and in the output where its form is known; some of it takes a
        pass over them."""
        said: list[str] = []
        for w in [*self.table.warnings, *self.output_checks]:
            said += w() if callable(w) else [w]
        return list(dict.fromkeys(said))

    def rows(self) -> list[list[object]]:
        with self.placing_errors():
            return [self._fields(r) for r in self.df.collect()]

    def iterate_rows(self) -> Iterator[list[object]]:
        """The lists of ``rows``, in their order; the driver holds those of one partition at a time."""
        with self.placing_errors():
            for r in self.df.toLocalIterator():
                yield self._fields(r)

    def _fields(self, row: Row) -> list[object]:
        return list(row[0]) if self.table.ragged else list(row)

    @contextmanager
    def placing_errors(self) -> Iterator[None]:
        """Errors of the input are raised with the place that the checks of the sources find."""
        try:
            yield
        except QueryError:
            raise
        except Exception as e:
            if not _debug:
                for check in self.table.checks if error_info(e)[0] == "IO handling" else ():
                    if found := check():
                        raise found from e
            raise


    def first_bad_record(self) -> tuple[int, str] | None:
        """(number, message) of the first record of the input with which the query fails, None if it ends.

        The query is run over its first 1, 2, 4, ... records until it fails, then the number is halved in; so
        it takes about as long as the query over four times the records up to the bad one.
        """

        def failure(n: int) -> Exception | None:
            try:
                self.replay(n).df.write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001 - it is what is looked for
                return e
            return None

        low, high = 0, 1
        while (found := failure(high)) is None:
            low, high = high, high * 2
            if low >= self.n_records():
                return None
        while high - low > 1:
            middle = (low + high) // 2
            error = failure(middle)
            low, high, found = (low, middle, error) if error else (middle, high, found)
        return high, error_info(found)[1]


def run(text: str, source: Table | None, find: Finder | None, options: Options) -> Result:
    """Plan all stages of ``text``; ``find`` looks tables up by name and the stage's modifier."""
    try:
        return _run(text, source, find, options)
    except ParsingError as e:
        if _debug:
            raise
        for word, hint in HINTS.items():
            if re.search(rf"\s{word}\s", text, re.IGNORECASE) and hint not in str(e):
                raise ParsingError(f"{e}. {hint}") from e
        raise


_debug = False


def set_debug_mode(value: bool = True) -> None:
    """Let errors through as they are raised, without hints."""
    global _debug
    _debug = value


# What to say of keywords that other dialects have.
HINTS = {
    "HAVING": "There is no HAVING: pipe the groups into a stage with WHERE, as in ... GROUP BY a1 | SELECT * WHERE a2 > 1",
    "LIKE": "LIKE is a function: WHERE LIKE(a1, 'text%')",
    "FROM": "FROM names the input only where it isn't given by the context",
}


def _run(text: str, source: Table | None, find: Finder | None, options: Options, within: int | None = None) -> Result:
    current = source
    table = first = None
    plans = [parse_stage(parts, with_from=source is None and n == 0) for n, parts in enumerate(stages(text))]
    for n, stage in enumerate(plans):
        options.sort_stages = any(depends_on_order(later) for later in plans[n + 1 :])
        if current is None:
            if stage.source is None:
                raise ParsingError('Queries without context-based input table must contain "FROM" statement')
            current = find(stage.source, stage.modifier) if find else None
            if current is None:
                raise ParsingError(f'Unable to find input table: "{stage.source}"')
        elif n == 0 and stage.modifier and isinstance(current, ModifiedTable):
            current = current.modified(stage.modifier)
        if n == 0:
            current = first = current.table if isinstance(current, ModifiedTable) else current
            if within is not None:
                numbered = first.with_numbers()
                current = replace(numbered, df=numbered.df.filter(F.col(NR) <= within))
        lookup = None if find is None else lambda name, m=stage.modifier: find(name, m)
        table = Planner(stage, current, lookup, options).run()
        current = table
    again = lambda n: _run(text, source, find, replace(options, python_expressions=[]), n)
    return Result(table, options.python_expressions, replay=again, n_records=lambda: first.df.count())


class ModifiedTable:
    """A source whose reading depends on WITH (header) or WITH (noheader)."""

    def __init__(self, read: Callable[[str | None], Table]) -> None:
        self.read = read
        self.table_read: Table | None = None

    def modified(self, modifier: str) -> Table:
        return self.read(modifier)

    @property
    def table(self) -> Table:
        if self.table_read is None:
            self.table_read = self.read(None)
        return self.table_read


def query(
    text: str,
    source: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    init_code: str = "",
    namespace: Mapping[str, object] | None = None,
    allow_python: bool = True,
    strict_nulls: bool = False,
) -> Result:
    """Run ``text`` over DataFrames: ``source`` is a, or FROM names one of ``tables``; joins name one
    of ``tables`` too."""
    known = {k: from_frame(v) for k, v in (tables or {}).items()}

    def find(name: str, modifier: str | None) -> Table | None:
        return known.get(name)

    options = Options(init_code, dict(namespace or {}), allow_python, strict_nulls=strict_nulls)
    return run(text, from_frame(source) if source is not None else None, find if tables is not None else None, options)


def query_tables(spark: SparkSession, text: str, folder: str, **options: object) -> DataFrame:
    """Run ``text`` over the Parquet tables of a folder, FROM and joins naming them."""

    def find(name: str, modifier: str | None) -> Table | None:
        return from_frame(spark.read.parquet(f"{folder}/{name}.parquet"))

    return run(text, None, find, Options(**options)).df


def error_info(error: Exception) -> tuple[str, str]:
    """(kind, message) of an error; Spark's own are told by what raised them."""
    if isinstance(error, QueryError):
        return error.kind, str(error)
    if isinstance(error, SyntaxError):
        return "syntax error", str(error)
    text = str(error)
    if told := re.search(r"\[USER_RAISED_EXCEPTION\]\s*(.*?)\s*SQLSTATE: \w+", text, re.DOTALL):
        return "IO handling" if told.group(1).startswith(INPUT_OUTPUT) else "query execution", told.group(1)
    if "ARITHMETIC_OVERFLOW" in text:
        return "query execution", "a whole number is beyond 64 bits"
    if "PythonException" in type(error).__name__ or "CAST_INVALID_INPUT" in text or "DIVIDE_BY_ZERO" in text:
        lines = [x.strip() for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("at ", "File ", "Traceback", "==", "JVM"))]
        told = [x for x in lines if re.match(r"[\w.]*(Error|Exception)\b.*: ", x) and "Traceback" not in x]
        return "query execution", re.sub(r"\s*SQLSTATE: \w+.*|^\[\w+(?:\.\w+)*\]\s*", "", (told or lines or [text])[-1 if told else 0])
    return "unexpected", text


# How messages begin that tell of inputs and outputs rather than of the query.
INPUT_OUTPUT = ("Unable to decode input table", "Inconsistent double quote escaping", "Error decoding JSON", "Unable to use monocolumn", "Inconsistent number of columns in output")


def _find_delimited(spark: SparkSession, input_path: str | None, delim: str, policy: str, encoding: str | None, has_header: bool, **options: object) -> Finder:
    def find(name: str, modifier: str | None) -> Table | None:
        path = delimited.table_path(name, input_path)
        if path is None:
            return None
        return delimited.read_delimited(spark, path, delim, policy, encoding, has_header, table_name="join", modifier=modifier, **options)

    return find


def query_csv(
    spark: SparkSession, text: str, input_path: str, delim: str = ",", policy: str | None = None, output_path: str | None = None, output_delim: str | None = None,
    output_policy: str | None = None, encoding: str | None = "utf-8", with_headers: bool = False, comment_prefix: str | None = None, init_code: str = "",
    strip_whitespaces: bool = False, comment_regex: str | None = None, single_file: bool = True, allow_python: bool = True,
) -> Result:
    """Run ``text`` over a text file or folder; with ``output_path`` write the result as text.

    ``single_file`` writes one file in order through the driver, a partition at a time; otherwise a
    folder of one file per task, without header.
    """
    policy = policy or delimited.default_policy(delim)
    output_delim = delim if output_delim is None else output_delim
    output_policy = output_policy or (policy if output_delim == delim else delimited.default_policy(output_delim))
    delimited.check_dialect(delim, policy, encoding, text)
    delimited.check_dialect(output_delim, output_policy, encoding, text)
    options = dict(comment_prefix=comment_prefix, comment_regex=comment_regex, strip_whitespaces=strip_whitespaces)
    source = ModifiedTable(lambda m: delimited.read_delimited(spark, input_path, delim, policy, encoding, with_headers, modifier=m, **options))
    find = _find_delimited(spark, input_path, delim, policy, encoding, with_headers, **options)
    result = run(text, source, find, Options(init_code or default_init_code(), {}, allow_python, keep_order=True))
    result.output_checks.append(lambda: writers.output_warnings(result.table, output_delim, output_policy))
    _write(result, output_path, output_delim, output_policy, encoding, single_file)
    return result


def _write(result: Result, path: str | None, delim: str, policy: str, encoding: str | None = "utf-8", single_file: bool = True) -> None:
    if not path:
        return
    with result.placing_errors():
        if single_file:
            with open(path, "w", encoding=encoding or "latin-1", newline="") as out:
                writers.write_stream(result.table, out, delim, policy)
        else:
            writers.write_folder(result.table, path, delim, policy)


def query_json(spark: SparkSession, text: str, input_path: str, output_path: str | None = None, init_code: str = "", tables: Mapping[str, str] | None = None) -> Result:
    """Run ``text`` over JSON Lines; a1 is each line's value. ``tables`` names files to join."""
    find = None if tables is None else (lambda name, m: others.read_jsonl(spark, tables[name], "join") if name in tables else None)
    result = run(text, others.read_jsonl(spark, input_path), find, Options(init_code or default_init_code(), keep_order=True))
    if output_path:
        with result.placing_errors(), open(output_path, "w", encoding="utf-8") as out:
            for row in writers.json_lines(result.table).toLocalIterator():
                out.write(row[0] + "\n")
    return result


def query_sqlite(
    spark: SparkSession, text: str, database: str, table: str | None = None, init_code: str = "", output_path: str | None = None, output_delim: str = ",",
    output_policy: str = "quoted_rfc", single_file: bool = True,
) -> Result:
    """Run ``text`` over tables of an SQLite file; joins name tables of the same file. With
    ``output_path`` write the result as text."""

    def find(name: str, modifier: str | None) -> Table | None:
        return others.read_sqlite(spark, database, name)

    source = others.read_sqlite(spark, database, table) if table else None
    result = run(text, source, find, Options(init_code or default_init_code(), keep_order=True))
    result.output_checks.append(lambda: writers.output_warnings(result.table, output_delim, output_policy))
    _write(result, output_path, output_delim, output_policy, single_file=single_file)
    return result


def query_dataframe(spark: SparkSession, text: str, frame: object, join_frame: object | None = None, init_code: str = ""):  # noqa: ANN201
    """Run ``text`` over a pandas or Spark frame, b being ``join_frame``; gives a frame of the same kind."""
    find = None if join_frame is None else (lambda name, m: others.from_any(spark, join_frame) if name in ("b", "B") else None)
    result = run(text, others.from_any(spark, frame), find, Options(init_code, keep_order=True))
    return result.df if isinstance(frame, DataFrame) else _pandas(result)


def _pandas(result: Result):  # noqa: ANN202
    pdf = result.df.toPandas()
    if result.header is None:
        pdf.columns = range(len(pdf.columns))
    return pdf


def query_table(
    spark: SparkSession, text: str, rows: list[list[object]], join_rows: list[list[object]] | None = None, header: list[str] | None = None,
    join_header: list[str] | None = None, init_code: str = "", namespace: Mapping[str, object] | None = None,
) -> Result:
    """Run ``text`` over lists of fields, b being ``join_rows``."""
    find = None if join_rows is None else (lambda name, m: others.from_lists(spark, join_rows, join_header) if name in ("b", "B") else None)
    return run(text, others.from_lists(spark, rows, header), find, Options(init_code, dict(namespace or {}), keep_order=True))


INIT_FILE = "~/.loamql_init_source.py"


def default_init_code() -> str:
    """The user's init file, empty if there is none."""
    path = os.path.expanduser(INIT_FILE)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as source:
            return source.read()
    return ""
