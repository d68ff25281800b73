"""JSON Lines, pandas, SQLite and lists as tables."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamql.functions.compiler import rendered_text
from loamql.functions.fallback import spark_type
from loamql.plans.lexer import IOHandlingError, RuntimeQueryError
from loamql.sources.tables import FIELDS, NR, Table, from_frame, number


def read_jsonl(spark: SparkSession, path: str, table_name: str = "input") -> Table:
    """One column, the JSON value of each line that isn't blank; a line that isn't JSON is an error, whose
    record and line are looked up when a run has failed."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        raise IOHandlingError(f"Unable to read {path}: {str(e).splitlines()[0]}") from e
    wrong = f"Error decoding JSON in {table_name} table"
    guarded = F.coalesce(F.try_parse_json("value"), F.parse_json(F.raise_error(F.lit(wrong)).cast("string")))

    def place() -> Exception | None:
        numbered = number(lines)
        bad = numbered.filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).orderBy(NR).head(1)
        if not bad:
            return None
        record = numbered.filter((F.trim("value") != "") & (F.col(NR) <= bad[0][NR])).count()
        detail = "it is no JSON value"
        try:
            json.loads(bad[0]["value"])
        except json.JSONDecodeError as e:
            detail = str(e)
        return IOHandlingError(f"{wrong} at record {record}, line {bad[0][NR]}: {detail}")

    return Table(lines.filter(F.trim("value") != "").select(guarded.alias("c1")), None, checks=[place])


def from_pandas(spark: SparkSession, pdf) -> Table:  # noqa: ANN001
    """A pandas frame: its cells with their types, its columns as header unless they are a range."""
    import pandas as pd

    plain = isinstance(pdf.columns, pd.RangeIndex) or len(pdf.columns) == 0
    header = None if plain else [str(c) for c in pdf.columns]
    copy = pdf.reset_index(drop=True)
    copy.columns = [f"c{n + 1}" for n in range(len(pdf.columns))]
    copy[NR] = range(1, len(copy) + 1)
    fields = []
    for name in copy.columns:
        kind = copy[name].dtype
        if kind == object or str(kind) in ("str", "string"):
            values = [None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in copy[name]]
            fields.append(T.StructField(name, spark_type(values)))
        elif str(kind).startswith(("int", "Int", "uint", "UInt")):
            fields.append(T.StructField(name, T.LongType()))
        elif str(kind).startswith(("float", "Float")):
            fields.append(T.StructField(name, T.DoubleType()))
        elif str(kind) in ("bool", "boolean"):
            fields.append(T.StructField(name, T.BooleanType()))
        elif str(kind).startswith("datetime"):
            fields.append(T.StructField(name, T.TimestampNTZType()))
        else:
            fields.append(T.StructField(name, T.StringType()))
    schema = T.StructType(fields)
    if not len(copy):
        return Table(spark.createDataFrame([], schema), header, numbered=True)
    rows = [[None if v is None or v is pd.NA or isinstance(v, float) and v != v and not isinstance(f.dataType, T.DoubleType) else v for v, f in zip(r, fields)] for r in copy.astype(object).itertuples(index=False)]
    rows = [[str(v) if v is not None and isinstance(f.dataType, T.StringType) and not isinstance(v, str) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v, f in zip(r, fields)] for r in rows]
    return Table(spark.createDataFrame(rows, schema), header, numbered=True)


def from_lists(spark: SparkSession, rows: list[list[object]], header: list[str] | None = None) -> Table:
    """Lists of fields; records of unequal width become text."""
    widths = {len(r) for r in rows}
    if header is not None and rows and len(header) != len(rows[0]):
        raise RuntimeQueryError("List of column names and table records have different lengths")
    if len(widths) > 1:
        data = [(n + 1, [rendered_text(v) for v in r]) for n, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"{NR} bigint, {FIELDS} array<string>")
        note = f'Number of fields in "input" table is not consistent: e.g. {" and ".join(str(w) for w in sorted(widths)[:2])}'
        return Table(df, header, ragged=True, numbered=True, warnings=[note])
    width = len(rows[0]) if rows else len(header or [])
    kinds = [spark_type([r[n] for r in rows]) for n in range(width)]
    schema = T.StructType([T.StructField(f"c{n + 1}", k) for n, k in enumerate(kinds)] + [T.StructField(NR, T.LongType())])
    fit = lambda v, k: None if v is None else str(v) if isinstance(k, T.StringType) else float(v) if isinstance(k, T.DoubleType) else v
    data = [[fit(v, k) for v, k in zip(r, kinds)] + [n + 1] for n, r in enumerate(rows)]
    return Table(spark.createDataFrame(data, schema), header, numbered=True)


SQLITE_TYPES = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary"}
SQLITE_PART = 200_000  # rows that one task reads


def read_sqlite(spark: SparkSession, path: str, name: str) -> Table:
    """A table of an SQLite file that all workers can open, read in ranges of rowid."""
    if not re.fullmatch(r"[a-zA-Z0-9_]*", name):
        raise IOHandlingError(f'Unable to use "{name}": input table name can contain only alphanumeric characters and underscore')
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        try:
            header = [d[0] for d in db.execute(f"SELECT * FROM {name} LIMIT 0").description]
        except sqlite3.OperationalError as e:
            raise IOHandlingError(f'no such table "{name}"') from e
        # one scan tells which types each column holds
        quoted = ['"' + column.replace('"', '""') + '"' for column in header]
        tests = ", ".join(f"max(typeof({q}) = '{t}')" for q in quoted for t in SQLITE_TYPES)
        held = db.execute(f"SELECT {tests} FROM {name}").fetchone() if header else ()
        kinds = []
        for n in range(len(header)):
            seen = {t for k, t in enumerate(SQLITE_TYPES) if held[n * len(SQLITE_TYPES) + k]}
            kinds.append("double" if seen == {"integer", "real"} else SQLITE_TYPES[seen.pop()] if len(seen) == 1 else "string")
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
            key = "rowid"
        except sqlite3.OperationalError:  # a table WITHOUT ROWID is read by one task
            low, high, key = 0, 0, None
    low, high = low or 0, high or 0
    parts = max(1, -(-(high - low + 1) // SQLITE_PART))
    names = [f"c{n + 1}" for n in range(len(header))]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), f"{NR}_key bigint"])

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for part in batch["id"]:
                    where = f" WHERE rowid BETWEEN {low + part * SQLITE_PART} AND {low + (part + 1) * SQLITE_PART - 1} ORDER BY rowid" if key else ""
                    rows = db.execute(f"SELECT {'rowid' if key else '0'}, * FROM {name}{where}").fetchall()
                    frame = pd.DataFrame([r[1:] for r in rows], columns=names, dtype=object)
                    for n, k in zip(names, kinds):
                        if k == "string":
                            frame[n] = [None if v is None else v if isinstance(v, str) else str(v) for v in frame[n]]
                        elif k in ("bigint", "double"):
                            frame[n] = frame[n].astype("Int64" if k == "bigint" else "Float64")
                    frame[f"{NR}_key"] = [r[0] if key else i for i, r in enumerate(rows)]
                    yield frame

    df = spark.range(0, parts, 1, parts).mapInPandas(read, schema)
    ordered: DataFrame = df.drop(f"{NR}_key")
    return Table(ordered, header)


def from_any(spark: SparkSession, table: object) -> Table:
    """A Spark or pandas frame."""
    return from_frame(table) if isinstance(table, DataFrame) else from_pandas(spark, table)
