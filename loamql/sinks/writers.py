"""Results as delimited text, JSON Lines and coloured lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamql.functions.compiler import type_of
from loamql.operators.engine import rendered
from loamql.plans.lexer import IOHandlingError
from loamql.sources.tables import FIELDS, Table

# ANSI codes that columns cycle through.
COLOURS = ["\x1b[0m", "\x1b[31m", "\x1b[32m", "\x1b[33m", "\x1b[34m", "\x1b[35m", "\x1b[36m"]


def field_texts(table: Table, delim: str) -> Column:
    """Each record as an array of texts, null where a value is null."""
    if table.ragged:
        return F.col(FIELDS)
    separator = ";" if delim == "|" else "|"
    cols = []
    for name in table.names():
        kind, item = type_of(table.df.schema[name].dataType)
        cols.append(rendered(F.col(name), kind, item, separator).cast("string"))
    return F.array(*cols) if cols else F.array().cast("array<string>")


def quote(field: Column, delim: str, policy: str) -> Column:
    """A field as the policy writes it."""
    if policy not in ("quoted", "quoted_rfc"):
        return field
    needed = field.contains('"') | (field.contains(delim) if delim else F.lit(False))
    if policy == "quoted_rfc":
        needed = needed | field.rlike("[\\n\\r]")
    return F.when(needed, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def text_lines(table: Table, delim: str, policy: str) -> DataFrame:
    """(value) of each record; the header isn't among them. A record of another width than the header
    is an error, as is a second field under ``monocolumn``."""
    fields = field_texts(table, delim)
    if policy == "monocolumn":
        if not table.ragged and table.width > 1:
            raise IOHandlingError("Unable to use monocolumn output format: some records have more than one column")
        fields = F.when(F.size(fields) > 1, F.raise_error(F.lit("Unable to use monocolumn output format: some records have more than one column")).cast("array<string>")).otherwise(fields)
    if table.header is not None:
        width = len(table.header)
        if not table.ragged and table.width != width:
            raise IOHandlingError(f"Inconsistent number of columns in output header and the current record: {width} != {table.width}")
        if table.ragged:
            wrong = F.raise_error(F.concat(F.lit(f"Inconsistent number of columns in output header and the current record: {width} != "), F.size(fields).cast("string")))
            fields = F.when(F.size(fields) != width, wrong.cast("array<string>")).otherwise(fields)
    texts = F.transform(fields, lambda x: quote(F.coalesce(x, F.lit("")), delim, policy))
    return table.df.select(F.array_join(texts, delim if policy != "monocolumn" else "").alias("value"))


def output_warnings(table: Table, delim: str, policy: str) -> list[str]:
    """Whether nulls became empty fields, or fields hold the separator; one pass over the result."""
    fields = field_texts(table, delim)
    nulls = F.max(F.exists(fields, lambda x: x.isNull()).cast("int"))
    holds = F.max(F.exists(fields, lambda x: x.contains(delim)).cast("int")) if policy in ("simple", "whitespace") and delim else F.lit(0)
    found = table.df.agg(nulls.alias("n"), holds.alias("h")).first()
    out = []
    if found["n"]:
        out.append("null values in output were replaced by empty strings")
    if found["h"]:
        out.append("Some output fields contain separator")
    return out


def header_line(table: Table, delim: str, policy: str) -> str | None:
    if table.header is None:
        return None

    def put(name: str) -> str:
        special = policy in ("quoted", "quoted_rfc") and ('"' in name or delim and delim in name or policy == "quoted_rfc" and ("\n" in name or "\r" in name))
        return '"' + name.replace('"', '""') + '"' if special else name

    return delim.join(put(h) for h in table.header)


def write_folder(table: Table, path: str, delim: str, policy: str) -> None:
    """One text file per task in a folder, without header."""
    text_lines(table, delim, policy).write.mode("error").text(path)


def iterate_lines(table: Table, delim: str, policy: str) -> Iterator[str]:
    head = header_line(table, delim, policy)
    if head is not None:
        yield head
    for row in text_lines(table, delim, policy).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def write_stream(table: Table, out: TextIO, delim: str, policy: str, line_separator: str = "\n", colour: bool = False) -> bool:
    """The result in order, a partition at a time; False if the reader of ``out`` went away."""
    try:
        if colour and policy != "monocolumn" and delim:
            for fields in _coloured(table, delim, policy):
                out.write(fields + line_separator)
        else:
            for line in iterate_lines(table, delim, policy):
                out.write(line + line_separator)
        out.flush()
    except BrokenPipeError:
        return False
    return True


def _coloured(table: Table, delim: str, policy: str) -> Iterator[str]:
    paint = lambda fields: delim.join(COLOURS[n % len(COLOURS)] + f for n, f in enumerate(fields)) + COLOURS[0]
    if table.header is not None:
        yield paint(table.header)
    texts = F.transform(field_texts(table, delim), lambda x: quote(F.coalesce(x, F.lit("")), delim, policy))
    for row in table.df.select(texts.alias("f")).toLocalIterator():
        yield paint(row[0])


def json_lines(table: Table) -> DataFrame:
    """(value) of each record: the bare value of a single column, else an object by header, or by col0
    and on."""
    options = {"ignoreNullFields": "false"}
    if table.ragged:
        return table.df.select(F.to_json(F.col(FIELDS)).alias("value"))
    names = table.names()
    if len(names) == 1:
        whole = F.to_json(F.struct(F.col(names[0]).alias("v")), options)
        return table.df.select(F.substring(whole, F.lit(6), F.length(whole) - 6).alias("value"))
    keys = table.header or [f"col{n}" for n in range(len(names))]
    return table.df.select(F.to_json(F.struct(*(F.col(n).alias(k) for n, k in zip(names, keys))), options).alias("value"))
