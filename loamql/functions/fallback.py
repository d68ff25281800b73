"""Expressions that have no column: evaluated in Python workers, batch-wise through Arrow.

The code of a query and of its init source runs with the rights of the workers; ``allow_python``
switches it off.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import types as T

from loamql.plans.lexer import ParsingError, RuntimeQueryError


class Record:
    """What ``a`` and ``b`` are in an expression: fields by attribute, name or number."""

    def __init__(self, fields: list, names: dict[str, int]) -> None:
        self.__dict__["_fields"] = fields
        self.__dict__["_names"] = names

    def __getattr__(self, name: str) -> object:
        if name not in self._names:
            raise AttributeError(name)
        return self._at(self._names[name])

    def _at(self, place: int) -> object:
        """A field, None behind the end of a short record."""
        return self._fields[place] if 0 <= place < len(self._fields) else None

    def __getitem__(self, key: str | int) -> object:
        if isinstance(key, int):
            return self._at(key - 1)
        return self._at(self._names[key])


def namespace(init_source: str, user: dict[str, object]) -> dict[str, object]:
    """The names an expression may use besides its fields."""
    import datetime
    import json
    import math
    import os
    import random
    import re
    import sys
    import time
    from collections import OrderedDict, defaultdict, namedtuple
    from types import SimpleNamespace

    from loamql.functions.compiler import like_regex

    def like(text: object, pattern: str) -> bool:
        return re.match(like_regex(pattern)[4:].replace(r"\z", r"\Z"), str(text)) is not None

    names: dict[str, object] = {
        "re": re, "ast": ast, "json": json, "random": random, "datetime": datetime, "os": os, "math": math, "time": time, "sys": sys,
        "OrderedDict": OrderedDict, "defaultdict": defaultdict, "namedtuple": namedtuple, "LIKE": like, "like": like, "Like": like,
        "Max": max, "MAX": max, "Min": min, "MIN": min, "Sum": sum, "SUM": sum, "udf": SimpleNamespace(**user), "LOAMQL_VERSION": __import__("loamql").__version__,
    }
    if init_source:
        try:
            exec(init_source, names)  # noqa: S102 - the user's own code
        except Exception as e:
            raise RuntimeQueryError(f"Exception while executing user-provided init code: {e}") from e
    return names


class Evaluator:
    """Evaluates one expression over rows; made once per worker."""

    def __init__(self, source: str, variables: list[str], records: dict[str, tuple[int, dict[str, int]]], init_source: str, user: dict[str, object]) -> None:
        self.source, self.variables, self.records, self.init_source, self.user = source, variables, records, init_source, user
        self.call = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"call": None}

    def __call__(self, *values: object) -> object:
        if self.call is None:
            # one function of the fields, compiled once a worker: no code is compiled or looked up per row
            self.fields = [n for n, v in enumerate(self.variables) if v not in ("__record", "__none", "__a", "__b")]
            self.readers = [(at, names) for at, names in self.records.values()]
            self.record = self.variables.index("__record") if "__record" in self.variables else None
            parameters = ", ".join([*(self.variables[n] for n in self.fields), *self.records])
            self.call = eval(f"lambda {parameters}: ({self.source})", namespace(self.init_source, self.user))  # noqa: S307 - the query's own expression
        given = [values[n] for n in self.fields]
        for at, names in self.readers:
            held = values[at]
            given.append(Record([] if held is None else list(held.values()) if isinstance(held, dict) else list(held), names))
        try:
            return self.call(*given)
        except Exception as e:
            if self.record is not None:
                raise RuntimeQueryError(f"At record {values[self.record]}, Details: {e}") from e
            raise


def kinds_of(value: object) -> set[str]:
    """The kinds of a value and, behind "list/", of its elements; none of None."""
    import datetime

    if value is None:
        return set()
    if isinstance(value, (list, tuple, set)) and type(value) in (list, tuple, set):
        return {"list"} | {f"list/{k}" for x in value for k in kinds_of(x)}
    names = {str: "str", bool: "bool", int: "int", float: "float", Decimal: "float", datetime.datetime: "datetime", datetime.date: "date"}
    return {names.get(type(value), "other")}


def type_of_kinds(kinds: set[str]) -> T.DataType:
    """The narrowest type that holds all of ``kinds``; string if they are unlike."""
    own = {k for k in kinds if "/" not in k}
    if own == {"bool"}:
        return T.BooleanType()
    if own and own <= {"int", "bool"}:
        return T.LongType()
    if own and own <= {"int", "float", "bool"}:
        return T.DoubleType()
    if own == {"list"}:
        return T.ArrayType(type_of_kinds({k[5:] for k in kinds if "/" in k}))
    if own == {"datetime"}:
        return T.TimestampType()
    if own == {"date"}:
        return T.DateType()
    return T.StringType()


def spark_type(values: list[object]) -> T.DataType:
    """The narrowest type that holds all of ``values``; string if they are unlike."""
    return type_of_kinds({k for v in values for k in kinds_of(v)})


def seen(call: Callable[..., object]) -> Callable[..., list[str]]:
    """The kinds of ``call``'s result; an error counts when the result is asked for."""

    def kinds(*args: object) -> list[str]:
        try:
            return sorted(kinds_of(call(*args)))
        except Exception:
            return []

    return kinds


def coerced(call: Callable[..., object], kind: T.DataType) -> Callable[..., object]:
    """``call`` with results of the declared type; what can't be of it becomes text or an error."""

    def fit(value: object, kind: T.DataType) -> object:
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
        if isinstance(kind, T.LongType):
            if isinstance(value, float) and value != int(value):
                raise RuntimeQueryError(f"the expression gave {value!r} where whole numbers were seen over all rows")
            return int(value)
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.ArrayType):
            return [fit(v, kind.elementType) for v in value]
        return value

    return lambda *args: fit(call(*args), kind)


def checked(source: str) -> ast.expr:
    try:
        return ast.parse(source, mode="eval").body
    except SyntaxError as e:
        raise ParsingError(f"Invalid expression: {source}: {e.msg}") from e
