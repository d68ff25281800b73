"""From the plan of a stage to a DataFrame.

Order of work, each part only where the query has it: join, STRICT and duplicate guards, WHERE,
projection or aggregation or update, ORDER BY, DISTINCT, LIMIT. Record numbers are attached only
where the query mentions them or its result depends on the order of rows.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamql import __version__
from loamql.functions import fallback
from loamql.functions.compiler import Compiler, Unsupported, Value, float_text, parse, type_of
from loamql.plans.lexer import IOHandlingError, ParsingError, RuntimeQueryError
from loamql.plans.stage import Stage
from loamql.session import pin
from loamql.sources.tables import FIELDS, NR, Table, in_file_order, of_many_files

# The spellings of the aggregates.
AGGREGATES = {
    "count": ("COUNT", "count", "Count"), "min": ("MIN", "min", "Min"), "max": ("MAX", "max", "Max"), "sum": ("SUM", "sum", "Sum"), "avg": ("AVG", "avg", "Avg"),
    "variance": ("VARIANCE", "variance", "Variance"), "median": ("MEDIAN", "median", "Median"), "any_value": ("ANY_VALUE", "any_value", "Any_value"), "array_agg": ("ARRAY_AGG", "array_agg"),
}
AGGREGATE_OF = {spelling: name for name, spellings in AGGREGATES.items() for spelling in spellings}
UNNEST = ("UNNEST", "unnest", "Unnest")
EARLY_ROWS = 10_000  # a LIMIT of up to so many rows, without an order, is taken from the first tasks at once
FORBIDDEN = '"ORDER BY", "UPDATE" and "DISTINCT" keywords are not allowed in aggregate queries'
INSIDE = "Aggregate functions can't be used inside other expressions"


@dataclass
class Options:
    """What a query may use besides its tables."""

    init_source: str = ""
    user: dict[str, object] = field(default_factory=dict)
    allow_python: bool = True
    sort_stages: bool = False  # set for a stage when a later one depends on the order of its rows
    keep_order: bool = False  # rows come out in input order also behind a join or DISTINCT
    strict_nulls: bool = False  # nulls in MIN, MAX, SUM, AVG, VARIANCE and MEDIAN are errors
    python_expressions: list[str] = field(default_factory=list)  # filled: those that aren't columns


class Scope:
    """The variables of a stage and the frame that holds them."""

    def __init__(self, a: Table, b: Table | None) -> None:
        self.a, self.b = a, b
        self.sides = {"a": a} | ({"b": b} if b else {})
        self.max_b: Column | None = None
        self.types: dict[str, tuple[str, str]] = {}
        self.decimals: set[str] = set()  # fields that are stored as decimals

    def column(self, side: str, n: int) -> Value | None:
        table = self.sides.get(side)
        if table is None:
            return None
        if table.ragged:
            return Value(F.get(F.col(f"{side}{FIELDS}"), F.lit(n - 1)), "str")
        if not 0 < n <= table.width:
            return Value(F.lit(None), "null")
        name = f"{side}{n}"
        if name in self.decimals:
            return Value(F.col(name).cast("double"), *self.types[name], raw=F.col(name))
        return Value(F.col(name), *self.types[name])

    def index(self, side: str, name: str) -> int | None:
        header = self.sides[side].header if side in self.sides else None
        if not header or name not in header:
            return None
        return len(header) - header[::-1].index(name)  # the last of equal names, from 1

    def special(self, name: str) -> Value | None:
        if name in ("NR", "aNR"):
            return Value(F.col(f"a{NR}"), "int")
        if name == "bNR" and self.b:
            return Value(F.col(f"b{NR}"), "int")
        if name in ("NF", "bNF"):
            side = "a" if name == "NF" else "b"
            table = self.sides.get(side)
            if table is None:
                return None
            if not table.ragged:
                return Value(F.lit(table.width).cast("long"), "int")
            size = F.size(F.col(f"{side}{FIELDS}")).cast("long")
            return Value(F.coalesce(F.when(F.col(f"{side}{FIELDS}").isNotNull(), size), self.max_b.cast("long") if self.max_b is not None else F.lit(None)), "int")
        if name == "LOAMQL_VERSION":
            return Value(F.lit(__version__), "str", const=__version__)
        return None

    def resolve(self, node: ast.expr) -> Value | None:
        """The value of a variable node, None if it is none."""
        if isinstance(node, ast.Name):
            if m := re.fullmatch(r"([ab])([1-9][0-9]*)", node.id):
                return self.column(m.group(1), int(m.group(2)))
            return self.special(node.id)
        if isinstance(node, (ast.Attribute, ast.Subscript)) and isinstance(node.value, ast.Name) and node.value.id in self.sides:
            side = node.value.id
            if isinstance(node, ast.Attribute):
                if node.attr == "NR":
                    return self.special(f"{side}NR")
                n = self.index(side, node.attr)
                if n is None:
                    raise ParsingError(f'Unable to find column "{node.attr}" in {"input" if side == "a" else "join"} header')
                return self.column(side, n)
            if isinstance(node.slice, ast.Constant):
                key = node.slice.value
                if isinstance(key, int):
                    return self.column(side, key)
                if isinstance(key, str):
                    n = self.index(side, key)
                    if n is None:
                        raise RuntimeQueryError(f'No "{key}" field at record 1')
                    return self.column(side, n)
        return None

    def header_name(self, node: ast.expr) -> str | None:
        """The name that a plain variable gives its output column."""
        if isinstance(node, ast.Name):
            if m := re.fullmatch(r"([ab])([1-9][0-9]*)", node.id):
                header = self.sides[m.group(1)].header if m.group(1) in self.sides else None
                n = int(m.group(2))
                return header[n - 1] if header and n <= len(header) else None
            return node.id
        if isinstance(node, (ast.Attribute, ast.Subscript)) and isinstance(node.value, ast.Name) and node.value.id in ("a", "b"):
            if isinstance(node, ast.Attribute):
                return node.attr
            if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
                return node.slice.value
            if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, int) and node.value.id in self.sides:
                header = self.sides[node.value.id].header
                return header[node.slice.value - 1] if header and 0 < node.slice.value <= len(header) else None
        return None


def depends_on_order(stage: Stage) -> bool:
    """Whether a stage's result depends on the order of its input's rows."""
    texts = [i.text for i in stage.items] + [e for _, e in stage.assignments or []] + [stage.where or "", *(stage.group or []), *(stage.order or [])]
    marks = r"(?<![\w.])(a?NR|a\.NR|ANY_VALUE|any_value|Any_value|ARRAY_AGG|array_agg)\b|\ba\.NR\b"
    return bool(stage.order or stage.distinct or stage.limit is not None and not stage.group) or any(re.search(marks, t) for t in texts) or bool(stage.join and any("NR" in x for p in stage.join.pairs for x in p))


class Planner:
    """Plans one stage."""

    def __init__(self, stage: Stage, a: Table, find: Callable[[str], Table | None] | None, options: Options) -> None:
        self.stage, self.options = stage, options
        self.a = a
        self.b: Table | None = None
        if stage.join:
            if find is None:
                raise ParsingError("JOIN operations are not supported by the application")
            self.b = find(stage.join.table)
            if self.b is None:
                raise ParsingError(f'Unable to find join table: "{stage.join.table}"')
            if (a.header is None) != (self.b.header is None):
                have = "has a header while the Join table doesn't have a header" if a.header else "doesn't have a header while the Join table has a header"
                raise IOHandlingError(f"Inconsistent modes: Input table {have}")
        self.warnings = [*a.warnings, *(self.b.warnings if self.b else [])]
        self.checks = [*a.checks, *(self.b.checks if self.b else [])]

    # -- what is needed ----------------------------------------------------------------------------

    def expressions(self) -> list[str]:
        s = self.stage
        out = [i.text for i in s.items if not i.star] + [e for _, e in s.assignments or []]
        out += [s.where] if s.where else []
        return [*out, *(s.group or []), *(s.order or [])]

    def mentions(self, *names: str) -> bool:
        texts = self.expressions() + ([x for p in self.stage.join.pairs for x in p] if self.stage.join else [])
        return any(re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", t) for n in names for t in texts)

    def aggregated(self) -> bool:
        if self.stage.group:
            return True
        return any(not i.star and not i.spread and self._holds_aggregate(parse(self._counted(i.text))) for i in self.stage.items)

    def _holds_aggregate(self, node: ast.expr) -> bool:
        """Whether an aggregate of fields or constants is anywhere in the expression."""
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call) and (call := self._aggregate_call(inner)):
                parts = [x for a in call.args[:1] for x in ast.walk(a)]
                names = [x for x in parts if isinstance(x, ast.Name)]
                if not names or any(x.id in ("a", "b") or self.scope_for_types.resolve(x) is not None for x in names):
                    return True
        return False

    @staticmethod
    def _counted(text: str) -> str:
        return re.sub(r"(?i)\bcount\s*\(\s*\*\s*\)", "COUNT(1)", text)

    def _aggregate_call(self, node: ast.expr) -> ast.Call | None:
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in AGGREGATE_OF):
            return None
        name = AGGREGATE_OF[node.func.id]
        if name in ("min", "max", "sum"):  # Python's own functions unless called with one scalar
            if len(node.args) != 1 or node.keywords or isinstance(node.args[0], (ast.List, ast.Tuple, ast.ListComp, ast.GeneratorExp, ast.Set, ast.Starred)):
                return None
            try:
                if self.scope_for_types is not None and Compiler(self.scope_for_types.resolve).value(node.args[0]).type == "list":
                    return None
            except (Unsupported, ParsingError):
                pass
        return node

    scope_for_types: Scope | None = None

    # -- the plan ----------------------------------------------------------------------------------

    def run(self) -> Table:
        s = self.stage
        grouped_in_order = False
        self.scope_for_types = self._scope(self.a, self.b)
        aggregates = s.assignments is None and not s.excluded and self.aggregated()
        if aggregates and (s.order or s.distinct):
            raise ParsingError(FORBIDDEN)
        if aggregates:
            grouped_in_order = any(k in ("any_value", "array_agg", "plain") for k in self._aggregate_kinds())
        ordered = s.order is not None or s.distinct and s.limit is not None or s.distinct_count or s.limit is not None and not aggregates and s.assignments is None
        self.early = (
            s.limit is not None and s.limit <= EARLY_ROWS and not (aggregates or s.assignments is not None or s.order or s.distinct or s.distinct_count or s.join)
            and not self.mentions("NR", "aNR", "a.NR") and not self.a.numbered and in_file_order(self.a.df)
        )
        ordered = ordered and not self.early
        keep = (self.options.sort_stages or self.options.keep_order and (s.join is not None or s.distinct or of_many_files(self.a.df))) and not aggregates
        keep = keep and not self.early
        ordered = ordered or keep
        self.sorted_out = keep
        short = s.assignments is not None and (self.a.ragged or ordered)  # a record without the field is named in the error
        if self.mentions("NR", "aNR", "a.NR") or short:
            self.a = self.a.with_numbers()
        elif ordered or grouped_in_order:
            self.a = self.a.with_order()
        if self.b and self.mentions("bNR", "b.NR"):
            self.b = self.b.with_numbers()
        elif self.b and (ordered or grouped_in_order):
            self.b = self.b.with_order()
        self.scope = self._scope(self.a, self.b)
        df = self._side("a", self.a)
        if self.b:
            df = self._join(df)
        if s.assignments is not None:
            return self._update(df)
        if s.where:
            df = df.filter(self._truth(s.where, filtering=True))
        return self._aggregate(df) if aggregates else self._select(df)

    def _aggregate_kinds(self) -> list[str]:
        kinds = []
        for item in self.stage.items:
            call = None if item.star or item.spread else self._aggregate_call(parse(self._counted(item.text)))
            kinds.append(AGGREGATE_OF[call.func.id] if call else "key" if item.text in (self.stage.group or []) else "plain")
        return kinds

    def _scope(self, a: Table, b: Table | None) -> Scope:
        scope = Scope(a, b)
        for side, table in scope.sides.items():
            if not table.ragged:
                for n, f in enumerate(f for f in table.df.schema.fields if f.name != NR):
                    scope.types[f"{side}{n + 1}"] = type_of(f.dataType)
                    if isinstance(f.dataType, T.DecimalType):
                        scope.decimals.add(f"{side}{n + 1}")
        return scope

    @staticmethod
    def _side(side: str, table: Table) -> DataFrame:
        if table.ragged:
            cols = [F.col(FIELDS).alias(f"{side}{FIELDS}")]
        else:
            cols = [F.col(c).alias(f"{side}{n + 1}") for n, c in enumerate(table.names())]
        return table.df.select(*cols, *([F.col(NR).alias(f"{side}{NR}")] if table.numbered else []))

    # -- expressions -------------------------------------------------------------------------------

    def _value(self, text: str, node: ast.expr | None = None) -> Value:
        node = node if node is not None else parse(text)
        try:
            value = Compiler(self.scope.resolve).value(node)
            if value.type == "match":
                raise Unsupported("a match as a value")
            return value
        except Unsupported as why:
            return self._in_python(ast.unparse(node), node, str(why))

    def _truth(self, text: str, filtering: bool = False) -> Column:
        node = parse(text)
        try:
            compiler = Compiler(self.scope.resolve)
            return compiler.condition(node) if filtering else compiler.truth(node)
        except Unsupported as why:
            test = ast.parse(f"bool({ast.unparse(node)})", mode="eval").body
            return F.coalesce(self._in_python(ast.unparse(test), test, str(why), T.BooleanType()).col, F.lit(False))

    def _in_python(self, source: str, node: ast.expr, why: str, kind: T.DataType | None = None) -> Value:
        if not self.options.allow_python:
            raise ParsingError(f"{source}: this needs Python workers, which are switched off ({why})")
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call) and isinstance(inner.func, ast.Name) and inner.func.id in (*UNNEST, *(s for n, ss in AGGREGATES.items() if n not in ("min", "max", "sum") for s in ss)):
                raise ParsingError(INSIDE if inner.func.id in AGGREGATE_OF else "UNNEST can only be a whole column")
        self.options.python_expressions.append(f"{source} ({why})")
        names, cols, records = [], [], {}
        for inner in ast.walk(node):
            if isinstance(inner, ast.Name) and inner.id not in names:
                if inner.id in self.scope.sides:
                    side = inner.id
                    table = self.scope.sides[side]
                    header = {h: n for n, h in enumerate(table.header or [])}
                    names.append(f"__{side}")
                    if table.ragged:
                        cols.append(F.col(f"{side}{FIELDS}"))
                    else:
                        cols.append(F.struct(*(F.col(f"{side}{n + 1}") for n in range(table.width))))
                    records.setdefault(side, (len(cols) - 1, header))
                else:
                    value = self.scope.resolve(inner)
                    if value is not None:
                        names.append(inner.id)
                        cols.append(value.col)
        if self.a.numbered and self.a.counted:  # for messages
            names.append("__record")
            cols.append(F.col(f"a{NR}"))
        fallback.namespace(self.options.init_source, self.options.user)  # its errors come now, not on a worker
        if not cols:
            names, cols = ["__none"], [F.lit(0)]
        call = fallback.Evaluator(source, names, records, self.options.init_source, self.options.user)
        if kind is None:
            kind = self._seen_type(call, cols)
        udf = F.udf(fallback.coerced(call, kind), kind, useArrow=True)
        if re.search(r"\b(random|time|now|today|os|udf)\b", source) or self.options.init_source:
            udf = udf.asNondeterministic()  # evaluated once per row, wherever it is used
        return Value(udf(*cols), *type_of(kind))

    def _seen_type(self, call: Callable[..., object], cols: list[Column]) -> T.DataType:
        """The type of the results on all rows; errors on the first rows are raised at once."""
        held = self._base.select(*(c.alias(f"v{n}") for n, c in enumerate(cols)))
        for n, row in enumerate(held.limit(50).collect()):
            try:
                call(*row)
            except RuntimeQueryError:
                raise
            except Exception as e:
                raise RuntimeQueryError(f"At record {n + 1}, Details: {e}") from e
        return self._kinds_over(call, held, [F.col(f"v{n}") for n in range(len(cols))])

    @staticmethod
    def _kinds_over(call: Callable[..., object], df: DataFrame, cols: list[Column]) -> T.DataType:
        """One pass of the workers over all rows folds the kinds of the results; only the kinds are collected."""
        kinds = F.udf(fallback.seen(call), "array<string>", useArrow=True)
        return fallback.type_of_kinds({r[0] for r in df.select(F.explode(kinds(*cols)).alias("kind")).distinct().collect()})

    # -- join --------------------------------------------------------------------------------------

    def _key(self, text: str, want: str) -> tuple[str, Value, int | None]:
        text = {"NR": "a.NR", "aNR": "a.NR", "bNR": "b.NR"}.get(text, text)
        node = parse(text)
        side = node.value.id if isinstance(node, (ast.Attribute, ast.Subscript)) and isinstance(node.value, ast.Name) else text[:1]
        value = self.scope.resolve(node)
        if value is None or side not in ("a", "b"):
            raise ParsingError(f'Unable to parse join expression: "{text}"')
        place = None
        if self.scope.sides[side].ragged and not text.endswith(".NR"):
            if isinstance(node, ast.Name):
                place = int(text[1:])
            elif isinstance(node, ast.Subscript) and isinstance(node.slice.value, int):
                place = node.slice.value
            else:
                place = self.scope.index(side, node.attr if isinstance(node, ast.Attribute) else node.slice.value)
        return side, value, place

    def _join(self, df: DataFrame) -> DataFrame:
        how = self.stage.join.how
        b = self._side("b", self.b).withColumn("__hit", F.lit(True))
        pairs = []
        for left, right in self.stage.join.pairs:
            one, two = self._key(left, "a"), self._key(right, "b")
            if {one[0], two[0]} != {"a", "b"}:
                raise ParsingError("Join keys must be one of each table")
            one, two = (one, two) if one[0] == "a" else (two, one)
            for side, value, place in (one, two):
                if place is not None:
                    held = F.col(f"{side}{FIELDS}")
                    text = f'No "a{place}" field at record ' if side == "a" else f'No field with index {place} at record '
                    tail = "" if side == "a" else ' in "B" table'
                    number = F.col(f"{side}{NR}").cast("string") if self.scope.sides[side].numbered and self.scope.sides[side].counted else F.lit("?")
                    guard = F.when(F.size(held) < place, F.raise_error(F.concat(F.lit(text), number, F.lit(tail)))).otherwise(F.lit(True))
                    if side == "a":
                        df = df.filter(guard)
                    else:
                        b = b.filter(guard)
            pairs.append((one[1], two[1]))
        keys_a, keys_b = [], []
        for n, (x, y) in enumerate(pairs):
            if x.number and y.number:
                kind = "double" if "float" in (x.type, y.type) else "long"
                cx, cy = x.col.cast(kind), y.col.cast(kind)
            elif x.type == y.type:
                kind, cx, cy = "", x.col, y.col
            else:  # keys of different kinds are never equal
                cx, cy = F.lit(1), F.lit(0)
                kind = ""
            keys_a.append((f"__ka{n}", cx, kind))
            keys_b.append((f"__kb{n}", cy, kind))
        df = df.withColumns({n: c for n, c, _ in keys_a})
        b = b.withColumns({n: c for n, c, _ in keys_b})
        if self.b.ragged:
            self.scope.max_b = F.lit(self.b.df.agg(F.coalesce(F.max(F.size(FIELDS)), F.lit(0))).first()[0])
        if how == "strict" or self.stage.assignments is not None:
            # only keys that b has more than once; none, as a rule
            many = b.groupBy(*(F.col(n).alias(f"__m{n}") for n, _, _ in keys_b)).agg(F.count(F.lit(1)).alias("__same")).filter(F.col("__same") > 1)
            same = [b[n].eqNullSafe(many[f"__m{n}"]) for n, _, _ in keys_b]
            b = b.join(many, same, "left").drop(*(f"__m{n}" for n, _, _ in keys_b)).withColumn("__same", F.coalesce("__same", F.lit(1)))
        cond = None
        for (x, _, kind), (y, _, _) in zip(keys_a, keys_b):
            one = df[x].eqNullSafe(b[y])
            if kind == "double":
                one = one & F.coalesce(~F.isnan(df[x]), F.lit(True))
            cond = one if cond is None else cond & one
        out = df.join(b, cond, "inner" if how == "inner" and self.stage.assignments is None else "left")
        shown = F.concat_ws(", ", *(F.coalesce(F.col(n).cast("string"), F.lit("None")) for n, _, _ in keys_a))
        if how == "strict":
            wrong = F.coalesce(F.col("__same"), F.lit(0)) != 1
            out = out.filter(F.when(wrong, F.raise_error(F.concat(F.lit('In "STRICT LEFT JOIN" each key in A must have exactly one match in B. Bad A key: "'), shown, F.lit('"')))).otherwise(F.lit(True)))
        elif self.stage.assignments is not None:
            twice = F.coalesce(F.col("__same"), F.lit(0)) > 1
            out = out.filter(F.when(twice, F.raise_error(F.concat(F.lit("More than one record in UPDATE query matched a key from the input table. Key: "), shown))).otherwise(F.lit(True)))
        return out

    # -- select ------------------------------------------------------------------------------------

    def _star(self, star: str) -> list[Value]:
        out = []
        for side in ("a", "b"):
            if star in ("*", f"{side}.*") and side in self.scope.sides:
                table = self.scope.sides[side]
                if table.ragged:
                    held = F.col(f"{side}{FIELDS}")
                    if side == "b" and self.scope.max_b is not None:  # a missing record is as many nulls as the widest has fields
                        held = F.coalesce(held, F.array_repeat(F.lit(None).cast("string"), self.scope.max_b))
                    out.append(Value(held, "fields"))
                else:
                    out += [Value(F.col(f"{side}{n + 1}"), *self.scope.types[f"{side}{n + 1}"]) for n in range(table.width)]
        return out

    def _header(self) -> list[str] | None:
        items = self.stage.items
        any_alias, any_star = any(i.alias for i in items), any(i.star for i in items)
        if self.a.header is None:
            if any_star and any_alias:
                raise ParsingError("Using both * (star) and AS alias in the same query is not allowed for input tables without header")
            if not any_alias:
                return None
        out: list[str] = []
        for item in items:
            if item.star:
                for side in ("a", "b"):
                    if item.star in ("*", f"{side}.*") and side in self.scope.sides:
                        out += self.scope.sides[side].header or []
            elif item.alias:
                out.append(item.alias)
            else:
                name = None if item.spread else self.scope.header_name(parse(self._counted(item.text)))
                out.append(name or f"col{len(out) + 1}")
        return out

    def _select(self, df: DataFrame) -> Table:
        s = self.stage
        self._base = df
        values: list[Value] = []
        unnested = None
        if s.excluded is not None:
            drop = set()
            for name in s.excluded:
                n = self._field_number(name)
                if n is None:
                    raise ParsingError(f'Unknown field in EXCEPT expression: "{name}"')
                drop.add(n)
            if self.a.ragged:
                at = F.array(*(F.lit(n - 1) for n in drop))
                values = [Value(F.filter(F.col(f"a{FIELDS}"), lambda _, i: ~F.array_contains(at, i)), "fields")]
            else:
                values = [Value(F.col(f"a{n + 1}"), *self.scope.types[f"a{n + 1}"]) for n in range(self.a.width) if n + 1 not in drop]
            header = None if self.a.header is None else [h for n, h in enumerate(self.a.header) if n + 1 not in drop]
        else:
            header = self._header()
            for item in s.items:
                if item.star:
                    values += self._star(item.star)
                    continue
                node = parse(item.text)
                if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in UNNEST and len(node.args) == 1:
                    if unnested is not None:
                        raise ParsingError("Only one UNNEST is allowed per query")
                    value = self._value("", node.args[0])
                    if value.type != "list":
                        raise ParsingError("UNNEST needs a list")
                    unnested = len(values)
                    values.append(value)
                    continue
                value = self._value(item.text, node)
                if item.spread:
                    if value.type != "list":
                        raise ParsingError(f"*{item.text}: only a list can become columns")
                    value = Value(value.col, "fields", value.item)
                values.append(value)
        made = df.withColumns({f"__o{n}": v.col if v.raw is None else v.raw for n, v in enumerate(values)}) if values else df
        keys = []
        if s.order:
            for n, text in enumerate(s.order):
                made = made.withColumn(f"__s{n}", self._value(text).col)
                keys.append(f"__s{n}")
        if unnested is not None:
            made = made.select("*", F.posexplode(f"__o{unnested}").alias("__at", "__one")).drop(f"__o{unnested}").withColumnRenamed("__one", f"__o{unnested}")
            values[unnested] = Value(F.col(f"__o{unnested}"), values[unnested].item)
        places = [c for c in (f"a{NR}", f"b{NR}", "__at") if c in made.columns]
        if any(v.type == "fields" for v in values):  # records of any width
            parts = [F.col(f"__o{n}") if v.type == "fields" and v.item in ("other", "str") else F.transform(f"__o{n}", _renderer(v.item)) if v.type == "fields" else F.array(rendered(F.col(f"__o{n}"), v.type)) for n, v in enumerate(values)]
            made = made.select(F.concat(*parts).alias(FIELDS), *keys, *places)
            ragged, names = True, [FIELDS]
        else:
            made = made.select(*(F.col(f"__o{n}").alias(f"c{n + 1}") for n in range(len(values))), *keys, *places)
            ragged, names = False, [f"c{n + 1}" for n in range(len(values))]
        return self._finish(made, names, header, ragged, keys, places)

    def _finish(self, made: DataFrame, names: list[str], header: list[str] | None, ragged: bool, keys: list[str], places: list[str]) -> Table:
        """Sort, then DISTINCT, then LIMIT, as the rows would flow through them."""
        s = self.stage
        down = s.descending
        order = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k in [*keys, *places]] if keys else [F.col(p).asc() for p in places]
        if s.distinct_count or s.distinct and (s.limit is not None or keys or self.sorted_out):
            # the first of equal rows is the one that comes first in the order
            first = F.struct(*(F.col(c) for c in [*keys, *places]))
            picked = (F.max if down and keys else F.min)(first).alias("__first")
            grouped = made.groupBy(*names).agg(picked, F.count(F.lit(1)).alias("__count"))
            made = grouped.select(*names, "__count", *(F.col(f"__first.{c}").alias(c) for c in [*keys, *places]))
        elif s.distinct:
            made = made.select(*names).distinct()
        if s.distinct_count:
            if ragged:
                made = made.withColumn(FIELDS, F.concat(F.array(F.col("__count").cast("string")), F.col(FIELDS)))
            else:
                renamed = [F.col("__count").alias("c1"), *(F.col(c).alias(f"c{n + 2}") for n, c in enumerate(names))]
                made = made.select(*renamed, *keys, *places)
                names = [f"c{n + 1}" for n in range(len(names) + 1)]
            header = None if header is None else ["count", *header]
        if self.early:
            # the first tasks' first rows are the first rows: no other task is started once they are found
            first, spark = made.select(*names), made.sparkSession
            held = spark._jsparkSession.createDataFrame(first._jdf.takeAsList(s.limit), first._jdf.schema())
            return Table(DataFrame(held, spark), header, ragged, warnings=self.warnings, checks=self.checks)
        if keys or (s.limit is not None and places) or s.distinct_count or self.sorted_out:
            made = made.orderBy(*order)
        if s.limit is not None:
            made = made.limit(s.limit)
        return Table(made.select(*names), header, ragged, warnings=self.warnings, checks=self.checks)

    def _field_number(self, name: str) -> int | None:
        node = parse(name)
        if isinstance(node, ast.Name) and (m := re.fullmatch(r"a([1-9][0-9]*)", node.id)):
            return int(m.group(1))
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "a":
            return self.scope.index("a", node.attr)
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "a" and isinstance(node.slice, ast.Constant):
            key = node.slice.value
            return key if isinstance(key, int) else self.scope.index("a", key)
        return None

    # -- aggregation -------------------------------------------------------------------------------

    def _numbers(self, v: Value) -> Value:
        """A value as a number: text is whole numbers if all of it is, else floats."""
        if v.number:
            return Value(v.col.cast("long"), "int") if v.type == "bool" else v
        if v.type == "str":
            text = F.trim(v.col)
            return Value(text.cast("long"), "int") if self.whole[v.col._jc.toString()] else Value(text.cast("double"), "float")
        if v.type == "json":
            return Value(F.variant_get(v.col, "$", "double"), "float")
        raise RuntimeQueryError(f"Unable to convert value of type {v.type} to a number")

    def _whole_texts(self, df: DataFrame, values: list[Value]) -> dict[str, bool]:
        """Whether each text that is aggregated as a number is a whole number in all rows; one pass for all."""
        texts = {v.col._jc.toString(): v.col for v in values if v.type == "str"}
        if not texts:
            return {}
        odd = [F.max((F.trim(c).isNotNull() & F.trim(c).try_cast("long").isNull()).cast("int")).alias(f"t{n}") for n, c in enumerate(texts.values())]
        found = df.agg(*odd).first()
        return {name: not found[n] for n, name in enumerate(texts)}

    def _aggregate(self, df: DataFrame) -> Table:
        s = self.stage
        self._base = df
        header = self._header()
        key_nodes = [ast.dump(parse(k)) for k in s.group or []]
        keys = [self._value(k) for k in s.group or []]
        df = df.withColumns({f"__g{n}": k.col for n, k in enumerate(keys)}) if keys else df.withColumn("__g0", F.lit(1))
        group = [f"__g{n}" for n in range(max(len(keys), 1))]
        aggs: list[Column] = []
        shown: list[tuple[Column, str]] = []
        keys_shown: list[Column] = []
        order = [c for c in (f"a{NR}", f"b{NR}") if c in df.columns]
        place = F.struct(*order) if order else F.lit(0)
        wanted: list[tuple[str, ast.Call | None, Value | None]] = []
        for item in s.items:
            if item.star:
                wanted += [("plain", None, v) for v in self._star(item.star)]
                continue
            node = parse(self._counted(item.text))
            call = self._aggregate_call(node)
            if call is None:
                if any(isinstance(x, ast.Call) and self._aggregate_call(x) for x in ast.walk(node)):
                    raise ParsingError(INSIDE)
                if ast.dump(node) in key_nodes:
                    wanted.append(("key", None, keys[key_nodes.index(ast.dump(node))]))
                    keys_shown.append(F.col(group[key_nodes.index(ast.dump(node))]))
                    continue
                wanted.append(("plain", None, self._value(item.text, node)))
            else:
                kind = AGGREGATE_OF[call.func.id]
                wanted.append((kind, call, None if kind == "count" else self._value("", call.args[0])))
        self.whole = self._whole_texts(df, [v for kind, _, v in wanted if kind in ("min", "max", "sum", "avg", "variance", "median")])
        medians: list[tuple[int, Value]] = []
        shown_keys = iter(keys_shown)
        for kind, call, value in wanted:
            if kind == "key":
                shown.append((next(shown_keys), value.type))
                continue
            name = f"__x{len(aggs)}"
            if kind == "count":
                aggs.append(F.count(F.lit(1)).alias(name))
                shown.append((F.col(name), "int"))
                continue
            if kind == "median":
                medians.append((len(shown), self._numbers(value)))
                shown.append((F.lit(None), "null"))  # joined below
                continue
            made, out, kind_out = self._one_aggregate(kind, call, value, df, place, name, len(shown) + 1)
            aggs.append(made.alias(name))
            shown.append((out, kind_out))
        grouped = df.groupBy(*group).agg(*aggs) if aggs else df.select(*group).distinct()
        for n, number in medians:
            found, kind = self._median(df, group, number)
            same = [grouped[g].eqNullSafe(found[f"__m{g}"]) for g in group]
            grouped = grouped.join(found, same[0] if len(same) == 1 else functools.reduce(lambda x, y: x & y, same), "left").drop(*(f"__m{g}" for g in group)).withColumnRenamed("__median", f"__q{n}")
            shown[n] = (F.col(f"__q{n}"), kind)
        if s.limit is not None or s.group:
            grouped = grouped.orderBy(*(F.col(g).asc_nulls_first() for g in group))
        if s.limit is not None:
            grouped = grouped.limit(s.limit)
        out = grouped.select(*(c.alias(f"c{n + 1}") for n, (c, _) in enumerate(shown)))
        return Table(out, header, warnings=self.warnings, checks=self.checks)

    def _median(self, df: DataFrame, group: list[str], number: Value) -> tuple[DataFrame, str]:
        """(the groups as __m*, __median): equal values are counted before the shuffle, and of the counted
        values, in order, the two middle ones are taken; no list of a group's values is ever held. Whole
        numbers stay whole unless some group's middles differ, which one look at the groups' middles tells."""
        col = number.col
        if self.options.strict_nulls:
            col = F.coalesce(col, F.raise_error(F.lit("MEDIAN of a null value")).cast("long"))
        named = df.select(*(F.col(g).alias(f"__m{g}") for g in group), col.alias("__v")).filter(F.col("__v").isNotNull())
        keys = [f"__m{g}" for g in group]
        counts = named.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v"))
        placed = counts.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
        high = F.min(F.when(F.col("__upto") * 2 > F.col("__all"), F.col("__v")))
        middles = placed.filter(F.col("__upto") * 2 >= F.col("__all")).groupBy(*keys).agg(F.min("__v").alias("__low"), high.alias("__high"))
        kind = number.type
        if kind == "int":
            middles = pin(middles)  # one row per group
            kind = "float" if middles.filter("__low <> __high").limit(1).count() else "int"
        low, high = (F.col(c).cast("double" if kind == "float" else "long") for c in ("__low", "__high"))
        return middles.select(*keys, (low if kind == "int" else F.when(low == high, low).otherwise((low + high) / 2)).alias("__median")), kind

    def _one_aggregate(self, kind: str, call: ast.Call | None, value: Value, df: DataFrame, place: Column, name: str, number: int) -> tuple[Column, Column, str]:
        """(aggregate, its result after grouping, its type)."""
        out = F.col(name)
        if kind == "plain":  # has to be the same in all rows of a group
            if value.type == "fields":
                raise ParsingError("* can't be used in aggregate queries over records of varying width")
            same = F.to_json(value.col) if value.type == "json" else value.col
            states = F.struct(F.min_by(value.col, place).alias("v"), F.min(same).alias("lo"), F.max(same).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(same).alias("set"))
            state = F.col(name)
            unlike = (state["lo"] != state["hi"]) | (state["set"] > 0) & (state["set"] < state["n"])
            wrong = F.raise_error(F.lit(f"Invalid aggregate expression: non-constant values in output column {number}"))
            guard = F.when(unlike, wrong).otherwise(F.lit(None))
            return states, F.coalesce(guard.cast("string").cast(self._cast_of(value, df)), state["v"]), value.type
        if kind == "any_value":
            return F.min_by(F.struct(value.col.alias("v")), place), F.col(f"{name}.v"), value.type
        if kind == "array_agg":
            item = F.struct(place.alias("p"), value.col.alias("v"))
            listed = F.transform(F.array_sort(out), lambda x: x["v"])
            made = Value(listed, "list", value.type)
            if len(call.args) > 1:
                made = self._post(made, call.args[1], df.groupBy(*(c for c in df.columns if re.fullmatch(r"__g\d+", c))).agg(F.collect_list(item).alias(name)))
            return F.collect_list(item), made.col, made.type
        if kind in ("min", "max") and value.type in ("time",):
            return (F.min if kind == "min" else F.max)(value.col), out, value.type
        number = self._numbers(value)
        col = number.col if value.raw is None or kind not in ("min", "max", "sum") else value.raw
        if self.options.strict_nulls:
            col = F.coalesce(col, F.raise_error(F.lit(f"{kind.upper()} of a null value")).cast("long"))
        if kind in ("min", "max"):
            return (F.min if kind == "min" else F.max)(col), out, number.type
        if kind == "sum":
            return F.coalesce(F.sum(col), F.lit(0)), out, number.type
        if kind == "avg":
            return F.avg(col.cast("double")), out, "float"
        if kind == "variance":
            return F.var_pop(col.cast("double")), out, "float"
        raise ParsingError(f"Unknown aggregate {kind}")

    @staticmethod
    def _cast_of(value: Value, df: DataFrame) -> T.DataType:
        return df.select(value.col.alias("v")).schema["v"].dataType

    def _post(self, listed: Value, node: ast.expr, grouped: DataFrame) -> Value:
        """ARRAY_AGG's callback: a lambda becomes a column where it can, else runs in Python, typed over all groups."""
        if isinstance(node, ast.Lambda) and len(node.args.args) == 1:
            compiler = Compiler(lambda n: None)
            compiler.local[node.args.args[0].arg] = listed
            try:
                return compiler.value(node.body)
            except Unsupported:
                pass
        if isinstance(node, ast.Name) and node.id == "len":
            return Value(F.size(listed.col).cast("long"), "int")
        if not self.options.allow_python:
            raise ParsingError("this ARRAY_AGG callback needs Python workers, which are switched off")
        source = f"({ast.unparse(node)})(__list)"
        self.options.python_expressions.append(source)
        call = fallback.Evaluator(source, ["__list"], {}, self.options.init_source, self.options.user)
        kind = self._kinds_over(call, grouped, [listed.col])
        return Value(F.udf(fallback.coerced(call, kind), kind, useArrow=True)(listed.col), *type_of(kind))

    # -- update ------------------------------------------------------------------------------------

    def _update(self, df: DataFrame) -> Table:
        s = self.stage
        self._base = df
        test = self._truth(s.where) if s.where else F.lit(True)
        if s.join and s.join.how == "inner":  # rows without a match stay as they are
            test = test & F.coalesce(F.col("__hit"), F.lit(False))
        new: dict[int, Value] = {}
        for name, text in s.assignments:
            n = self._field_number(name)
            if n is None:
                raise ParsingError(f'Unable to parse "UPDATE" expression: Unknown field name: "{name}"')
            if not self.a.ragged and n > self.a.width:
                raise RuntimeQueryError(f'No "a{n}" field at record 1')
            new[n] = self._value(text)
        # evaluated before they are put in place, as Python expressions can't be used there
        df = df.withColumns({f"__u{n}": v.col for n, v in new.items()})
        new = {n: Value(F.col(f"__u{n}"), v.type, v.item) for n, v in new.items()}
        if self.a.ragged:
            held = F.col(f"a{FIELDS}")
            for n, value in new.items():
                old = held
                short = F.size(F.col(f"a{FIELDS}")) < n
                record = F.col(f"a{NR}").cast("string") if self.a.numbered else F.lit("?")
                guard = F.when(short, F.raise_error(F.concat(F.lit(f'No "a{n}" field at record '), record))).otherwise(F.lit(None).cast("string"))
                put = F.coalesce(guard, rendered_or_null(value))
                held = F.transform(old, _put_at(n - 1, put))
                held = F.when(short, F.array(guard)).otherwise(held)
            df = df.orderBy(f"a{NR}") if self.sorted_out else df
            made = df.select(F.when(test, held).otherwise(F.col(f"a{FIELDS}")).alias(FIELDS), *([F.col(f"a{NR}").alias(NR)] if self.a.numbered else []))
            return Table(made, self.a.header, True, self.a.numbered, self.warnings, self.checks)
        cols = []
        for n in range(1, self.a.width + 1):
            old = F.col(f"a{n}")
            if n in new:
                value = new[n]
                old_type = self.scope.types[f"a{n}"][0]
                put = value.col
                if value.type != "null" and value.type != old_type and not (value.number and Value(old, old_type).number):
                    if old_type != "str":  # the column has to hold both
                        old = rendered(old, old_type)
                    put = rendered(put, value.type)
                old = F.when(test, put).otherwise(old)
            cols.append(old.alias(f"c{n}"))
        df = df.orderBy(f"a{NR}") if self.sorted_out else df
        made = df.select(*cols, *([F.col(f"a{NR}").alias(NR)] if self.a.numbered else []))
        return Table(made, self.a.header, False, self.a.numbered, self.warnings, self.checks)


def rendered(col: Column, kind: str, item: str = "str", separator: str = "|") -> Column:
    """A value as delimited text writes it; null stays null."""
    if kind in ("str", "fields"):
        return col
    if kind == "float":
        return float_text(col)
    if kind == "bool":
        return F.when(col, "True").when(~col, "False")
    if kind == "list":
        return F.array_join(F.transform(col, lambda x: F.coalesce(rendered(x, item), F.lit(""))), separator)
    if kind == "time":
        return F.regexp_replace(col.cast("string"), r"\.0+$", "")
    if kind == "json":
        return F.to_json(col)
    return col.cast("string")


def _renderer(kind: str) -> Callable[[Column], Column]:
    return lambda x: rendered(x, kind)


def _put_at(place: int, value: Column) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(i == place, value).otherwise(x)


def rendered_or_null(v: Value) -> Column:
    return F.lit(None).cast("string") if v.type == "null" else rendered(v.col, v.type, v.item)

