"""Python expressions as Spark columns.

An expression's syntax tree is lowered to a column with a static type where the meaning is the same;
where it isn't, ``Unsupported`` says why and the caller evaluates the expression in Python workers.
Types: str, int, float, bool, null, list, json (a VARIANT), time, match (of a regular expression: only
whether there is one), other.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamql.plans.lexer import ParsingError

Resolve = Callable[[ast.expr], "Value | None"]


class Unsupported(Exception):
    """The expression has no column with the same meaning."""


@dataclass
class Value:
    col: Column
    type: str
    item: str = "other"  # type of a list's items
    const: object = None  # the value of a literal
    raw: Column | None = None  # a decimal as it is stored, where ``col`` is it as a double

    @property
    def number(self) -> bool:
        return self.type in ("int", "float", "bool")


def type_of(kind: T.DataType) -> tuple[str, str]:
    """(type, type of items) of a Spark type."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "str", "other"
    if isinstance(kind, T.BooleanType):
        return "bool", "other"
    if isinstance(kind, T.IntegralType):
        return "int", "other"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float", "other"
    if isinstance(kind, T.ArrayType):
        return "list", type_of(kind.elementType)[0]
    if isinstance(kind, T.VariantType):
        return "json", "other"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time", "other"
    if isinstance(kind, T.NullType):
        return "null", "other"
    return "other", "other"


def like_regex(pattern: str) -> str:
    """_ is one character, % any run, nothing else is special; neither matches a line break."""
    return "(?d)^" + "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in pattern) + r"\z"


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ParsingError(f"Invalid expression: {text}: {e.msg}") from e


def _literal(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), "null")
    if isinstance(value, bool):
        return Value(F.lit(value), "bool", const=value)
    if isinstance(value, int) and abs(value) < 1 << 63:
        return Value(F.lit(value).cast("long"), "int", const=value)
    if isinstance(value, float):
        return Value(F.lit(value), "float", const=value)
    if isinstance(value, str):
        return Value(F.lit(value), "str", const=value)
    raise Unsupported(f"literal {value!r}")


class Compiler:
    """Lowers expressions whose variables ``resolve`` knows."""

    def __init__(self, resolve: Resolve) -> None:
        self.resolve = resolve
        self.local: dict[str, Value] = {}

    # -- entry points ----------------------------------------------------------------------------

    def value(self, node: ast.expr) -> Value:
        found = self.resolve(node)
        if found is not None:
            return found
        method = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None:
            raise Unsupported(type(node).__name__)
        return method(node)

    def truth(self, node: ast.expr) -> Column:
        """Whether the value is true in Python's sense; never null."""
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        return self.is_true(self.value(node))

    def condition(self, node: ast.expr) -> Column:
        """``truth`` where null may stand for false, so that plain comparisons reach the scan."""
        if isinstance(node, ast.BoolOp):
            parts = [self.condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        v = self.value(node)
        return v.col if v.type == "bool" else self.is_true(v)

    @staticmethod
    def is_true(v: Value) -> Column:
        if v.type == "null":
            return F.lit(False)
        if v.type in ("bool", "match"):
            return F.coalesce(v.col, F.lit(False))
        if v.type in ("int", "float"):
            return F.coalesce(v.col != 0, F.lit(False))
        if v.type == "str":
            return F.coalesce(v.col != "", F.lit(False))
        if v.type == "list":
            return F.coalesce(F.size(v.col) > 0, F.lit(False))
        if v.type == "time":
            return v.col.isNotNull()
        raise Unsupported(f"truth of {v.type}")

    # -- leaves ----------------------------------------------------------------------------------

    def _constant(self, node: ast.Constant) -> Value:
        return _literal(node.value)

    def _name(self, node: ast.Name) -> Value:
        if node.id in self.local:
            return self.local[node.id]
        raise Unsupported(f"name {node.id}")

    def _joinedstr(self, node: ast.JoinedStr) -> Value:
        parts = []
        for piece in node.values:
            if isinstance(piece, ast.Constant):
                parts.append(F.lit(piece.value))
            elif isinstance(piece, ast.FormattedValue) and piece.format_spec is None and piece.conversion == -1:
                parts.append(self.text(self.value(piece.value)))
            else:
                raise Unsupported("format of an f-string")
        return Value(F.concat(*parts) if parts else F.lit(""), "str")

    def _list(self, node: ast.List) -> Value:
        items = [self.value(e) for e in node.elts]
        kinds = {i.type for i in items}
        if not items or len(kinds) > 1 or kinds & {"list", "json", "other"}:
            raise Unsupported("list of unlike items")
        return Value(F.array(*(i.col for i in items)), "list", items[0].type)

    _tuple = _list

    # -- operators -------------------------------------------------------------------------------

    def _unaryop(self, node: ast.UnaryOp) -> Value:
        if isinstance(node.op, ast.Not):
            return Value(~self.truth(node.operand), "bool")
        v = self.value(node.operand)
        if not v.number:
            raise Unsupported(f"sign of {v.type}")
        if isinstance(node.op, ast.USub):
            if v.const is not None:
                return _literal(-v.const)
            return Value(-self.numeric(v), "int" if v.type == "bool" else v.type)
        if isinstance(node.op, ast.UAdd):
            return v
        raise Unsupported("~")

    def _boolop(self, node: ast.BoolOp) -> Value:
        parts = [self.value(v) for v in node.values]
        kinds = {p.type for p in parts}
        if kinds == {"bool"}:
            return Value(self.truth(node), "bool")
        if len(kinds) > 1:
            raise Unsupported("and/or of unlike values")
        out = parts[-1].col
        for p in reversed(parts[:-1]):
            yes = self.is_true(p)
            out = F.when(yes, out).otherwise(p.col) if isinstance(node.op, ast.And) else F.when(yes, p.col).otherwise(out)
        return Value(out, parts[0].type, parts[0].item)

    @staticmethod
    def numeric(v: Value) -> Column:
        return v.col.cast("long") if v.type in ("bool", "int") else v.col.cast("double")

    def _binop(self, node: ast.BinOp) -> Value:
        left, right = self.value(node.left), self.value(node.right)
        op = type(node.op).__name__
        if op == "Add" and left.type == right.type == "str":
            return Value(F.concat(left.col, right.col), "str")
        if op == "Add" and left.type == right.type == "list" and left.item == right.item:
            return Value(F.concat(left.col, right.col), "list", left.item)
        if op == "Mult" and {left.type, right.type} == {"str", "int"}:
            text, n = (left, right) if left.type == "str" else (right, left)
            return Value(F.call_function("repeat", text.col, n.col.cast("int")), "str")
        if op == "Mod" and left.type == "str":
            raise Unsupported("% formatting")
        if not (left.number and right.number):
            raise Unsupported(f"{op} of {left.type} and {right.type}")
        a, b = self.numeric(left), self.numeric(right)
        whole = left.type != "float" and right.type != "float"
        kind = "int" if whole else "float"
        if op in ("Add", "Sub", "Mult"):
            return Value({"Add": a + b, "Sub": a - b, "Mult": a * b}[op], kind)
        if op == "Div":
            return Value(a.cast("double") / b.cast("double"), "float")
        if op in ("FloorDiv", "Mod"):
            if whole:
                rest = F.pmod(a, F.abs(b))  # from 0 up to |b|
                rest = F.when((b < 0) & (rest != 0), rest + b).otherwise(rest)
                return Value(F.call_function("div", a - rest, b), kind) if op == "FloorDiv" else Value(rest, kind)
            quotient = F.floor(a.cast("double") / b.cast("double")).cast("double")
            return Value(quotient, kind) if op == "FloorDiv" else Value(a - b * quotient, kind)
        if op == "Pow":
            if whole and right.const is not None and right.const >= 0:
                return Value(F.pow(a, b).cast("long"), "int")
            if not whole:
                return Value(F.pow(a, b), "float")
        raise Unsupported(op)

    def _compare(self, node: ast.Compare) -> Value:
        out = None
        left_node = node.left
        for op, right_node in zip(node.ops, node.comparators):
            one = self._one_comparison(left_node, op, right_node)
            out = one if out is None else out & one
            left_node = right_node
        return Value(out, "bool")

    @staticmethod
    def _is_list_literal(node: ast.expr) -> bool:
        return isinstance(node, (ast.List, ast.Tuple, ast.Set))

    def _one_comparison(self, left_node: ast.expr, op: ast.cmpop, right_node: ast.expr) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            found = self._contains(self.value(left_node), right_node)
            return found if isinstance(op, ast.In) else ~found
        left, right = self.value(left_node), self.value(right_node)
        if isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):
            positive = isinstance(op, (ast.Is, ast.Eq))
            if "null" in (left.type, right.type):
                other = right if left.type == "null" else left
                same = ~other.col if other.type == "match" else F.lit(True) if other.type == "null" else other.col.isNull()
            elif isinstance(op, (ast.Is, ast.IsNot)) and "bool" not in (left.type, right.type):
                raise Unsupported("identity")
            elif left.number and right.number:
                same = self._same_number(left, right)
            elif left.type == right.type and left.type != "other":
                same = left.col.eqNullSafe(right.col)
            elif "json" in (left.type, right.type):
                same = self._json_equals(left, right)
            elif "other" in (left.type, right.type):
                raise Unsupported("comparison")
            else:  # values of different kinds are never equal, None aside
                same = left.col.isNull() & right.col.isNull()
            return same if positive else ~same
        if left.type == "json" and right.type in ("int", "float", "str"):
            left = Value(F.variant_get(left.col, "$", {"int": "double", "float": "double", "str": "string"}[right.type]), "float" if right.type != "str" else "str")
        if not (left.number and right.number or left.type == right.type and left.type in ("str", "time")):
            raise Unsupported(f"order of {left.type} and {right.type}")
        a, b = (self.numeric(left), self.numeric(right)) if left.number else (left.col, right.col)
        return {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]

    def _same_number(self, left: Value, right: Value) -> Column:
        a, b = self.numeric(left), self.numeric(right)
        same = a.eqNullSafe(b)
        if "float" in (left.type, right.type):
            return same & F.coalesce(~F.isnan(a.cast("double")), F.lit(True))
        return same

    @staticmethod
    def _json_equals(left: Value, right: Value) -> Column:
        if left.type != "json":
            left, right = right, left
        kind = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}.get(right.type)
        if kind is None:
            raise Unsupported("comparison of JSON values")
        return F.coalesce(F.try_variant_get(left.col, "$", kind) == right.col, F.lit(False))

    def _contains(self, item: Value, container: ast.expr) -> Column:
        if self._is_list_literal(container):
            out = F.lit(False)
            for element in container.elts:
                other = self.value(element)
                if item.number and other.number:
                    one = self._same_number(item, other)
                elif item.type == other.type and item.type in ("str", "time"):
                    one = item.col.eqNullSafe(other.col)
                elif "null" in (item.type, other.type):
                    one = item.col.isNull() & other.col.isNull()
                else:
                    one = F.lit(False)
                out = out | one
            return out
        held = self.value(container)
        if held.type == "str" and item.type == "str":
            return F.contains(held.col, item.col)
        if held.type == "list":
            if held.item != item.type:
                if held.item in ("other", "json"):
                    raise Unsupported("in")
                return F.lit(False)
            return F.coalesce(F.array_contains(held.col, item.col), F.lit(False))
        raise Unsupported(f"in {held.type}")

    def _ifexp(self, node: ast.IfExp) -> Value:
        yes, no = self.value(node.body), self.value(node.orelse)
        test = self.truth(node.test)
        if yes.type == "null" or no.type == "null":
            kind = no if yes.type == "null" else yes
            return Value(F.when(test, yes.col).otherwise(no.col), kind.type, kind.item)
        if yes.type == no.type:
            return Value(F.when(test, yes.col).otherwise(no.col), yes.type, yes.item)
        raise Unsupported("if/else of unlike values")

    # -- subscripts ------------------------------------------------------------------------------

    def _subscript(self, node: ast.Subscript) -> Value:
        held = self.value(node.value)
        if isinstance(node.slice, ast.Slice):
            return self._slice(held, node.slice)
        key = self.value(node.slice)
        if held.type == "json":
            if isinstance(key.const, str) and not set(key.const) & set("'\\"):
                return Value(F.variant_get(held.col, f"$['{key.const}']", "variant"), "json")
            if isinstance(key.const, int) and not isinstance(key.const, bool) and key.const >= 0:
                return Value(F.variant_get(held.col, f"$[{key.const}]", "variant"), "json")
            raise Unsupported("key of a JSON value")
        if key.type != "int":
            raise Unsupported("subscript")
        if held.type == "list":
            at = F.when(key.col >= 0, key.col + 1).otherwise(key.col).cast("int")
            return Value(F.element_at(held.col, at), held.item)
        if held.type == "str":
            n = F.length(held.col)
            at = F.when(key.col >= 0, key.col).otherwise(key.col + n).cast("int")
            inside = (at >= 0) & (at < n)
            return Value(F.when(held.col.isNotNull() & ~inside, F.raise_error(F.lit("string index out of range"))).otherwise(F.substring(held.col, at + 1, F.lit(1))), "str")
        raise Unsupported(f"subscript of {held.type}")

    def _slice(self, held: Value, cut: ast.Slice) -> Value:
        if cut.step is not None or held.type not in ("str", "list"):
            raise Unsupported("slice")
        n = F.length(held.col) if held.type == "str" else F.size(held.col)

        def place(node: ast.expr | None, default: Column) -> Column:
            if node is None:
                return default
            v = self.value(node)
            if v.type != "int":
                raise Unsupported("slice")
            at = v.col.cast("int")
            return F.least(F.greatest(F.when(at < 0, at + n).otherwise(at), F.lit(0)), n)

        begin, end = place(cut.lower, F.lit(0)), place(cut.upper, n)
        size = F.greatest(end - begin, F.lit(0))
        if held.type == "str":
            return Value(F.substring(held.col, begin + 1, size), "str")
        return Value(F.slice(held.col, begin + 1, size), "list", held.item)

    # -- comprehensions --------------------------------------------------------------------------

    def _listcomp(self, node: ast.ListComp) -> Value:
        if len(node.generators) != 1 or node.generators[0].is_async or not isinstance(node.generators[0].target, ast.Name):
            raise Unsupported("comprehension")
        step = node.generators[0]
        source = self.value(step.iter)
        if source.type != "list":
            raise Unsupported(f"iteration over {source.type}")
        name, col = step.target.id, source.col

        def with_item(make: Callable[[], object]) -> Callable[[Column], Column]:
            def inner(x: Column) -> Column:
                before = self.local.get(name)
                self.local[name] = Value(x, source.item)
                try:
                    return make()
                finally:
                    self.local.pop(name)
                    if before is not None:
                        self.local[name] = before

            return inner

        for test in step.ifs:
            col = F.filter(col, with_item(lambda test=test: self.truth(test)))
        kinds: list[Value] = []

        def element() -> Column:
            kinds.append(self.value(node.elt))
            return kinds[-1].col

        return Value(F.transform(col, with_item(element)), "list", kinds[-1].type)

    _generatorexp = _listcomp

    # -- calls -----------------------------------------------------------------------------------

    def text(self, v: Value) -> Column:
        """str(v)"""
        if v.type == "str":
            return F.coalesce(v.col, F.lit("None"))
        if v.type == "int":
            return F.coalesce(v.col.cast("string"), F.lit("None"))
        if v.type == "bool":
            return F.coalesce(F.when(v.col, "True").otherwise("False"), F.lit("None")) if v.const is not None else F.when(v.col.isNull(), "None").when(v.col, "True").otherwise("False")
        if v.type == "float":
            return F.coalesce(float_text(v.col), F.lit("None"))
        if v.type == "null":
            return F.lit("None")
        if v.type == "json":
            raise Unsupported("text of a JSON value")
        raise Unsupported(f"str of {v.type}")

    def _call(self, node: ast.Call) -> Value:
        if any(isinstance(a, ast.Starred) for a in node.args):
            raise Unsupported("spread arguments")
        words = {k.arg: k.value for k in node.keywords}
        if isinstance(node.func, ast.Name):
            return self._function(node.func.id, node.args, words)
        if isinstance(node.func, ast.Attribute):
            path = ast.unparse(node.func)
            if path in MODULE_CALLS and not words:
                args = [self.value(a) for a in node.args]
                return MODULE_CALLS[path](self, args)
            root = node.func.value
            if isinstance(root, ast.Name) and root.id in ("re", "math", "json", "random", "datetime", "os", "sys", "time", "udf"):
                raise Unsupported(path)
            if words:
                raise Unsupported("keyword arguments of a method")
            return self._method(self.value(root), node.func.attr, node.args)
        raise Unsupported("call")

    def _function(self, name: str, args: list[ast.expr], words: dict[str, ast.expr]) -> Value:
        if name in ("LIKE", "like", "Like") and len(args) == 2 and not words:
            text, pattern = self.value(args[0]), self.value(args[1])
            if text.type != "str" or not isinstance(pattern.const, str):
                raise Unsupported("LIKE")
            return Value(F.coalesce(text.col.rlike(like_regex(pattern.const)), F.lit(False)), "bool")
        if name == "sorted" and len(args) == 1 and set(words) <= {"reverse"}:
            v = self.value(args[0])
            if v.type != "list" or v.item not in ("str", "int", "float"):
                raise Unsupported("sorted")
            down = "reverse" in words and getattr(words["reverse"], "value", None)
            return Value(F.sort_array(v.col, asc=not down), "list", v.item)
        if words:
            raise Unsupported("keyword arguments")
        if name not in BUILTINS:
            raise Unsupported(f"function {name}")
        return BUILTINS[name](self, [self.value(a) for a in args])

    def _method(self, on: Value, name: str, arg_nodes: list[ast.expr]) -> Value:
        args = [self.value(a) for a in arg_nodes]
        if on.type == "str" and (name, len(args)) in STR_METHODS and all(a.type == "str" for a in args):
            return STR_METHODS[name, len(args)](on, *args)
        if on.type == "str" and name == "join" and len(args) == 1 and args[0].type == "list" and args[0].item == "str":
            return Value(F.array_join(args[0].col, on.const) if isinstance(on.const, str) else F.call_function("array_join", args[0].col, on.col), "str")
        if on.type == "str" and name == "get":
            raise Unsupported("get")
        if on.type == "json" and name == "get" and args and isinstance(args[0].const, str) and len(args) == 1:
            return Value(F.try_variant_get(on.col, f"$['{args[0].const}']", "variant"), "json")
        if on.type == "list" and name == "count" and len(args) == 1 and args[0].type == on.item:
            return Value(F.size(F.filter(on.col, lambda x: x.eqNullSafe(args[0].col))).cast("long"), "int")
        if on.type == "time" and name in TIME_PARTS and not args:
            return TIME_PARTS[name](on)
        raise Unsupported(f"{on.type}.{name}")

    def _attribute(self, node: ast.Attribute) -> Value:
        path = ast.unparse(node)
        if path in ("math.pi", "math.e", "math.inf", "math.nan"):
            return _literal(getattr(math, node.attr))
        on = self.value(node.value)
        if on.type == "time" and node.attr in ("year", "month", "day", "hour", "minute", "second"):
            return Value(getattr(F, {"day": "dayofmonth"}.get(node.attr, node.attr))(on.col).cast("long"), "int")
        raise Unsupported(path)


def float_text(col: Column) -> Column:
    """A double the way Python's str writes it."""
    java = col.cast("double").cast("string")
    size = F.abs(col.cast("double"))
    digits = F.regexp_extract(java, r"^(-?[0-9.]+)E(-?[0-9]+)$", 1)
    power = F.regexp_extract(java, r"^(-?[0-9.]+)E(-?[0-9]+)$", 2)
    trimmed = lambda c: F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1")
    plain = trimmed(java.try_cast("decimal(38,18)").cast("string"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    small = trimmed(java.try_cast("decimal(38,26)").cast("string"))
    exponent = F.concat(
        F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), F.when(power.startswith("-"), "-").otherwise("+"),
        F.lpad(F.regexp_replace(power, "^-", ""), 2, "0"),
    )
    long_exponent = F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), F.when(power.startswith("-"), "-").otherwise("+"), F.regexp_replace(power, "^-", ""))
    exponent = F.when(F.length(F.regexp_replace(power, "^-", "")) > 2, long_exponent).otherwise(exponent)
    return (
        F.when(F.isnan(col.cast("double")), "nan")
        .when(size == F.lit(math.inf), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16), plain)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(exponent)
    )


def rendered_text(value: object, separator: str = "|") -> str | None:
    """A Python value as delimited text writes it; None stays None."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return separator.join(rendered_text(v, separator) or "" for v in value)
    return str(value)


# -- builtins ------------------------------------------------------------------------------------


def _len(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].type == "str":
        return Value(F.length(args[0].col).cast("long"), "int")
    if len(args) == 1 and args[0].type == "list":
        return Value(F.size(args[0].col).cast("long"), "int")
    raise Unsupported("len")


def _int(c: Compiler, args: list[Value]) -> Value:
    if len(args) != 1:
        raise Unsupported("int")
    v = args[0]
    if v.type in ("int", "bool"):
        return Value(v.col.cast("long"), "int")
    if v.type == "float":
        return Value(v.col.cast("long"), "int")  # towards 0
    if v.type == "str":
        text = F.regexp_replace(F.regexp_replace(v.col, r"^\s+|\s+$", ""), r"(?<=[0-9])_(?=[0-9])", "")
        good = text.rlike(r"^[+-]?[0-9]+$")
        return Value(F.when(good, text.cast("long")).when(v.col.isNotNull(), F.raise_error(F.concat(F.lit("invalid literal for int() with base 10: '"), v.col, F.lit("'"))).cast("long")), "int")
    if v.type == "json":
        return Value(F.variant_get(v.col, "$", "bigint"), "int")
    raise Unsupported(f"int of {v.type}")


def _float(c: Compiler, args: list[Value]) -> Value:
    if len(args) != 1:
        raise Unsupported("float")
    v = args[0]
    if v.number:
        return Value(v.col.cast("double"), "float")
    if v.type == "str":
        text = F.regexp_replace(v.col, r"^\s+|\s+$", "")
        good = text.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$")
        return Value(F.when(good, text.cast("double")).when(v.col.isNotNull(), F.raise_error(F.concat(F.lit("could not convert string to float: '"), v.col, F.lit("'"))).cast("double")), "float")
    if v.type == "json":
        return Value(F.variant_get(v.col, "$", "double"), "float")
    raise Unsupported(f"float of {v.type}")


def _str(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].type == "json":
        return Value(F.variant_get(args[0].col, "$", "string"), "str")
    if len(args) != 1:
        raise Unsupported("str")
    return Value(c.text(args[0]), "str")


def _abs(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].number:
        return Value(F.abs(c.numeric(args[0])), "float" if args[0].type == "float" else "int")
    raise Unsupported("abs")


def _round(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].number:
        return Value(F.bround(c.numeric(args[0]).cast("double"), 0).cast("long"), "int")
    if len(args) == 2 and args[0].type == "float" and isinstance(args[1].const, int):
        return Value(F.bround(args[0].col.cast("double"), args[1].const), "float")
    if len(args) == 2 and args[0].type == "int" and isinstance(args[1].const, int) and args[1].const >= 0:
        return args[0]
    raise Unsupported("round")


def _bool(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1:
        return Value(c.is_true(args[0]), "bool")
    raise Unsupported("bool")


def _extreme(name: str) -> Callable[[Compiler, list[Value]], Value]:
    def call(c: Compiler, args: list[Value]) -> Value:
        if len(args) == 1 and args[0].type == "list" and args[0].item in ("int", "float", "str"):
            return Value(F.array_max(args[0].col) if name == "max" else F.array_min(args[0].col), args[0].item)
        kinds = {a.type for a in args}
        if len(args) > 1 and len(kinds) == 1 and kinds <= {"int", "float", "str"}:
            return Value((F.greatest if name == "max" else F.least)(*(a.col for a in args)), args[0].type)
        raise Unsupported(name)

    return call


def _sum(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].type == "list" and args[0].item in ("int", "float"):
        kind = "long" if args[0].item == "int" else "double"
        return Value(F.aggregate(args[0].col.cast(f"array<{kind}>"), F.lit(0).cast(kind), lambda s, x: s + x), args[0].item)
    raise Unsupported("sum")


def _list(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].type == "list":
        return args[0]
    raise Unsupported("list")


def _reversed(c: Compiler, args: list[Value]) -> Value:
    if len(args) == 1 and args[0].type == "list":
        return Value(F.reverse(args[0].col), "list", args[0].item)
    raise Unsupported("reversed")


BUILTINS: dict[str, Callable[[Compiler, list[Value]], Value]] = {
    "len": _len, "int": _int, "float": _float, "str": _str, "abs": _abs, "round": _round, "bool": _bool, "list": _list, "reversed": _reversed,
    "min": _extreme("min"), "Min": _extreme("min"), "MIN": _extreme("min"), "max": _extreme("max"), "Max": _extreme("max"), "MAX": _extreme("max"),
    "sum": _sum, "Sum": _sum, "SUM": _sum,
}


def _quoted(v: Value) -> Column | str:
    """A regular expression that matches the text itself."""
    if isinstance(v.const, str):
        return F.lit("".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in v.const))
    return F.concat(F.lit("\\Q"), v.col, F.lit("\\E"))


def _split(on: Value, by: Value) -> Value:
    if by.const == "":
        raise Unsupported("empty separator")
    return Value(F.call_function("split", on.col, _quoted(by), F.lit(-1)), "list", "str")


SPACE = r"[\s\x1c-\x1f\x85 ]"
STR_METHODS: dict[tuple[str, int], Callable[..., Value]] = {
    ("upper", 0): lambda s: Value(F.upper(s.col), "str"),
    ("lower", 0): lambda s: Value(F.lower(s.col), "str"),
    ("strip", 0): lambda s: Value(F.regexp_replace(s.col, f"^{SPACE}+|{SPACE}+$", ""), "str"),
    ("lstrip", 0): lambda s: Value(F.regexp_replace(s.col, f"^{SPACE}+", ""), "str"),
    ("rstrip", 0): lambda s: Value(F.regexp_replace(s.col, f"{SPACE}+$", ""), "str"),
    ("strip", 1): lambda s, x: Value(F.btrim(s.col, x.col), "str"),
    ("lstrip", 1): lambda s, x: Value(F.ltrim(s.col, x.col), "str"),
    ("rstrip", 1): lambda s, x: Value(F.rtrim(s.col, x.col), "str"),
    ("split", 1): _split,
    ("split", 0): lambda s: Value(F.filter(F.split(s.col, f"{SPACE}+", -1), lambda x: x != ""), "list", "str"),
    ("replace", 2): lambda s, a, b: Value(F.replace(s.col, a.col, b.col), "str") if a.const != "" else _refuse("empty text"),
    ("startswith", 1): lambda s, x: Value(F.startswith(s.col, x.col), "bool"),
    ("endswith", 1): lambda s, x: Value(F.endswith(s.col, x.col), "bool"),
    ("find", 1): lambda s, x: Value((F.call_function("locate", x.col, s.col) - 1).cast("long"), "int"),
    ("count", 1): lambda s, x: Value((F.size(_split(s, x).col) - 1).cast("long"), "int"),
    ("isdigit", 0): lambda s: Value(s.col.rlike(r"^\p{Nd}+$"), "bool"),
    ("isupper", 0): lambda s: Value((F.upper(s.col) == s.col) & (F.lower(s.col) != s.col), "bool"),
    ("islower", 0): lambda s: Value((F.lower(s.col) == s.col) & (F.upper(s.col) != s.col), "bool"),
}


def _refuse(why: str) -> Value:
    raise Unsupported(why)


TIME_PARTS = {
    "date": lambda v: Value(F.to_date(v.col), "time"),
    "weekday": lambda v: Value(F.weekday(v.col).cast("long"), "int"),
    "isoweekday": lambda v: Value((F.weekday(v.col) + 1).cast("long"), "int"),
}

# Python and Java agree on patterns made of these parts only
SHARED_REGEX = re.compile(r"""(?x)^(?: [^\\(){}\[\]^$|?*+.] | \\[dws.\\()\[\]{}|?*+^$/-] | \[\^?(?:[^\\\[\]&^]|\\[dws.\\\[\]^-])+\] | [.^|*+?] | \((?!\?) | \(\?: | \) | \{\d+(?:,\d*)?\} | \$(?=$) )*$""")


def _pattern(v: Value) -> str:
    if not isinstance(v.const, str) or not SHARED_REGEX.match(v.const):
        raise Unsupported("regular expression")
    return f"(?U){v.const}" if re.search(r"\\[dws]", v.const) else v.const


def _regex(kind: str) -> Callable[[Compiler, list[Value]], Value]:
    def call(c: Compiler, args: list[Value]) -> Value:
        if kind == "sub":
            if len(args) != 3 or any(a.type != "str" for a in args) or not isinstance(args[1].const, str) or set(args[1].const) & set("\\$"):
                raise Unsupported("re.sub")
            return Value(F.regexp_replace(args[2].col, _pattern(args[0]), args[1].const), "str")
        if len(args) != 2 or args[1].type != "str":
            raise Unsupported(f"re.{kind}")
        pattern = _pattern(args[0])
        if kind == "findall":
            if "(" in pattern.replace("\\(", ""):
                raise Unsupported("groups in re.findall")
            return Value(F.regexp_extract_all(args[1].col, F.lit(pattern), F.lit(0)), "list", "str")
        pattern = {"match": f"^(?:{pattern})", "search": pattern, "fullmatch": f"^(?:{pattern})\\z"}[kind]
        return Value(F.coalesce(args[1].col.rlike(pattern), F.lit(False)), "match")

    return call


def _math(name: str, result: str = "float") -> Callable[[Compiler, list[Value]], Value]:
    def call(c: Compiler, args: list[Value]) -> Value:
        if not args or not all(a.number for a in args):
            raise Unsupported(f"math.{name}")
        cols = [a.col.cast("double") for a in args]
        if name == "log":
            out = F.ln(cols[0]) if len(cols) == 1 else F.ln(cols[0]) / F.ln(cols[1])
        else:
            out = getattr(F, {"fabs": "abs"}.get(name, name))(*cols)
        return Value(out.cast("long") if result == "int" else out, result)

    return call


def _loads(c: Compiler, args: list[Value]) -> Value:
    if len(args) != 1 or args[0].type != "str":
        raise Unsupported("json.loads")
    return Value(F.parse_json(args[0].col), "json")


def _random(c: Compiler, args: list[Value]) -> Value:
    return Value(F.rand(), "float")


MODULE_CALLS: dict[str, Callable[[Compiler, list[Value]], Value]] = {
    "re.match": _regex("match"), "re.search": _regex("search"), "re.fullmatch": _regex("fullmatch"), "re.sub": _regex("sub"), "re.findall": _regex("findall"),
    "math.sqrt": _math("sqrt"), "math.exp": _math("exp"), "math.log": _math("log"), "math.log10": _math("log10"), "math.log2": _math("log2"), "math.fabs": _math("fabs"),
    "math.floor": _math("floor", "int"), "math.ceil": _math("ceil", "int"), "math.sin": _math("sin"), "math.cos": _math("cos"), "math.tan": _math("tan"), "math.atan": _math("atan"),
    "math.pow": _math("pow"), "json.loads": _loads, "random.random": _random,
}
