"""Every lowered form is evaluated as a column and in Python on the same values."""

import ast
import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamql.functions.compiler import Compiler, Unsupported, Value, float_text, like_regex, parse

ROWS = [
    ("", 0, 0.0, "1"), ("abc", 5, 2.5, "-12"), ("Ab c  d", -7, -0.5, " 42 "), ("é😀z", 3, 1e10, "7"), ("a.b|c", -1, 123456.789, "0"),
    (" pad\t", 12, 1e-5, "3"), ("aaa", 100, 1e16, "99"), ("x(y)z", 2, 0.00012, "5"), ("A,b;C", 9, -3.75, "08"), ("line\nbreak", 1, 7.0, "+4"),
]
EXPRESSIONS = """
a1 + 'x'; a1 * 2; len(a1); a1.upper(); a1.lower(); a1.strip(); a1.lstrip(); a1.rstrip(); a1.strip('a'); a1.split('.'); a1.split(); a1.split('|')[0]
a1.find('b'); a1.replace('a', 'zz'); a1.startswith('a'); a1.endswith('c'); a1.count('a'); a1[:2]; a1[1:]; a1[-2:]; a1[1:3]; a1[:-1]; a1[5:2]; 'b' in a1; 'b' not in a1
a2 + 1; a2 - 3; a2 * a2; a2 / 4; a2 // 3; a2 % 3; a2 // -3; a2 % -3; -a2; +a2; a2 ** 2; abs(a2); a2 + a3; a3 * 2; a3 // 2; a3 % 2; round(a3); round(a3, 1); int(a3); float(a2)
int(a4); float(a4); str(a2); str(a3); str(a2 > 1); a2 > 1; 1 < a2 <= 5; a2 == a3; a1 == 'abc'; a1 != 'abc'; a1 == a2; a2 in [1, 2, 3]; a1 in ['abc', '']; a1 in [5, 3]; a2 in [1.0, 2.5]
a2 > 1 and a3 < 3; a2 > 1 or a1 == ''; not a1; not a2; not a3; a1 and 'yes'; a1 or 'empty'; a2 or 7; a2 and 3; 'p' if a2 > 0 else 'n'; a2 if a1 else None; a1 is None; a1 is not None
max(a2, 4); min(a2, 4); max([a2, 3]); sum([a2, 1, 2]); sorted(a1.split('a')); len(a1.split('a')); '-'.join(a1.split('a')); [x.upper() for x in a1.split('a') if x]; [len(x) for x in a1.split('.')]
f'{a1}:{a2}'; f'{a3}'; bool(a1); bool(a2); [a1, 'k']; a1.split('a') + ['z']; re.match('a', a1) is not None; bool(re.search('[b-d]', a1)); re.sub('[ab]', '_', a1); re.findall('[a-c]', a1)
math.floor(a3); math.ceil(a3); math.sqrt(abs(a2)); math.pi; a1.isdigit(); a4.isdigit(); a1.isupper(); sorted([a2, 3, 1], reverse=True); a1.split('a')[-1]
""".strip().replace("\n", "; ").split("; ")


@pytest.fixture(scope="module")
def lowered(spark):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, a1 string, a2 bigint, a3 double, a4 string").coalesce(1)
    kinds = {"a1": "str", "a2": "int", "a3": "float", "a4": "str"}
    compiler = Compiler(lambda n: Value(F.col(n.id), kinds[n.id]) if isinstance(n, ast.Name) and n.id in kinds else None)
    cols = [compiler.value(parse(e)).col.alias(f"e{k}") for k, e in enumerate(EXPRESSIONS)]
    return [list(r) for r in df.select("n", *cols).orderBy("n").select(*(f"e{k}" for k in range(len(cols)))).collect()]


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)), ids=EXPRESSIONS)
def test_same_as_python(lowered, k):
    for row, got in zip(ROWS, lowered):
        want = eval(EXPRESSIONS[k], {"re": re, "math": math, "json": json}, dict(zip(("a1", "a2", "a3", "a4"), row)))  # noqa: S307
        if isinstance(want, float):
            assert got[k] == pytest.approx(want, rel=1e-12), row
        else:
            assert got[k] == want and isinstance(got[k], bool) == isinstance(want, bool), row


@pytest.mark.parametrize("text", ["a1.title()", "a1.zfill(4)", "eval('1')", "{1: 2}", "a1 + a2", "a1 % a2", "lambda x: x", "re.sub('(?<=a)b', '', a1)", "open('x')"])
def test_refused(text):
    kinds = {"a1": "str", "a2": "int"}
    compiler = Compiler(lambda n: Value(F.col(n.id), kinds[n.id]) if isinstance(n, ast.Name) and n.id in kinds else None)
    with pytest.raises(Unsupported):
        compiler.value(parse(text))


def test_float_text(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-4, 0.00012345, 1e-5, 1.25e-7, 123456789012345.6, float("nan"), float("inf"), -2.5e-10]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double")
    got = [r[0] for r in df.orderBy("n").select(float_text(F.col("v"))).collect()]
    assert got == [str(v) for v in values]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab%_.\\\n*", max_size=6), st.text("ab%_.\\*", max_size=4)), min_size=1, max_size=8))
def test_like(spark, pairs):
    for text, pattern in pairs:
        want = re.match("^" + "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in pattern) + r"\Z", text) is not None
        got = spark.range(1).select(F.lit(text).rlike(like_regex(pattern))).first()[0]
        assert got == want, (text, pattern)
