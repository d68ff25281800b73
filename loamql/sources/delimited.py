"""Delimited text as tables: five policies, comments, byte order marks, headers and warnings.

All splitting is done by column expressions. Records of ``quoted_rfc`` may span lines: whether a line
begins inside a quoted field is a prefix sum over the quotes before it, taken per block of lines and
then over the blocks, so no file has to be read by one task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamql.plans.lexer import IOHandlingError
from loamql.sources.tables import FIELDS, NR, Table, file_places, number

POLICIES = ("simple", "quoted", "quoted_rfc", "whitespace", "monocolumn")
NAMED_FORMATS = {"csv": (",", "quoted"), "tsv": ("\t", "simple"), "monocolumn": ("", "monocolumn")}
ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "latin-1": "latin-1", "latin1": "latin-1", "iso-8859-1": "latin-1"}
BLOCK_LINES_BITS = 16
BOM = b"\xef\xbb\xbf"  # the reader drops it, under any encoding


def default_policy(delim: str) -> str:
    """The policy that goes with a delimiter where none is named."""
    return "quoted" if delim in (",", ";") else "whitespace" if delim == " " else "simple"


def named_format(name: str) -> tuple[str, str]:
    if name not in NAMED_FORMATS:
        raise IOHandlingError(f"Unknown format: {name}")
    return NAMED_FORMATS[name]


def check_dialect(delim: str, policy: str, encoding: str | None, query: str = "") -> None:
    """Guards against dialects that can't work."""
    if policy not in POLICIES:
        raise IOHandlingError(f"Unknown policy: {policy}")
    if encoding is not None and encoding.lower() not in ENCODINGS:
        raise IOHandlingError(f"Unknown encoding: {encoding}")
    if delim == '"' and policy in ("quoted", "quoted_rfc"):
        raise IOHandlingError('Double quote delimiter is incompatible with "quoted" policy')
    if delim != " " and policy == "whitespace":
        raise IOHandlingError('Only whitespace " " delim is supported with "whitespace" policy')
    if encoding and ENCODINGS[encoding.lower()] == "latin-1" and not (query.isascii() and delim.isascii()):
        raise IOHandlingError("To use non-ascii characters in query or delimiter choose utf-8 encoding instead of latin-1")


def _regex(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def split_fields(line: Column, delim: str, policy: str) -> tuple[Column, Column]:
    """(fields, whether a quote is misplaced) of a line. A badly quoted field is kept as it stands."""
    none = F.lit(False)
    if policy == "monocolumn" or not delim:
        return F.array(line), none
    if policy == "whitespace":
        return F.filter(F.split(line, " +", -1), lambda x: x != ""), none
    plain = F.split(line, _regex(delim), -1)
    if policy == "simple":
        return plain, none
    pad = "" if delim == " " else " *"
    d = _regex(delim)
    piece = f"(?s){d}(?:{pad}\"[^\"]*+(?:\"\"[^\"]*+)*+\"{pad}(?={d}|\\z)|(?:(?!{d}).)*+)"
    whole = f"(?s)^{pad}\"([^\"]*+(?:\"\"[^\"]*+)*+)\"{pad}\\z"
    raw = F.transform(F.regexp_extract_all(F.concat(F.lit(delim), line), F.lit(piece), F.lit(0)), lambda x: F.substring(x, F.lit(len(delim) + 1), F.length(x)))
    unquoted = F.transform(raw, lambda x: F.when(~x.contains('"'), x).when(x.rlike(whole), F.replace(F.regexp_extract(x, whole, 1), F.lit('""'), F.lit('"'))).otherwise(x))
    bad = F.exists(raw, lambda x: x.contains('"') & ~x.rlike(whole))
    has_quote = line.contains('"')
    return F.when(has_quote, unquoted).otherwise(plain), has_quote & bad


UTF8_ERROR = "Unable to decode input table as UTF-8. Use binary (latin-1) encoding instead"


def _lines(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """(value) of each line. Rows have the order of files and of lines in them only where ``number`` or a
    writer asks for it: nothing is sorted here."""
    try:
        df = spark.read.text(path)
    except Exception as e:
        raise IOHandlingError(f"Unable to read {path}: {str(e).splitlines()[0]}") from e
    raw = F.col("value")
    if encoding and ENCODINGS[encoding.lower()] == "latin-1":
        return df.select(F.decode(raw.cast("binary"), "ISO-8859-1").alias("value"))
    if encoding:
        return df.select(F.when(F.is_valid_utf8(raw), raw).otherwise(F.raise_error(F.lit(UTF8_ERROR))).alias("value"))
    return df


def _begins_with(spark: SparkSession, lines: DataFrame, mark: bytes) -> bool:
    """Whether the first file begins with these bytes."""
    files = lines.inputFiles()
    if not files:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(b & 0xFF for b in (stream.read() for _ in range(len(mark))) if b >= 0) == mark
    finally:
        stream.close()


def _records(lines: DataFrame, comment: Column) -> DataFrame:
    """(value, __nr, __line) of each record of ``quoted_rfc`` lines, __line being its last line; a comment
    counts only between records.

    A line with an odd number of quotes opens or closes a quoted field, a comment line between
    records does nothing: with an odd number of quotes it leaves "outside" and makes "inside" outside.
    """
    numbered = number(lines)
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    rows = numbered.select(
        F.col(NR).alias("n"), "value", comment.alias("comment"), F.shiftright(F.col(NR), BLOCK_LINES_BITS).alias("block"),
        (odd & ~comment).cast("int").alias("flip"), (odd & comment).alias("reset"),
    )
    by_line = Window.partitionBy("block").orderBy("n")
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum("flip").over(before), F.lit(0))
    rows = rows.withColumn("flips", flips)
    rows = rows.withColumn("reset_at", F.last(F.when(F.col("reset"), F.col("flips")), ignorenulls=True).over(before))
    # what a block as a whole does to the state: one row per block of lines
    ends = rows.groupBy("block").agg(F.max_by(F.struct((F.col("flips") + F.col("flip")).alias("flips"), F.when(F.col("reset"), F.col("flips")).otherwise(F.col("reset_at")).alias("reset_at")), "n").alias("e"))
    ends = ends.select("block", F.col("e.flips").alias("bf"), F.col("e.reset_at").alias("br"))
    by_block = Window.orderBy("block")
    whole = by_block.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("total", F.coalesce(F.sum("bf").over(whole), F.lit(0)))
    ends = ends.withColumn("reset_total", F.coalesce(F.last(F.when(F.col("br").isNotNull(), F.col("total") + F.col("br")), ignorenulls=True).over(whole), F.lit(0)))
    base = ends.select("block", (F.col("total") - F.col("reset_total")).alias("base"))
    rows = rows.join(base, "block")
    inside = F.when(F.col("reset_at").isNotNull(), F.col("flips") - F.col("reset_at")).otherwise(F.col("base") + F.col("flips")) % 2 == 1
    rows = rows.withColumn("inside", inside).filter(F.col("inside") | ~F.col("comment"))
    begins = (~F.col("inside")).cast("long")
    counts = rows.groupBy("block").agg(F.sum(begins).alias("c"))
    offset = counts.select("block", F.coalesce(F.sum("c").over(whole), F.lit(0)).alias("offset"))
    rows = rows.join(offset, "block").withColumn(NR, F.col("offset") + F.sum(begins).over(by_line))
    joined = rows.groupBy(NR).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("lines"), F.max("n").alias("__line"))
    return joined.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), NR, "__line").orderBy(NR)


def read_delimited(
    spark: SparkSession, path: str, delim: str, policy: str, encoding: str | None = "utf-8", has_header: bool = False,
    comment_prefix: str | None = None, comment_regex: str | None = None, strip_whitespaces: bool = False, table_name: str = "input", modifier: str | None = None,
) -> Table:
    """The table of a text file or folder; every field is text, records may differ in width.

    An empty file gives a table without rows; a header of an empty file is empty.
    """
    check_dialect(delim, policy, encoding)
    if modifier in ("header", "headers"):
        has_header = True
    elif modifier in ("noheader", "noheaders"):
        has_header = False
    lines = _lines(spark, path, encoding)
    warnings: list[str | Callable[[], list[str]]] = []
    if _begins_with(spark, lines, BOM):
        warnings.append(f"UTF-8 Byte Order Mark (BOM) was found and skipped in {table_name} table")
    value = F.col("value")
    comment = F.lit(False)
    if comment_prefix:
        comment = comment | value.startswith(comment_prefix)
    if comment_regex:
        comment = comment | value.rlike(comment_regex)
    if policy == "quoted_rfc":
        records = _records(lines, comment)
    else:
        records = lines.filter(~comment) if comment_prefix or comment_regex else lines
    fields, bad = split_fields(value, delim, policy)
    if policy == "quoted_rfc":
        message = F.concat(F.lit(f"Inconsistent double quote escaping in {table_name} table at record "), F.col(NR).cast("string"), F.lit(", line "), F.col("__line").cast("string"))
        fields = F.when(bad, F.raise_error(message)).otherwise(fields)
    if strip_whitespaces:
        fields = F.transform(fields, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    header = None
    if policy == "quoted_rfc":
        table = records.select(fields.alias(FIELDS), NR)
        if has_header:
            head = table.filter(F.col(NR) == 1).head(1)
            header = list(head[0][0]) if head else []
            table = table.filter(F.col(NR) > 1).withColumn(NR, F.col(NR) - 1)
        out = Table(table, header, ragged=True, numbered=True)
    else:
        if has_header:
            records = records.withColumns(file_places())
        table = records.select(fields.alias(FIELDS), *(["__path", "__block", "__place"] if has_header else []))
        if has_header:
            table, header = _without_headers(table)
        if policy == "quoted":

            def quotes() -> list[str]:
                numbered = number(lines).filter(~comment)
                first = numbered.filter(split_fields(value, delim, policy)[1]).agg(F.min(NR)).first()[0]
                return [f"Inconsistent double quote escaping in {table_name} table. E.g. at line {first}"] if first else []

            warnings.append(quotes)
        out = Table(table.select(FIELDS), header, ragged=True)

    def widths() -> list[str]:
        sizes = [r[0] for r in out.df.select(F.size(FIELDS).alias("n")).distinct().limit(3).collect()]
        sizes += [len(header)] if header else []
        if len(set(sizes)) > 1:
            return [f"Number of fields in {table_name} table is not consistent: e.g. {' and '.join(str(s) for s in sorted(set(sizes))[:2])}"]
        return []

    warnings.append(widths)
    if table_name != "input" and has_header:
        warnings.append(f'The first record in {table_name} table was also treated as header')
    out.warnings = warnings
    return out


def _without_headers(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``table`` (fields, and where each record is read from) without the first record of every file, and
    that of the first file. With several files one pass finds where they begin; one place per file is kept."""
    if len(table.inputFiles()) > 1:
        first = F.min_by(F.struct("__place", FIELDS), F.struct("__block", "__place"))
        heads = table.groupBy("__path").agg(first.alias("h")).orderBy("__path").select("h.*").collect()
    else:
        heads = table.select("__place", FIELDS).head(1)
    if heads:
        table = table.filter(~F.col("__place").isin([h["__place"] for h in heads]))
    return table, list(heads[0][FIELDS]) if heads else []


def detect_dialect(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(delimiter, policy) from the first lines, else from the file's name; None if neither tells."""
    lines = [r[0] for r in spark.read.text(path).head(10)]
    for delim, policy in (("\t", "simple"), (",", "quoted"), (";", "quoted"), ("|", "simple")):
        if len(lines) < 2:
            break
        frame = spark.createDataFrame([(x,) for x in lines], "value string")
        fields, bad = split_fields(F.col("value"), delim, policy)
        sizes = frame.select(F.size(fields).alias("n"), bad.alias("bad")).collect()
        if len({r["n"] for r in sizes}) == 1 and sizes[0]["n"] >= 2 and not any(r["bad"] for r in sizes):
            return delim, policy
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    return {".csv": (",", "quoted"), ".tsv": ("\t", "simple")}.get(extension)


def table_path(name: str, input_path: str | None, index_file: str = "~/.loamql_table_names") -> str | None:
    """Where a join table is: a path, a path beside the input, or a name in the index file (name, tab,
    path)."""
    for path in (os.path.expanduser(name), os.path.join(os.path.dirname(input_path), name) if input_path else None):
        if path and os.path.exists(path):
            return path
    index = os.path.expanduser(index_file)
    if os.path.exists(index):
        with open(index, encoding="utf-8") as lines:
            for line in lines:
                parts = line.rstrip("\n").split("\t")
                if len(parts) > 1 and parts[0] == name and os.path.exists(os.path.expanduser(parts[1])):
                    return os.path.expanduser(parts[1])
    return name if re.match(r"^[a-z0-9]+://", name) else None
