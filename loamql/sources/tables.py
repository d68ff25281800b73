"""Tables as the engine sees them: rows in an order, an optional header, columns by position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamql.session import pin

NR = "__nr"
FIELDS = "__fields"


@dataclass
class Table:
    """``df`` holds the columns by position: c1 to cN, or one array of strings in ``__fields`` where
    records differ in width. ``__nr`` is the record's number from 1, where it was asked for."""

    df: DataFrame
    header: list[str] | None
    ragged: bool = False
    numbered: bool = False
    counted: bool = True  # whether __nr, where there is one, is the record's number; else it only sorts like it
    warnings: list[str | Callable[[], list[str]]] = field(default_factory=list)  # a callable looks when asked
    checks: list[Callable[[], Exception | None]] = field(default_factory=list)  # what a failed run is asked for: the input's error, with its place

    @property
    def width(self) -> int:
        return len([c for c in self.df.columns if c != NR])

    def names(self) -> list[str]:
        return [f"c{n + 1}" for n in range(self.width)]

    def with_numbers(self) -> Table:
        if self.numbered and self.counted:
            return self
        return replace(self, df=number(self.df), numbered=True)

    def with_order(self) -> Table:
        """With a ``__nr`` that sorts like the record's number: no pass that counts is needed where the
        rows come straight from files."""
        if self.numbered:
            return self
        nodes = _linear(self.df)
        if nodes is None or "Python" in nodes:
            return self.with_numbers()
        places = file_places()
        place = F.struct(*(c.alias(n) for n, c in places.items())) if len(self.df.inputFiles()) > 1 else places["__place"]
        return replace(self, df=self.df.withColumn(NR, place), numbered=True, counted=False)

    def frame(self) -> DataFrame:
        """The rows under the header's names, col1 to colN where there is none."""
        if self.ragged:
            return self.df.select(F.col(FIELDS).alias("fields"))
        names = self.header or [f"col{n + 1}" for n in range(self.width)]
        return self.df.select(*(F.col(c).alias(h) for c, h in zip(self.names(), names)))


def number(df: DataFrame) -> DataFrame:
    """``df`` with ``__nr`` from 1, in the order of its files and the rows in them.

    * Rows straight from Parquet have their place in the file; with several files the row counts of
      those before are added, from a table of one row per file.
    * Other rows that only come through projections and filters of a single file's scan keep its
      order: their place in the task is dense, and the row counts of the tasks before are added, from a
      table of one row per task. Both passes cut the file alike.
    * The same over several files: the counts of the stretches of files before are added, from a table of
      one row per stretch that a task reads.
    * Any other frame is written to the shared folder first, in its order.
    """
    nodes = _linear(df)
    if nodes is not None and "Filter" not in nodes and "parquet" in nodes:
        placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
        if len(df.inputFiles()) == 1:
            return placed.withColumn(NR, F.col("__row") + 1).drop("__path", "__row")
        files = df.select(F.col("_metadata.file_path").alias("__path")).groupBy("__path").agg(F.count(F.lit(1)).alias("__n"))
        before = files.select("__path", (F.sum("__n").over(Window.orderBy("__path")) - F.col("__n")).alias("__before"))
        return placed.join(before, "__path").withColumn(NR, F.col("__before") + F.col("__row") + 1).drop("__path", "__row", "__before")
    if nodes is not None and len(df.inputFiles()) == 1:
        placed = df.withColumn("__place", F.monotonically_increasing_id())
        task, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
        if df.rdd.getNumPartitions() == 1:
            return placed.withColumn(NR, F.col("__place") + 1).drop("__place")
        tasks = df.select(F.spark_partition_id().cast("long").alias("__task")).groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
        before = tasks.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__before"))
        placed = placed.withColumn("__task", task).withColumn("__within", within)
        return placed.join(before, "__task").withColumn(NR, F.col("__before") + F.col("__within") + 1).drop("__place", "__task", "__within", "__before")
    if nodes is not None and "Python" not in nodes:
        placed = df.withColumns(file_places())
        blocks = placed.groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__least"))
        before = blocks.select("__path", "__block", "__least", (F.sum("__n").over(Window.orderBy("__path", "__block")) - F.col("__n")).alias("__before"))
        joined = placed.join(before, ["__path", "__block"])
        return joined.withColumn(NR, F.col("__before") + F.col("__place") - F.col("__least") + 1).drop("__path", "__block", "__place", "__least", "__before")
    return number(pin(df))


def file_places() -> dict[str, Column]:
    """Where a row is read from: its file, the first byte of the stretch of it that its task reads, and a
    number that grows along each stretch."""
    return {"__path": F.input_file_name(), "__block": F.input_file_block_start(), "__place": F.monotonically_increasing_id()}


def of_many_files(df: DataFrame) -> bool:
    return _linear(df) is not None and len(df.inputFiles()) > 1


def in_file_order(df: DataFrame) -> bool:
    """Whether the order of partitions is the order of rows: one file, only projected and filtered."""
    return _linear(df) is not None and len(df.inputFiles()) == 1


def _linear(df: DataFrame) -> set[str] | None:
    """The kinds of nodes of a plan that only projects and filters one scan of files, with the scan's
    format; None for any other plan. Projections that hide the scan's columns count as filters."""
    kinds: set[str] = set()
    plan = df._jdf.queryExecution().analyzed()
    if "PythonUDF" in plan.toString():
        kinds.add("Python")
    while True:
        name = plan.nodeName()
        if name == "LogicalRelation":
            relation = plan.relation().toString().lower()
            kinds.add("parquet" if relation.startswith("parquet") or "parquet" in str(plan.toString()).lower().split("relation")[-1] else "other")
            break
        if name not in ("Project", "Filter", "SubqueryAlias", "View"):
            return None
        kinds.add(name)
        plan = plan.children().apply(0)
    if "parquet" in kinds and "Filter" not in kinds:
        try:
            df.select("_metadata.row_index").schema
        except AnalysisException:
            kinds.add("Filter")
    return kinds


def from_frame(df: DataFrame, header: list[str] | None = None, numbers: str | None = None) -> Table:
    """A table of a DataFrame; ``numbers`` is a column that holds the record number already."""
    names = [c for c in df.columns if c != numbers]
    inner = iter(range(1, len(names) + 1))
    renamed = df.toDF(*(NR if c == numbers else f"c{next(inner)}" for c in df.columns))  # by position, so that equal names do no harm
    return Table(renamed, list(names) if header is None else header or None, numbered=bool(numbers))
