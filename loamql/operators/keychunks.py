"""Per-key results in equal chunks of rows, whatever share of the rows a key holds.

Rows are put into one total order by key, without moving a key into one task:

1. count the rows of each key within each input block (a fixed run of rows of one input file);
2. prefix-sum those counts over (key, block), which gives each pair its offset in the total order;
3. number the rows: offset of (key, block) plus the rank within the block;
4. cut the numbers into chunks of equal size and reduce each chunk to one state per key in it;
5. merge the states. Only a chunk's first and last key can continue in a neighbour, so there are at
   most (keys + chunks) states, and they carry their ends so that values cut by a chunk's edge are
   counted once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamql.session import pin, shuffle_width

BLOCK_ROWS_BITS = 18  # rows of one input file that count as one block: 2**18
CHUNK_ROWS = 65_536


def _places(df: DataFrame) -> list[Column]:
    """The file and row of each row, where ``df`` is read from files; else none."""
    try:
        cols = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")]
        df.select(*cols).schema
    except AnalysisException:
        return []
    return cols


def with_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with ``__block`` and ``__row``, a stable place of each row in the input.

    A frame that is read from files uses the file's name and row index; any other is written to the
    shared folder first, as its rows have no stable place of their own.
    """
    if "__path" in df.columns and "__row" in df.columns:  # placed before
        placed = df.select(*columns, "__path", "__row")
    elif places := _places(df):
        placed = df.select(*columns, *places)
    else:
        pinned = pin(df.select(*columns))
        placed = pinned.select(*columns, *_places(pinned))
    block = F.xxhash64(F.col("__path"), F.shiftright("__row", BLOCK_ROWS_BITS))
    return placed.withColumn("__block", block).drop("__path")


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before the row in ``order``.

    Distributed: range partitions are summed apart, their totals (one row per partition) are summed
    in order, and each partition adds its base. ``order`` has to identify a row.
    """
    width = shuffle_width(df.sparkSession)
    ranged = pin(df.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()))
    # one row per range partition, so its size is bounded by the shuffle width
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    base = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + F.col("__within")).drop("__range", "__base", "__within")


def number_rows(df: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """``keys`` and ``carry`` of each row with ``__pos``, its place from 0 in the order of ``keys``.

    Null is a key of its own and comes first. Ties are kept apart by the row's place in the input,
    so the numbering is the same in every run over the same files.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    placed = with_blocks(df, list(dict.fromkeys([*keys, *carry])))
    # a key is held as (is it set, value), so that nulls join and sort like any other key
    for name, key in zip(names, keys):
        placed = placed.withColumn(name, F.struct(F.col(key).isNotNull().alias("set"), F.col(key).alias("value")))
    flat = []
    for name in names:
        flat += [F.col(f"{name}.set").alias(f"{name}s"), F.coalesce(F.col(f"{name}.value").cast("string"), F.lit("")).alias(f"{name}v")]
    cols = [f"{n}{x}" for n in names for x in "sv"]
    placed = placed.select("*", *flat).drop(*names)
    counts = placed.groupBy("__block", *cols).agg(F.count(F.lit(1)).alias("__n"))
    offsets = prefix_sums(counts, [*cols, "__block"], "__n", "__offset").drop("__n")
    rank = F.row_number().over(Window.partitionBy("__block", *cols).orderBy("__row")) - 1
    numbered = placed.withColumn("__rank", rank).join(offsets, ["__block", *cols])
    return numbered.withColumn("__pos", F.col("__offset") + F.col("__rank")).drop("__block", "__row", "__rank", "__offset", *cols)


def chunked(df: DataFrame, keys: list[str], carry: list[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The numbered rows with ``__chunk``; every chunk but the last has exactly ``chunk_rows`` rows."""
    return number_rows(df, keys, carry).withColumn("__chunk", F.floor(F.col("__pos") / F.lit(chunk_rows)).cast("long"))


def key_counts(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, n, total): the rows of each key, null included, and of the whole table.

    An empty table gives no row.
    """
    named = df.withColumnRenamed(key, "__key")
    states = chunked(named, ["__key"], chunk_rows=chunk_rows).groupBy("__chunk", "__key").agg(F.count(F.lit(1)).alias("n"))
    merged = states.groupBy("__key").agg(F.sum("n").alias("n"))
    total = merged.agg(F.sum("n").alias("total"))  # one row
    return merged.crossJoin(F.broadcast(total)).select(F.col("__key").alias(key), "n", "total")


def key_summary(df: DataFrame, key: str, member: str, measures: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, n, n_members, *measures): rows, distinct non-null ``member`` values and sums per key.

    ``measures`` maps a result's name to the expression that is summed; a null adds nothing, and a
    key without a value sums to null. Rows are ordered by (key, member), so a chunk sees each member
    as one run; a member that goes on from the chunk before is counted there only. Other columns of
    ``df``, whatever their names, don't matter; an empty table gives no row.
    """
    sums = [f"__m{n}" for n in range(len(measures))]
    named = df.select(*(e.alias(s) for e, s in zip(measures.values(), sums)), F.col(key).alias("__key"), F.col(member).alias("__member"), *_places(df))
    rows = chunked(named, ["__key", "__member"], sums, chunk_rows)
    runs = rows.groupBy("__chunk", "__key", "__member").agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in sums))
    states = runs.groupBy("__chunk", "__key").agg(
        F.sum("n").alias("n"), F.count("__member").alias("members"), F.min("__member").alias("first"), F.max("__member").alias("last"), *(F.sum(s).alias(s) for s in sums)
    )
    # a key's chunks follow each other without a gap, so the state before is that of the chunk before: the
    # states meet by (key, chunk), and no task gets all states of a key
    states = pin(states)
    prior = states.select(F.col("__key").alias("__pkey"), (F.col("__chunk") + 1).alias("__pchunk"), F.col("last").alias("before"))
    states = states.join(prior, states["__key"].eqNullSafe(prior["__pkey"]) & (states["__chunk"] == prior["__pchunk"]), "left").drop("__pkey", "__pchunk")
    cut = F.when(F.col("before") == F.col("first"), 1).otherwise(0)
    merged = (
        states.withColumn("members", F.col("members") - cut)
        .groupBy("__key")
        .agg(F.sum("n").alias("n"), F.sum("members").alias("n_members"), *(F.sum(s).alias(s) for s in sums))
    )
    return merged.select(F.col("__key").alias(key), "n", "n_members", *(F.col(s).alias(name) for s, name in zip(sums, measures)))


def heavy_keys(df: DataFrame, key: str, percent: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, n, total) of the non-null keys that at least ``percent`` of all rows hold."""
    named = key_counts(df.withColumnRenamed(key, "__heavy"), "__heavy", chunk_rows)
    found = named.filter(F.col("__heavy").isNotNull() & (F.col("n") * 100 >= F.col("total") * F.lit(percent)))
    return found.select(F.col("__heavy").alias(key), "n", "total")
