"""Queries over streaming DataFrames: SELECT and UPDATE stages that need no order and no whole table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from loamql.api import Options, run
from loamql.plans.lexer import ParsingError, stages
from loamql.plans.stage import parse_stage
from loamql.sources.tables import Table, from_frame


def query_stream(text: str, stream: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The streaming result of ``text`` over ``stream``; joins are inner or left, with static tables.

    What depends on the order or the end of the input is refused: NR, ORDER BY, LIMIT, DISTINCT,
    GROUP BY and other aggregates, STRICT LEFT JOIN and UPDATE with a join.
    """
    if not stream.isStreaming:
        raise ParsingError("the input is not a stream")
    for parts in stages(text):
        stage = parse_stage(parts, with_from=False)
        refused = {"ORDER BY": stage.order, "GROUP BY": stage.group, "LIMIT": stage.limit is not None, "DISTINCT": stage.distinct}
        refused["STRICT LEFT JOIN"] = stage.join and stage.join.how == "strict"
        refused["UPDATE with a join"] = stage.join and stage.assignments is not None
        refused["NR"] = any(t.kind == "word" and t.text in ("NR", "aNR", "bNR") for t in parts)
        for name, there in refused.items():
            if there:
                raise ParsingError(f"{name} can't be used on a stream")
    known = {k: from_frame(v) for k, v in (tables or {}).items()}

    def find(name: str, modifier: str | None) -> Table | None:
        return known.get(name)

    result = run(text, from_frame(stream), find if tables is not None else None, Options())
    return result.df
