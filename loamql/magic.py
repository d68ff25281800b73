"""A line magic for notebooks: ``%loamql SELECT ... FROM frame``, frames being notebook variables."""

from __future__ import annotations


def run_magic(line: str, variables: dict[str, object]):  # noqa: ANN201
    """The result as a frame: Spark's if all named tables are Spark's, else pandas'."""
    from pyspark.sql import DataFrame, SparkSession

    from loamql.api import _pandas, run
    from loamql.operators.engine import Options
    from loamql.sources.others import from_any

    spark = SparkSession.getActiveSession()
    if spark is None:
        from loamql.session import local_session

        spark = local_session()
    used: list[object] = []

    def find(name: str, modifier: str | None):  # noqa: ANN202
        frame = variables.get(name)
        if frame is None or not (isinstance(frame, DataFrame) or hasattr(frame, "itertuples")):
            return None
        used.append(frame)
        return from_any(spark, frame)

    calls = {k: v for k, v in variables.items() if callable(v) and not k.startswith("_")}
    result = run(line, None, find, Options(user=calls, keep_order=True))
    return result.df if all(isinstance(u, DataFrame) for u in used) else _pandas(result)


def load_ipython_extension(ipython) -> None:  # noqa: ANN001
    """Registers the magic and completes column names after ``frame.``"""

    def magic(line: str):  # noqa: ANN202
        return run_magic(line, ipython.user_ns)

    def complete(shell, event):  # noqa: ANN001, ANN202
        text = event.line
        for name, frame in shell.user_ns.items():
            if not name.startswith("_") and hasattr(frame, "columns") and f" {name}" in text:
                return [f"a.{c}" for c in frame.columns if str(c).isidentifier()]
        return ["SELECT", "UPDATE", "WHERE", "GROUP BY", "ORDER BY", "LIMIT", "JOIN"]

    ipython.register_magic_function(magic, "line", "loamql")
    ipython.set_hook("complete_command", complete, str_key="%loamql")
