"""The command line: csv, json and sqlite modes, and an interactive loop where no query is given."""

from __future__ import annotations

import argparse
import atexit
import contextlib
import itertools
import json
import os
import shutil
import sys
import tempfile

from loamql import __version__

HISTORY = "~/.loamql_history"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loamql", description="Run a query over text, JSON Lines or SQLite tables.")
    parser.add_argument("--version", action="version", version=__version__)
    modes = parser.add_subparsers(dest="mode", required=True)
    for mode in ("csv", "json", "sqlite"):
        p = modes.add_parser(mode)
        p.add_argument("--query")
        p.add_argument("--input")
        p.add_argument("--output")
        p.add_argument("--init-source-file")
        p.add_argument("--error-format", choices=("hr", "json"), default="hr")
        p.add_argument("--debug-mode", action="store_true", help="show errors as they are raised")
        if mode in ("csv", "sqlite"):
            p.add_argument("--out-format", choices=("csv", "tsv", "input"), default="input" if mode == "csv" else "csv")
            p.add_argument("--out-delim")
            p.add_argument("--out-policy")
            p.add_argument("--color", action="store_true")
        if mode == "csv":
            p.add_argument("--delim", default=None)
            p.add_argument("--policy", choices=("simple", "quoted", "quoted_rfc", "whitespace", "monocolumn"))
            p.add_argument("--encoding", default="utf-8", choices=("utf-8", "latin-1"))
            p.add_argument("--with-headers", action="store_true")
            p.add_argument("--comment-prefix")
            p.add_argument("--comment-regex")
            p.add_argument("--strip-spaces", "--trim-spaces", dest="strip", action="store_true")
        if mode == "sqlite":
            p.add_argument("--database", required=True)
    return parser


def _delimiter(text: str | None) -> str | None:
    return {"TAB": "\t", "\\t": "\t", None: None}.get(text, text)


def _report(args: argparse.Namespace, error: Exception) -> None:
    from loamql.api import error_info

    kind, message = error_info(error)
    if args.error_format == "json":
        print(json.dumps({"error_type": kind, "error": message}), file=sys.stderr)
    else:
        print(f"Error [{kind}]: {message}", file=sys.stderr)


def _init_code(args: argparse.Namespace) -> str:
    from loamql.api import default_init_code

    if args.init_source_file:
        with open(args.init_source_file, encoding="utf-8") as source:
            return source.read()
    return default_init_code()


def _out(args: argparse.Namespace, delim: str, policy: str) -> tuple[str, str]:
    from loamql.sources import delimited

    if args.out_delim is not None:
        delim = _delimiter(args.out_delim)
        return delim, args.out_policy or delimited.default_policy(delim)
    if args.out_format != "input":
        delim, policy = delimited.named_format(args.out_format)
    return delim, args.out_policy or policy


def run_one(args: argparse.Namespace, query: str) -> bool:
    from loamql.api import error_info, query_csv, query_json, query_sqlite, set_debug_mode
    from loamql.plans.lexer import RuntimeQueryError
    from loamql.session import local_session
    from loamql.sinks import writers
    from loamql.sources import delimited

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = local_session()
        spark.sparkContext.setLogLevel("OFF")
    set_debug_mode(args.debug_mode)
    result = None
    try:
        said: list[str] = []
        if args.mode == "json":
            result = query_json(spark, query, args.input, args.output, _init_code(args))
            if not args.output:
                with result.placing_errors():
                    for row in writers.json_lines(result.table).toLocalIterator():
                        print(row[0])
            return True
        if args.mode == "csv":
            delim, policy = _delimiter(args.delim), args.policy
            if delim is None:
                found = delimited.detect_dialect(spark, args.input) if not policy == "monocolumn" else ("", "monocolumn")
                if found is None:
                    raise SystemExit("Unable to tell the dialect of the input, name it with --delim and --policy")
                delim, policy = found[0], policy or found[1]
            policy = policy or delimited.default_policy(delim)
            out_delim, out_policy = _out(args, delim, policy)
            result = query_csv(
                spark, query, args.input, delim, policy, None, out_delim, out_policy, args.encoding, args.with_headers, args.comment_prefix, _init_code(args), args.strip, args.comment_regex
            )
        else:
            out_delim, out_policy = _out(args, ",", "quoted_rfc")
            result = query_sqlite(spark, query, args.database, args.input, _init_code(args))
        with result.placing_errors():
            if args.output:
                with open(args.output, "w", encoding=getattr(args, "encoding", "utf-8"), newline="") as out:
                    writers.write_stream(result.table, out, out_delim, out_policy)
            elif not writers.write_stream(result.table, sys.stdout, out_delim, out_policy, colour=args.color):
                os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())  # the reader went away
                return True
        said = result.warnings
        for warning in dict.fromkeys(said):
            print(f"Warning: {warning}", file=sys.stderr)
        return True
    except Exception as e:  # noqa: BLE001 - told to the user
        if args.debug_mode:
            raise
        if result is not None and error_info(e)[0] == "query execution" and " record" not in error_info(e)[1]:
            with contextlib.suppress(Exception):  # the message without the record will do
                if found := result.first_bad_record():
                    e = RuntimeQueryError(f"At record {found[0]}, Details: {found[1]}")
        _report(args, e)
        return False


def interactive(args: argparse.Namespace) -> int:
    """Show the input's first records, then run queries until an empty line."""
    try:
        import readline

        if os.path.exists(os.path.expanduser(HISTORY)):
            readline.read_history_file(os.path.expanduser(HISTORY))
    except ImportError:
        readline = None
    preview = argparse.Namespace(**vars(args) | {"output": None})
    run_one(preview, "SELECT TOP 10 *")
    while True:
        try:
            query = input("Input query, or an empty line to leave:\n> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        if not query:
            return 0
        if readline:
            readline.write_history_file(os.path.expanduser(HISTORY))
        if run_one(args, query) and args.output:  # what was written is shown from its file
            print(f"The result is in {args.output}; it begins with:")
            with open(args.output, encoding=getattr(args, "encoding", "utf-8")) as made:
                for line in itertools.islice(made, 10):
                    print(line.rstrip("\n"))


def _from_stdin() -> str:
    """The standard input as a file, so that it can be read in parts and more than once."""
    handle, path = tempfile.mkstemp(prefix="loamql-stdin-")
    atexit.register(os.unlink, path)
    with os.fdopen(handle, "wb") as copy:
        shutil.copyfileobj(sys.stdin.buffer, copy)
    return path


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.query is None:
        if args.mode != "sqlite" and not args.input:
            print("Error: --input is needed where queries are typed in", file=sys.stderr)
            return 1
        return interactive(args)
    if args.mode != "sqlite" and not args.input:
        args.input = _from_stdin()
    return 0 if run_one(args, args.query) else 1
