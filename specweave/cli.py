"""Command line: ``python -m specweave.cli [options] [path ...]``."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from . import __version__
from .functions.refs import SPACES

HELP = """Usage: specweave [options] [path ...]

Traces requirement items through Markdown specs and source files.

  -t, --tags <a,b,_>        keep spec items with one of these tags; _ keeps untagged ones
  -f, --format <text|json>  report format
      --json                same as --format json
  -v, --verbose             list every item and its edges (text only)
  -V, --version             print the version
  -h, --help                print this help
"""


class UsageError(Exception):
    pass


@dataclass
class Options:
    paths: list[str] = field(default_factory=list)
    tags: list[str] | None = None
    format: str | None = None
    verbose: bool = False
    show: str | None = None


def parse_args(argv: list[str]) -> Options:
    out, args, chosen = Options(), list(argv), {}
    values = {"-t": "tags", "--tags": "tags", "-f": "format", "--format": "format"}
    flags = {"--json": "json", "-v": "verbose", "--verbose": "verbose", "-V": "version", "--version": "version", "-h": "help", "--help": "help"}
    while args:
        arg = args.pop(0)
        if not arg.startswith("-") or arg == "-":
            out.paths.append(arg)
            continue
        if arg == "--":
            out.paths += args
            break
        name, eq, value = arg.partition("=") if arg.startswith("--") else (arg, "", "")
        if name in flags:
            if eq:
                raise UsageError(f"option {name} does not take a value")
            kind = flags[name]
            if kind in ("version", "help"):
                out.show = kind
                return out
        elif name in values:
            kind = values[name]
            if not eq:
                if not args:
                    raise UsageError(f"missing value for {name}")
                value = args.pop(0)
        else:
            raise UsageError(f"unknown option: {name}")
        setting = "format" if kind == "json" else kind
        if setting in chosen:
            raise UsageError(f"{name} is already selected by {chosen[setting]}")
        chosen[setting] = name
        if kind == "tags":
            out.tags = [t for t in (x.strip(SPACES) for x in value.split(",")) if t]
        elif kind == "json":
            out.format = "json"
        elif kind == "format":
            if value not in ("text", "json"):
                raise UsageError(f'invalid value for {name}: "{value}" (expected "text" or "json")')
            out.format = value
        else:
            out.verbose = True
    if out.verbose and out.format == "json":
        raise UsageError("-v/--verbose applies to the text format only")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 clean, 1 with defects or problems, 2 for usage and read errors."""
    from .operators.extract import ReadError
    from .sources.tree import MissingPath

    try:
        opts = parse_args(sys.argv[1:] if argv is None else argv)
        if opts.show:
            print(__version__ if opts.show == "version" else HELP.rstrip())
            return 0
        from pyspark.sql import SparkSession

        from .operators.extract import files_frame, trace_of
        from .report import Report, use_colour

        spark = spark or SparkSession.builder.appName("specweave").getOrCreate()
        files = files_frame(spark, opts.paths)
        report = Report(trace_of(files, opts.tags))
    except (UsageError, MissingPath, ReadError) as e:
        print(f"error: {e}\n\n{HELP}", file=sys.stderr)
        return 2
    sys.stdout.write(report.json(__version__) if opts.format == "json" else report.text(opts.verbose, use_colour()))
    return 0 if report.clean else 1


if __name__ == "__main__":
    sys.exit(main())
