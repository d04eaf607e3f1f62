"""Command line: python -m snapweave.cli COMMAND ... Exit codes: 0 ok, 1 failed check, 2 I/O, 3 internal, 4 usage."""

from __future__ import annotations

import argparse
import json
import sys
import traceback

from . import __version__
from .errors import SnapweaveError, UsageError
from .functions.labels import CHANGE_CLASSES
from .operators.libraries import PREFERENCE


class BadArguments(UsageError):
    """What the parser of the command line refuses."""


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise BadArguments(message)


def parser() -> Parser:
    p = Parser(prog="snapweave")
    p.add_argument("--schema-override", choices=list("ABCDEF"))
    p.add_argument("--version-label")
    p.add_argument("--mid-bridge")
    p.add_argument("--on-mid-collision", choices=["error", "warn"], default="error")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True, parser_class=Parser)

    def turnover(c: Parser) -> None:
        c.add_argument("--turnover-warn", type=float, default=0.05)
        c.add_argument("--turnover-fail", type=float, default=0.30)
        c.add_argument("--report-json")

    def collapse(c: Parser) -> None:
        c.add_argument("--json", action="store_true")
        c.add_argument("--collapse-to-individual", action="store_true")
        c.add_argument("--gid-preference", default=",".join(PREFERENCE))
        c.add_argument("-o", "--out", required=True)

    c = sub.add_parser("cohort")
    c.add_argument("file")
    c.add_argument("--anno-files", nargs="+", required=True, action="extend")
    c.add_argument("--cohort-version")
    c.add_argument("--no-propagate", action="store_true")
    c.add_argument("--cohort-coverage-warn", type=float, default=0.50)
    c.add_argument("--cohort-coverage-fail", type=float, default=0.25)
    collapse(c)
    turnover(c)

    c = sub.add_parser("diff")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--json", action="store_true", help="the default")
    c.add_argument("--tsv", action="store_true")
    c.add_argument("-o", "--out")
    c.add_argument("--include-class", action="append", default=[], choices=CHANGE_CLASSES)
    c.add_argument("--all-events", action="store_true")
    c.add_argument("--substantive-regroup-fail", type=int)
    c.add_argument("--report")
    turnover(c)

    c = sub.add_parser("join")
    c.add_argument("old")
    c.add_argument("new")
    collapse(c)

    for name, many in (("lookup", False), ("validate-groups", True)):
        c = sub.add_parser(name)
        c.add_argument("query", nargs="+" if many else None)
        c.add_argument("--anno-files", nargs="+", required=True, action="extend")
        c.add_argument("--json", action="store_true")

    c = sub.add_parser("schema")
    c.add_argument("path")
    c.add_argument("--json", action="store_true")
    return p


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("snapweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def check_paths(spark, paths: list[str]) -> None:
    """Release files that don't exist are wrong usage."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise BadArguments(f"there is no file {p}")


def run(args: argparse.Namespace) -> None:
    from .errors import ValidationFailure
    from .plans import commands as C
    from .plans import render as R

    spark = session()
    opts = C.Options(args.schema_override, args.version_label, args.mid_bridge, args.on_mid_collision, args.quiet)
    check_paths(spark, [*getattr(args, "anno_files", []), *(getattr(args, n) for n in ("old", "new", "path", "file") if hasattr(args, n))])
    chosen = lambda: tuple(x.strip() for x in args.gid_preference.split(",") if x.strip())
    if args.command == "cohort":
        C.cohort(
            spark, args.file, args.anno_files, args.out, opts, args.cohort_version, args.json, args.collapse_to_individual, chosen(), (args.turnover_warn, args.turnover_fail), (args.cohort_coverage_warn, args.cohort_coverage_fail),
            args.report_json, not args.no_propagate,
        )
    elif args.command == "diff":
        C.diff(spark, args.old, args.new, opts, args.out, args.tsv, args.include_class, args.all_events, (args.turnover_warn, args.turnover_fail), args.substantive_regroup_fail, args.report, args.report_json)
    elif args.command == "join":
        C.join(spark, args.old, args.new, args.out, opts, args.json, args.collapse_to_individual, chosen())
    elif args.command == "lookup":
        found = C.lookup(spark, args.query, args.anno_files, opts)
        sys.stdout.write(json.dumps(found, indent=2) + "\n" if args.json else R.lookup_text(found))
    elif args.command == "schema":
        release = C.schema(spark, args.path, opts)
        sys.stdout.write(json.dumps(release.describe(), indent=2) + "\n" if args.json else R.schema_text(release))
    else:
        items = C.validate_groups(spark, args.query, args.anno_files, opts)
        if args.json:
            sys.stdout.write(json.dumps(items, indent=2) + "\n")
        for x in [] if args.json else items:
            if x["status"] == "lifted":
                opts.warn(R.LIFTED.format(group_id=x["group_id"], lifted_to=x["lifted_to"], found_in=", ".join(x["found_in"])))
            elif x["status"] == "unresolvable":
                opts.warn(R.UNKNOWN.format(group_id=x["group_id"]))
        if lost := [x["group_id"] for x in items if x["status"] == "unresolvable"]:
            raise ValidationFailure(R.UNRESOLVABLE.format(n=len(lost), ids=", ".join(f"'{g}'" for g in lost)))


def main(argv: list[str] | None = None) -> int:
    from .plans.render import ERROR, USAGE

    try:
        run(parser().parse_args(argv))
    except BadArguments as e:
        sys.stderr.write(USAGE.format(text=e) + "\n")
        return e.exit_code
    except SnapweaveError as e:
        sys.stderr.write(ERROR.format(text=e) + "\n")
        return e.exit_code
    except KeyboardInterrupt:
        return 4
    except OSError as e:
        sys.stderr.write(ERROR.format(text=e) + "\n")
        return 2
    except Exception:
        traceback.print_exc()
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
