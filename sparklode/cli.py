"""python -m sparklode.cli scan|analyze|report|brief|ask|update|status ROOT [QUESTION]"""

from __future__ import annotations

import argparse
import json
import sys

from .session import build_session
from .sources.scan import Limits


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparklode")
    parser.add_argument("verb", choices=("scan", "analyze", "report", "brief", "ask", "update", "status"))
    parser.add_argument("root")
    parser.add_argument("question", nargs="?")
    parser.add_argument("--state")
    parser.add_argument("--output")
    parser.add_argument("--force", action="store_true", help="parse everything again")
    parser.add_argument("--max-files", type=int, default=Limits.files)
    parser.add_argument("--limit", type=int, default=8)
    parser.add_argument("--master")
    parser.add_argument("--include", action="append", default=[], help="bring back what is ignored")
    parser.add_argument("--exclude", action="append", default=[], help="leave out a folder or what a glob matches")
    parser.add_argument("--concurrency", type=int, help="tasks side by side, where --master is not given")
    parser.add_argument("--json", action="store_true", help="one line of JSON instead of an indented one")
    parser.add_argument("--quiet", action="store_true", help="print nothing but errors")
    args = parser.parse_args(argv)
    if args.verb == "ask" and not args.question:
        parser.error("ask needs a question")
    if args.limit < 1 or args.max_files < 1 or args.concurrency is not None and args.concurrency < 1:
        parser.error("--limit, --max-files and --concurrency must be positive")
    from .api import Project

    spark = build_session("sparklode", args.master or (f"local[{args.concurrency}]" if args.concurrency else None), spark__ui__showConsoleProgress="false")
    try:
        project = Project(spark, args.root, args.state, Limits(files=args.max_files))
        result = {"scan": lambda: project.scan(args.include, args.exclude), "analyze": lambda: project.analyze(args.include, args.exclude, not args.force), "update": lambda: project.update(args.include, args.exclude), "brief": project.brief, "status": project.status, "report": lambda: project.report(args.output), "ask": lambda: project.ask(args.question, args.limit)}[args.verb]()
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    if not args.quiet:
        print(result if isinstance(result, str) else json.dumps(result, indent=None if args.json else 2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
