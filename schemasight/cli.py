"""Command line: scan, suggest, export, script, search, older, check, team. check and team exit with 1 if the gate blocks."""

from __future__ import annotations

import argparse
import sys

from schemasight import api, sinks
from schemasight.operators.reports import fitting_widths, table_lines
from schemasight.session import session
from schemasight.shared import settle


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="schemasight")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "suggest", "export", "search", "check", "script", "older"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--json", help="write the rows to this directory as JSON")
        if name in ("export", "script"):
            s.add_argument("--format", choices=sorted(api.FORMATS) if name == "export" else ["mongo_shell", "pymongo"], default="mongo_shell")
            s.add_argument("--db-name")
        if name == "search":
            s.add_argument("words")
        if name == "check":
            s.add_argument("--family", choices=sorted(api.FAMILIES))
            s.add_argument("--config")
            s.add_argument("--html", help="write a page to this file")
            s.add_argument("--report", help="write the sections of the report to this directory")
    t = sub.add_parser("team")
    t.add_argument("team")
    t.add_argument("--catalog", required=True)
    t.add_argument("--config")
    t.add_argument("--json")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command in ("check", "team"):
        if getattr(a, "report", None):
            api.check_report(spark, a.path, a.report, a.config)
        out = api.check(spark, a.path, a.family, a.config) if a.command == "check" else api.check_team(spark, a.catalog, a.team, config=a.config)
        if not out:
            print("nothing to scan")
            return 0
        if a.json:
            api.report(out["violations"], a.json)
        if getattr(a, "html", None):
            sinks.write_page(out["violations"], out["gate"], a.html)
        out["gate"].show(100, truncate=False)
        return 0 if all(r["passed"] for r in out["gate"].collect()) else 1
    rows = {"scan": lambda: api.indexes(spark, a.path), "suggest": lambda: api.suggestions(spark, a.path), "export": lambda: api.export(spark, a.path, a.format, a.db_name), "search": lambda: api.search(spark, a.path, a.words), "script": lambda: api.script(spark, a.path, a.format, a.db_name), "older": lambda: api.older_suggestions(spark, a.path)}[a.command]()
    if a.json:
        api.report(rows, a.json)
    elif a.command in ("export", "script"):
        for r in rows.toLocalIterator():
            print(r["line"])
    else:
        rows = settle(rows)  # read for the widths and again for the lines
        widths = fitting_widths(rows)
        print("  ".join(c.ljust(w)[:w] for c, w in widths.items()).rstrip())
        for r in table_lines(rows, widths).select("table_line").toLocalIterator():
            print(r["table_line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
