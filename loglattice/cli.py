"""Command line: ``python -m loglattice.cli analyze --source KIND=PATH ...`` and others."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from loglattice import cases
from loglattice.events import derive
from loglattice.functions import attack, decode
from loglattice.operators import delta
from loglattice.operators.slices import slice_report
from loglattice.sources.detect import detect, routed
from loglattice.sources.readers import READERS, build_events


def session() -> SparkSession:
    return SparkSession.builder.appName("loglattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _sources(pairs: list[str]) -> list[tuple[str, str, dict]]:
    out = []
    for p in pairs:
        kind, _, path = p.partition("=")
        if kind not in READERS or not path:
            raise SystemExit(f"a source is KIND=PATH with KIND one of {', '.join(READERS)}")
        out.append((kind, path, {}))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglattice", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="run all recipes and correlations over some sources")
    c = sub.add_parser("case", help="persistent cases")
    d = sub.add_parser("decode", help="find encoded strings in a text")
    w = sub.add_parser("detect", help="what kind of source each file of a folder is")
    w.add_argument("path")
    r = sub.add_parser("report", help="a report of some detections by level, tactic and time")
    r.add_argument("path")
    r.add_argument("--out")
    for x in (a, c):
        x.add_argument("--source", action="append", default=[], metavar="KIND=PATH")
        x.add_argument("--folder", action="append", default=[], metavar="PATH", help="files whose kind is told by name and content")
        x.add_argument("--infra", action="append", default=[], metavar="IP")
        x.add_argument("--format", choices=("json", "markdown", "html"), default="json")
        x.add_argument("--level", choices=("full", "detailed", "summary"), default="full")
        x.add_argument("--out")
        x.add_argument("--attack", metavar="FILE", help="STIX bundle with the full ATT&CK table")
    c.add_argument("action", choices=("new", "add", "list", "show", "analyze", "diff", "document", "infra", "note", "rebuild", "vacuum", "rm"))
    c.add_argument("case", nargs="?")
    c.add_argument("text", nargs="?", help="a title, a note, or the case to compare with")
    c.add_argument("--root", default="cases")
    c.add_argument("--force", action="store_true")
    d.add_argument("text")
    return p


def _render(tables: dict, fmt: str, level: str) -> str:
    rows, counts = cases.collect_counted(tables)
    if fmt == "json":
        return json.dumps(cases.bundle(rows, level, counts), indent=1, default=str)
    body = cases.bundle(rows, level)["analysis"]
    body = {k: v for k, v in body.items() if isinstance(v, list)}
    return cases.markdown(body) if fmt == "markdown" else cases.html_report(body)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    text = ""
    if args.command == "decode":
        text = json.dumps(decode.scan(args.text), indent=1)
    elif args.command == "detect":
        text = json.dumps({r.path: r.kind for r in detect(session(), args.path).collect()}, indent=1)
    elif args.command == "report":
        found = derive(build_events(session(), [("evtx", args.path, {})]))
        text = slice_report(found, args.path.rpartition("/")[2], datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC"))
    elif args.command == "analyze":
        from loglattice.analyze import analyze

        errors: list[tuple[str, str]] = []
        sources = _sources(args.source)
        for path in args.folder:
            taken, left = routed(session(), path)
            sources += taken
            errors += [(p, f"no reader for {kind or 'this content'}") for p, kind in left]
        raw = build_events(session(), sources, errors)
        for path, why in errors:
            print(f"{path}: {why}", file=sys.stderr)
        if raw is None:
            return 1
        table = attack.load_table(args.attack) if args.attack else None
        text = _render(analyze(derive(raw, table), tuple(args.infra), techniques=table), args.format, args.level)
    elif args.action == "list":
        text = json.dumps(cases.list_cases(session(), args.root), indent=1)
    else:
        case = cases.Case(session(), args.root, args.case or "")
        if args.action == "new":
            case.create(args.text or "")
        elif args.action == "add":
            sources = _sources(args.source) + [s for path in args.folder for s in routed(case.spark, path)[0]]
            text = str(sum(case.append_source(kind, path, args.force, **options) for kind, path, options in sources))
        elif args.action == "show":
            text = json.dumps(case.meta, indent=1)
        elif args.action == "diff":
            other = cases.Case(case.spark, args.root, args.text or "")
            found = {k: [r.asDict(True) for r in v.collect()] for k, v in delta.delta(other.analyze(), case.analyze()).items()}
            text = json.dumps({"headline": delta.headline(found), **found}, indent=1, default=str)
        elif args.action == "document":
            text = cases.document(case.meta, cases.collect(case.analyze()))
        elif args.action == "rebuild":
            text = f"{case.rebuild()} batch(es) rebuilt"
        elif args.action == "vacuum":
            text = f"{len(case.vacuum())} batch(es) deleted"
        elif args.action == "infra":
            case.set_infrastructure(args.infra)
        elif args.action == "note":
            case.note(args.text or "")
        elif args.action == "rm":
            case.delete()
        else:
            text = _render(case.analyze(attack.load_table(args.attack) if args.attack else None), args.format, args.level)
    if getattr(args, "out", None):
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    elif text:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
