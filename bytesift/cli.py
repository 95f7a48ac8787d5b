"""Command line: python -m bytesift.cli [--perf-report FILE] [local] COMMAND ...; without a command, `--rule R PATH...` scans."""

from __future__ import annotations

import argparse
import json
import sys
import time

from bytesift.plans.policy import Policy


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytesift")
    sub = p.add_subparsers(dest="command", required=True)
    grams = lambda t: tuple(int(x) for x in t.split(","))

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if "root" in names:
            c.add_argument("--root", required=True, help="a table, or several with commas between")
        if "rule" in names:
            c.add_argument("--rule", required=True)
        return c

    c = command("init", "root")
    c.add_argument("--shards", type=int, default=8)
    c.add_argument("--tier1-set-fp", type=float, default=0.4)
    c.add_argument("--tier2-set-fp", type=float, default=0.25)
    c.add_argument("--id-source", default="sha256", choices=["sha256", "md5", "sha1", "sha512"])
    c.add_argument("--gram-sizes", type=grams, default=(3, 4))
    c.add_argument("--store-path", action="store_true")
    c.add_argument("--compaction-idle-cooldown-s", type=float, default=5.0)
    c.add_argument("--dedup-min-docs", type=int, default=1000)
    c.add_argument("--force", action="store_true")
    c = command("index", "root")
    c.add_argument("--path-list", action="store_true")
    c.add_argument("paths", nargs="+")
    c = command("delete", "root")
    c.add_argument("values", nargs="+")
    c = command("rule-check", "rule")
    c.add_argument("--root")
    c.add_argument("--id-source")
    c.add_argument("--gram-sizes", type=grams, default=(3, 4))
    c.add_argument("--max-anchors-per-pattern", type=int, default=16)
    c.add_argument("--json", action="store_true")
    c = command("search", "root", "rule")
    c.add_argument("--max-anchors-per-pattern", type=int, default=16)
    c.add_argument("--max-candidates", type=float, default=10.0, help="percent of live documents; 0: all")
    c.add_argument("--verify", action="store_true")
    command("info", "root")
    c = command("scan", "rule")
    c.add_argument("paths", nargs="+")
    c.add_argument("--tag", help="only rules with this tag")
    c.add_argument("--timeout", type=float, help="seconds after which the scan is cancelled")
    command("compact", "root").add_argument("--force", action="store_true")
    command("dedup", "root").add_argument("--force", action="store_true")
    return p


def scan(spark, hits, timeout: float | None, out) -> int:
    """Prints hits as they come. After `timeout` seconds the jobs of the scan are cancelled, and the code is 2."""
    from threading import Timer

    job, late = f"scan-{id(hits)}", []

    def stop() -> None:
        late.append(True)
        spark.sparkContext.cancelJobsWithTag(job)

    clock = Timer(timeout, stop) if timeout else None
    spark.sparkContext.addJobTag(job)
    try:
        if clock:
            clock.start()
        for r in hits.toLocalIterator():
            print(f"{r.rule} {r.external_id}", file=out)
    except Exception:
        if not late:
            raise
        print(f"the scan was cancelled after {timeout:g} s", file=sys.stderr)
        return 2
    finally:
        if clock:
            clock.cancel()
        spark.sparkContext.removeJobTag(job)
    return 0


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("bytesift").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def rule_check(args, out) -> int:
    from bytesift.engine import Engine, load_rules
    from bytesift.plans.check import check_source

    source = load_rules(args.rule)
    policy = Engine(session(), args.root.split(",")).policy() if args.root else Policy(id_source=args.id_source or "sha256", grams=args.gram_sizes)
    report = check_source(source, policy, id_source_known=bool(args.root or args.id_source))
    if args.json:
        print(report.to_json(), file=out)
    else:
        print(f"status: {report.status}", file=out)
        for i in report.issues:
            where = f" at {i.line}:{i.column}" if i.line else ""
            print(f"{i.severity}: {i.code}{where}: {i.message}" + (f" ({i.remediation})" if i.remediation else ""), file=out)
    return int(report.status == "unsupported")


def main(argv: list[str] | None = None, out=None) -> int:
    """Runs a command; 1 if a rule can't be used."""
    from bytesift.plans.errors import RuleError

    out = out or sys.stdout
    argv = list(sys.argv[1:] if argv is None else argv)
    report = None
    if argv[:1] == ["--perf-report"] and len(argv) > 1:
        report, argv = argv[1], argv[2:]
    if argv[:1] == ["local"]:  # all tables are local to the session
        argv = argv[1:]
    if argv[:1] == ["--rule"]:
        argv = ["scan", *argv]
    args = parser().parse_args(argv)
    began, code = time.perf_counter(), 1
    try:
        code = _run(args, out)
    except (RuleError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
    if report:
        with open(report, "w", encoding="utf-8") as f:
            json.dump({"command": args.command, "seconds": round(time.perf_counter() - began, 6), "exit": code}, f)
    return code


def _run(args, out) -> int:
    if args.command == "rule-check":
        return rule_check(args, out)
    from bytesift.engine import Engine, load_rules
    from bytesift.operators import search
    from bytesift.sources.files import expand_inputs, scan_files

    spark = session()
    if args.command == "scan":
        return scan(spark, Engine(spark, []).scan(load_rules(args.rule), args.paths, args.tag), args.timeout, out)
    engine = Engine(spark, args.root.split(","))
    if args.command == "init":
        engine.init(Policy(args.id_source, args.store_path, args.gram_sizes, args.tier1_set_fp, args.tier2_set_fp, args.shards, dedup_min_docs=args.dedup_min_docs, compaction_cooldown_s=args.compaction_idle_cooldown_s), args.force)
    elif args.command == "index":
        for r in engine.ingest(expand_inputs(spark, args.paths, args.path_list)).groupBy("status").count().toLocalIterator():
            print(f"{r['status']}: {r['count']}", file=out)
    elif args.command == "delete":
        for r in engine.delete(args.values).toLocalIterator():
            print(f"{r.identity_hex}: {r.status}", file=out)
    elif args.command == "info":
        for r in engine.info().toJSON().toLocalIterator():
            print(r, file=out)
    elif args.command in ("compact", "dedup"):
        for r in getattr(engine, args.command)(args.force):
            print(json.dumps(r), file=out)
    else:
        _search(engine, args, out, search, scan_files)
    return 0


def _search(engine, args, out, search, scan_files) -> None:
    from bytesift.engine import load_rules
    from bytesift.plans.resolve import compile_source
    from pyspark.sql import functions as F

    queries = compile_source(load_rules(args.rule))
    result = engine.search(load_rules(args.rule), search.Options(args.max_candidates, args.max_anchors_per_pattern))
    hits = result.hits.persist()
    if args.verify:
        paths = [r[0] for r in hits.select("external_id").distinct().filter("external_id IS NOT NULL").collect()]  # the command line's own output
        there = [p for p in paths if engine.store.fs.exists(engine.store.path(p))]
        contents = scan_files(engine.spark, there).select(F.col("path").alias("external_id"), "content")
        hits = search.verify(hits, contents, queries).persist()
    summary = {r.rule: r for r in result.summary.collect()}
    counts = {r.rule: r for r in search.verified_counts(hits).collect()} if args.verify else {}
    for q in queries:
        s = summary.get(q.name)
        print(f"rule: {q.name}\ntier_used: {result.tiers[q.name]}\ncandidates: {s.candidates if s else 0}\ntruncated: {str(bool(s and s.truncated)).lower()}", file=out)
        if s and s.truncated:
            print(f"truncated_limit: {s.truncated_limit}", file=out)
        if args.verify:
            c = counts.get(q.name)
            print(f"verified_checked: {c.checked if c else 0}\nverified_matched: {c.matched if c else 0}\nverified_skipped: {c.skipped if c else 0}", file=out)
        own = hits.filter(F.col("rule") == q.name)
        for r in (search.display_order(own) if args.verify else own).toLocalIterator():
            print(f"{r.identity_hex} {r.external_id or ''}".rstrip(), file=out)


if __name__ == "__main__":
    sys.exit(main())
