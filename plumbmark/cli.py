"""python -m plumbmark.cli --warehouse PATH list-runs | show-run RUN_ID | refusals | stats | run PRIMITIVES | crawl"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from plumbmark.operators import audit, audited, corpus, crawl, reports
from plumbmark.session import build_session
from plumbmark.sources import drawings, primitives


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbmark")
    parser.add_argument("--warehouse", default=os.environ.get("PLUMBMARK_WAREHOUSE", "plumbmark-audit"))
    commands = parser.add_subparsers(dest="command", required=True)
    runs = commands.add_parser("list-runs")
    runs.add_argument("--limit", type=int, default=20)
    runs.add_argument("--drawing-id")
    commands.add_parser("show-run").add_argument("run_id")
    refusals = commands.add_parser("refusals")
    refusals.add_argument("--drawing-id")
    refusals.add_argument("--attempted-type")
    commands.add_parser("stats")
    commands.add_parser("run").add_argument("primitives", help="folder of saved tables of detected primitives")
    fetch = commands.add_parser("crawl")
    for name in ("--candidates", "--responses", "--samples-dir", "--provenance-dir", "--summary"):
        fetch.add_argument(name, required=True)
    fetch.add_argument("--target", type=int, default=20)
    fetch.add_argument("--categories", nargs="+", required=True)
    fetch.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = build_session("plumbmark-cli", 2, 2)
    if args.command == "crawl":
        return _crawl(spark, args)
    w = audit.Warehouse(spark, args.warehouse)
    if args.command == "run":
        found = audited.run(w, primitives.load(spark, args.primitives))
        print(*audit.as_table(found["objects"].groupBy("drawing_id", "type").count().orderBy("drawing_id", "type")), sep="\n")
        return 0
    if w.version() is None:
        print(f"no audit warehouse in {args.warehouse}", file=sys.stderr)
        return 1
    if args.command == "list-runs":
        shown = {"": audit.list_runs(w.runs(), args.limit, args.drawing_id)}
    elif args.command == "show-run":
        shown = audit.show_run(w, args.run_id)
        if shown is None:
            print(f"no run {args.run_id}", file=sys.stderr)
            return 1
    elif args.command == "refusals":
        shown = {"": audit.refusals_by_type(w.read("refusals_log"), w.runs(), args.drawing_id, args.attempted_type)}
    else:
        shown = {"runs": reports.overview(w.runs(), w.read("refusals_log"), w.read("policy_fires")), "marks": audit.tag_sums(w.counts()), "refusals": audit.top_types(w.read("refusals_log"))}
    for title, df in shown.items():
        print(*([f"# {title}"] if title else []), *audit.as_table(df), sep="\n")
    return 0


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _crawl(spark, args) -> int:
    """The saved candidates (category, pos, filename, url, license_raw, source_page_url) and responses, both Parquet; a dry run only counts licences."""
    some = spark.read.parquet(args.candidates)
    if args.dry_run:
        shown = corpus.dry_run(some.where(F.col("category").isin(args.categories)))
    else:
        history = drawings.provenance(spark, args.provenance_dir) if _exists(spark, args.provenance_dir) else None
        taken = spark.read.parquet(args.samples_dir).select("name") if _exists(spark, args.samples_dir) else None
        shown = crawl.crawl(crawl.pool(some, args.categories, args.target), spark.read.parquet(args.responses), args.samples_dir, args.provenance_dir, args.summary, history, taken)
    print(*audit.as_table(shown), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
