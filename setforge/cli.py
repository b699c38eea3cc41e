"""Command line: build, cache import, cache scan, cache build, fetch, perf, flamegraph. Exit codes: 0 done, 2 strict and missing, 1 any error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from setforge import api
from setforge.errors import SetforgeError
from setforge.operators import fetch, profile
from setforge.plans import planner
from setforge.sources import profiles


#: What a manifest says about the evidence that sources must have.
POLICY = {"metadata": "the licence in the metadata is a public domain mark or CC0", "curated": "title, description or subject say so", "excluded": "names of commercial games"}


def default_cache(given: str | None = None, env: dict | None = None) -> str:
    """The given path, else below XDG_CACHE_HOME, else below HOME, else in the working folder."""
    env = os.environ if env is None else env
    if given:
        return given
    if env.get("XDG_CACHE_HOME"):
        return os.path.join(env["XDG_CACHE_HOME"], "setforge", "store")
    if env.get("HOME"):
        return os.path.join(env["HOME"], ".cache", "setforge", "store")
    return "setforge-store"


def exit_code(code: int) -> int:
    return code if code in (0, 2) else 1


def _count(given: str) -> int:
    if not given.isdecimal():
        raise argparse.ArgumentTypeError(f"{given!r} is no number of 0 or more")
    return int(given)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="setforge")
    p.add_argument("--cache", default=os.environ.get("SETFORGE_CACHE"))
    sub = p.add_subparsers(dest="command", required=True)

    def plan(q: argparse.ArgumentParser) -> None:
        q.add_argument("dat")
        q.add_argument("source")
        q.add_argument("destination")
        q.add_argument("-j", "--jobs", type=_count, default=0, help="cores in local mode; 0 takes all")
        q.add_argument("--layout", choices=(planner.PARENT_BUNDLES, planner.PER_GAME), default=planner.PARENT_BUNDLES)
        q.add_argument("--compression", choices=("deflate", "store"), default="deflate")
        q.add_argument("--missing", choices=("allow", "fail"), default="allow")
        q.add_argument("--dry-run", action="store_true")

    plan(sub.add_parser("build"))
    cache = sub.add_parser("cache").add_subparsers(dest="step", required=True)
    cache.add_parser("import").add_argument("dat")
    scan = cache.add_parser("scan")
    scan.add_argument("source")
    scan.add_argument("-j", "--jobs", type=_count, default=0)
    plan(cache.add_parser("build"))
    get = sub.add_parser("fetch", help="a catalogue of downloaded public sources, and its bundles")
    get.add_argument("listed", help="file of sources, with pipes")
    get.add_argument("metadata", help="folder of their metadata documents")
    get.add_argument("downloads", help="folder of their files")
    get.add_argument("--work-dir", default="public-sources")
    get.add_argument("--max-roms", type=_count, default=fetch.MAX_ROMS, help="0: all")
    get.add_argument("--catalog-tier", choices=("metadata", "curated"), default="curated")
    get.add_argument("-j", "--jobs", type=_count, default=0)
    get.add_argument("--layout", choices=(planner.PARENT_BUNDLES, planner.PER_GAME), default=planner.PARENT_BUNDLES)
    get.add_argument("--dry-run", action="store_true")
    get.add_argument("--skip-run", action="store_true", help="make the catalogue only")
    get.add_argument("--refresh", action="store_true", help="prepare the sources anew")
    sub.add_parser("perf").add_argument("path")
    flame = sub.add_parser("flamegraph")
    flame.add_argument("path")
    kind = flame.add_subparsers(dest="report")
    top = kind.add_parser("top")
    top.add_argument("n", type=int, nargs="?", default=30)
    top.add_argument("min_pct", type=float, nargs="?", default=1.0)
    kind.add_parser("search").add_argument("pattern")
    kind.add_parser("syscalls")
    kind.add_parser("summary")
    kind.add_parser("diff").add_argument("after")
    return p


def _show(title: str, df: DataFrame) -> None:
    print(f"== {title}")
    df.show(1000, truncate=False)


def perf_reports(samples: DataFrame) -> dict[str, DataFrame]:
    leaf = profile.with_leaf(samples)
    return {
        "threads": profile.thread_breakdown(samples).orderBy("n", ascending=False),
        "functions": profile.top_functions(leaf),
        "functions by thread": profile.top_functions_per_thread(leaf),
        "edges": profile.callee_edges(samples),
        "timeline": profile.timeline(leaf, "time", "function").orderBy("bucket"),
        "categories": profile.category_counts(leaf),
    }


def flame_report(frames: DataFrame, args: argparse.Namespace) -> DataFrame:
    match args.report:
        case "search":
            return profile.frame_search(frames, args.pattern)
        case "syscalls":
            return profile.frame_syscalls(frames)
        case "summary":
            return profile.category_percents(frames)
        case "diff":
            return profile.ranked_diff(profile.frame_diff(frames, profiles.read_frames(frames.sparkSession, args.after)))
    return profile.frame_top(frames, getattr(args, "n", 30), getattr(args, "min_pct", 1.0))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("setforge").config("spark.sql.session.timeZone", "UTC")
        if getattr(args, "jobs", 0):
            builder = builder.master(f"local[{args.jobs}]")
        spark = builder.getOrCreate()
    try:
        if args.command == "perf":
            samples = profiles.read_samples(spark, args.path).cache()
            if samples.isEmpty():
                print("no samples", file=sys.stderr)
                return 1
            for title, df in perf_reports(samples).items():
                _show(title, df)
            return 0
        if args.command == "flamegraph":
            _show(args.report or "top", flame_report(profiles.read_frames(spark, args.path), args))
            return 0
        if args.command == "fetch":
            n = fetch.gather(spark, args.listed, args.metadata, args.downloads, args.work_dir, POLICY, args.catalog_tier, args.max_roms, args.refresh)
            print(f"{n} games in {os.path.join(args.work_dir, 'catalogue.dat')}")
            if args.skip_run:
                return 0
            store = api.open_store(spark, os.path.join(args.work_dir, "store"))
            where = [os.path.join(args.work_dir, x) for x in ("catalogue.dat", "sources", "out")]
            report = api.run(store, *where, layout=args.layout, strict=True, dry_run=args.dry_run)
            print(f"matched {report.matched}, missing {report.missing}, bundles {report.bundles}, written {report.written}")
            return exit_code(report.exit_code)
        store = api.open_store(spark, default_cache(args.cache))
        if args.command == "cache" and args.step == "import":
            print(api.import_dat(store, args.dat))
            return 0
        if args.command == "cache" and args.step == "scan":
            print(*api.scan_source(store, args.source))
            return 0
        work = api.run if args.command == "build" else api.build
        report = work(store, args.dat, args.source, args.destination, layout=args.layout, compression=args.compression, strict=args.missing == "fail", dry_run=args.dry_run)
        print(f"matched {report.matched}, missing {report.missing}, bundles {report.bundles}, written {report.written}")
        return exit_code(report.exit_code)
    except SetforgeError as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # an error inside a task comes wrapped
        print(str(e)[:2000], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
