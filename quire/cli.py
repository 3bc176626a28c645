"""Command line: init, import, etat, mesures, reconvertir. Exit codes: 0 done, 1 refused or failed, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .operators import manifest
from .plans import jobs


def clock() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("quire")
    parser.add_argument("--corpus", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    add = commands.add_parser("import")
    add.add_argument("paths", nargs="*")
    add.add_argument("--reessayer", action="store_true")
    commands.add_parser("etat")
    commands.add_parser("mesures")
    for name in ("reconvertir", "reinitialiser"):
        commands.add_parser(name).add_argument("--oui", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command == "init":
            os.makedirs(os.path.join(args.corpus, ".corpus"), exist_ok=True)
            return 0
        root = jobs.find_root(args.corpus)
        spark = spark or SparkSession.builder.appName("quire").getOrCreate()
        if args.command == "import":
            for name, counts in jobs.import_paths(spark, root, args.paths, clock, retry=args.reessayer).items():
                print(name, " · ".join(f"{k} {n}" for k, n in sorted(counts.items())))
        elif args.command == "etat":
            jobs.sync_checklist(spark, root)
            for r in manifest.counts(jobs.documents(spark, root)).collect():
                print(manifest.STATUSES[r["status"]], r["n"])
        elif args.command == "mesures":
            print("\n".join(jobs.statistics(spark, root)))
        else:
            job = {"reconvertir": jobs.reconvert, "reinitialiser": jobs.reset}[args.command]
            print(" · ".join(f"{k} {n}" for k, n in sorted(job(spark, root, clock, dry_run=not args.oui).items())))
        return 0
    except KeyboardInterrupt:
        return 130
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
