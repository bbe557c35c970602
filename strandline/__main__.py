"""Command line: stages of a sample's run.

    python -m strandline run --config sample.json --folder OUT [--stage NAME]
    python -m strandline queries
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from strandline.plans.sample import Inputs, Run, Settings

STAGES = ("arms", "sites", "chunked_segments", "allelic_clusters", "bins", "coverage_segments", "segment_counts", "allelic_ratios", "optimal_fit", "segments")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a sample, or up to one stage of it")
    run.add_argument("--config", required=True, help="JSON with inputs and settings")
    run.add_argument("--folder", required=True, help="where stages are written")
    run.add_argument("--stage", choices=STAGES, default="segments")
    run.add_argument("--export", help="folder for the tab-separated segments")
    commands.add_parser("queries", help="list the registered queries")
    given = parser.parse_args(arguments)
    if given.command == "queries":
        from strandline.plans import catalog

        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    config = json.loads("\n".join(r.value for r in spark.read.text(given.config).collect()))
    done = Run(spark, Inputs(**config["inputs"]), given.folder, Settings(**config.get("settings", {})))
    getattr(done, given.stage)()
    if given.export:
        done.export(given.export)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
