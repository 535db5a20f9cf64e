"""python -m linkwright [--config FILE] [--profile-only | --inference-only] [--test-limit N]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from linkwright.plans.resolve import Resolver, load_config


def main() -> None:
    parser = argparse.ArgumentParser(prog="linkwright")
    parser.add_argument("--config", "-c")
    parser.add_argument("--profile-only", action="store_true")
    parser.add_argument("--inference-only", action="store_true")
    parser.add_argument("--test-limit", type=int)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("linkwright").getOrCreate()
    config = load_config(args.config)
    resolver = Resolver(spark, config)
    if not args.inference_only:
        resolver.profile(f"{config['output']['reports_dir']}/profiling_report.json")
    if args.profile_only:
        return
    if not args.inference_only:
        print(json.dumps(resolver.train(), indent=2))
    resolver.resolve(args.test_limit)


if __name__ == "__main__":
    main()
