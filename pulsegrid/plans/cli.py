"""Command line: inspect-config, estimate, generate, validate, features.  Codes: 0 fine, 2 configuration or checks failed."""

from __future__ import annotations

import argparse
import json
import sys

from pulsegrid.plans import run
from pulsegrid.sources import config as cfg


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pulsegrid").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="pulsegrid")
    p.add_argument("command", choices=["inspect-config", "json-schema", "estimate", "generate", "validate", "features"])
    p.add_argument("--config", help="YAML file, or the name of a profile")
    p.add_argument("--output", default="output")
    p.add_argument("--truth-only", action="store_true")
    p.add_argument("--scope", choices=["all", "truth"], default="all")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--changed", action="store_true", help="features: make again what changes of the stored timeline reach")
    a = p.parse_args(args)
    if a.command == "json-schema":
        print(json.dumps(cfg.json_schema(), indent=1))
        return 0
    try:
        name = a.config or "quick"
        source = name if name.endswith((".yaml", ".yml")) else cfg.profile_path(name)
        config = cfg.load(source)
        if a.command == "inspect-config":
            print(cfg.resolved(config))
            return 0
        if a.command == "estimate":
            print(json.dumps(cfg.estimate(config), indent=1))
            return 0
        home = f"{a.output.rstrip('/')}/{cfg.run_id(config)}"
        spark = spark or session()
        if a.command == "generate":
            run.generate(spark, config, a.output, a.truth_only, source)
            found = run.validate(spark, config, home, "truth" if a.truth_only else "all")
        elif a.command == "features":
            if a.changed:
                print(json.dumps(run.update_features(spark, config, home)))
            else:
                run.write_features(spark, config, home, a.overwrite)
            return 0
        else:
            found = run.validate(spark, config, home, a.scope)
    except cfg.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    ok = all(f["passed"] for f in found)
    print(home, "PASS" if ok else "FAIL", *[f["check"] for f in found if not f["passed"]])
    return 0 if ok else 2


if __name__ == "__main__":
    sys.exit(main())
