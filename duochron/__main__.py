"""The command line: ``python -m duochron fit|check``; exit code 0 for a converged fit, 2 for one that isn't, 1 for an error."""

from __future__ import annotations

import argparse
import json
import sys

from .config import ConfigError, load_config, merged
from .plans.parameters import LAYOUTS, REGISTRY
from .plans.solve import LOSSES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="duochron", description="Two-time correlation analytics on Spark")
    p.add_argument("--master", help="Spark master; that of the environment without it")
    commands = p.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="load, preprocess and fit")
    fit.add_argument("source", help="NPZ archive, HDF5 file or Parquet data set")
    fit.add_argument("--config", help="YAML or JSON file")
    fit.add_argument("--output", help="folder for parameters, summary and fitted cells")
    fit.add_argument("--cache", help="Parquet data set to read through")
    fit.add_argument("--mode", help="analysis mode")
    fit.add_argument("--phi", nargs="+", type=float, help="keep the angles nearest to these")
    fit.add_argument("--per-angle-mode", choices=LAYOUTS)
    fit.add_argument("--loss", choices=LOSSES)
    fit.add_argument("--max-iterations", type=int)
    starts = fit.add_mutually_exclusive_group()
    starts.add_argument("--multistart", action="store_true")
    starts.add_argument("--cmaes", action="store_true")
    fit.add_argument("--multistart-n", type=int)
    fit.add_argument("--initial", nargs=2, action="append", default=[], metavar=("NAME", "VALUE"), help=f"start of a parameter: {', '.join(REGISTRY)}")
    check = commands.add_parser("check", help="check a configuration")
    check.add_argument("config")
    return p


def settings(args: argparse.Namespace) -> dict:
    """The configuration that a command line means: its file, and over it what was given."""
    own = load_config(args.config or {})
    o: dict = {"multi_start": {}, "cmaes": {}}
    for key in ("per_angle_mode", "loss", "max_iterations"):
        if getattr(args, key) is not None:
            o[key] = getattr(args, key)
    if args.multistart:
        o["multi_start"]["enable"] = True
    if args.multistart_n is not None:
        o["multi_start"]["n_starts"] = args.multistart_n
    if args.cmaes:
        o["cmaes"]["enable"] = True
    given: dict = {"optimization": o, "initial_parameters": {k: float(v) for k, v in args.initial}}
    if args.mode:
        given["analysis_mode"] = args.mode
    return load_config(merged(given, own))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "check":
            load_config(args.config)
            print("sound")
            return 0
        config = settings(args)
    except (ConfigError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1

    from pyspark.sql import SparkSession

    from . import api
    from .operators.filters import subset_by_request
    from .schema import Dataset
    from .sources.files import json_safe, write_result

    builder = SparkSession.builder.appName("duochron")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    d = api.load_data(spark, args.source, config, args.cache)
    if args.phi:
        angle = subset_by_request(d.angle, spark.createDataFrame([(x,) for x in args.phi], "want double"))
        d = Dataset(d.c2.join(angle.select("angle_idx"), "angle_idx", "left_semi"), angle, d.frame, d.dt, d.length)
    result, names = api.fit(spark, d, config)
    if args.output:
        write_result(spark, result, names, d.c2, args.output)
    values = dict(zip(names, result.parameters.tolist()))
    print(json.dumps(json_safe({"status": result.status, "chi_squared": result.chi_squared, "reduced_chi_squared": result.reduced_chi_squared, "iterations": result.iterations, "parameters": values})))
    return 0 if result.converged else 2


if __name__ == "__main__":
    sys.exit(main())
