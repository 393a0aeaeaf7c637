"""python -m assayer REPORT --input value ...: runs one report of assayer.drivers; options are its parameters."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from assayer.drivers import DRIVERS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m assayer", description="Reports over tables.")
    reports = out.add_subparsers(dest="report", required=True)
    for name, f in DRIVERS.items():
        own = reports.add_parser(name, help=(f.__doc__ or "").split("\n")[0], description=f.__doc__)
        for p in list(inspect.signature(f).parameters.values())[1:]:
            if p.default is p.empty:
                own.add_argument(f"--{p.name}", required=True)
            elif isinstance(p.default, tuple):
                own.add_argument(f"--{p.name}", nargs="*", default=list(p.default))
            else:
                own.add_argument(f"--{p.name}", type=type(p.default), default=p.default)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    report = DRIVERS[options.pop("report")]
    report(spark or SparkSession.builder.appName("assayer").getOrCreate(), **options)


if __name__ == "__main__":
    main()
