"""python -m lattice (-f | -l | -s) [FOLDER]: the devices of a catalog, ``FOLDER``/platforms and /devices as Parquet, or the built-in one."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lattice.operators import catalog
from lattice.plans import fixtures


def listing(spark: SparkSession, verbosity: int, folder: str | None = None) -> DataFrame:
    read = lambda name, made: spark.read.parquet(f"{folder}/{name}") if folder else made(spark)
    return catalog.platform_listing(read("platforms", fixtures.platforms), read("devices", fixtures.devices), verbosity)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattice", description=__doc__)
    kinds = parser.add_mutually_exclusive_group(required=True)
    kinds.add_argument("-f", "--full-list", dest="verbosity", action="store_const", const=2, help="every device of every platform")
    kinds.add_argument("-l", "--long-list", dest="verbosity", action="store_const", const=1, help="platforms with their counts")
    kinds.add_argument("-s", "--summary", dest="verbosity", action="store_const", const=0, help="names of platforms")
    parser.add_argument("folder", nargs="?")
    given = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    listing(spark, given.verbosity, given.folder).show(truncate=False)


if __name__ == "__main__":
    main()
