"""``python -m quarrylens``: a whole run over captured tables, from the command line."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from . import runs
from .sources import scratch
from .sources.captures import Config


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run as the arguments say and print the totals; 0, or 1 if no target could be analysed."""
    config = Config.arguments(args)
    spark = spark or SparkSession.builder.appName("quarrylens").getOrCreate()
    base = config.captured.rstrip("/")
    held = {n.removesuffix(".parquet"): f"{base}/{n}" for n in scratch.names(spark, base)}
    if "pages" not in held:
        raise ValueError(f"no table pages in {base}")
    tables = {n: spark.read.parquet(held[n]) for n in ("pages", *runs.TABLES) if n in held}
    done = runs.run(spark, config, tables, held.get("bodies"), config.output)
    print(json.dumps(done.totals | {"documents": done.documents}, sort_keys=True))
    return 0 if done.totals["failed"] < done.totals["pages"] else 1


if __name__ == "__main__":
    sys.exit(main())
