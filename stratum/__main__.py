"""python -m stratum QUERY TABLES OUT: runs a registered query over a folder of tables and writes Parquet; without arguments, the names."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from stratum import catalog

    if len(args) != 3 or args[0] not in catalog.QUERIES:
        print(__doc__, *sorted(catalog.QUERIES), sep="\n")
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"stratum {args[0]}").getOrCreate()
    catalog.QUERIES[args[0]](spark, args[1]).write.parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
