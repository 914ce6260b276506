"""python -m hypso [options] files"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import engine
from .options import OptionError, parse


def main(argv: list[str]) -> int:
    try:
        options = parse(argv)
    except OptionError as e:
        print(f"hypso: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("hypso").getOrCreate()
    level = options.log.upper()
    spark.sparkContext.setLogLevel({"WARNING": "WARN", "CRITICAL": "FATAL"}.get(level, level))
    for name in engine.run(spark, options)[0]:
        print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
