"""`spark-submit` entry: run the report of a specification file, write it, and tell how much of the log was left out.

    python -m logloom SPEC.json [csv|parquet|json]
"""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from logloom.sinks import FORMATS, write_report
from logloom.sources.watch import Watch


def load_definition(path: str) -> dict[str, Any]:
    """A specification from a JSON file in UTF-8 (with or without BOM) or windows-1251."""
    with open(path, "rb") as file:
        content = file.read()
    try:
        return json.loads(content.decode("utf-8-sig"))
    except UnicodeDecodeError:
        return json.loads(content.decode("cp1251"))


def main(arguments: list[str]) -> int:
    if not 1 <= len(arguments) <= 2 or (len(arguments) == 2 and arguments[1] not in FORMATS):
        print(__doc__, file=sys.stderr)
        return 2
    definition = load_definition(arguments[0])
    spark = SparkSession.builder.appName("logloom report").getOrCreate()
    watch = Watch()
    print(write_report(spark, definition, *arguments[1:], watch=watch))
    print(", ".join(f"{name} {n}" for name, n in watch.counts().items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
