"""python -m tessera [--in-mem | --on-disk] [--data FOLDER] [--store FOLDER]: statements from standard input, rows to standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .session import Engine

parser = argparse.ArgumentParser()
parser.add_argument("--in-mem", action="store_true", help="prefer hash joins (the default)")
parser.add_argument("--on-disk", action="store_true", help="prefer joins of sorted runs")
parser.add_argument("--data", default="data")
parser.add_argument("--store")
args = parser.parse_args()
spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
Engine(spark, args.data, args.store, in_memory=args.in_mem or not args.on_disk).repl(sys.stdin, sys.stdout)
