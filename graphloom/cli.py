"""Command lines: ``python -m graphloom.cli mine TYPE PATH MINSUP [OUT]`` and ``... convert ADJ PARTITION_FILE OUT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.miner import Miner
from .sources.readers import read_graph
from .sources.writers import CountSink, FileSink, convert_to_partitions


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = ["--" + a[1:] if a.startswith("-") and a[1:] in ("txt", "adj", "adjp", "ladjp") else a for a in (sys.argv[1:] if argv is None else argv)]
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mine")
    for kind in ("txt", "adj", "adjp", "ladjp"):
        m.add_argument(f"--{kind}", metavar="PATH")
    m.add_argument("-p", "--partition-file")
    m.add_argument("minsup", type=int)
    m.add_argument("out", nargs="?", default="-")
    m.add_argument("--max-edges", type=int)
    m.add_argument("--no-support", action="store_true")
    c = sub.add_parser("convert")
    for name in ("adj", "partition_file", "out"):
        c.add_argument(name)
    a = p.parse_args(argv)
    if a.command == "mine" and a.minsup < 1:
        print("minsup must be at least 1", file=sys.stderr)
        return 3
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "convert":
        for f in convert_to_partitions(spark, a.adj, a.partition_file, a.out):
            print(f)
        return 0
    given = [(k, getattr(a, k)) for k in ("txt", "adj", "adjp", "ladjp") if getattr(a, k)]
    if len(given) != 1:
        p.error("give one graph: -txt, -adj, -adjp or -ladjp")
    sink = CountSink() if a.out == "-" else FileSink(a.out, not a.no_support)
    miner = Miner(spark, a.max_edges).set_graph(*read_graph(spark, *given[0], a.partition_file)).set_min_support(a.minsup).set_output(sink)
    miner.run()
    for k, v in miner.report().items():
        print(f"[{k}={v}]")
    return 0


if __name__ == "__main__":
    sys.exit(main())
