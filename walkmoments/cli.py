"""delta-delete: moment changes of edge deletions from an edge-list file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.deltas import MomentDeltaCalculator
from .sources.files import read_edges, write_deltas


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="walkmoments")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("delta-delete", help="exact moment changes of deleting edges")
    one.add_argument("--edge-list", required=True)
    one.add_argument("--num-nodes", type=int, required=True)
    one.add_argument("--candidates")
    one.add_argument("--orders", type=int, nargs="+", default=[2, 3])
    one.add_argument("--backend", choices=["topology", "low_rank"], default="low_rank")
    one.add_argument("--output", required=True)
    return top


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("walkmoments").getOrCreate()
    graph = MomentDeltaCalculator.from_undirected_edges(read_edges(spark, given.edge_list), given.num_nodes)
    chosen = read_edges(spark, given.candidates) if given.candidates else None
    count = write_deltas(graph.deletion_deltas(chosen, orders=given.orders, backend=given.backend), given.output)
    print(f"{count} rows written to {given.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
