"""Connected components of links, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidebar.llm.common import shared_path, write_table

#: Rounds after which a run is ended with an error; each at least halves the length of the longest chains.
MOST_ROUNDS = 100


def _turn(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges as a table in the shared folder and a mark of its rows, taken while they are written."""
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")]
    path = shared_path(edges.sparkSession, label)
    write_table(edges.observe(seen, *marks), path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), tuple(seen.get.values())


def connected(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of links (a, b).

    Alternating large and small star steps; each hooks the neighbours of a node to the smallest of them by a
    grouped minimum and a join, so no neighbourhood is gathered, and ends when the stars no longer change. Both sides of a join
    grow with the links, so neither is broadcast.
    """
    edges, mark = _turn(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    seen = None
    for _ in range(MOST_ROUNDS):
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges, mark = _turn(small.select("e.*").where("u <> v").distinct(), "star")
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
