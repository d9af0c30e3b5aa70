"""Episodes along a series: stretches that a boundary row ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_episode_roles(df: DataFrame, group: str, boundary: Column, boundary_belongs: bool) -> DataFrame:
    """Rows tagged for aggregation by (key, group).

    ``group`` is the running count of boundary rows.  A boundary row ends the group
    before its own; it also belongs to its own group when boundary_belongs.  Grouping
    the tagged rows is a plain partial aggregate, with no window over an episode.
    """
    own = F.struct(F.col(group).alias("g"), F.lit(False).alias("ends"))
    end = F.struct((F.col(group) - 1).alias("g"), F.lit(True).alias("ends"))
    at_boundary = F.array(own, end) if boundary_belongs else F.array(end)
    roles = F.when(boundary, at_boundary).otherwise(F.array(own))
    tagged = df.withColumn("_role", F.explode(roles))
    return tagged.withColumn("episode", F.col("_role.g")).withColumn("ends", F.col("_role.ends")).drop("_role")


def episodes(
    df: DataFrame, keys: Sequence[str], group: str, boundary: Column, boundary_belongs: bool, own: dict[str, Column], end: dict[str, Column]
) -> DataFrame:
    """Aggregate each episode: ``own`` over its rows, ``end`` over the boundary row that closes it.

    Expressions are aggregates over columns; each sees null on the rows of the other role.
    """
    tagged = with_episode_roles(df, group, boundary, boundary_belongs)
    values = [c for c in df.columns if c not in keys]
    split = tagged.select(
        *keys,
        "episode",
        *[F.when(~F.col("ends"), F.col(c)).alias(c) for c in values],
        *[F.when(F.col("ends"), F.col(c)).alias(f"end_{c}") for c in values],
    )
    named = [e.alias(n) for n, e in (own | end).items()]
    return split.groupBy(*keys, "episode").agg(F.count("ts").alias("rows"), *named).where(F.col("rows") > 0)
