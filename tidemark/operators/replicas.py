"""Copies of series on several nodes: placement, answers by quorum, differences and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.murmur import murmur3_of
from ..schema import ARRIVAL, SERIES
from .table import checksum

#: Places of each node on the ring, and equal stretches that the ring is cut into for lookups.
VIRTUAL_NODES, STRETCH_BITS = 150, 12


def ring_places(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(place, node): where each node's virtual nodes hash to; of places that collide the later node's counts."""
    given = spark.createDataFrame(list(enumerate(nodes)), "turn int, node string")
    named = given.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    placed = named.withColumn("place", murmur3_of(F.concat_ws("#", "node", "i")))
    return placed.groupBy("place").agg(F.max_by("node", F.struct("turn", "i")).alias("node"))


def stretches(spark: SparkSession, nodes: list[str], n: int, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(stretch, after, upto, owners): keys that hash above ``after`` and up to ``upto`` have these ``n`` owners.

    The owners are the first different nodes clockwise from the first place not before the hash. Every row lies in one
    of 4,096 stretches of the ring, so that a key finds its row by an equality and a comparison. The table has a row for
    each place and stretch at most, whatever the number of keys.
    """
    places = sorted((r.place, r.node) for r in ring_places(spark, nodes, virtual).collect())  # 150 for each node
    owners: list[str] = []
    rows = []
    for place, node in [*places, *places][::-1]:  # twice round, backwards: the first round ends with full lists
        owners = [node, *[x for x in owners if x != node]][:n]
        rows.append((place, owners))
    rows = rows[len(places) :][::-1]
    lows = [-1, *[p for p, _ in rows]]
    parts = [(lows[i], p, own) for i, (p, own) in enumerate(rows)]
    if rows:
        parts.append((lows[-1], (1 << 32) - 1, rows[0][1]))  # beyond the last place the first one follows
    table = spark.createDataFrame(parts, "after long, upto long, owners array<string>").where("after < upto")
    shift = 32 - STRETCH_BITS
    spread = F.explode(F.sequence(F.shiftright(F.col("after") + 1, shift), F.shiftright("upto", shift)))
    return table.withColumn("stretch", spread)


def placement(keys: DataFrame, nodes: list[str], n: int) -> DataFrame:
    """``keys`` (series_key and further columns) with owners, the ``n`` nodes that hold each, in order.

    A lookup by range on the ring: its table, bounded by nodes and stretches, is broadcast.
    """
    ring = F.broadcast(stretches(keys.sparkSession, nodes, n))
    hashed = keys.withColumn("_hash", murmur3_of(F.col("series_key"))).withColumn("stretch", F.shiftright("_hash", 32 - STRETCH_BITS))
    found = hashed.join(ring, "stretch").where((F.col("_hash") > F.col("after")) & (F.col("_hash") <= F.col("upto")))
    return found.select(*keys.columns, "owners")


def best_count(stats: DataFrame, quorum: int = 1) -> DataFrame:
    """Of each series' answers (node, sum, count, min, max) the one with the largest count, ties to the smaller node.

    Series with fewer than ``quorum`` answers are left out.
    """
    answer = F.struct("node", "sum", "count", "min", "max")
    best = stats.groupBy(*SERIES).agg(F.min_by(answer, F.struct(-F.col("count"), F.col("node"))).alias("best"), F.count_distinct("node").alias("answers"))
    return best.where(F.col("answers") >= quorum).select(*SERIES, "best.*", "answers")


def merge_samples(samples: DataFrame) -> DataFrame:
    """Samples of all nodes (priority, seq, timestamp, value), each time once: the value of the first node by priority.

    Of a node's values of one second the first to arrive counts.
    """
    return samples.groupBy(*SERIES, "timestamp").agg(F.min_by("value", F.struct("priority", "seq")).alias("value"))


def digest(points: DataFrame) -> DataFrame:
    """Rows and an order-free content checksum of each series."""
    return points.groupBy(*SERIES).agg(F.count("*").alias("count"), checksum().cast("string").alias("checksum"))


def differing(local: DataFrame, peer: DataFrame) -> DataFrame:
    """Series whose digests differ, with the rows of either side (0 where it is missing); ``pull`` if the peer has more."""
    a = local.select(*SERIES, F.col("count").alias("local_count"), F.col("checksum").alias("_a"))
    b = peer.select(*SERIES, F.col("count").alias("peer_count"), F.col("checksum").alias("_b"))
    both = a.join(b, SERIES, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("local_count", "peer_count")]
    return both.select(*SERIES, *counts).withColumn("pull", F.col("peer_count") > F.col("local_count"))


def missing(local: DataFrame, peer: DataFrame) -> DataFrame:
    """The peer's points that are missing locally, even if others of their second are there.

    A field that is null in both copies of an arrival is the same in both.
    """
    here = local.select(*(F.col(c).alias(f"_{c}") for c in ARRIVAL))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ARRIVAL]
    return peer.join(here, same, "left_anti").select(*peer.columns)


def repair(local: DataFrame, peer: DataFrame) -> DataFrame:
    """Local points and the peer's that were missing."""
    return local.unionByName(missing(local, peer).select(*local.columns))


def moved(keys: DataFrame, before: list[str], after: list[str], n: int) -> DataFrame:
    """Keys whose owners change with the nodes: (series_key, gained, lost)."""
    old = placement(keys.select("series_key"), before, n).withColumnRenamed("owners", "_b")
    placed = placement(old, after, n).withColumnRenamed("owners", "_a")
    changes = placed.select("series_key", F.array_except("_a", "_b").alias("gained"), F.array_except("_b", "_a").alias("lost"))
    return changes.where((F.size("gained") > 0) | (F.size("lost") > 0))
