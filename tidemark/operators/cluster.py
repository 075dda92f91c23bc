"""Cluster state as a table: merging, failure detection, digests and ring changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heartbeat interval, and how many intervals of silence make a node suspect or down. Fixed values.
INTERVAL, SUSPECT_AFTER, DOWN_AFTER = 2, 2, 5
#: Levels of the Merkle tree that one task folds, and the leaves under them.
LEVELS = 12
BLOCK = 1 << LEVELS


def latest(states: DataFrame, key: str, newest: tuple[str, ...]) -> DataFrame:
    """Of each ``key`` the row that is newest by ``newest``."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_s")).select(key, "_s.*")


def merged(local: DataFrame, received: DataFrame, sender: str, now: int) -> DataFrame:
    """Local node rows after a state from ``sender``: the newer heartbeat of each node wins, and the sender is active now.

    An equal heartbeat leaves the local row. A known node keeps its port, of which heartbeats tell nothing. A sender
    that neither side knows adds no row.
    """
    theirs = received.select("id", *[F.col(c).alias(f"_{c}") for c in received.columns if c != "id"])
    both = local.join(theirs, "id", "full_outer")
    newer = F.col("last_heartbeat").isNull() | (F.col("_last_heartbeat") > F.col("last_heartbeat"))
    chosen = {c: F.when(newer, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("address", "last_heartbeat", "status")}
    chosen["http_port"] = F.coalesce("http_port", "_http_port")
    told = {"last_heartbeat": F.lit(now).cast("long"), "status": F.lit("active")}
    return both.select("id", *[(F.when(F.col("id") == sender, told[c]).otherwise(x) if c in told else x).alias(c) for c, x in chosen.items()]).select(*local.columns)


def detected(nodes: DataFrame, now: int) -> DataFrame:
    """Status by age of the last heartbeat: down after 5 silent intervals, an active node suspect after 2."""
    age = F.lit(now) - F.col("last_heartbeat")
    status = F.when(age > DOWN_AFTER * INTERVAL, "down").when((age > SUSPECT_AFTER * INTERVAL) & (F.col("status") == "active"), "suspect").otherwise(F.col("status"))
    return nodes.withColumn("status", status)


def active(nodes: DataFrame) -> DataFrame:
    """Active storage nodes; routers keep no data."""
    return nodes.where((F.col("status") == "active") & ~F.col("id").startswith("router"))


def ring_changes(nodes: DataFrame, ring: DataFrame) -> DataFrame:
    """(id, change): ``add`` for active nodes that aren't on the ring, ``remove`` for down nodes that are.

    A suspect node stays; so does a node of the ring that the state doesn't know.
    """
    on = ring.select(F.col("id"), F.lit(True).alias("_on"))
    both = nodes.join(on, "id", "full_outer")
    change = F.when((F.col("status") == "active") & F.col("_on").isNull(), "add").when((F.col("status") == "down") & F.col("_on"), "remove")
    return both.select("id", change.alias("change")).where(F.col("change").isNotNull())


def leaves(nodes: DataFrame) -> DataFrame:
    """(id, hash): SHA-256 of ``id|address|status|port``."""
    return nodes.select("id", F.sha2(F.concat_ws("|", "id", "address", "status", F.col("http_port").cast("string")), 256).alias("hash"))


def merkle_root(nodes: DataFrame) -> DataFrame:
    """One row (root): leaves in order of id, hashed in pairs level by level; an odd last one is carried up.

    Without nodes the root is the hash of the word ``empty``. The nodes are counted: up to ``BLOCK`` are gathered and
    folded in one task; more are numbered in order of id, and aligned blocks of ``BLOCK``, which are subtrees, are
    folded apart, and their roots again, until one block is left.
    """
    level = leaves(nodes)
    left = level.count()
    if left > BLOCK:
        numbered = level.orderBy("id", "hash").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["hash"]))
        level = nodes.sparkSession.createDataFrame(numbered, "id long, hash string")
    while left > BLOCK:
        level = _folded(level.groupBy(F.shiftright("id", LEVELS).alias("id")).agg(_in_order())).select("id", F.get("level", F.lit(0)).alias("hash"))
        left = -(-left // BLOCK)
    return _folded(level.agg(_in_order())).select(F.coalesce(F.get("level", F.lit(0)), F.sha2(F.lit("empty"), 256)).alias("root"))


def _in_order() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("id", "hash"))), lambda s: s["hash"]).alias("level")


def _folded(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the at most ``BLOCK`` hashes of ``level`` folded to one."""
    keys = [c for c in blocks.columns if c != "level"]
    for _ in range(LEVELS):
        pair = lambda i: F.when(F.get("level", 2 * i + 1).isNull(), F.get("level", 2 * i)).otherwise(F.sha2(F.concat(F.get("level", 2 * i), F.get("level", 2 * i + 1)), 256))
        nxt = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("level") + 1) / 2) - 1, F.lit(0)).cast("int")), pair)
        blocks = blocks.select(*keys, F.when(F.size("level") > 1, nxt).otherwise(F.col("level")).alias("level"))
    return blocks
