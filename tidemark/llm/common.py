"""Helpers the corpus operators share: folds, cutting lineage, Arrow batches and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

#: Raw text bytes that one numpy pass takes; bounds a worker's arrays whatever the Arrow batch holds.
CHUNK_BYTES = 1_000_000
#: Parts that a small table is dealt into for work on whole texts.
DEALT = 16


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id gives null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """True for rows no label may be learnt from; a row without an id is never learnt from either."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(True))


class Written:
    """A table in the shared folder: it cuts lineage, outlives executors, and can be dropped when superseded."""

    def __init__(self, df: DataFrame, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = fresh_dir(self.spark, "corpus")
        df.write.option("compression", codec).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Tables written on the way to one result, dropped once that is written."""

    def __init__(self):
        self.held: list[Written] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.held.append(Written(df))
        return self.held[-1].df

    def last(self, df: DataFrame) -> Written:
        out = Written(df)
        for table in self.held:
            table.drop()
        self.held = []
        return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Written(df).df


def carried(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its further columns in one struct, and a function that unpacks them again in the old order.

    Operators add columns of their own; further columns of any name thus neither clash nor get lost.
    """
    rest = [c for c in df.columns if c not in own]
    if not rest:
        return df, lambda out: out.select(*df.columns)
    held = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_carried")
    return df.select(*[c for c in df.columns if c in own], held), lambda out: out.select(*[F.col("_carried")[c].alias(c) if c in rest else c for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder; a table of fewer than `DEALT` splits (one small file) is dealt round into so many.

    Neither the number of cores nor the ids matter, so reruns elsewhere deal alike and repeated ids are spread.
    """
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df if df.rdd.getNumPartitions() >= DEALT else df.repartition(DEALT)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Python bytes of a binary column; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes each; a longer text stands alone, whole."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct integers, by one sort."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each node's smallest known reachable index) after adding the edges (a, b)."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (jumped := root[root])).any():
            root = jumped
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), the component being its smallest node.

    ``edges`` has long columns a and b, in any order and number; null ends and loops are ignored. Each round
    hooks every node to the smallest label next to it and then jumps one pointer, so the number of rounds follows
    the logarithm of the longest path, not its length. A round's smallest labels are aggregated before the
    shuffle, so a node with very many links costs its task one row for each map task. Nodes without a link to
    another node are not returned.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    live = Written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # parents holds every contracted node and the smaller node it was contracted into
    parents: list[Written] = []
    while not live.df.isEmpty():  # every round contracts the larger end of each edge
        both = live.df.union(live.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = Written(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a"))
        # chains a -> p -> q are jumped until each contracted node points at a node that is not contracted
        while True:
            h = hook.df
            up = h.select(F.col("a").alias("p"), F.col("p").alias("q"))
            longer = h.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
            jumped = Written(longer)
            hook.drop()
            moved = not jumped.df.where("moved").isEmpty()
            hook = Written(jumped.df.select("a", "p")) if moved else jumped
            if not moved:
                break
            jumped.drop()
        h = hook.df.select("a", "p")
        parents.append(hook)
        ends = live.df.join(h, "a", "left").select(F.coalesce("p", "a").alias("x"), "b")
        ends = ends.join(h.select(F.col("a").alias("b"), F.col("p").alias("p2")), "b", "left").select("x", F.coalesce("p2", "b").alias("y"))
        nxt = Written(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        live.drop()
        live = nxt
    out = None
    for hook in reversed(parents):
        h = hook.df.select(F.col("a").alias("node"), F.col("p").alias("component"))
        if out is None:
            out = h
        else:
            later = out.select(F.col("node").alias("component"), F.col("component").alias("q"))
            out = h.join(later, "component", "left").select("node", F.coalesce("q", "component").alias("component")).union(out)
    return out if out is not None else live.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
