"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors

#: Single-precision products this far from the bound are decided; closer ones are computed again in double.
ROUNDING = 1e-5
#: Lengths of vectors that get pivots of their own; pivots, besides its own, to which a cell's distances are known.
LENGTHS, COMPARED = 16, 8
#: Tasks that the pairs of blocks are dealt over at most; a task takes its pairs one after the other.
MOST_TASKS = 100_000


@dataclass
class Cells:
    """The cells of vectors of one length: their pivots, and the distances of each cell's vectors to some of them.

    ``inner`` and ``outer`` have a row for each cell: the least and largest distance of the vectors at home in it to the
    first pivots and, last, to the cell's own.
    """

    pivots: np.ndarray
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None

    def distances(self, u: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (u @ self.pivots.T), 0.0))

    def rims(self, u: np.ndarray, cell: int) -> np.ndarray:
        d = self.distances(u)
        return np.hstack([d[:, :COMPARED], d[:, [cell]]])

    def seen(self, u: np.ndarray, home: int, reach: float, among: np.ndarray | None = None) -> np.ndarray:
        """A mask of the cells (of ``among`` them) in which each unit vector at home in ``home`` may have a neighbour.

        With chord distance d, x within ``reach`` of some y at home in cell j needs d(x, p_j) <= d(x, p_home) + 2 reach,
        and each d(x, p) within ``reach`` of the distances to p at which that cell's vectors lie.
        """
        d, slack = self.distances(u), 1e-7
        among = np.arange(len(self.pivots)) if among is None else among
        at, own = d[:, among], d[:, home]
        mask = at <= own[:, None] + 2 * reach + slack
        mask &= (at <= self.outer[among, -1] + reach + slack) & (at >= self.inner[among, -1] - reach - slack)
        for p in range(self.inner.shape[1] - 1):
            mask &= (d[:, [p]] <= self.outer[among, p] + reach + slack) & (d[:, [p]] >= self.inner[among, p] - reach - slack)
        return mask | (among == home)


def linked(x: np.ndarray, y: np.ndarray, bound: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with cosine >= bound in double precision, a bounded number at a time."""
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), step):
        near = x4[lo : lo + step] @ y4.T
        i, j = np.nonzero(near >= bound - ROUNDING)
        close = near[i, j] < bound + ROUNDING
        if close.any():
            at = np.flatnonzero(close)
            good = np.einsum("ij,ij->i", x[lo + i[at]], y[j[at]]) >= bound
            keep = np.ones(len(i), dtype=bool)
            keep[at[~good]] = False
            i, j = i[keep], j[keep]
        yield lo + i, j


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, cell_size: int = 8_192, most_pivots: int = 1_024, block: int = vectors.BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding).

    Vectors link at cosine >= ``cosine``. Equal vectors are one node with a count, so copies are never paired. The
    distance is the chord between unit vectors, a metric; pivots, the first distinct vectors in hash order, about
    one for ``cell_size`` vectors, make the cells. A vector is at home in the cell of its nearest pivot, and is
    also seen wherever the triangle inequality lets a neighbour be at home. Cells are cut into blocks; two blocks meet
    if one has vectors that are seen in the other's cell, and only those are compared. Memory is bounded by two
    blocks, and a crowded cell is shared out. Links are counted where they are found; only a spanning forest of each
    pair of blocks leaves the task.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components link with nothing:
    n_links is 0 and component_id their own id. Vectors of different lengths don't link; of the lengths beyond the
    `LENGTHS` commonest each is one cell. Rows with equal ids are separate vectors.
    """
    rows = vectors.valid(embeddings)
    found = rows.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = common.Written(found.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))).df
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    out = common.Written(_links(nodes, cosine, reach, cell_size, most_pivots, block)).df
    linked_nodes = out.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comps = common.components(out.where("b IS NOT NULL").select("a", "b"))
    placed = nodes.join(linked_nodes, "node", "left").join(comps, "node", "left").select("embedding", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    placed = common.Written(placed).df
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = common.Written(placed.join(smallest, "component").select("embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")).df
    keyed = rows.join(answer, "embedding").select("vec_id", "n_links", "component_id")
    # rows that take no part come back from the input itself
    alone = vectors.given(embeddings).where(~vectors.takes_part()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = keyed.union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(nodes: DataFrame, cosine: float, reach: float, cell_size: int, most_pivots: int, block: int) -> DataFrame:
    """(a, null, n): n vectors link to those of node a; (a, b, null): edges of spanning forests."""
    cells: dict[int, Cells] = {}
    for row in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect():
        k = int(min(most_pivots, max(8, row["count"] // cell_size), row["count"]))
        first = nodes.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("embedding"), "node").limit(k).collect()  # k rows
        cells[row["dim"]] = Cells(vectors.unit(np.array([r.embedding for r in first], dtype=float)))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.zeros(batch.num_rows, dtype=np.int32)
            for dim, at, x in vectors.by_length(batch):
                if dim in cells:
                    home[at] = cells[dim].distances(vectors.unit(x)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "cell"])

    placed = nodes.select("node", "n", "dim", "embedding")
    placed = placed.mapInArrow(at_home, T.StructType([*placed.schema.fields, T.StructField("cell", T.IntegerType())]))
    packed, kind = vectors.blocks(placed, ["dim", "cell"], ["node", "n"], [], block).df, vectors.width_of(nodes)
    of = lambda raw, dim: vectors.unit(np.frombuffer(raw, kind).astype(float).reshape(-1, dim))
    wide = range(COMPARED + 1)

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] in cells:
                    d = cells[r["dim"]].rims(of(r["xs"], r["dim"]), r["cell"])
                    d = np.hstack([np.repeat(d[:, :1], COMPARED + 1 - d.shape[1], axis=1), d])  # fewer pivots: the first again
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "cell": pa.array([r["cell"]], pa.int32()), "lo": pa.array([d.min(axis=0)]), "hi": pa.array([d.max(axis=0)])})

    measured = packed.select("dim", "cell", "xs").mapInArrow(rims, "dim int, cell int, lo array<double>, hi array<double>")
    bounds = [*(F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in wide), *(F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in wide)]
    known = measured.groupBy("dim", "cell").agg(*bounds).collect()  # a row for each pivot
    for dim, c in cells.items():
        c.inner, c.outer = np.full((len(c.pivots), COMPARED + 1), np.inf), np.full((len(c.pivots), COMPARED + 1), -np.inf)
        for r in known:
            if r.dim == dim:
                c.inner[r.cell], c.outer[r.cell] = [r[f"lo{i}"] for i in wide], [r[f"hi{i}"] for i in wide]
        fewer = COMPARED - min(COMPARED, len(c.pivots))
        c.inner, c.outer = c.inner[:, fewer:], c.outer[:, fewer:]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                seen = [0]
                if r["dim"] in cells:
                    seen = np.flatnonzero(cells[r["dim"]].seen(of(r["xs"], r["dim"]), r["cell"], reach).any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), r["block"])), pa.array(np.full(len(seen), r["dim"], dtype=np.int32)), pa.array(np.asarray(seen, dtype=np.int32))], ["v", "dim", "cell"])

    visiting = packed.select("block", "dim", "cell", "xs").mapInArrow(visits, "v long, dim int, cell int")
    met = visiting.join(packed.select(F.col("block").alias("h"), "dim", "cell"), ["dim", "cell"])
    pairs = common.Written(met.select(F.greatest("v", "h").alias("left"), F.least("v", "h").alias("right")).distinct()).df
    side = lambda s, key: packed.select(F.col("block").alias(key), "dim", *[F.col(c).alias(f"{s}_{c}") for c in ("cell", "node", "n", "xs")])
    sent = pairs.join(side("r", "right").drop("dim"), "right")
    width = max(12, min(pairs.count() // 4, MOST_TASKS))
    units = side("l", "left").repartition(width, "left").join(sent.repartition(width, "left"), "left")
    units = units.withColumn("same", F.col("left") == F.col("right")).select("same", "dim", *[f"{s}_{c}" for s in "lr" for c in ("cell", "node", "n", "xs")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, same = batch.column("dim")[r].as_py(), batch.column("same")[r].as_py()
                cell = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind)
                sides = []
                for own, other in ("lr", "rl"):
                    node, n, u = cell(f"{own}_node", "<i8"), cell(f"{own}_n", "<i8"), of(cell(f"{own}_xs", kind), dim)
                    home, there = batch.column(f"{own}_cell")[r].as_py(), batch.column(f"{other}_cell")[r].as_py()
                    if home != there:
                        near = np.flatnonzero(cells[dim].seen(u, home, reach, np.array([there]))[:, 0])
                        node, n, u = node[near], n[near], u[near]
                    sides.append((node, n, u))
                (x, xn, xu), (y, yn, yu) = sides
                if not len(x) or not len(y):
                    continue
                ids = x if same else np.concatenate([x, y])
                root, total = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
                for i, j in linked(xu, yu, cosine):
                    if same:
                        i, j = i[i != j], j[i != j]
                    else:
                        j = j + len(x)
                        total += np.bincount(j, weights=xn[i], minlength=len(ids)).astype(np.int64)
                    total += np.bincount(i, weights=yn[j - (0 if same else len(x))], minlength=len(ids)).astype(np.int64)
                    root = common.hook(root, i, j)
                hit, moved = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(root)))
                a = pa.array(np.concatenate([ids[hit], ids[moved]]))
                b = pa.array(np.concatenate([np.zeros(len(hit), dtype=np.int64), ids[root[moved]]]), mask=np.arange(len(a)) < len(hit))
                n = pa.array(np.concatenate([total[hit], np.zeros(len(moved), dtype=np.int64)]), mask=np.arange(len(a)) >= len(hit))
                yield pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

    return units.mapInArrow(compare, "a long, b long, n long")


def op2_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS c FROM embeddings
  UNION
  SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.node
), links AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT node AS vec_id, coalesce(any_value(links.n), 0)::BIGINT AS n_links, min(c) AS component_id, node = min(c) AS kept
FROM reach LEFT JOIN links ON links.a = node GROUP BY node
"""
