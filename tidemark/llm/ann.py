"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a router."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors

#: Tasks that blocks are searched in at most; a task takes its blocks one after the other.
MOST_TASKS = 100_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k`` other rows of largest inner product."""
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, parts of equal size (within one), cutting few edges of the neighbour graph.

    Recursive bisection: the halves of a set are the lower and upper half of the smoothed vector that varies least
    along edges (power iteration), then pairs of rows that both gain are exchanged. ``parts`` is a power of two.
    """
    label = np.zeros(len(near), dtype=np.int64)
    k = near.shape[1]
    a, b = np.repeat(np.arange(len(near)), k), near.ravel()
    random = np.random.default_rng(5)
    for level in range(parts.bit_length() - 1):
        halved = np.empty_like(label)
        for part in range(1 << level):
            rows = np.flatnonzero(label == part)
            where = np.full(len(near), -1)
            where[rows] = np.arange(len(rows))
            inside = (where[a] >= 0) & (where[b] >= 0)
            i, j = where[a[inside]], where[b[inside]]
            n = len(rows)
            degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1.0
            v = random.standard_normal(n)
            for _ in range(60):
                v -= (v * degree).sum() / degree.sum()
                v = 0.5 * v + 0.5 * (np.bincount(i, weights=v[j], minlength=n) + np.bincount(j, weights=v[i], minlength=n) + v) / degree
                v /= np.sqrt((v * v).sum()) + 1e-300
            side = np.zeros(n, dtype=bool)
            side[np.argsort(v, kind="stable")[n // 2 :]] = True
            for _ in range(10):
                sign = np.where(side, 1.0, -1.0)
                pull = np.bincount(i, weights=sign[j], minlength=n) + np.bincount(j, weights=sign[i], minlength=n)
                gain = -sign * pull
                up, down = np.flatnonzero(~side), np.flatnonzero(side)
                up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
                m = min(len(up), len(down))
                swaps = int((gain[up[:m]] + gain[down[:m]] > 2).sum()) // 2
                if not swaps:
                    break
                side[up[:swaps]], side[down[:swaps]] = True, False
            halved[rows] = 2 * part + side
        label = halved
    return label


@dataclass
class Router:
    """Softmax regression: the probability of each part for a vector."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def learn(x: np.ndarray, parts: int, k: int, recall: float, steps: int = 250) -> Router:
    """Cut the sample's neighbour graph, fit the router to it, and choose how many parts to probe.

    A row's target is the share of its neighbours, and itself, in each part. ``probes`` is the least number of parts
    in which the sample's rows find ``recall`` of their ``k`` nearest in the sample; in the whole table neighbours are
    nearer, and more of them are found.
    """
    dim = x.shape[1]
    if parts < 2 or len(x) <= 2 * k:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    near = neighbour_graph(x, k)
    label = balanced_cut(near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), label[near].ravel()), 1.0)
    target[np.arange(len(x)), label] += k
    target /= target.sum(axis=1, keepdims=True)
    scale = np.sqrt((x * x).sum(axis=1).mean()) + 1e-12
    z = x / scale
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        s = z @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target) / len(x)
        vw, vb = 0.9 * vw - 8.0 * (z.T @ e + 1e-5 * w), 0.9 * vb - 8.0 * e.sum(axis=0)
        w, b = w + vw, b + vb
    router = Router(w / scale, b, parts)
    s = router.scores(x)
    home = s.argmax(axis=1)
    rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1)
    depth = rank[np.repeat(np.arange(len(x)), k), home[near].ravel()]
    found = np.cumsum(np.bincount(depth, minlength=parts)) / len(depth)
    router.probes = min(parts, int(np.searchsorted(found, recall)) + 1)
    return router


def parts_for(count: int, k: int, part_size: int, least: int, most: int) -> int:
    """A power of two: enough parts of ``part_size`` vectors, but ``least`` and at most ``most``; 1 for a handful."""
    if count < 2 * k * least:
        return 1
    return min(most, max(least, 1 << (-(-count // part_size) - 1).bit_length()))


def search(embeddings: DataFrame, is_query, k: int = 20, sample: int = 8_192, part_size: int = 4_096, least_parts: int = 8, most_parts: int = 256, recall: float = 0.94, block: int = vectors.BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``is_query`` holds, the ``k`` of largest inner product found.

    The router is fitted on at most ``sample`` distinct vectors, the first in hash order. Every vector is indexed, in
    its likeliest part; a query searches its ``probes`` likeliest parts exactly, in double precision. Equal vectors
    are one entry with their k + 1 smallest ids, which is all that a result can hold of them; equal queries are
    searched once. A part is searched in blocks of bounded size, so a crowded part is shared out, and only the best
    k + 1 of a block leave the task; they are merged by rank, of which each task keeps k + 1 before the shuffle. All
    candidates return if fewer than k take part. A sample of this size can tell some hundreds of parts apart, hence
    ``most_parts``; a table of over ``most_parts`` times ``part_size`` vectors has larger parts, not more of them.

    Null, zero and non-finite vectors, and rows without an id, take no part. Vectors of other lengths than the
    commonest are compared among themselves, each length in one part. A row with the query's own id is no candidate.
    Ties go to the smaller id.
    """
    rows = vectors.valid(embeddings)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("vec_id", "embedding")
    wanted = asked.select("embedding").distinct().withColumn("asks", F.lit(True))
    nodes = entries.join(wanted, "embedding", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    nodes = common.Written(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))).df
    commonest = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if commonest is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = nodes.where(F.col("dim") == commonest["dim"])
    parts = parts_for(commonest["count"], k, part_size, least_parts, most_parts)
    x = vectors.matrix(own.orderBy(F.xxhash64("embedding"), "node").limit(sample if parts > 1 else 1).select("embedding").toArrow()["embedding"])
    best = _searched(nodes, commonest["dim"], learn(x, parts, k, recall), k, block)
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("less", "vec_id"))).where(F.col("_r") <= k + 1)
    merged = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("less", "vec_id"))).alias("best"))  # k + 1 at most
    merged = merged.join(nodes.select("node", "embedding"), "node")
    answer = asked.join(merged, "embedding").withColumn("best", F.slice(F.filter("best", lambda e: e["vec_id"] != F.col("vec_id")), 1, k))
    flat = answer.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("rank", "hit"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def _searched(nodes: DataFrame, dim: int, router: Router, k: int, block: int) -> DataFrame:
    """(node, less, vec_id): for each asking node and block it visits, the best, less being the negative score."""
    kind = vectors.width_of(nodes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=np.int32)
            to = np.zeros((batch.num_rows, router.probes), dtype=np.int32)
            sizes = np.ones(batch.num_rows, dtype=np.int64)
            for length, at, x in vectors.by_length(batch):
                if length == dim:
                    score = router.scores(x)
                    part[at], sizes[at] = score.argmax(axis=1), router.probes
                    to[at] = np.argsort(-score, axis=1, kind="stable")[:, : router.probes]
            sizes[~np.asarray(batch.column("asks"))] = 0
            visited = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(to[np.arange(router.probes) < sizes[:, None]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), visited], [*batch.schema.names, "part", "visited"])

    schema = T.StructType([*nodes.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("visited", T.ArrayType(T.IntegerType()))])
    routed = nodes.mapInArrow(route, schema)
    held = vectors.blocks(routed.select("dim", "part", "node", "ids", "embedding"), ["dim", "part"], ["node"], ["ids"], block).df
    going = routed.where("asks").select("dim", F.explode("visited").alias("part"), "node", "embedding")
    queries = vectors.blocks(going, ["dim", "part"], ["node"], [], block // 2).df
    sent = queries.select("dim", "part", F.col("node").alias("nodes"), F.col("xs").alias("q_xs")).join(held.select("dim", "part", "block"), ["dim", "part"])
    width = max(12, min(held.count(), MOST_TASKS))
    units = held.drop("part").repartition(width, "block").join(sent.drop("dim", "part").repartition(width, "block"), "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind)
                width = batch.column("dim")[r].as_py()
                sizes, ids, nodes_ = cell("ids_sizes", "<i8"), cell("ids", "<i8"), cell("nodes", "<i8")
                c, q = (cell(name, kind).astype(float).reshape(-1, width) for name in ("xs", "q_xs"))
                begin = np.cumsum(sizes) - sizes
                for lo in range(0, len(q), 256):
                    s = q[lo : lo + 256] @ c.T
                    slack = 1e-9 * (np.abs(s).max() + 1.0)
                    less, named, asks = [], [], []
                    for i in range(len(s)):
                        at = np.arange(len(c))
                        if len(c) > k + 1:
                            at = np.flatnonzero(s[i] >= np.partition(s[i], len(c) - k - 1)[len(c) - k - 1] - slack)
                        score = (c[at] * q[lo + i]).sum(axis=1)  # one order of summation wherever the row lies
                        own_less, own_ids = -np.repeat(score, sizes[at]), ids[common.concat_ranges(begin[at], sizes[at])]
                        top = np.lexsort((own_ids, own_less))[: k + 1]
                        less.append(own_less[top])
                        named.append(own_ids[top])
                        asks.append(np.full(len(top), nodes_[lo + i]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (asks, less, named)], ["node", "less", "vec_id"])

    return units.select("dim", "ids_sizes", "ids", "xs", "nodes", "q_xs").mapInArrow(compare, "node long, less double, vec_id long")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
