"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
#: Node pairs that a traversal holds at once, and products of node sizes below which it compares directly.
FRONTIER, DIRECT = 100_000, 256
#: Tasks that pairs of nodes are dealt over at most; a task takes its pairs one after the other.
MOST_TASKS = 100_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 for a text without a word."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(len(found) - words + 1, 1)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """``documents`` with simhash (a long holding the 64 bits), replacing a column so named; no shuffle.

    Texts are whole. Null and empty texts, and texts of white space, have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, words) for x in common.text_bytes(batch.column("_bytes"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "simhash"])

    rest = documents.drop("simhash", "_bytes")
    out = T.StructType([*rest.schema.fields, T.StructField("simhash", T.LongType())])
    return rest.withColumn("_bytes", F.col("text").cast("binary")).mapInArrow(run, out)


def trie_matches(a: np.ndarray, b: np.ndarray, budget: int, top: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] and b[j] differing in at most ``budget`` of bits ``top``..0.

    ``a`` and ``b`` are sorted and distinct, and agree within themselves above ``top``. A node of a trie is a
    range of its array; pairs of nodes are taken one bit at a time, those of a level together. A pair of children
    on different sides spends one of the pair's remaining differences and is dropped when none is left. With
    ``same``, ``a`` is ``b`` and each pair comes once.
    """
    if not len(a) or not len(b):
        return
    one = np.uint64(1)
    first = tuple(np.array([x]) for x in (0, len(a), 0, len(b), budget))
    stack = [(top, first)]
    while stack:
        bit, (alo, ahi, blo, bhi, left) = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            state = (alo, ahi, blo, bhi, left)
            stack += [(bit, tuple(x[:half] for x in state)), (bit, tuple(x[half:] for x in state))]
            continue
        product = (ahi - alo) * (bhi - blo)
        small = (product <= DIRECT) | (bit < 0)
        if small.any():
            yield from _compare(a, b, alo[small], ahi[small], blo[small], bhi[small], budget, top, same)
            alo, ahi, blo, bhi, left = (x[~small] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            continue
        shift = np.uint64(bit)
        mid_a = _middle(a, alo, ahi, shift, one)
        mid_b = mid_a if same and a is b and (alo == blo).all() else _middle(b, blo, bhi, shift, one)
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), dtype=bool)
        spend = left > 0
        cross = spend & ~twin
        parts = [
            (alo, mid_a, blo, mid_b, left), (mid_a, ahi, mid_b, bhi, left),
            tuple(x[spend] for x in (alo, mid_a, mid_b, bhi, left - 1)), tuple(x[cross] for x in (mid_a, ahi, blo, mid_b, left - 1)),
        ]
        nxt = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        full = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2])
        stack.append((bit - 1, tuple(x[full] for x in nxt)))


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64, one: np.uint64) -> np.ndarray:
    """Where the bit turns from 0 to 1 within each range [lo, hi) of a sorted array."""
    split = ((values[lo] >> shift) | one) << shift
    return np.clip(np.searchsorted(values, split), lo, hi)


def _compare(a, b, alo, ahi, blo, bhi, budget: int, top: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches of all index pairs of the given node pairs, a bounded number at a time."""
    wide = bhi - blo
    rows = ahi - alo
    mask = np.uint64((1 << (top + 1)) - 1)
    i_all = common.concat_ranges(alo, rows)
    blo, wide = np.repeat(blo, rows), np.repeat(wide, rows)
    done = np.r_[0, np.cumsum(wide)]
    at = 0
    while at < len(i_all):
        end = max(int(np.searchsorted(done, done[at] + 2_000_000, side="right")) - 1, at + 1)
        j = common.concat_ranges(blo[at:end], wide[at:end])
        i = np.repeat(i_all[at:end], wide[at:end])
        near = np.bitwise_count((a[i] ^ b[j]) & mask) <= budget
        if same:
            near &= i < j
        yield i[near], j[near]
        at = end


def link(a: np.ndarray, b: np.ndarray, budget: int, top: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sorted sets of fingerprints: fewer edges than fingerprints."""
    values = a if same else np.concatenate([a, b])
    root = np.arange(len(values))
    for i, j in trie_matches(a, b, budget, top, same):
        root = common.hook(root, i, j if same else j + len(a))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def links(prints: DataFrame, distance: int = 3, node_size: int = 16_384) -> DataFrame:
    """Edges (a, b) between distinct ``prints.simhash`` that connect all that differ in at most ``distance`` bits.

    The top of the trie, as deep as leaves about ``node_size`` fingerprints in a node, is walked by Spark: a node's
    partners are the nodes whose prefixes differ in at most ``distance`` bits, joined with the budget that is
    left. A node that holds more (fingerprints need not be spread evenly) is dealt into as many blocks as it
    needs, which meet pairwise. A task gets one pair of blocks, so its memory is bounded, and returns a
    spanning forest rather than all pairs. An empty table gives no edges.
    """
    n = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / node_size))))
    top = 64 - depth
    node = F.shiftrightunsigned("simhash", top) if depth else F.lit(0).cast("long")
    placed = prints.select("simhash", node.alias("node"))
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / F.lit(node_size)).cast("int").alias("parts"))
    sized = placed.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int"))
    blocks = common.Written(sized.groupBy("node", "parts", "part").agg(F.sort_array(F.collect_list("simhash")).alias("prints")), "snappy").df
    masks = [sum(1 << x for x in bits) for k in range(min(distance, depth) + 1) for bits in combinations(range(depth), k)]
    left = blocks.select(F.col("node").alias("a_node"), F.col("part").alias("a_part"), F.col("prints").alias("a"))
    right = blocks.select(F.col("node").alias("b_node"), F.col("part").alias("b_part"), F.col("prints").alias("b"))
    moves = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(distance - m.bit_count()).alias("budget")) for m in masks])
    asked = left.select("a_node", "a_part", "a", F.inline(moves))
    units = asked.withColumn("b_node", F.col("a_node").bitwiseXOR(F.col("mask"))).where("b_node >= a_node")
    units = units.join(right, "b_node").where("b_node > a_node OR b_part >= a_part")
    units = units.withColumn("same", F.expr("b_node = a_node AND b_part = a_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sets = []
                for side in ("a", "b"):
                    values = np.asarray(batch.column(side)[k].values).view(np.uint64)
                    sets.append(np.sort(values))
                same = batch.column("same")[k].as_py()
                x, y = link(sets[0], sets[0] if same else sets[1], batch.column("budget")[k].as_py(), top - 1, same)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    spread = units.select("a", "b", "budget", "same").repartition(max(8, min(MOST_TASKS, n // 4096 + 1)))
    return spread.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(simhash, component_id) for each distinct simhash of ``prints`` (doc_id, simhash).

    component_id is the smallest doc_id among documents reachable by links, null where none has an id. Equal
    fingerprints are one node, so copies are never compared with each other.
    """
    nodes = common.Written(prints.groupBy("simhash").agg(F.min("doc_id").alias("first")))
    found = common.components(links(nodes.df.select("simhash"), distance))
    placed = nodes.df.join(found.withColumnRenamed("node", "simhash"), "simhash", "left")
    placed = common.Written(placed.select("simhash", "first", F.coalesce("component", "simhash").alias("component"))).df
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return common.cut(placed.join(smallest, "component").select("simhash", "component_id"))


def near_duplicates(documents: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """``documents`` (doc_id and further columns, text excepted) with simhash and component_id.

    Every row returns, repeated rows too; all rows of a fingerprint share its component. Columns of these names are
    replaced.
    """
    prints = common.Written(fingerprints(documents.drop("component_id"), words).drop("text")).df
    return prints.join(groups(prints.select("doc_id", "simhash"), distance), "simhash", "left")


def dedup(documents: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``documents``: that of the smallest doc_id.

    Among rows of one id (or of none), the one whose text hashes lowest; of equal rows, one. Only ids, fingerprints
    and hashes take part in finding groups; the texts move once, to meet the ids that stay.
    """
    names = documents.columns
    hashed = documents.withColumn("_h", F.xxhash64(F.col("text").cast("binary")))
    prints = common.Written(fingerprints(hashed.select("doc_id", "text", "_h"), words).drop("text")).df
    grouped = prints.join(groups(prints.select("doc_id", "simhash"), distance), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first")
    # an id is that of its component, or the component has none; simhash keeps components without ids apart
    lone = F.when(F.col("component_id").isNull(), F.col("simhash"))
    kept = common.cut(grouped.groupBy("component_id", lone.alias("lone")).agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first._h").alias("_h")))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._h") == F.col("r._h"))
    return hashed.alias("l").join(kept.alias("r"), same, "left_semi").dropDuplicates(["doc_id", "_h"]).select(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
