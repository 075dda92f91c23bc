"""Valid vectors, and blocks of vectors with one key, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Vectors of a block, about; a task holds two blocks at a time.
BLOCK = 8_192


def takes_part():
    """Whether a row of (vec_id, embedding) has an id and finite components that aren't all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def given(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding); components stay single where they are so stored, which halves what is moved, else are double."""
    single = embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType(), embeddings.schema["embedding"].dataType.containsNull)
    return embeddings.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    return given(embeddings).where(takes_part())


def width_of(df: DataFrame) -> str:
    """The numpy type of a column ``embedding``."""
    return "<f4" if df.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose rows have one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that tiny or huge ones keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length of vectors in a batch with columns dim and embedding."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, matrix(batch.column("embedding").take(pa.array(rows)))


def blocks(rows: DataFrame, keys: list[str], scalars: list[str], lists: list[str], most: int = BLOCK) -> common.Written:
    """``rows`` packed: (block, keys, and in binary the 64-bit ``scalars``, ``lists`` with their sizes, and vectors xs).

    A block holds about ``most`` rows with equal ``keys`` (ints). Keys with more rows are dealt into as many blocks as
    they need by a hash of the first scalar, after the rows of each have been counted, so a crowded key is no task.
    """
    kind = width_of(rows)
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_parts"))
    salted = rows.join(parts, keys).withColumn("_salt", F.pmod(F.xxhash64(scalars[0]), F.col("_parts")).cast("int"))
    dealt = salted.select(*keys, "_salt", *scalars, *lists, "embedding").repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
    names = [*scalars, *(x for c in lists for x in (f"{c}_sizes", c)), "xs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = (), [], 0

        def block() -> pa.RecordBatch:
            joined = lambda get, to: np.concatenate([np.asarray(get(b)) for b in held]).astype(to).tobytes()
            out = [joined(lambda b, c=c: b.column(c), "<i8") for c in scalars]
            for c in lists:
                out += [joined(lambda b, c=c: b.column(c).value_lengths(), "<i8"), joined(lambda b, c=c: b.column(c).flatten(), "<i8")]
            out.append(joined(lambda b: b.column("embedding").flatten(), kind))
            return pa.RecordBatch.from_arrays([*(pa.array([int(k)], pa.int32()) for k in now[:-1]), *(pa.array([o], pa.binary()) for o in out)], [*keys, *names])

        for batch in batches:
            marks = np.stack([np.asarray(batch.column(k)) for k in (*keys, "_salt")], axis=1)
            turns = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)]
            for lo, hi in zip(turns[:-1], turns[1:], strict=True):
                if hi > lo:
                    if held and (tuple(marks[lo]) != now or count >= 2 * most):
                        yield block()
                        held, count = [], 0
                    now, count = tuple(marks[lo]), count + int(hi - lo)
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield block()

    out = dealt.mapInArrow(run, ", ".join([*(f"{k} int" for k in keys), *(f"{n} binary" for n in names)]))
    return common.Written(out.withColumn("block", F.monotonically_increasing_id()), "snappy")
