"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linear

BITS = 20
ORDERS = (3, 4, 5, 6, 7)
#: Tasks that count grams at most, and slices in which their counts are added up.
COUNTERS, SLICES = 96, 64


def gram_buckets(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the character n-gram that starts at each code point."""
    wide = buf.astype(np.uint32)
    h = np.zeros(len(buf), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = len(buf) - n + 1
        if size <= 0:
            return
        h = (h[:size] ^ wide[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield n, (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def folded(text: bytes) -> str:
    """Lower-cased words between single spaces, so that a gram at an edge of the text meets a boundary too."""
    return " ".join(["", *text.decode("utf-8", "replace").lower().split(), ""])


def presence(texts: list[bytes], slots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) once for each feature that a text holds; with ``slots``, only the features chosen there.

    Grams are of characters, whatever bytes they take, and never cross texts: each order skips the positions whose
    gram would.
    """
    for lo, hi in common.chunks(texts):
        parts = [folded(x) for x in texts[lo:hi]]
        buf = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes)
        found = []
        for n, bucket in gram_buckets(buf):
            if slots is None:
                at = np.arange(len(bucket))
                feature = bucket.astype(np.int64)
            else:
                feature = slots[bucket]
                at = np.flatnonzero(feature >= 0)
                feature = feature[at].astype(np.int64)
            row = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[row]
            found.append((row[inside] << 32) | feature[inside])
        keys = common.distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        yield (keys >> 32) + lo, keys & 0xFFFFFFFF


@dataclass
class Model:
    """``slots`` maps a gram bucket to its place in ``weights`` or to -1; ``intercept`` is the score of no evidence."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def gram_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the texts of class 0 and 1 of ``rows`` (y, text) that hold it, and the texts of each class.

    Each of at most `COUNTERS` tasks counts its texts in an array of fixed size; the arrays are added up slice by slice,
    so the driver receives one array, whatever the number of texts.
    """
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((2, size), dtype=np.int32)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for row, feature in presence(common.text_bytes(batch.column("text"))):
                for c in (0, 1):
                    hits[c] += np.bincount(feature[y[row] == c], minlength=size).astype(np.int32)
        for i, part in enumerate(np.split(hits, SLICES, axis=1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "hits": pa.array([part.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, dtype=np.int32) for x in table["hits"].to_pylist()], axis=0, dtype=np.int32)
        return pa.table({"slice": table["slice"][:1], "hits": pa.array([total.tobytes()], pa.binary())})

    form = "slice int, hits binary"
    hits, docs = np.zeros((2, size), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for r in rows.groupBy("y").count().collect():
        docs[r["y"]] = r["count"]
    wide = size // SLICES
    for r in rows.coalesce(COUNTERS).mapInArrow(count, form).groupBy("slice").applyInArrow(add, form).collect():
        hits[:, r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["hits"], dtype=np.int32).reshape(2, wide)
    return hits, docs


def telling(hits: np.ndarray, docs: np.ndarray, most: int, least: int = 3) -> np.ndarray:
    """The ``most`` buckets, of those in ``least`` texts, whose counts differ most between classes, by likelihood ratio."""
    p = (hits[1] + 0.5) / (docs[1] + 1.0)
    q = (hits[0] + 0.5) / (docs[0] + 1.0)
    m = (hits.sum(0) + 1.0) / (docs.sum() + 2.0)
    gain = docs[1] * (p * np.log(p / m) + (1 - p) * np.log((1 - p) / (1 - m))) + docs[0] * (q * np.log(q / m) + (1 - q) * np.log((1 - q) / (1 - m)))
    gain[hits.sum(0) < least] = 0
    kept = np.argsort(-gain, kind="stable")[:most]
    return kept[gain[kept] > 4]


def grams_of(texts: list[bytes], slots: np.ndarray) -> list[np.ndarray]:
    """For each text the chosen features that it holds."""
    out = [np.zeros(0, dtype=np.int32)] * len(texts)
    for row, feature in presence(texts, slots):
        turns = np.flatnonzero(np.diff(row)) + 1
        for r, part in zip(row[np.r_[0, turns]] if len(row) else [], np.split(feature, turns), strict=False):
            out[r] = part.astype(np.int32)
    return out


def fit(documents: DataFrame, labels: DataFrame, usable, label: str = "toxic", sample: int | None = None, features: int = 8_192, l2: float = 1e-4) -> Model:
    """Learn from all labelled documents, or with ``sample`` from the first so many in hash order of their ids.

    The counts of a gram are the documents of either class that hold it. The ``features`` grams whose counts differ most
    (by likelihood ratio) are kept; each is scaled by its log-count ratio, and logistic regression sets the weights, in
    passes of Spark over the documents' kept features. The driver receives counts and sums of fixed size. With one class
    or none the score is the smoothed share of ones.
    """
    rows = linear.labelled_texts(documents, labels, label, usable, sample)
    size = 1 << BITS
    hits, docs = gram_counts(rows)
    prior = float(np.log((docs[1] + 1.0) / (docs[0] + 1.0)))
    if not docs.all():
        return Model(np.full(size, -1, dtype=np.int32), np.zeros(1), prior)
    ratio = np.log(((hits[1] + 1.0) / (hits[1].sum() + 1.0)) / ((hits[0] + 1.0) / (hits[0].sum() + 1.0)))
    kept = telling(hits, docs, features)
    slots = np.full(size, -1, dtype=np.int32)
    slots[kept] = np.arange(len(kept), dtype=np.int32)
    if not len(kept):
        return Model(slots, np.zeros(1), prior)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = grams_of(common.text_bytes(batch.column("text")), slots)
            parts = {"y": np.asarray(batch.column("y")).astype(np.int8), "sizes": np.array([len(h) for h in held], dtype=np.int32), "cols": np.concatenate([np.zeros(0, dtype=np.int32), *held]).astype("<u2")}
            yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

    blocks = common.Written(rows.mapInArrow(encode, "y binary, sizes binary, cols binary"))
    scale = ratio[kept]
    w, b = linear.logistic(blocks.df, scale, int(docs.sum()), l2, start=0.1)
    blocks.drop()
    return Model(slots, w * scale, b)


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``documents`` with toxicity (0 to 1) and toxic (1 where toxicity >= threshold), replacing columns so named.

    Every whole text is scored where it lies, without a shuffle. Null and empty texts hold no gram and get the
    intercept's score; repeated rows each get the same one.
    """
    return common_score(documents, lambda texts: logits(texts, model), "toxicity").withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))


def logits(texts: list[bytes], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.intercept)
    for row, feature in presence(texts, model.slots):
        out += np.bincount(row, weights=model.weights[feature], minlength=len(texts))
    return out


def common_score(documents: DataFrame, logits_of, name: str) -> DataFrame:
    """``documents`` with column ``name`` = the logistic function of ``logits_of`` its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip(logits_of(common.text_bytes(batch.column("_bytes"))), -35, 35)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(1.0 / (1.0 + np.exp(-z)))], [*batch.schema.names[:-1], name])

    rest = documents.drop(name, "_bytes")
    out = rest.schema.add(name, "double")
    return rest.withColumn("_bytes", F.col("text").cast("binary")).mapInArrow(run, out)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, labels, ~common.held_out(4, 2, "_id"))
    scored = score(documents.select("doc_id", common.held_out(4, 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))
