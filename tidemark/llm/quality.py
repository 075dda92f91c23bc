"""Quality: document scores learnt from preference pairs by Bradley-Terry ranking, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linear, toxicity
from .substrings import Rolled

#: Shares of bytes by class, shapes of words, and repetition; see `features`.
NAMES = ("upper", "lower", "digit", "space", "newline", "sentence", "exclaim", "pipe", "markup", "other", "high", "log_words", "word_len", "word_var", "shout", "symbol_end", "alone_symbol", "distinct", "top_word", "same_next", "bigrams", "lines", "line_repeats", "long_words", "short_words")
_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-"]], _CLASS[ord("!")], _CLASS[ord("|")] = 5, 6, 7
_CLASS[[ord(c) for c in "#$%&*<>{}[]\\/=+~^_`@"]] = 8
_CLASS[128:] = 10
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Labelled documents in a block, about: what one step of a pass holds, and where a document's rivals come from.
BLOCK = 2_048


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def repeats(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many distinct keys it holds and how often its commonest occurs."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]) if len(r) else np.zeros(0, dtype=np.int64)
    runs = np.diff(np.r_[first, len(r)])
    most = np.zeros(n)
    np.maximum.at(most, r[first], runs)
    return np.bincount(r[first], minlength=n), most


def features(texts: list[bytes]) -> np.ndarray:
    """A row of `NAMES` for each whole text; an empty one has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi in common.chunks(texts):
        n = hi - lo
        buf = np.frombuffer(b"".join(x + b"\n" for x in texts[lo:hi]), dtype=np.uint8)
        size = np.array([len(x) + 1 for x in texts[lo:hi]])
        doc = np.repeat(np.arange(n), size)
        classes = np.bincount(doc * 11 + _CLASS[buf], minlength=11 * n).reshape(n, 11)
        classes[:, 4] -= 1
        length = np.maximum(size - 1, 1)
        space = _SPACE[buf]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(space & ~np.r_[True, space[:-1]])
        at = doc[starts]
        words = np.bincount(at, minlength=n)
        wide = (ends - starts).astype(float)
        mean = share(np.bincount(at, weights=wide, minlength=n), words)
        caps = np.r_[0, np.cumsum((_CLASS[buf] == 0))]
        capital = (caps[ends] - caps[starts]) >= np.maximum(2, 0.5 * wide)
        last = _CLASS[buf[ends - 1]] if len(ends) else np.zeros(0, dtype=np.int64)
        before = _CLASS[buf[np.maximum(ends - 2, 0)]] if len(ends) else last
        symbol = np.isin(last, (6, 8)) & np.isin(before, (6, 8)) & (wide > 2)
        rolled = Rolled(buf)
        key = rolled.spans(starts, ends)  # of a word's bytes in their order
        distinct, top = repeats(at, key, n)
        inner = at[1:] == at[:-1]
        same = np.bincount(at[1:][inner & (key[1:] == key[:-1])], minlength=n)
        pair = (key[1:] * np.uint64(3) + common.mixed(key[:-1]))[inner]
        pairs, _ = repeats(at[1:][inner], pair, n)
        line_end = np.flatnonzero(buf == 10)
        line_start = np.r_[0, line_end[:-1] + 1]
        lines = np.bincount(doc[line_end], minlength=n)
        line_kinds, _ = repeats(doc[line_end], rolled.spans(line_start, line_end), n)
        per = [
            *(share(classes[:, c], length) for c in range(11)), np.log1p(words), mean,
            np.sqrt(np.maximum(share(np.bincount(at, weights=wide * wide, minlength=n), words) - mean * mean, 0)),
            share(np.bincount(at[capital], minlength=n), words), share(np.bincount(at[symbol], minlength=n), words),
            share(np.bincount(at[(wide == 1) & np.isin(last, (7, 8))], minlength=n), words), share(distinct, words), share(top, words),
            share(same, words), share(pairs, words - 1), share(lines, words), share(line_kinds, lines),
            share(np.bincount(at[wide > 15], minlength=n), words), share(np.bincount(at[wide < 3], minlength=n), words),
        ]
        block = np.stack(per, axis=1)
        block[size == 1] = 0
        out[lo:hi] = block
    return out


@dataclass
class Model:
    """A text's score: ((features - mean) / spread, and its square) . weights, and the mean of its grams' weights.

    The mean is over the root of the number of grams that the text holds of those in ``slots``; ``cut`` is the score
    at the threshold.
    """

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slots: np.ndarray
    grams: np.ndarray

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self.expanded(features(texts)) @ self.weights + self.gram_scores(toxicity.grams_of(texts, self.slots)) - self.cut

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, np.minimum(z * z, 16.0)])

    def gram_scores(self, held: list[np.ndarray]) -> np.ndarray:
        return np.array([self.grams[h].sum() / np.sqrt(max(len(h), 1)) for h in held])


def fit(documents: DataFrame, labels: DataFrame, usable, label: str = "quality", sample: int | None = None, rivals: int = 12, grams: int = 1_024, l2: float = 1e-4, steps: int = 40) -> Model:
    """Learn from all labelled documents, or with ``sample`` from the first so many in hash order of their ids.

    A document's features are `NAMES`, and which of ``grams`` character n-grams, those that tell the labels apart
    best, it holds. Documents are dealt into blocks of about `BLOCK`, and each is preferred, or loses, to ``rivals``
    documents of the other label in its block, dealt round in hash order; each label weighs half. Bradley-Terry weights
    minimize the logistic loss of feature differences over all those pairs, by L-BFGS in at most ``steps`` passes, each of
    them a Spark job that sums the blocks' gradients. The cut is the quantile of all the documents' scores at the share of
    documents labelled 0, so that share is judged low. The driver receives sums of fixed size. With one label or none, all
    texts score as that label (0.5 without any).
    """
    rows = linear.labelled_texts(documents, labels, label, usable, sample)
    hits, docs = toxicity.gram_counts(rows)
    wide, none = 2 * len(NAMES), np.full(hits.shape[1], -1, dtype=np.int32)
    if not docs.all():
        only = 3.0 * float(np.sign(docs[0]) - np.sign(docs[1]))
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(wide), only, none, np.zeros(1))
    kept = toxicity.telling(hits, docs, grams)
    none[kept] = np.arange(len(kept), dtype=np.int32)
    slots = none

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.text_bytes(batch.column("text"))
            held = [h.astype("<u2").tobytes() for h in toxicity.grams_of(texts, slots)]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "y": batch.column("y"), "x": pa.array([r.tobytes() for r in features(texts)], pa.binary()), "f": pa.array(held, pa.binary())})

    blocks, copies = dealt(rows.mapInArrow(encode, "key long, y int, x binary, f binary"), docs)
    total = int(docs.sum())
    mean = linear.summed(blocks.df, lambda b: unpacked(b).own_x().sum(0)) / total
    spread = np.sqrt(linear.summed(blocks.df, lambda b: ((unpacked(b).own_x() - mean) ** 2).sum(0)) / total) + 1e-6
    model = Model(mean, spread, np.zeros(wide), 0.0, np.zeros(0, dtype=np.int32), np.zeros(max(len(kept), 1)))  # passes need no slots
    weight = 0.5 / (docs * copies * rivals)  # of a pair of the document, a copy, that it is dealt for

    def lost(at: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = at[:wide], at[wide:]

        def of(block: dict) -> np.ndarray:
            b = unpacked(block)
            z = model.expanded(b.x)
            s = z @ w + b.spread_over(v)
            good, bad = np.flatnonzero(b.y == 1), np.flatnonzero(b.y == 0)
            if not len(good) or not len(bad):
                return np.zeros(1 + len(at))
            winner = np.r_[np.repeat(good, rivals), good[(np.arange(len(bad) * rivals) * 7919) % len(good)]]
            loser = np.r_[bad[(np.arange(len(good) * rivals) * 7919) % len(bad)], np.repeat(bad, rivals)]
            each = np.repeat(weight[::-1], [len(good) * rivals, len(bad) * rivals])
            gap = s[winner] - s[loser]
            e = each / (1.0 + np.exp(np.clip(gap, -35, 35)))
            pull = np.bincount(winner, weights=e, minlength=len(s)) - np.bincount(loser, weights=e, minlength=len(s))
            return np.r_[each @ np.logaddexp(0, -gap), -(z.T @ pull), -b.gathered(pull, len(v))]

        got = linear.summed(blocks.df, of)
        return got[0] + 0.5 * l2 * float(at @ at), got[1:] + l2 * at

    best = linear.minimized(lost, np.zeros(wide + len(model.grams)), steps)
    model.weights, model.grams = best[:wide], best[wide:]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                b = unpacked(block)
                s = model.expanded(b.x) @ model.weights + b.spread_over(model.grams)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s[b.own])})

    model.cut = linear.quantile(blocks.df.mapInArrow(scored, "s double"), docs[0] / total)
    blocks.drop()
    model.slots = slots
    return model


@dataclass
class Block:
    """Documents of one block: labels, whether a row is its document's first copy, features, and the grams each holds."""

    y: np.ndarray
    own: np.ndarray
    x: np.ndarray
    at: np.ndarray
    cols: np.ndarray
    share: np.ndarray

    def own_x(self) -> np.ndarray:
        return self.x[self.own]

    def spread_over(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=v[self.cols] * self.share, minlength=len(self.y))

    def gathered(self, pull: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, weights=self.share * pull[self.at], minlength=size)


def unpacked(block: dict) -> Block:
    sizes, cols = np.frombuffer(block["sizes"], dtype=np.int32), np.frombuffer(block["cols"], dtype="<u2").astype(np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    x = np.frombuffer(block["x"]).reshape(-1, len(NAMES))
    return Block(np.frombuffer(block["y"], dtype=np.int8), np.frombuffer(block["own"], dtype=bool), x, at, cols, 1.0 / np.sqrt(sizes[at]))


def dealt(encoded: DataFrame, docs: np.ndarray, size: int | None = None, least: int = 64) -> tuple[common.Written, np.ndarray]:
    """Encoded documents (key, y, x, f) dealt by key into blocks of about ``size`` (`BLOCK`), and the copies of either label.

    Documents of the rarer label are copied into several blocks, evenly, if a block would hold fewer than ``least`` of
    them, so that all others meet one, however rare it is; the copies are about ``least`` rows a block at most.
    """
    n = max(1, round(int(docs.sum()) / (size or BLOCK)))
    copies = np.minimum(n, np.maximum(1, -(-least * n // docs)))
    copies[docs > docs.min()] = 1
    times = F.when(F.col("y") == 1, int(copies[1])).otherwise(int(copies[0]))
    step = F.when(F.col("y") == 1, int(n // copies[1])).otherwise(int(n // copies[0]))
    spread = encoded.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    spread = spread.withColumn("block", F.pmod(F.pmod("key", F.lit(n)) + F.col("copy") * step, F.lit(n)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("y", "ascending")])
        f = table["f"].to_pylist()
        parts = {"y": table["y"].to_numpy().astype(np.int8), "own": table["copy"].to_numpy() == 0, "sizes": np.array([len(h) // 2 for h in f], dtype=np.int32)}
        whole = {"x": b"".join(table["x"].to_pylist()), "cols": b"".join(f)} | {k: v.tobytes() for k, v in parts.items()}
        return pa.table({k: pa.array([whole[k]], pa.binary()) for k in ("y", "own", "x", "sizes", "cols")})

    packed = spread.groupBy("block").applyInArrow(pack, "y binary, own binary, x binary, sizes binary, cols binary")
    return common.Written(packed), copies


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with quality (0 to 1) and good (1 where quality >= 0.5), replacing columns so named.

    Whole texts are scored where they lie. Null and empty texts have zero features and no gram, and get the score of that.
    """
    return toxicity.common_score(documents, model.logits, "quality").withColumn("good", (F.col("quality") >= 0.5).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, labels, ~common.held_out(3, 1, "_id"))
    scored = score(documents.select("doc_id", common.held_out(3, 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", F.col("quality").alias("score"), F.col("good").alias("predicted"))
