"""Language identification: known words by log frequency, backing off to shorter character n-grams for others."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common



def _class_of(kinds: str) -> str:
    """The inside of a character class: all code points whose general category begins with one of ``kinds``."""
    held = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    firsts = [c for c, before in zip(held, [-2, *held], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(held, [*held[1:], -2], strict=True) if c != after - 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts, strict=True))


#: A word: a letter of any script, and the letters and marks that follow it. Numbers of any kind are no letters.
WORD = re.compile(f"[{_class_of('L')}][{_class_of('LM')}]*")
#: The same for texts without marks and without numbers other than digits, found several times as fast.
PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: What may be a mark or such a number: all but the first three Unicode blocks and common punctuation.
NOT_PLAIN = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0250-\u1fff\u2070-\u20ab\u20ad-\U0010ffff]")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (WORD if NOT_PLAIN.search(text) else PLAIN_WORD).findall(text)
WORD_KIND = 0
UND = "und"
#: Words that a worker remembers, and weights (words by languages) that it keeps for them and makes at a time.
REMEMBER, WEIGHTS, STEP = 200_000, 8_000_000, 1_000_000


@dataclass
class Rows:
    """Log weights of entries in each language: ``base`` where a language lacks the entry, else ``base`` plus a gain.

    Entry i has the languages ``cols`` and ``gains`` from ``starts[i]`` to ``starts[i + 1]``, so the size follows the
    counts above 0 and not entries times languages. An index of entries gives a row for each.
    """

    base: np.ndarray
    starts: np.ndarray
    cols: np.ndarray
    gains: np.ndarray

    def __getitem__(self, at: list[int]) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        sizes = self.starts[at + 1] - self.starts[at]
        found = common.concat_ranges(self.starts[at], sizes)
        out = np.tile(self.base, (len(at), 1))
        out[np.repeat(np.arange(len(at)), sizes), self.cols[found]] += self.gains[found]
        return out


@dataclass
class Model:
    """``tables[0]`` has words and ``tables[n]`` the n-grams of padded words; each entry is a row of ``logs[n]``."""

    langs: list[str]
    prior: np.ndarray
    tables: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray | Rows]
    orders: tuple[int, ...]
    memo: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "rows": None}

    def weights(self, words: list[str]) -> np.ndarray:
        """Log weights of words in each language, a row each: a word's own if known, else of the longest n-grams known."""
        try:
            at = list(map(self.memo.__getitem__, words))
        except KeyError:
            self.learn(words)
            at = list(map(self.memo.__getitem__, words))
        return self.rows[at]

    def learn(self, words: list[str]) -> None:
        """Remember words that are new; the memo of pure results starts anew when it is full."""
        if self.rows is None or len(self.memo) + len(words) > len(self.rows):
            self.memo.clear()
            self.rows = np.zeros((max(min(REMEMBER, WEIGHTS // len(self.langs)), len(words)), len(self.langs)), dtype=np.float32)
        known, taken = self.tables[WORD_KIND], {n: ([], [], []) for n in (WORD_KIND, *self.orders)}
        for word in words:
            if word in self.memo:
                continue
            row = self.memo[word] = len(self.memo)
            at = known.get(word)
            if at is not None:
                n, hits = WORD_KIND, (at,)
            else:
                padded = f" {word} "
                for n in self.orders:
                    table = self.tables[n]
                    hits = [table[g] for g in map(padded.__getitem__, map(slice, range(len(padded) - n + 1), range(n, len(padded) + 1))) if g in table]
                    if hits:
                        break
                else:
                    continue
            rows, sizes, entries = taken[n]
            rows.append(row)
            sizes.append(len(hits))
            entries.extend(hits)
        for n, (rows, sizes, entries) in taken.items():
            if rows:
                sizes = np.array(sizes)
                sums = np.add.reduceat(self.logs[n][entries], np.cumsum(sizes) - sizes, axis=0)
                self.rows[rows] = sums / sizes[:, None]


def grams(word: str, orders: tuple[int, ...]) -> Iterator[tuple[int, str]]:
    padded = f" {word} "
    for n in orders:
        for i in range(len(padded) - n + 1):
            yield n, padded[i : i + n]


def fit(documents: DataFrame, usable, per_lang: int = 1_500, entries: int = 40_000, orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """Learn from text and non-null lang of rows where ``usable`` holds.

    Of every language a hash-seeded share of the rows is read, ``per_lang`` in expectation (all of them, if there are
    fewer). Counts are aggregated by Spark; of each kind (words seen 3 times, and n-grams of each order) the
    ``entries`` commonest of each language are kept, with their counts in all languages, so a language keeps its own however rare it is.
    The model is bounded by the parameters and grows with the number of languages.
    """
    rows = documents.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r["lang"] for r in known)
    if not langs:
        return Model([], np.zeros(0), {k: {} for k in (WORD_KIND, *orders)}, {k: np.zeros((0, 0)) for k in (WORD_KIND, *orders)}, orders)
    rates = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in known], "lang string, rate double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(rates), "lang").where(chance < F.col("rate")).select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), common.text_bytes(batch.column("text")), strict=True):
                words.update((lang, w) for w in words_of(text.decode("utf-8", "replace")))
        counts: Counter = Counter()
        for (lang, w), c in words.items():
            counts[lang, WORD_KIND, w] += c
            for n, g in grams(w, orders):
                counts[lang, n, g] += c
        items = list(counts.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], ["lang", "kind", "gram", "n"])

    counted = common.Written(sample.mapInArrow(count, "lang string, kind int, gram string, n long").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")))
    totals = {(r.kind, r.lang): r.n for r in counted.df.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    tables, logs = {}, {}
    alike, least = Window.partitionBy("kind", "gram"), F.when(F.col("kind") == WORD_KIND, 3).otherwise(1)
    usual = counted.df.withColumn("all", F.sum("n").over(alike)).where(F.col("all") >= least)
    ranked = usual.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "gram")))
    kept = common.Written(ranked.withColumn("best", F.min("rank").over(alike)).where(F.col("best") <= entries).select("kind", "gram", "lang", "n"))
    for kind in (WORD_KIND, *orders):
        got = kept.df.where(F.col("kind") == kind).select("gram", "lang", "n").toArrow().sort_by([("gram", "ascending"), ("lang", "ascending")])
        # sorted, so that equal grams are neighbours
        grams_of = got["gram"].to_pylist()
        firsts = [i for i, g in enumerate(grams_of) if not i or g != grams_of[i - 1]]
        tables[kind] = {grams_of[i]: at for at, i in enumerate(firsts)}
        total = np.array([totals.get((kind, lang), 0) for lang in langs], dtype=float)
        base = np.log(0.1 / (total + 0.1 * max(len(firsts), 1))).astype(np.float32)
        cols = pc.index_in(got["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int32)
        logs[kind] = Rows(base, np.array([*firsts, len(grams_of)]), cols, np.log(10.0 * got["n"].to_numpy() + 1.0).astype(np.float32))
    counted.drop()
    kept.drop()
    return Model(langs, np.zeros(len(langs)), tables, logs, orders)


def identify(text: str, model: Model) -> tuple[str, float]:
    """The likeliest language and its share of the likelihood; ("und", 0.0) without a letter or a model."""
    words = words_of(text)
    if not words or not model.langs:
        return UND, 0.0
    counts = Counter(words)
    total = model.prior.copy()
    weight = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    listed, step = list(counts), max(1, STEP // len(model.langs))
    for i in range(0, len(listed), step):
        total += weight[i : i + step] @ model.weights(listed[i : i + step])
    best = int(total.argmax())
    return model.langs[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def predict(documents: DataFrame, model: Model, keep: bool = True) -> DataFrame:
    """``documents`` with lang_pred and lang_score, replacing columns so named; whole texts, no shuffle.

    A null text, or one without a letter, gets ``und`` and 0.0. Equal scores go to the language first by code
    point. Repeated rows each get the same answer. With ``keep``, a worker keeps the words it has met for its next task,
    which is faster; without, it gives that memory back.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by `entries` and orders for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [identify(x.decode("utf-8", "replace"), model) for x in common.text_bytes(batch.column("_bytes"))]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "lang_score"])
        if not keep:
            model.memo, model.rows = {}, None

    rest = documents.drop("lang_pred", "lang_score", "_bytes")
    out = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return rest.withColumn("_bytes", F.col("text").cast("binary")).mapInArrow(run, out)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir)
    model = fit(documents.select("doc_id", "lang", "text"), ~common.held_out(4, 2))
    scored = predict(documents.select("doc_id", common.held_out(4, 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
