"""Suffix-array dedup: long repeated substrings, by refining buckets of suffixes with hashes of their own bytes.

Suffixes that share an anchor share a bucket: of the q-grams in a window of `length` bytes, a quarter as long as it, the
one with the smallest hash is its anchor, so equal windows have equal anchors at equal places. Buckets are refined at
fixed levels (runs of suffixes, groups of them, single ones) by hashes of more of the suffix's own bytes. This replaces
bucket pointers: no bucket of a suffix some bytes later is looked up or reused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_TABLE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
U = np.uint64
#: Bytes of text that one pass takes at a time; it holds some 100 bytes for each.
PASS_BYTES = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PASS_BYTES)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


class Rolled:
    """Hashes of any substring of a buffer, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[buf] * self.up[: len(buf)], out=self.sums[1:])

    def windows(self, q: int) -> np.ndarray:
        h = self.sums[q:] - self.sums[:-q]
        return common.mixed(h * self.down[: len(h)])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return common.mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive keys, from running minima of blocks of ``w``."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, q: int) -> dict[str, np.ndarray]:
    """Runs of suffixes with one anchor in texts [starts, ends) of a buffer.

    For each run: the text it lies in, its first and last suffix and its anchor within the text, the bucket of the
    anchor's q-gram, and a hash of all bytes that the suffixes' windows cover.
    """
    rolled = Rolled(buf)
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < length:
        return {"text": none, "first": none, "last": none, "anchor": none, "bucket": none.astype(np.uint64), "whole": none.astype(np.uint64)}
    grams = rolled.windows(q)
    bits = U(max(20, int(len(grams)).bit_length()))
    place = (U(1) << bits) - U(1)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
    anchor = (least & place).astype(np.int64)
    sizes = np.maximum(ends - starts - length + 1, 0)
    at = common.concat_ranges(starts, sizes)
    text = np.repeat(np.arange(len(starts)), sizes)
    if not len(at):
        return {"text": none, "first": none, "last": none, "anchor": none, "bucket": none.astype(np.uint64), "whole": none.astype(np.uint64)}
    own = anchor[at]
    turn = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
    lo, hi = np.r_[0, turn], np.r_[turn, len(at)] - 1
    first, last, text = at[lo], at[hi], text[lo]
    return {"text": text, "first": first - starts[text], "last": last - starts[text], "anchor": own[lo] - starts[text], "bucket": grams[own[lo]], "whole": rolled.spans(first, last + length)}


def _packed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi in common.chunks(texts, PASS_BYTES):
        sizes = np.array([len(x) for x in texts[lo:hi]], dtype=np.int64)
        ends = np.cumsum(sizes)
        yield lo, np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8), ends - sizes, ends


def _keyed(df: DataFrame) -> DataFrame:
    """With a key for each different row: its id and a hash of its text. Rows equal in both are judged alike."""
    return df.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_h", F.xxhash64(F.col("text").cast("binary"))).withColumn("_bytes", F.col("text").cast("binary"))


def _squeezed(df: DataFrame) -> DataFrame:
    """``df`` with _bytes replaced by z, the same compressed, so that a shuffle moves less."""
    names = [c for c in df.columns if c != "_bytes"]
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress(x) for x in common.text_bytes(batch.column("_bytes"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), z], [*names, "z"])

    return df.select(*names, "_bytes").mapInArrow(run, schema)


def _settle(rows: DataFrame, ref: list[str], write) -> tuple[DataFrame, DataFrame]:
    """Rows that are repeated whole, and one row of each class that has to be refined.

    Rows of a bucket (k1, k2) with equal ``f`` are one class. A class of several rows is settled: it repeats. A
    bucket of one class is settled too. Classes that share a bucket with others are refined, one row standing for
    all. Counts are aggregated before the shuffle and joined back from a written table, so that AQE can split the
    rows of a key that is everywhere.
    """
    classes = write(rows.groupBy("k1", "k2", "f").agg(F.count("*").alias("n"), F.min(F.struct(*ref)).alias("ref")))
    again = write(classes.where("n > 1").select("k1", "k2", "f"))
    crowded = write(classes.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2"))
    return rows.join(again, ["k1", "k2", "f"], "left_semi").select(*ref), classes.join(crowded, ["k1", "k2"], "left_semi").select("k1", "ref.*")


def repeated(keyed: DataFrame, length: int = 400, step: int = 16) -> common.Written:
    """(_id, _h, spans) of each text of ``keyed`` (_id, _h, _bytes) that has some: its repeated runs of bytes.

    A window is ``length`` bytes of one text; it is repeated if equal bytes start anywhere else. spans are the
    ranges (lo, hi) that repeated windows cover, merged and in order: no more than a text has room for. Buckets are refined
    three times, each time only where they hold different classes:

    0. Each text gives its runs of suffixes by anchor. Anchors that occur once are dropped by a count. In the
       others' buckets, runs that are equal in all their bytes repeat.
    1. Of runs that share a bucket but differ, ``step`` suffixes at a time go on. Their next bucket is (bucket, bytes
       that all their windows hold). If all bytes of all their windows occur again, all of them repeat.
    2. Of the rest each suffix goes on alone: (bucket, all ``length`` bytes).

    Equal windows share their anchor at the same distance, hence every bucket, and are never separated. The result is
    written, so that what was written on the way can go.
    """
    q = max(length // 4, 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("_id"), batch.column("_h")
            for lo, buf, starts, ends in _packed(common.text_bytes(batch.column("_bytes"))):
                r = runs(buf, starts, ends, length, q)
                rows = pa.array(r["text"] + lo)
                small = [pa.array(r[c].astype(np.int32)) for c in ("first", "last", "anchor")]
                yield pa.RecordBatch.from_arrays([pa.array(r["bucket"].view(np.int64)), pa.array(r["whole"].view(np.int64)), ids.take(rows), hashes.take(rows), *small], ["k1", "f", "_id", "_h", "first", "last", "anchor"])

    steps = common.Steps()
    write = steps.write
    found = common.Written(keyed.select("_id", "_h", "_bytes").mapInArrow(find, "k1 long, f long, _id long, _h long, first int, last int, anchor int"))
    shared = write(found.df.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1"))
    alike = write(found.df.join(shared, "k1", "left_semi").withColumn("k2", F.lit(0).cast("long")))
    found.drop()
    settled, open_runs = _settle(alike, ["_id", "_h", "first", "last", "anchor"], write)
    spans = [settled.select("_id", "_h", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))]

    asked = write(open_runs.groupBy("_id", "_h").agg(F.collect_list(F.struct("k1", "first", "last", "anchor")).alias("runs")))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpress.decompress(batch.column("z")[i].as_py())
                k1, first, last, anchor = (batch.column("runs")[i].values.field(f) for f in ("k1", "first", "last", "anchor"))
                parts = [text[a : b + length] for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                ids = [pa.array(np.full(len(k1), batch.column(c)[i].as_py(), dtype=np.int64)) for c in ("_id", "_h")]
                yield pa.RecordBatch.from_arrays([*ids, k1, first, anchor, pa.array(parts, pa.binary())], ["_id", "_h", "k1", "first", "anchor", "part"])

    texts = _squeezed(keyed.select("_id", "_h", "_bytes"))
    parts = asked.join(texts, ["_id", "_h"]).mapInArrow(cut_out, "_id long, _h long, k1 long, first int, anchor int, part binary")
    # a row that is there twice gives its runs twice, and one of each is enough
    parts = write(parts.groupBy("_id", "_h", "first").agg(F.first("k1").alias("k1"), F.first("anchor").alias("anchor"), F.first("part").alias("part")).withColumn("run", F.monotonically_increasing_id()))
    where = parts.select("run", "_id", "_h", "first")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("anchor")) - np.asarray(batch.column("first"))
            for lo, buf, starts, ends in _packed(batch.column("part").to_pylist()):
                rolled, from_ = Rolled(buf), place[lo : lo + len(starts)]
                count = ends - starts - length + 1
                # groups begin at distances from the anchor that are multiples of step, whatever the run
                low, high = -from_ // step, (count - 1 - from_) // step
                text = np.repeat(np.arange(len(starts)), high - low + 1)
                grid = common.concat_ranges(low, high - low + 1) * step + from_[text]
                a, b = np.maximum(grid, 0), np.minimum(grid + step, count[text]) - 1
                at = starts[text]
                core = common.mixed(rolled.spans(at + grid + step - 1, at + grid + length) + (grid - from_[text]).astype(np.uint64))
                full = common.mixed(rolled.spans(at + a, at + b + length) + (a - from_[text]).astype(np.uint64))
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), batch.column("run").take(rows), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["k1", "k2", "f", "run", "a", "b"])

    groups = write(parts.select("k1", "run", "first", "anchor", "part").mapInArrow(spread, "k1 long, k2 long, f long, run long, a int, b int"))
    settled, open_groups = _settle(groups, ["run", "a", "b"], write)
    by_run = [settled]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("anchor")) - np.asarray(batch.column("first"))
            for lo, buf, starts, _ in _packed(batch.column("part").to_pylist()):
                rolled = Rolled(buf)
                lists = batch.column("todo").slice(lo, len(starts))
                text = np.repeat(np.arange(len(starts)), np.asarray(lists.value_lengths()))
                pairs = lists.flatten()
                a, b = (np.asarray(pairs.field(f)).astype(np.int64) for f in ("a", "b"))
                text, a = np.repeat(text, b - a + 1), common.concat_ranges(a, b - a + 1)
                window = common.mixed(rolled.spans(starts[text] + a, starts[text] + a + length) + (a - place[lo : lo + len(starts)][text]).astype(np.uint64))
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), pa.array(window.view(np.int64)), batch.column("run").take(rows), pa.array(a.astype(np.int32))], ["k1", "k2", "run", "a"])

    todo = open_groups.groupBy("run").agg(F.collect_list(F.struct("a", "b")).alias("todo"))
    alone = write(parts.join(todo, "run").select("k1", "run", "first", "anchor", "part", "todo").mapInArrow(single, "k1 long, k2 long, run long, a int"))
    twice = write(alone.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    by_run.append(alone.join(twice, ["k1", "k2"], "left_semi").select("run", "a", F.col("a").alias("b")))
    fine = by_run[0].union(by_run[1]).join(where, "run").select("_id", "_h", (F.col("first") + F.col("a")).alias("lo"), (F.col("first") + F.col("b") + length).alias("hi"))
    return steps.last(_merged(spans[0].union(fine)))


def _merged(ranges: DataFrame) -> DataFrame:
    """(_id, _h, spans) from rows (_id, _h, lo, hi): the union of each text's ranges, as ranges that don't touch."""
    text = Window.partitionBy("_id", "_h").orderBy("lo")
    before = F.max("hi").over(text.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    whole = marked.withColumn("run", F.sum("new").over(text)).groupBy("_id", "_h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def within(keyed: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """What ``repeated`` gives for ``length``, looked for only in ``spans``, the runs that a smaller length gave.

    A repeated window lies within one of those runs, since each shorter window in it repeats too. Only runs of
    ``length`` bytes and more are cut out and searched, as texts of their own.
    """
    long = spans.withColumn("spans", F.filter("spans", lambda s: s["hi"] - s["lo"] >= length)).where("size(spans) > 0")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text, held = unpress.decompress(batch.column("z")[i].as_py()), batch.column("spans")[i].values
                lo, hi = held.field("lo"), held.field("hi")
                ids = [pa.array(np.full(len(lo), batch.column(c)[i].as_py(), dtype=np.int64)) for c in ("_id", "_h")]
                yield pa.RecordBatch.from_arrays([*ids, lo, pa.array([text[a:b] for a, b in zip(lo.to_pylist(), hi.to_pylist(), strict=True)], pa.binary())], ["_id", "_h", "lo", "_bytes"])

    cut = _squeezed(keyed.select("_id", "_h", "_bytes")).join(long, ["_id", "_h"]).select("_id", "_h", "z", "spans").mapInArrow(cut_out, "_id long, _h long, lo int, _bytes binary")
    parts = common.Written(cut.withColumn("_text", F.col("_h")).withColumn("_h", F.xxhash64("_text", "lo"))).df
    places = parts.select("_id", "_h", "_text", "lo").distinct()
    found = repeated(parts.select("_id", "_h", "_bytes"), length).df.join(places.withColumnRenamed("lo", "at"), ["_id", "_h"])
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("at")).alias("lo"), (s["hi"] + F.col("at")).alias("hi")))
    # runs of one text don't touch, so theirs don't either
    return found.withColumn("spans", moved).groupBy("_id", F.col("_text").alias("_h")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


SPANS = "array<struct<lo:int,hi:int>>"


def _cut(documents: DataFrame, columns: dict[str, DataFrame], removed: str, as_text: bool, words: int | None = None, enough: int = 0) -> DataFrame:
    """``documents`` (text excepted) with n_bytes, the spans of each of ``columns`` and kept, the bytes out of ``removed``.

    With ``words``, runs of the first of ``columns`` count only if they hold so many words or ``enough`` bytes.
    """
    names = list(columns)
    own = ["n_bytes", *names, "kept"]
    rest = [c for c in documents.columns if c not in ("text", "_id", "_h", "_bytes", "z", *own)]
    texts = _squeezed(_keyed(documents.select(*rest, "text")).select(*rest, "_id", "_h", "_bytes"))
    for name, spans in columns.items():
        texts = texts.join(spans.withColumnRenamed("spans", name), ["_id", "_h"], "left")
    kept_type = T.StringType() if as_text else T.BinaryType()
    out = T.StructType([*documents.select(*rest).schema.fields, T.StructField("n_bytes", T.LongType()), *[T.StructField(c, T._parse_datatype_string(SPANS)) for c in columns], T.StructField("kept", kept_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            sizes, found, kept = [], {c: [] for c in names}, []
            for i in range(batch.num_rows):
                text = unpress.decompress(batch.column("z")[i].as_py())
                sizes.append(len(text))
                for c in names:
                    spans = batch.column(c)[i].as_py() or []
                    if words is not None and c == names[0]:
                        spans = [s for s in spans if s["hi"] - s["lo"] >= enough or len(text[s["lo"] : s["hi"]].split()) >= words]
                    found[c].append(spans)
                gone = found[removed][-1]
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(s["hi"] for s in gone)], [*(s["lo"] for s in gone), len(text)], strict=True)) if gone else text)
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), *(pa.array(found[c], kind) for c in names), left], [*rest, *own])

    return texts.select(*rest, "z", *columns).mapInArrow(run, out)


def dedup(documents: DataFrame, length: int = 400, as_text: bool = False) -> DataFrame:
    """``documents`` (text excepted) with n_bytes, spans (the removed ranges of bytes, merged) and kept (other bytes).

    Bytes are those of the text in UTF-8; a null text is empty. Texts shorter than ``length`` keep all. Rows that
    repeat a text remove each other's, an exact copy in full. Every row returns; columns so named are replaced.
    Spans are found with 128-bit keys of two 64-bit hashes of the bytes. With ``as_text``, kept is a string: where a
    span ends within a character, what is left of the character goes too.
    """
    found = repeated(_keyed(documents.select("doc_id", "text")), length).df
    return _cut(documents, {"spans": found}, "spans", as_text)


def dedup_passages(documents: DataFrame, least: int = 200, words: int = 51, enough: int = 400, as_text: bool = False) -> DataFrame:
    """``documents`` without their repeated passages: as ``dedup``, with passages in place of spans.

    A passage is a run of bytes covered by strings of ``least`` bytes that repeat, if it holds ``words`` words (parts
    at its ends count) or ``enough`` bytes. Shorter runs, such as a formula of a few dozen words, stay.
    """
    found = repeated(_keyed(documents.select("doc_id", "text")), least).df
    return _cut(documents, {"passages": found}, "passages", as_text, words, enough)


def dedup_both(documents: DataFrame, length: int = 400, least: int = 200, words: int = 51) -> DataFrame:
    """What ``dedup`` gives for ``length``, and the passages that ``dedup_passages`` would remove, in one search.

    Strings of ``length`` bytes are looked for only where those of ``least`` bytes, fewer than ``length``, repeat.
    """
    keyed = _keyed(documents.select("doc_id", "text")).select("_id", "_h", "_bytes")
    short = repeated(keyed, least).df
    found = within(keyed, short, length)
    return _cut(documents, {"passages": short, "spans": found}, "spans", False, words, length)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    found = dedup_both(documents)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), size("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("passages").alias("n_passages"))
