"""Token-id files: concatenated ids, with document boundaries in Elias-Fano code."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WORD_BPE, encoder

#: A segment ends after so many ids or documents; a longer document is a segment of its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 15
#: Every so many-th one of the upper bits has its place noted, for select.
EVERY = 256
#: Documents that a reader decodes at a time.
SLICE = 4_096


@dataclass
class EliasFano:
    """A non-decreasing sequence of ``n`` numbers up to ``top``, in about 2 + log2(top / n) bits each.

    The low ``bits`` bits of each are packed; the high parts are a bit vector with a one at (high part + index).
    ``hints`` holds the place of every 256th one, so that a value is selected by looking at a few dozen bytes.
    """

    n: int
    top: int
    low: bytes
    high: bytes
    hints: bytes

    @property
    def bits(self) -> int:
        return max(0, (self.top // max(self.n, 1)).bit_length() - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        made = cls(len(values), int(values[-1]) if len(values) else 0, b"", b"", b"")
        bits = made.bits
        places = (values >> bits) + np.arange(len(values))
        ones = np.zeros(int(places[-1]) + 1 if len(places) else 0, dtype=np.uint8)
        ones[places] = 1
        lows = (values[:, None] >> np.arange(bits)) & 1
        made.low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
        made.high = np.packbits(ones, bitorder="little").tobytes()
        made.hints = places[::EVERY].astype("<u4").tobytes()
        return made

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The values from the lo-th up to the hi-th, decoded from the hint before the first to the one after the last."""
        if lo >= hi:
            return np.zeros(0, dtype=np.int64)
        hints = np.frombuffer(self.hints, "<u4")
        after = -(-hi // EVERY)
        first, last = int(hints[lo // EVERY]), int(hints[after]) if after < len(hints) else len(self.high) * 8
        bits = np.unpackbits(np.frombuffer(self.high[first // 8 : -(-last // 8)], np.uint8), bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :])[lo % EVERY : lo % EVERY + hi - lo] + first
        return ((ones - np.arange(lo, hi)) << self.bits) | self._lows(lo, hi)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.slice(i, i + 1)[0])

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        bits = self.bits
        if not bits:
            return np.zeros(hi - lo, dtype=np.int64)
        first, last = lo * bits // 8, -(-hi * bits // 8)
        raw = np.unpackbits(np.frombuffer(self.low[first:last], np.uint8), bitorder="little")[lo * bits - first * 8 :]
        return raw[: (hi - lo) * bits].reshape(-1, bits).astype(np.int64) @ (1 << np.arange(bits))


FORMAT = "part int, seq int, part_start long, n_docs int, n_nulls int, n_ids long, width int, doc_ids binary, ids binary, low binary, high binary, hints binary"


def write(documents: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> common.Written:
    """Files of the ids of all ``documents`` (doc_id, text) in ascending doc_id order; a Parquet table of segments.

    Each text's ids are followed by ``end_id``; a null text has that one only. A segment holds whole documents: their
    ids one after the other (2 bytes each where all fit, else 4) and the Elias-Fano code of where each ends. The
    range partitioning on (doc_id, hash of the text) orders the parts, so the order of all ids is (part, seq, document),
    and texts that share an id are spread too. A null doc_id comes first. Spark's commit makes rewritten tasks harmless.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("hash"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        seq, before, docs, held, size = 0, 0, [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            kind = "<u2" if ids.max(initial=0) < 65_536 else "<u4"
            ends = EliasFano.of(np.cumsum([len(x) // 4 for x in held]))
            names = np.array([d for d in docs if d is not None], dtype="<i8")
            row = (part, seq, before, len(docs), len(docs) - len(names), len(ids), int(kind[2]), names.tobytes(), ids.astype(kind).tobytes(), ends.low, ends.high, ends.hints)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in FORMAT.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), codes.encoded(common.text_bytes(batch.column("text"))), strict=True):
                ids += end
                if docs and (size + len(ids) // 4 > SEGMENT_IDS or len(docs) >= SEGMENT_DOCS):
                    yield segment()
                    seq, before, docs, held, size = seq + 1, before + size, [], [], 0
                docs.append(doc)
                held.append(ids)
                size += len(ids) // 4
        codes.rest()
        if docs:
            yield segment()

    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return common.Written(ordered.mapInArrow(run, FORMAT))


def _bases(segments: DataFrame) -> dict[int, int]:
    """The ids before each part; one sum for each part goes through the driver."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    return dict(zip((r.part for r in totals), np.cumsum([0, *(r.n for r in totals)]).tolist(), strict=False))


def _code(batch: pa.RecordBatch, r: int) -> EliasFano:
    return EliasFano(*(batch.column(c)[r].as_py() for c in ("n_docs", "n_ids", "low", "high", "hints")))


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each document in files that `write` made; ids as little-endian 32-bit integers.

    ``start`` counts all ids before the document: those of earlier parts, of the part's earlier segments, and of the
    segment up to the boundary before. Documents of a segment are taken some thousands at a time.
    """
    base = _bases(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, n, nulls, width = (batch.column(c)[r].as_py() for c in ("part", "part_start", "n_docs", "n_nulls", "width"))
                code, start = _code(batch, r), start + base[part]
                docs = [*[None] * nulls, *np.frombuffer(batch.column("doc_ids")[r].as_buffer(), dtype="<i8").tolist()]
                ids, at = np.frombuffer(batch.column("ids")[r].as_buffer(), dtype=f"<u{width}"), 0
                for lo in range(0, n, SLICE):
                    ends = code.slice(lo, min(lo + SLICE, n))
                    cuts = np.r_[at, ends]
                    flat = ids[at : cuts[-1]].astype("<u4")
                    texts = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(((cuts - at) * 4).astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(docs[lo : lo + SLICE], pa.int64()), pa.array(cuts[:-1] + start), texts], ["doc_id", "start", "ids"])
                    at = int(cuts[-1])

    return segments.mapInArrow(run, "doc_id long, start long, ids binary")


def offsets(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens) of the documents in ``wanted`` (doc_id), without reading any ids.

    The segments' lists of doc_ids are joined with ``wanted``; each segment then selects the boundaries asked of it.
    A repeated id gives a row for each of its documents; a null or unknown one gives none.
    """
    base = _bases(segments)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, nulls, docs in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "n_nulls", "doc_ids")), strict=True):
                docs = np.frombuffer(docs, dtype="<i8")
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, seq, dtype=np.int32)), pa.array(np.arange(nulls, nulls + n, dtype=np.int32))], ["doc_id", "part", "seq", "place"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                code, asked = _code(batch, r), batch.column("asked")[r].as_py()
                start = base[batch.column("part")[r].as_py()] + batch.column("part_start")[r].as_py()
                cuts = [(code.select(a["place"] - 1) if a["place"] else 0, code.select(a["place"])) for a in asked]
                rows = [(a["doc_id"], start + lo, hi - lo) for a, (lo, hi) in zip(asked, cuts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens"])

    listed = segments.select("part", "seq", "n_nulls", "doc_ids").mapInArrow(places, "doc_id long, part int, seq int, place int")
    asked = listed.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "place")).alias("asked"))  # at most a segment's documents
    codes = segments.select("part", "seq", "part_start", "n_docs", "n_ids", "low", "high", "hints")
    return codes.join(asked, ["part", "seq"]).drop("seq").mapInArrow(chosen, "doc_id long, start long, n_tokens long")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = read(write(documents).df)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
