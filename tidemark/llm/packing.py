"""Packing token ids into training windows online, with a bounded number of open windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WORD_BPE, encoder

#: A piece: document, start, ids (4 bytes each), ids of its document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Best-fit packing with at most ``windows`` open windows of ``size`` ids; finished windows are yielded.

    A piece goes to the open window with the least room that holds it. If none does and another may be opened, one
    is; else the fullest is emitted, its last gap filled with the piece's beginning, so an emitted window has no
    padding. At the end the open windows are merged: the emptiest is cut to fill the fullest until one is left, and
    that one stays open or is cut at powers of two.
    """

    def __init__(self, size: int = 2048, windows: int = 64):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, int, list[Piece]]] = []  # (room, number, pieces), by room
        self.made = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            yield [(doc, at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        if at < total:
            yield from self.place((doc, at, ids[4 * at :], total))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        need = len(piece[2]) // 4
        at = bisect_left(self.open, (need,))
        if at < len(self.open):
            room, number, pieces = self.open.pop(at)
            pieces.append(piece)
            if room == need:
                yield pieces
            else:
                insort(self.open, (room - need, number, pieces))
        elif len(self.open) < self.windows:
            self.made += 1
            insort(self.open, (self.size - need, self.made, [piece]))
        else:
            room, _, pieces = self.open.pop(0)
            doc, start, ids, total = piece
            yield [*pieces, (doc, start, ids[: 4 * room], total)]
            yield from self.place((doc, start + room, ids[4 * room :], total))

    def merge(self) -> Iterator[list[Piece]]:
        """Full windows of what is open; at most one window stays open."""
        left = [[room, pieces] for room, _, pieces in self.open]
        self.open = []
        while len(left) > 1:
            room, pieces = left.pop(0)
            while room and left:
                doc, start, ids, total = left[-1][1].pop()
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    left[-1][1].append((doc, start + n, ids[4 * n :], total))
                elif not left[-1][1]:
                    left.pop()
            if room:
                left.append([room, pieces])
                break
            yield pieces
        for room, pieces in left:
            self.made += 1
            self.open.append((room, self.made, pieces))

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.merge()
        for _, _, pieces in self.open:
            yield from powers_of_two(pieces)
        self.open = []


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces cut into windows whose sizes are powers of two, the largest first: none needs padding."""
    left = sum(len(p[2]) // 4 for p in pieces)
    queue = pieces[::-1]
    while left:
        take = 1 << (left.bit_length() - 1)
        left -= take
        window = []
        while take:
            doc, start, ids, total = queue.pop()
            n = min(take, len(ids) // 4)
            window.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                queue.append((doc, start + n, ids[4 * n :], total))
            take -= n
        yield window


def pack(documents: DataFrame, size: int = 2048, windows: int = 64, tokenizer: str = WORD_BPE, end_id: int = 1, fan: int = 1024, keep: bool = True) -> DataFrame:
    """A row for each piece of ``documents`` (doc_id, text) in the windows: the training sequences themselves.

    doc_id, start (ids of its document before it), length, ids (little-endian 32-bit), doc_tokens (with ``end_id``,
    that ends each document), sequence_id, offset (ids before it in its window). Every partition is packed where
    it lies, with at most ``windows`` open windows, so memory doesn't grow with the partition, and written. Its last
    leftover, under ``size`` ids, is merged with those of about ``fan`` partitions in a task, and so on with what
    these leave until a single task is left; only leftovers are shuffled. Sequence ids hold the partition in their
    upper bits and the round of merging below. A null or empty text is its end id alone. Repeated rows are packed
    each. Windows are of ``size`` ids but for up to log2(size) of the whole table, which hold a power of two; none
    holds padding. ``size`` should be a power of two itself. With ``keep``, a worker keeps what it has learnt of words
    for its next task, which is faster; without, it gives that memory back.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    done = common.Written(texts.mapInArrow(_packed(size, windows, tokenizer, end_id, 0, False, keep), ROWS)).df
    out, turn = done.where("NOT left").select(*NAMES), 0
    while parts := done.where("left").select("part").distinct().count():
        turn, last = turn + 1, parts <= fan
        left = done.where("left").select("part", *NAMES)
        left = left.repartition(1) if last else left.repartition(-(-parts // fan), "part")
        done = common.Written(left.sortWithinPartitions("part", "offset").drop("part").mapInArrow(_packed(size, windows, tokenizer, end_id, turn, last, keep), ROWS)).df
        out = out.union(done.where("NOT left").select(*NAMES))
    return out


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
ROWS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part int, left boolean"


def _packed(size: int, windows: int, tokenizer: str, end_id: int, turn: int, last: bool, keep: bool):
    """Packs a partition: texts in turn 0, else pieces that were left; ``last`` cuts what it leaves itself."""
    names = [*NAMES, "part", "left"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, end = TaskContext.get().partitionId(), Packer(size, windows), np.array([end_id], dtype="<u4").tobytes()
        number, rows, held = (part << 40) + (turn << 36), [], 0

        def windows_of() -> Iterator[tuple[list[Piece], bool]]:
            codes = None if turn else encoder(tokenizer)
            for batch in batches:
                if turn:
                    for piece in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True):
                        yield from ((w, False) for w in packer.place(piece))
                    continue
                texts = common.text_bytes(batch.column("text"))
                for doc, ids in zip(batch.column("doc_id").to_pylist(), codes.encoded(texts), strict=True):
                    yield from ((w, False) for w in packer.add(doc, ids + end))
            if codes:
                codes.rest(keep)
            yield from ((w, False) for w in (packer.finish() if last else packer.merge()))
            yield from ((pieces, True) for _, _, pieces in packer.open)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for window, left in windows_of():
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, ids, total, number, offset, part, left))
                offset += len(ids) // 4
            number, held = number + 1, held + offset
            if held > 1 << 19:
                yield flushed()
                rows, held = [], 0
        if rows:
            yield flushed()

    return run


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
