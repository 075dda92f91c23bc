"""Token ids of whole texts with a public tokenizer, each different piece of text encoded by the library once."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from . import common

#: The vocabulary file by its public name; a path works as well.
WORD_BPE = "word_bpe_49k.json"
#: Chunks of each generation, and pieces, that a worker remembers: some 150 bytes each, kept between tasks.
REMEMBER = 300_000
#: New pieces that go to the library in one text.
TOGETHER = 200
_MADE: dict[str, Encoder] = {}
#: Chunks whose pieces are plain to see: ASCII without apostrophes and angle brackets, and letters of Latin-1.
PLAIN = re.compile("[\x00-&(-;=-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Their pieces, in lower case: runs of letters, single digits, runs of what else isn't blank.
PIECE = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t-\ra-z0-9\xdf-\xf6\xf8-\xff]+")
#: What marks the last token of a piece.
WORD_END = "</w>"


def path_of(name: str) -> str:
    """A tokenizer's file: ``name`` itself if it is a path, else that of the public file so named."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes without special tokens. For tokenizers of lower-cased pieces that never hold blanks and end in a mark.

    The ids of a text are those of its chunks between ASCII blanks, one after the other. Text repeats most of its
    chunks, so each is looked up and, if new, encoded. The pieces of a plain chunk, a word and its punctuation, are
    found here, and the library encodes each piece once; it takes other chunks apart itself.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path_of(name))
        self.merge = self.tokenizer.model.tokenize
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(WORD_END)
        self.pieces: dict[str, bytes] = {}
        self.chunks = Memo()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; an empty text has none.

        Give many texts at once, some MB of them: what is new in any of them goes to the library together.
        """
        known = self.chunks
        known.turn()
        # the vocabulary is lower case; a special token's name, in angle brackets, only counts as written
        get, out, late = known.__getitem__, [], []
        for raw in texts:
            before, chunks = len(known.new), (raw if b"<" in raw else raw.lower()).split()
            ids = list(map(get, chunks))
            if len(known.new) > before:
                late.append((len(out), ids, [(i, chunks[i]) for i, found in enumerate(ids) if not found]))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if late:
            self.learn_chunks(list(dict.fromkeys(known.new)))
            known.new = []
            for at, ids, missing in late:
                for i, chunk in missing:
                    ids[i] = known[chunk]
                out[at] = b"".join(ids)
        return out

    def encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text in turn, about a megabyte of text encoded at a time."""
        for lo, hi in common.chunks(texts):
            yield from self.encode(texts[lo:hi])

    def rest(self, keep: bool = True) -> None:
        """Keep one generation of chunks only, or nothing: a worker outlives its task and does other things next."""
        self.pieces = {}
        self.chunks.old = {}
        if not keep:
            self.chunks = Memo()

    def learn_pieces(self, new: list[str]) -> None:
        others = []
        for piece in new:
            if piece.isascii() and piece.isprintable():  # the library's steps before merging leave it as it is
                ids = [t.id for t in self.merge(piece)]
                self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(piece)
        groups = [others[i : i + TOGETHER] for i in range(0, len(others), TOGETHER)]
        got = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, got, strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(group) or len(ids) * 4 != stops[-1]:
                raise ValueError("this tokenizer doesn't mark the ends of pieces")
            raw, start = ids.tobytes(), 0
            for piece, stop in zip(group, stops.tolist(), strict=True):
                self.pieces[piece], start = raw[start:stop], stop

    def learn_chunks(self, new: list[bytes]) -> None:
        plain, pieces, others = [], [], []
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            if PLAIN.fullmatch(text):
                plain.append(chunk)
                pieces.append(PIECE.findall(text.lower()))
            else:
                others.append((chunk, text))
        if len(self.pieces) > REMEMBER:
            self.pieces.clear()
        known = self.pieces
        self.learn_pieces(list(dict.fromkeys(x for found in pieces for x in found if x not in known)))
        self.chunks.update(zip(plain, [known[f[0]] if len(f) == 1 else b"".join([known[x] for x in f]) for f in pieces], strict=True))
        if others:
            got = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
            for (chunk, _), encoded in zip(others, got, strict=True):
                self.chunks[chunk] = np.array(encoded.ids, dtype="<u4").tobytes()


class Memo(dict):
    """What is known of chunks; one that isn't counts as nothing for now and is noted in ``new``.

    Two generations: when this one is full it becomes ``old``, from which what is asked for again comes back, so
    frequent chunks stay and rare ones go.
    """

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            self.new.append(chunk)
            return b""
        self[chunk] = found
        return found

    def turn(self) -> None:
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()


def encoder(name: str = WORD_BPE) -> Encoder:
    """The worker's encoder for a tokenizer, kept between tasks."""
    if name not in _MADE:
        _MADE[name] = Encoder(name)
    return _MADE[name]
