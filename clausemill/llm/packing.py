"""Sum-of-squares online packing of token ids into fixed-length sequences.

A document's full windows are cut off as sequences of their own; what remains is placed online. N(h) counts the
open windows filled to level h; a piece of size s goes to the level h, an empty window (h = 0) included, that
minimises the sum of N(h)^2 after the placement (Csirik et al., 2006). The level array holds, per level, the open
windows themselves. Every task packs the documents of its own partition, so nothing is shuffled and a level
array never has more than `length` - 1 levels; open windows stay few because the rule evens their levels out.
At the end of a task the fullest open windows keep what the rule put there, and the emptiest are cut up to fill them; the
last tokens go into windows whose lengths are powers of two, so nothing is padded. `placement` says of each piece whether
it is a full window of its document (`full`), lies where the rule put it (`rule`) or was moved at the end (`moved`).

A partition's packing depends only on its rows and their order, so a lost task is simply run again.

Defined cases: a null text is an empty one, which is the end id alone; repeated rows are packed each; a text of
any length is cut; the string of an added token is that token, as in the tokenizers library; an empty table gives no
rows. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

LENGTH = 1024

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, placement string"


def _bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


BYTE_OF = _bytes()
#: How a byte-level BPE tokenizer cuts texts before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    path is a byte-level BPE file of the tokenizers library; its vocabulary and ranks are run by tiktoken, which gives
    the same ids in less time (tests compare them). Added tokens are cut out of a text first, as that library does.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in model["added_tokens"]}
        if any(t[flag] for t in model["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what is beside them aren't supported")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else re.compile("(?!)")
        ranks = {}
        for token, n in model["model"]["vocab"].items():
            if all(c in BYTE_OF for c in token) and token not in self.added:
                ranks[bytes(BYTE_OF[c] for c in token)] = n
        self.encoding = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not self.split.search(text := text or ""):
            return self.encoding.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        parts = self.split.split(text)  # texts and added tokens in turn
        return b"".join(self.added[p] if n % 2 else self.encoding.encode_to_numpy(p).astype("<u4", copy=False).tobytes() for n, p in enumerate(parts))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


Piece = tuple[object, int, bytes, int, str]  # id, start, ids, tokens of the document, placement


class Packer:
    """Places pieces online; finished windows come out as lists of pieces."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(length)]

    def place(self, piece: Piece) -> list[Piece] | None:
        size, counts = len(piece[2]) // 4, self.counts
        # change of the sum of squares for each level h = 0 .. length - size
        change = 2 * counts[size : self.length + 1] + 1
        change[-1] = 0  # a full window isn't counted
        levels = counts[: self.length - size + 1]
        change[1:] += 1 - 2 * levels[1:]
        change[1:][levels[1:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        window = self.open[best].pop() if best else []
        if best:
            counts[best] -= 1
        window.append(piece)
        if best + size == self.length:
            return window
        self.open[best + size].append(window)
        counts[best + size] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """All open windows, filled: the fullest with the pieces of the emptiest. The last tokens lie in powers of two."""
        windows = [window for level in reversed(self.open) for window in level]
        first, last, donor = 0, len(windows), []
        while first < last:
            window = windows[first]
            first += 1
            room = self.length - sum(len(p[2]) // 4 for p in window)
            while room and (donor or first < last):
                if not donor:
                    last -= 1
                    donor = windows[last][::-1]
                room -= self._move(donor, window, room)
            if room:
                donor = window[::-1]
            else:
                yield window
        left = sum(len(p[2]) // 4 for p in donor)
        for size in [1 << b for b in reversed(range(self.length.bit_length())) if left >> b & 1]:
            window, room = [], size
            while room:
                room -= self._move(donor, window, room)
            yield window

    @staticmethod
    def _move(donor: list[Piece], window: list[Piece], room: int) -> int:
        """Moves the donor's last piece, or as much of its front as there is room for; how much that is."""
        who, start, ids, tokens, _ = donor.pop()
        if len(ids) > 4 * room:
            donor.append((who, start + room, ids[4 * room :], tokens, "moved"))
            ids = ids[: 4 * room]
        window.append((who, start, ids, tokens, "moved"))
        return len(ids) // 4


def _pack(length: int, path: str, end: bytes, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, number = Packer(length), TaskContext.get().partitionId() << 40
    done: list[tuple] = []

    def finish(window: list[Piece]) -> None:
        nonlocal number
        offset = 0
        for who, start, ids, tokens, how in window:
            done.append((who, start, len(ids) // 4, ids, tokens, number, offset, how))
            offset += len(ids) // 4
        number += 1

    def out() -> pa.RecordBatch:
        columns = [list(x) for x in zip(*done, strict=True)]
        done.clear()
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "placement"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = None
    for part in parts:
        kind = part.column(0).type
        for at in range(0, part.num_rows, 256):
            who, texts = (part.column(k).slice(at, 256).to_pylist() for k in (0, 1))
            for one, text in zip(who, texts, strict=True):
                ids = encoder(path).encode(text) + end
                tokens = len(ids) // 4
                full = tokens - tokens % length
                for start in range(0, full, length):
                    finish([(one, start, ids[4 * start : 4 * (start + length)], tokens, "full")])
                if full < tokens and (window := packer.place((one, full, ids[4 * full :], tokens, "rule"))):
                    finish(window)
            if len(done) > 2000:
                yield out()
    for window in packer.rest():
        finish(window)
        if len(done) > 2000:
            yield out()
    if done:
        yield out()


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, placement.

    The ids of a document with end_id behind it lie in its pieces, each exactly once; sequence_id is unique, and
    the pieces of a sequence fill it from offset 0 without gaps. tokenizer_path: the file of a tokenizer, at the
    same place on all executors.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    return plain.mapInArrow(lean(partial(_pack, length, tokenizer_path, end)), SCHEMA.format(id=plain.schema["doc_id"].dataType.simpleString()))
