"""License scans: ordered signature rules behind a keyword prefilter.

One Aho-Corasick pass over a text's words finds the rules that can match at all; only those run. Detections are
resolved in order of priority, then length, then place: one that lies within the interval of a detection that was
already kept is suppressed. Four fixed phrases are found in any case and always keep their labels.

Every text is judged on its own, whole, with no shuffle. Defined cases: a null text is empty; a text without words
or detections has empty label strings, null places and score 0; repeated rows are each judged. Columns other than id
and text aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, utf8
from .license_rules import build

#: phrase → label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Upper case to lower, and everything that separates words to a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
BASE_CONFIDENCE = 0.8


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.rules, behind = build()
        self.words = ahocorasick.Automaton()
        for word, numbers in behind.items():
            self.words.add_word(f" {word}", tuple(numbers))
        self.words.make_automaton()
        self.phrases = [(f" {phrase} ".encode(), len(phrase.split()), label) for phrase, label in BASE.items()]

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """Kept detections (rule, start, end) in characters of the space-joined words."""
        gated: set[int] = set()
        for _, numbers in self.words.iter(f" {text} "):
            gated.update(numbers)
        found = [(n, m.start(), m.end()) for n in gated for m in self.rules[n].pattern.finditer(text)]
        found.sort(key=lambda d: (-self.rules[d[0]].priority, d[1] - d[2], d[1], d[0]))
        kept: list[tuple[int, int, int]] = []
        covered = Cover()
        for rule, start, end in found:
            if not covered.holds(start, end):
                kept.append((rule, start, end))
                covered.add(start, end)
        return sorted(kept, key=lambda d: (d[1], d[0]))

    def scan(self, text: bytes | None) -> tuple:
        words = (text or b"").translate(TO_WORDS).split()
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        starts: list[int] = []
        base: set[str] = set()
        for phrase, _, label in self.phrases:
            at, counted, word = padded.find(phrase), 0, 0
            while at >= 0:
                word += padded.count(b" ", counted, at)
                counted = at
                starts.append(word)
                base.add(label)
                at = padded.find(phrase, at + 1)
        kept = self.detections(joined.decode("utf-8", "replace"))
        labels = base | {self.rules[n].label for n, _, _ in kept}
        score = max([BASE_CONFIDENCE] * bool(base) + [self.rules[n].confidence for n, _, _ in kept], default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


class Cover:
    """The widest intervals kept so far: starts and ends both increase, so one look-up decides."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        n = bisect_right(self.starts, start)
        return n > 0 and self.ends[n - 1] >= end

    def add(self, start: int, end: int) -> None:
        first, last = bisect_left(self.starts, start), bisect_right(self.ends, end)
        last = max(first, last)  # those in between lie within the new one
        self.starts[first:last], self.ends[first:last] = [start], [end]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for part in small(parts):
        rows = [scanner().scan(t) for t in utf8(part.column(1))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *NAMES])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_scan, f"id {plain.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
