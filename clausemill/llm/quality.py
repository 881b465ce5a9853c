"""Quality rules with distribution divergence.

Base rules fail texts that are short or repeat their own five-word windows. The method compares two histograms of a
text, character classes and common words, with those of each language by Jensen-Shannon distance; a text is kept if
some language's two distances are both within their limits. The references are the summed histograms of all labelled documents, added
up on the map side; what reaches the driver is one row for each language, however rare it is. Texts
shorter than the minimum lengths have no reliable histogram and are left to the base rules.

Defined cases: a null text has no words; without words, or with fewer than ten, the base rules fail; without
references (no labels) the base verdict holds; repeated rows are each judged. Columns other than id, text and label
aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, utf8

#: Function words of some languages, one histogram bin each; all other words share the last bin.
COMMON_WORDS = (
    "the of and to in a is that it for on with as was at by be this from or are an have not but "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "de la que el en y los se del las un por con no una su para al lo como más o pero sus le "
    "et les des est dans qui une pour pas sur au ce il sont avec plus par je ne ou aux elle nous"
).split()
WORD_BIN = {w.encode(): n for n, w in enumerate(dict.fromkeys(COMMON_WORDS))}
WORD_BINS = len(WORD_BIN) + 1
#: vowels, other ASCII letters, capitals, letters beyond ASCII, digits, spaces, line ends, sentence marks, brackets and quotes, symbols, other
CHAR_BINS = 11
SYMBOLS = "#*$%&|<>"
#: Distances (base 2, 0 to 1) above which a text is no language's, and the lengths from which they count.
CHAR_LIMIT, WORD_LIMIT, LEAST_CHARS, LEAST_WORDS = 0.30, 0.50, 200, 50


def _classes() -> bytes:
    table = bytearray([10] * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            table[b] = 3
        elif c in "aeiouy":
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 4
        elif c in " \t":
            table[b] = 5
        elif c in "\n\r\x0b\x0c":
            table[b] = 6
        elif c in ".,;:!?-'":
            table[b] = 7
        elif c in "()[]{}\"":
            table[b] = 8
        elif c in "#*$%&|<>+=/\\@^_`~":
            table[b] = 9
    return bytes(table)


CLASSES = np.frombuffer(_classes(), np.uint8)


def char_histogram(text: bytes) -> np.ndarray:
    """Counts by class; of a character beyond ASCII only the first byte counts."""
    raw = np.frombuffer(text, np.uint8)
    return np.bincount(CLASSES[raw[(raw & 0xC0) != 0x80]], minlength=CHAR_BINS)


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Counts by common word; words are compared in lower case, without marks at their ends."""
    last = WORD_BINS - 1
    counts = np.zeros(WORD_BINS, np.int64)
    for word, n in Counter(words).items():
        counts[WORD_BIN.get(word.lower().strip(b".,;:!?\"'()"), last)] += n
    return counts


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def base_measures(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """The words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.split()  # bytes: ASCII white space only
    spaces = sum(text.count(c.encode()) for c in " \t\n\x0b\x0c\r")
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - spaces
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    n = len(words)
    if n >= 6:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) <= n - 5:  # else no window can repeat
            windows = np.lib.stride_tricks.sliding_window_view(ids, 5)
            bits = max(1, int(len(number) - 1).bit_length())
            if 5 * bits <= 62:
                keys = windows @ (np.int64(1) << (bits * np.arange(5, dtype=np.int64)))
                _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            else:
                _, inverse, counts = np.unique(np.ascontiguousarray(windows).view([("", np.int64)] * 5).ravel(), return_inverse=True, return_counts=True)
            again = counts[inverse.ravel()] > 1
            hit = np.zeros(n, bool)
            for k in range(5):
                hit[k : n - 4 + k] |= again
            repeated = int(hit.sum())
    return words, chars, symbols, len(lines) - len(set(lines)), repeated


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list] = {}
    for part in small(parts):
        for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
            entry = sums.setdefault(lang, [0, np.zeros(CHAR_BINS + WORD_BINS, np.int64)])
            entry[0] += 1
            entry[1] += np.concatenate([char_histogram(text), word_histogram(text.split())])
        if len(sums) > 1000:
            yield _sums(sums)
            sums = {}
    if sums:
        yield _sums(sums)


def _sums(sums: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "n", "bins"])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[int]]]:
    """(language, summed histogram) from all labelled documents, for every language."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = labelled.mapInArrow(_add_up, "lang string, n long, bins array<long>")
    each = sums.groupBy("lang").agg(*[F.sum(F.col("bins")[k]).alias(f"b{k}") for k in range(CHAR_BINS + WORD_BINS)])
    return sorted((r["lang"], [r[f"b{k}"] for k in range(CHAR_BINS + WORD_BINS)]) for r in each.collect())


def _judge(refs: list[tuple[str, list[int]]], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = [(np.array(bins[:CHAR_BINS]), np.array(bins[CHAR_BINS:])) for _, bins in refs]
    known = [(c, w) for c, w in known if c.sum() and w.sum()]
    for part in small(parts):
        out: list[tuple] = []
        for text in utf8(part.column(1)):
            words, chars, symbols, dup, repeated = base_measures(text or b"")
            n = len(words)
            failed = n < 10 or 100 * repeated > 20 * n
            by_char = by_word = None
            own_c = char_histogram(text or b"")
            if known and n >= LEAST_WORDS and own_c.sum() >= LEAST_CHARS:
                own_w = word_histogram(words)
                # the language that the text exceeds least, of equals the nearest
                each = [(distance(own_c, c), distance(own_w, w)) for c, w in known]
                by_char, by_word = min(each, key=lambda d: (max(0.0, d[0] / CHAR_LIMIT - 1, d[1] / WORD_LIMIT - 1), sum(d)))
            near = by_char is None or (by_char <= CHAR_LIMIT and by_word <= WORD_LIMIT)
            out.append((n, chars, symbols, dup, repeated, failed, by_char, by_word, not failed and near))
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *NAMES])


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def judge(docs: DataFrame, refs: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base measures, base_failed, both distances to the nearest language (null where not taken), and kept."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {plain.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return plain.mapInArrow(partial(_judge, refs), schema)
