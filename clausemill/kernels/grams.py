"""Counts of n-grams from a sorted stream of the longest grams that begin at each place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between words; within words it and smaller characters are escaped, so grams that begin alike stand together when sorted.
BETWEEN, ESCAPE = "\n", "\x0b"
LOW = [chr(k) for k in (11, *range(11))]
#: Rows that are looked at together.
TOGETHER = 1 << 17


def escaped(c: str) -> str:
    return ESCAPE + chr(ord(c) + 48)


def unescape(words: pa.Array) -> pa.Array:
    """The words themselves again."""
    if not pc.any(pc.match_substring(words, ESCAPE)).as_py():
        return words
    back = {escaped(c): c for c in LOW}

    def one(word: str) -> str:
        first, *rest = word.split(ESCAPE)
        return first + "".join(back[ESCAPE + x[0]] + x[1:] for x in rest)

    return pa.array([one(w) for w in words.to_pylist()], pa.string())


@dataclass
class Groups:
    """The grams of one size and key that end in a run of rows: words is rows x n codes into `dictionary`."""

    key: str | None
    n: int
    words: np.ndarray
    frequency: np.ndarray
    first: pa.Array | None
    dictionary: pa.Array
    stop: np.ndarray

    def meaningful(self) -> np.ndarray:
        return ~self.stop[self.words[:, 0]] & ~self.stop[self.words[:, -1]]

    def grams(self) -> pa.Array:
        at = np.arange(0, self.words.size + 1, self.n, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(at), unescape(self.dictionary.take(pa.array(self.words.ravel()))))

    def where(self, kept: np.ndarray) -> Groups:
        return Groups(self.key, self.n, self.words[kept], self.frequency[kept], None if self.first is None else self.first.take(pa.array(kept)), self.dictionary, self.stop)


def ranks(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes in the order of the ids, the ids by code); nulls come last."""
    d = ids.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = len(order)
    codes = pc.fill_null(d.indices, len(order)).to_numpy(zero_copy_only=False)
    return rank[codes], pa.concat_arrays([d.dictionary.take(pa.array(order)), pa.nulls(1, d.dictionary.type)])


def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= TOGETHER:
            yield [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if rows:
        yield [c.combine_chunks() for c in pa.Table.from_batches(held).columns]


def counted(parts: Iterator[pa.RecordBatch], sizes: tuple[int, ...], stop_words: list[str]) -> Iterator[Groups]:
    """Grams of each size, whole ones only, from rows (key, w[, doc_id]) sorted by key and w.

    A group that the last row of a run belongs to may go on: its sums are carried into the next run by that row.
    """
    longest, carry = max(sizes), None
    for columns in runs(parts):
        key, w, ids = columns[0], columns[1], columns[2] if len(columns) > 2 else None
        key, w = key.cast(pa.string()), w.cast(pa.string())
        weight = np.ones((len(w), len(sizes)), np.int64)
        if carry:
            key, w, weight = pa.concat_arrays([carry[0], key]), pa.concat_arrays([carry[1], w]), np.vstack([carry[2], weight])
        if ids is not None:
            some = pa.concat_arrays([carry[3], ids]) if carry else ids
            rank, by_rank = ranks(some)
            own = rank[len(sizes) :] if carry else rank
            first = np.repeat(own[:, None], len(sizes), axis=1)
            if carry:
                first = np.vstack([rank[: len(sizes)][None, :], first])
        split = pc.split_pattern(w, BETWEEN)
        d = split.flatten().dictionary_encode()
        m, codes = pc.list_value_length(split).to_numpy(), d.indices.to_numpy()
        table = np.full((len(w), longest), -1, np.int32)
        table[np.arange(longest)[None, :] < m[:, None]] = codes
        stop = pc.is_in(unescape(d.dictionary), pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
        keys = key.dictionary_encode()
        key_codes = pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
        new = np.ones(len(w), bool)
        new[1:] = key_codes[1:] != key_codes[:-1]
        last_weight, last_first, at = np.zeros((1, len(sizes)), np.int64), np.zeros(len(sizes), np.int64), 0
        for n in range(1, longest + 1):
            new[1:] |= table[1:, n - 1] != table[:-1, n - 1]
            if n not in sizes:
                continue
            at = sizes.index(n)
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(weight[:, at], starts)
            last_weight[0, at] = sums[-1]
            if ids is not None:
                least = np.minimum.reduceat(first[:, at], starts)
                last_first[at] = least[-1]
            whole = starts[:-1]
            whole, kept = whole[table[whole, n - 1] >= 0], table[whole, n - 1] >= 0
            for code in np.unique(key_codes[whole]):
                here = key_codes[whole] == code
                yield Groups(
                    keys.dictionary[int(code)].as_py() if code >= 0 else None, n, table[whole[here], :n], sums[:-1][kept][here],
                    by_rank.take(pa.array(least[:-1][kept][here])) if ids is not None else None, d.dictionary, stop,
                )
        carry = (key.slice(len(key) - 1), w.slice(len(w) - 1), last_weight, by_rank.take(pa.array(last_first)) if ids is not None else None)
    if carry:
        words = pc.split_pattern(carry[1], BETWEEN).flatten()
        d = words.dictionary_encode()
        stop = pc.is_in(unescape(d.dictionary), pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
        for at, n in enumerate(sizes):
            if len(words) >= n:
                yield Groups(carry[0][0].as_py(), n, d.indices.to_numpy()[None, :n], carry[2][0, at : at + 1], None if carry[3] is None else carry[3].slice(at, 1), d.dictionary, stop)


def most_frequent(g: Groups, k: int) -> Groups:
    """Those among which the k most frequent are, equals by first document; all that one document has first."""
    if len(g.frequency) <= k:
        return g
    rank, _ = ranks(g.first)
    order = np.lexsort((rank, -g.frequency))
    last = order[k - 1]
    return g.where(np.flatnonzero((g.frequency > g.frequency[last]) | ((g.frequency == g.frequency[last]) & (rank <= rank[last]))))
