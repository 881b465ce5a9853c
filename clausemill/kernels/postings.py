"""Postings of documents from their terms, a few documents at a time, without Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that are sorted together.
TOGETHER = 1 << 20


def spans(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of documents with about so many terms; a longer document is one by itself."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield start, end - start
        start = end


def inverted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, positions) of rows (doc_id, terms), sorted by term within each run of documents."""
    for part in parts:
        lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
        for start, rows in spans(lengths):
            own, ids = lengths[start : start + rows], part.column(0).slice(start, rows)
            d = part.column(1).slice(start, rows).flatten().dictionary_encode()
            order = pc.sort_indices(d.dictionary)
            rank = np.empty(len(order), np.int32)
            rank[order.to_numpy()] = np.arange(len(order))
            term = rank[d.indices.to_numpy()]
            row = np.repeat(np.arange(rows), own)
            position = (np.arange(len(term)) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32)
            by = np.argsort(term, kind="stable")
            term, row, position = term[by], row[by], position[by]
            starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)).astype(np.int32)), pa.array(position))
            yield pa.RecordBatch.from_arrays([d.dictionary.take(order).take(pa.array(term[starts])), ids.take(pa.array(row[starts])), lists], names=["term", "doc_id", "positions"])
