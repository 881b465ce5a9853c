"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints are computed text by text in numpy. Candidates share a bucket key; each bucket is compared with
its bit planes stored vertically: the XOR planes of many pairs are added into carry-save counters, a machine
word of pairs at a time, and a block is abandoned as soon as every pair in it exceeds the radius.

* `near_groups` (radius 2 by default) is exact. Its keys are pairs of 16-bit blocks: fingerprints that differ in
  at most r of r + 2 blocks agree on two whole blocks. Equal fingerprints are collapsed before bucketing, so a
  group of exact copies of any size is one row. A bucket that is still large is split again on the bits its key
  left open, by the same argument, inside its task.
* `similar_groups` serves wide radii, where such keys would be too short: its buckets are bands of minima of the
  same shingle hashes. Every pair of a bucket is looked at; sizes and parity sketches of the distinct shingles rule out
  only pairs that can't be similar, and the Jaccard similarity of the whole shingle sets decides on the others.
* `copy_groups` takes the links of both: near fingerprints, and beyond their radius similar shingle sets.

Defined cases: a null text is an empty one; without words the fingerprint is zero and links like any other;
with fewer words than a shingle the whole sequence is the one shingle. Repeated rows give repeated results. Rows
with a null id keep their fingerprint and take the smallest non-null id of their group, or null if there is none.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import bounded, components, lean, small, utf8

SEED = 42
BITS = 64
#: Buckets up to this size are compared as they are, larger ones are split first.
DIRECT = 2048
#: Queries compared with a bucket at once.
TILE = 256
#: 64-bit words of a parity sketch (wide radii).
PARITY = 16


# ---- fingerprints ----------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    found = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; signed, as Spark's long."""
    ones = np.zeros(BITS, np.int64)
    for block in range(0, len(hashes), 1 << 16):
        part = hashes[block : block + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts):
            fps = [fingerprint(shingle_hashes(t, shingle_words)) for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp long")


# ---- bit-sliced distances --------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, packed 64 to a word (padded with zeros)."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, held in bit-sliced counters, is above the radius."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _beyond(n: int) -> np.ndarray:
    """Words with ones in the lanes from n on, which only fill up the last word."""
    words = np.zeros(-(-n // 64), np.uint64)
    if n % 64:
        words[-1] = ALL << np.uint64(n % 64)
    return words


def sliced_counts(plane: Callable[[int], np.ndarray], n: int, radius: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """Adds the 64 XOR planes of n lanes into carry-save counters; (counters, lanes over the radius), or None if all are."""
    first = plane(0)
    counters = [np.zeros_like(first) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(first) | _beyond(n)
    for b in range(BITS):
        carry = first if b == 0 else plane(b)
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
            if not carry.any():
                break
        else:
            over |= carry
        if b % 16 == 15 and (_exceeds(counters, over, radius) == ALL).all():
            return None
    return counters, _exceeds(counters, over, radius)


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n]


def pair_distances(xors: np.ndarray, radius: int) -> np.ndarray:
    """Distances of pairs given as XORed values; radius + 1 stands for all above the radius."""
    if not len(xors):
        return np.zeros(0, np.uint16)
    vertical = planes(xors)
    found = sliced_counts(lambda b: vertical[b], len(xors), radius)
    if found is None:
        return np.full(len(xors), radius + 1, np.uint16)
    total = sum(_unpack(c, len(xors)).astype(np.uint16) << k for k, c in enumerate(found[0]))
    return np.where(_unpack(found[1], len(xors)) == 1, radius + 1, total)


def tile_distances(queries: np.ndarray, vertical: np.ndarray, n: int, radius: int) -> np.ndarray | None:
    """Distances of each query to the n values whose planes are given, or None if all are above the radius."""
    masks = np.where((queries[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1) == 1, ALL, np.uint64(0))
    found = sliced_counts(lambda b: vertical[b][None, :] ^ masks[b][:, None], n, radius)
    if found is None:
        return None
    total = sum(_unpack(c, n).astype(np.uint16) << k for k, c in enumerate(found[0]))
    return np.where(_unpack(found[1], n) == 1, radius + 1, total)


# ---- links within buckets --------------------------------------------------------------------------------------


class Roots:
    """Union-find over positions, merged by whole arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up


def link_sorted(keys: np.ndarray, values: np.ndarray, radius: int, open_bits: tuple[int, ...] = ()) -> np.ndarray:
    """Roots (positions) of the values after linking all pairs with equal keys within the radius.

    keys are sorted. open_bits: bits that the keys don't fix, on which a large bucket can be split; without
    them, or with few of them left, it is compared in tiles as it is.
    """
    roots = Roots(len(keys))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    lanes = np.flatnonzero(small)
    for shift in range(1, 64):  # all pairs of all small buckets, one offset at a time
        lanes = lanes[lanes + shift < ends[lanes]]
        if not len(lanes):
            break
        near = lanes[pair_distances(values[lanes] ^ values[lanes + shift], radius) <= radius]
        roots.merge(near, near + shift)
    for at, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = values[at : at + size]
        if size <= DIRECT or len(open_bits) <= 2 * (radius + 2):
            vertical = planes(own)
            for q in range(0, size, TILE):
                got = tile_distances(own[q : q + TILE], vertical, size, radius)
                if got is not None:
                    base = roots.parent[at : at + size]
                    near = (got <= radius) & (base[q : q + TILE, None] != base[None, :])
                    i, j = np.nonzero(near)
                    roots.merge(at + q + i, at + j)
        else:
            for bits in block_pairs(open_bits, radius):
                sub = np.zeros(size, np.uint64)
                for k, bit in enumerate(bits):
                    sub |= (own >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
                order = np.argsort(sub, kind="stable")
                rest = tuple(b for b in open_bits if b not in bits)
                inner = link_sorted(sub[order], own[order], radius, rest)
                roots.merge(at + order, at + order[inner])
    return roots.parent


def block_pairs(bits: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """The bits of each pair of blocks, of radius + 2 blocks: within the radius, one pair agrees wholly."""
    blocks = [tuple(map(int, x)) for x in np.array_split(np.array(bits), radius + 2)]
    return [a + b for a, b in combinations(blocks, 2)]


def block_keys(fp: Column, radius: int) -> Column:
    """Array of bucket keys: the bits of a pair of blocks, with the pair's number in front."""
    keys = []
    for n, bits in enumerate(block_pairs(tuple(range(BITS)), radius)):
        mask = sum(1 << b for b in bits)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def _column(column: pa.Array) -> np.ndarray:
    """Numbers as they are, sketches as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY) if pa.types.is_binary(column.type) else np.asarray(column)


def runs(parts: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[list[np.ndarray]]:
    """Whole key runs of a stream that is sorted by its first columns: the last run of a batch waits for the next."""
    held: list[list[np.ndarray]] = []
    together = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for part in parts:
        if not part.num_rows:
            continue
        now = [_column(c) for c in part.columns]
        if held and any(held[-1][k][-1] != now[k][0] for k in range(keys)):
            yield together()
            held.clear()
        differs = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:keys]]))
        if len(differs):
            cut = int(differs[-1]) + 1
            held.append([c[:cut] for c in now])
            yield together()
            held.clear()
            now = [c[cut:] for c in now]
        held.append(now)
    if held:
        yield together()


def _link_buckets(radius: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, bits, fp) sorted by key → (a, b): each fingerprint with the root of its links, none with itself."""
    pairs = block_pairs(tuple(range(BITS)), radius)
    for n, bits, fps in runs(parts):
        new = np.r_[True, (n[1:] != n[:-1]) | (bits[1:] != bits[:-1])]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(n)])
        shared = np.repeat(sizes > 1, sizes)  # most buckets hold one fingerprint
        n, bits, fps = n[shared], bits[shared], fps[shared]
        for pair in np.unique(n):
            own, keys = fps[n == pair].view(np.uint64), bits[n == pair]
            rest = tuple(b for b in range(BITS) if b not in pairs[pair])
            root = link_sorted(keys, own, radius, rest)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[root[linked]].view(np.int64))], names=["a", "b"])


def fingerprint_links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links that span the components of all fingerprints (long column fp) within the radius."""
    keyed = distinct_fps.select(F.explode(block_keys(F.col("fp"), radius)).alias("k"), "fp").select("k.n", "k.bits", "fp")
    dealt = keyed.repartition("n", "bits").sortWithinPartitions("n", "bits", "fp")
    return dealt.mapInArrow(lean(partial(_link_buckets, radius)), "a long, b long").distinct()


def near_groups(docs: DataFrame, radius: int = 2, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id) for every row: the smallest id that links within the radius can reach."""
    rows = checkpoint(fingerprints(docs, shingle_words, id_col, text_col))
    smallest = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(smallest.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = smallest.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(of_root, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("id", "fp", "component_id")


# ---- wide radii ------------------------------------------------------------------------------------------------

#: Bands, minima in a band, members that one task compares at once.
BANDS, DEPTH, MEMBERS = 20, 3, 4096


def band_minima(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands: hashes fall into BANDS * DEPTH bins, each band hashes its bins' minima.

    An empty bin borrows the next filled one's minimum (densified one-permutation hashing).
    """
    count = BANDS * DEPTH
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    bins = (mixed >> np.uint64(32)) % np.uint64(count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins.astype(np.int64), hashes)
    filled = np.flatnonzero(np.bincount(bins.astype(np.int64), minlength=count))
    donor = filled[np.searchsorted(filled, np.arange(count)) % len(filled)]
    value = (least[donor] + np.uint64(1)) * (np.uint64(2) * (np.arange(count) - donor).astype(np.uint64) + np.uint64(1))
    value = value.reshape(BANDS, DEPTH)
    key = np.zeros(BANDS, np.uint64)
    for d in range(DEPTH):
        key = (key ^ value[:, d]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def parity(hashes: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Bit i is 1 if an odd number of the distinct hashes falls into bin i of 64 * words.

    A hash that two sets share cancels out, so sketches differ in at most as many bits as the sets in elements.
    """
    bins = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * words)
    return np.packbits((np.bincount(bins.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def possible(differing: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of x and y elements that differ in at least so many can be similar: false only if they can't."""
    most = (x + y) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (differing <= most) & (np.minimum(x, y) + 1e-6 >= similarity * np.maximum(x, y))


def _sketch(words: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small(parts):
        whole, sizes, sketches, bands = [], [], [], []
        for text in utf8(part.column(1)):
            hashes = np.unique(shingle_hashes(text, words))
            whole.append(xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split())))
            sizes.append(len(hashes))
            sketches.append(parity(hashes).tobytes())
            bands.append(band_minima(hashes) if len(hashes) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "whole", "n", "sketch", "bands"])


def _blocks(similarity: float, members: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, n, id) sorted → (band, key, part, id): the members of each bucket of several.

    A bucket of more than `members` is cut into blocks in order of n; each pair of blocks is a part of its own, left out
    only if the sizes alone rule out all its pairs.
    """
    for band, key, n, ids in runs(parts):
        new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(ids)])
        few = np.repeat((sizes > 1) & (sizes <= members), sizes)
        yield _rows(band[few], key[few], 0, ids[few])
        for at, size in zip(new[sizes > members].tolist(), sizes[sizes > members].tolist(), strict=True):
            edges = [*range(at, at + size, members), at + size]
            for i in range(len(edges) - 1):
                for j in range(i, len(edges) - 1):
                    if n[edges[i + 1] - 1] + 1e-6 >= similarity * n[edges[j]]:
                        pick = np.r_[edges[i] : edges[i + 1], edges[j] : edges[j + 1]] if i < j else np.arange(edges[i], edges[i + 1])
                        yield _rows(band[pick], key[pick], i * len(edges) + j, ids[pick])


def _rows(band: np.ndarray, key: np.ndarray, part: int, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(band), pa.array(key), pa.array(np.full(len(ids), part, np.int64)), pa.array(ids)], names=["band", "key", "part", "id"])


def _screen(similarity: float, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, part, id, n, sketch) sorted → (a, b) that span the pairs which n and sketch don't rule out."""
    for band, key, part, ids, n, sketch in runs(parts, 3):
        new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[new, len(ids)])
        a, b = [], []
        for at, size in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own, count, roots = sketch[at : at + size], n[at : at + size], Roots(size)
            for q in range(0, size, TILE):
                end = min(size, q + TILE)
                differing = np.zeros((end - q, end), np.int64)
                for w in range(PARITY):
                    differing += np.bitwise_count(own[q:end, w, None] ^ own[None, :end, w])
                i, j = np.nonzero(possible(differing, count[q:end, None], count[None, :end], similarity))
                roots.merge(q + i, j)
            linked = np.flatnonzero(roots.parent != np.arange(size))
            a.append(ids[at + linked])
            b.append(ids[at + roots.parent[linked]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def link_sets(sets: list[np.ndarray], similarity: float, sides: np.ndarray) -> np.ndarray:
    """Roots (positions) of sets of sorted hashes after linking all pairs with the similarity.

    If there are two sides, only pairs across them are linked. Pairs that are linked already, or that sizes and parity
    sketches rule out, aren't looked at.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    words = PARITY if sizes.max() <= 32 * PARITY else 4 * PARITY
    sketches = np.stack([parity(s, words) for s in sets])
    roots, across = np.arange(len(sets)), sides.min() != sides.max()
    for q in range(1, len(sets)):
        may = sides[:q] != sides[q] if across else np.ones(q, bool)
        left = np.flatnonzero(may & (np.minimum(sizes[:q], sizes[q]) + 1e-6 >= similarity * np.maximum(sizes[:q], sizes[q])))
        differing = np.bitwise_count(sketches[left] ^ sketches[q]).sum(axis=1, dtype=np.int64)
        fits = possible(differing, sizes[left], sizes[q], similarity)
        left = left[fits][np.argsort(differing[fits], kind="stable")]
        while len(left := left[roots[left] != roots[q]]):
            for k, p in enumerate(left.tolist()):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both >= similarity * (sizes[p] + sizes[q] - both):
                    low, high = sorted((roots[p], roots[q]))
                    roots[roots == high] = low
                    break
            left = left[k + 1 :]
    return roots


def _agree(words: int, similarity: float, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, part, side, id, text) sorted → (a, b) that span the pairs of a part whose shingle sets have the similarity."""

    def each() -> Iterator[tuple]:
        for part in small(parts):
            keys = [part.column(k).to_pylist() for k in range(4)]
            for root, nth, side, i, text in zip(*keys, utf8(part.column(4)), strict=True):
                yield (root, nth), side, i, np.unique(shingle_hashes(text, words))

    for _, rows in groupby(each(), key=itemgetter(0)):
        own = [r for r in rows if len(r[3])]
        if len(own) < 2:
            continue
        ids = np.array([r[2] for r in own], np.int64)
        roots = link_sets([r[3] for r in own], similarity, np.array([r[1] for r in own]))
        linked = np.flatnonzero(roots != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[roots[linked]])], names=["a", "b"])


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", members: int = MEMBERS) -> DataFrame:
    """(id, component_id) for every row with an id: groups linked by equal words or by similar shingle sets.

    Texts without words aren't linked. Rows that repeat an id count as one document with all its texts. One task compares at
    most about 2 * members documents at once. Ids that aren't integers are numbered by a hash, which has to tell them apart.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return _named_groups(docs, id_col, text_col, similarity=similarity, shingle_words=shingle_words, members=members)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = checkpoint(plain.mapInArrow(lean(partial(_sketch, shingle_words)), "id long, whole binary, n long, sketch binary, bands array<long>").where("size(bands) > 0"))
    least = rows.groupBy("whole").agg(F.min("id").alias("least"), F.min(F.struct("n", "sketch", "bands")).alias("s"))
    keyed = least.select(F.posexplode("s.bands").alias("band", "key"), F.col("s.n").alias("n"), F.col("least").alias("id"))
    keyed = keyed.select(F.col("band").cast("long").alias("band"), "key", "n", "id").repartition("band", "key").sortWithinPartitions("band", "key", "n", "id")
    shared = keyed.mapInArrow(lean(partial(_blocks, similarity, members)), "band long, key long, part long, id long")
    sketches = least.select(F.col("least").alias("id"), "s.n", "s.sketch")
    dealt = shared.join(sketches, "id").select("band", "key", "part", "id", "n", "sketch").repartition("band", "key", "part").sortWithinPartitions("band", "key", "part")
    maybe = components(dealt.mapInArrow(lean(partial(_screen, similarity)), "a long, b long").where("a <> b").distinct())
    # each group of possible pairs is verified as a whole: in one part, or in the pairs of its blocks if it is large
    sizes = maybe.groupBy("root").agg(F.ceil(F.count("*") / members).cast("long").alias("blocks"))
    blocked = maybe.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocked = blocked.select("root", F.col("node").alias("id"), "blocks", "block", other.alias("other"))
    blocked = blocked.select("root", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("part"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id")
    texts = bounded(blocked).join(plain, "id").select("root", "part", "side", "id", "text").repartition("root", "part").sortWithinPartitions("root", "part")
    similar = texts.mapInArrow(lean(partial(_agree, shingle_words, similarity)), "a long, b long").where("a <> b")
    equal = rows.join(least.select("whole", "least"), "whole").select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")
    roots = components(similar.unionByName(equal))
    ids = plain.select("id")
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component_id"))


def _named_groups(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """similar_groups for ids of other types."""
    named = docs.select(F.col(id_col).alias("name"), F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    names = checkpoint(named.where("name is not null").select("name", "doc_id").distinct())
    if names.count() != names.select("doc_id").distinct().count():
        raise ValueError("two ids have the same hash; number them first")
    groups = similar_groups(named, **options).distinct().join(names, F.col("id") == F.col("doc_id")).select("name", "component_id")
    least = groups.groupBy("component_id").agg(F.min("name").alias("least"))
    each = named.where("name is not null").select("name")
    return each.join(groups.join(least, "component_id").select("name", "least"), "name").select(F.col("name").alias("id"), F.col("least").alias("component_id"))


# ---- both, and what is kept ------------------------------------------------------------------------------------


def copy_groups(docs: DataFrame, radius: int = 2, near_words: int = 3, similarity: float = 0.8, similar_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every id with a copy: texts whose fingerprints are within the radius, or whose shingle sets are similar.

    Fingerprints are those of near_groups, with all their links; similar_groups adds the pairs that lie further apart. Groups
    that share an id are one. Texts without words and rows with a null id link nothing.
    """
    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"))
    near = near_groups(named, radius, near_words, id_col, text_col)
    wide = similar_groups(named, similarity, similar_words, id_col, text_col)
    links = [g.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")) for g in (near, wide)]
    return components(links[0].unionByName(links[1])).select(F.col("node").alias("id"), F.col("root").alias("component_id"))


def once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, those with the same id and text reduced to the one whose other columns come first.

    Rows with a null id stay. Only ids that are repeated bring their texts to a shuffle.
    """
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_again_id"))
    again = bounded(again)
    on = docs[id_col] == again["_again_id"]
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = docs.join(again, on, "left_semi").groupBy(id_col, text_col).agg(F.min(F.struct(F.lit(0).alias("_none"), *others)).alias("_first"))
    first = first.select(*[c if c in (id_col, text_col) else F.col("_first")[c].alias(c) for c in docs.columns])
    return docs.join(again, on, "left_anti").unionByName(first)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the smallest of its group in groups (id, component_id).

    Rows that groups doesn't know, such as those with a null id, stay. So do all rows of an id that is kept: once() reduces
    those with the same text.
    """
    gone = bounded(groups.where("id <> component_id").select(F.col("id").alias("_gone_id")).distinct())
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")
