"""Language-model scoring: a causal self-attention model over subword ids, beside a smoothed unigram base.

Texts are read once, where they lie. A task gathers them in chunks of bounded size; a chunk numbers its distinct words and
keeps its texts as numbers. The words, one row a chunk with their training counts, meet in one shuffle by word, which gives
each its count in the corpus, and go back to their chunk. There they are cut into subwords, each word once, and the texts
become arrays of subword ids with their unigram sums: a table that the model learns from and scores without any shuffle.

The most frequent subwords are classes of their own, the others share one class in which they are told apart by their corpus
counts, so that class and member probabilities multiply to a proper distribution over all ids and the end.

The attention model starts on the driver from START_DOCS training documents, those with the smallest hashes, and then learns
where the data lie: every task trains on every window of all the training documents it holds, and the parameters are
averaged by their numbers of ids. Of these, at most SLOTS sums come to the driver, and one count per vocabulary entry.

Defined cases: a null text is empty, which is the end alone; repeated rows count and are scored each; a null id is
neither held out nor learned from; an empty table gives no rows. Columns other than id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, shared_folder, written
from . import attention
from .common import lean, small

CHUNK_BYTES, START_DOCS, START_ROUNDS, BLOCK, SLOTS = 32 << 20, 400, 4, 1 << 20, 64
END = b""  # as a word


def id_kind(size: int) -> np.dtype:
    """What tables keep subword ids in."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class Subwords:
    """Subword ids of words; the id after the vocabulary is the end."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = id_kind(self.end + 1)
        self.opens = np.zeros(self.end + 1, bool)  # tokens that begin with a space
        self.opens[[n for token, n in ranks.items() if token[:1] == b" "]] = True

    def encode(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace")) if word else [self.end]

    def encode_all(self, words: pa.Array, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, none of them the end, one behind the other, and how many each has.

        Words hold no space, so a run of them is encoded as one text, whose tokens with a space in front open the words.
        """
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), at_once):
            some = words.slice(at, at_once)
            text = pc.binary_join_element_wise(b"", some, b" ").buffers()[2].to_pybytes()
            got = self.encoding.encode_to_numpy(text.decode("utf-8", "replace"))
            begins = np.flatnonzero(self.opens[got])
            if len(begins) == len(some):
                size = np.diff(np.r_[begins, len(got)])
            else:  # no token of the vocabulary is the space itself
                each = [self.encode(w) for w in some.to_pylist()]
                size, got = np.array([len(x) for x in each]), np.array([i for x in each for i in x])
            ids.append(got.astype(self.kind))
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words and the end."""
    return [*(text or b"").lower().split(), END]  # bytes: lower() and split() know ASCII only


# ---- texts as numbers of words -----------------------------------------------------------------------------------

CHUNKED = "chunk long, n int, word binary, c long, id {id}, held_out boolean, words binary"


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the numbers of the texts' words, and how many each text has.

    Every text ends with the number after the last word's, which is the end's.
    """
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(kind)))
    flat, bounds = found.flatten(), np.asarray(found.offsets).astype(np.int64)
    bounds -= bounds[0]
    coded = flat.dictionary_encode()
    numbers, words = np.asarray(coded.indices).astype(np.int32), coded.dictionary
    hollow = pc.index(words, pa.scalar("", words.type)).as_py()  # before the first and after the last word of a text
    end = len(words)
    if hollow >= 0:
        real = numbers != hollow
        bounds = np.r_[0, np.cumsum(real)][bounds]
        numbers = numbers[real]
        numbers -= numbers > hollow
        words, end = pa.concat_arrays([words.slice(0, hollow), words.slice(hollow + 1)]), end - 1
    sizes = np.diff(bounds)
    return words.cast(pa.large_binary() if kind == pa.large_string() else pa.binary()), np.insert(numbers, bounds[1:], np.int32(end)), sizes + 1


def _number(chunk_bytes: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held_out, train, text) → a row for each text, with its words' numbers, and one for each word of its chunk."""
    chunk, size, held = TaskContext.get().partitionId() << 24, 0, []
    names = ["chunk", "n", "word", "c", "id", "held_out", "words"]

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, out_, train, texts = (rows.column(k).chunk(0) for k in range(4))
        words, numbers, sizes = numbered(texts)
        n = len(words) + 1
        counts = np.bincount(numbers[np.repeat(np.asarray(train), sizes)], minlength=n)
        ends = np.r_[0, np.cumsum(sizes)] * 4
        for at in range(0, rows.num_rows, 1000):
            k = min(1000, rows.num_rows - at)
            own = numbers[ends[at] // 4 : ends[at + k] // 4]
            raw = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((ends[at : at + k + 1] - ends[at]).astype(np.int32)), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), ids.slice(at, k), out_.slice(at, k), raw], names=names)
        for at in range(0, n, 100_000):
            k = min(100_000, n - at)
            some = words.slice(at, k).cast(pa.binary())
            some = pa.concat_arrays([some, pa.array([END], pa.binary())]) if at + k == n else some
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.arange(at, at + k, dtype=np.int32)), some, pa.array(counts[at : at + k]), pa.nulls(k, ids.type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary())], names=names)

    for part in small(parts):
        held.append(part)
        size += part.column(3).nbytes
        if size >= chunk_bytes:
            yield from out()
            chunk, size, held = chunk + 1, 0, []
    if size:
        yield from out()


# ---- texts as subword ids ----------------------------------------------------------------------------------------

CODED = "id {id}, held_out boolean, n_tokens long, n_known long, logs double, ids binary, fresh long"


class Lexicon:
    """A chunk's words: their corpus counts and subword ids, by number."""

    def __init__(self, coder: Subwords, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks().sort_by("n")
        words = rows.column("word").combine_chunks()
        ids, sizes = coder.encode_all(words.slice(0, len(words) - 1))
        self.ids, self.sizes = np.r_[ids, ids.dtype.type(coder.end)], np.r_[sizes, 1]  # the last is the end
        self.begins = np.cumsum(self.sizes) - self.sizes
        c = np.asarray(rows.column("c"))
        self.logs, self.known = np.log10(c + 1.0), (c > 0).astype(np.int64)

    def code(self, docs: pa.RecordBatch) -> pa.RecordBatch:
        raw = docs.column("words").to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        words, begins = np.frombuffer(b"".join(raw), "<i4"), np.cumsum(sizes) - sizes
        each = self.sizes[words]
        ids = self.ids[np.arange(int(each.sum())) + np.repeat(self.begins[words] - (np.cumsum(each) - each), each)]
        ends = np.r_[0, np.cumsum(np.add.reduceat(each, begins))] * self.ids.itemsize
        coded = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
        columns = [docs.column("id"), docs.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat(self.known[words], begins)), pa.array(np.add.reduceat(self.logs[words], begins)), coded, pa.nulls(len(raw), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "logs", "ids", "fresh"])


def _code(path: str, pattern: str, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, words before texts → a row for each text, and one a chunk (ids null) with the words that are counted there."""
    now, held, lexicon = None, [], None
    for part in parts:
        chunks = part.column("chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), part.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            own = part.slice(a, b - a)
            if now != chunks[a]:
                now, held, lexicon = chunks[a], [], None
            is_word = own.column("words").is_null()
            if (words := own.filter(is_word)).num_rows:
                held.append(words)
            docs = own.filter(pc.invert(is_word))
            if docs.num_rows and lexicon is None:
                lexicon = Lexicon(subwords(path, pattern), held)
                fresh = sum(pc.sum(pc.cast(w.column("first"), pa.int64())).as_py() or 0 for w in held)
                one = [pa.nulls(1, docs.column("id").type), *[pa.nulls(1, k) for k in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())], pa.array([fresh], pa.int64())]
                held = []
                yield pa.RecordBatch.from_arrays(one, names=["id", "held_out", "n_tokens", "n_known", "logs", "ids", "fresh"])
            at = 0
            while at < docs.num_rows:  # of about BLOCK words at once
                size, end = 0, at
                while end < docs.num_rows and (end == at or size < 4 * BLOCK):
                    size += len(docs.column("words")[end].as_buffer())
                    end += 1
                yield lexicon.code(docs.slice(at, end - at))
                at = end


# ---- the model ---------------------------------------------------------------------------------------------------


class Vocabulary:
    """Classes of ids, members' probabilities within them, and the model's parameters."""

    def __init__(self, counts: np.ndarray):
        self.kind = id_kind(len(counts))
        top = np.lexsort((np.arange(len(counts)), -counts))[: attention.CLASSES - 1]
        top = top[counts[top] > 0]
        self.class_of = np.full(len(counts), attention.CLASSES - 1, np.int16)
        self.class_of[top] = np.arange(len(top))
        rest = self.class_of == attention.CLASSES - 1
        self.member = np.zeros(len(counts))  # log probability within the class
        self.member[rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + rest.sum()))
        self.mass = np.bincount(self.class_of, weights=counts, minlength=attention.CLASSES) + 1
        self.params = attention.initial(self.mass)


def blocks(kind: np.dtype, parts: Iterator[pa.RecordBatch], column: str = "ids", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their ids one behind the other, how many each has), of about `most` ids at once."""
    for part in parts:
        raw = part.column(column).to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
        at = 0
        while at < len(raw):
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most)) + at)
            yield part.slice(at, end - at), np.frombuffer(b"".join(raw[at:end]), kind), sizes[at:end]
            at = end


def _id_counts(size: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(size, np.int64)
    for _, ids, _ in blocks(id_kind(size), parts):
        counts += np.bincount(ids, minlength=size)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["id", "n"])


LEARNED = "slot int, params binary, weight double"


def _refine(vocabulary: Vocabulary, rate: float, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters after every window of a task's texts."""
    trainer = attention.Trainer(vocabulary.params.copy(), rate)
    waiting: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    for _, ids, sizes in blocks(vocabulary.kind, parts):
        waiting.append(vocabulary.class_of[ids])
        lengths.append(sizes)
        if sum(map(len, waiting)) >= BLOCK:
            trainer.see(np.concatenate(waiting), np.concatenate(lengths))
            waiting, lengths = [], []
    if waiting:
        trainer.see(np.concatenate(waiting), np.concatenate(lengths))
    if trainer.ids:
        yield _model(TaskContext.get().partitionId() % SLOTS, trainer.adam.flat, trainer.ids)


def _model(slot: int, flat: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([flat.astype("<f4").tobytes()], pa.binary()), pa.array([float(weight)])], names=["slot", "params", "weight"])


def average(models: Iterator[tuple[bytes, float]]) -> tuple[np.ndarray, float]:
    """The weighted mean of parameters, and the weight."""
    total, weight = np.zeros(attention.SIZE), 0.0
    for params, w in models:
        total += np.frombuffer(params, "<f4") * w
        weight += w
    return (total / weight if weight else total), weight


def _average(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mean, weight = average((p, w) for part in parts for p, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
    if weight:
        yield _model(0, mean, weight)


def _score(vocabulary: Vocabulary, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = attention.Scorer(vocabulary.params)
    for rows, ids, sizes in blocks(vocabulary.kind, parts):
        begins = np.cumsum(sizes) - sizes
        logs = scorer.score(vocabulary.class_of[ids], sizes) + np.add.reduceat(vocabulary.member[ids], begins)
        yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(5)), pa.array(logs / math.log(10))], names=["id", "held_out", "n_tokens", "n_known", "logs", "score"])


def learn(coded: DataFrame, size: int, rate: float = 0.01, refining: float = 0.01) -> Vocabulary:
    """Classes and a model from the rows (id, ids); every window of all of them is learned from."""
    sums = coded.select("ids").mapInArrow(lean(partial(_id_counts, size)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in sums:
        counts[r["id"]] = r["n"]
    vocabulary = Vocabulary(counts)
    hashed = coded.select("ids", F.xxhash64("id", "ids").alias("h"))
    n = coded.count()
    share = min(1.0, 4 * START_DOCS / max(1, n))
    few = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h").limit(START_DOCS).collect()
    start = [np.frombuffer(r["ids"], vocabulary.kind) for r in few]
    if start:
        trainer = attention.Trainer(vocabulary.params, rate)
        for _ in range(START_ROUNDS):
            trainer.see(vocabulary.class_of[np.concatenate(start)], np.array([len(x) for x in start]))
        each = coded.select("ids").mapInArrow(lean(partial(_refine, vocabulary, refining)), LEARNED)
        sums = each.repartition(SLOTS, "slot").mapInArrow(_average, LEARNED).collect()  # at most SLOTS rows
        vocabulary.params = average((r["params"], r["weight"]) for r in sums)[0].astype(np.float32)
    return vocabulary


def code(docs: DataFrame, path: str, pattern: str, modulus: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The table (id, held_out, n_tokens, n_known, logs, ids) of all rows, and the numbers of training tokens and of distinct ones.

    logs sums log10(c + 1) over the tokens; ids are subword ids, little-endian.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    remainder = F.crc32(F.col("id").cast("string").cast("binary")) % modulus
    plain = plain.select("id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("train"), "text")
    chunked = written(plain.mapInArrow(lean(partial(_number, chunk_bytes)), CHUNKED.format(id=kind)), folder := shared_folder(docs.sparkSession), compression="zstd")
    words = chunked.where("word is not null")
    total = words.agg(F.sum("c")).first()[0] or 0
    # a chunk has a word once, so a word has no more rows than there are chunks
    alike = W.partitionBy("word")
    counted = words.select("chunk", "n", "word", F.sum("c").over(alike).alias("c"), (F.min("chunk").over(alike) == F.col("chunk")).alias("first"))
    none = lambda kind: F.lit(None).cast(kind)
    counted = counted.select("chunk", "n", "word", "c", (F.col("first") & (F.col("c") > 0)).alias("first"), none(kind).alias("id"), none("boolean").alias("held_out"), none("binary").alias("words"))
    texts = chunked.where("words is not null").select("chunk", "n", "word", "c", none("boolean").alias("first"), "id", "held_out", "words")
    met = counted.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.col("words").isNotNull())
    coded = written(met.mapInArrow(lean(partial(_code, path, pattern)), CODED.format(id=kind)), **{"compression": "zstd", "parquet.block.size": str(16 << 20)})
    discard(docs.sparkSession, folder)
    distinct = coded.where("fresh is not null").agg(F.sum("fresh")).first()[0] or 0
    return coded.where("fresh is null").drop("fresh"), total, distinct


def apply(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The coded rows with their scores for their ids."""
    kind = coded.schema["id"].dataType.simpleString()
    return coded.mapInArrow(lean(partial(_score, vocabulary)), f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double")


def score(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32 of the id as text leaves the remainder `held` by `modulus` are held out. path, pattern: a
    tokenizer's ranks and its pattern, at the same place on all executors. The coded texts stay in a folder of the shared
    store for as long as the result is read.
    """
    coded, total, distinct = code(docs, path, pattern, **options)
    found = apply(coded, learn(coded.where("not held_out and id is not null"), subwords(path, pattern).end + 1))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return found.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
