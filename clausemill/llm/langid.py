"""Language identification by cross-parsing entropy.

Each language has the suffix automaton of a bounded sample of its labelled text. A text is parsed greedily with
every automaton into longest matches (Ziv and Merhav, 1993); the language whose automaton needs the fewest
phrases per character wins. Automata are stored as complete transition tables: a step that leaves the automaton
starts a new phrase, and its table entry says so in the lowest bit, so that many texts advance together in numpy.

The sample is bounded by `chars` characters per language, whole labelled texts in order of a hash, those of up to LONGEST
characters first; it is the only thing that isn't taken from all rows. Every language that has a labelled row is learned;
beyond FULL languages each has fewer characters, so that the automata keep to the memory of FULL. Prediction parses whole
texts. They are cut into lanes of LANE characters that advance together; a lane that continues a text is then parsed again
from the state at the end of the lane before, until both parses begin a phrase at the same place and so agree from there on.

Letters are compared in lower case; runs of anything else count as one separator. Each language has symbols for the
letters of its own sample; of more than 62, the less frequent share HASHED classes. Letters that a language's sample
doesn't have begin a new phrase in it.

Whether a text is in a learned language at all is told by its phrases per character: `limits` holds for each language what
texts of its sample need that its automaton hasn't seen, and `accept` rejects texts that need far more.

Defined cases: `und` with score 0 for a null text, a text without a letter, or if nothing could be learned; ties go
to the first language in order; repeated rows are each predicted; rows with a null label are not learned from.
Columns other than id, text and label aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, small

CHARS, LONGEST, FULL, SYMBOLS, HASHED, LANE, BLOCK = 65_536, 4096, 8, 64, 16, 2048, 2_000_000
UNKNOWN = "und"
#: Characters from which phrases per character tell whether a text is in a language.
LEAST = 200


def automaton(codes: list[int], symbols: int = SYMBOLS) -> np.ndarray:
    """Transition table of the codes' suffix automaton: entry [state * symbols + code] is
    (next state * symbols) * 2 + 1 if a new phrase begins there, without the 1 if the match goes on."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    start = np.ones(symbols, np.int32)
    for c, to in nxt[0].items():
        start[c] = to * symbols * 2 + 1
    table = np.tile(start, (len(nxt), 1))
    for state, steps in enumerate(nxt):
        for c, to in steps.items():
            table[state, c] = to * symbols * 2
    return table.reshape(-1)


class Lanes:
    """Parses of lanes, in order of falling length, by one automaton: code at[j] .. at[j] + left[j] is lane j."""

    def __init__(self, table: np.ndarray, codes: np.ndarray, at: np.ndarray, left: np.ndarray):
        self.table, self.codes, self.at, self.left = table, codes, at, left
        self.state, self.count, self.broke = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), []
        for t in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -t, side="left"))  # lanes longer than t
            got = table[self.state[:m] + codes[at[:m] + t]]
            broke = (got & 1).astype(np.uint8)
            self.count[:m] += broke
            self.state[:m] = got >> 1
            self.broke.append(broke)

    def breaks(self, before: np.ndarray) -> np.ndarray:
        """Phrases begun within each lane, apart from a text's first; before: the lane that a lane continues, or -1."""
        count, state = self.count.copy(), self.state.copy()
        lane = np.flatnonzero(before >= 0)
        while len(lane):
            came = state[before[lane]]
            count[lane], ended = self._again(lane, came)
            changed = np.flatnonzero(state[lane] != ended)
            state[lane] = ended
            changed = np.zeros(len(state), bool) if not len(changed) else np.isin(np.arange(len(state)), lane[changed])
            lane = np.flatnonzero((before >= 0) & changed[before])
        return count

    def _again(self, lane: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, last state) of lanes parsed from the states, until they agree with the parse from the root."""
        count, ended = np.zeros(len(lane), np.int32), self.state[lane].copy()
        open_, passed = np.arange(len(lane)), np.zeros(len(lane), np.int32)
        for t in range(int(self.left[lane].max())):
            done = self.left[lane[open_]] <= t
            ended[open_[done]] = state[done]
            open_, state = open_[~done], state[~done]
            if not len(open_):
                break
            own = lane[open_]
            got = self.table[state + self.codes[self.at[own] + t]]
            broke, state = got & 1, got >> 1
            count[open_] += broke
            passed[open_] += self.broke[t][own]
            agree = (broke == 1) & ((self.broke[t][own] == 1) | (t == 0))
            count[open_[agree]] += self.count[own[agree]] - passed[open_[agree]]
            open_, state = open_[~agree], state[~agree]
        ended[open_] = state
        return count, ended


class Model:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        letters = [Counter(c for c in text.lower() if c.isalpha()) for _, text in samples]
        every = sorted(set().union(*letters))
        code = {c: n for n, c in enumerate(every, 2)}
        self.code = np.zeros(0x110000, np.int32)  # 0: not a letter, 1: a letter of no sample
        for point in range(0x110000):
            if (c := chr(point)).isalpha():
                self.code[point] = code.get(c.lower(), 1)
        self.own, self.tables = [], []  # of each language: its symbols for the codes, its automaton
        for (_, text), found in zip(samples, letters, strict=True):
            common = [c for c, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
            first = SYMBOLS - 2 if len(common) <= SYMBOLS - 2 else SYMBOLS - 2 - HASHED
            own = np.ones(len(every) + 2, np.uint8)  # 1: a letter its sample doesn't have
            own[0] = 0
            for n, c in enumerate(common):
                own[code[c]] = 2 + n if n < first else 2 + first + ord(c) % HASHED
            self.own.append(own)
            self.tables.append(automaton(own[self.codes(text)].tolist(), int(own.max()) + 1))

    def codes(self, text: str) -> np.ndarray:
        got = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != 0) | (got[:-1] != 0)
        return got[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) by each language."""
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        lanes = np.maximum(1, -(-sizes // LANE))
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at, left = begins[owner] + nth * LANE, np.minimum(LANE, sizes[owner] - nth * LANE)
        order = np.argsort(-left, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, place[np.arange(len(order)) - 1], -1)[order]  # the lane that a lane continues
        at, left, owner = at[order], left[order], owner[order]
        out = np.ones((len(texts), len(self.tables)))
        for k, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            np.add.at(out[:, k], owner, Lanes(table, own[flat], at, left).breaks(before))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and phrases per character (0 for texts of fewer than LEAST)."""
        coded = [self.codes(t) if t else np.zeros(0, np.int32) for t in texts]
        lettered = np.array([bool((c > 0).any()) for c in coded], bool)
        names, scores, dear = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.tables or not lettered.any():
            return names, scores, dear
        where = np.flatnonzero(lettered)
        counts = self.phrases([coded[i] for i in where])
        rates = counts / np.array([len(coded[i]) for i in where])[:, None]
        best = rates.argmin(axis=1)
        ranked = np.sort(rates, axis=1)
        sure = 1 - ranked[:, 0] / ranked[:, 1] if rates.shape[1] > 1 else np.ones(len(where))
        for i, b, s in zip(where.tolist(), best.tolist(), sure.tolist(), strict=True):
            names[i], scores[i] = self.languages[b], s
        for i, r in zip(where.tolist(), ranked[:, 0].tolist(), strict=True):
            dear[i] = r if len(coded[i]) >= LEAST else 0.0
        return names, scores, dear


@lru_cache(maxsize=1)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def learn(labelled: DataFrame, chars: int = CHARS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """(language, sample text) in order of language, from rows with a label and a text that isn't empty.

    Whole texts, one per line, as long as a language's stay within `chars` characters (of more than FULL languages, within
    their share of FULL times as many); only a first text that is longer than that by itself is cut.
    """
    plain = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text <> '' and lang is not null")
    size = F.length("text")
    counts = plain.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.least(size, F.lit(LONGEST))).alias("mean")).collect()
    if not counts:
        return ()
    each = max(1, chars * FULL // max(FULL, len(counts)))
    h = F.xxhash64("id", "text")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (8 * each / r["mean"] + 32) / r["n"]))])
    some = plain.withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    first = W.partitionBy("lang").orderBy(size > LONGEST, "h", "id")
    some = some.select("lang", F.sum(size).over(first.rowsBetween(W.unboundedPreceding, 0)).alias("end"), F.row_number().over(first).alias("n"), F.substring("text", 1, each).alias("part"))
    texts: dict[str, list] = {}
    for r in sorted(some.where((F.col("end") <= each) | (F.col("n") == 1)).collect(), key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(r["part"])
    return tuple((lang, "\n".join(parts)) for lang, parts in sorted(texts.items()))


def limits(samples: tuple[tuple[str, str], ...], slack: float = 1.75, parts: int = 4) -> dict[str, float]:
    """For each language the phrases per character beyond which a text isn't in it.

    A quarter of the sample is parsed by the automaton of the rest, piece by piece; the limit is the highest rate of a piece,
    times the slack. A sample of fewer pieces than parts sets no limit.
    """
    out = {}
    for lang, text in samples:
        lines = [x for x in text.split("\n") if any(c.isalpha() for c in x)]
        if len(lines) < 2 * parts:
            out[lang] = 1.0
            continue
        known = Model(((lang, "\n".join(x for n, x in enumerate(lines) if n % parts)),))
        held = [known.codes("\n".join(lines[k : k + 4 * parts : parts])) for k in range(0, len(lines), 4 * parts)]
        rates = [known.phrases([h])[0, 0] / len(h) for h in held if len(h) >= LEAST]
        out[lang] = min(1.0, slack * max(rates)) if rates else 1.0
    return out


def blockwise(samples: tuple[tuple[str, str], ...], texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Predictions in blocks of about BLOCK characters, which bounds memory."""
    out, at = ([], [], []), 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK):
            size += len(texts[end] or "")
            end += 1
        for every, got in zip(out, model(samples).predict(texts[at:end]), strict=True):
            every += got
        at = end
    return out


def _predict(samples: tuple[tuple[str, str], ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small(parts, 1024):
        names, scores, _ = blockwise(samples, part.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; score is 1 - phrases of the best / phrases of the second."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(lean(partial(_predict, samples)), f"id {plain.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the modulus."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def _accept(samples: tuple[tuple[str, str], ...], most: dict[str, float], text_at: int, least_score: float, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small(parts, 1024):
        kept = [n != UNKNOWN and n in most and s >= least_score and r <= most[n] for n, s, r in zip(*blockwise(samples, part.column(text_at).to_pylist()), strict=True)]
        yield part.filter(pa.array(kept, pa.bool_()))


def accept(docs: DataFrame, samples: tuple[tuple[str, str], ...], most: dict[str, float], least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, whose text is in a language of `most`, with at least the score and at most as
    many phrases per character as `most` says. Texts of fewer than LEAST characters need a letter only."""
    return docs.mapInArrow(lean(partial(_accept, samples, most, docs.columns.index(text_col), least_score)), docs.schema)
