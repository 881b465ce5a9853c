"""Cleaning, counting and describing a corpus: set operations over documents(doc_id, text)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import kernels as K
from ..functions import text as T
from ..kernels import grams
from ..kernels.words import FUNCTION_WORDS
from ..session import checkpoint

MEANINGLESS = sorted(FUNCTION_WORDS)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), lines stripped."""
    return docs.select("doc_id", F.posexplode(F.split(T.text("text"), "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


def repeated_lines(docs: DataFrame, chars: int = 60, times: int = 3) -> DataFrame:
    """(doc_id, line, n): short lines that occur often within their document."""
    found = lines(docs).where((F.length("line") > 0) & (F.length("line") < chars))
    return found.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the repeated lines: within each row, in one pass over its lines."""
    return docs.select("doc_id", K.without_headers(F.col("text")).alias("text"))


def rejoin_lines(of_lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, paragraph) from (doc_id, line_no, line): hard-wrapped lines joined, as gaps and islands."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    long = F.array_sort(F.collect_list(F.when(F.length("line") > 20, F.length("line"))))  # of one document, as numbers
    widths = of_lines.groupBy("doc_id").agg(long.alias("w")).select("doc_id", F.when(F.size("w") > 0, F.element_at("w", (0.9 * (F.size("w") - 1)).cast("int") + 1)).otherwise(0).alias("width"))
    held = of_lines.join(widths, "doc_id")
    before = F.coalesce(F.lag("line").over(order), F.lit(""))
    goes_on = before.rlike(r"\b(Pvt|Ltd|Co|Inc|No|Rs|Sr|Jr|Dr|Mr|Mrs|Ms|viz|Govt|Dept)\.$")
    lower = F.substring("line", 1, 1).rlike(r"\p{Ll}")
    joins = (before != "") & (F.col("line") != "") & (~before.rlike("[.:;!?]$") | goes_on) & (lower | (F.length(before) >= 0.8 * F.col("width")))
    numbered = held.withColumn("new", (~joins).cast("int")).withColumn("paragraph_no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = numbered.groupBy("doc_id", "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("p"))
    return parts.select("doc_id", "paragraph_no", F.array_join(F.col("p.line"), " ").alias("paragraph"))


def tokens(docs: DataFrame, tokenizer: Callable[[Column], Column] = T.ascii_words) -> DataFrame:
    """(doc_id, pos, term)."""
    return docs.select("doc_id", F.posexplode(tokenizer(T.text("text"))).alias("pos", "term"))


def sentence_tokens(docs: DataFrame, sentences: Callable[[Column], Column] = T.sentences_of_lines) -> DataFrame:
    """(doc_id, sent_id, words)."""
    return docs.select("doc_id", F.posexplode(sentences(T.text("text"))).alias("sent_id", "words"))


def token_counts(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(tokenizer, token, n). Tokens of kernels are counted in Python, some texts at a time: no column holds them all."""
    native = {name: f for name, f in tokenizers.items() if not hasattr(f, "kernel")}
    own = {name: f.kernel for name, f in tokenizers.items() if name not in native}
    counted = []
    if native:
        pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), f(F.col("t")).alias("tokens")) for name, f in native.items()])
        each = docs.select(T.text("text").alias("t")).select(F.explode(pairs).alias("p")).select("p.tokenizer", F.explode("p.tokens").alias("token"))
        counted.append(each.select("tokenizer", "token", F.lit(1).cast("long").alias("n")))
    if own:
        counted.append(docs.select("text").mapInArrow(partial(_counted, own), "tokenizer string, token string, n long"))
    return reduce(DataFrame.unionByName, counted).groupBy("tokenizer", "token").agg(F.sum("n").alias("n"))


def _counted(tokenizers: dict[str, Callable[[str], list[str]]], parts: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Sums of tokens, handed over whenever so many different ones are held."""
    sums = {name: Counter() for name in tokenizers}

    def held(least: int) -> Iterator[pa.RecordBatch]:
        for name, found in sums.items():
            if len(found) >= least:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["tokenizer", "token", "n"])
                found.clear()

    for part in parts:
        for _, some in K.chunks(part.column(0)):
            for text in some:
                for name, f in tokenizers.items():
                    sums[name].update(f(text))
            yield from held(most)
    yield from held(1)


def tokenizer_table(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Tokens, distinct tokens, distinct terms and the reduction for each tokenizer, pre-aggregated by token."""
    counted = token_counts(docs, tokenizers)
    term = F.when(F.col("token").rlike(r"(?U)\w"), F.lower("token"))
    found = counted.groupBy("tokenizer").agg(F.sum("n").alias("tokens"), F.count("*").alias("token_dictionary"), F.count_distinct(term).alias("term_dictionary"))
    return found.withColumn("reduction_pct", 100.0 * (1 - F.col("term_dictionary") / F.greatest("token_dictionary", F.lit(1))))


def tokenizer_problems(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Five counts of what tokenizers get wrong."""
    counted = token_counts(docs, tokenizers)
    alphabetic = F.when(F.col("token").rlike(r"^\p{L}+$"), F.col("token"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return counted.groupBy("tokenizer").agg(
        total(~F.col("token").rlike(r"(?U)\w")).alias("punctuation_only"), total(F.col("token").isin("₹", "Rs", "Rs.", "INR")).alias("bare_currency_symbol"),
        total(F.col("token") == "-").alias("hyphen_fragments"), (F.count_distinct(alphabetic) - F.count_distinct(F.lower(alphabetic))).alias("case_duplicates"),
        total((F.length("token") == 1) & alphabetic.isNotNull()).alias("single_char_tokens"),
    )


def document_statistics(docs: DataFrame, sentences: Callable[[Column], Column] = T.sentences_of_lines) -> DataFrame:
    """Sentences, tokens, characters and vocabulary per document, and one total row (doc_id null) whose vocabulary is
    the corpus's. Per document everything is counted within the row; only distinct words are shuffled."""
    own = docs.select("doc_id", F.length(T.text("text")).cast("long").alias("characters"), sentences(T.text("text")).alias("s")).withColumn("w", F.flatten("s"))
    rows = own.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size("w").cast("long").alias("tokens"), "characters", F.size(F.array_distinct("w")).cast("long").alias("vocabulary"))
    words = own.select(F.explode(F.array_distinct("w")).alias("word")).distinct().agg(F.count("*").alias("vocabulary"))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sentences", "tokens", "characters")])
    total = sums.join(words, F.lit(True)).select(F.lit(None).cast("long").alias("doc_id"), "sentences", "tokens", "characters", "vocabulary")
    return rows.unionByName(total)


def word_frequencies(docs: DataFrame, least: int = 4) -> DataFrame:
    """(word, n, first_doc) of lower-cased words with at least so many letters."""
    return tokens(docs).where(F.length("term") >= least).groupBy(F.col("term").alias("word")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def common_words(frequencies: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """(word, n) of the k most frequent words, equals in order of first sight; only documents that decide are read again."""
    some = checkpoint(frequencies.withColumn("place", F.rank().over(W.orderBy(F.desc("n"), "first_doc"))).where(F.col("place") <= k))
    where = F.broadcast(some.select(F.col("first_doc").alias("doc_id")).distinct())  # k at most
    seen = tokens(docs.join(where, "doc_id", "left_semi")).groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))
    first = some.join(seen, (some["first_doc"] == seen["doc_id"]) & (some["word"] == seen["term"]))
    return first.orderBy(F.desc("n"), "first_doc", "pos").limit(k).select("word", "n")


def rare_words(frequencies: DataFrame, k: int = 8) -> DataFrame:
    return frequencies.where("n = 1").orderBy("word").limit(k).select("word", "n")


def grams_of(of_sentences: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(doc_id, sent_id, at, n, gram), never across sentences."""
    every = F.concat(*[F.transform(T.ngrams(F.col("words"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))) for n in sizes])
    return of_sentences.select("doc_id", "sent_id", F.posexplode(every).alias("at", "g")).select("doc_id", "sent_id", "at", "g.n", "g.gram")


#: Bytes of input for each of the partitions that longer n-grams are dealt over.
GRAMS_SHARE = 1 << 21


def _direct(sizes: tuple[int, ...]) -> tuple[int, ...]:
    """Sizes whose grams are counted on the map side before their shuffle; longer grams hardly repeat."""
    return tuple(n for n in sizes if n < 2 or max(sizes) < 3)


def _short_grams(of_sentences: DataFrame, sizes: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, gram, frequency, first_doc)."""
    starts = F.concat(*[F.transform(T.ngrams(F.col("words"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))) for n in sizes])
    each = of_sentences.select(*by, "doc_id", F.explode(starts).alias("s")).select(*by, "doc_id", "s.n", "s.gram")
    return each.groupBy(*by, "n", "gram").agg(F.count("*").alias("frequency"), F.min("doc_id").alias("first_doc"))


def _windows(of_sentences: DataFrame, sizes: tuple[int, ...], by: Column, *more: str, only_meaningful: bool = False) -> DataFrame:
    """(key, w, more): of each place the longest gram that begins there, sorted, where its key and first two words belong.

    Where a function word stands no meaningful gram begins.
    """
    low = F.array_join("words", "").rlike("[\\x00-\\x0b]")
    words = F.when(low, F.transform("words", lambda w: reduce(lambda done, c: F.replace(done, F.lit(c), F.lit(grams.escaped(c))), grams.LOW, w))).otherwise(F.col("words"))
    held = of_sentences.where(F.size("words") >= min(sizes)).select(by.alias("key"), *more, words.alias("words"))
    begins = F.sequence(F.lit(1), F.size("words") - (min(sizes) - 1))
    begins = F.filter(begins, lambda i: ~F.element_at("words", i).isin(MEANINGLESS)) if only_meaningful else begins
    places = F.transform(begins, lambda i: F.array_join(F.slice("words", i, max(sizes)), grams.BETWEEN))
    each = held.select("key", F.explode(places).alias("w"), *more)
    return each.repartition(_shares(of_sentences), "key", F.substring_index("w", grams.BETWEEN, 2)).sortWithinPartitions("key", "w")


def ngram_counts(of_sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4, 5), least: int = 1, only_meaningful: bool = False, top: int | None = None) -> DataFrame:
    """(n, gram, frequency, first_doc); those as frequent as `least`, meaningful if asked.

    Each place sends the longest gram that begins there, once, to where its first two words belong. All grams that begin
    there are its beginnings, and counted in the sorted stream without another shuffle. With `top`, of grams of more than
    two words only such come back among which the `top` most frequent of each size are.
    """
    direct = _direct(sizes)
    longer = tuple(n for n in sizes if n not in direct)
    counts = []
    if direct:
        short = _short_grams(of_sentences, direct).where(F.col("frequency") >= least)
        counts.append(meaningful(short).where("meaningful").drop("meaningful") if only_meaningful else short)
    if longer:
        schema = StructType([StructField("n", IntegerType()), StructField("gram", ArrayType(StringType())), StructField("frequency", LongType()), StructField("first_doc", of_sentences.schema["doc_id"].dataType)])
        counts.append(_windows(of_sentences, longer, F.lit(""), "doc_id", only_meaningful=only_meaningful).mapInArrow(partial(_gram_rows, longer, least, only_meaningful, top), schema))
    return reduce(DataFrame.unionByName, counts)


def _gram_rows(sizes: tuple[int, ...], least: int, only_meaningful: bool, top: int | None, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in grams.counted(parts, sizes, MEANINGLESS):
        if least > 1 or only_meaningful:
            g = g.where(np.flatnonzero((g.frequency >= least) & (g.meaningful() if only_meaningful else True)))
        g = grams.most_frequent(g, top) if top else g
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g.frequency), g.n, np.int32)), g.grams(), pa.array(g.frequency), g.first], names=["n", "gram", "frequency", "first_doc"])


def ngram_sizes(of_sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4, 5), by: str | None = None) -> DataFrame:
    """ngram_summary() of all grams (of each value of a text column): summed where they are counted, so that no gram is a row."""
    direct = _direct(sizes)
    longer = tuple(n for n in sizes if n not in direct)
    key = F.col(by) if by else F.lit("")
    names = ("total", "unique_grams", "meaningful_grams")
    sums = []
    if direct:
        sums.append(ngram_summary(_short_grams(of_sentences.withColumn("key", key), direct, ("key",)), ("key",)))
    if longer:
        sums.append(_windows(of_sentences, longer, key).mapInArrow(partial(_gram_sums, longer), "key string, n int, total long, unique_grams long, meaningful_grams long"))
    total = reduce(DataFrame.unionByName, sums).groupBy("key", "n").agg(*[F.sum(c).alias(c) for c in names])
    return total.select(*([F.col("key").alias(by)] if by else []), "n", *names)


def _gram_sums(sizes: tuple[int, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    for g in grams.counted(parts, sizes, MEANINGLESS):
        sums[g.key, g.n] = sums.get((g.key, g.n), 0) + np.array([g.frequency.sum(), len(g.frequency), (g.meaningful() & (g.frequency >= 2)).sum()])
    rows = [(key, n, *v.tolist()) for (key, n), v in sums.items()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "n", "total", "unique_grams", "meaningful_grams"])


def _shares(rows: DataFrame) -> int:
    """How many partitions rows are dealt over: by the size of what they are read from, where that is known."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(4096, size // GRAMS_SHARE)) if size < 1 << 50 else least


def meaningful(grams: DataFrame) -> DataFrame:
    return grams.withColumn("meaningful", T.is_meaningful(F.col("gram"), MEANINGLESS))


def ngram_summary(grams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total, unique and meaningful (twice or more) n-grams for each n."""
    good = meaningful(grams)
    return good.groupBy(*by, "n").agg(F.sum("frequency").alias("total"), F.count("*").alias("unique_grams"), F.count_if((F.col("frequency") >= 2) & F.col("meaningful")).alias("meaningful_grams"))


def top_ngrams(grams: DataFrame, of_sentences: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent of each n, ties in order of first sight. Spark limits each partition's group first.

    Numbers decide but for grams that one document has first; where in it they stand is looked up there only.
    """
    place = F.rank().over(W.partitionBy("n").orderBy(F.desc("frequency"), "first_doc"))
    some = checkpoint(grams.withColumn("place", place).where(F.col("place") <= k).select("n", "gram", "frequency", "first_doc"))
    sizes = tuple(r["n"] for r in some.select("n").distinct().orderBy("n").collect()) or (1,)
    where = F.broadcast(some.select(F.col("first_doc").alias("doc_id")).distinct())  # k a size at most
    seen = grams_of(of_sentences.join(where, "doc_id", "left_semi"), sizes).groupBy("doc_id", "n", "gram").agg(F.min(F.struct("sent_id", "at")).alias("first"))
    both = some.join(seen.withColumnRenamed("doc_id", "first_doc"), ["first_doc", "n", "gram"])
    rank = F.row_number().over(W.partitionBy("n").orderBy(F.desc("frequency"), "first_doc", "first"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("n", "rank", F.array_join("gram", " ").alias("ngram"), "frequency")


def dictionary_growth(sums: DataFrame) -> DataFrame:
    """Each n-gram dictionary's size against that of single words, from ngram_sizes() or ngram_summary()."""
    sizes = sums.select("n", F.col("unique_grams").alias("size"))
    single = sizes.where("n = 1").select(F.col("size").alias("single"))
    return sizes.join(single, F.lit(True)).select("n", "size", (F.col("size") / F.col("single")).alias("growth"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Measure, before, after and change in percent for two (doc_id, pos, term) tables."""
    one = lambda df, name: df.agg(F.count("*").alias(f"tokens_{name}"), F.count_distinct("term").alias(f"vocabulary_{name}"))
    both = one(before, "before").join(one(after, "after"), F.lit(True))
    rows = both.selectExpr("stack(2, 'tokens', tokens_before, tokens_after, 'vocabulary', vocabulary_before, vocabulary_after) as (measure, before, after)")
    return rows.withColumn("change_pct", 100.0 * (F.col("after") - F.col("before")) / F.col("before"))


def lemma_map(pairs: DataFrame) -> DataFrame:
    """(pipeline, surface, lemma): the most frequent lemma, the first seen of equals; pairs has (pipeline, surface, lemma, ord)."""
    counts = pairs.groupBy("pipeline", "surface", "lemma").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))
    return counts.groupBy("pipeline", "surface").agg(F.min_by("lemma", F.struct(-F.col("n"), "first_seen")).alias("lemma"))


def first_label(rows: DataFrame, key: str, label: str, order: Column) -> DataFrame:
    """The label that each key had first."""
    return rows.groupBy(key).agg(F.min_by(label, order).alias(label))
