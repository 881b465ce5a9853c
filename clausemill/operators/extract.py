"""Entities, numbers, obligations and morphology of contract texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..kernels import annotate, stem, tokens
from ..kernels.clean import clean, normalise_numbers
from ..kernels.ocr import AMOUNT_LINE
from ..kernels.words import APART, CUSTOM_STOP_WORDS, DOMAIN_PROBES, MODALS, NEGATION_PROBES, NEGATIONS, STOP_WORDS, TOGETHER
from ..plans.pipelines import PIPELINES, flat, sentences_by_pipeline, surfaces
from ..session import written

_CLASS = dict(tokens.CLASSES)
# Entity labels found by rule; amounts as in the tokenizer.
ENTITY_RULES = (
    ("MONEY", _CLASS["MONEY"]),
    ("DATE", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("LAW", r"(?:Section|Sec\.)\s\d+[A-Z]?(?:\(\d+\))?|(?:[A-Z][a-z]+\s)+Act,?\s\d{4}"),
    ("DURATION", r"\b\d+\s*(?:\([a-z\- ]+\)\s*)?(?:days?|weeks?|months?|years?)\b"),
    (
        "DESIGNATION",
        r"\b(?:(?:Senior|Junior|Lead|Principal|Associate|Chief)\s)?(?:(?:Software|Data|Research|Sales|Marketing|HR|Finance|"
        r"Product|Technical)\s)?(?:Engineer|Developer|Analyst|Manager|Consultant|Executive|Scientist|Designer|Officer|Architect)\b",
    ),
)
_ENTITIES = [(label, re.compile(pattern)) for label, pattern in ENTITY_RULES]


def rule_entities(text: str) -> list[tuple[int, int, str]]:
    """Spans of the rules, overlaps resolved longest first."""
    return tokens.longest_first([(m.start(), m.end(), label) for label, pattern in _ENTITIES for m in pattern.finditer(text)])


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, text) by rule."""
    found = K.each(lambda t: [{"start": a, "end": b, "label": label, "text": t[a:b]} for a, b, label in rule_entities(t)], "array<struct<start:int,end:int,label:string,text:string>>")
    return docs.select("doc_id", F.explode(found(F.col("text"))).alias("e")).select("doc_id", "e.*")


def merge_entities(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule spans and the model's spans that overlap none of them; both (doc_id, start, end, label)."""
    r = rules.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    kept = model.join(r, (model["doc_id"] == r["d"]) & (model["start"] < r["e"]) & (r["s"] < model["end"]), "left_anti")
    cols = ["doc_id", "start", "end", "label"]
    return kept.select(*cols).unionByName(rules.select(*cols))


def entity_inventory(found: DataFrame, default: DataFrame) -> DataFrame:
    """(text, label, default_label, frequency, correct): default has (text, label, ord), its first label counts."""
    counts = found.groupBy("text", "label").agg(F.count("*").alias("frequency"))
    first = default.groupBy("text").agg(F.min_by("label", "ord").alias("default_label"))
    return counts.join(first, "text", "left").select("text", "label", F.coalesce("default_label", F.lit("(missed)")).alias("default_label"), "frequency", F.lit("").alias("correct"))


def numeric_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, money, dates, durations, other_numbers)."""
    typed = docs.select("doc_id", T.normalise_numbers(T.text("text")).alias("t")).withColumn("k", K.typed_counts(F.col("t")))
    n = lambda kind: F.coalesce(F.col("k")[kind], F.lit(0).cast("long"))
    return typed.select("doc_id", n("MONEY").alias("money"), n("DATE").alias("dates"), F.regexp_count("t", F.lit(T.DURATION)).cast("long").alias("durations"), n("NUMBER").alias("other_numbers"))


def amount_lines(docs: DataFrame, k: int = 12) -> DataFrame:
    """The first k lines with an amount, in order of document and line."""
    each = docs.select("doc_id", F.posexplode(F.split(T.text("text"), "\n")).alias("line_no", "line"))
    return each.where(F.col("line").rlike(AMOUNT_LINE.pattern)).orderBy("doc_id", "line_no").limit(k)


#: A token of a sentence.
DEPENDENCY = "pos int, text string, lemma string, tag string, dep string, head int"
TOKENS = "array<struct<" + DEPENDENCY.replace(" string", ":string").replace(" int", ":int") + ">>"


def annotated_sentences(docs: DataFrame, wanted: Callable[[list[annotate.Token]], object] | None = None) -> DataFrame:
    """(doc_id, sent_id, tokens): rule-based annotation, of the wanted sentences or all."""
    fields = [(f.split()[0], pa.string() if f.endswith("string") else pa.int32()) for f in DEPENDENCY.split(", ")]

    def build(texts: list[str]) -> tuple[list[int], list[pa.Array]]:
        found = [(k, s) for k, t in enumerate(texts) for s in map(annotate.shallow_dependencies, annotate.annotate(clean(t))) if s and (wanted is None or wanted(s))]
        every = [x for _, s in found for x in s]
        columns = [pa.array([getattr(x, name) for x in every], kind) for name, kind in fields]
        at = pa.array([0, *accumulate(len(s) for _, s in found)], pa.int32())
        lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, names=[name for name, _ in fields]))
        return [k for k, _ in found], [pa.array([s[0].sent for _, s in found], pa.int32()), lists]

    return K.rows_of(docs, build, f"sent_id int, tokens {TOKENS}")


def annotations(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, text, lemma, tag, dep, head): rule-based; model-backed annotators give the same columns."""
    return annotated_sentences(docs).select("doc_id", "sent_id", F.explode("tokens").alias("a")).select("doc_id", "sent_id", "a.*")


def sentences_of(annotated: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tokens) of annotated_sentences(), or of a row per token."""
    if "tokens" in annotated.columns:
        return annotated
    names = [f.split()[0] for f in DEPENDENCY.split(", ")]
    return annotated.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("tokens"))


def has_modal(sentence: list[annotate.Token]) -> bool:
    """Whether obligations() finds anything in the sentence."""
    return any(t.head >= 0 and t.text.lower() in MODALS for t in sentence)


def obligations(annotated: DataFrame) -> DataFrame:
    """(doc_id, sent_id, subject, modal, negated, verb, object, type) of modal verbs and their heads, each within its sentence."""
    t = F.col("tokens")
    modals = F.filter(t, lambda x: F.lower(x["text"]).isin(sorted(MODALS)) & (x["head"] >= 0))
    held = sentences_of(annotated).select("doc_id", "sent_id", "tokens", F.explode(modals).alias("m"))
    verb = F.get(F.filter(t, lambda x: (x["pos"] == F.col("m.head")) & x["tag"].rlike("^(VB|MD)")), F.lit(0))
    below = lambda *dep: F.filter(t, lambda x: (x["head"] == F.col("m.head")) & x["dep"].isin(*dep))
    first = lambda *dep: F.array_min(F.transform(below(*dep), lambda x: x["pos"]))
    placed = held.select("*", verb.alias("v"), first("nsubj", "nsubjpass").alias("s"), first("dobj", "attr", "oprd").alias("o"), (F.size(below("neg")) > 0).alias("negated")).where(F.col("v").isNotNull())
    phrase = lambda at: F.coalesce(F.array_join(F.transform(F.filter(t, lambda x: (x["head"] == F.col(at)) | (x["pos"] == F.col(at))), lambda x: x["text"]), " "), F.lit(""))
    strong, negated = F.lower("m.text").isin("shall", "must"), F.col("negated")
    kind = F.when(strong & negated, "PROHIBITION").when(strong, "OBLIGATION").when(negated, "RESTRICTED RIGHT").otherwise("RIGHT")
    return placed.select("doc_id", "sent_id", phrase("s").alias("subject"), F.col("m.text").alias("modal"), "negated", F.col("v.lemma").alias("verb"), phrase("o").alias("object"), kind.alias("type"))


def noun_phrases(annotated: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent runs of two or more nouns and adjectives, as lemmas without stop words; runs end with their sentence."""
    is_part = lambda x: x["tag"].rlike("^(NN|JJ)") & ~F.lower(x["text"]).isin(sorted(STOP_WORDS))
    # control characters, which are in no word, stand between lemmas and for what ends a run
    line = F.array_join(F.transform("tokens", lambda x: F.when(is_part(x), F.lower(x["lemma"])).otherwise("\x02")), "\x01")
    found = F.filter(F.split(line, "\x01?\x02\x01?"), lambda x: F.contains(x, F.lit("\x01")))
    phrases = sentences_of(annotated).select(F.explode(found).alias("p")).select(F.replace("p", F.lit("\x01"), F.lit(" ")).alias("noun_phrase"))
    return phrases.groupBy("noun_phrase").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "noun_phrase").limit(k)


def stemming_tests(spark) -> DataFrame:
    """(stemmer, over_errors, under_errors): groups that collapse although they differ, and that don't although they should."""
    rows = [(kind, n, w) for kind, groups in (("apart", APART), ("together", TOGETHER)) for n, g in enumerate(groups) for w in g]
    words = spark.createDataFrame(rows, "kind string, g int, word string")
    each = words.select("kind", "g", F.explode(F.array(*[F.struct(F.lit(s).alias("stemmer"), K.stemmed(s)(F.col("word")).alias("stem")) for s in stem.STEMMERS])).alias("x")).select("kind", "g", "x.*")
    groups = each.groupBy("stemmer", "kind", "g").agg(F.count_distinct("stem").alias("d"), F.count("*").alias("n"))
    over, under = (F.col("kind") == "apart") & (F.col("d") < F.col("n")), (F.col("kind") == "together") & (F.col("d") > 1)
    return groups.groupBy("stemmer").agg(F.count_if(over).alias("over_errors"), F.count_if(under).alias("under_errors"))


def best_stemmer(tests: DataFrame) -> DataFrame:
    return tests.orderBy("over_errors", "under_errors", "stemmer").limit(1)


def stop_word_order(words: DataFrame, stemmer: str = "porter") -> DataFrame:
    """Tokens and vocabulary if stop words go before or after stemming; words has (term)."""
    counted = words.groupBy("term").agg(F.count("*").alias("n")).withColumn("stem", K.stemmed(stemmer)(F.col("term")))
    stop = sorted(STOP_WORDS)
    first, after = ~F.col("term").isin(stop), ~F.col("stem").isin(stop)
    row = lambda name, kept, leaked: counted.agg(F.lit(name).alias("order"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("tokens"), F.count_distinct(F.when(kept, F.col("stem"))).alias("vocabulary"), F.coalesce(F.sum(F.when(leaked, F.col("n"))), F.lit(0)).alias("surviving"))
    return row("stop words, then stems", first, F.lit(False)).unionByName(row("stems, then stop words", after, ~first & after))


def second_list() -> frozenset[str]:
    """Another general stop list: the English one of Spark ML."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def stop_word_meaning(spark, sentences: list[str], lists: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Each sentence as each stop list leaves it."""
    lists = lists or {"general": STOP_WORDS, "second": second_list(), "custom": CUSTOM_STOP_WORDS}
    own = spark.createDataFrame([(s,) for s in sentences], "sentence string").withColumn("w", F.filter(K.tokenize("treebank")(F.lower("sentence")), lambda x: x.rlike(r"^\p{L}+$")))
    left = lambda words: F.filter("w", lambda x: ~x.isin(sorted(words)))
    return own.select("sentence", *[F.array_join(left(words), " ").alias(name) for name, words in lists.items()])


def pipeline_tokens(docs: DataFrame, names: tuple[str, ...] = tuple(PIPELINES)) -> DataFrame:
    """(pipeline, doc_id, sent_id, words): every pipeline's sentences, texts read, cleaned and sent to Python once."""

    def build(texts: list[str]) -> tuple[list[int], list[pa.Array]]:
        rows = [(k, p, n, words) for k, t in enumerate(texts) for p, of in zip(names, sentences_by_pipeline(names, t), strict=True) for n, words in enumerate(of)]
        number, pipeline, sent_id, words = map(list, zip(*rows)) if rows else ([], [], [], [])
        return number, [pa.array(pipeline, pa.string()), pa.array(sent_id, pa.int32()), pa.array(words, pa.list_(pa.string()))]

    return K.rows_of(docs, build, "pipeline string, sent_id int, words array<string>").select("pipeline", "doc_id", "sent_id", "words")


def flat_tokens(of_pipelines: DataFrame) -> DataFrame:
    """(pipeline, doc_id, pos, term): positions count through a document's sentences."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.size("words")).over(W.partitionBy("pipeline", "doc_id").orderBy("sent_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return of_pipelines.withColumn("base", before).select("pipeline", "doc_id", "base", F.posexplode("words").alias("p", "term")).select("pipeline", "doc_id", (F.col("base") + F.col("p")).cast("int").alias("pos"), "term")


def surface_lemmas(docs: DataFrame, name: str) -> DataFrame:
    """(pipeline, surface, lemma, ord) of every token."""
    found = K.each(lambda t: [{"surface": a, "lemma": b} for a, b in surfaces(name, t)], "array<struct<surface:string,lemma:string>>")
    return docs.select("doc_id", F.posexplode(found(F.col("text"))).alias("pos", "x")).select(F.lit(name).alias("pipeline"), "x.surface", "x.lemma", F.struct("doc_id", "pos").alias("ord"))


def probes_kept(name: str) -> dict[str, int]:
    """How many domain probes a pipeline keeps apart, and how many negations it keeps; a handful of words, no job."""
    outs = [tuple(flat(name, p)) for p in DOMAIN_PROBES]
    kept = sum(bool(o) and outs.count(o) == 1 for o in outs)
    return {"domain_terms": kept, "domain_probes": len(outs), "negations": sum(any(w in flat(name, t) for w in NEGATIONS) for t in NEGATION_PROBES), "negation_probes": len(NEGATION_PROBES)}


def pipeline_table(of_pipelines: DataFrame, seconds: dict[str, float] | None = None) -> DataFrame:
    """(pipeline, ord, token_count, vocabulary, meaningful_ngrams, domain_terms, negations[, seconds])."""
    from .corpus import ngram_sizes

    spark = of_pipelines.sparkSession
    single = F.col("n") == 1
    held = written(of_pipelines)  # read for words and for longer grams; the pipelines are the dear part
    counts = ngram_sizes(held, (1, 2, 3), by="pipeline").groupBy("pipeline").agg(
        F.sum(F.when(single, F.col("total"))).alias("token_count"), F.sum(F.when(single, F.col("unique_grams")).otherwise(0)).alias("vocabulary"),
        F.sum(F.when(~single, F.col("meaningful_grams")).otherwise(0)).alias("meaningful_ngrams"),
    )
    rows = [(n, i, *(probes_kept(n)[k] for k in ("domain_terms", "negations")), (seconds or {}).get(n)) for i, n in enumerate(PIPELINES)]
    probes = spark.createDataFrame(rows, "pipeline string, ord int, domain_terms int, negations int, seconds double")
    return probes.join(counts, "pipeline")


def entity_counts(found: DataFrame) -> DataFrame:
    """(label, frequency), the most frequent first."""
    return found.groupBy("label").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "label")


def lemma_table(spark, words: list[str]) -> DataFrame:
    """(word, stems by each stemmer, lemma as a noun, lemma by its tag)."""
    rows = [(w, *(f(w) for f in stem.STEMMERS.values()), annotate.lemma(w), annotate.lemma(w, annotate.tag([w])[0])) for w in words]
    return spark.createDataFrame(rows, "word string, " + ", ".join(f"{s} string" for s in stem.STEMMERS) + ", lemma string, lemma_by_tag string")


def analyze(text: str) -> dict:
    """Typed tokens of the text as it is, and the final pipeline's tokens with their tags; no job for one text."""
    final = flat("Final Pipeline", text)
    return {"tokens": [{"text": a, "type": b} for a, b in tokens.typed(text)], "final": final, "tags": annotate.tag(final), "cleaned": normalise_numbers(clean(text))}


