"""Registered queries that SQL can't express, against plain Python over the smallest tables."""

import re
from collections import Counter, defaultdict
from itertools import pairwise

import pytest

from clausemill.kernels import annotate, clean, stem, tokens, words
from clausemill.operators import subwords
from clausemill.plans import contracts, pipelines, registry
from clausemill.sources.readers import html_text


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, small, name):
    return registry.QUERIES[name](spark, small).collect()


def test_cleaned_documents(spark, small, texts):
    assert {r["doc_id"]: r["text"] for r in rows(spark, small, "cleaned_documents")} == {i: clean.clean(t) for i, t in texts.items()}


def test_rejoined_lines(spark, small, texts):
    got = defaultdict(list)
    for r in rows(spark, small, "rejoined_lines"):
        got[r["doc_id"]].append((r["paragraph_no"], r["paragraph"]))
    assert {i: [p for _, p in sorted(x)] for i, x in got.items()} == {i: clean.rejoin([x.strip() for x in t.split("\n")]) for i, t in texts.items()}


def test_page_texts(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in rows(spark, small, "page_texts")} == {i: html_text(h) for i, h in pages.items()}


def test_typed_tokens_and_numbers(spark, small, texts):
    want = Counter((i, kind) for i, t in texts.items() for _, kind in tokens.typed(t))
    assert {(r["doc_id"], r["type"]): r["n"] for r in rows(spark, small, "typed_tokens")} == want
    assert {r["doc_id"]: r["n"] for r in rows(spark, small, "hybrid_token_counts")} == {i: len(tokens.hybrid(t)) for i, t in texts.items()}
    profile = {}
    for i, t in texts.items():
        kinds = Counter(kind for _, kind in tokens.typed(clean.normalise_numbers(t)))
        durations = len(re.findall(r"(?i)\b\d+\s+(?:days?|weeks?|months?|years?)\b", clean.normalise_numbers(t)))
        profile[i] = (kinds["MONEY"], kinds["DATE"], durations, kinds["NUMBER"])
    assert {r["doc_id"]: tuple(r)[1:] for r in rows(spark, small, "numeric_profile")} == profile


def test_corpus_tokenizers(spark, small, texts):
    for r in rows(spark, small, "corpus_tokenizers"):
        every = [x for t in texts.values() for x in tokens.TOKENIZERS[r["tokenizer"]](t)]
        assert (r["tokens"], r["token_dictionary"], r["term_dictionary"]) == (len(every), len(set(every)), len(tokens.terms(every)))


def test_pipelines(spark, small, texts):
    sentences = {n: {i: pipelines.PIPELINES[n](clean.clean(t)) for i, t in texts.items()} for n in pipelines.PIPELINES}
    for r in rows(spark, small, "pipeline_comparison"):
        own = [s for d in sentences[r["pipeline"]].values() for s in d]
        flat = [t for s in own for t in s]
        grams = Counter(tuple(s[k : k + n]) for s in own for n in (2, 3) for k in range(len(s) - n + 1))
        good = sum(c >= 2 and g[0] not in words.FUNCTION_WORDS and g[-1] not in words.FUNCTION_WORDS for g, c in grams.items())
        assert (r["token_count"], r["vocabulary"], r["meaningful_ngrams"]) == (len(flat), len(set(flat)), good)
    index = defaultdict(list)
    for i, d in sentences["Final Pipeline"].items():
        for pos, t in enumerate(t for s in d for t in s):
            index[t, i].append(pos)
    assert {(r["term"], r["doc_id"]): list(r["positions"]) for r in rows(spark, small, "pipeline_index")} == index


def test_stems(spark, small, texts):
    want = {}
    for name, f in stem.STEMMERS.items():
        over = sum(len({f(w) for w in g}) < len(g) for g in words.APART)
        want[name] = (over, sum(len({f(w) for w in g}) > 1 for g in words.TOGETHER))
    assert {r["stemmer"]: (r["over_errors"], r["under_errors"]) for r in rows(spark, small, "stemming_tests")} == want
    terms = [w for t in texts.values() for w in re.findall("[a-z]+", t.lower())]
    before = [stem.STEMMERS["porter"](w) for w in terms if w not in words.STOP_WORDS]
    after = [(w, s) for w in terms if (s := stem.STEMMERS["porter"](w)) not in words.STOP_WORDS]
    got = {r["order"]: tuple(r)[1:] for r in rows(spark, small, "stop_word_order")}
    assert got["stop words, then stems"] == (len(before), len(set(before)), 0)
    assert got["stems, then stop words"] == (len(after), len({s for _, s in after}), sum(w in words.STOP_WORDS for w, _ in after))


def test_noun_phrases(spark, small, texts):
    counts = Counter()
    for t in texts.values():
        for s in annotate.annotate(clean.clean(t)):
            run = []
            for x in [*s, None]:
                if x is not None and x.tag.startswith(("NN", "JJ")) and x.text.lower() not in words.STOP_WORDS:
                    run.append(x.lemma.lower())
                else:
                    if len(run) >= 2:
                        counts[" ".join(run)] += 1
                    run = []
    assert [tuple(r) for r in rows(spark, small, "noun_phrases")] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:15]
    assert rows(spark, small, "obligations") == [] and rows(spark, small, "rule_entities") == []  # the tables hold no contracts


def test_subword_table(spark, small, texts):
    table = {r["word"]: list(r["subwords"]) for r in rows(spark, small, "subword_table")}
    merges = subwords.learn_merges(subwords.pre_tokens(registry.documents(spark, small)), vocabulary=2000)
    rank = {p: n for n, p in enumerate(merges)}
    pieces = Counter(p for t in texts.values() for p in re.findall(r"\w+|[^\w\s]+", clean.normalise(t)))
    pairs = Counter()
    for p, n in pieces.items():
        for pair in pairwise(p):
            pairs[pair] += n
    assert merges[0] == min(pairs, key=lambda p: (-pairs[p], p))
    for word, found in table.items():
        whole = [s for p in re.findall(r"\w+|[^\w\s]+", word) for s in subwords.split_word(p, rank)]
        assert found == whole and "".join(found) == "".join(re.findall(r"\w+|[^\w\s]+", word))


def test_taggers_learn(spark, small):
    got = {r["tagger"]: r for r in contracts.QUERIES["tagging_scores_learned"](spark, small).collect()}
    rules = {r["tagger"]: r for r in contracts.QUERIES["tagging_scores"](spark, small).collect()}
    assert got["learned with domain"]["domain_accuracy"] > got["learned"]["domain_accuracy"] and got["learned with domain"]["accuracy"] > 0.7
    assert rules["domain"]["domain_accuracy"] > rules["general"]["domain_accuracy"] and rules["general"]["accuracy"] > rules["shapes"]["accuracy"]


def test_two_subword_tables(spark, small):
    found = contracts.QUERIES["subwords_by_two_tokenizers"](spark, small).collect()
    assert len(found) == 28 and all(r["n_subwords"] == len(r["subwords"]) for r in found)
    assert all(r["public_subwords"] is None or r["n_public"] == len(r["public_subwords"]) for r in found)
