"""The preprocessing pipelines that are compared: text in, sentences of tokens out."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from ..kernels.annotate import Token, annotate, hybrid_annotate
from ..kernels.clean import clean, normalise_numbers
from ..kernels.stem import STEMMERS
from ..kernels.tokens import sentences, treebank
from ..kernels.words import CUSTOM_STOP_WORDS, STOP_WORDS

STEMMER = "snowball"


@lru_cache(maxsize=1 << 17)
def stemmed(word: str) -> str:
    return STEMMERS[STEMMER](word)


def stemming(cleaned: str) -> list[list[str]]:
    """Treebank words, lower case, without stop words, stemmed."""
    out = ([stemmed(w.lower()) for w in treebank(s) if any(c.isalnum() or c == "_" for c in w) and w.lower() not in STOP_WORDS] for s in sentences(cleaned))
    return [s for s in out if s]


def lemmas(cleaned: str) -> list[list[str]]:
    """Lemmas of all words, stop words included."""
    out = ([t.lemma.lower() for t in s if not t.is_punct] for s in annotate(cleaned))
    return [s for s in out if s]


def final_token(t: Token) -> str:
    """Merged and non-alphabetic tokens keep their surface, others are lemmas."""
    return t.text.lower() if not t.text.isalpha() else t.lemma.lower()


def final_sentences(cleaned: str) -> list[list[Token]]:
    return hybrid_annotate(normalise_numbers(cleaned))


def final(cleaned: str) -> list[list[str]]:
    """Domain-aware tokens, lemmas, and then the domain's stop words removed."""
    out = ([x for t in s if not t.is_punct and (x := final_token(t)) not in CUSTOM_STOP_WORDS] for s in final_sentences(cleaned))
    return [s for s in out if s]


#: Pipelines by name, cleaned text in; more can be added, and every comparison then includes them.
PIPELINES: dict[str, Callable[[str], list[list[str]]]] = {"Pipeline A": stemming, "Pipeline B": lemmas, "Final Pipeline": final}


def sentences_by_pipeline(names: tuple[str, ...], text: str) -> list[list[list[str]]]:
    """Each pipeline's sentences of a text, which is cleaned (again) once."""
    cleaned = clean(text)
    return [PIPELINES[n](cleaned) for n in names]


def surfaces(name: str, text: str) -> list[tuple[str, str]]:
    """(lower-cased surface, lemma) of each token, for the corpus lemma map."""
    cleaned = clean(text)
    if name == "Pipeline B":
        return [(t.text.lower(), t.lemma.lower()) for s in annotate(cleaned) for t in s if not t.is_punct]
    if name == "Final Pipeline":
        return [(t.text.lower(), final_token(t)) for s in final_sentences(cleaned) for t in s if not t.is_punct]
    return []


def flat(name: str, text: str) -> list[str]:
    return [t for s in PIPELINES[name](clean(text)) for t in s]


def query_terms(name: str, text: str, lemma_of: dict[str, str] | None = None) -> list[str]:
    """The terms of a query operand. With the corpus lemma map, a surface gets the lemma that the corpus gave it."""
    if lemma_of is None or name == "Pipeline A":
        return flat(name, text)
    own = [lemma_of.get(surface, lemma) for surface, lemma in surfaces(name, text)]
    return [t for t in own if name != "Final Pipeline" or t not in CUSTOM_STOP_WORDS]
