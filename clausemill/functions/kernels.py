"""Per-document kernels as vectorised UDFs: one Arrow batch in, one out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..kernels import clean as _clean
from ..kernels import ocr, stem, tokens
from ..plans.pipelines import flat, sentences_by_pipeline


#: Texts whose results are Python objects at the same time, and characters after which fewer are.
ROWS, CHARACTERS = 64, 1 << 18


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(where it starts, texts) of runs of a few texts; null counts as empty."""
    start, run, held = 0, [], 0
    for k in range(0, len(texts), ROWS):
        for t in texts.slice(k, ROWS).to_pylist():
            run.append(t or "")
            held += len(run[-1])
            if len(run) >= ROWS or held >= CHARACTERS:
                yield start, run
                start, run, held = start + len(run), [], 0
    if run:
        yield start, run


def each(f: Callable, schema: str) -> Callable[[Column], Column]:
    """A column function from a function of one text; null counts as empty.

    Results become Arrow values a few texts at a time: as Python objects, those of a whole batch can take gigabytes.
    """

    def of(column: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(schema))

        def run(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([], kind), *(pa.array([f(t) for t in some], kind) for _, some in chunks(texts))])

        return F.arrow_udf(run, schema)(column)

    return of


def rows_of(docs: DataFrame, build: Callable[[list[str]], tuple[list[int], list[pa.Array]]], fields: str) -> DataFrame:
    """(doc_id, fields) of documents(doc_id, text): build gives, of a few texts, each row's text number and the columns.

    Python hands the rows over as they come, so neither side ever holds the rows of a whole batch of texts.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *_parse_datatype_string(fields)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        for part in parts:
            ids, texts = part.column(0), part.column(1)
            for start, some in chunks(texts):
                number, columns = build(some)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(some)).take(pa.array(number, pa.int64())), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


clean_text = each(_clean.clean, "string")
normalise = each(_clean.normalise, "string")
dehyphenate = each(_clean.dehyphenate, "string")
without_headers = each(lambda t: "\n".join(_clean.drop_headers([x.strip() for x in t.split("\n")])), "string")
typed_tokens = each(lambda t: [{"text": a, "type": b} for a, b in tokens.typed(t)], "array<struct<text:string,type:string>>")
sentences = each(tokens.sentences, "array<string>")
#: How many tokens of each type a text has: a handful of numbers instead of all tokens.
typed_counts = each(lambda t: list(Counter(m.lastgroup for m in tokens.TYPED.finditer(t)).items()), "map<string,bigint>")


def tokenize(name: str) -> Callable[[Column], Column]:
    """The tokenizer of that name; `kernel` is its function of one text."""
    column = each(tokens.TOKENIZERS[name], "array<string>")
    column.kernel = tokens.TOKENIZERS[name]
    return column


def token_count(name: str) -> Callable[[Column], Column]:
    """How many tokens the tokenizer of that name finds."""
    return each(lambda t: len(tokens.TOKENIZERS[name](t)), "int")


def stemmed(name: str) -> Callable[[Column], Column]:
    return each(stem.STEMMERS[name], "string")


def repair(mode: str) -> Callable[[Column], Column]:
    """(text, fixed, unresolved) of amounts repaired in that mode."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ocr.repair_amounts(t or "", mode) for t in texts], columns=["text", "fixed", "unresolved"])

    return lambda column: F.pandas_udf(run, "struct<text:string,fixed:int,unresolved:int>")(column)


def pipeline_sentences(names: tuple[str, ...]) -> Callable[[Column], Column]:
    """Preprocessing pipelines' sentences of tokens, in the order of the names; the text is cleaned once."""
    return each(lambda t: sentences_by_pipeline(names, t), "array<array<array<string>>>")


def pipeline_terms(name: str) -> Callable[[Column], Column]:
    """A preprocessing pipeline's tokens, through all sentences."""
    return each(lambda t: flat(name, t), "array<string>")
