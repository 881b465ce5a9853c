"""Native column functions over text: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# As in kernels/clean.py; white space and digits of Unicode, line ends only where \n stands.
PAGE_LINE = r"(?imdU)^\s*page\s+\d+(\s+of\s+\d+)?\s*$"
NUMBER_LINE = r"(?mdU)^\s*\d+\s*$"
LABEL = r"(?mdU)^\s*(?:\d+(?:\.\d+)*|[a-z]|[ivx]+)[.)]\s+"
DURATION_TWICE = r"(?i)\b([0-9]+)\s*\(\s*[a-z\- ]+\s*\)\s*(days?|weeks?|months?|years?)"
DURATION = r"(?i)\b[0-9]+\s+(?:days?|weeks?|months?|years?)\b"


def text(column: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def whitespace_tokens(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def word_tokens(t: Column) -> Column:
    """Runs of Unicode word characters."""
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0))


def word_punct_tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def ascii_words(t: Column) -> Column:
    """Lower-cased runs of ASCII letters, the same in all engines."""
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))


def sentences_of_lines(t: Column) -> Column:
    """Arrays of words, one for each line that has any."""
    return F.filter(F.transform(F.split(F.lower(t), "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0))), lambda x: F.size(x) > 0)


def ngrams(words: Column, n: int) -> Column:
    """Arrays of n neighbours; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))).otherwise(F.array().cast("array<array<string>>"))


def drop_page_lines(t: Column) -> Column:
    return F.regexp_replace(t, PAGE_LINE, "")


def drop_number_lines(t: Column) -> Column:
    return F.regexp_replace(t, NUMBER_LINE, "")


def drop_labels(t: Column) -> Column:
    return F.regexp_replace(t, LABEL, "")


def collapse(t: Column) -> Column:
    """Single spaces and line ends, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{2,}", "\n"), r"^\s+|\s+$", "")


def raw_lower(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"(?U)\s+", " ")


def normalise_numbers(t: Column) -> Column:
    return F.regexp_replace(t, DURATION_TWICE, "$1 $2")


def query_type(q: Column) -> Column:
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    words = F.size(F.filter(F.split(F.regexp_replace(q, '^"+|"+$', ""), r"\s+"), lambda x: x != ""))
    out = F.when(padded.contains(" NOT "), "Boolean NOT").when(padded.contains(" AND "), "Boolean AND").when(padded.contains(" OR "), "Boolean OR")
    return out.when(words == 1, "Unigram").when(words == 2, "Bigram").when(words == 3, "Trigram").otherwise(F.concat(words.cast("string"), F.lit("-gram phrase")))


def is_meaningful(gram: Column, function_words: list[str]) -> Column:
    """First and last word are no function words."""
    return ~F.element_at(gram, 1).isin(function_words) & ~F.element_at(gram, -1).isin(function_words)


def reading_order(boxes: Column) -> Column:
    """(text, confidence) of a page's boxes, an array of (y, x, height, text, score).

    Folds the boxes from top to bottom: one whose middle is within 0.6 of the taller height of the line's drifting middle
    joins that line. Lines read from left to right; the confidence is the mean score in percent.
    """
    part = "struct<x:double,text:string>"
    start = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("tallest"), F.array().cast(f"array<array<{part}>>").alias("lines"))

    def add(done: Column, box: Column) -> Column:
        y, height, lines = box["b"]["y"], box["b"]["height"], done["lines"]
        joins = (F.size(lines) > 0) & (F.abs(y - done["level"]) <= 0.6 * F.greatest(done["tallest"], height))
        own = F.array(F.struct(box["b"]["x"].alias("x"), box["b"]["text"].alias("text")))
        longer = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(F.element_at(lines, -1), own)))
        return F.struct(
            F.when(joins, (done["level"] + y) / 2).otherwise(y).alias("level"), F.when(joins, F.greatest(done["tallest"], height)).otherwise(height).alias("tallest"),
            F.when(joins, longer).otherwise(F.concat(lines, F.array(own))).alias("lines"),
        )

    ordered = F.array_sort(F.transform(boxes, lambda b, n: F.struct(b["y"].alias("y"), n.alias("n"), b.alias("b"))))
    text = F.aggregate(ordered, start, add, lambda done: F.array_join(F.transform(done["lines"], lambda line: F.array_join(F.transform(F.array_sort(line), lambda x: x["text"]), " ")), "\n"))
    score = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + b["score"]) * 100 / F.size(boxes)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.when(F.size(boxes) > 0, score).otherwise(0.0).alias("confidence"))


def parsed_ngrams(cell: Column) -> Column:
    """(ngram, frequency) of a cell `ngram (n), ngram (n)`."""
    parts = F.split(cell, r"(?<=\([0-9]{1,18}\)),\s*")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(.*) \([0-9]+\)$", 1).alias("ngram"), F.regexp_extract(x, r"\(([0-9]+)\)$", 1).cast("long").alias("frequency")))
