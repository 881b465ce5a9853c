"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of words; their hashes form a set that travels inside the plan to every task,
like a broadcast, and is probed by every window of every document (`IN` over literals is a hash set). Windows
that hit are cut out, verified word by word against the benchmark's windows, and reduced to hit words and items
per document. A set of more than `set_limit` hashes would make too long a plan: it is a broadcast relation then, which the
exploded windows are joined with where they are, and only those that hit are shuffled. Only a set of more than
`broadcast_limit` hashes, of 16 bytes each, is joined by a shuffle of the windows. All three give the same rows.

Defined cases: a null text has no words; an item without words has no window; an item shorter than a window is
one window of its own length; repeated benchmark rows and repeated documents change nothing and are each
reported; items with a null id count as hits but not as items. Columns other than id and text aren't read, and
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import bounded, lower_ascii

#: Separators of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, gram, hash): the distinct windows of every item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = items.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), p -> slice(w, p, size))")).alias("gram"))
    return at.select("item", "size", "gram", F.xxhash64("gram").alias("hash")).distinct()


def _spots(size: int, probe: str) -> str:
    """SQL: the windows of the given size among the words w whose hash passes the probe."""
    window = f"slice(w, p + 1, {size})"
    return f"if(size(w) >= {size}, transform(filter(sequence(0, size(w) - {size}), p -> {probe.format(f'xxhash64({window})')}), p -> struct(p as at, {window} as gram)), array())"


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, set_limit: int = 50_000, broadcast_limit: int = 4_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, key, n_words, spans, items) per row: spans are (at, size) in words, distinct; items distinct and sorted.

    key is a hash of the text; (id, key) leads back to the rows of docs.
    """
    grams = benchmark_windows(benchmark, window, item_col, item_text_col)
    hashes = grams.select("size", "hash").distinct()
    few = hashes.limit(set_limit + 1).collect()  # at most set_limit + 1 pairs of numbers
    by_size: dict[int, list[int]] = {}
    for row in few:
        by_size.setdefault(row["size"], []).append(row["hash"])
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))
    if len(few) <= set_limit:
        spots = [_spots(size, "{} in (" + ",".join(f"{h}L" if h != -(1 << 63) else "(-9223372036854775807L - 1L)" for h in found) + ")") for size, found in sorted(by_size.items())]
        found = F.expr(f"concat({', '.join(spots)})") if spots else F.expr("cast(array() as array<struct<at:int,gram:array<string>>>)")
        rows = checkpoint(kept.select("id", "key", F.size("w").alias("n_words"), found.alias("spots")))
        spot = rows.where("size(spots) > 0").select("id", "key", F.explode("spots").alias("s")).select("id", "key", "s.at", "s.gram", F.xxhash64("s.gram").alias("hash"))
        grams = F.broadcast(grams)  # at most set_limit windows
    else:
        rows = kept.select("id", "key", F.size("w").alias("n_words"))
        sizes = [r["size"] for r in hashes.select("size").distinct().collect()]  # at most `window` numbers
        every = F.expr(f"concat({', '.join(_spots(size, '{} is not null') for size in sorted(sizes))})")
        spot = kept.select("id", "key", F.explode(every).alias("s")).select("id", "key", "s.at", "s.gram", F.xxhash64("s.gram").alias("hash"))
        known = hashes.select("hash").distinct()
        spot = spot.join(F.broadcast(known) if known.count() <= broadcast_limit else known, "hash", "left_semi")
    sure = spot.join(grams, ["hash", "gram"]).groupBy("id", "key").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    sure = sure.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "spans", "items")
    both = rows.join(sure, rows["id"].eqNullSafe(sure["hit_id"]) & (rows["key"] == sure["hit_key"]), "left")
    none = F.expr("cast(array() as array<struct<at:int,size:int>>)")
    return both.select("id", "key", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def hit_words(spans: Column) -> Column:
    """Words inside any of the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """The rows of docs, columns as they are, whose share of hit words is at most max_share."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, benchmark, **options).where(hit_words(F.col("spans")) > max_share * F.col("n_words"))
    found = found.select(F.col("id").alias("_hit_id"), F.col("key").alias("_hit_key")).distinct()
    found = bounded(found)
    hit = docs[id_col].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs[text_col]) == found["_hit_key"])
    return docs.join(found, hit, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(id, text): every document with its hit words removed; a document that has hits is left as its other words,
    lower-cased and joined by single spaces, one without hits keeps its text."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, benchmark, **options).where("size(spans) > 0").select("id", "key", "spans").dropDuplicates(["id", "key"])
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    both = plain.join(found.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    both = both.withColumn("w", words_of(F.col("text"))).withColumn("gone", F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.size - 1))))"))
    left = F.expr("array_join(filter(transform(w, (x, i) -> if(array_contains(gone, i), null, x)), x -> x is not null), ' ')")
    return both.select("id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left).alias("text"))


