"""Retrieval and tagging quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, relevant, retrieved, precision, recall, f1, p_at_k, r_at_k) for every row of queries.

    ranked: (query_id, doc_id, rank); relevant: (query_id, doc_id). Without any result precision is 1 if nothing is
    relevant, else 0; without relevant documents recall and F1 are null. P@k divides by the results among the first k.
    """
    truth = relevant.select("query_id", "doc_id").distinct().withColumn("is_relevant", F.lit(True))
    both = ranked.select("query_id", "doc_id", "rank").join(truth, ["query_id", "doc_id"], "full")
    counts = both.groupBy("query_id").agg(
        F.count_if("is_relevant").alias("relevant"), F.count("rank").alias("retrieved"), F.count_if(F.col("is_relevant") & F.col("rank").isNotNull()).alias("hits"),
        F.count_if(F.col("rank") <= k).alias("first"), F.count_if(F.col("is_relevant") & (F.col("rank") <= k)).alias("first_hits"),
    )
    zero = {c: 0 for c in ("relevant", "retrieved", "hits", "first", "first_hits")}
    c = queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(zero)
    empty = F.when(F.col("relevant") == 0, 1.0).otherwise(0.0)
    out = c.withColumns({
        "precision": F.when(F.col("retrieved") > 0, F.col("hits") / F.col("retrieved")).otherwise(empty), "recall": F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")),
        "p_at_k": F.when(F.col("first") > 0, F.col("first_hits") / F.col("first")).otherwise(empty), "r_at_k": F.when(F.col("relevant") > 0, F.col("first_hits") / F.col("relevant")),
    })
    total = F.col("precision") + F.col("recall")
    f1 = F.when(F.col("recall").isNull(), None).when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total)
    return out.withColumn("f1", f1).select("query_id", "relevant", "retrieved", "precision", "recall", "f1", "p_at_k", "r_at_k")


def with_judgements(manual: DataFrame, provisional: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, source): the manual judgements of queries that have any, else the provisional ones."""
    judged = manual.select("query_id").distinct()
    return manual.select("query_id", "doc_id", F.lit("manual").alias("source")).unionByName(
        provisional.join(judged, "query_id", "left_anti").select("query_id", "doc_id", F.lit("PROVISIONAL").alias("source"))
    )


def averages(results: DataFrame, by: str, metrics: tuple[str, ...] = ("precision", "recall", "f1", "p_at_k", "r_at_k")) -> DataFrame:
    """Means that skip missing values, NaN included."""
    return results.groupBy(by).agg(*[F.avg(F.nanvl(m, F.lit(None).cast("double"))).alias(m) for m in metrics])


def pivoted(rows: DataFrame, measures: tuple[str, ...], by: str, names: list[str]) -> DataFrame:
    """One row per measure, one column per name: a comparison table on its side."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
    long = rows.selectExpr(f"`{by}`", f"stack({len(measures)}, {pairs}) as (measure, value)")
    return long.groupBy("measure").pivot(by, names).agg(F.first("value"))


def first_of_type(results: DataFrame, order: str = "query_id") -> DataFrame:
    return results.withColumn("_n", F.row_number().over(W.partitionBy("type").orderBy(order))).where("_n = 1").drop("_n")


def select_pipeline(metrics: DataFrame) -> DataFrame:
    """Pipelines in order of F1, domain terms, negations, n-grams; equals in their given order (`ord`); ties of F1 marked."""
    order = [F.desc("f1"), F.desc("domain_terms"), F.desc("negations"), F.desc("meaningful_ngrams"), F.asc("ord")]
    best = metrics.agg(F.max("f1").alias("best_f1"))
    return metrics.join(best, F.lit(True)).withColumn("tied", F.col("f1").eqNullSafe(F.col("best_f1"))).drop("best_f1").withColumn("place", F.row_number().over(W.orderBy(*order)))


def changed_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id) whose ranked lists differ."""
    as_list = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    return as_list(a, "x").join(as_list(b, "y"), "query_id", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("query_id")


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, exact, f1) of multiset overlap; pairs has (id, predicted array, gold array)."""
    side = lambda name: pairs.select("id", F.explode(name).alias("t")).groupBy("id", "t").agg(F.count("*").alias(name))
    both = side("predicted").join(side("gold"), ["id", "t"]).groupBy("id").agg(F.sum(F.least("predicted", "gold")).alias("both"))
    own = pairs.join(both, "id", "left").select("id", (F.col("predicted") == F.col("gold")).alias("exact"), F.size("predicted").alias("n"), F.size("gold").alias("m"), F.coalesce("both", F.lit(0)).alias("b"))
    p, r = F.col("b") / F.greatest("n", F.lit(1)), F.col("b") / F.greatest("m", F.lit(1))
    return own.select("id", "exact", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def tagging_accuracy(rows: DataFrame) -> DataFrame:
    """(tagger, accuracy, domain_accuracy); rows have (tagger, gold, predicted, is_domain)."""
    right = (F.col("gold") == F.col("predicted")).cast("double")
    return rows.groupBy("tagger").agg(F.avg(right).alias("accuracy"), F.avg(F.when(F.col("is_domain"), right)).alias("domain_accuracy"))


def entity_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over sets of (sent_id, text, label): gold, correct, spurious, missed, precision, recall, f1."""
    keys = ["sent_id", "text", "label"]
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    c = p.join(g, keys, "full").agg(F.count("g").alias("gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("correct"), F.count_if(F.col("g").isNull()).alias("spurious"), F.count_if(F.col("p").isNull()).alias("missed"))
    c = c.withColumn("precision", F.col("correct") / F.greatest(F.col("correct") + F.col("spurious"), F.lit(1))).withColumn("recall", F.col("correct") / F.greatest("gold", F.lit(1)))
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def entity_table(gold: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """Each gold entity with each model's label of that text in the sentence, the last one if several."""
    out = gold
    for name, frame in predictions.items():
        last = frame.groupBy("sent_id", "text").agg(F.max_by("label", "ord").alias(name))
        out = out.join(last, ["sent_id", "text"], "left").withColumn(name, F.coalesce(name, F.lit("(missed)"))).withColumn(f"{name}_correct", F.col(name) == F.col("label"))
    return out


def domain_tokens(rows: DataFrame, names: list[str]) -> DataFrame:
    """(sent_id, pos, word, gold, each tagger's tag, whether it is right) for domain words; rows have (sent_id, pos, word, gold, tagger, predicted, is_domain)."""
    wide = rows.where("is_domain").groupBy("sent_id", "pos", "word", "gold").pivot("tagger", names).agg(F.first("predicted"))
    return wide.select("sent_id", "pos", "word", "gold", *names, *[(F.col(n) == F.col("gold")).alias(f"{n}_correct") for n in names])


def in_order(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """One row for each of the names, in their order (`ord`), with nulls where rows have none."""
    order = rows.sparkSession.createDataFrame(list(enumerate(names)), f"ord int, {by} string")
    return order.join(rows, by, "left")


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded half to even."""
    return rows.withColumns({c: F.bround(c, digits) for c in columns})


def provisional(sources: DataFrame) -> DataFrame:
    """(queries, provisional, report): how many queries have provisional judgements, and whether the numbers may be reported."""
    n = F.count_if(F.col("source") == "PROVISIONAL")
    return sources.agg(F.count("*").alias("queries"), n.alias("provisional"), (n == 0).alias("report"))
