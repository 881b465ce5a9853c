"""Learned part-of-speech tagging: features as columns, a multinomial logistic regression from Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels.annotate import MONEY_TOKEN, tag, tag_domain, tag_shapes
from ..kernels.words import DOMAIN_TAGS, NOUN_OR_VERB

FEATURES = ["w", "suf3", "suf2", "pre2", "is_title", "is_upper", "has_digit", "has_hyphen", "has_currency", "in_domain_lexicon", "prev", "prev2", "next"]
#: Taggers by name, words in, tags out; more can be added.
TAGGERS = {"general": tag, "shapes": tag_shapes, "domain": tag_domain}


def without_traces(tagged: DataFrame) -> DataFrame:
    """Rows tagged -NONE- dropped and positions counted anew."""
    order = W.partitionBy("sent_id").orderBy("pos")
    return tagged.where("tag <> '-NONE-'").withColumn("pos", F.row_number().over(order) - 1)


def features(words: DataFrame) -> DataFrame:
    """The features of each word of (sent_id, pos, word): neighbours by lag and lead."""
    order = W.partitionBy("sent_id").orderBy("pos")
    near = lambda c: F.lower(c)
    w = F.col("word")
    return words.withColumns({
        "w": F.lower(w), "suf3": F.lower(F.right(w, F.lit(3))), "suf2": F.lower(F.right(w, F.lit(2))), "pre2": F.lower(F.substring(w, 1, 2)),
        "is_title": w.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"), "is_upper": w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"), "has_digit": w.rlike(r"\p{Nd}"),
        "has_hyphen": w.contains("-"), "has_currency": w.rlike(MONEY_TOKEN.pattern), "in_domain_lexicon": F.lower(w).isin(sorted(DOMAIN_TAGS)),
        "prev": F.coalesce(near(F.lag("word").over(order)), F.lit("<S>")), "prev2": F.coalesce(near(F.lag("word", 2).over(order)), F.lit("<S>")),
        "next": F.coalesce(near(F.lead("word").over(order)), F.lit("</S>")),
    })


def train_tagger(tagged: DataFrame, weight: str | None = None, hashed: int = 1 << 14, iterations: int = 300) -> PipelineModel:
    """A tagger from (sent_id, pos, word, tag[, weight]); the penalty is one over the summed weights."""
    rows = features(without_traces(tagged))
    total = rows.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    hasher = FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=hashed)
    index = StringIndexer(inputCol="tag", outputCol="label", handleInvalid="keep").fit(rows)
    learner = LogisticRegression(family="multinomial", maxIter=iterations, standardization=False, regParam=1.0 / max(1.0, float(total or 1)), **({"weightCol": weight} if weight else {}))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*index.labels, "NN"])
    return PipelineModel([hasher, index, learner.fit(Pipeline(stages=[hasher, index]).fit(rows).transform(rows)), names])


def apply_tagger(model: PipelineModel, words: DataFrame) -> DataFrame:
    """(sent_id, pos, word, predicted)."""
    rows = features(words)
    return model.transform(rows if "tag" in rows.columns else rows.withColumn("tag", F.lit(None).cast("string"))).select("sent_id", "pos", "word", "predicted")


def is_domain(word: Column) -> Column:
    """Whether a word counts for the domain accuracy."""
    return F.lower(word).isin(sorted({*DOMAIN_TAGS, *NOUN_OR_VERB, "shall"})) | word.rlike(MONEY_TOKEN.pattern)
