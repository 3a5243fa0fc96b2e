"""A token tagger trained in Spark: words and their neighbours hashed, and a multinomial regression over them.

It stands where a neural net would: fit() gives a model that save() writes, and predict()
tags tokens in the same columns as any scorer behind inference.score().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def own_features(word: Column) -> dict[str, Column]:
    """Named features of a word: itself, its shape and ends."""
    low = F.lower(word)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}+", "A"), r"[\p{Ll}]+", "a"), r"\p{N}+", "0")
    return {"w": low, "s": shape, "p3": F.substring(low, 1, 3), "e3": F.right(low, F.lit(3))}


#: The feature that a word gives to the token so many places on.
GIVEN = {1: "b1", 2: "b2", -1: "a1", -2: "a2"}


def _named(values: dict[str, Column]) -> list[Column]:
    return [F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("#"))) for k, v in values.items()]


def word_features(word: Column) -> tuple[list[Column], dict[int, list[Column]]]:
    """with_features() by word: those of its own, and those that it gives to tokens around it."""
    return _named(own_features(word)), {n: _named({k: F.lower(word)}) for n, k in GIVEN.items()}


def with_features(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """Tokens with an array of named features: the word, its shape and ends, and the words around it."""
    w = Window.partitionBy(key).orderBy(pos)
    low = F.lower(F.col(word))
    named = own_features(F.col(word)) | {k: F.lag(low, n).over(w) for n, k in GIVEN.items()}
    return tokens.withColumn("features_named", F.array(*_named(named)))


def fit(tokens: DataFrame, label: str = "iob2", key: str = "doc_id", pos: str = "pos", word: str = "word", buckets: int = BUCKETS, rounds: int = 30, penalty: float = 1e-4) -> PipelineModel:
    """A model of the label of each token."""
    index = StringIndexer(inputCol=label, outputCol="_class", handleInvalid="skip", stringOrderType="alphabetAsc").fit(tokens)
    stages = [index, HashingTF(inputCol="features_named", outputCol="_x", numFeatures=buckets, binary=True), LogisticRegression(featuresCol="_x", labelCol="_class", predictionCol="_guess", probabilityCol="_p", maxIter=rounds, regParam=penalty, family="multinomial"), IndexToString(inputCol="_guess", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(with_features(tokens, key, pos, word))


def predict(model: PipelineModel, tokens: DataFrame, key: str = "doc_id", pos: str = "pos", word: str = "word", columns: Sequence[str] | None = None) -> DataFrame:
    """Tokens with the label predicted and its probability."""
    kept = list(columns or tokens.columns)
    scorer = PipelineModel([s for s in model.stages if s.uid.split("_")[0] != "StringIndexerModel" and "StringIndexer" not in s.uid])
    scored = scorer.transform(with_features(tokens, key, pos, word))
    from pyspark.ml.functions import vector_to_array

    return scored.select(*kept, "predicted", F.array_max(vector_to_array("_p")).alias("score"))
