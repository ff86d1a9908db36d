"""Training a ranker: synthetic queries, labelled pairs, split, a pairwise linear model.

Random draws are hashes of the row's id and a seed, so every run and every
partitioning gives the same queries.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words


def draw(id_: Column, name: str, seed: int = 42) -> Column:
    """A number from 0 to 1 for a row, a purpose and a seed."""
    return F.pmod(F.xxhash64(id_.cast("string"), F.lit(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sample(df: DataFrame, n: int, seed: int = 42, id_: str = "doc_id") -> DataFrame:
    """The n rows whose hash is smallest: a sampling operator, so its limit is the feature."""
    return df.orderBy(F.xxhash64(F.col(id_).cast("string"), F.lit(seed)), id_).limit(n)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def typo(text: Column, id_: Column, seed: int) -> Column:
    """A character left out of, or two swapped in, one word of four letters or more."""

    def changed(tokens: Column, i: Column, word: Column) -> Column:
        at = F.floor(draw(id_, "place", seed) * (F.length(word) - 1)).cast("int") + 1
        cut = F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1))
        swap = F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1)), F.substr(word, at + 2))
        new = F.when(draw(id_, "kind", seed) < 0.5, cut).otherwise(swap)
        return F.array_join(F.concat(F.slice(tokens, 1, i), F.array(new), F.slice(tokens, i + 2, F.size(tokens))), " ")

    def chosen(tokens: Column) -> Column:
        long = F.filter(F.transform(tokens, lambda t, i: F.when(F.length(t) >= 4, i)), lambda i: i.isNotNull())
        place = once(long, lambda ks: F.get(ks, F.floor(draw(id_, "word", seed) * F.size(ks)).cast("int")))
        return once(place, lambda i: F.when(i.isNotNull(), once(F.get(tokens, i), lambda word: changed(tokens, i, word))).otherwise(text))

    return once(F.split(text, " "), chosen)


def synthetic_queries(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, text, gold_id) from documents (doc_id, full_address, pincode): the first part, others by chance, sometimes abbreviated, misspelt, with pincode."""
    id_ = F.col("doc_id")
    parts = F.filter(F.transform(F.split("full_address", ","), F.trim), lambda p: p != "")
    keep = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (F.pmod(F.xxhash64(id_.cast("string"), i, F.lit(seed)), F.lit(1000)) < 600), p)), lambda p: p.isNotNull())
    text = F.lower(F.array_join(keep, " "))
    short = {v: k for k, v in words.ABBREVIATIONS.items() if " " not in v and k.isalpha() and k != v}
    # The first long form that the text has is shortened.
    chain = F.lit(None).cast("string")
    for full, abbreviation in reversed(list(short.items())):
        chain = F.when(F.col("_text").contains(full), F.replace("_text", F.lit(full), F.lit(abbreviation))).otherwise(chain)
    out = docs.where("trim(full_address) <> ''").withColumn("_text", text).withColumn("_text", F.when(draw(id_, "abbreviate", seed) < 0.4, F.coalesce(chain, "_text")).otherwise(F.col("_text")))
    with_pin = F.when(F.col("pincode").rlike("^[0-9]{6}$") & (draw(id_, "pincode", seed) < 0.5), F.concat_ws(" ", "_text", "pincode")).otherwise(F.col("_text"))
    out = out.withColumn("_text", with_pin).withColumn("_text", F.when(draw(id_, "typo", seed) < 0.3, typo(F.col("_text"), id_, seed)).otherwise(F.col("_text")))
    return out.select(F.xxhash64(id_.cast("string")).alias("query_id"), F.trim("_text").alias("text"), id_.alias("gold_id")).where("text <> ''")


def label_pairs(queries: DataFrame, hits: DataFrame, most: int = 40) -> DataFrame:
    """(query_id, doc_id, rank, label): at most ``most`` candidates of each query, the gold one among them; queries that did not find theirs are dropped."""
    marked = hits.join(queries.select("query_id", "gold_id"), "query_id").withColumn("label", (F.col("doc_id") == F.col("gold_id")).cast("int"))
    found = marked.where("label = 1").select("query_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("label").desc(), "rank", "doc_id")
    return marked.join(found, "query_id", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("query_id", "doc_id", "rank", "label")


def split(pairs: DataFrame, share: float = 0.2, seed: int = 42, group: str = "query_id") -> DataFrame:
    """``pairs`` with ``validation``: whole groups, by hash."""
    return pairs.withColumn("validation", draw(F.col(group), "split", seed) < share)


def fit(pairs: DataFrame, features: list[str], group: str = "query_id") -> LogisticRegressionModel:
    """A pairwise linear ranker: logistic regression, without intercept, on differences of a positive and a negative row of a group.

    Each negative is paired with its group's first positive, so pairs grow with
    the rows of a group, not with their square.
    """
    first = pairs.where("label > 0").groupBy(group).agg(F.min_by(F.struct(*features), F.struct("rank", "doc_id")).alias("p"))
    rows = pairs.where("label = 0").join(first, group)
    flip = F.pmod(F.xxhash64(F.col(group), F.col("doc_id")), F.lit(2)) == 0
    differences = rows.select(*[F.when(flip, F.col(f"p.{c}") - F.col(c)).otherwise(F.col(c) - F.col(f"p.{c}")).alias(c) for c in features], F.when(flip, 1.0).otherwise(0.0).alias("label"))
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(differences)
    return LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, regParam=0.01, maxIter=50).fit(vectors)


def predict(rows: DataFrame, model: LogisticRegressionModel, features: list[str]) -> DataFrame:
    """``rows`` with ``model_score``: as many weights as features, so a plain sum of columns."""
    weights = model.coefficients.toArray().tolist()
    return rows.withColumn("model_score", sum((F.lit(float(w)) * F.col(c) for c, w in zip(features, weights)), F.lit(0.0)))


def save(model: LogisticRegressionModel, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return PipelineModel.load(path).stages[0]


@dataclass
class Bundle:
    """A linear model with the names that its weights belong to, so that it is never applied to others."""

    features: list[str]
    weights: list[float]

    @staticmethod
    def of(model: LogisticRegressionModel, features: list[str]) -> Bundle:
        return Bundle(list(features), model.coefficients.toArray().tolist())

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"features": self.features, "weights": self.weights}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        row = json.loads(spark.read.text(path).first()[0])
        if len(row["features"]) != len(row["weights"]) or len(set(row["features"])) != len(row["features"]):
            raise ValueError(f"{path} is no ranking model: {len(row['features'])} names, {len(row['weights'])} weights")
        return Bundle(row["features"], row["weights"])

    def missing(self, columns: list[str]) -> list[str]:
        """Features that a table does not have."""
        return [f for f in self.features if f not in set(columns)]

    def score(self, rows: DataFrame, name: str = "model_score") -> DataFrame:
        """``rows`` with the model's score by the names of the columns, whatever their order; null on every row where a feature is missing, so ranking goes without a model."""
        if self.missing(rows.columns):
            return rows.withColumn(name, F.lit(None).cast("double"))
        return rows.withColumn(name, sum((F.lit(float(w)) * F.col(f"`{f}`").cast("double") for f, w in zip(self.features, self.weights)), F.lit(0.0)))
