"""A ranker that is trained, saved and loaded, and what keeps it from the wrong features."""

import random

import pytest
from pyspark.sql import functions as F

from placewright.operators import learn, metrics, rank

NAMES = ["near", "noise", "size"]


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(8)
    rows = []
    for g in range(120):
        best = r.randrange(8)
        for i in range(8):
            rows.append((g, f"d{i}", i + 1, int(i == best), r.random() + 0.8 * (i == best), r.random(), r.random() - 0.3 * (i == best)))
    return learn.split(spark.createDataFrame(rows, "query_id int, doc_id string, rank int, label int, near double, noise double, size double"))


def test_a_trained_ranker_beats_the_order_that_was(spark, pairs, tmp_path):
    learn.Bundle.of(learn.fit(pairs.where("not validation"), NAMES), NAMES).save(spark, str(tmp_path / "model"))
    model = learn.Bundle.load(spark, str(tmp_path / "model"))
    held = pairs.where("validation")
    ndcg = lambda df: metrics.evaluate(df.select(F.col("query_id").alias("group"), "label", F.col("s").alias("score"), F.col("rank").alias("tie")), "tie").first().ndcg_10
    trained, before = ndcg(model.score(held).withColumn("s", F.col("model_score"))), ndcg(held.withColumn("s", -F.col("rank").cast("double")))
    assert trained > before + 0.2 and trained > 0.75
    # By name: columns in another order score the same, and a table without a feature is not scored at all.
    scores = lambda df: {(r.query_id, r.doc_id): r.model_score for r in model.score(df).collect()}
    assert scores(held) == scores(held.select("size", "label", "noise", "doc_id", "query_id", "near"))
    assert set(scores(held.drop("noise")).values()) == {None} and model.missing(["near", "size"]) == ["noise"]


def test_a_broken_model_is_refused(spark, tmp_path):
    learn.Bundle(["a", "b"], [1.0]).save(spark, str(tmp_path / "short"))
    with pytest.raises(ValueError):
        learn.Bundle.load(spark, str(tmp_path / "short"))


def test_a_model_counts_only_without_entities(spark):
    names = ("locality", "city", "building_name", "office_name", "road_name", "pincode", "district", "state", "landmark", "village", "block", "taluka", "flat_number")
    entity = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    row = lambda q, city, d, m: (q, tuple(city if n == "city" else None for n in names), d, "Pune", 1.0, 50.0, int(d[1]), m)
    rows = [row(1, None, "d1", -4.0), row(1, None, "d2", 4.0), row(2, "Pune", "d1", -4.0), row(2, "Pune", "d2", 4.0)]
    df = spark.createDataFrame(rows, f"query_id int, entities {entity}, doc_id string, city_name string, bm25_score double, quality_score double, retrieval_position int, model_score double")
    for c in ("building_name", "office_name", "road_name", "locality", "district_name", "state_name", "pincode", "full_address", "text"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    first = lambda d: {r.query_id: r.doc_id for r in d.where("place = 1").collect()}
    assert first(rank.rank(df, "model_score")) == {1: "d2", 2: "d1"}
    assert first(rank.rank(df.withColumn("model_score", F.lit(None).cast("double")), "model_score")) == first(rank.rank(df)) == {1: "d1", 2: "d1"}


def test_typos_are_worked_out_once(spark):
    """One character is lost or two are swapped in one word of four letters or more; the text is named a bounded number of times, however many words there are."""
    rows = [(i, t) for i, t in enumerate(["main road pune", "a bc def", "", None, "hill station road sector seven"] * 40)]
    df = spark.createDataFrame(rows, "id int, text string").select("id", "text", learn.typo(F.col("text"), F.col("id"), 7).alias("new"))
    for r in df.collect():
        if r.text in ("a bc def", "", None):
            assert r.new == r.text
            continue
        (old, new), = [(a, b) for a, b in zip(r.text.split(" "), r.new.split(" ")) if a != b] or [("same", "same")]
        assert len(old) >= 4 and (len(new) == len(old) - 1 or sorted(new) == sorted(old)) and len(r.text.split(" ")) == len(r.new.split(" "))
    assert len(learn.typo(F.col("text"), F.col("id"), 7)._jc.toString().split("split(")) == 2
