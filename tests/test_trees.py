"""Boosted trees: their first split against brute force, and what they learn that weights cannot."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.operators import learn, metrics, trees

NAMES = ["a", "b.c", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    """The best row of a group is the one whose ``a`` is in the middle: no weight of ``a`` finds it."""
    r = random.Random(3)
    out = []
    for g in range(150):
        best = r.randrange(6)
        for i in range(6):
            a = r.uniform(0.4, 0.6) if i == best else r.choice([r.uniform(0, 0.45), r.uniform(0.55, 1)])
            out.append((g, f"d{g}-{i}", i, int(i == best), a, r.random() + 0.1 * (i == best), r.choice([None, float("nan"), r.random()])))
    return learn.split(spark.createDataFrame(out, "query_id int, doc_id string, rank int, label int, a double, `b.c` double, noise double"))


def test_first_split_equals_brute_force(rows):
    cuts = trees.edges(rows, NAMES, 8)
    held = rows.select("query_id", "doc_id", "label", trees.binned(rows, NAMES, cuts).alias("bins"))
    state = trees.pairs(held, "query_id", "doc_id", 42).withColumns({"lose_score": F.lit(0.25), "win_score": F.lit(0.0)})
    got = trees.best_splits(trees.histogram(state, {"node": 0, "open": True}), 1.0, 1.0).first()
    p = 1 / (1 + math.exp(-0.25))
    seen = [(list(x), g) for r in state.collect() for x, g in ((r.lose, p), (r.win, -p))]
    assert len(seen) == 2 * 150 * 5
    h = p * (1 - p)
    part = lambda xs: sum(g for _, g in xs) ** 2 / (len(xs) * h + 1.0)
    best = max((round(part([s for s in seen if s[0][f] <= b]) + part([s for s in seen if s[0][f] > b]) - part(seen), 9), -f, -b) for f in range(3) for b in range(8) if h * min(sum(s[0][f] <= b for s in seen), sum(s[0][f] > b for s in seen)) >= 1)
    assert (-got.feature, -got.bin) == best[1:] and got.gain == pytest.approx(best[0], abs=1e-6)


def test_bins_are_counts_of_lower_cuts(spark):
    df = spark.createDataFrame([(0.5, 2.0), (1.0, None), (1.5, float("nan")), (None, 1.0)], "x double, y double")
    assert [list(r[0]) for r in df.select(trees.binned(df, ["x", "y"], [[0.5, 1.0], []])).collect()] == [[0, 0], [1, 0], [2, 0], [0, 0]]


def test_trees_rank_better_than_weights(spark, rows, tmp_path):
    train, held = rows.where("not validation"), rows.where("validation")
    trees.fit(train, NAMES, trees=12, rate=0.4, bins=16).save(spark, str(tmp_path / "forest"))
    model = trees.Forest.load(spark, str(tmp_path / "forest"))
    line = learn.Bundle.of(learn.fit(train.withColumnRenamed("b.c", "b").fillna(0.0).replace(float("nan"), 0.0), ["a", "b", "noise"]), ["a", "b", "noise"])
    plain = held.withColumnRenamed("b.c", "b").fillna(0.0).replace(float("nan"), 0.0)
    ndcg = lambda df: metrics.overall(df.select(F.col("query_id").alias("group"), "label", F.col("model_score").alias("score"), F.col("rank").alias("tie")), "tie").first().ndcg_10
    boosted, weighted = ndcg(model.score(held)), ndcg(line.score(plain))
    assert boosted > weighted + 0.1 and boosted > 0.85
    assert model.used()["a"] > model.used()["noise"]
    # By name, whatever the order; without a feature there is no score.
    scores = lambda df: {r.doc_id: r.model_score for r in model.score(df).collect()}
    assert scores(held) == scores(held.select("noise", "doc_id", F.col("`b.c`"), "a"))
    assert set(scores(held.drop("noise")).values()) == {None}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "x", 0, 1.0), (1, "y", 0, 2.0)], "query_id int, doc_id string, label int, a double")
    model = trees.fit(df, ["a"])
    assert model.trees == [] and {r.model_score for r in model.score(df).collect()} == {0.0}
    empty = trees.fit(df.limit(0), ["a"])
    assert empty.trees == [] and empty.score(df).count() == 2
