"""A ranker of boosted trees: pairs of a group's rows, histograms of their gradients.

Rows are paired once, and a pair holds the bins of both its sides, so each
later step is local to a row: a level of a tree is one aggregate, reduced before
it shuffles, whose result is as large as nodes x features x bins and never
grows with the data; only each node's best split comes to the driver.

A pair is a row of label 0 and one of label above 0 of its group, drawn by hash
among ``POSITIVES`` that the group keeps (by hash too), so pairs grow with the
rows, not with their square, and no group is gathered.

Defined cases: values that are null or NaN fall into the lowest bin; groups of
one label make no pairs, rows without label or group are in none; without pairs the model has no trees and scores 0;
equal gains go to the first feature, then the lowest bin; repeated rows count
as often as they are there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .learn import draw
from .store import kept

#: Rows of label above 0 that a group keeps as partners.
POSITIVES = 8


def edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 cuts of each feature, at its quantiles: one pass for all."""
    shares = F.lit([(i + 1) / bins for i in range(bins - 1)])
    value = lambda c: F.when(F.isnan(F.col(f"`{c}`").cast("double")), None).otherwise(F.col(f"`{c}`").cast("double"))
    row = rows.agg(*[F.percentile_approx(value(c), shares, 10000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(features))]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> Column:
    """An array of each feature's bin: how many cuts lie below its value."""
    one = lambda c, cut: F.coalesce(F.size(F.filter(F.lit(cut or [0.0]), lambda e: e < F.when(F.isnan(c), None).otherwise(c))), F.lit(0)) if cut else F.lit(0)
    return F.array(*[F.greatest(one(F.col(f"`{f}`").cast("double"), cut), F.lit(0)).cast("int") for f, cut in zip(features, cuts)])


def pairs(rows: DataFrame, group: str, id_: str, seed: int) -> DataFrame:
    """(lose, win): the bins of a row of label 0 and of a partner above it."""
    key = F.xxhash64(F.col(id_).cast("string"), F.lit(seed))
    best = rows.where("label > 0").select(F.col(group).alias("_g"), key.alias("_k"), "bins")
    # Rows first keep the least hash of each of their group's slots, so what meets is bounded by the slots.
    slots = best.groupBy("_g", F.pmod("_k", F.lit(POSITIVES)).alias("_slot")).agg(F.min_by("bins", "_k").alias("win"))
    held = slots.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_slot", "win"))).alias("wins"))  # POSITIVES at most
    lost = rows.where("label = 0").select(F.col(group).alias("_g"), draw(F.col(id_), "partner", seed).alias("_d"), F.col("bins").alias("lose"))
    return lost.join(held, "_g").select("lose", F.element_at("wins", (F.floor(F.col("_d") * F.size("wins")) + 1).cast("int"))["win"].alias("win"))


def leaf_of(tree: dict[str, Any], get: Any, value: Any) -> Column:
    """What a tree says of a row: ``get(feature, cut)`` is whether it goes left, ``value(node)`` what a leaf gives."""
    if "feature" not in tree:
        return value(tree)
    return F.when(get(tree["feature"], tree["bin"]), leaf_of(tree["left"], get, value)).otherwise(leaf_of(tree["right"], get, value))


def _leaves(tree: dict[str, Any]) -> list[dict[str, Any]]:
    return [tree] if "feature" not in tree else _leaves(tree["left"]) + _leaves(tree["right"])


def _by_bins(side: str) -> Any:
    return lambda f, b: F.col(side)[f] <= b


def histogram(state: DataFrame, tree: dict[str, Any]) -> DataFrame:
    """(node, feature, bin, g, h): sums of both sides' gradients of pairs (lose, win, lose_score, win_score) in the tree's open leaves."""
    p = F.lit(1.0) / (1.0 + F.exp(F.col("win_score") - F.col("lose_score")))
    of = lambda side: leaf_of(tree, _by_bins(side), lambda n: F.lit(n["node"] if n["open"] else None).cast("int"))
    side = lambda c, sign: F.struct(of(c).alias("node"), F.col(c).alias("bins"), (F.col("p") * sign).alias("g"))
    both = state.select("lose", "win", p.alias("p")).select(F.explode(F.array(side("lose", 1.0), side("win", -1.0))).alias("s"), (F.col("p") * (1 - F.col("p"))).alias("h"))
    cells = both.where("s.node is not null").select("s.node", "s.g", "h", F.posexplode("s.bins").alias("feature", "bin"))
    return cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, ridge: float, least: float) -> DataFrame:
    """(node, G, H, feature, bin, gain): of each node the cut ``value's bin <= bin`` of the greatest gain, or nulls where none gains."""
    w = Window.partitionBy("node", "feature").orderBy("bin")
    # Sums are as many as nodes, features and bins allow, whatever the data: one task sees them all, and nothing is dealt out again.
    up = sums.repartition(1).withColumns({"gl": F.sum("g").over(w), "hl": F.sum("h").over(w)}).withColumns({"G": F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "H": F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    part = lambda g, h: g * g / (h + ridge)
    gl, hl, G, H = (F.col(c) for c in ("gl", "hl", "G", "H"))
    # Sums of doubles differ in their last digits from run to run, so gains are compared rounded.
    gain = F.round(part(gl, hl) + part(G - gl, H - hl) - part(G, H), 9)
    ok = (hl >= least) & (H - hl >= least) & (gain > 1e-9)
    split = F.when(ok, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    best = up.withColumn("split", split).groupBy("node").agg(F.min_by("G", "feature").alias("G"), F.min_by("H", "feature").alias("H"), F.max("split").alias("s"))
    return best.select("node", "G", "H", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), F.col("s.gain").alias("gain"))


def grow(state: DataFrame, depth: int, rate: float, ridge: float, least: float) -> dict[str, Any]:
    """One tree: a job for each level, and a last one for the leaves' values."""
    root: dict[str, Any] = {"node": 0, "open": True, "value": 0.0}
    n = 1
    for level in range(depth + 1):
        places = {x["node"]: x for x in _leaves(root) if x["open"]}
        if not places:
            break
        for r in best_splits(histogram(state, root), ridge, least).collect():  # a row of each node, 2 ** depth at most
            x = places[r.node]
            x["value"] = -rate * r.G / (r.H + ridge)
            if r.feature is not None and level < depth:
                x |= {"feature": r.feature, "bin": r.bin, "left": {"node": n, "open": True, "value": 0.0}, "right": {"node": n + 1, "open": True, "value": 0.0}}
                n += 2
        for x in places.values():
            x["open"] = False
    return root


@dataclass
class Forest:
    """Trees with the names of their features, so that they are never applied to others."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[dict[str, Any]] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"features": self.features, "cuts": self.cuts, "trees": self.trees}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        row = json.loads(spark.read.text(path).first()[0])
        if len(row["features"]) != len(row["cuts"]) or len(set(row["features"])) != len(row["features"]):
            raise ValueError(f"{path} is no ranking model: {len(row['features'])} names, {len(row['cuts'])} lists of cuts")
        return Forest(row["features"], row["cuts"], row["trees"])

    def missing(self, columns: list[str]) -> list[str]:
        """Features that a table does not have."""
        return [f for f in self.features if f not in set(columns)]

    def score(self, rows: DataFrame, name: str = "model_score") -> DataFrame:
        """``rows`` with the sum of all trees by the names of the columns; null on every row where a feature is missing, so ranking goes without a model."""
        if self.missing(rows.columns):
            return rows.withColumn(name, F.lit(None).cast("double"))
        held = rows.withColumn("_bins", binned(rows, self.features, self.cuts))
        total = sum((leaf_of(t, _by_bins("_bins"), lambda n: F.lit(float(n["value"]))) for t in self.trees), F.lit(0.0))
        return held.withColumn(name, total).drop("_bins")

    def used(self) -> dict[str, int]:
        """How many splits each feature has."""
        out = dict.fromkeys(self.features, 0)
        todo = list(self.trees)
        while todo:
            t = todo.pop()
            if "feature" in t:
                out[self.features[t["feature"]]] += 1
                todo += [t["left"], t["right"]]
        return out


def fit(rows: DataFrame, features: list[str], group: str = "query_id", id_: str = "doc_id", trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1.0, seed: int = 42, every: int = 5) -> Forest:
    """Trees on pairwise logistic gradients of ``rows`` (group, id, label, features).

    The pairs' scores are written down after ``every`` trees, so that plans stay
    short and a lost executor costs no more than those.
    """
    cuts = edges(rows, features, bins)
    held = rows.select(F.col(group), F.col(id_), "label", binned(rows, features, cuts).alias("bins"))
    state = kept(pairs(held, group, id_, seed).withColumns({"lose_score": F.lit(0.0), "win_score": F.lit(0.0)}), "pairs")
    model = Forest(list(features), cuts)
    for i in range(trees):
        tree = grow(state, depth, rate, ridge, least)
        if "feature" not in tree:
            break
        model.trees.append(tree)
        at = lambda side: F.col(f"{side}_score") + leaf_of(tree, _by_bins(side), lambda n: F.lit(float(n["value"])))  # noqa: B023, E731
        state = state.withColumns({"lose_score": at("lose"), "win_score": at("win")})
        if (i + 1) % every == 0 and i + 1 < trees:
            state = kept(state, "pairs")
    return model
