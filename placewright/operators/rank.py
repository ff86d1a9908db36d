"""Ranking of retrieved candidates: features, entity fit, score, confidence, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .query import locality_variants

#: Fixed values: (entity of the query, field of the candidate).
PAIRS = (("full_address", "full_address"), ("building_name", "building_name"), ("road_name", "road_name"), ("locality", "locality"), ("city", "city_name"), ("district", "district_name"), ("state", "state_name"))
EXACT = PAIRS[1:] + (("pincode", "pincode"),)
BASE = ("query_length", "candidate_length", "candidate_bm25_score", "candidate_quality_score", "candidate_rank", "retrieval_position", "has_latitude", "has_longitude", "geo_distance_km", "geo_distance_available", "field_presence_count")
MEASURES = {
    "ratio": S.ratio, "partial_ratio": S.partial_ratio, "token_sort_ratio": S.token_sort_ratio, "token_set_ratio": S.token_set_ratio,
    "common_token_count": S.common_tokens, "token_overlap_percent": S.token_overlap, "jaccard_similarity": S.jaccard, "exact_match": S.exact_match,
}
TEXT_FIELDS = ("building_name", "office_name", "road_name", "locality", "city_name", "district_name", "state_name", "pincode", "full_address")


def feature_names() -> list[str]:
    """The 77 features, in order."""
    return [*BASE, *[f"{q}__{c}__{m}" for q, c in PAIRS for m in MEASURES], *[f"exact_{q}" for q, _ in EXACT], "query_candidate_token_common", "query_candidate_token_overlap", "query_candidate_jaccard"]


def presence(df_columns: list[str]) -> Column:
    """How many text fields of a candidate have a value."""
    return sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in TEXT_FIELDS if c in df_columns), F.lit(0))


def features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text, entities, a candidate's fields, bm25_score, rank, retrieval_position, location, optionally lat and lon) with the 77 features.

    A missing entity is stood in for by the whole query.
    """
    e, query = F.col("entities"), F.coalesce("text", F.lit(""))
    asked = {q: (query if q == "full_address" else F.coalesce(F.when(e[q] != "", e[q]), query)) for q, _ in PAIRS}
    has_geo = F.col("location").isNotNull() if "location" in pairs.columns else F.lit(False)
    distance = S.haversine(F.col("lat"), F.col("lon"), F.col("location.lat"), F.col("location.lon")) if {"lat", "lon", "location"} <= set(pairs.columns) else F.lit(None).cast("double")
    candidate = F.concat_ws(" ", *[F.col(c) for c in TEXT_FIELDS if c in pairs.columns])
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    base = [F.length(query), F.length(candidate), F.col("bm25_score"), F.col("quality_score"), F.col("rank"), F.col("retrieval_position"), has_geo, has_geo, F.coalesce(distance, F.lit(0.0)), distance.isNotNull(), presence(pairs.columns)]
    cell = lambda c: F.col(c) if c in pairs.columns else F.lit(None).cast("string")
    new = dict(zip(BASE, map(number, base)))
    new |= {f"{q}__{c}__{m}": number(f(asked[q], cell(c))) for q, c in PAIRS for m, f in MEASURES.items()}
    new |= {f"exact_{q}": number(S.exact_match(e[q], cell(c))) for q, c in EXACT}
    new |= {"query_candidate_token_common": number(S.common_tokens(query, candidate)), "query_candidate_token_overlap": S.token_overlap(query, candidate), "query_candidate_jaccard": S.jaccard(query, candidate)}
    return pairs.withColumns(new)


def best(values: Column, measure) -> Column:
    """The largest measure over the variants, 0 for none."""
    return F.coalesce(F.array_max(F.transform(values, measure)), F.lit(0.0))


def locality_similarity(asked: Column, found: Column) -> Column:
    """Ratio and common beginning of the best spelling."""
    variants = locality_variants(asked)
    prefix = F.greatest(S.prefix_affinity(asked, found), best(variants, lambda v: S.prefix_affinity(v, found)))
    value = 0.55 * S.best_ratio(variants, found) + 0.45 * prefix
    return F.when((F.coalesce(asked, F.lit("")) == "") | (F.coalesce(found, F.lit("")) == ""), 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def with_entity_fit(pairs: DataFrame, name: str = "entity_fit") -> DataFrame:
    """``pairs`` (entities, a candidate's fields) with how well the candidate has the query's entities, 0 to 1.

    The similarities are columns of their own first, so each is worked out once.
    """
    e, columns = F.col("entities"), pairs.columns
    col = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    has = lambda k: F.coalesce(e[k] != "", F.lit(False))
    only = lambda k, value: F.when(has(k), value).otherwise(0.0)
    cities = locality_variants(e["city"])
    parts = {
        "_address": only("locality", S.best_ratio(locality_variants(e["locality"]), col("full_address"))),
        "_locality": only("locality", locality_similarity(e["locality"], col("locality"))),
        **{f"_office_{c}": only("office_name", S.ratio(e["office_name"], col(c))) for c in ("office_name", "building_name", "full_address")},
        "_city": only("city", S.best_ratio(cities, col("city_name"))),
        "_district": only("city", S.best_ratio(cities, col("district_name"))),
        **{f"_building_{c}": only("building_name", S.ratio(e["building_name"], col(c))) for c in ("building_name", "full_address")},
        **{f"_road_{c}": only("road_name", S.ratio(e["road_name"], col(c))) for c in ("road_name", "full_address")},
    }
    most = lambda prefix: F.greatest(*[F.col(c) for c in parts if c.startswith(prefix)])
    out = pairs.withColumns(parts).withColumns({"_similar": F.greatest("_locality", F.when(F.col("_address") >= 0.5, 0.85 * F.col("_address")).otherwise(0.0)), "_office": most("_office_"), "_near": F.greatest("_city", "_district")})
    similar, office = F.col("_similar"), F.col("_office")
    hit = F.exists(cities, lambda v: S.exact_match(v, col("city_name")) | S.exact_match(v, col("district_name")))
    fit = only("locality", 0.60 * similar + F.when(similar >= 0.88, 0.15).otherwise(0.0))
    fit += only("office_name", 0.55 * office + F.when(office >= 0.85, 0.15).otherwise(0.0))
    fit += only("city", F.when(~has("locality") | (similar >= 0.72), 0.35).otherwise(0.08) * F.when(hit, 1.0).otherwise(F.col("_near")))
    fit += only("building_name", 0.25 * most("_building_"))
    fit += F.when(has("pincode") & S.exact_match(e["pincode"], col("pincode")), 0.25).otherwise(0.0)
    fit += only("road_name", 0.15 * most("_road_"))
    return out.withColumn(name, F.least(F.greatest(fit, F.lit(0.0)), F.lit(1.0))).select(*[F.col(f"`{c}`") for c in columns if c != name], name)


def exact_count(e: Column, columns: list[str]) -> Column:
    """How many entities are equal to the candidate's fields."""
    return sum((F.when(S.exact_match(e[q], F.col(c)), 1).otherwise(0) for q, c in EXACT if c in columns), F.lit(0))


def combined(bm25: Column, exact: Column, fit: Column, quality: Column, model: Column | None = None) -> Column:
    """The weighted parts, without rounding and bounds."""
    text = F.when(F.coalesce(bm25, F.lit(0.0)) <= 0, 0.0).otherwise(bm25 / (bm25 + 5.0))
    bonus = F.least(F.lit(1.0), exact / 2.0)
    good = F.least(F.greatest(F.coalesce(quality, F.lit(0.0)) / 100.0, F.lit(0.0)), F.lit(1.0))
    plain = 0.10 * text + 0.20 * bonus + 0.55 * fit + 0.15 * good
    if model is None:
        return plain
    return F.when(model.isNull(), plain).otherwise(0.30 / (1 + F.exp(-model)) + 0.05 * text + 0.20 * bonus + 0.35 * fit + 0.10 * good)


def score(parts: Column) -> Column:
    return F.bround(F.least(F.greatest(parts, F.lit(0.0)), F.lit(1.0)), 6)


def confidence(parts: Column) -> Column:
    return F.bround(F.least(F.greatest(parts, F.lit(0.0)), F.lit(0.99)), 4)


def label(c: Column) -> Column:
    return F.when(c > 0.95, "exact_match").when(c >= 0.80, "high").when(c >= 0.60, "medium").otherwise("low")


def has_entities(e: Column) -> Column:
    return F.coalesce(*[F.when(e[k] != "", e[k]) for k in ("locality", "city", "building_name", "office_name", "road_name", "pincode", "district", "state")]).isNotNull()


def rank(pairs: DataFrame, model: str | None = None) -> DataFrame:
    """``pairs`` with entity_fit, score and confidence, numbered from the best (``place``). A model's score counts only for queries without entities."""
    e, own = F.col("entities"), pairs.columns
    out = with_entity_fit(pairs).withColumn("exact_count", exact_count(e, own))
    by_model = F.when(~has_entities(e), F.col(model)) if model else None
    out = out.withColumn("_parts", combined(F.col("bm25_score"), F.col("exact_count"), F.col("entity_fit"), F.col("quality_score") if "quality_score" in own else F.lit(None).cast("double"), by_model))
    out = out.withColumns({"score": score(F.col("_parts")), "confidence": confidence(F.col("_parts"))}).drop("_parts")
    w = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), F.col("score").desc(), F.col("bm25_score").desc(), "retrieval_position")
    return out.withColumn("place", F.row_number().over(w))


def explanation(e: Column, columns: list[str], c: Column) -> Column:
    """Which fields are equal, and how sure the match is."""
    pairs = [(q, f) for q, f in (("building_name", "building_name"), ("office_name", "office_name"), ("road_name", "road_name"), ("locality", "locality"), ("city", "city_name"), ("district", "district_name"), ("state", "state_name"), ("pincode", "pincode")) if f in columns]
    equal = F.concat_ws(", ", *[F.when(F.lower(F.trim(e[q])) == F.lower(F.trim(F.col(f))), q) for q, f in pairs])
    level = F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")
    return F.concat(F.lit("matched: "), F.when(equal == "", "none").otherwise(equal), F.lit("; confidence: "), level)
