"""Requests as rows: what is wrong with them, the older service that some are for, and a log of what was answered.

A request has query_id and text, and any of strategy, size, state, district,
city, locality, building, pincode, office, lat, lon, distance; a column that is
not there was not given.

Defined cases: null means not given; the older service answers requests with
errors too (sizes are cut to 100, unknown strategies are ``auto``), so who wants
them refused keeps those without; empty filters are no filters; a table without
requests gives none. Query ids must be distinct; repeats of a row are answered
as one is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import search
from .operators.index import Index
from .operators.store import kept
from .plans import strategy

#: Strategies of the older service, the mode that each is run in, fields of its filters and of its hits.
OLDER = {"exact": "exact", "fuzzy": "fuzzy", "phrase": "phrase", "autocomplete": "autocomplete", "hierarchical_admin": "admin", "hierarchical_pincode": "pincode", "geospatial": "geospatial"}
FIELDS = {"state": "state_name", "district": "district_name", "city": "city_name", "locality": "locality", "pincode": "pincode", "building": "building_name", "office": "office_name"}
HIT = ("address_hash", "full_address", "building_name", "road_name", "locality", "city_name", "district_name", "subdistrict_name", "state_name", "pincode", "office_name", "latitude", "longitude", "location", "quality_score", "source_file")
GIVEN = {"strategy": "string", "size": "int", **dict.fromkeys(("state", "district", "city", "locality", "building", "pincode", "office"), "string"), "lat": "double", "lon": "double", "distance": "string"}


def given(requests: DataFrame) -> DataFrame:
    """Requests with all columns that one may have."""
    return requests.select("query_id", "text", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in GIVEN.items()])


def checked(requests: DataFrame) -> DataFrame:
    """Requests with strategy, size and distance filled in where they were not given, and ``errors``: names of the arguments that are not allowed."""
    r = given(requests)
    wrong = {
        "strategy": ~F.coalesce("strategy", F.lit("auto")).isin(*strategy.STRATEGIES),
        "size": ~F.coalesce("size", F.lit(20)).between(1, 100),
    }
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in wrong.items()]), lambda e: e.isNotNull())
    return r.withColumn("errors", errors).withColumns({"strategy": F.coalesce("strategy", F.lit("auto")), "size": F.coalesce("size", F.lit(20)), "distance": F.coalesce("distance", F.lit("5km"))})


def older_strategy(asked: Column, pincode: Column, lat: Column, lon: Column, state: Column) -> Column:
    """The older service's choice: a point, then a pincode, then a state, else ``auto``; unknown names are ``auto``."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    own = F.when(lat.isNotNull() & lon.isNotNull(), "geospatial").when(some(pincode), "hierarchical_pincode").when(some(state), "hierarchical_admin").otherwise("auto")
    return F.when(F.coalesce(asked, F.lit("auto")) == "auto", own).otherwise(F.when(asked.isin(*OLDER), asked).otherwise("auto"))


def older_plan(requests: DataFrame) -> DataFrame:
    """Requests as the older service runs them: filters are those given, office never is, and no entities are looked for."""
    r = given(requests)
    f = F.struct(*[F.when(F.col(k) != "", F.col(k)).alias(k) if k != "office" else F.lit(None).cast("string").alias(k) for k in ("state", "district", "city", "locality", "building", "pincode", "office")], F.lit(None).cast("string").alias("address_hash"))
    r = r.withColumns({"filters": f, "normalized_query": F.coalesce("text", F.lit("")), "strategy": older_strategy(F.col("strategy"), F.col("pincode"), F.col("lat"), F.col("lon"), F.col("state"))})
    mode = F.when(F.col("strategy") == "auto", strategy.legacy_mode(F.col("normalized_query"), F.col("filters"), F.col("lat"), F.col("lon"))).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in OLDER.items() for x in kv]), F.col("strategy")))
    none = ("building_name", "office_name", "landmark", "district", "state", "pincode", "road_name", "flat_number", "locality", "city")
    entities = F.struct(*[F.lit(None).cast("string").alias(k) for k in none])
    plans = strategy.as_legacy(r.withColumn("entities", entities), mode)
    size = F.least(F.when(F.col("size") > 0, F.col("size")).otherwise(20), F.lit(100))
    return plans.select("query_id", "text", "normalized_query", "entities", "filters", "strategy", "run_as", size.alias("size"), "lat", "lon", F.coalesce(search.radius_km(F.col("distance")), F.lit(5.0)).alias("radius_km"))


def passing(hits: DataFrame, plans: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits whose documents have every value that the request's filters name, letter by letter."""
    own = plans.select("query_id", *[F.col(f"filters.{k}").alias(f"_want_{k}") for k in FIELDS])
    about = docs.select("doc_id", *[(F.col(f) if f in docs.columns else F.lit(None).cast("string")).alias(f"_has_{k}") for k, f in FIELDS.items()])
    fits = reduce(lambda a, k: a & (F.col(f"_want_{k}").isNull() | F.coalesce(F.col(f"_want_{k}") == F.col(f"_has_{k}"), F.lit(False))), FIELDS, F.lit(True))
    return hits.join(own, "query_id").join(about, "doc_id").where(fits).drop(*[f"_want_{k}" for k in FIELDS], *[f"_has_{k}" for k in FIELDS])


def older_near(plans: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score, place) of requests run as ``geospatial`` with a point: documents within its radius that hold a word of the text, if there is one, and pass the filters; nearest first."""
    located = index.docs.where("location is not null").select("doc_id", "location.lat", "location.lon")
    near = passing(search.within(plans.select("query_id", "lat", "lon", "radius_km"), located), plans, index.docs)
    text = plans.where("normalized_query <> ''").select("query_id", F.lit(0).alias("clause_id"), F.lit(1).alias("grp"), F.lit(True).alias("must"), F.lit("match").alias("kind"), F.lit("full_address").alias("field"), F.col("normalized_query").alias("text"), F.lit(1.0).alias("boost"), F.lit(0.0).alias("tie"))
    matched = search.clause_scores(text, index).groupBy("query_id", "doc_id").agg(F.max("score").alias("_s"))
    free = plans.where("normalized_query = ''").select("query_id", F.lit(True).alias("_free"))
    quality = index.docs.select("doc_id", search.quality_of(index).alias("_q"))
    found = near.join(matched, ["query_id", "doc_id"], "left").join(free, "query_id", "left").where(F.col("_s").isNotNull() | F.col("_free")).join(quality, "doc_id")
    found = found.withColumn("score", F.round(F.coalesce("_s", F.lit(1.0)) + 0.05 * F.col("_q"), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance_km", F.col("score").desc(), "doc_id"))
    return found.select("query_id", "doc_id", "score", place.alias("place"))


def older_search(requests: DataFrame, index: Index) -> DataFrame:
    """The older service: one retrieval, no second ranking, hits with the columns of ``HIT`` that documents have, ``size`` of each request at most.

    Filters raise scores, except by place, where every one has to hold. A
    request by place without a point is answered as ``auto`` answers its text.
    """
    plans = older_plan(requests)
    pointless = (F.col("run_as") == "geospatial") & (F.col("lat").isNull() | F.col("lon").isNull())
    again = strategy.as_legacy(plans.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})).select("query_id", F.col("run_as").alias("_again")).dropDuplicates(["query_id"])
    plans = kept(plans.join(again, "query_id").withColumn("run_as", F.when(pointless, F.col("_again")).otherwise(F.col("run_as"))).drop("_again"), "older")
    near = older_near(plans.where("run_as = 'geospatial'").dropDuplicates(["query_id"]), index)
    rest = plans.where("run_as <> 'geospatial'").dropDuplicates(["query_id"])
    # No filter is a hard one here, so retrieval is not told of them.
    hits = search.retrieve(rest.select("query_id"), kept(strategy.clauses(rest), "clauses"), index, 100).select("query_id", "doc_id", "score", F.col("rank").alias("place"))
    both = near.unionByName(hits).join(plans.select("query_id", "text", "strategy", "size"), "query_id").where(F.col("place") <= F.col("size"))
    return both.drop("size").join(index.docs.select("doc_id", *[c for c in HIT if c in index.docs.columns]), "doc_id")


def log(requests: DataFrame, results: DataFrame, filters: Sequence[str] = ("state", "district", "city", "locality", "building", "pincode")) -> DataFrame:
    """(query_id, event, at): a JSON text for each request, with what was asked, its errors, and how many results there are.

    Results are counted by request before they meet it, so nothing large moves; ``at`` is the query's time.
    """
    r = checked(requests)
    n = results.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    request = F.struct("text", "size", F.struct(*filters).alias("filters"), F.struct("lat", "lon", "distance").alias("geo"))
    event = F.to_json(F.struct("strategy", request.alias("request"), "errors", F.struct(F.coalesce("candidate_count", F.lit(0)).alias("candidate_count")).alias("response")))
    return r.join(n, "query_id", "left").select("query_id", event.alias("event"), F.current_timestamp().alias("at"))


__all__ = ["checked", "given", "log", "older_plan", "older_search", "older_strategy", "passing"]
