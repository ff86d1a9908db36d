"""From an analysed query to clauses: strategy, filters, and the table of what each strategy asks for.

What a strategy asks is a fixed table of rows (strategy, group, must, kind,
source of the text, field, weight, tie). Queries join it, so planning a batch
is one broadcast join with a table of known size.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.query import locality_variants
from ..operators.search import radius_km

STRATEGIES = ("exact", "fuzzy", "phrase", "autocomplete", "city", "locality", "district", "state", "building", "office", "road", "full_address", "pincode", "hierarchical_admin", "hierarchical_pincode", "geospatial", "auto")
# fmt: off
# Fields and weights of the clauses.
GENERAL = {"building_name": 5, "office_name": 4, "road_name": 3, "locality": 2, "city_name": 1.5, "district_name": 1.25, "state_name": 1, "full_address": 2}
AUTOCOMPLETE = {"building_name": 4, "road_name": 3, "locality": 2, "city_name": 1.5, "district_name": 1.25, "full_address": 2}
ROAD = {"road_name": 5, "building_name": 3, "locality": 2, "city_name": 1.5, "district_name": 1.25, "state_name": 1, "full_address": 2}
CITY = {"city_name": 5, "locality": 3, "district_name": 2, "state_name": 1.5, "full_address": 1.5}
LOCALITY = {"locality": 5, "road_name": 4, "building_name": 3, "city_name": 2, "district_name": 1.5, "state_name": 1, "full_address": 2}
DISTRICT = {"district_name": 5, "city_name": 3, "locality": 2, "state_name": 2, "full_address": 1.5}
STATE = {"state_name": 5, "district_name": 3, "city_name": 2, "locality": 1.5, "full_address": 1.5}
ADMIN = {"building_name": 4, "office_name": 3, "road_name": 2, "locality": 1.5, "city_name": 1.25, "district_name": 1, "state_name": 1, "full_address": 2}
LOCATION = {"building": ("building_name", 4), "road": ("road_name", 3), "locality": ("locality", 3), "city": ("city_name", 2.5), "district": ("district_name", 2), "state": ("state_name", 1.5)}
LEGACY = {
    "pincode": {"pincode": 18, "searchable_text": 8, "full_address": 6, "city_name": 3, "district_name": 2, "state_name": 2},
    "city": {"city_name": 14, "district_name": 8, "state_name": 4, "locality": 5, "searchable_text": 4, "full_address": 3},
    "locality": {"locality": 14, "building_name": 7, "office_name": 6, "city_name": 5, "district_name": 3, "searchable_text": 4, "full_address": 3},
    "building": {"building_name": 16, "office_name": 8, "locality": 5, "city_name": 4, "searchable_text": 4, "full_address": 3},
    "office": {"office_name": 16, "building_name": 8, "locality": 5, "city_name": 4, "searchable_text": 4, "full_address": 3},
    "full_address": {"full_address": 16, "searchable_text": 12, "building_name": 5, "office_name": 5, "locality": 4, "city_name": 3, "district_name": 2, "state_name": 2},
    "general": {"searchable_text": 12, "full_address": 10, "building_name": 6, "office_name": 6, "locality": 5, "city_name": 4, "district_name": 3, "state_name": 2, "pincode": 6},
}
LEGACY_PHRASE = {
    "pincode": ("full_address", "searchable_text"), "city": ("city_name", "district_name", "full_address"), "locality": ("locality", "full_address", "searchable_text"),
    "building": ("building_name", "full_address", "searchable_text"), "office": ("office_name", "building_name", "full_address", "searchable_text"),
    "full_address": ("full_address", "searchable_text"), "general": ("full_address", "searchable_text"),
}
LEGACY_FUZZY = {"searchable_text": 10, "full_address": 9, "building_name": 7, "office_name": 7, "locality": 6, "city_name": 5, "district_name": 4, "state_name": 3, "pincode": 6}
LEGACY_PREFIX = {"searchable_text": 10, "full_address": 8, "building_name": 8, "office_name": 8, "locality": 7, "city_name": 6, "district_name": 4}
LEGACY_ADMIN = {"state_name": 10, "district_name": 9, "city_name": 8, "locality": 6, "building_name": 4, "office_name": 4, "searchable_text": 4, "full_address": 3}
LEGACY_HINTS = {"state": ("state_name", 8), "district": ("district_name", 8), "city": ("city_name", 10), "locality": ("locality", 10), "building": ("building_name", 10), "office": ("office_name", 10)}
# fmt: on
SPEC = "strategy string, grp int, must boolean, kind string, source string, field string, boost double, tie double"


class _Rows:
    """Rows of one strategy, groups numbered as they come."""

    def __init__(self, strategy: str) -> None:
        self.strategy, self.rows, self.grp = strategy, [], 0

    def add(self, kind: str, source: str, fields: Mapping[str, float], must: bool = False, boost: float = 1, tie: float = 0, join: bool = False) -> _Rows:
        if not join:
            self.grp += 1
        self.rows += [(self.strategy, self.grp, must, kind, source, f, float(w * boost), float(tie)) for f, w in fields.items()]
        return self

    def entities(self) -> _Rows:
        """Boosts of whatever entities the query has."""
        self.add("phrase", "e.building_name", {"building_name": 5, "office_name": 4, "full_address": 2})
        self.add("phrase", "e.office_name", {"office_name": 5, "building_name": 3, "full_address": 2})
        self.add("phrase", "e.landmark", {"full_address": 2, "locality": 1.5, "building_name": 1.5})
        self.add("phrase", "v.locality", {"locality": 10}, tie=1).add("match", "v.city", {"city_name": 6}, tie=1).add("match", "v.city", {"district_name": 4}, tie=1)
        self.add("match", "e.district", {"district_name": 2}).add("match", "e.state", {"state_name": 1.5}).add("term", "e.pincode", {"pincode": 1})
        return self.add("phrase", "e.road_name", {"road_name": 1}).add("match", "e.flat_number", {"full_address": 1.5})

    def location(self, *names: str, phrase: bool = False) -> _Rows:
        """Boosts of the given filters; phrases have no weight of their own."""
        for n in names:
            if n == "pincode":
                self.add("term", "f.pincode", {"pincode": 1})
            elif n == "road":
                self.add("match", "f.building", {"road_name": 3})
            else:
                field, boost = LOCATION[n]
                self.add("phrase" if phrase else "match", f"f.{n}", {field: 1 if phrase else boost})
        return self


def specification() -> list[tuple]:
    """All rows of the fixed table."""
    every = ("building", "road", "locality", "city", "district", "state", "pincode")
    place = ("locality", "city", "district", "state")
    new = lambda name: _Rows(name).entities()
    locality = new("locality").add("phrase", "v.locality", {"locality": 10}, must=True, tie=1).add("fuzzy", "v.locality", {"locality": 6}, must=True, tie=1, join=True)
    locality.add("phrase", "v.locality", {"full_address": 4}, must=True, tie=1, join=True).add("match", "query_without_locality", LOCALITY, must=True)
    locality.add("match", "v.city", {"city_name": 6}, tie=1).add("match", "v.city", {"district_name": 4}, tie=1).add("phrase", "v.city", {"full_address": 1}, tie=1)
    office = new("office").add("phrase", "office_or_query", {"office_name": 12, "building_name": 6, "full_address": 5}, must=True, tie=1).add("fuzzy", "office_or_query", {"office_name": 8}, must=True, tie=1, join=True)
    office.add("fuzzy", "office_or_query", {"office_name": 6, "building_name": 4, "full_address": 3, "searchable_text": 2}, must=True, tie=1, join=True)
    built = [
        new("exact").add("phrase", "query", GENERAL, must=True).location("pincode", phrase=True),
        new("fuzzy").add("fuzzy", "query", GENERAL, must=True).location("pincode"),
        new("phrase").add("phrase", "query", {"full_address": 1}, must=True).location("pincode", phrase=True),
        new("autocomplete").add("prefix", "query_of_two", AUTOCOMPLETE, must=True, tie=1).location("pincode"),
        new("city").add("match", "query", CITY, must=True).location(*place),
        locality.location("city", "locality", "district", "state", phrase=True),
        new("district").add("match", "query", DISTRICT, must=True).location(*place),
        new("state").add("match", "query", STATE, must=True).location(*place),
        new("building").add("match", "query", GENERAL, must=True).location("building", "road", *place),
        office.location("building", "locality", "city", "district", "state", "pincode", phrase=True),
        new("road").add("match", "query", ROAD, must=True).location("building", "road", *place),
        new("full_address").add("match", "query", GENERAL, must=True).add("phrase", "query", {"full_address": 1}).location(*every),
        new("pincode").add("term", "pincode_or_digits", {"pincode": 1}, must=True).location(*place),
        new("hierarchical_admin").add("match", "building_or_query", ADMIN, must=True).location(*every),
        new("hierarchical_pincode").add("match", "f.city", {"city_name": 3}, must=True).add("match", "f.state", {"state_name": 2}, must=True).add("term", "pincode_or_query", {"pincode": 1}, must=True).location(*place, "pincode"),
        new("geospatial").add("fuzzy", "query", GENERAL, must=True),
    ]
    for mode in ("exact", "phrase", "autocomplete", "pincode", "admin", "fuzzy"):
        for intent, fields in LEGACY.items():
            r = _Rows(f"legacy {mode} {intent}")
            r.add("fuzzy", "query", LEGACY["general"], boost=5, tie=0.25).add("phrase", "query", {"searchable_text": 6}).add("phrase", "query", {"full_address": 5}).add("fuzzy", "query", LEGACY_FUZZY, boost=2, tie=0.2)
            phrases = LEGACY_PHRASE[intent]
            if mode == "exact":
                r.add("phrase", "query", fields, boost=14, tie=0.2)
            elif mode == "autocomplete":
                r.add("prefix", "query", LEGACY_PREFIX, boost=8, tie=1)
            elif mode == "pincode":
                r.add("term", "query", {"pincode": 20}).add("fuzzy", "query", fields, boost=10, tie=0.2).add("fuzzy", "query", LEGACY_FUZZY, boost=3, tie=0.2)
                phrases = ("full_address", "searchable_text")
            elif mode == "admin":
                r.add("fuzzy", "query", LEGACY_ADMIN, boost=8, tie=0.2).add("fuzzy", "query", LEGACY_FUZZY, boost=4, tie=0.2)
                phrases = ("state_name", "district_name", "city_name", "locality")
            elif mode == "phrase":
                r.add("fuzzy", "query", fields, boost=8, tie=0.2)
            else:
                r.add("fuzzy", "query", fields, boost=10, tie=0.25).add("fuzzy", "query", LEGACY_FUZZY, boost=5, tie=0.2)
            weight = {"exact": 12, "phrase": 14, "autocomplete": 5, "pincode": 8, "admin": 7, "fuzzy": 9}[mode]
            for f in phrases:
                r.add("phrase", "query", {f: weight})
            for name, (field, boost) in LEGACY_HINTS.items():
                r.add("phrase", f"f.{name}", {field: boost})
            built.append(r.add("term", "f.pincode", {"pincode": 15}))
    return [row for r in built for row in r.rows]


def resolve(entities: Column, intent: Column, asked: Column, lat: Column, lon: Column, pincode: Column, state: Column) -> Column:
    """The strategy that a query is run with."""
    has = lambda *ks: reduce(lambda a, b: a | b, [entities[k].isNotNull() for k in ks])
    by_intent = {"PINCODE_SEARCH": "pincode", "CITY_SEARCH": "city", "LOCALITY_SEARCH": "locality", "DISTRICT_SEARCH": "district", "STATE_SEARCH": "state", "BUILDING_SEARCH": "building", "OFFICE_SEARCH": "office", "NEARBY_SEARCH": "fuzzy", "ROAD_SEARCH": "road", "FULL_ADDRESS_SEARCH": "full_address"}
    return (
        F.when(F.coalesce(asked, F.lit("auto")) != "auto", F.when(asked.isin(*STRATEGIES), asked).otherwise("auto"))
        .when(lat.isNotNull() & lon.isNotNull(), "geospatial")
        .when(has("pincode") & has("office_name", "building_name", "road_name"), "full_address")
        .when(has("office_name"), "office")
        .when(has("building_name") & has("locality", "city", "pincode"), "full_address")
        .when(has("building_name"), "building")
        .when(has("road_name") & ~has("pincode"), "road")
        .when(has("locality") & has("city") & ~has("pincode"), "locality")
        .when(pincode.isNotNull() | has("pincode"), "pincode")
        .when(F.element_at(X.mapping(by_intent), intent).isNotNull(), F.element_at(X.mapping(by_intent), intent))
        .when(state.isNotNull(), "state")
        .otherwise("fuzzy")
    )


def automatic(query: Column, filters: Column, lat: Column, lon: Column) -> Column:
    """What ``auto`` stands for once it is to be run."""
    some = F.coalesce(*[filters[k] for k in ("building", "locality", "city", "district", "state")]).isNotNull()
    return (
        F.when(lat.isNotNull() & lon.isNotNull(), "geospatial")
        .when(filters["pincode"].isNotNull(), "pincode")
        .when(some, "building")
        .when(query.rlike("^[0-9]{6}$"), "pincode")
        .when(F.size(F.split(query, r"\s+")) >= 4, "full_address")
        .when(F.length(query) <= 12, "autocomplete")
        .otherwise("fuzzy")
    )


def legacy_intent(query: Column, filters: Column, mode: str) -> Column:
    """The older builder's intent of a query."""
    pin = query.rlike("^[0-9]{6}$")
    fixed = {"admin": F.lit("city"), "phrase": F.lit("full_address"), "exact": F.when(pin, "pincode").otherwise("full_address"), "pincode": F.when(pin, "pincode").otherwise("general"), "fuzzy": F.lit("general")}
    if mode in fixed:
        return fixed[mode]
    low, n = F.lower(F.trim(query)), F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != ""))
    return (
        F.when(pin, "pincode")
        .when(low.rlike("post office|office|branch"), "office")
        .when(low.rlike("building|tower|complex|apartment|society|block"), "building")
        .when(filters["city"].isNotNull(), "city").when(filters["locality"].isNotNull(), "locality").when(filters["building"].isNotNull(), "building").when(filters["office"].isNotNull(), "office")
        .when(n >= 4, "full_address").when(n == 1, "city").when(n == 2, "locality").otherwise("general")
    )


def legacy_mode(query: Column, filters: Column, lat: Column, lon: Column) -> Column:
    """The older builder's automatic mode."""
    some = F.coalesce(*[filters[k] for k in ("state", "district", "city", "locality", "building", "office")]).isNotNull()
    return (
        F.when(lat.isNotNull() & lon.isNotNull(), "geospatial").when(filters["pincode"].isNotNull(), "pincode").when(some, "admin")
        .when(query.rlike("^[0-9]{6}$"), "exact").when(F.size(F.split(query, r"\s+")) >= 4, "phrase").when(F.length(query) <= 12, "autocomplete").otherwise("fuzzy")
    )


def as_legacy(plans: DataFrame, mode: str | Column | None = None) -> DataFrame:
    """The plans as the older builder runs them: in the given mode, or the one that it chooses; places by radius stay as they are."""
    q, f = F.col("normalized_query"), F.col("filters")
    chosen = mode if isinstance(mode, Column) else F.lit(mode) if mode else legacy_mode(q, f, F.col("lat"), F.col("lon"))
    intents = {m: legacy_intent(q, f, m) for m in ("exact", "phrase", "autocomplete", "pincode", "admin", "fuzzy")}
    intent = reduce(lambda out, m: F.when(chosen == m, intents[m]).otherwise(out), intents, F.lit("general"))
    return plans.withColumn("run_as", F.when(chosen == "geospatial", chosen).otherwise(F.concat(F.lit("legacy "), chosen, F.lit(" "), intent)))


def plan(analysed: DataFrame) -> DataFrame:
    """Queries with ``strategy``, ``filters``, ``size`` and geography, from analysed queries with entities.

    Optional columns of ``analysed``: strategy, state, district, city, locality,
    building, pincode (filters that win over entities), address_hash (a filter
    only), lat, lon, distance, size.
    """
    given = lambda c, kind="string": F.col(f"asked.{c}") if c in analysed.columns else F.lit(None).cast(kind)
    own = analysed.withColumn("asked", F.struct(*analysed.columns))
    e = F.col("entities")
    pairs = {"state": "state", "district": "district", "city": "city", "locality": "locality", "building": "building_name", "pincode": "pincode", "office": "office_name"}
    filters = F.struct(*[F.coalesce(F.when(given(k) != "", given(k)), e[v]).alias(k) for k, v in pairs.items()], F.when(given("address_hash") != "", given("address_hash")).alias("address_hash"))
    lat, lon = given("lat", "double"), given("lon", "double")
    out = own.withColumn("filters", filters)
    asked = resolve(e, F.col("intent"), given("strategy"), lat, lon, given("pincode"), given("state"))
    out = out.withColumn("resolved", asked)
    run = F.when(F.col("resolved") == "auto", automatic(F.col("normalized_query"), F.col("filters"), lat, lon)).otherwise(F.col("resolved"))
    size = F.least(F.coalesce(F.when(given("size", "int") > 0, given("size", "int")), F.lit(20)), F.lit(100))
    return out.select("query_id", "text", "normalized_query", "tokens", "intent", "entities", "filters", F.col("resolved").alias("strategy"), run.alias("run_as"), size.alias("size"), lat.alias("lat"), lon.alias("lon"), F.coalesce(radius_km(given("distance")), F.lit(5.0)).alias("radius_km"))


def clauses(plans: DataFrame, by: str = "run_as") -> DataFrame:
    """Clause rows of planned queries: the plan's rows of the fixed table, with their texts."""
    spark: SparkSession = plans.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(specification())], "spec_id int, " + SPEC)
    e, f, q = F.col("entities"), F.col("filters"), F.when(F.col("normalized_query") != "", F.col("normalized_query"))
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    sources = {
        "query": one(q), "query_of_two": one(F.when(F.length(q) >= 2, q)), "query_without_locality": one(F.when(f["locality"].isNull(), q)), "office_or_query": one(F.coalesce(e["office_name"], q)),
        "building_or_query": one(F.coalesce(f["building"], q)), "pincode_or_query": one(F.coalesce(f["pincode"], q)), "pincode_or_digits": one(F.coalesce(f["pincode"], F.when(q.rlike(r"^\p{Nd}+$"), q))), "v.locality": locality_variants(f["locality"]), "v.city": locality_variants(f["city"]),
        **{f"e.{k}": one(e[k]) for k in ("building_name", "office_name", "landmark", "district", "state", "pincode", "road_name", "flat_number")},
        **{f"f.{k}": one(f[k]) for k in ("building", "locality", "city", "district", "state", "pincode", "office")},
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("texts")) for k, v in sources.items()]))
    rows = plans.select("query_id", F.col(by).alias("strategy"), each.alias("s")).select("query_id", "strategy", "s.source", F.posexplode("s.texts").alias("variant", "text"))
    rows = rows.join(F.broadcast(table), ["strategy", "source"])
    return rows.select("query_id", (F.col("spec_id") * 100 + F.col("variant")).alias("clause_id"), "grp", "must", "kind", "field", "text", "boost", "tie")
