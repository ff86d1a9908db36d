"""Requests: errors, the older service, its hard filters by place, and the log."""

import json

import pytest
from pyspark.sql import functions as F

from placewright import requests
from placewright.operators import index

ASK = "query_id int, text string, strategy string, size int, city string, lat double, lon double, distance string"


@pytest.fixture(scope="module")
def held(spark):
    rows = [(f"d{i}", name, city, lat, lon, q) for i, (name, city, lat, lon, q) in enumerate([("Sunrise Tower", "Pune", 18.52, 73.85, 80.0), ("Sunrise Plaza", "Pune", 18.53, 73.85, 40.0), ("Moon Plaza", "Mumbai", 18.521, 73.85, 90.0), ("Sunrise Tower", "Mumbai", 19.07, 72.87, 70.0), ("Unplaced House", "Pune", None, None, 10.0)])]
    df = spark.createDataFrame(rows, "doc_id string, building_name string, city_name string, lat double, lon double, quality_score double")
    for c in ("office_name", "road_name", "locality", "district_name", "state_name", "pincode", "address_hash"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    full = F.concat_ws(", ", "building_name", "city_name")
    df = df.withColumns({"full_address": full, "searchable_text": full, "location": F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))}).drop("lat", "lon")
    return index.build(df)


def test_errors_and_what_stands_in_for_what_is_not_given(spark):
    df = spark.createDataFrame([(1, "x", None, None), (2, "x", "nearest", 0), (3, None, "road", 100), (4, "", "auto", 101)], "query_id int, text string, strategy string, size int")
    got = {r.query_id: (r.errors, r.strategy, r["size"], r.distance) for r in requests.checked(df).collect()}
    assert got == {1: ([], "auto", 20, "5km"), 2: (["strategy", "size"], "nearest", 0, "5km"), 3: ([], "road", 100, "5km"), 4: (["size"], "auto", 101, "5km")}


def test_the_older_service(spark, held):
    here = (18.52, 73.85, "3km")
    asks = [(1, "sunrise tower", "phrase", 2, None, None, None, None), (2, None, None, 5, None, *here), (3, "sunrise", None, 5, None, *here), (4, None, None, 5, "Pune", *here), (5, "moon plaza", "geospatial", 1, None, None, None, None), (6, "zzzz", "exact", 5, None, None, None, None), (7, None, None, 1, "pune", *here), (8, None, None, 2, None, *here)]
    out = requests.older_search(spark.createDataFrame(asks, ASK), held).orderBy("query_id", "place").collect()
    got = {q: [r.doc_id for r in out if r.query_id == q] for q, *_ in asks}
    assert sorted(got[1]) == ["d0", "d3"] and got[2] == ["d0", "d2", "d1"] and got[3] == ["d0", "d1"] and got[4] == ["d0", "d1"]
    assert got[5] == ["d2"] and got[6] == [] and got[7] == [] and got[8] == ["d0", "d2"]
    assert {r.strategy for r in out if r.query_id in (2, 3, 4)} == {"geospatial"} and out[0].full_address


def test_every_request_is_logged(spark):
    asks = spark.createDataFrame([(1, 'a "b"', "auto", 5, "Pune", 1.0, 2.0, "3km"), (2, None, "odd", None, None, None, None, None)], ASK)
    results = spark.createDataFrame([(1, "d0"), (1, "d1")], "query_id int, doc_id string")
    got = {r.query_id: json.loads(r.event) for r in requests.log(asks, results).collect()}
    assert got[1] == {"strategy": "auto", "request": {"text": 'a "b"', "size": 5, "filters": {"city": "Pune"}, "geo": {"lat": 1.0, "lon": 2.0, "distance": "3km"}}, "errors": [], "response": {"candidate_count": 2}}
    assert got[2]["errors"] == ["strategy"] and got[2]["response"] == {"candidate_count": 0}
