"""Preprocessing of a stream against preprocessing of all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from placewright.operators import clean
from placewright.streaming import ingest

SCHEMA = "serial_number string, building_name string, road_name string, state_code string, state_name string, pincode string, note string, ord long"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_is_preprocessing(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"s{i}", r.choice(["Rose", "rose ", "N/A", "Lily", "", None]), r.choice(["Main Rd", "park st", None]), r.choice(["1", "2", " 2", None]), r.choice([None, None, "goa", "Kerala"]), r.choice(["411001", "012345", "411002.0", None]), r.choice([None, " "]) if i == 5 else None, i) for i in range(60)]
    rows += [(f"t{i}", *rows[i][1:7], 100 + i) for i in range(0, 40, 3)] + [("e", "", None, " ", None, None, None, 200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = clean.preprocess(df, "ord")
    held = ingest.Preprocessing(spark, str(tmp_path), "ord")
    assert held.read() is None
    parts = [rows[i::3] for i in range(3)]
    for i, part in enumerate(parts):
        held.put(spark.createDataFrame(part, SCHEMA), i)
        if i == 0:
            held.put(spark.createDataFrame(part, SCHEMA), i)
            held.compact()
    got = held.read()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(str, (tuple(x) for x in d.select(sorted(want.columns)).collect())))
    assert key(got) == key(want)
    assert got.where(F.col("state_name").isNull()).count() < len(rows)


def test_a_row_is_cleaned_once_and_on_all_tasks(spark, tmp_path, monkeypatch):
    seen = []
    cleaned = clean.cleaned
    monkeypatch.setattr(clean, "cleaned", lambda df, text: seen.append((df.count(), len([n for n in df.select(F.spark_partition_id().alias("p")).distinct().collect()]))) or cleaned(df, text))
    held = ingest.Preprocessing(spark, str(tmp_path), "ord")
    for i in range(3):
        rows = [(f"s{i}-{j}", f"rose {j}", "main rd", str(j % 3), "goa" if i == 2 and j == 1 else None, "411001", "x", 1000 * i + j) for j in range(200)]
        held.put(spark.createDataFrame(rows, SCHEMA).coalesce(1), i)
    assert [n for n, _ in seen] == [200, 200, 200]
    assert all(parts > 1 for _, parts in seen)
    got = held.read()
    assert got.where("state_code = '1'").select("state_name").distinct().first()[0] == "Goa" and got.where("state_code <> '1' and state_name is not null").count() == 0
