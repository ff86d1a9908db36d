"""Upserts that are replayed, reordered and late against one batch."""

import random

from pyspark.sql import functions as F

from placewright.operators import segments
from placewright.sources import csv
from placewright.streaming import upsert


def versions(spark, rows):
    return spark.createDataFrame(rows, "id string, version int, note string")


def test_any_order_of_batches_is_one_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.randint(0, 9), r.choice("xyz")) for _ in range(60)]
    want = sorted(tuple(x) for x in upsert.latest(versions(spark, rows), "id", ("version",)).collect())
    assert [w[0] for w in want] == ["a", "b", "c", "d"] and all(w[1:] == max((v, n) for i, v, n in rows if i == w[0]) for w in want)
    for turn in range(2):
        table = upsert.UpsertTable(spark, str(tmp_path / f"t{turn}"), "id", ("version",))
        assert table.read() is None
        parts = [rows[i::4] for i in range(4)]
        numbers = list(range(4)) + [2, 0]
        r.shuffle(numbers)
        for i, n in enumerate(numbers):
            table.put(versions(spark, parts[n]), n)
            if i == 3:
                table.compact()
        assert sorted(tuple(x) for x in table.read().collect()) == want


def test_a_key_twice_in_the_new_rows_stays_once(spark):
    old = versions(spark, [("a", 1, "x"), ("b", 1, "x")])
    new = versions(spark, [("a", 2, "y"), ("a", 3, "z"), ("c", 1, "x"), ("c", 1, "x")])
    once = csv.merge_by_key(old, new, "id", ("version",))
    assert sorted(tuple(x) for x in once.collect()) == [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "x")]
    assert sorted(map(tuple, csv.merge_by_key(once, new, "id", ("version",)).collect())) == sorted(map(tuple, once.collect()))


def test_a_stream_is_indexed_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i % 12}", f"rose {i}", i) for i in range(30)], "doc_id string, name string, version int")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    index = segments.GrowingIndex(spark, str(tmp_path / "index"), ("name",), synonyms=False)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(index.sink("docs", "version")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    last = index.manifest()["last"]
    index.sink("docs", "version")(docs.withColumn("name", F.lit("other")), 0)
    assert index.manifest()["last"] == last
    assert sorted((r.doc_id, r.version) for r in index.open().docs.collect()) == sorted((f"d{i % 12}", i) for i in range(18, 30))
    index.append(docs.where("version < 3").withColumn("name", F.lit("late")), "version", ("docs", 99))
    assert {r.version for r in index.open().docs.collect()} == set(range(18, 30)) and index.manifest()["batches"] == {"docs": 99}
    assert index.open().terms.where("term = 'late'").count() == 0
