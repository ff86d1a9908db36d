"""Retrieval that leaves ranges of documents unread against retrieval that reads all, and beginnings of terms."""

import random

import pytest
from pyspark.sql import functions as F

from placewright import service
from placewright.operators import index, parts, search
from placewright.plans import strategy

FIELDS = "doc_id string, address_hash string, full_address string, building_name string, road_name string, locality string, city_name string, state_name string, pincode string, quality_score double"
CITIES = ("pune", "nagpur", "agra", "delhi")


@pytest.fixture(scope="module")
def stored(spark):
    r = random.Random(6)
    rows = []
    for i in range(1500):
        name = f"{r.choice(['rose', 'lily', 'lotus', 'jasmine', 'palm'])} {r.choice(['tower', 'house', 'plaza'])} {r.randint(1, 60)}"
        road, place, city, pin = f"{r.choice(['main', 'park', 'hill'])} road", f"sector {r.randint(1, 40)}", r.choice(CITIES), str(411000 + r.randint(1, 40))
        rows.append((f"h{i:04d}", f"h{i:04d}", f"{name}, {road}, {place}, {city}, {pin}", name, road, place, city, "maharashtra", pin, float(r.randint(0, 100))))
    docs = spark.createDataFrame(rows, FIELDS).repartition(4)
    return index.stored(index.build(docs, index.FIELDS))


def test_pruned_retrieval_is_the_whole_one(spark, stored):
    r = random.Random(7)
    texts = [f"{r.choice(['rose', 'lily', 'palm'])} {r.choice(['tower', 'hose', 'plaza'])} {r.randint(1, 60)} sector {r.randint(1, 40)} {r.choice(CITIES)} {r.choice(['', str(411000 + r.randint(1, 40))])}" for _ in range(25)]
    texts += ["", "pune", "sector 7", "lotus house 12 main road agra", "zzzz", "411007"]
    names = ["auto", "fuzzy", "phrase", "autocomplete", "city", "exact", "office", "pincode", "locality"]
    asked = spark.createDataFrame([(i, t, names[i % len(names)]) for i, t in enumerate(texts)], "query_id int, text string, strategy string")
    plans = service.planned(asked)
    clauses = strategy.clauses(plans)
    pruned = index.with_ranges(stored, 16)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    for k in (3, 40):
        figures = {}
        assert rows(search.retrieve(plans, clauses, pruned, k, figures)) == rows(search.retrieve(plans, clauses, stored, k)) != []
        assert figures["read"] < figures["all"]
        if k == 3:
            assert figures["read"] * 3 < figures["all"], figures


def test_bounds_hold_for_every_document(spark, stored):
    asked = spark.createDataFrame([(1, "rose tower 12 sector 7 pune"), (2, "lily plaza main road")], "query_id int, text string")
    plans = service.planned(asked)
    clauses = strategy.clauses(plans)
    pruned = index.with_ranges(stored, 16)
    spots = search.asked_terms(clauses, pruned).join(pruned.ranges, ["field", "term"])
    bounds = search.range_bounds(spots, clauses).withColumnRenamed("text_score", "bound")
    scores = search.combined(search.clause_scores(clauses, stored), clauses, "doc_id").join(pruned.docs.select("doc_id", "range"), "doc_id")
    both = scores.join(bounds, ["query_id", "range"], "left")
    assert both.where("bound is null or text_score > bound + 1e-9").count() == 0 and both.count() > 100


def test_beginnings_of_any_length(spark):
    terms = ["a", "ab", "abc", "abcd", "abcde", "abce", "x" * 25, "x" * 30, "xy"]
    frame = lambda ws, c: spark.createDataFrame([("f", w) for w in ws], f"field string, {c} string")
    wanted = ["a", "ab", "abcd", "abcdef", "x" * 22, "x" * 30, "q"]
    got = {(r.asked_term, r.term) for r in search.prefix_terms(frame(wanted, "asked_term"), frame(terms, "term")).collect()}
    assert got == {(w, t) for w in wanted for t in terms if t.startswith(w)}
    assert search.prefix_terms(frame(["abcd"], "asked_term"), frame(terms, "term")).select(F.count("*")).first()[0] == 2


def test_parts_of_documents_give_what_all_postings_do(spark, stored):
    texts = ["rose tower 12 sector 7 pune", "lily hose", "sector 7", "pune", "main road agra", "pal", "zzzz", "rose rose tower", "hill road sector 3 nagpur 411007"]
    asked = spark.createDataFrame([(10 * i + j, t, s) for i, t in enumerate(texts) for j, s in enumerate(["fuzzy", "phrase", "autocomplete", "office", "locality", "full_address", "pincode"])], "query_id int, text string, strategy string")
    clauses = strategy.clauses(service.planned(asked)).cache()
    docs = stored.docs.select("doc_id", F.col("quality_score").alias("q"))
    norm = index.K1 * (1 - index.B + index.B * F.col("dl") / F.col("avg_dl"))
    got = parts.best(clauses, lambda c: search.asked_terms(c, stored), stored.postings, docs, norm, 10_000)
    rows = lambda df: {(r.query_id, r.doc_id): round(r.text_score, 6) for r in df.collect()}
    whole = rows(search.combined(search.clause_scores(clauses, stored), clauses, "doc_id"))
    assert rows(got) == pytest.approx(whole, abs=2e-6) and len(whole) > 10_000
    few = parts.best(clauses, lambda c: search.asked_terms(c, stored), stored.postings, docs, norm, 3)
    assert rows(few).items() <= rows(got).items() and 0 < few.count() < len(whole) / 10


def test_equal_queries_are_answered_once(spark):
    asked = spark.createDataFrame([(1, "pune", None), (2, "pune", None), (3, "pune", "city"), (4, None, None), (5, None, None), (6, "agra", None)], "query_id int, text string, strategy string")
    distinct, same = service.once(asked)
    assert sorted(r.query_id for r in distinct.collect()) == [1, 3, 4, 6]
    answers = distinct.select("query_id", F.coalesce("text", F.lit("none")).alias("found"))
    assert sorted(map(tuple, service.for_all(answers, same).collect())) == [(1, "pune"), (2, "pune"), (3, "pune"), (4, "none"), (5, "none"), (6, "agra")]


def test_a_query_meets_few_parts_whatever_the_partitions(spark, stored):
    for docs, tasks in ((0, 1), (1500, 4), (15_000, 36), (15_000, 200), (900_000, 36), (10_000_000, 200)):
        n, blocks = parts.grid(docs, tasks)
        assert n * parts.PART_DOCS >= docs and tasks <= n * blocks <= max(2 * tasks + n, n)
        assert n <= max(-(-docs // parts.PART_DOCS), tasks**0.5 + 1)
    asked = spark.createDataFrame([(i, f"rose tower {i}") for i in range(40)], "query_id int, text string")
    clauses = strategy.clauses(service.planned(asked.withColumn("strategy", F.lit("fuzzy")))).cache()
    docs = stored.docs.select("doc_id", F.col("quality_score").alias("q"))
    best = lambda: sorted(map(tuple, parts.best(clauses, lambda c: search.asked_terms(c, stored), stored.postings, docs, F.lit(1.0), 5).select("query_id", "doc_id", F.round(F.col("text_score") + 0.05 * F.col("q"), 6)).collect()))
    few = best()
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        more = best()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    top = lambda rows: {(q, d) for q in range(40) for _, d in sorted((-s, d) for x, d, s in rows if x == q)[:5]}
    assert top(few) == top(more) and len({q for q, *_ in few}) == 40


def test_written_tables_are_broadcast_by_their_rows_not_their_files(spark):
    from placewright.operators import store

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = lambda n: store.kept(spark.range(n).select((F.col("id") % 7).alias("k"), F.lit("the same text in every row").alias("text")), "wide")
    asked = spark.range(1_000_000).select(F.col("id").alias("k"))
    many, few = wide(400_000), wide(700)
    # What is made of such a table is as large; files of both are small.
    for df in (many, many.where("k > 2"), many.select(F.explode(F.array("k", F.col("k") + 1)).alias("k"))):
        assert "BroadcastHashJoin" not in plan(asked.join(df, "k"))
    assert "BroadcastHashJoin" in plan(asked.join(few, "k"))
    assert many.count() == 400_000 and many.join(few.select("k").distinct(), "k").count() == 400_000


def test_what_many_queries_ask_is_written_small(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 290, "012345").otherwise("54321").alias("text"))
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 1000 == 7, "54321").otherwise("012345").alias("text"))
    clause = asked.select("query_id", F.lit(0).alias("clause_id"), F.lit(1).alias("grp"), F.lit(True).alias("must"), F.lit("term").alias("kind"), F.lit("text").alias("field"), "text", F.lit(1.0).alias("boost"), F.lit(0.0).alias("tie"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where tables are larger
    try:
        search.clause_scores(clause, index.build(docs, ["text"], synonyms=False), kinds=("term",)).select("query_id", "doc_id").write.parquet(f"{tmp_path}/met")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    met = spark.read.parquet(f"{tmp_path}/met")
    n, pairs, queries, ids = met.agg(F.count("*"), F.sum(F.xxhash64("query_id", "doc_id") % 1_000_003), F.sum("query_id"), F.sum("doc_id")).first()
    want = asked.crossJoin(docs.withColumnRenamed("text", "own")).where("text = own").agg(F.count("*"), F.sum(F.xxhash64("query_id", "doc_id") % 1_000_003), F.sum("query_id"), F.sum("doc_id")).first()
    assert (n, pairs, queries, ids) == tuple(want) and n == 19_980 * 290 + 20 * 10
    # A list of 20 000 queries for each document took 2 bytes a row.
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < n / 2
