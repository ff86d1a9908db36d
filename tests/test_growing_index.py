"""An index that grows in steps against one built at once."""

import pytest
from pyspark.sql import functions as F

from placewright.operators import index, search, segments

FIELDS = ("name", "city")


def table(spark, rows):
    return spark.createDataFrame([(i, n, c, 1) for i, n, c in rows], "doc_id string, name string, city string, version int")


def rows_of(built):
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    return [key(df.select(sorted(df.columns))) for df in (built.postings, built.fields, built.terms, built.docs)]


@pytest.fixture
def grown(spark, tmp_path):
    return segments.GrowingIndex(spark, str(tmp_path / "index"), FIELDS, synonyms=True)


def test_steps_give_what_one_build_gives(spark, grown):
    a = [(f"d{i}", f"rose tower {i % 7} road", "pune" if i % 3 else None) for i in range(40)]
    b = [(f"d{i}", f"lily rd {i % 5}", "delhi") for i in range(30, 60)]
    c = [("d5", "rose", "agra"), ("d99", "", None), (None, "lost", "lost")]
    grown.append(table(spark, a))
    grown.append(table(spark, b))
    grown.delete(table(spark, [(f"d{i}", "", "") for i in (1, 2, 31, 59, 777)]))
    grown.append(table(spark, c))
    grown.append(table(spark, [("d1", "rose again", "pune")]))
    final = {i: (i, n, t) for i, n, t in a + b} | {"d5": c[0], "d99": c[1]}
    for i in (1, 2, 31, 59):
        del final[f"d{i}"]
    final["d1"] = ("d1", "rose again", "pune")
    want = rows_of(index.build(table(spark, list(final.values())), FIELDS, True))
    assert rows_of(grown.open()) == want
    queries = spark.createDataFrame([(1, "rose pune"), (2, "lily 3")], "query_id int, text string")
    found = lambda ix: sorted(map(tuple, search.bm25(queries, ix, "name").collect()))
    before = found(grown.open())
    assert before == found(index.build(table(spark, list(final.values())), FIELDS, True)) != []
    grown.merge(35)
    assert rows_of(grown.open()) == want and [r.kind for r in grown.figures().orderBy("number").collect()].count("segment") == 2
    grown.delete(table(spark, [("d99", "", ""), ("d0", "", "")]))
    grown.merge(10**6)
    del final["d99"], final["d0"]
    assert rows_of(grown.open()) == rows_of(index.build(table(spark, list(final.values())), FIELDS, True))
    assert [(r.kind, r.docs) for r in grown.figures().collect()] == [("segment", len(final))]


def test_odd_steps(spark, grown):
    with pytest.raises(ValueError):
        grown.open()
    assert grown.append(table(spark, [])) == 0 and grown.delete(table(spark, [("x", "", "")])) == 0
    twice = table(spark, [("x", "old", "a"), ("x", "new", "b")]).withColumn("version", F.when(F.col("name") == "new", 2).otherwise(1))
    n = grown.append(twice, order="version")
    assert [r.name for r in grown.open().docs.collect()] == ["new"] and grown.delete(table(spark, [("y", "", "")])) == n and grown.merge(5) == n
    last, commits = grown.commits()
    grown._valid(last + 1, commits)
    with pytest.raises(Exception):  # of two writers of one number one fails
        grown._valid(last + 1, commits)


def test_a_commit_without_manifest_is_not_there(spark, grown):
    grown.append(table(spark, [("x", "one", "a")]))
    grown._write_segment(9, table(spark, [("y", "two", "b")]), None)
    assert [r.doc_id for r in grown.open().docs.collect()] == ["x"]


def test_counts_of_what_goes_move_documents_not_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", 1), (1, "b c", 3), (2, "b", 3), (3, None, 1)], "doc_id int, text string, segment int")
    fields, terms = segments.GrowingIndex(spark, f"file://{tmp_path}/none", ("text",), synonyms=False)._counts(docs, None, -1)
    assert sorted((r.segment, r.term, r.df) for r in terms.collect()) == [(1, "a", -1), (1, "b", -1), (3, "b", -2), (3, "c", -1)]
    assert terms._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
