"""Queries against their SQL on tables made to hold what the given ones hold rarely or never."""

import duckdb
import pytest

from placewright import catalog, catalog_search  # noqa: F401
from placewright.operators import index, search

SF = "/root/testdata/sf0.001"


def differences(spark, folder, name, **tables):
    """Rows of a query on a folder with some tables replaced, missing from or beyond those of its SQL."""
    db = duckdb.connect()
    for t in catalog.TABLES:
        if t in tables:
            tables[t].coalesce(1).write.parquet(f"{folder}/{t}.parquet")
            db.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
            db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    key = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, (int, float)) else v for v in r)) for r in rows)
    want = key(db.sql(catalog.ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert want
    return [x for x in zip(key(got.select(columns).collect()), want) if x[0] != x[1]] if got.count() == len(want) else ["rows", got.count(), len(want)]


def customers(spark, rows):
    return spark.createDataFrame([(k, f"Customer#{k}", k % 25, b, "BUILDING") for k, b in rows], spark.read.parquet(f"{SF}/customer.parquet").schema)


def test_small_coordinates_have_no_exponent(spark, tmp_path):
    small = customers(spark, [(i, b) for i, b in enumerate((0.01, -0.02, 0.03, 0.07, -0.09, 0.1, 0.0, 9999.99, -999.85))])
    assert differences(spark, tmp_path, "coord_validate", customer=small) == []


def test_the_first_of_equal_rows_is_by_serial_text(spark, tmp_path):
    # Rows of these keys agree in all but the serial number, whose order as a text is not that of the number.
    equal = customers(spark, [(1493800 * k, 0.05) for k in (50, 75, 25)] + [(1, 0.02)])
    assert differences(spark, tmp_path, "row_dedup", customer=equal) == []


def clauses(spark, rows):
    kinds = "query_id int, clause_id int, grp int, must boolean, kind string, field string, text string, boost double, tie double"
    return spark.createDataFrame([(q, c, 1, True, kind, "text", t, 1.0, 0.0) for q, c, kind, t in rows], kinds)


@pytest.fixture(scope="module")
def small(spark):
    texts = ["a b c d", "a c b", "a a b 0", "x 0", "b a", "", None, "a b", "d x 0 a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return texts, index.stored(index.build(docs, ["text"], synonyms=False))


def test_terms_and_phrases_meet_by_their_rarest_term(spark, small, monkeypatch):
    texts, stored = small
    written, tables = search.kept, {}
    monkeypatch.setattr(search, "kept", lambda df, name: tables.setdefault(name, written(df, name)))
    asked = ["a b", "x 0", "0", "a b c", "b a", "d", "q a", "a a"]
    rows = [(i, c, kind, t) for i, t in enumerate(asked) for c, kind in enumerate(("term", "phrase"))]
    got = {(r.query_id, r.clause_id, r.doc_id) for r in search.clause_scores(clauses(spark, rows), stored, slop=0, kinds=("term", "phrase")).collect()}
    held = lambda t: f" {t or ''} "
    want = {(i, 0, d) for i, q in enumerate(asked) for d, t in enumerate(texts) if set(q.split()) <= set(held(t).split())}
    want |= {(i, 1, d) for i, q in enumerate(asked) for d, t in enumerate(texts) if f" {q} " in held(t)}
    assert got == want
    met = tables["met"].groupBy("kind", "query_id").count().collect()
    assert sorted(r["count"] for r in met if r.kind == "phrase") == sorted([6, 2, 3, 3, 6, 2, 6])


def test_equal_clauses_are_scored_once(spark, small, monkeypatch):
    _, stored = small
    scored, spots = search.scored_clauses, []
    monkeypatch.setattr(search, "scored_clauses", lambda found, *rest: spots.append(found.count()) or scored(found, *rest))
    many = clauses(spark, [(i, 0, "term", "a b") for i in range(300)] + [(300, 0, "prefix", "x"), (300, 1, "prefix", "x")])
    got = search.clause_scores(many, stored, kinds=("term", "prefix"))
    each = {}
    for r in got.collect():
        each.setdefault((r.query_id, r.clause_id), []).append((r.doc_id, round(r.score, 9)))
    one = search.clause_scores(clauses(spark, [(0, 0, "term", "a b")]), stored, kinds=("term",)).collect()
    want = sorted((r.doc_id, round(r.score, 9)) for r in one)
    assert len(each) == 302 and all(sorted(each[i, 0]) == want for i in range(300)) and len(want) == 6
    assert sorted(each[300, 0]) == sorted(each[300, 1]) == [(3, 1.0), (8, 1.0)]
    assert spots[0] == 3  # a, b and the one word that begins with x


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_postings_are_counted_in_any_slices(spark, monkeypatch, most):
    rows = [(1, "a b a"), (1, "b c"), (2, ""), (None, "a"), (3, None), (4, "c " * 50), (None, "a d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    long = index.term_rows(docs.selectExpr("doc_id", "text"), ["text"], True).select("doc_id", "field", "dl", "term", "pos").toPandas()
    monkeypatch.setattr(index, "MOST_WORDS", most)
    want = {}
    for r in long.itertuples():
        want.setdefault((None if r.doc_id != r.doc_id else int(r.doc_id), r.term), []).append(r.pos)
    parts = spark.createDataFrame(rows, "doc_id long, text string").repartition("doc_id").sortWithinPartitions("doc_id")
    cut = parts.selectExpr("doc_id", "'text' field", "size(filter(split(coalesce(text, ''), ' '), x -> x <> '')) dl", "filter(split(coalesce(text, ''), ' '), x -> x <> '') terms").toArrow()
    direct = {}
    for size in (1, 2, 100):
        got = [r for b in index._counted(cut.combine_chunks().to_batches(max_chunksize=size)) for r in b.to_pylist()]
        direct[size] = sorted((str(r["doc_id"]), r["term"], r["tf"], tuple(r["positions"]), r["dl"]) for r in got)
    assert direct[1] == direct[2] == direct[100]
    got = {(r.doc_id, r.term): sorted(r.positions) for r in index.posting_rows(docs, ["text"], True).collect()}
    assert got == {k: sorted(v) for k, v in want.items()} and got[1, "a"] == [0, 2] and got[1, "b"] == [0, 1]
