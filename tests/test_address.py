"""Address operators by example, and queries against SQL on the smallest tables."""

import importlib
import os
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from placewright import catalog, catalog_search, service, session
from placewright.functions import similarity as S
from placewright.functions import text as X
from placewright.operators import clean, entities, index, ingest, metrics, query, search
from placewright.plans import strategy
from placewright.sources import csv
from placewright.streaming import ingest as streaming

SF = "/root/testdata/sf0.001"
CHECKED = ("address_dedup", "preprocess_pipeline", "schema_map", "query_normalize", "phrases", "entity_core", "strategy_resolution", "bm25_topk", "phrase_match", "fuzzy_match", "geo_radius", "candidate_dedup", "token_set_ratio", "partial_ratio", "metric_ndcg_10", "query_clauses", "strategy_clauses", "entity_fit_mixed", "preprocess_report", "invalid_counts")


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind}" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.dedup_key, "TCS,  Hinjewadi") == "tcs hinjewadi" == one(spark, X.dedup_key, "TCS Hinjewadi")
    assert one(spark, X.plain_symbols, "sector - 21") == "sector 21"
    assert one(spark, X.expand_abbreviations, "Main Rd") == "Main Road" and one(spark, X.expand_abbreviations, "bird st.") == "bird Street."
    assert one(spark, X.column_key, "Sl. No. (x)*") == "sl no" and one(spark, X.title, "3rd o'neil") == "3Rd O'Neil"
    assert [one(spark, X.pincode, v) for v in ("411045.0", "012345", "4110456", None)] == ["411045", None, None, None]
    assert [one(spark, lambda c: X.coordinate(c, 90), v) for v in ("18.5", "91", "1d", "NaN", " 7 ")] == ["18.5", None, None, None, "7"]
    assert one(spark, X.nfkc, "ﬁ​x") == "fix" and one(spark, X.null_like, " N/A ") is None


def test_unicode_normalize_takes_whole_texts(spark, tmp_path):
    rows = [(1, "plain " * 40 + "ﬁ①Å"), (2, "x" * 59 + "é½ tail"), (3, "ＡＢＣ\u200b end"), (4, "  "), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.value for r in catalog.QUERIES["unicode_normalize"](spark, str(tmp_path)).collect()}
    assert got == {k: unicodedata.normalize("NFKC", t or "").replace("\u200b", "").strip() or None for k, t in rows}


def test_similarity(spark):
    assert one(spark, S.ratio, "abcd", "abxd") == pytest.approx(0.75) and one(spark, S.ratio, "", "x") == 0
    assert one(spark, S.partial_ratio, "bc", "abcd") == 1 and one(spark, S.token_set_ratio, "pune road", "road pune east") == 1
    assert one(spark, S.exact_match, "मुंबई", "दिल्ली") is False and one(spark, S.prefix_affinity, "hinjavadi", "hinjewadi") == pytest.approx(4 / 9)


def test_duplicates_and_quality(spark):
    df = spark.createDataFrame([(1, "411001", "MH"), (2, "411001", "MH"), (3, None, None), (4, "411002", " ")], "ord int, pincode string, state_name string")
    assert clean.row_dedup(df, "ord").count() == 3
    assert {r.ord: r.q for r in df.select("ord", clean.quality_score(df).alias("q")).collect()} == {1: 100.0, 2: 100.0, 3: 0.0, 4: 40.0}
    assert set(clean.empty_columns(df.where("ord = 3"))) == {"pincode", "state_name"}


def test_preprocessing_report(spark):
    rose, none = ("Rose", "411001", "18.5", "27", "MH", None), (None,) * 6
    rows = [rose, rose, none, none, (" ",) * 6, ("rose", "411001", "95", "27", None, None), ("Lily", "012345", "18.5", "28", None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, building_name string, pincode string, latitude string, state_code string, state_name string, note string")
    got = {r.statistic: r.value for r in clean.report(df, clean.preprocess(df, "ord", tally=True), "ord").collect()}
    want = {"rows_input": 7, "rows_output": 2, "duplicate_rows_removed": 2, "empty_rows_removed": 2, "empty_columns_removed": 1, "duplicate_addresses_removed": 1}
    want |= {"filled_state_name": 2, "invalid_pincode": 1, "invalid_latitude": 1, "covered_pincode": 1, "covered_latitude": 2, "null_pct_state_name": 50, "quality_below_50": 0}
    assert {k: got[k] for k in want} == want
    assert not {"note", "_rows"} & set(clean.preprocess(df, "ord").columns)
    nothing = df.where("ord < 0")
    got = {r.statistic: r.value for r in clean.report(nothing, clean.preprocess(nothing, "ord", tally=True), "ord").collect()}
    assert got["rows_input"] == got["rows_output"] == got["duplicate_rows_removed"] == got["filled_state_name"] == 0 and got["quality_mean"] is None


def test_columns_are_mapped(spark):
    got = {h: (s, m) for h, s, _, m in ingest.resolve(spark, ["PIN Code", "statename", "Subdistrict Name", "localty name", "zzz"])}
    assert got == {"PIN Code": ("pincode", "exact"), "statename": ("state_name", "exact"), "Subdistrict Name": ("subdistrict_name", "exact"), "localty name": ("locality", "fuzzy"), "zzz": (None, "unmapped")}


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("officename,pincode,district,statename,latitude\nX,411001,Pune,MH,18.5\n")
    (tmp_path / "b.csv").write_text(",,,\nSl. No.,City/Town,State Code,District\n,,,\n1,Poona,27,Pune\n")
    df, reports = csv.ingest_folder(spark, str(tmp_path))
    assert [r.status for r in reports] == ["success", "success"] and reports[1].header_row == 1
    rows = sorted((r.source_file, r.city_name, r.district_name, r.pincode, r.latitude) for r in df.collect())
    assert rows == [("a.csv", None, "Pune", "411001", 18.5), ("b.csv", "Poona", "Pune", None, None)]


def test_queries_by_example(spark):
    df = spark.createDataFrame([(1, "Flat 12, Rose Tower near metro temple, Hinjewadi Pune 411057"), (2, "Reliance Corporate Office"), (3, "Delhi"), (4, "no. 5 rd Banglore")], "query_id int, text string")
    got = {r.query_id: r for r in service.analyse(df).collect()}
    assert got[1].entities.pincode == "411057" and got[1].entities.flat_number == "12" and got[1].entities.landmark == "Metro" and got[1].intent == "FULL_ADDRESS_SEARCH"
    assert got[2].entities.office_name == "Reliance Corporate Office" and got[3].entities.city == "Delhi"
    assert got[4].normalized_query == "no 5 road bangalore"
    parsed = entities.parse(spark.createDataFrame([("411045",), ("",)], "text string")).collect()
    assert parsed[0].parsed.pincode == "411045" and parsed[0].parsed.intent == "PINCODE_SEARCH" and parsed[1].parsed.intent == "EMPTY_QUERY"
    assert one(spark, query.locality_variants, "Poona") == ["poona", "pune"]


def test_longest_common_subsequence(spark):
    texts = ["", "a", "abc cab", "ab " * 20, "b" * 61, "ab" * 31, "cab " * 40]

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", S.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == length(r.a, r.b), r


def test_search_places_the_address_that_fits_first(spark):
    rows = [("h1", "TCS, Hinjewadi, Pune, Maharashtra, 411057", "TCS", "Hinjewadi", "Pune", "411057", 68.0), ("h2", "Rose Tower, Hinjewadi, Pune, Maharashtra, 411057", "Rose Tower", "Hinjewadi", "Pune", "411057", 70.0), ("h3", "Connaught Place, New Delhi, Delhi, 110001", None, "Connaught Place", "New Delhi", "110001", 80.0)]
    docs = spark.createDataFrame([(r[0], *r) for r in rows], "doc_id string, address_hash string, full_address string, building_name string, locality string, city_name string, pincode string, quality_score double")
    queries = spark.createDataFrame([(1, "rose tower hinjewadi pune 411057"), (2, "zzzz qqqq")], "query_id int, text string")
    got = service.search_addresses(queries, index.build(docs)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place)][0] == "h2" and {r.query_id for r in got} == {1}
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1)) and all(0 <= r.confidence <= 0.99 for r in got)


@pytest.mark.parametrize("name", ["address_retrieval", "address_search"])
def test_searches_retrieve_a_pool_of_100(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def retrieve(plans, clauses, built, k=100):
        raise Asked(k)

    monkeypatch.setattr(catalog_search.search, "retrieve", retrieve)
    with pytest.raises(Asked) as asked:
        catalog.QUERIES[name](spark, SF)
    assert asked.value.args == (100,)


def test_metrics_of_the_ideal_order(spark):
    rows = spark.createDataFrame([(1, 3 - i if i < 3 else 0, 10.0 - i, i) for i in range(8)], "group int, label int, score double, tie int")
    r = metrics.evaluate(rows, "tie").first()
    assert (r.ndcg_10, r.mrr, r.recall_100, r.top1) == (1.0, 1.0, 1.0, 1.0)


def test_stream_takes_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "411001", "x")], "building_name string, pincode string, source_file string")
    for f in streaming.SCHEMA.fieldNames():
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    rows.select(streaming.SCHEMA.fieldNames()).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streaming.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].full_address == "A, 411001" and got[0].address_hash


@pytest.mark.parametrize("name", CHECKED)
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for t in catalog.TABLES:
        p = f"{SF}/{t}.parquet"
        db.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(repr([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in rows)
    assert key(got.select(columns).collect()) == key(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_every_sql_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog_search and importlib.import_module("__spark_entry__").queries()


CSV_TEXT = "Sl. No.,City/Town,State\n1,Orléans,Ö\n2,Pune,Maharashtra\n"


@pytest.mark.parametrize(("encoding", "encodings", "name"), [("utf-8", csv.ENCODINGS, "UTF-8"), ("utf-8-sig", csv.ENCODINGS, "UTF-8"), ("latin-1", csv.ENCODINGS, "ISO-8859-1"), ("cp1252", ("UTF-8", "windows-1252"), "windows-1252")])
def test_csv_encodings(spark, tmp_path, encoding, encodings, name):
    text = CSV_TEXT.replace("Ö", "“Ö”") if encoding == "cp1252" else CSV_TEXT
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    df, report = csv.load(spark, str(tmp_path / "a.csv"), encodings)
    assert report.encoding == name and df.columns == ["Sl. No.", "City/Town", "State"]
    assert [tuple(r) for r in df.collect()] == [("1", "Orléans", "“Ö”" if encoding == "cp1252" else "Ö"), ("2", "Pune", "Maharashtra")]


def test_csv_of_long_letters_is_read_at_every_offset(spark, tmp_path):
    for shift in range(3):
        rows = [f"{i},{'x' * shift}{'पुणे' * 8}" for i in range(3000)]
        path = tmp_path / f"long{shift}.csv"
        path.write_text("pincode,city\n" + "\n".join(rows) + "\n", encoding="utf-8")
        assert path.stat().st_size > 250_000
        df, report = csv.load(spark, str(path))
        assert report.encoding == "UTF-8" and df.count() == 3000 and df.first()["city"].endswith("पुणे")


def test_csv_bad_byte_far_down_decides_the_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"pincode,city\n" + b"411001,Pune\n" * 9000 + b"411002,Orl\xe9ans\n")
    df, report = csv.load(spark, str(tmp_path / "a.csv"))
    assert report.encoding == "ISO-8859-1" and df.where("city = 'Orléans'").count() == 1


def test_csv_rows_above_the_header_go_by_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Total,,\n\npincode,city,statename\n411001,Pune,MH\nTotal,,\npincode,city,statename\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24b")
    try:
        df, report = csv.load(spark, str(tmp_path / "in" / "a.csv"))
        assert report.header_row == 2 and sorted(tuple(r) for r in df.collect()) == [("411001", "Pune", "MH"), ("Total", None, None), ("pincode", "city", "statename")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    merged, reports = csv.ingest_folder(spark, str(tmp_path / "in"), count=True)
    assert reports[0].rows == 3 and reports[0].confidence == 100 and reports[0].warnings == ["header in row 2"] and merged.count() == 3
    assert csv.discover(spark, str(tmp_path / "nowhere")) == [] and csv.ingest_folder(spark, str(tmp_path / "nowhere")) == (None, [])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms_are_brute_force_and_take_long_tokens(spark):
    import random

    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(160)} | {"abcdefghijklmnop", "abcdefghxjklmnp", "q" * 5000})
    wanted = words[::3] + ["abcdefghijklmnop", "q" * 4998 + "z"]
    frame = lambda ws: spark.createDataFrame([("f", w) for w in ws], "field string, term string")
    got = {(x.asked_term, x.term) for x in search.fuzzy_terms(frame(wanted), frame(words)).collect()}
    allowed = lambda a: 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
    want = {(a, b) for a in wanted for b in words if abs(len(a) - len(b)) <= 2 and (len(a) < 100 or len(b) > 100) and edit_distance(a[-40:] if len(a) > 100 else a, b[-40:] if len(a) > 100 else b) <= allowed(a)}
    assert {p for p in got if len(p[0]) < 100} == {p for p in want if len(p[0]) < 100}
    assert ("q" * 4998 + "z", "q" * 5000) in got


@pytest.fixture(scope="module")
def places(spark):
    rows = [("h1", "TCS, Hinjewadi, Pune, 411057", "TCS", "Hinjewadi", "Pune", "411057", 18.59, 73.73, 68.0), ("h2", "Rose Tower, Hinjewadi, Pune, 411057", "Rose Tower", "Hinjewadi", "Pune", "411057", 18.595, 73.735, 70.0), ("h3", "Connaught Place, New Delhi, 110001", None, "Connaught Place", "New Delhi", "110001", 28.63, 77.21, 80.0)]
    docs = spark.createDataFrame([(r[0], *r[:6], {"lat": r[6], "lon": r[7]}, r[8]) for r in rows], "doc_id string, address_hash string, full_address string, building_name string, locality string, city_name string, pincode string, location struct<lat:double,lon:double>, quality_score double")
    return index.build(docs)


def test_queries_without_text_match_all_that_passes_the_filters(spark, places):
    rows = [(1, "", 18.59, 73.73, "1km", None, None), (2, "", None, None, None, "110001", None), (3, "", None, None, None, None, "h2"), (4, "", None, None, None, None, None), (5, "", 28.63, 77.21, "3km", "411057", None), (6, "tcs", None, None, None, None, "h2")]
    asked = spark.createDataFrame(rows, "query_id int, text string, lat double, lon double, distance string, pincode string, address_hash string").withColumn("strategy", F.lit("geospatial"))
    plans = service.planned(asked)
    got = {}
    for r in search.retrieve(plans, strategy.clauses(plans), places).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert [d for d, _ in got[1]] == ["h2", "h1"] and got[1][0][1] == 1 + 0.05 * 70
    assert [d for d, _ in got[2]] == ["h3"] and [d for d, _ in got[3]] == ["h2"] and [d for d, _ in got[4]] == ["h3", "h2", "h1"]
    assert 5 not in got and 6 not in got


def test_nearby_and_reverse_geocoding(spark, places):
    points = spark.createDataFrame([(1, 18.59, 73.73, "3km", None), (2, 18.59, 73.73, "3km", "rose towr"), (3, 0.0, 0.0, "3km", None)], "query_id int, lat double, lon double, distance string, text string")
    got = sorted((r.query_id, r.place, r.doc_id) for r in service.nearby(points, places).collect())
    assert got == [(1, 1, "h1"), (1, 2, "h2"), (2, 1, "h2")]
    found = service.reverse_geocode(points.drop("text", "distance").where("query_id <> 2"), places).collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, "h2")] and 0 <= found[0].confidence <= 0.99
    nearest = service.reverse_geocode(points.drop("text", "distance"), places, order="distance").collect()
    assert {(r.query_id, r.doc_id) for r in nearest} == {(1, "h1"), (2, "h1")}


def test_what_strategies_ask_for():
    rows = {}
    for name, _, must, kind, source, field, boost, _ in strategy.specification():
        rows.setdefault(name, []).append((must, kind, source, field, boost))
    musts = lambda name: {(f, b) for m, _, _, f, b in rows[name] if m}
    assert musts("autocomplete") == {("building_name", 4), ("road_name", 3), ("locality", 2), ("city_name", 1.5), ("district_name", 1.25), ("full_address", 2)}
    asked = lambda name: {s for m, _, s, _, _ in rows[name] if not m and s.startswith("f.")}
    place = {"f.city", "f.locality", "f.district", "f.state"}
    assert asked("autocomplete") == {"f.pincode"} and asked("city") == asked("pincode") == place
    assert asked("building") == asked("road") == place | {"f.building"} and asked("full_address") == place | {"f.building", "f.pincode"}
    assert {s for m, _, s, _, _ in rows["pincode"] if m} == {"pincode_or_digits"}


def test_words_are_no_pincode(spark):
    asked = spark.createDataFrame([(1, "411001"), (2, "pune")], "query_id int, text string").withColumn("strategy", F.lit("pincode"))
    got = strategy.clauses(service.planned(asked)).where("must").collect()
    assert [(r.query_id, r.text) for r in got] == [(1, "411001")]


def test_older_builder(spark):
    asked = spark.createDataFrame([(1, "411001"), (2, "pune"), (3, "rose tower main road hinjewadi")], "query_id int, text string")
    plans = strategy.as_legacy(service.planned(asked))
    assert {r.query_id: r.run_as for r in plans.collect()}[1] in ("legacy exact pincode", "legacy pincode pincode")
    assert strategy.clauses(plans).select("query_id").distinct().count() == 3
    assert {r.run_as for r in strategy.as_legacy(service.planned(asked), "admin").collect()} == {"legacy admin city"}


def test_whole_phrases_are_brute_force(spark):
    import re

    read = lambda t, k: {r[k]: re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()}
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    got = {(r.query_id, r.doc_id) for r in catalog.QUERIES["phrase_whole"](spark, SF).collect()}
    exact = {(q, d) for q, w in items.items() for d, words in docs.items() if w and f" {' '.join(w)} " in f" {' '.join(words)} "}
    assert exact and exact <= got


def test_index_is_written_and_read(spark, places, tmp_path):
    places.write(str(tmp_path / "index"))
    stored = index.Index.read(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "hinjewadi")], "query_id int, text string")
    key = lambda ix: sorted(tuple(r) for r in search.bm25(queries, ix, "full_address").collect())
    assert key(stored) == key(places) != []


def test_similarities_of_many_pairs(spark):
    """Against the definition, over lengths on both sides of a word of bits, equal texts, empty ones and nulls; shared out over tasks, and found again where they are used twice."""
    r = random.Random(3)
    text = lambda: "".join(r.choice("ab c1é") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 130])))
    rows = [(i, text(), text()) for i in range(150)] + [(150, "same text", "same text"), (151, None, "x"), (152, "x" * 3000, "yx" * 2000)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)

    def shared(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    want = {i: None if a is None else 1.0 if a == b else 2 * shared(a, b) / (len(a) + len(b)) for i, a, b in rows}
    got = df.withColumn("s", S.indel(F.col("a"), F.col("b"))).select("id", "s", F.when(F.col("s") > 0.5, F.col("s")).otherwise(F.col("s") / 2).alias("t"))
    assert {x.id: x.s for x in got.collect()} == pytest.approx(want)
    words = df.select("id", S.best_ratio(F.array("a", F.lit("same text")), F.col("b")).alias("m"), S.ratio(F.col("a"), F.col("b")).alias("x"), S.ratio(F.lit("same text"), F.col("b")).alias("y"))
    assert all(x.m == max(x.x, x.y) for x in words.collect())
    assert session.spread(spark.range(100), "id").rdd.getNumPartitions() == 4
