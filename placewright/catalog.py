"""Queries of the address operators over the driver tables, and SQL that gives the same rows.

The raw tables hold no addresses, so operators run on views made from them by
one SQL text that both engines read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import words
from .operators import clean, ingest, store
from .session import spread
from .sources import csv, records
from .streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ADDRESS = """
WITH base AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM {customer}
  UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM {customer} WHERE c_custkey % 10 = 0)
SELECT CAST(b.c_custkey AS STRING) AS serial_number, CAST(b.c_custkey % 97 AS STRING) AS building_number,
       CASE b.c_custkey % 7 WHEN 0 THEN upper(p.p_name) WHEN 1 THEN '  ' || p.p_name || '  ' WHEN 2 THEN 'N/A' WHEN 3 THEN '--' ELSE p.p_name END AS building_name,
       p.p_type || ' Rd' AS road_name, 'Sector - ' || CAST(b.c_custkey % 40 AS STRING) AS locality, b.c_mktsegment AS city_name,
       CAST(n.n_nationkey AS STRING) AS district_code, n.n_name AS district_name, CAST(r.r_regionkey AS STRING) AS state_code,
       CASE WHEN b.c_custkey % 5 = 0 THEN NULL ELSE r.r_name END AS state_name,
       CASE WHEN b.c_custkey % 11 = 0 THEN '012345' WHEN b.c_custkey % 13 = 0 THEN CAST(100000 + (b.c_custkey*7919) % 900000 AS STRING) || '.0'
            ELSE CAST(100000 + (b.c_custkey*7919) % 900000 AS STRING) END AS pincode,
       CAST(b.c_acctbal/100 AS STRING) AS latitude, CAST(b.c_acctbal/40 AS STRING) AS longitude, b.c_custkey AS ord
FROM base b JOIN {nation} n ON b.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON p.p_partkey = b.c_custkey % 200
"""
#: Free-text queries of every kind, made from the same tables.
ASKED = """
SELECT c.c_custkey AS query_id, CASE c.c_custkey % 12
  WHEN 0 THEN 'Flat ' || CAST(c.c_custkey % 97 AS STRING) || ', ' || p.p_name || ' Tower, Sector ' || CAST(c.c_custkey % 40 AS STRING) || ' ' || n.n_name || ' ' || CAST(100000 + (c.c_custkey*7919) % 900000 AS STRING)
  WHEN 1 THEN p.p_name || ' Rd. ' || n.n_name WHEN 2 THEN 'near ' || p.p_name || ' temple, Banglore' WHEN 3 THEN CAST(100000 + (c.c_custkey*7919) % 900000 AS STRING)
  WHEN 4 THEN p.p_name || ' bank office, Mubmai MH' WHEN 5 THEN n.n_name WHEN 6 THEN CAST(c.c_custkey % 30 AS STRING) || ' Vill. ' || n.n_name || ' Dist ' || c.c_mktsegment
  WHEN 7 THEN 'h.no 12 ' || p.p_name || ' colny, ' || n.n_name || ' TN' WHEN 8 THEN 'opp ' || c.c_mktsegment || ' school ' || p.p_name || ' st' WHEN 9 THEN '' WHEN 10 THEN '1234567 ' || p.p_name
  ELSE 'West Bengal ' || c.c_mktsegment || ' ' || n.n_name END AS text
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {part} p ON p.p_partkey = c.c_custkey % 200
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # Parts grow with the input, and their files are far smaller than their rows: they are joined by shuffles, not broadcast.
    return spark.sql(sql, **{t: table(spark, sf_dir, t).hint("shuffle_hash") if t == "part" else table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark writes doubles below 0.001 with an exponent, DuckDB does not.
    return view(spark, sf_dir, ADDRESS).withColumns({c: X.plain_number(F.col(c)) for c in ("latitude", "longitude")})


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ASKED)


WITH = f"WITH a AS ({duck(ADDRESS)}), "
WITH_Q = f"WITH RECURSIVE q AS ({duck(ASKED)}), "


def query_of(sql: str | None = None, name: str | None = None):
    """Register a query, and its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_map(values: Mapping[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def sql_key(c: str) -> str:
    """The comparison key of a text."""
    return rf"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def sql_value(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('', 'nan', 'none', 'null', '<na>') THEN NULL ELSE trim({c}) END"


SQL_ADDRESS = "concat_ws(', ', " + ", ".join(sql_value(c) for c in words.ADDRESS_PARTS) + ")"
SQL_HASH = f"sha256({sql_key('full_address')})"
BUILT = WITH + f"f AS (SELECT *, {SQL_ADDRESS} AS full_address FROM a), h AS (SELECT *, {SQL_HASH} AS address_hash FROM f) "


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(addresses(spark, sf_dir), "ord")
    df = df.withColumn("full_address", clean.full_address(df))
    return df.withColumn("address_hash", clean.address_hash(F.col("full_address")))


# --- Cleaning ---------------------------------------------------------------------------------------------------


@query_of(BUILT + "SELECT serial_number, full_address FROM h")
def full_address_build(spark, sf_dir):
    return built(spark, sf_dir).select("serial_number", "full_address")


@query_of(BUILT + "SELECT serial_number, address_hash FROM h")
def address_hash(spark, sf_dir):
    return built(spark, sf_dir).select("serial_number", "address_hash")


@query_of(BUILT + "SELECT serial_number, address_hash FROM (SELECT *, row_number() OVER (PARTITION BY address_hash ORDER BY ord) AS n FROM h) WHERE n = 1")
def address_dedup(spark, sf_dir):
    return clean.address_dedup(built(spark, sf_dir), "ord").select("serial_number", "address_hash")


@query_of(WITH + "d AS (SELECT DISTINCT * FROM a) SELECT min(serial_number) AS serial_number, building_number, building_name, road_name, locality, city_name, district_code, state_name, pincode, latitude FROM d GROUP BY ALL")
def row_dedup(spark, sf_dir):
    """The first of equal rows by the text of their serial number, as its SQL has it."""
    return clean.row_dedup(addresses(spark, sf_dir).drop("ord"), "serial_number").select("serial_number", "building_number", "building_name", "road_name", "locality", "city_name", "district_code", "state_name", "pincode", "latitude")


@query_of(WITH + "x AS (SELECT serial_number, CASE WHEN ord % 4 = 0 THEN '  ' ELSE building_name END AS b, CASE WHEN ord % 4 = 0 THEN NULL ELSE city_name END AS c FROM a) SELECT serial_number, b, c FROM x WHERE NOT (trim(coalesce(b, '')) = '' AND trim(coalesce(c, '')) = '')")
def empty_row_drop(spark, sf_dir):
    df = addresses(spark, sf_dir).select("serial_number", F.when(F.col("ord") % 4 == 0, "  ").otherwise(F.col("building_name")).alias("b"), F.when(F.col("ord") % 4 == 0, None).otherwise(F.col("city_name")).alias("c"))
    return clean.drop_empty_rows(df, ["serial_number"])


@query_of(WITH + "x AS (SELECT 1) SELECT serial_number, city_name FROM a")
def empty_column_drop(spark, sf_dir):
    return clean.drop_empty_columns(addresses(spark, sf_dir).select("serial_number", "city_name", F.lit(" ").alias("nothing"), F.lit(None).cast("string").alias("null_only")))


@query_of(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{00ad}]', '', 'g'), ',{2,}', ',', 'g'), '\s+', ' ', 'g')), '') AS value FROM (SELECT page_id, '  ' || url || ',,, ' || chr(8203) || 'x' AS html FROM pages)")
def invalid_chars(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("  "), "url", F.lit(",,, ​x")).alias("html"))
    return df.select("page_id", X.strip_invisible(F.col("html")).alias("value"))


@query_of()
def unicode_normalize(spark, sf_dir):
    """NFKC of whole texts, which DuckDB does not have; held against Python's in the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", X.nfkc(F.col("text")).alias("value"))


@query_of(WITH + f"x AS (SELECT 1) SELECT serial_number, CASE WHEN lower(trim(building_name)) IN ({quoted(words.NULL_LIKE)}) THEN NULL ELSE building_name END AS building_name FROM a")
def null_normalize(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.null_like(F.col("building_name")).alias("building_name"))


@query_of(WITH + "x AS (SELECT trim(state_code) AS code, trim(state_name) AS name, row_number() OVER (PARTITION BY trim(state_code) ORDER BY ord) AS n FROM a WHERE trim(state_name) <> '') SELECT code, name FROM x WHERE n = 1")
def code_name_lookup(spark, sf_dir):
    return clean.code_names(addresses(spark, sf_dir), "state_code", "state_name", "ord")


@query_of(WITH + "m AS (SELECT state_code, arg_min(state_name, ord) AS name FROM a WHERE state_name IS NOT NULL GROUP BY state_code) SELECT serial_number, coalesce(state_name, name) AS state_name, district_name FROM a LEFT JOIN m USING (state_code)")
def hierarchy_fill(spark, sf_dir):
    return clean.fill_hierarchy(addresses(spark, sf_dir), "ord").select("serial_number", "state_name", "district_name")


@query_of(WITH + "x AS (SELECT 1) SELECT 'state_name' AS \"column\", count(*) FILTER (state_name IS NULL AND state_code IS NOT NULL) AS attempts FROM a UNION ALL SELECT 'district_name', count(*) FILTER (district_name IS NULL AND district_code IS NOT NULL) FROM a")
def fill_attempts(spark, sf_dir):
    return clean.fill_attempts(addresses(spark, sf_dir))


@query_of(WITH + rf"""x AS (SELECT serial_number, road_name || ', nr. mkt St-2' AS v FROM a), m AS (SELECT {sql_map(words.ADDRESS_ABBREVIATIONS)} AS m),
t AS (SELECT serial_number, regexp_extract_all(v, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ts FROM x)
SELECT serial_number, array_to_string(list_transform(ts, lambda t: coalesce(m[lower(t)], t)), '') AS road_name FROM t, m""")
def abbreviation_expand(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.expand_abbreviations(F.concat("road_name", F.lit(", nr. mkt St-2"))).alias("road_name"))


@query_of(WITH + r"""x AS (SELECT 1) SELECT serial_number, nullif(trim(regexp_replace(regexp_replace(regexp_replace(locality || ' @(x)', '\s*[-–—]\s*', ' ', 'g'), '[^\p{L}\p{N}_\s,./#&''-]', ' ', 'g'), '\s+', ' ', 'g')), '') AS locality FROM a""")
def symbol_normalize(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.plain_symbols(F.concat("locality", F.lit(" @(x)"))).alias("locality"))


@query_of(WITH + r"x AS (SELECT 1) SELECT serial_number, array_to_string(list_transform(string_split(trim(regexp_replace(building_name, '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS building_name FROM a")
def title_case(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.title_words(F.col("building_name")).alias("building_name"))


@query_of(WITH + r"c AS (SELECT 'automobile' AS key, 'Auto Town' AS name UNION ALL SELECT 'machinery', 'Machine City') SELECT serial_number, coalesce(name, upper(city_name[1]) || lower(city_name[2:])) AS city_name FROM a LEFT JOIN c ON lower(trim(city_name)) = key")
def geographic_standardize(spark, sf_dir):
    known = spark.createDataFrame([("automobile", "Auto Town"), ("machinery", "Machine City")], "key string, name string")
    return clean.standardize(addresses(spark, sf_dir), ["city_name"], known).select("serial_number", "city_name")


SQL_PIN = "CASE WHEN regexp_full_match(split_part(trim(pincode), '.', 1), '[1-9][0-9]{5}') THEN split_part(trim(pincode), '.', 1) END"


@query_of(WITH + f"x AS (SELECT 1) SELECT serial_number, {SQL_PIN} AS pincode FROM a")
def pincode_validate(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.pincode(F.col("pincode")).alias("pincode"))


def sql_coordinate(c: str, bound: int) -> str:
    return f"CASE WHEN try_cast(trim({c}) AS DOUBLE) BETWEEN -{bound} AND {bound} THEN trim({c}) END"


@query_of(WITH + f"x AS (SELECT 1) SELECT serial_number, {sql_coordinate('latitude', 90)} AS latitude, {sql_coordinate('longitude', 180)} AS longitude FROM a")
def coord_validate(spark, sf_dir):
    return clean.validate(addresses(spark, sf_dir)).select("serial_number", "latitude", "longitude")


@query_of(WITH + f"x AS (SELECT 1) SELECT count(*) FILTER ({SQL_PIN} IS NULL) AS invalid_pincode, count(*) FILTER ({sql_coordinate('latitude', 90)} IS NULL) AS invalid_latitude, count(*) FILTER ({sql_coordinate('longitude', 180)} IS NULL) AS invalid_longitude FROM a")
def invalid_counts(spark, sf_dir):
    return clean.invalid_counts(addresses(spark, sf_dir))


def _sql_quality() -> str:
    present = [c for c in words.QUALITY_WEIGHTS]
    earned = " + ".join(f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN ({quoted(words.NULL_LIKE_QUALITY)}) THEN {words.QUALITY_WEIGHTS[c]}.0 ELSE 0.0 END" for c in present)
    return f"round_even(CAST(({earned}) AS DOUBLE) / {sum(words.QUALITY_WEIGHTS.values())} * 100, 2)"


SCORED = BUILT + f", s AS (SELECT *, {_sql_quality()} AS quality_score FROM h) "
SCORED = SCORED.replace(") , s", "), s")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = built(spark, sf_dir)
    return df.withColumn("quality_score", clean.quality_score(df))


@query_of(SCORED + "SELECT serial_number, quality_score FROM s")
def quality_score(spark, sf_dir):
    return scored(spark, sf_dir).select("serial_number", "quality_score")


@query_of(SCORED + 'SELECT min(quality_score) AS "min", max(quality_score) AS "max", round_even(avg(quality_score), 2) AS mean, median(quality_score) AS median, count(*) FILTER (quality_score < 50) AS below_50 FROM s')
def quality_summary(spark, sf_dir):
    return clean.quality_summary(scored(spark, sf_dir))


@query_of(BUILT + "SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM h GROUP BY address_hash)")
def dup_hash_count(spark, sf_dir):
    return clean.duplicate_hashes(built(spark, sf_dir))


FACTS = ("serial_number", "building_name", "state_name", "pincode", "latitude")


@query_of(WITH + "x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round_even(count(*) FILTER ({c} IS NULL OR trim({c}) = '') / greatest(count(*), 1)::DOUBLE * 100, 2) AS null_pct FROM a" for c in FACTS))
def null_pct(spark, sf_dir):
    return clean.null_percentages(addresses(spark, sf_dir).select(*FACTS))


PLACES = ("state_name", "district_name", "city_name", "locality", "pincode")


@query_of(WITH + "x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM a" for c in PLACES))
def distinct_counts(spark, sf_dir):
    return clean.distinct_counts(addresses(spark, sf_dir), PLACES)


@query_of(WITH + "x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (trim({c}) <> '') AS present, round_even(count(*) FILTER (trim({c}) <> '') / greatest(count(*), 1)::DOUBLE * 100, 2) AS pct FROM a" for c in ("pincode", "latitude", "longitude", "state_name")))
def coverage(spark, sf_dir):
    return clean.coverage(addresses(spark, sf_dir), ("pincode", "latitude", "longitude", "state_name"))


def _sql_title(c: str) -> str:
    return rf"array_to_string(list_transform(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _sql_symbols(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '\s*[-–—]\s*', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s,./#&''-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _sql_preprocess() -> str:
    null = lambda c: f"CASE WHEN lower(trim({c})) IN ({quoted(words.NULL_LIKE)}) THEN NULL ELSE {c} END"
    trimmed = lambda c: rf"nullif(trim(regexp_replace({c}, '\s+', ' ', 'g')), '')"
    cols = ("serial_number", "building_number", "building_name", "road_name", "locality", "city_name", "district_code", "district_name", "state_code", "state_name", "pincode", "latitude", "longitude")
    return (
        WITH + "d AS (SELECT DISTINCT * FROM a), n AS (SELECT ord, " + ", ".join(f"{null(trimmed(c))} AS {c}" for c in cols) + " FROM d), "
        + "m AS (SELECT state_code, arg_min(state_name, ord) AS fill FROM n WHERE state_name IS NOT NULL GROUP BY state_code), "
        + "e AS (SELECT n.* REPLACE (coalesce(state_name, fill) AS state_name, regexp_replace(road_name, ' Rd$', ' Road') AS road_name) FROM n LEFT JOIN m USING (state_code)), "
        + f"t AS (SELECT ord, serial_number, building_number, {_sql_title(_sql_symbols('building_name'))} AS building_name, {_sql_title(_sql_symbols('road_name'))} AS road_name, {_sql_title(_sql_symbols('locality'))} AS locality, {_sql_title('city_name')} AS city_name, {_sql_title('district_name')} AS district_name, {_sql_title('state_name')} AS state_name, {SQL_PIN} AS pincode, {sql_coordinate('latitude', 90)} AS latitude, {sql_coordinate('longitude', 180)} AS longitude FROM e), "
        + f"f AS (SELECT *, {SQL_ADDRESS} AS full_address FROM t), h AS (SELECT *, {SQL_HASH} AS address_hash FROM f), "
        + "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address_hash ORDER BY ord) AS rn FROM h) WHERE rn = 1), "
        + f"s AS (SELECT *, {_sql_quality()} AS quality_score FROM u) "
    )


def _sql_report() -> str:
    result = ("serial_number", "building_number", "building_name", "road_name", "locality", "city_name", "district_code", "district_name", "state_code", "state_name", "pincode", "latitude", "longitude", "full_address", "address_hash", "quality_score")
    # Codes are only cleaned, so they are as they were in n.
    columns = {c: f"u2.{c}" for c in result} | {c: f"n2.{c}" for c in ("district_code", "state_code")}
    nulls = " UNION ALL ".join(f"SELECT 'null_pct_{c}' AS statistic, round_even((1 - count(*) FILTER (trim(CAST({v} AS STRING)) <> '') / greatest(count(*), 1)::DOUBLE) * 100, 2) AS value FROM s u2 LEFT JOIN n n2 ON n2.ord = u2.ord" for c, v in columns.items())
    one = {
        "rows_input": "(SELECT count(*) FROM a)", "duplicate_rows_removed": "(SELECT count(*) FROM a) - (SELECT count(*) FROM d)", "empty_columns_removed": "0", "empty_rows_removed": "0",
        "rows_output": "(SELECT count(*) FROM s)", "duplicate_addresses_removed": "(SELECT count(*) FROM d) - (SELECT count(*) FROM s)",
        "filled_state_name": "(SELECT count(*) FROM n WHERE state_name IS NULL AND state_code IS NOT NULL)", "filled_district_name": "(SELECT count(*) FROM n WHERE district_name IS NULL AND district_code IS NOT NULL)",
        "invalid_pincode": f"(SELECT count(*) FROM n WHERE pincode IS NOT NULL AND {SQL_PIN} IS NULL)", "invalid_latitude": f"(SELECT count(*) FROM n WHERE latitude IS NOT NULL AND {sql_coordinate('latitude', 90)} IS NULL)", "invalid_longitude": f"(SELECT count(*) FROM n WHERE longitude IS NOT NULL AND {sql_coordinate('longitude', 180)} IS NULL)",
        "quality_min": "(SELECT min(quality_score) FROM s)", "quality_max": "(SELECT max(quality_score) FROM s)", "quality_mean": "(SELECT round_even(avg(quality_score), 2) FROM s)", "quality_median": "(SELECT round_even(median(quality_score), 2) FROM s)", "quality_below_50": "(SELECT count(*) FROM s WHERE quality_score < 50)",
        **{f"covered_{c}": f"(SELECT count(*) FROM s WHERE trim({c}) <> '')" for c in ("pincode", "latitude", "longitude")},
    }
    return _sql_preprocess() + nulls + " UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', CAST({v} AS DOUBLE)" for k, v in one.items())


@query_of(_sql_preprocess() + "SELECT serial_number, full_address, address_hash, pincode, quality_score FROM s")
def preprocess_pipeline(spark, sf_dir):
    return clean.preprocess(addresses(spark, sf_dir), "ord").select("serial_number", "full_address", "address_hash", "pincode", "quality_score")


@query_of(_sql_preprocess() + "SELECT serial_number, full_address, address_hash, pincode, quality_score FROM s")
def stream_preprocess(spark, sf_dir):
    """The same of a stream of files in which rows, their copies and the names of their codes come in any order."""
    a = addresses(spark, sf_dir)
    folder = f"{store.shared_folder(spark)}/placewright-arriving-{uuid.uuid4().hex}"
    a.repartition(4, F.xxhash64("ord", F.lit(1))).write.parquet(f"{folder}/in")
    held = streaming.Preprocessing(spark, f"{folder}/tables", "ord")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    held.run(stream, f"{folder}/state").awaitTermination()
    return held.read().select("serial_number", "full_address", "address_hash", "pincode", "quality_score")


@query_of(_sql_report())
def preprocess_report(spark, sf_dir):
    """What the steps removed, filled and found invalid, and what their result holds."""
    a = addresses(spark, sf_dir)
    return clean.report(a, clean.preprocess(a, "ord", tally=True), "ord")


# --- Ingestion --------------------------------------------------------------------------------------------------

@query_of("SELECT CAST(doc_id AS STRING) AS doc_id, length(text) AS n_chars, sha256(text) AS text_sha256, CAST(n_chars AS STRING) AS noted FROM documents WHERE trim(text) <> ''")
def csv_records(spark, sf_dir):
    """Documents written as CSV files, whose texts hold commas, quotes and line ends, and read again record by record."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Sl. No."), F.col("text").alias("Locality"), F.col("n_chars").alias("Pincode"))
    folder = f"{store.shared_folder(spark)}/placewright-csv-{uuid.uuid4().hex}"
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    paths = csv.discover(spark, folder)
    rows = records.records(spark, paths, records.survey(spark, paths, csv.ENCODINGS))
    doc_id, text, noted = (F.get("cells", F.lit(i)) for i in range(3))
    return rows.where(F.trim(text) != "").select(doc_id.alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"), noted.alias("noted"))


HEADERS = ("PIN Code", "statename", "district", "Sl. No.", "City/Town", "State/ Union territory*", "Sub-District Name (In English)", "Subdistrict Code", "  Latitude ", "bldg_no", "localty name", "pin_codes", "distrct name", "unknown thing", "tehsil nam", "s.no", "Villages", "")


#: Headers as files have them: names from the list, whole for the first suppliers and then with one letter left out, and suppliers' own names.
ASKED_HEADERS = f"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 6 THEN s_name || ' (x) [' || CAST(s_nationkey AS STRING) || ']' WHEN s_suppkey <= {len(HEADERS)} THEN h
  ELSE substr(h, 1, CAST(s_suppkey % 11 AS INT)) || substr(h, CAST(s_suppkey % 11 AS INT) + 2) END AS header
FROM (SELECT *, CASE s_suppkey % {len(HEADERS)} {" ".join(f"WHEN {i} THEN " + quoted([h]) for i, h in enumerate(HEADERS))} END AS h FROM {{supplier}}) t
"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ASKED_HEADERS).select("header").distinct()


SQL_HEADERS = f"h AS (SELECT DISTINCT header FROM ({duck(ASKED_HEADERS)})), "
SQL_COLUMN_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(header)), '*', ''), '\([^)]*\)', '', 'g'), '[._\-/]+', ' ', 'g'), '\s+', ' ', 'g'))"
SQL_SUB = r"(contains(replace(k, ' ', ''), 'subdistrict') OR regexp_matches(k, '^(sub district|tehsil|taluk)| (tehsil|taluk)'))"
SQL_ALIASES = "al AS (SELECT unnest([" + quoted(ingest.aliases()) + "]) AS alias, unnest([" + quoted(ingest.aliases().values()) + "]) AS standard, unnest(range(" + str(len(ingest.aliases())) + ")) AS place)"


@query_of("WITH " + SQL_HEADERS + f"k AS (SELECT header, {SQL_COLUMN_KEY} AS k FROM h) SELECT header, k AS key, {SQL_SUB} AS subdistrict FROM k")
def column_name_normalize(spark, sf_dir):
    return headers(spark, sf_dir).select("header", X.column_key(F.col("header")).alias("key"), X.is_subdistrict(F.col("header")).alias("subdistrict"))


def sql_lcs(a: str, b: str) -> str:
    """Longest common subsequence by rows; lists are 1-based."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, CASE WHEN substr({a}, CAST(i AS INT), 1) = substr({b}, CAST(j AS INT), 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0::BIGINT])"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(range(1, length({a}) + 1), lambda prev, i: {row}, list_transform(range(length({b}) + 1), lambda x: 0::BIGINT))[-1] END"


def sql_indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN {a} = {b} THEN 1.0 ELSE 2.0 * ({sql_lcs(a, b)}) / (length({a}) + length({b})) END"


@query_of("WITH " + SQL_HEADERS + f"k AS (SELECT DISTINCT header, {SQL_COLUMN_KEY} AS k FROM h), {SQL_ALIASES}, exact AS (SELECT header, standard, 100.0 AS confidence, 'exact' AS \"match\" FROM k JOIN al ON k = alias), "
          f"p AS (SELECT header, k, alias, standard, place FROM k, al WHERE k <> '' AND header NOT IN (SELECT header FROM exact) AND CASE WHEN {SQL_SUB} THEN NOT starts_with(standard, 'district_') ELSE NOT starts_with(standard, 'subdistrict_') END), "
          f"sc AS (SELECT header, standard, place, round({sql_indel('k', 'alias')} * 100, 6) AS score FROM p), "
          "fuzzy AS (SELECT header, standard, score AS confidence, 'fuzzy' AS \"match\" FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, place) AS n FROM sc WHERE score >= 88) WHERE n = 1) "
          "SELECT * FROM exact UNION ALL SELECT * FROM fuzzy UNION ALL SELECT DISTINCT header, NULL, 0.0, 'unmapped' FROM h WHERE header NOT IN (SELECT header FROM exact) AND header NOT IN (SELECT header FROM fuzzy)")  # fmt: skip
def schema_map(spark, sf_dir):
    return ingest.resolve_columns(headers(spark, sf_dir), ingest.alias_table(spark))


@query_of("SELECT s_name AS office_name, NULL AS building_name, CAST(s_nationkey AS STRING) AS state_code, NULL::DOUBLE AS latitude, 'suppliers' AS source_file FROM supplier UNION ALL SELECT NULL, c_name, CAST(c_nationkey AS STRING), c_acctbal, 'customers' FROM customer")
def union_merge(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("Office Name"), F.col("s_nationkey").alias("ST Code"))
    b = table(spark, sf_dir, "customer").select(F.col("c_name").alias("bldgname"), F.col("c_nationkey").alias("state code"), F.col("c_acctbal").alias("lat"))
    parts = [ingest.standardize(df, [(h, s) for h, s, _, _ in ingest.resolve(spark, df.columns)], name) for df, name in ((a, "suppliers"), (b, "customers"))]
    return ingest.merge(parts).select("office_name", "building_name", "state_code", "latitude", "source_file")


@query_of(WITH + rf"""x AS (SELECT serial_number, trim(regexp_replace(v, '\s+', ' ', 'g')) AS v FROM (SELECT serial_number, CASE WHEN ord % 3 = 0 THEN pincode ELSE building_name END AS v FROM a))
SELECT serial_number, CASE WHEN lower(v) IN ({quoted(words.NULL_LIKE_SOURCE)}) THEN NULL ELSE regexp_replace(v, '^(\d+)\.0$', '\1') END AS value FROM x""")
def nullable_string(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", X.nullable_string(F.when(F.col("ord") % 3 == 0, F.col("pincode")).otherwise(F.col("building_name"))).alias("value"))


#: Lines of files, drawn from the parts: titles, headers, data, empty ones.
LINES = """
SELECT p_partkey AS line, CASE p_partkey % 7 WHEN 0 THEN split('|| ', '[|]') WHEN 1 THEN split(p_name || '|||', '[|]') WHEN 2 THEN split('PIN Code|District|' || p_brand, '[|]') WHEN 3 THEN split(CAST(p_size AS STRING) || '|3,400|-1.5|' || p_type, '[|]')
  WHEN 4 THEN split('city|city|pincode|' || CAST(p_partkey AS STRING), '[|]') WHEN 5 THEN split('Sl. No.|City/Town|State/ Union territory*|' || p_type || '|District Code', '[|]') ELSE split(p_type || '|' || p_name, '[|]') END AS cells
FROM {part}
"""
_LINE_KEYS = SQL_COLUMN_KEY.replace("header", "c")


@query_of(f"""WITH l AS ({duck(LINES).replace("split(", "string_split(").replace("'[|]'", "'|'")}), f AS (SELECT line, len(cells) AS n, list_filter(cells, lambda c: trim(c) <> '') AS cs FROM l),
k AS (SELECT *, list_transform(cs, lambda c: {_LINE_KEYS}) AS ks FROM f),
s AS (SELECT *, len(list_distinct(list_filter(ks, lambda k: k IN ({quoted(ingest.aliases())})))) AS hits, len(list_filter(cs, lambda c: regexp_full_match(replace(trim(c), ',', ''), '-?[0-9]+(\\.[0-9]+)?'))) AS numbers FROM k)
SELECT line, CASE WHEN len(cs) = 0 THEN -100.0 WHEN len(cs) = 1 AND n > 3 THEN -50.0 ELSE hits - 0.5 * numbers + CASE WHEN hits > 0 AND len(list_distinct(cs)) = len(cs) THEN 0.5 ELSE 0.0 END END::DOUBLE AS score FROM s""")
def header_score(spark, sf_dir):
    return ingest.header_scores(view(spark, sf_dir, LINES))
