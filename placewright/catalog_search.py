"""Queries of the index, query, retrieval, ranking and metric operators, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import requests, service
from .catalog import ADDRESS, ASKED, BUILT, ORACLES, SQL_ADDRESS, SQL_HASH, WITH, WITH_Q, addresses, asked, duck, query_of, quoted, scored, sql_indel, sql_key, sql_map, sql_words, table, view, _sql_quality
from .functions import similarity as S
from .functions import text as X
from .functions import words
from .operators import places as tree
from .operators import entities, index, learn, metrics, query, rank, search, segments, store, trees
from .plans import strategy
from .session import spread
from .streaming import upsert

# --- Index ------------------------------------------------------------------------------------------------------

SQL_FOLD = f"translate(lower(coalesce({{c}}, '')), '{X.FOLDED[0]}', '{X.FOLDED[1]}')"


def sql_terms(c: str) -> str:
    return rf"regexp_extract_all({SQL_FOLD.format(c=c)}, '[\p{{L}}\p{{N}}]+')"


def documents(spark, sf_dir):
    return index.documents(scored(spark, sf_dir), "ord")


DOCS = BUILT.rstrip() + ", v AS (SELECT *, " + ", ".join(f"CASE WHEN lower(trim({c})) IN ('', 'nan', 'none', 'null', 'na', 'n/a', '<na>') THEN NULL ELSE trim({c}) END AS {c}_" for c in ("address_hash", "pincode", "locality", "building_name")) + " FROM h) "


@query_of(DOCS + "SELECT serial_number, coalesce(address_hash_, 'row-' || ord || '-' || coalesce(pincode_, 'na') || '-' || coalesce(substr(locality_, 1, 40), 'na')) AS doc_id, building_name_ AS building_name, "
          "CASE WHEN try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(longitude AS DOUBLE) BETWEEN -180 AND 180 THEN try_cast(latitude AS DOUBLE) END AS lat FROM v")  # fmt: skip
def doc_map(spark, sf_dir):
    return documents(spark, sf_dir).select("serial_number", "doc_id", "building_name", F.col("location.lat").alias("lat"))


@query_of(DOCS + "SELECT serial_number, 'row-' || ord || '-' || coalesce(pincode_, 'na') || '-' || coalesce(substr(locality_, 1, 40), 'na') AS doc_id FROM v")
def doc_id(spark, sf_dir):
    return index.documents(addresses(spark, sf_dir), "ord").select("serial_number", "doc_id")


@query_of(f"SELECT p_partkey, array_to_string({sql_terms('p_name')}, '|') AS terms FROM part")
def analyzer_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.analyze(F.col("p_name")), "|").alias("terms"))


@query_of(f"SELECT p_partkey, array_to_string(flatten(list_transform({sql_terms('p_name')}, lambda t: list_transform(range(2, least(length(t), 20) + 1), lambda n: substr(t, 1, CAST(n AS INT))))), '|') AS grams FROM part")
def edge_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.edge_ngrams(X.analyze(F.col("p_name"))), "|").alias("grams"))


@query_of(WITH + f"m AS (SELECT {sql_map(words.SYNONYMS)} AS m) SELECT serial_number, array_to_string(flatten(list_transform({sql_terms('road_name')}, lambda t: CASE WHEN m[t] IS NULL THEN [t] ELSE list_concat([t], string_split(m[t], ' ')) END)), '|') AS terms FROM a, m")
def synonym_expand(spark, sf_dir):
    return addresses(spark, sf_dir).select("serial_number", F.array_join(X.with_synonyms(X.analyze(F.col("road_name"))), "|").alias("terms"))


def corpus(spark, sf_dir):
    return index.build(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], synonyms=False)


TOKENS = f"t AS (SELECT doc_id, unnest({sql_terms('text')}) AS term, generate_subscripts({sql_terms('text')}, 1) - 1 AS pos FROM documents)"


@query_of(f"WITH {TOKENS} SELECT (SELECT count(*) FROM documents) AS documents, count(*)::BIGINT AS postings, count(DISTINCT term) AS terms FROM (SELECT DISTINCT doc_id, term FROM t)")
def index_stats(spark, sf_dir):
    return index.stats(corpus(spark, sf_dir))


@query_of(f"WITH {TOKENS} SELECT doc_id, term, count(*)::INT AS tf, min(pos)::INT AS first_position FROM t GROUP BY doc_id, term")
def postings(spark, sf_dir):
    return corpus(spark, sf_dir).postings.select("doc_id", "term", "tf", F.get("positions", F.lit(0)).alias("first_position"))


def grown(spark, sf_dir):
    """An index of the documents that came in three appends, the second with older texts of the first, lost some, and was merged in between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    growing = segments.GrowingIndex(spark, f"{store.shared_folder(spark)}/placewright-index-{uuid.uuid4().hex}", ("text",), synonyms=False)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    growing.append(docs.where(part == 0).unionByName(docs.where(part == 1).select("doc_id", F.reverse("text").alias("text"))))
    growing.append(docs.where(part == 1))
    growing.merge(1 << 40)
    growing.append(docs.where(part == 2))
    growing.delete(docs.where("doc_id % 7 = 3"))
    growing.append(docs.where("doc_id % 14 = 3"))
    return growing.open()


GROWN = "documents WHERE doc_id % 7 <> 3 OR doc_id % 14 = 3"


@query_of(f"WITH {TOKENS.replace('FROM documents', 'FROM ' + GROWN)}, d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id) SELECT term, df, occurrences::BIGINT AS occurrences, n_docs, avg_dl FROM d, (SELECT count(*) AS n_docs, round(avg(dl), 9) AS avg_dl FROM l)")
def index_growth(spark, sf_dir):
    """Terms, postings and statistics of an index after appends, replacements, deletions and a merge."""
    built = grown(spark, sf_dir)
    seen = built.postings.groupBy("term").agg(F.sum("tf").alias("occurrences"))
    return built.terms.join(seen, "term").crossJoin(built.fields).select("term", "df", "occurrences", "n_docs", F.round("avg_dl", 9).alias("avg_dl"))


@query_of("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1")
def keyed_upsert(spark, sf_dir):
    """The last event of each user, from a stream whose files arrive three times, one batch of which comes again and some of which come late."""
    events = table(spark, sf_dir, "events")
    folder = f"{store.shared_folder(spark)}/placewright-events-{uuid.uuid4().hex}"
    held = upsert.UpsertTable(spark, f"{folder}/table", "user_id", ("ts", "event_id"))
    for i in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        held.run(stream, f"{folder}/state").awaitTermination()
    held.compact()
    held.put(events.where("event_id % 2 = 0"), 7, "late")
    held.put(events.where("event_id % 2 = 0"), 7, "late")
    return held.read().select("user_id", "event_id", "ts", "event_type", "value")


# --- Queries ----------------------------------------------------------------------------------------------------

SQL_NORMAL = (
    f"m AS (SELECT {sql_map(words.SPELLING)} AS sp, {sql_map(words.ABBREVIATIONS)} AS ab, {sql_map(words.STATES)} AS st), "
    f"r AS (SELECT query_id, text, list_filter(string_split({sql_key('text')}, ' '), lambda t: t <> '') AS r FROM q), "
    "n1 AS (SELECT query_id, text, list_transform(r, lambda t: coalesce(sp[t], t)) AS r, ab, st FROM r, m), n2 AS (SELECT query_id, text, list_transform(r, lambda t: coalesce(ab[t], t)) AS r, st FROM n1), "
    "n3 AS (SELECT query_id, text, flatten(list_transform(list_transform(r, lambda t: coalesce(st[t], t)), lambda t: string_split(t, ' '))) AS r, st FROM n2), "
    "n AS (SELECT query_id, text, coalesce(list_filter(r, lambda x, i: list_position(r, x) = i), []) AS t, st FROM n3) "
)
NORMAL = WITH_Q + SQL_NORMAL


@query_of(NORMAL + "SELECT query_id, array_to_string(t, ' ') AS normalized FROM n")
def query_normalize(spark, sf_dir):
    return query.analyze(asked(spark, sf_dir)).select("query_id", F.col("normalized_query").alias("normalized"))


@query_of(NORMAL + r"""SELECT query_id, array_to_string(coalesce(flatten(list_transform(list_filter(string_split(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '~' ELSE x END), ' '), '~'), lambda s: trim(s) <> ''),
  lambda s: flatten(list_transform(range(1, len(string_split(trim(s), ' ')) + 1), lambda i: list_transform(list_filter([2, 3, 4], lambda k: i + k - 1 <= len(string_split(trim(s), ' '))), lambda k: array_to_string(string_split(trim(s), ' ')[i:i + k - 1], ' ')))))), []), '|') AS phrases FROM n""")
def phrases(spark, sf_dir):
    return query.analyze(asked(spark, sf_dir)).select("query_id", F.array_join("phrases", "|").alias("phrases"))


@query_of(WITH_Q + "x AS (SELECT 1) SELECT query_id, array_to_string(regexp_extract_all(text, '[0-9]+'), '|') AS numbers, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda n: length(n) = 6)) > 0 AS pincode_like FROM q")
def number_extract(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.array_join(query.numbers(F.col("text")), "|").alias("numbers"), query.potential_pincode(F.col("text")).alias("pincode_like"))


def sql_has(markers) -> str:
    return f"list_has_any(t, [{quoted(markers)}])"


STATE_NAMES = tuple(dict.fromkeys(words.STATES.values()))
PIN = "'[1-9][0-9]{5}'"
SQL_INTENT = f"""CASE WHEN len(t) = 0 THEN 'AUTO_SEARCH' WHEN len(t) = 1 AND regexp_full_match(t[1], {PIN}) THEN 'PINCODE_SEARCH'
 WHEN {sql_has(words.BUILDING_INTENT)} AND (len(t) >= 4 OR len(list_filter(t, lambda x: regexp_full_match(x, {PIN}))) > 0) THEN 'FULL_ADDRESS_SEARCH'
 WHEN {sql_has(words.LANDMARK_INTENT)} THEN 'NEARBY_SEARCH' WHEN {sql_has(words.OFFICE)} THEN 'OFFICE_SEARCH' WHEN {sql_has(words.BLOCK)} THEN 'BLOCK_SEARCH' WHEN {sql_has(words.VILLAGE)} THEN 'VILLAGE_SEARCH'
 WHEN {sql_has(words.DISTRICT)} THEN 'DISTRICT_SEARCH' WHEN {sql_has(words.ROAD_INTENT)} THEN 'ROAD_SEARCH' WHEN {sql_has(words.BUILDING_INTENT)} THEN 'BUILDING_SEARCH' WHEN {sql_has(STATE_NAMES)} THEN 'STATE_SEARCH'
 WHEN len(t) = 1 THEN 'CITY_SEARCH' WHEN len(t) = 2 THEN 'LOCALITY_SEARCH' WHEN len(t) >= 4 THEN 'FULL_ADDRESS_SEARCH' ELSE 'LOCALITY_SEARCH' END"""


@query_of(NORMAL + f"SELECT query_id, {SQL_INTENT} AS intent FROM n")
def intent(spark, sf_dir):
    return query.analyze(asked(spark, sf_dir)).select("query_id", "intent")


@query_of(NORMAL + f"""SELECT query_id, concat_ws('|', CASE WHEN len(t) = 0 THEN 'Query cannot be empty.' END, CASE WHEN len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]{{7,}}'))) > 0 THEN 'Query contains unsupported numeric tokens.' END,
 CASE WHEN len(t) = 1 AND regexp_full_match(t[1], '[0-9]+') AND NOT regexp_full_match(t[1], {PIN}) THEN 'Single numeric token is not a valid pincode.' END, CASE WHEN len(t) = 1 AND length(t[1]) < 2 THEN 'Query is too short.' END) AS errors FROM n""")
def validate_query(spark, sf_dir):
    return query.analyze(asked(spark, sf_dir)).select("query_id", F.array_join("validation_errors", "|").alias("errors"))


_ALIASES = {a: "|".join([a, *[b for b in g if b != a]]) for g in words.LOCALITY_ALIASES for a in g}


_SPELT = ("Poona", " Hinjewadi", "Navi-Mumbai", "madras", "", "१२", *sorted(_ALIASES))
#: Place names as people write them, and names of nations.
SPELLINGS = f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 4 THEN n_name ELSE CASE c_custkey % 3 WHEN 0 THEN h WHEN 1 THEN upper(h) ELSE replace(h, ' ', '-') || '.' END END AS value
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % {len(_SPELT)} {" ".join(f"WHEN {i} THEN {quoted([v])}" for i, v in enumerate(_SPELT))} END AS h FROM {{customer}}) c JOIN {{nation}} n ON c_nationkey = n_nationkey
"""


@query_of(f"WITH v AS ({duck(SPELLINGS)}), m AS (SELECT {sql_map(_ALIASES)} AS m), k AS (SELECT id, value, array_to_string({sql_words('value')}, ' ') AS k, m FROM v, m) SELECT id, CASE WHEN value = '' THEN '' WHEN k = '' THEN value ELSE coalesce(m[k], k) END AS variants FROM k")
def locality_variants(spark, sf_dir):
    return view(spark, sf_dir, SPELLINGS).select("id", F.array_join(query.locality_variants(F.col("value")), "|").alias("variants"))


def sql_title(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({c}), '\p{{L}}+|[^\p{{L}}]+'), lambda p: upper(p[1]) || p[2:]), '')"


def sql_first(markers) -> str:
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({quoted(markers)}))[1]"


def sql_labelled(markers) -> str:
    i = sql_first(markers)
    return rf"(SELECT {sql_title('s')} FROM (SELECT concat_ws(' ', CASE WHEN i > 1 AND regexp_full_match(t[i - 1], '[0-9]+') THEN t[i - 1] END, t[i], CASE WHEN regexp_full_match(t[i + 1], '\p{{L}}+') THEN t[i + 1] END) AS s FROM (SELECT {i} AS i) WHERE i IS NOT NULL))"


_grams = lambda k: f"list_transform(range(1, len(t) - {k - 2}), lambda i: array_to_string(t[i:i + {k - 1}], ' '))"
SQL_STATE = sql_title(f"coalesce(list_filter(list_concat(list_concat({_grams(2)}, {_grams(3)}), t), lambda g: g IN ({quoted(STATE_NAMES)}))[1], list_filter(list_transform(t, lambda x: st[x]), lambda x: x IS NOT NULL)[1])")
_ok = lambda k: rf"coalesce(i > {k} AND regexp_full_match(t[i - {k}], '\p{{L}}+') AND t[i - {k}] NOT IN ({quoted(entities.SEPARATORS)}), false)"
_n = f"CASE WHEN NOT {_ok(1)} THEN 0 WHEN NOT {_ok(2)} THEN 1 WHEN NOT {_ok(3)} THEN 2 WHEN NOT {_ok(4)} THEN 3 ELSE 4 END"
_of = lambda k: f"coalesce(t[i + {k}] IN ({quoted(words.OFFICE)}), false)"
_more = f"CASE WHEN NOT {_of(1)} THEN 0 WHEN NOT {_of(2)} THEN 1 WHEN NOT {_of(3)} THEN 2 WHEN NOT {_of(4)} THEN 3 ELSE 4 END"
_stop = lambda k: f"coalesce(regexp_full_match(t[i + {k}], '[0-9]+') OR t[i + {k}] IN ({quoted(words.PREPOSITIONS + STATE_NAMES)}), true)"
_mark = lambda k: f"coalesce(t[i + {k}] IN ({quoted(words.LANDMARKS)}), false)"
_l = f"CASE WHEN {_stop(1)} THEN 0 WHEN {_mark(1)} OR {_stop(2)} THEN 1 WHEN {_mark(2)} OR {_stop(3)} THEN 2 ELSE 3 END"
#: Entities that depend on the tokens alone.
ENTITIES = (
    NORMAL.rstrip() + f", ix AS (SELECT query_id, unnest(t) AS w, generate_subscripts(t, 1) AS i, t FROM n), "
    f"off AS (SELECT query_id, arg_min({sql_title('s')}, i) AS office_name FROM (SELECT query_id, i, array_to_string(t[i - k:i + x], ' ') AS s FROM (SELECT query_id, i, t, {_n} AS k, {_more} AS x FROM ix WHERE w IN ({quoted(words.OFFICE)})) WHERE k > 0 AND NOT coalesce(i - k > 1 AND t[i - k - 1] IN ({quoted(words.PREPOSITIONS)}), false)) GROUP BY query_id), "
    f"lm AS (SELECT query_id, arg_min({sql_title('s')}, i) AS landmark FROM (SELECT query_id, i, array_to_string(t[i + 1:i + k], ' ') AS s FROM (SELECT query_id, i, t, {_l} AS k FROM ix WHERE w IN ({quoted(words.PREPOSITIONS)})) WHERE k > 0) GROUP BY query_id), "
    f"e AS (SELECT n.query_id, t, list_filter(t, lambda x: regexp_full_match(x, {PIN}))[1] AS pincode, {SQL_STATE} AS state, landmark, office_name, "
    f"(SELECT {sql_title('s')} FROM (SELECT array_to_string(t[greatest(i - 3, 1):i], ' ') AS s FROM (SELECT {sql_first(words.ROAD)} AS i) WHERE i IS NOT NULL)) AS road_name, "
    f"{sql_labelled(words.DISTRICT)} AS district, {sql_labelled(words.VILLAGE)} AS village, {sql_labelled(words.BLOCK)} AS block, {sql_labelled(words.TALUKA)} AS taluka, "
    "list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] = 'flat' AND regexp_full_match(t[i + 1], '[0-9]+') THEN t[i + 1] WHEN t[i] = 'house' AND t[i + 1] = 'number' AND regexp_full_match(t[i + 2], '[0-9]+') THEN t[i + 2] WHEN t[i] = 'house' AND regexp_full_match(t[i + 1], '[0-9]+') THEN t[i + 1] END), lambda x: x IS NOT NULL)[1] AS flat_number, "
    f"{sql_first(words.BUILDING)} AS marker FROM n LEFT JOIN off USING (query_id) LEFT JOIN lm USING (query_id)) "
)


def _entity(*names: str):
    """Registers one query per entity."""
    for name in names:

        def run(spark, sf_dir, name=name):
            return service.analyse(asked(spark, sf_dir)).select("query_id", F.col(f"entities.{name}").alias(name))

        query_of(ENTITIES + f"SELECT query_id, {name} FROM e", f"entity_{name}")(run)


_entity("pincode", "state", "landmark", "office_name", "road_name", "district", "village", "block", "taluka", "flat_number")
_every = words.BUILDING + words.ROAD + words.LOCALITY + words.VILLAGE + words.BLOCK + words.TALUKA + words.DISTRICT + words.OFFICE
_not = lambda c: f"NOT list_contains(string_split(lower(coalesce({c}, '')), ' '), x)"
CORE = ENTITIES.rstrip() + f""", c1 AS (SELECT *, list_filter(t, lambda x: x IS DISTINCT FROM pincode AND {_not('state')} AND {_not('office_name')} AND {_not('landmark')} AND {_not('road_name')} AND x NOT IN ({quoted(tuple(dict.fromkeys(words.PREPOSITIONS + _every)))})) AS f,
  CASE WHEN marker IS NULL THEN [] ELSE list_filter(t[marker + 1:], lambda x: x IS DISTINCT FROM pincode AND x IS DISTINCT FROM flat_number AND {_not('office_name')} AND {_not('landmark')} AND x NOT IN ({quoted(tuple(dict.fromkeys(words.PREPOSITIONS + words.BUILDING + words.ROAD + words.LOCALITY)))})) END AS tail FROM e),
c2 AS (SELECT *, len(f) AS n, len(tail) AS m FROM c1),
c3 AS (SELECT *, CASE WHEN m >= 3 THEN array_to_string(tail[1:m - 2], ' ') WHEN m >= 1 THEN tail[1] END AS b0, CASE WHEN m >= 3 THEN tail[m - 1] WHEN m = 2 THEN tail[2] END AS l0, CASE WHEN m >= 3 THEN tail[m] END AS c0 FROM c2),
core AS (SELECT query_id, {sql_title("CASE WHEN b0 IS NOT NULL THEN b0 WHEN n >= 4 THEN f[1] || ' ' || f[2] WHEN n = 3 THEN f[1] END")} AS building_name,
  {sql_title("coalesce(l0, CASE WHEN b0 IS NULL AND n >= 4 THEN f[n - 1] WHEN b0 IS NULL AND n = 3 THEN f[2] WHEN b0 IS NULL AND n = 2 THEN f[1] END, CASE WHEN n >= 2 THEN f[n - 1] END)")} AS locality,
  coalesce({sql_title("coalesce(c0, CASE WHEN n >= 1 THEN f[n] END)")}, CASE WHEN state IN ('Delhi', 'Chandigarh') THEN state END, CASE WHEN state IS NOT NULL AND len(t) = 1 THEN t[1] END) AS city,
  pincode, state, office_name, road_name, district, flat_number, landmark, t FROM c3) """


@query_of(CORE + "SELECT query_id, building_name, locality, city FROM core")
def entity_core(spark, sf_dir):
    return service.analyse(asked(spark, sf_dir)).select("query_id", "entities.building_name", "entities.locality", "entities.city")


def _sql_parse() -> str:
    """The parser's rules over its own normal form of a text."""
    tokens = SQL_NORMAL
    for theirs, own in ((words.SPELLING, words.PARSER_SPELLING), (words.ABBREVIATIONS, words.PARSER_ABBREVIATIONS), (words.STATES, words.PARSER_STATES)):
        tokens = tokens.replace(sql_map(theirs), sql_map(own))
    named = lambda xs, i: f"CASE WHEN len({xs}) >= {i} THEN {sql_title(f'{xs}[{i}]')} END"
    joined = lambda xs: sql_title(f"nullif(array_to_string({xs}, ' '), '')")
    gone = lambda xs, *names: "list_filter(" + xs + ", lambda x: " + " AND ".join(f"NOT list_contains(string_split(lower(coalesce({c}, '')), ' '), x)" for c in names) + ")"
    first = lambda markers: f"list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({quoted(markers)}))[1]"
    after = lambda i, k: sql_title(f"array_to_string(t[{i}:{i} + {k}], ' ')")
    out, keys = [], entities.PARSER_FIELDS
    source = {"house_number": "flat_number", "area": "locality"}
    own = {k: f"v_{source.get(k, k)}" for k in keys}
    for i, k in enumerate(keys):
        before = ", ".join(f"coalesce(lower(trim({own[j]})), '')" for j in keys[:i])
        out.append(f"CASE WHEN {f'list_contains([{before}], lower(trim({own[k]})))' if before else 'false'} THEN NULL ELSE {own[k]} END AS {k}")
    some = lambda *ks: f"coalesce({', '.join(ks)}) IS NOT NULL" if len(ks) > 1 else f"{ks[0]} IS NOT NULL"
    return WITH_Q + tokens.rstrip() + f""",
p1 AS (SELECT query_id, t, list_filter(t, lambda x: regexp_full_match(x, {PIN}))[1] AS v_pincode, {sql_title(f"coalesce(list_filter(list_transform(t, lambda x: st[x]), lambda x: x IS NOT NULL)[1], list_filter(list_concat(list_concat({_grams(2)}, {_grams(3)}), list_concat({_grams(4)}, t)), lambda g: g IN ({quoted(words.PARSER_STATE_NAMES)}))[1])")} AS v_state,
  {first(words.PARSER_ROAD)} AS ir, {first(words.PARSER_LANDMARK)} AS il, {first(words.DISTRICT)} AS id, {first(words.VILLAGE)} AS iv, {first(words.PARSER_BUILDING)} AS ib FROM n),
p2 AS (SELECT *, CASE WHEN ir IS NOT NULL THEN {sql_title("array_to_string(t[greatest(ir - 2, 1):ir], ' ')")} END AS v_road_name, CASE WHEN il IS NOT NULL THEN {after("il", 2)} END AS v_landmark,
  CASE WHEN id IS NOT NULL THEN {after("id", 1)} END AS v_district, CASE WHEN iv IS NOT NULL THEN {after("iv", 1)} END AS v_village, CASE WHEN regexp_full_match(t[ib + 1], '[0-9]+') THEN t[ib + 1] END AS v_flat_number,
  CASE WHEN ib IS NULL THEN [] ELSE list_filter(t[ib + 1:], lambda x: x IS DISTINCT FROM v_pincode) END AS aft FROM p1),
p3 AS (SELECT *, list_filter({gone("list_filter(t, lambda x: x IS DISTINCT FROM v_pincode)", "v_state", "v_road_name", "v_landmark")}, lambda x: x NOT IN ({quoted(tuple(dict.fromkeys(words.PARSER_BUILDING + words.PARSER_LOCALITY + words.VILLAGE + words.DISTRICT)))})) AS f,
  list_filter(CASE WHEN coalesce(aft[1] = v_flat_number, false) THEN aft[2:] ELSE aft END, lambda x: x NOT IN ({quoted(tuple(dict.fromkeys(words.PARSER_BUILDING + words.PARSER_ROAD)))})) AS tl FROM p2),
p4 AS (SELECT *, len(f) AS n, len(tl) AS m, CASE WHEN len(tl) >= 3 THEN {joined("tl[1:len(tl) - 2]")} ELSE {named("tl", 1)} END AS b0,
  CASE WHEN len(tl) >= 3 THEN {sql_title("tl[len(tl) - 1]")} WHEN len(tl) = 2 THEN {named("tl", 2)} END AS l0, CASE WHEN len(tl) >= 3 THEN {sql_title("tl[len(tl)]")} END AS c0 FROM p3),
p5 AS (SELECT *, coalesce(b0, CASE WHEN n >= 4 THEN {joined("f[n - 1:n]")} WHEN n = 3 THEN {joined("f[2:3]")} END) AS v_building_name,
  coalesce(l0, CASE WHEN b0 IS NULL AND (n >= 2 OR (n = 1 AND len(t) <> 1)) THEN {sql_title("f[1]")} END) AS loc,
  coalesce(c0, CASE WHEN b0 IS NULL AND n >= 4 THEN {sql_title("f[n - 2]")} WHEN b0 IS NULL AND n IN (2, 3) THEN {sql_title("f[2]")} END, CASE WHEN n = 1 THEN {sql_title("f[1]")} END) AS cty FROM p4),
p6 AS (SELECT *, len(t) = 1 AND cty IS NULL AND v_state IS NULL AND v_pincode IS NULL AS lone FROM p5),
p7 AS (SELECT *, CASE WHEN NOT lone THEN loc END AS v_locality, CASE WHEN lone THEN {sql_title("t[1]")} ELSE cty END AS v_city FROM p6),
p8 AS (SELECT query_id, len(t) AS k, {", ".join(out)} FROM p7),
p9 AS (SELECT *, {" + ".join(f"({c} IS NOT NULL)::INT" for c in keys)} AS filled FROM p8)
SELECT query_id, {", ".join(keys)}, CASE WHEN k = 0 THEN 'EMPTY_QUERY' WHEN k = 1 AND {some("pincode")} THEN 'PINCODE_SEARCH' WHEN k = 1 AND {some("city")} THEN 'CITY_SEARCH'
  WHEN {some("building_name")} AND ({some("pincode", "locality", "area", "city", "district", "state")} OR k >= 4) THEN 'FULL_ADDRESS_SEARCH' WHEN filled >= 3 AND k >= 4 THEN 'FULL_ADDRESS_SEARCH' WHEN {some("building_name")} THEN 'BUILDING_SEARCH'
  WHEN {some("road_name")} THEN 'ROAD_SEARCH' WHEN {some("locality", "area")} THEN 'LOCALITY_SEARCH' WHEN {some("city")} THEN 'CITY_SEARCH' WHEN {some("district")} THEN 'DISTRICT_SEARCH' WHEN {some("state")} THEN 'STATE_SEARCH' ELSE 'AUTO' END AS intent,
  round_even(least(0.99, 0.25 + 0.08 * filled + CASE WHEN pincode IS NOT NULL THEN 0.12 ELSE 0.0 END + CASE WHEN k >= 4 THEN 0.15 ELSE 0.0 END)::DOUBLE, 4) AS confidence FROM p9"""


@query_of(_sql_parse())
def parse_address(spark, sf_dir):
    """The parser's twelve entities, intent and confidence."""
    return entities.parse(asked(spark, sf_dir)).select("query_id", "parsed.*")


SQL_STRATEGY = f"""CASE WHEN pincode IS NOT NULL AND coalesce(office_name, building_name, road_name) IS NOT NULL THEN 'full_address' WHEN office_name IS NOT NULL THEN 'office'
 WHEN building_name IS NOT NULL AND coalesce(locality, city, pincode) IS NOT NULL THEN 'full_address' WHEN building_name IS NOT NULL THEN 'building' WHEN road_name IS NOT NULL AND pincode IS NULL THEN 'road'
 WHEN locality IS NOT NULL AND city IS NOT NULL AND pincode IS NULL THEN 'locality' WHEN pincode IS NOT NULL THEN 'pincode' ELSE CASE {SQL_INTENT} WHEN 'PINCODE_SEARCH' THEN 'pincode' WHEN 'CITY_SEARCH' THEN 'city' WHEN 'LOCALITY_SEARCH' THEN 'locality'
 WHEN 'DISTRICT_SEARCH' THEN 'district' WHEN 'STATE_SEARCH' THEN 'state' WHEN 'BUILDING_SEARCH' THEN 'building' WHEN 'OFFICE_SEARCH' THEN 'office' WHEN 'NEARBY_SEARCH' THEN 'fuzzy' WHEN 'ROAD_SEARCH' THEN 'road' WHEN 'FULL_ADDRESS_SEARCH' THEN 'full_address' ELSE 'fuzzy' END END"""


@query_of(CORE + f"SELECT query_id, {SQL_STRATEGY} AS strategy, coalesce(city, '-') AS city_filter FROM core")
def strategy_resolution(spark, sf_dir):
    return service.preview(asked(spark, sf_dir)).select("query_id", "strategy", F.coalesce("filters.city", F.lit("-")).alias("city_filter"))


#: What each strategy asks, a line each: kind, whether it must match, where its text comes from, tie, fields and weights.
#: Lines that begin with + belong to the group of the line above. ``at`` names filters that are asked as well, ``at phrase`` as phrases.
ASKS = {
    "": """phrase should building_name 0 building_name^5 office_name^4 full_address^2
phrase should office_name 0 office_name^5 building_name^3 full_address^2
phrase should landmark 0 full_address^2 locality^1.5 building_name^1.5
phrase should localities 1 locality^10
match should cities 1 city_name^6
match should cities 1 district_name^4
match should district 0 district_name^2
match should state 0 state_name^1.5
term should pincode 0 pincode^1
phrase should road_name 0 road_name^1
match should flat_number 0 full_address^1.5""",
    "exact": """phrase must q 0 building_name^5 office_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2
at pincode""",
    "fuzzy": """fuzzy must q 0 building_name^5 office_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2
at pincode""",
    "phrase": """phrase must q 0 full_address^1
at pincode""",
    "autocomplete": """prefix must q2 1 building_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 full_address^2
at pincode""",
    "city": """match must q 0 city_name^5 locality^3 district_name^2 state_name^1.5 full_address^1.5
at locality city district state""",
    "locality": """phrase must localities 1 locality^10
+fuzzy must localities 1 locality^6
+phrase must localities 1 full_address^4
match must q_alone 0 locality^5 road_name^4 building_name^3 city_name^2 district_name^1.5 state_name^1 full_address^2
match should cities 1 city_name^6
match should cities 1 district_name^4
phrase should cities 1 full_address^1
at phrase city locality district state""",
    "district": """match must q 0 district_name^5 city_name^3 locality^2 state_name^2 full_address^1.5
at locality city district state""",
    "state": """match must q 0 state_name^5 district_name^3 city_name^2 locality^1.5 full_address^1.5
at locality city district state""",
    "building": """match must q 0 building_name^5 office_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2
at building road locality city district state""",
    "office": """phrase must office_or_q 1 office_name^12 building_name^6 full_address^5
+fuzzy must office_or_q 1 office_name^8
+fuzzy must office_or_q 1 office_name^6 building_name^4 full_address^3 searchable_text^2
at phrase building locality city district state pincode""",
    "road": """match must q 0 road_name^5 building_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2
at building road locality city district state""",
    "full_address": """match must q 0 building_name^5 office_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2
phrase should q 0 full_address^1
at building road locality city district state pincode""",
    "pincode": """term must pincode_or_digits 0 pincode^1
at locality city district state""",
    "hierarchical_admin": """match must building_or_q 0 building_name^4 office_name^3 road_name^2 locality^1.5 city_name^1.25 district_name^1 state_name^1 full_address^2
at building road locality city district state pincode""",
    "hierarchical_pincode": """match must city 0 city_name^3
match must state 0 state_name^2
term must pincode_or_q 0 pincode^1
at locality city district state pincode""",
    "geospatial": "fuzzy must q 0 building_name^5 office_name^4 road_name^3 locality^2 city_name^1.5 district_name^1.25 state_name^1 full_address^2",
}
AT = {"building": ("building_name", "building_name", 4), "road": ("building_name", "road_name", 3), "locality": ("locality", "locality", 3), "city": ("city", "city_name", 2.5), "district": ("district", "district_name", 2), "state": ("state", "state_name", 1.5)}


def sql_asks() -> str:
    """``ASKS`` as rows (strategy, grp, must, kind, source, field, boost, tie)."""
    rows = []
    for name in [n for n in ASKS if n]:
        grp = 0
        for line in (ASKS[""] + "\n" + ASKS[name]).split("\n"):
            if line.startswith("at "):
                phrase = "phrase" in line.split()
                for place in [w for w in line.split()[1:] if w != "phrase"]:
                    grp += 1
                    source, field, boost = AT.get(place, ("pincode", "pincode", 1))
                    plain = place == "road" or not phrase
                    rows.append((name, grp, False, "term" if place == "pincode" else "match" if plain else "phrase", source, field, boost if plain else 1, 0))
                continue
            kind, must, source, tie, *fields = line.lstrip("+").split()
            grp += not line.startswith("+")
            rows += [(name, grp, must == "must", kind, source, *f.split("^"), tie) for f in fields]
    return ", ".join(f"('{n}', {g}, {m}, '{k}', '{s}', '{f}', {float(b)}::DOUBLE, {float(t)}::DOUBLE)" for n, g, m, k, s, f, b, t in rows)


def sql_clauses(chosen: str) -> str:
    """Clause rows of the asked queries, run with the strategy that an expression over their entities names."""
    some = lambda c: f"CASE WHEN coalesce({c}, '') <> '' THEN [{c}] ELSE [] END"
    spelt = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN [] WHEN array_to_string({sql_words(c)}, ' ') = '' THEN [{c}] ELSE string_split(coalesce(al[array_to_string({sql_words(c)}, ' ')], array_to_string({sql_words(c)}, ' ')), '|') END"
    texts = {
        **{c: some(c) for c in ("building_name", "office_name", "landmark", "city", "locality", "district", "state", "pincode", "road_name", "flat_number", "q")},
        "localities": spelt("locality"), "cities": spelt("city"), "q2": "CASE WHEN length(q) >= 2 THEN [q] ELSE [] END", "q_alone": f"CASE WHEN locality IS NULL THEN {some('q')} ELSE [] END",
        "office_or_q": some("coalesce(office_name, q)"), "building_or_q": some("coalesce(building_name, q)"), "pincode_or_q": some("coalesce(pincode, q)"),
        "pincode_or_digits": some("coalesce(pincode, CASE WHEN regexp_full_match(q, '[0-9]+') THEN q END)"),
    }
    each = ", ".join(f"{{'source': '{k}', 'texts': {v}}}" for k, v in texts.items())
    return (
        CORE.rstrip() + f", sp AS (SELECT * FROM (VALUES {sql_asks()}) AS v(strategy, grp, must, kind, source, field, boost, tie)), "
        f"pq AS (SELECT core.*, array_to_string(t, ' ') AS q, {sql_map(_ALIASES)} AS al FROM core), pl AS (SELECT *, {chosen} AS strategy FROM pq), "
        f"ts AS (SELECT query_id, strategy, unnest([{each}]) AS s FROM pl), tx AS (SELECT query_id, strategy, s.source AS source, unnest(s.texts) AS text FROM ts) "
        "SELECT query_id, CAST(grp AS INT) AS grp, must, kind, field, text, boost, tie FROM tx JOIN sp USING (strategy, source)"
    )


CLAUSE_COLUMNS = ("query_id", "grp", "must", "kind", "field", "text", "boost", "tie")


@query_of(sql_clauses(SQL_STRATEGY))
def query_clauses(spark, sf_dir):
    """What each query asks of the index, as rows."""
    return strategy.clauses(service.planned(asked(spark, sf_dir))).select(*CLAUSE_COLUMNS)


#: Every strategy in turn, and a name that is none: the query's own form decides then.
NAMED = (*[n for n in ASKS if n], "none of them")
SQL_AUTOMATIC = "CASE WHEN pincode IS NOT NULL THEN 'pincode' WHEN coalesce(building_name, locality, city, district, state) IS NOT NULL THEN 'building' WHEN regexp_full_match(q, '[0-9]{6}') THEN 'pincode' WHEN len(t) >= 4 THEN 'full_address' WHEN q <> '' AND length(q) <= 12 THEN 'autocomplete' ELSE 'fuzzy' END"


@query_of(sql_clauses(f"CASE WHEN query_id % {len(NAMED)} = {len(NAMED) - 1} THEN {SQL_AUTOMATIC} ELSE list_extract([{quoted(NAMED)}], CAST(query_id % {len(NAMED)} AS INT) + 1) END"))
def strategy_clauses(spark, sf_dir):
    """The same for queries that name their strategy, each of them in turn."""
    named = asked(spark, sf_dir).withColumn("strategy", F.get(X.any_of(NAMED), (F.col("query_id") % len(NAMED)).cast("int")))
    return strategy.clauses(service.planned(named)).select(*CLAUSE_COLUMNS)


# --- Retrieval --------------------------------------------------------------------------------------------------


@query_of(f"""WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
bq AS (SELECT DISTINCT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM bq JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(questions, corpus(spark, sf_dir), "text", 10)


@query_of(ORACLES["bm25_topk"].replace("FROM documents", "FROM " + GROWN))
def grown_search(spark, sf_dir):
    """The same of the index that grew."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(questions, grown(spark, sf_dir), "text", 10)


def clause(df, kind: str):
    """One clause per query (query_id, text)."""
    return df.select("query_id", F.lit(0).alias("clause_id"), F.lit(1).alias("grp"), F.lit(True).alias("must"), F.lit(kind).alias("kind"), F.lit("text").alias("field"), "text", F.lit(1.0).alias("boost"), F.lit(0.0).alias("tie"))


@query_of(f"""WITH {TOKENS}, bq AS (SELECT item_id AS query_id, {sql_terms('text')}[3:5] AS ts FROM benchmark), x AS (SELECT query_id, doc_id, pos AS p FROM bq JOIN t ON term = ts[1]), y AS (SELECT query_id, doc_id, pos - 1 AS p FROM bq JOIN t ON term = ts[2]), z AS (SELECT query_id, doc_id, pos - 2 AS p FROM bq JOIN t ON term = ts[3])
SELECT DISTINCT query_id, doc_id FROM x JOIN y USING (query_id, doc_id) JOIN z USING (query_id, doc_id) WHERE greatest(x.p, y.p, z.p) - least(x.p, y.p, z.p) <= 2""")
def phrase_match(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(X.analyze(F.col("text")), 3, 3), " ").alias("text"))
    return search.clause_scores(clause(questions, "phrase"), index.stored(corpus(spark, sf_dir)), slop=2, kinds=("phrase",)).select("query_id", "doc_id")


@query_of()
def phrase_whole(spark, sf_dir):
    """Documents in which a benchmark item's whole text stands as a phrase of slop 2 (SQL has only fixed lengths; tested by brute force)."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.clause_scores(clause(questions, "phrase"), index.stored(corpus(spark, sf_dir)), slop=2, kinds=("phrase",)).select("query_id", "doc_id")


def names(spark, sf_dir):
    """An index of part names."""
    return index.build(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), ["text"], synonyms=False)


NAMES = f"nt AS (SELECT p_partkey AS doc_id, unnest({sql_terms('p_name')}) AS term FROM part)"


@query_of(f"WITH {NAMES}, s AS (SELECT s_suppkey AS query_id, substr({sql_terms('p_name')}[1], 1, 3) AS a FROM supplier JOIN part ON p_partkey = s_suppkey) SELECT DISTINCT query_id, doc_id FROM s JOIN nt ON starts_with(term, a)")
def prefix_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.substring(F.get(X.analyze(F.col("p_name")), F.lit(0)), 1, 3).alias("text"))
    return search.clause_scores(clause(s, "prefix"), names(spark, sf_dir), kinds=("prefix",)).select("query_id", "doc_id")


@query_of(f"WITH {NAMES}, v AS (SELECT DISTINCT term FROM nt), a AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4) AS asked_term FROM v) SELECT asked_term, term, levenshtein(asked_term, term) AS distance FROM a, v WHERE levenshtein(asked_term, term) <= CASE WHEN length(asked_term) <= 2 THEN 0 WHEN length(asked_term) <= 5 THEN 1 ELSE 2 END")
def fuzzy_match(spark, sf_dir):
    vocabulary = names(spark, sf_dir).terms
    misspelt = vocabulary.select("field", F.concat(F.substring("term", 1, 2), F.substring("term", 4, 100)).alias("term"))
    return search.fuzzy_terms(misspelt, vocabulary).select("asked_term", "term", F.levenshtein("asked_term", "term").cast("long").alias("distance"))


@query_of(WITH + "q AS (SELECT DISTINCT ord AS query_id, pincode AS p FROM a) SELECT DISTINCT query_id, ord AS doc FROM q JOIN a ON pincode = p")
def pincode_term(spark, sf_dir):
    a = addresses(spark, sf_dir)
    docs = index.build(a.select(F.col("ord").alias("doc_id"), F.col("pincode").alias("text")).distinct(), ["text"], synonyms=False)
    return search.clause_scores(clause(a.select(F.col("ord").alias("query_id"), F.col("pincode").alias("text")).distinct(), "term"), docs, kinds=("term",)).select("query_id", F.col("doc_id").alias("doc"))


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"6371.0 * 2 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h})))"


PLACES = "p AS (SELECT DISTINCT c_custkey AS id, c_acctbal / 200 AS lat, c_acctbal / 90 AS lon FROM customer)"
NEAR = f"WITH {PLACES}, near AS (SELECT x.id AS query_id, y.id AS doc_id, {sql_haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km FROM p x, p y WHERE x.id % 20 = 0) "


def places(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") / 200).alias("lat"), (F.col("c_acctbal") / 90).alias("lon"))


def points(spark, sf_dir):
    return places(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "lat", "lon")


@query_of(NEAR + "SELECT query_id, doc_id, round(km, 6) AS km FROM near WHERE km <= 25")
def geo_radius(spark, sf_dir):
    found = search.within(points(spark, sf_dir).withColumn("radius_km", search.radius_km(F.lit("25km"))), places(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("distance_km", 6).alias("km"))


@query_of(NEAR + "SELECT query_id, doc_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, doc_id) AS place FROM near WHERE km <= 40)")
def geo_sort(spark, sf_dir):
    docs = places(spark, sf_dir).select("doc_id", F.struct("lat", "lon").alias("location"))
    return service.nearby(points(spark, sf_dir).withColumn("distance", F.lit("40km")), index.Index(docs, docs, docs, docs)).select("query_id", "doc_id", "place")


@query_of(NEAR + "SELECT query_id, doc_id, round(km, 6) AS km, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, doc_id) AS place FROM near) WHERE place <= 10")
def geo_nearest(spark, sf_dir):
    """The ten nearest places of each point, however far, from a tree whose cells hold 64 places at most."""
    found = tree.nearest(points(spark, sf_dir), tree.build(places(spark, sf_dir), 64), 10)
    return found.select("query_id", "doc_id", F.round("distance_km", 6).alias("km"), "place")


HITS = "hit AS (SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS query_id, c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'h' || CAST(c_custkey % 7 AS STRING) END AS address_hash, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || '  ' || CAST(c_nationkey % 3 AS STRING) END AS full_address, round(c_acctbal / 100, 4) AS s FROM {customer}), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INT) AS rank FROM hit)"


def hits(spark, sf_dir):
    return spark.sql("WITH " + HITS + " SELECT * FROM ranked", customer=table(spark, sf_dir, "customer"))


SQL_HIT_KEY = r"coalesce('hash:' || nullif(address_hash, ''), 'addr:' || nullif(lower(trim(regexp_replace(full_address, '\s+', ' ', 'g'))), ''), 'id:' || doc_id)"


@query_of("WITH " + duck(HITS) + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {SQL_HIT_KEY} ORDER BY rank) AS n FROM ranked) SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS retrieval_position FROM k WHERE n = 1")
def candidate_dedup(spark, sf_dir):
    return search.candidate_dedup(hits(spark, sf_dir)).select("query_id", "doc_id", "retrieval_position")


JUDGED = "j AS (SELECT query_id, doc_id, full_address, rank AS retrieval_position, round((s + 10) / 120, 4) AS confidence, CAST(doc_id % 11 AS DOUBLE) AS score, s AS bm25_score FROM ranked)"


def judged(spark, sf_dir):
    return spark.sql("WITH " + HITS + ", " + JUDGED + " SELECT * FROM j", customer=table(spark, sf_dir, "customer"))


@query_of("WITH " + duck(HITS) + ", " + JUDGED + " SELECT query_id, doc_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, score DESC, bm25_score DESC, retrieval_position) AS n FROM j) WHERE n = 1")
def best_match(spark, sf_dir):
    return search.best_match(judged(spark, sf_dir)).select("query_id", "doc_id", "confidence")


@query_of("WITH " + duck(HITS) + ", " + JUDGED + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, score DESC, bm25_score DESC, retrieval_position) AS n FROM j), b AS (SELECT query_id, full_address AS fa FROM o WHERE n = 1) SELECT query_id, doc_id, place::INT AS place FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM o JOIN b USING (query_id) WHERE full_address IS DISTINCT FROM fa) WHERE place <= 5")
def resolve_alternatives(spark, sf_dir):
    return search.alternatives(judged(spark, sf_dir)).select("query_id", "doc_id", "place")


#: What the older builder asks in each mode: kind, tie, field or set of fields, and weight; ``@intent`` stands for the fields of the query's intent. Then phrases of single fields, weighted by mode.
OLDER = {
    "": "fuzzy .25 @general*5 phrase 0 searchable_text*6 phrase 0 full_address*5 fuzzy .2 @wide*2",
    "exact": "phrase .2 @intent*14", "autocomplete": "prefix 1 @begun*8", "pincode": "term 0 pincode*20 fuzzy .2 @intent*10 fuzzy .2 @wide*3",
    "admin": "fuzzy .2 @places*8 fuzzy .2 @wide*4", "phrase": "fuzzy .2 @intent*8", "fuzzy": "fuzzy .25 @intent*10 fuzzy .2 @wide*5",
}
OLDER_PHRASES = {"exact": 12, "phrase": 14, "autocomplete": 5, "pincode": 8, "admin": 7, "fuzzy": 9}


def _sql_older() -> str:
    sets = {**strategy.LEGACY, "wide": strategy.LEGACY_FUZZY, "begun": strategy.LEGACY_PREFIX, "places": strategy.LEGACY_ADMIN}
    rows = []
    for mode, weight in OLDER_PHRASES.items():
        for intent_name in strategy.LEGACY:
            grp, parts = 0, f"{OLDER['']} {OLDER[mode]}".split()
            for kind, tie, what in zip(parts[::3], parts[1::3], parts[2::3]):
                grp += 1
                name, times = what.split("*")
                fields = sets[intent_name if name == "@intent" else name[1:]] if name.startswith("@") else {name: 1}
                rows += [(mode, intent_name, grp, kind, "q", f, w * float(times), float(tie)) for f, w in fields.items()]
            single = {"pincode": ("full_address", "searchable_text"), "admin": ("state_name", "district_name", "city_name", "locality")}.get(mode, strategy.LEGACY_PHRASE[intent_name])
            hints = [("phrase", k, f, float(w)) for k, (f, w) in strategy.LEGACY_HINTS.items()] + [("term", "pincode", "pincode", 15.0)]
            for kind, source, f, w in [("phrase", "q", f, float(weight)) for f in single] + hints:
                grp += 1
                rows.append((mode, intent_name, grp, kind, source, f, w, 0.0))
    values = ", ".join(f"('{m}', '{i}', {g}, '{k}', '{s}', '{f}', {b}::DOUBLE, {t}::DOUBLE)" for m, i, g, k, s, f, b, t in rows)
    pin = "regexp_full_match(q, '[0-9]{6}')"
    return CORE.rstrip() + f""", sp AS (SELECT * FROM (VALUES {values}) AS v(mode, wish, grp, kind, source, field, boost, tie)),
o1 AS (SELECT *, array_to_string(t, ' ') AS q FROM core), o2 AS (SELECT *, CASE WHEN pincode IS NOT NULL THEN 'pincode' WHEN coalesce(state, district, city, locality, building_name, office_name) IS NOT NULL THEN 'admin'
  WHEN {pin} THEN 'exact' WHEN len(t) >= 4 THEN 'phrase' WHEN length(q) <= 12 THEN 'autocomplete' ELSE 'fuzzy' END AS mode FROM o1),
o3 AS (SELECT *, CASE mode WHEN 'admin' THEN 'city' WHEN 'phrase' THEN 'full_address' WHEN 'exact' THEN CASE WHEN {pin} THEN 'pincode' ELSE 'full_address' END WHEN 'pincode' THEN CASE WHEN {pin} THEN 'pincode' ELSE 'general' END WHEN 'fuzzy' THEN 'general'
  ELSE CASE WHEN {pin} THEN 'pincode' WHEN regexp_matches(q, 'post office|office|branch') THEN 'office' WHEN regexp_matches(q, 'building|tower|complex|apartment|society|block') THEN 'building' WHEN len(t) >= 4 THEN 'full_address' WHEN len(t) = 1 THEN 'city' WHEN len(t) = 2 THEN 'locality' ELSE 'general' END END AS wish FROM o2),
o4 AS (SELECT query_id, mode, wish, unnest([{{'source': 'q', 'text': nullif(q, '')}}, {{'source': 'state', 'text': state}}, {{'source': 'district', 'text': district}}, {{'source': 'city', 'text': city}}, {{'source': 'locality', 'text': locality}}, {{'source': 'building', 'text': building_name}}, {{'source': 'office', 'text': office_name}}, {{'source': 'pincode', 'text': pincode}}]) AS s FROM o3)
SELECT query_id, CAST(grp AS INT) AS grp, false AS must, kind, field, s.text AS text, boost, tie FROM o4 JOIN sp ON sp.mode = o4.mode AND sp.wish = o4.wish AND sp.source = s.source WHERE s.text IS NOT NULL"""


@query_of(_sql_older())
def legacy_clauses(spark, sf_dir):
    """What the older builder asks of the index for each query, in the mode that it chooses."""
    return strategy.clauses(strategy.as_legacy(service.planned(asked(spark, sf_dir)))).select(*CLAUSE_COLUMNS)


REQUESTED = """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS text, CASE c_custkey % 9 WHEN 0 THEN 'auto' WHEN 1 THEN 'phrase' WHEN 2 THEN 'locality' WHEN 3 THEN 'nearest' WHEN 4 THEN 'geospatial' WHEN 5 THEN 'hierarchical_admin' END AS strategy,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 130 AS INT) END AS size, CASE WHEN c_custkey % 6 = 1 THEN c_mktsegment WHEN c_custkey % 6 = 2 THEN '' END AS state, CASE WHEN c_custkey % 7 = 3 THEN CAST(100000 + c_custkey AS STRING) END AS pincode,
CASE WHEN c_custkey % 11 = 5 THEN c_acctbal / 200 END AS lat, CASE WHEN c_custkey % 22 = 5 THEN c_acctbal / 90 END AS lon FROM {customer}"""


@query_of(f"""WITH r AS ({duck(REQUESTED)}) SELECT query_id, concat_ws(',', CASE WHEN coalesce(strategy, 'auto') NOT IN ({", ".join(f"'{s}'" for s in strategy.STRATEGIES)}) THEN 'strategy' END, CASE WHEN coalesce(size, 20) < 1 OR coalesce(size, 20) > 100 THEN 'size' END) AS errors,
CASE WHEN strategy IN ('exact', 'fuzzy', 'phrase', 'autocomplete', 'hierarchical_admin', 'hierarchical_pincode', 'geospatial') THEN strategy WHEN coalesce(strategy, 'auto') <> 'auto' THEN 'auto' WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'geospatial'
 WHEN pincode <> '' THEN 'hierarchical_pincode' WHEN state <> '' THEN 'hierarchical_admin' ELSE 'auto' END AS older_strategy, CASE WHEN size IS NULL OR size <= 0 THEN 20 WHEN size > 100 THEN 100 ELSE size END AS size FROM r""")
def request_check(spark, sf_dir):
    """What is wrong with requests, and what the older service would run them as."""
    r = store.kept(view(spark, sf_dir, REQUESTED), "requests")
    return requests.checked(r).select("query_id", F.array_join("errors", ",").alias("errors")).join(requests.older_plan(r).select("query_id", F.col("strategy").alias("older_strategy"), "size"), "query_id")


def address_index(spark, sf_dir):
    """The stored index of all addresses, an address once."""
    return index.stored(index.build(store.kept(documents(spark, sf_dir).dropDuplicates(["doc_id"]), "addresses")))


ADDRESS_FIELDS = ("full_address", "building_name", "road_name", "locality", "city_name", "district_name", "state_name", "pincode")


def _sql_retrieval(k: int = 100) -> str:
    """Every document of every clause scored, then the best of each query: no pruning, no fold but by grouping."""
    clean = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', '<na>') THEN trim({c}) END"
    saturated = lambda tf: f"{tf} / ({tf} + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))"
    cells = ", ".join(f"{{'field': '{f}', 'value': {f}}}" for f in ADDRESS_FIELDS)
    ways = sql_map(index.both_ways())
    queries = sql_clauses(SQL_STRATEGY)
    with_, asks = queries[: queries.rindex("SELECT query_id, CAST(grp")], queries[queries.rindex("SELECT query_id, CAST(grp") :]
    a = duck(ADDRESS)
    return f"""{with_.rstrip()}, asks AS ({asks}), addr AS ({a}), addr_f AS (SELECT *, {SQL_ADDRESS} AS full_address FROM addr), addr_h AS (SELECT *, {SQL_HASH} AS address_hash, {_sql_quality()} AS quality FROM addr_f),
doc AS MATERIALIZED (SELECT DISTINCT ON (address_hash) address_hash AS doc_id, quality, {", ".join(f"{clean(c)} AS {c}" for c in ADDRESS_FIELDS)} FROM addr_h),
cell AS (SELECT doc_id, unnest([{cells}]) AS c FROM doc), word AS (SELECT doc_id, c.field AS field, {sql_terms("c.value")} AS ts FROM cell),
pos AS (SELECT doc_id, field, len(ts) AS dl, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM word WHERE len(ts) > 0), ways AS (SELECT {ways} AS m),
syn AS (SELECT doc_id, field, dl, pos, unnest(list_concat([term], CASE WHEN m[term] IS NULL THEN [] ELSE string_split(m[term], ' ') END)) AS term FROM pos, ways),
post AS MATERIALIZED (SELECT field, term, doc_id, count(*) AS tf, list(pos) AS ps, any_value(dl) AS dl FROM syn GROUP BY ALL),
fld AS (SELECT field, count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM word WHERE len(ts) > 0 GROUP BY field),
voc AS MATERIALIZED (SELECT field, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avg_dl FROM (SELECT field, term, count(*) AS df FROM post GROUP BY ALL) JOIN fld USING (field)),
cl AS MATERIALIZED (SELECT *, row_number() OVER () AS id, {sql_terms("text")} AS ts FROM asks),
pl2 AS MATERIALIZED (SELECT id, kind, field, len(ts) AS n, unnest(ts) AS asked, unnest(range(len(ts))) AS place FROM cl WHERE len(ts) > 0),
forms AS (SELECT DISTINCT field, asked FROM pl2 WHERE kind = 'fuzzy'),
near AS MATERIALIZED (SELECT field, asked, term, 1 - levenshtein(asked, term)::DOUBLE / least(length(asked), length(term)) AS weight FROM forms JOIN voc USING (field) WHERE abs(length(asked) - length(term)) <= 2 AND levenshtein(asked, term) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END),
begun AS (SELECT DISTINCT p.field, asked, term FROM (SELECT DISTINCT field, asked FROM pl2 WHERE kind = 'prefix' AND place = n - 1) p JOIN voc v ON v.field = p.field AND starts_with(term, asked)),
wanted AS (SELECT id, kind, field, n, place, asked AS term, 1.0 AS weight FROM pl2 WHERE kind IN ('match', 'term') OR (kind = 'prefix' AND place < n - 1)
  UNION ALL SELECT id, kind, field, n, place, term, weight FROM pl2 JOIN near USING (field, asked) WHERE kind = 'fuzzy'
  UNION ALL SELECT id, kind, field, n, place, term, 1.0 FROM pl2 JOIN begun USING (field, asked) WHERE kind = 'prefix' AND place = n - 1),
hit1 AS (SELECT id, kind, n, place, doc_id, max(CASE kind WHEN 'prefix' THEN 1.0 WHEN 'term' THEN idf ELSE idf * {saturated("tf")} * weight END) AS s FROM wanted JOIN voc USING (field, term) JOIN post USING (field, term) GROUP BY ALL),
plain AS (SELECT id, doc_id, sum(s) AS s FROM hit1 GROUP BY id, kind, n, doc_id HAVING kind <> 'term' OR count(*) = n),
hit2 AS MATERIALIZED (SELECT id, n, place, doc_id, idf, avg_dl, dl, ps FROM pl2 p JOIN voc v ON v.field = p.field AND v.term = p.asked JOIN post o ON o.field = p.field AND o.term = p.asked WHERE kind = 'phrase'),
full2 AS (SELECT id, doc_id, n, sum(idf) AS i, any_value(dl) AS dl, any_value(avg_dl) AS avg_dl FROM hit2 GROUP BY id, doc_id, n HAVING count(*) = n),
places AS MATERIALIZED (SELECT id, doc_id, n, place, unnest(ps) - place AS x FROM hit2 SEMI JOIN full2 USING (id, doc_id)),
serves AS (SELECT DISTINCT id, doc_id, n, place, x - d AS x FROM places, (SELECT unnest([0, 1, 2]) AS d)),
runs AS (SELECT id, doc_id, x FROM serves SEMI JOIN places USING (id, doc_id, x) GROUP BY id, doc_id, x, n HAVING count(*) = n),
phr AS (SELECT id, doc_id, any_value(i) * {saturated("count(*)").replace("dl / avg_dl", "any_value(dl) / any_value(avg_dl)")} AS s FROM runs JOIN full2 USING (id, doc_id) GROUP BY id, doc_id),
sc AS (SELECT query_id, grp, must, doc_id, boost * s AS s, tie FROM (SELECT * FROM plain UNION ALL SELECT * FROM phr) JOIN cl USING (id)),
gr AS (SELECT query_id, doc_id, must, max(s) + max(tie) * (sum(s) - max(s)) AS s FROM sc GROUP BY query_id, doc_id, grp, must),
need AS (SELECT query_id, count(DISTINCT grp) AS needed FROM cl WHERE must GROUP BY query_id),
found AS (SELECT query_id, doc_id, s + CASE WHEN needed IS NULL THEN 1.0 ELSE 0.0 END AS s FROM (SELECT query_id, doc_id, sum(s) AS s, count(*) FILTER (must) AS met FROM gr GROUP BY query_id, doc_id) LEFT JOIN need USING (query_id) WHERE met >= coalesce(needed, 0)),
free AS (SELECT query_id, pincode FROM core WHERE query_id NOT IN (SELECT query_id FROM cl)), best AS (SELECT doc_id FROM doc ORDER BY quality DESC, doc_id LIMIT {k}),
alls AS (SELECT * FROM found UNION ALL SELECT query_id, doc_id, 1.0 FROM free, best WHERE pincode IS NULL UNION ALL SELECT query_id, d.doc_id, 1.0 FROM free JOIN doc d USING (pincode)),
fin AS (SELECT a.query_id, a.doc_id, round(s + 0.05 * quality, 6) AS score FROM alls a JOIN doc d USING (doc_id) JOIN core c USING (query_id) WHERE c.pincode IS NULL OR c.pincode = d.pincode)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fin) WHERE rank <= {k}"""


@query_of(_sql_retrieval())
def address_retrieval(spark, sf_dir):
    """Every asked query against the address index: the 100 best addresses by text and quality."""
    built_index = address_index(spark, sf_dir)
    distinct, same = service.once(asked(spark, sf_dir))
    plans = service.planned(distinct)
    return service.for_all(search.retrieve(plans, store.kept(strategy.clauses(plans), "clauses"), built_index, 100), same)


@query_of()
def address_search(spark, sf_dir):
    """Every asked query from text to ranked results: 100 candidates retrieved, placed by entity fit, text and quality."""
    built_index = address_index(spark, sf_dir)
    ranked = service.search_addresses(asked(spark, sf_dir), built_index, 100)
    return ranked.select("query_id", "doc_id", "place", "score", "confidence", "label", "explanation")


# --- Similarity and ranking -------------------------------------------------------------------------------------

PAIRS = "pr AS (SELECT x.p_partkey AS id, x.p_name AS a, y.p_name || CASE WHEN x.p_partkey % 5 = 0 THEN '' ELSE ' ' || x.p_brand END AS b FROM {part} x JOIN {part} y ON y.p_partkey = CASE WHEN x.p_partkey % 3 = 0 THEN x.p_partkey ELSE x.p_partkey % 50 + 1 END)"


def pairs(spark, sf_dir):
    return spread(spark.sql("WITH " + PAIRS + " SELECT * FROM pr", part=table(spark, sf_dir, "part")), "id")


_norm = lambda c: f"array_to_string({sql_words(c)}, ' ')"
_sorted = lambda c: f"array_to_string(list_sort({sql_words(c)}), ' ')"
PAIR_WORDS = "WITH " + duck(PAIRS) + f", w AS (SELECT id, a, b, {_norm('a')} AS x, {_norm('b')} AS y, {_sorted('a')} AS sx, {_sorted('b')} AS sy, {sql_words('a')} AS ta, {sql_words('b')} AS tb FROM pr) "


def _measure(name: str, function, sql: str) -> None:
    def run(spark, sf_dir):
        return pairs(spark, sf_dir).select("id", F.round(function(F.col("a"), F.col("b")).cast("double"), 6).alias("value"))

    query_of(PAIR_WORDS + f"SELECT id, round(CAST({sql} AS DOUBLE), 6) AS value FROM w", name)(run)


_both = "list_intersect(list_distinct(ta), list_distinct(tb))"
_measure("indel_ratio", S.ratio, sql_indel("x", "y"))
_measure("token_sort_ratio", S.token_sort_ratio, sql_indel("sx", "sy"))
_measure("common_token_count", S.common_tokens, f"len({_both})")
_measure("token_overlap", S.token_overlap, f"len({_both}) / len(list_distinct(ta))::DOUBLE")
_measure("jaccard", S.jaccard, f"len({_both}) / len(list_distinct(list_concat(ta, tb)))::DOUBLE")
_measure("exact_match", S.exact_match, "CASE WHEN x = y AND x <> '' THEN 1 ELSE 0 END")
_measure("prefix_affinity", S.prefix_affinity, "len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i])) / greatest(length(x), length(y))::DOUBLE")
_measure("partial_ratio", S.partial_ratio, "CASE WHEN contains(y, x) OR contains(x, y) THEN 1.0 ELSE list_max(list_transform(list_distinct(list_transform(range(2 - least(length(x), length(y)), greatest(length(x), length(y)) + 1), lambda i: substr(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CAST(greatest(i, 1) AS INT), CAST(least(i, 1) + least(length(x), length(y)) - 1 AS INT)))), lambda v: " + sql_indel("(CASE WHEN length(x) <= length(y) THEN x ELSE y END)", "v").replace("lambda x:", "lambda z:") + ")) END")
_set = "s AS (SELECT *, array_to_string(list_sort(list_intersect(list_distinct(ta), list_distinct(tb))), ' ') AS c, array_to_string(list_sort(list_filter(list_distinct(ta), lambda v: NOT list_contains(tb, v))), ' ') AS l, array_to_string(list_sort(list_filter(list_distinct(tb), lambda v: NOT list_contains(ta, v))), ' ') AS r FROM w), s2 AS (SELECT id, c, l, r, trim(c || ' ' || l) AS cl, trim(c || ' ' || r) AS cr FROM s)"


@query_of(PAIR_WORDS.rstrip() + f", {_set} SELECT id, round(CAST(CASE WHEN c <> '' AND (l = '' OR r = '') THEN 1.0 WHEN c = '' THEN {sql_indel('cl', 'cr')} ELSE greatest({sql_indel('cl', 'cr')}, {sql_indel('c', 'cl')}, {sql_indel('c', 'cr')}) END AS DOUBLE), 6) AS value FROM s2")
def token_set_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.round(S.token_set_ratio(F.col("a"), F.col("b")), 6).alias("value"))


@query_of(f"WITH {PLACES} SELECT x.id AS a, y.id AS b, round({sql_haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')}, 6) AS km FROM p x JOIN p y ON y.id = x.id % 50 + 1")
def haversine(spark, sf_dir):
    p = places(spark, sf_dir)
    other = p.select(F.col("doc_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(other, F.col("doc_id") % 50 + 1 == F.col("b")).select(F.col("doc_id").alias("a"), "b", F.round(S.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query_of(WITH + "x AS (SELECT 1) SELECT serial_number, (" + " + ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN 1 ELSE 0 END" for c in rank.TEXT_FIELDS if c not in ("office_name", "full_address")) + ") AS n FROM a")
def field_presence(spark, sf_dir):
    a = addresses(spark, sf_dir)
    return a.select("serial_number", rank.presence(a.columns).alias("n"))


FITTED = "fp AS (SELECT id, a AS locality, b AS city, CASE WHEN id % 2 = 0 THEN a ELSE b END AS building_name, CAST(110000 + id % 5 AS STRING) AS pincode, a || ', ' || b AS full_address, upper(a) AS c_locality, b AS c_city, a AS c_building, '110002' AS c_pincode FROM pr)"


def fitted(spark, sf_dir):
    df = spread(spark.sql("WITH " + PAIRS + ", " + FITTED + " SELECT * FROM fp", part=table(spark, sf_dir, "part")), "id")
    none = F.lit(None).cast("string")
    e = F.struct("locality", "city", "building_name", "pincode", none.alias("office_name"), none.alias("road_name"), none.alias("district"), none.alias("state"))
    return df.select("id", e.alias("entities"), F.col("c_locality").alias("locality"), F.col("c_city").alias("city_name"), F.col("c_building").alias("building_name"), F.col("c_pincode").alias("pincode"), "full_address")


@query_of()
def entity_fit(spark, sf_dir):
    """Entity fit of pairs (tested by example: its parts have their own SQL)."""
    return rank.with_entity_fit(fitted(spark, sf_dir)).select("id", F.round("entity_fit", 6).alias("fit"))


MIXED = """mx AS (SELECT id, CASE WHEN id % 2 = 0 THEN a END AS q_locality, CASE WHEN id % 3 = 0 THEN b END AS q_city, CASE WHEN id % 5 < 2 THEN a END AS q_building, CASE WHEN id % 7 < 2 THEN b END AS q_office,
 CASE WHEN id % 4 = 1 THEN a END AS q_road, CASE WHEN id % 11 < 6 THEN CAST(110000 + id % 5 AS STRING) END AS q_pincode, b AS locality, CASE WHEN id % 6 = 0 THEN b ELSE upper(a) END AS city_name, a AS district_name, b AS building_name,
 CASE WHEN id % 2 = 1 THEN a END AS office_name, b AS road_name, '110002' AS pincode, b || ', 110002' AS full_address, a, b FROM pr)"""


def sql_fit() -> str:
    """Entity fit of ``mx``: every text is a, b or the address, so three similarities are all there are (part names have no other spellings)."""
    both = lambda c, d: sql_indel(_norm(c), _norm(d)).replace("lambda x:", "lambda z:")
    begin = f"len(list_filter(range(1, least(length({_norm('a')}), length({_norm('b')})) + 1), lambda i: ({_norm('a')})[1:i] = ({_norm('b')})[1:i])) / greatest(length({_norm('a')}), length({_norm('b')}))::DOUBLE"
    return f"""WITH {duck(PAIRS)}, {MIXED}, r AS (SELECT *, {_norm('a')} = {_norm('b')} AS eq, {both('a', 'b')} AS ab, {both('a', 'full_address')} AS af, {both('b', 'full_address')} AS bf, {begin} AS pre FROM mx),
p AS (SELECT *, CASE WHEN q_locality IS NULL THEN 0 ELSE greatest(0.55 * ab + 0.45 * pre, CASE WHEN af >= 0.5 THEN 0.85 * af ELSE 0 END) END AS sim,
 CASE WHEN q_office IS NULL THEN 0 ELSE greatest(CASE WHEN office_name IS NULL THEN 0 ELSE ab END, 1.0, bf) END AS office,
 CASE WHEN q_city IS NULL THEN 0 WHEN id % 6 = 0 OR eq THEN 1.0 ELSE ab END AS city FROM r)
SELECT id, round(least(1.0, greatest(0.0, CAST(CASE WHEN q_locality IS NULL THEN 0 ELSE 0.60 * sim + CASE WHEN sim >= 0.88 THEN 0.15 ELSE 0 END END
 + CASE WHEN q_office IS NULL THEN 0 ELSE 0.55 * office + CASE WHEN office >= 0.85 THEN 0.15 ELSE 0 END END
 + CASE WHEN q_city IS NULL THEN 0 ELSE CASE WHEN q_locality IS NULL OR sim >= 0.72 THEN 0.35 ELSE 0.08 END * city END
 + CASE WHEN q_building IS NULL THEN 0 ELSE 0.25 * greatest(ab, af) END + CASE WHEN q_pincode = pincode THEN 0.25 ELSE 0 END
 + CASE WHEN q_road IS NULL THEN 0 ELSE 0.15 * greatest(ab, af) END AS DOUBLE))), 6) AS fit FROM p"""


@query_of(sql_fit())
def entity_fit_mixed(spark, sf_dir):
    """Entity fit where queries have some of the entities, of candidates that differ from them."""
    df = spread(spark.sql("WITH " + PAIRS + ", " + MIXED + " SELECT * FROM mx", part=table(spark, sf_dir, "part")), "id")
    none = F.lit(None).cast("string")
    named = {"locality": "q_locality", "city": "q_city", "building_name": "q_building", "office_name": "q_office", "road_name": "q_road", "pincode": "q_pincode"}
    e = F.struct(*[F.col(c).alias(k) for k, c in named.items()], none.alias("district"), none.alias("state"))
    return rank.with_entity_fit(df.select("id", e.alias("entities"), "locality", "city_name", "district_name", "building_name", "office_name", "road_name", "pincode", "full_address")).select("id", F.round("entity_fit", 6).alias("fit"))


@query_of("WITH " + duck(PAIRS) + ", " + FITTED + f" SELECT id, (CASE WHEN {_norm('building_name')} = {_norm('c_building')} THEN 1 ELSE 0 END + CASE WHEN {_norm('locality')} = {_norm('c_locality')} THEN 1 ELSE 0 END + CASE WHEN {_norm('city')} = {_norm('c_city')} THEN 1 ELSE 0 END + CASE WHEN pincode = c_pincode THEN 1 ELSE 0 END) AS n FROM fp")
def exact_match_count(spark, sf_dir):
    df = fitted(spark, sf_dir)
    return df.select("id", rank.exact_count(F.col("entities"), df.columns).alias("n"))


@query_of("WITH " + duck(PAIRS) + ", " + FITTED + " SELECT id, 'matched: ' || CASE WHEN s = '' THEN 'none' ELSE s END || '; confidence: ' || CASE WHEN id % 100 >= 80 THEN 'high' WHEN id % 100 >= 60 THEN 'medium' ELSE 'low' END AS explanation FROM (SELECT id, concat_ws(', ', CASE WHEN lower(trim(building_name)) = lower(trim(c_building)) THEN 'building_name' END, CASE WHEN lower(trim(locality)) = lower(trim(c_locality)) THEN 'locality' END, CASE WHEN lower(trim(city)) = lower(trim(c_city)) THEN 'city' END, CASE WHEN pincode = c_pincode THEN 'pincode' END) AS s FROM fp)")
def explanation(spark, sf_dir):
    df = fitted(spark, sf_dir)
    return df.select("id", rank.explanation(F.col("entities"), df.columns, F.col("id") % 100 / 100.0).alias("explanation"))


SQL_PARTS = "0.10 * CASE WHEN o_totalprice <= 0 THEN 0 ELSE (o_totalprice / 10000) / (o_totalprice / 10000 + 5.0) END + 0.20 * least(1.0, (o_orderkey % 4) / 2.0) + 0.55 * ((o_custkey % 100) / 100.0::DOUBLE) + 0.15 * ((o_orderkey % 90) / 100.0::DOUBLE)"


@query_of(f"SELECT o_orderkey, score, confidence, CASE WHEN confidence > 0.95 THEN 'exact_match' WHEN confidence >= 0.80 THEN 'high' WHEN confidence >= 0.60 THEN 'medium' ELSE 'low' END AS label FROM (SELECT o_orderkey, round_even(least(greatest({SQL_PARTS}, 0), 1), 6) AS score, round_even(least(greatest({SQL_PARTS}, 0), 0.99), 4) AS confidence FROM orders)")
def score_confidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = rank.combined(F.col("o_totalprice") / 10000, F.col("o_orderkey") % 4, (F.col("o_custkey") % 100) / 100.0, (F.col("o_orderkey") % 90).cast("double"))
    out = o.select("o_orderkey", rank.score(parts).alias("s"), rank.confidence(parts).alias("c"))
    return out.select("o_orderkey", F.col("s").alias("score"), F.col("c").alias("confidence"), rank.label(F.col("c")).alias("label"))


@query_of()
def ranking_features(spark, sf_dir):
    """The 77 features of (query, candidate) pairs."""
    df = fitted(spark, sf_dir).withColumns({"text": F.col("full_address"), "bm25_score": F.lit(3.0), "rank": F.lit(1), "retrieval_position": F.lit(1), "quality_score": F.lit(80.0)})
    for c in ("road_name", "district_name", "state_name"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return rank.features(df).select("id", *[f"`{c}`" for c in rank.feature_names()])


GROUPS = "WITH g AS (SELECT l.doc_id // 200 AS grp, quality AS label, n_chars AS score, l.doc_id AS tie FROM labels l JOIN documents USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, tie) AS p, row_number() OVER (PARTITION BY grp ORDER BY label DESC, tie) AS i FROM g) "


def groups(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.select(F.floor(F.col("doc_id") / 200).alias("group"), F.col("quality").alias("label"), F.col("n_chars").alias("score"), F.col("doc_id").alias("tie"))


def text_features(spark, sf_dir):
    """(group, rank, doc_id, label, features): labelled documents by what their texts look like."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("quality is not null")
    share = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest(F.length("text"), F.lit(1))
    seen = both.select(F.floor(F.col("doc_id") / 20).alias("group"), F.lit(1).alias("rank"), "doc_id", F.col("quality").cast("int").alias("label"),
                       F.log1p(F.length("text").cast("double")).alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), share(r"[^\p{L}\p{N}\s]").alias("symbols"), share(r"\s").alias("spaces"))
    return seen, ["length", "digits", "capitals", "symbols", "spaces"]


@query_of()
def trained_ranking(spark, sf_dir):
    """Labelled documents in groups, ordered by a ranker that was trained on four fifths of the groups, saved and loaded again."""
    rows, names = text_features(spark, sf_dir)
    rows = store.kept(learn.split(rows, group="group"), "features")
    path = f"{store.shared_folder(spark)}/placewright-ranker-{uuid.uuid4().hex}"
    learn.Bundle.of(learn.fit(rows.where("not validation"), names, "group"), names).save(spark, path)
    scored_rows = learn.Bundle.load(spark, path).score(rows)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.col("model_score").desc(), "doc_id"))
    return scored_rows.select("group", "doc_id", "label", "validation", F.round("model_score", 6).alias("model_score"), place.alias("place"))


@query_of()
def boosted_ranking(spark, sf_dir):
    """The same documents and groups by ten boosted trees, trained, saved and loaded again."""
    rows, names = text_features(spark, sf_dir)
    rows = store.kept(learn.split(rows, group="group"), "features")
    path = f"{store.shared_folder(spark)}/placewright-forest-{uuid.uuid4().hex}"
    trees.fit(rows.where("not validation"), names, "group", trees=10).save(spark, path)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.col("model_score").desc(), "doc_id"))
    scored_rows = trees.Forest.load(spark, path).score(rows)
    return scored_rows.select("group", "doc_id", "label", "validation", F.round("model_score", 6).alias("model_score"), place.alias("place"))


_dcg = lambda c: f"sum(CASE WHEN {c} <= 10 THEN (pow(2, label) - 1) / log2({c} + 1) ELSE 0 END)"
SQL_METRICS = {
    "ndcg_10": f"round({_dcg('p')} / CASE WHEN {_dcg('i')} = 0 THEN 1 ELSE {_dcg('i')} END, 6)",
    "mrr": "round(coalesce(1.0::DOUBLE / min(p) FILTER (label > 0), 0), 6)",
    "precision_10": "round(count(*) FILTER (label > 0 AND p <= 10) / least(10, count(*))::DOUBLE, 6)",
    "recall_100": "round(coalesce(count(*) FILTER (label > 0 AND p <= 100) / nullif(count(*) FILTER (label > 0), 0)::DOUBLE, 0), 6)",
    "top1": "CASE WHEN count(*) FILTER (label > 0 AND p <= 1) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "top5": "CASE WHEN count(*) FILTER (label > 0 AND p <= 5) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
}
for _name, _sql in SQL_METRICS.items():

    def _metric(spark, sf_dir, name=_name):
        return metrics.evaluate(groups(spark, sf_dir), "tie").select("group", name)

    query_of(GROUPS + f'SELECT grp AS "group", {_sql} AS {_name} FROM o GROUP BY grp', f"metric_{_name}")(_metric)


@query_of(GROUPS.rstrip() + ", per AS (SELECT grp, " + ", ".join(f"{s} AS {k}" for k, s in SQL_METRICS.items()) + " FROM o GROUP BY grp HAVING max(label) > 0) SELECT " + ", ".join(f"round(avg({k}), 6) AS {k}" for k in SQL_METRICS) + " FROM per")
def metric_overall(spark, sf_dir):
    return metrics.overall(groups(spark, sf_dir), "tie")


@query_of("WITH " + duck(HITS) + ", l AS (SELECT query_id, doc_id, rank, CASE WHEN doc_id = query_id * 100 + 7 THEN 1 ELSE 0 END AS label FROM ranked), f AS (SELECT DISTINCT query_id FROM l WHERE label = 1) SELECT query_id, doc_id, rank, label FROM (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, rank, doc_id) AS n FROM l JOIN f USING (query_id)) WHERE n <= 40")
def pair_labels(spark, sf_dir):
    h = hits(spark, sf_dir)
    gold = h.select("query_id").distinct().withColumn("gold_id", F.col("query_id") * 100 + 7)
    return learn.label_pairs(gold, h)


@query_of()
def synthetic_queries(spark, sf_dir):
    """Queries made from addresses, the same in every run."""
    return learn.synthetic_queries(documents(spark, sf_dir).select("doc_id", "full_address", "pincode").dropDuplicates(["doc_id"]))


@query_of()
def group_split(spark, sf_dir):
    return learn.split(hits(spark, sf_dir).select("query_id", "doc_id"))
