"""One query per operation, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contamination, fingerprint, mixing, near_dedup, packing, passage_dedup, quality, repair, secrets, suffix_dedup, toxicity, vector_codes
from .store import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether the crc32 of the id as text is a multiple of 5; false for rows without id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand, perhaps edited, in two documents."""
    return passage_dedup.passages(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels").where(~held_out())), 3)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.expected_grade().alias("expected_grade"), F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_best"), quality.selected().alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.groups(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
pre AS (SELECT doc_id, s, n FROM (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM sh JOIN n USING (doc_id) JOIN df USING (s)) WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM pre x JOIN pre y ON x.s = y.s AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
link AS (SELECT a, b FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; ``near`` lists the items whose rarest terms stand within 32 words of each other."""
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=32)
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), contamination.contaminated().alias("contaminated"), F.concat_ws(",", "near").alias("near"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    examples = chat.expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").alias("chars"),
        chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("trained"),
        F.when(F.col("closing"), chat.read_turns(F.col("formatted"))).alias("turns"),
    )
    by_conv = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), "").alias("trained")
    )
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return by_conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
           + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + CASE WHEN role = 'user' THEN 14 ELSE 8 END AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.named(F.col("base")), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


def _op8_located(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop, m FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)::BIGINT)) AS s, unnest(ms) AS m, unnest(g2) AS g
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {2 if kind == "assign" else 0}) AS g2, regexp_split_to_array(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}'))) WHERE {keep}"""


#: What the SQL leaves alone, stated for itself: no digits, no letters, a UUID, a placeholder, words joined to a slug whose last piece is no key.
_ALLOWED_SQL = r"""
  NOT regexp_matches(m, '[0-9]') OR NOT regexp_matches(m, '[A-Za-z]')
  OR (length(m) = 36 AND list_transform(string_split(m, '-'), lambda p: CASE WHEN regexp_full_match(p, '[0-9A-Fa-f]+') THEN length(p) END) = [8, 4, 4, 4, 12])
  OR contains(lower(m), 'example') OR contains(lower(m), 'placeholder') OR contains(lower(m), 'xxxxxx')
  OR (len(pieces) > 1 AND len(list_filter(pieces[:-2], lambda p: NOT regexp_full_match(p, '[a-z]+'))) = 0 AND regexp_full_match(pieces[-1], '[a-z0-9]+')
      AND (regexp_full_match(pieces[-1], '[a-z]+|[0-9]+') OR length(pieces[-1]) < 10))
"""


def _class_sql(k: int) -> str:
    """The rank or the bits of a candidate's class."""
    return "CASE " + " ".join(f"WHEN regexp_matches(m, '{c[1]}') THEN {c[k]}" for c in secrets.CLASSES) + " END"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_op8_located("assign", 0, secrets.ASSIGN, "length(g) >= 6")} UNION ALL {_op8_located("access", 1, secrets.ACCESS)} UNION ALL {_op8_located("hex", 2, secrets.HEX)}),
cand AS (SELECT *, {_class_sql(0)} AS rank2, {_class_sql(2)} AS bits FROM (SELECT *, string_split(replace(replace(CASE WHEN ends_with(n, '/') THEN n[:-2] ELSE n END, '_', '/'), '-', '/'), '/') AS pieces
  FROM (SELECT *, CASE WHEN starts_with(m, '/') THEN m[2:] ELSE m END AS n FROM ({_op8_located("candidate", 9, secrets.CANDIDATE)}))) WHERE NOT coalesce({_ALLOWED_SQL}, false)),
win AS (SELECT doc_id, start, rank2, bits, m, unnest(range(0, length(m) - {secrets.WINDOW - 1})) AS b FROM cand),
chars AS (SELECT doc_id, start, rank2, bits, b, unnest(string_split(substr(m, b + 1, {secrets.WINDOW}), '')) AS c FROM win),
counts AS (SELECT doc_id, start, rank2, bits, b, c, count(*) AS n FROM chars GROUP BY ALL),
passing AS (SELECT doc_id, start, rank2, bits, b FROM counts GROUP BY ALL HAVING log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} >= bits),
runs AS (SELECT *, sum(CASE WHEN b <= prev + {secrets.WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, start ORDER BY b) AS run FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id, start ORDER BY b) AS prev FROM passing)),
entropy AS (SELECT doc_id, rank2 AS rank, list_extract({list(secrets.KINDS)}, rank2 + 1) AS kind, start + min(b) AS s, start + max(b) + {secrets.WINDOW} AS e FROM runs GROUP BY doc_id, start, rank2, run),
added AS (SELECT * FROM entropy x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start <= x.s AND x.e <= b.stop)),
every AS (SELECT doc_id, rank, kind, start AS s, stop AS e FROM base UNION ALL SELECT doc_id, rank, kind, s, e FROM added),
texts AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base_spans,
  count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = suffix_dedup.distinct_texts(docs)
    digests = texts.select("text_key", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("repeated"))
    return docs.select("doc_id", suffix_dedup.text_key().alias("text_key")).join(digests, "text_key").drop("text_key")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of conversations damaged by rule: rows dropped, emptied, cut off, repeated, or said by the user."""
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = every.withColumn("damage", damage).where("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
    found = repair.summaries(repair.edits(damaged)).withColumnRenamed("conv_id", "own")
    all_ids = every.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return joined.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op11_sql() -> str:
    """The same by list folds: states 1 to 4 are nothing, system, user and assistant read; p holds each row's letters from the last row on."""
    keep = {1: "CASE r.c WHEN 's' THEN v[2] WHEN 'u' THEN v[3] END", 2: "CASE r.c WHEN 'u' THEN v[3] END", 3: "CASE r.c WHEN 'a' THEN v[4] END", 4: "CASE r.c WHEN 'u' THEN v[3] END"}
    after = {1: 3, 2: 3, 3: 4, 4: 3}
    d = {q: f"2 + v[{q}]" for q in after}
    k = {q: f"coalesce(CASE WHEN r.stays THEN r.cut + {keep[q]} END, 1000000000)" for q in after}
    re = {q: f"CASE WHEN r.stays THEN r.cut + 1 + v[{after[q]}] ELSE 1000000000 END" for q in after}
    base = "[" + ", ".join(f"least({d[q]}, {k[q]}, {re[q]})" for q in after) + "]"
    third, fourth = "least(b[3], 5 + b[4])", "least(b[4], 5 + b[3])"
    costs = f"[least(b[1], 5 + {third}), least(b[2], 5 + {third}), {third}, {fourth}]"
    letters = " || ".join(f"CASE WHEN {d[q]} = n[{q}] THEN 'D' WHEN 5 + n[{after[q]}] = n[{q}] THEN 'I' WHEN {k[q]} = n[{q}] THEN 'K' ELSE 'R' END" for q in after)
    back = f"list_transform([s.v], lambda v: list_transform([{base}], lambda b: list_transform([{costs}], lambda n: {{'v': list_transform(n, lambda x: x - n[1]), 'p': list_append(s.p, {letters})}})[1])[1])[1]"
    named = lambda q: f"CASE WHEN {q} = 3 THEN 'assistant' ELSE 'user' END"
    step = f"""list_transform([ls[i][s.q]], lambda first: list_transform([CASE WHEN first = 'I' THEN [3, 3, 4, 3][s.q] ELSE s.q END], lambda q: list_transform([ls[i][q]], lambda l: {{
      'q': CASE l WHEN 'D' THEN q WHEN 'R' THEN [3, 3, 4, 3][q] ELSE CASE rows[i].c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END END,
      'audit': s.audit || CASE WHEN first = 'I' THEN 'I' ELSE '' END || l, 'cost': s.cost + CASE WHEN first = 'I' THEN 5 ELSE 0 END + CASE l WHEN 'D' THEN 2 WHEN 'R' THEN 1 + rows[i].cut ELSE rows[i].cut END,
      'said': list_concat(s.said, list_concat(CASE WHEN first = 'I' THEN [{named("s.q")} || ':'] ELSE [] END, CASE l WHEN 'D' THEN [] WHEN 'R' THEN [{named("q")} || ':' || rows[i].text] ELSE [rows[i].role || ':' || rows[i].text] END))}})[1])[1])[1]"""
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
hit AS (SELECT *, xor(list_reduce(key, lambda c, ch: xor(c >> 8, tab[(xor(c, ascii(ch)) & 255) + 1]), 4294967295), 4294967295) % 20 AS damage FROM raw, crc),
dam AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS time FROM hit WHERE damage <> 0),
mark AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM dam),
flt AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS before FROM mark),
conv AS (SELECT conv_id, list({{'c': c, 'role': role, 'text': text, 'stays': fault NOT IN ('blank', 'duplicate'), 'cut': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} ORDER BY turn NULLS FIRST, role, text, seen) AS rows,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id),
back AS (SELECT *, list_reverse(list_reduce(list_reverse(rows), lambda s, r: {back}, {{'v': [0, 10, 5, 0]::INTEGER[], 'p': []::VARCHAR[]}}).p) AS ls FROM conv),
fore AS (SELECT *, list_reduce(range(1, len(rows) + 1), lambda s, i: {step}, {{'q': 1, 'audit': '', 'cost': 0, 'said': []::VARCHAR[]}}) AS e FROM back),
done AS (SELECT *, CASE e.q WHEN 2 THEN ['user:', 'assistant:'] WHEN 3 THEN ['assistant:'] ELSE []::VARCHAR[] END AS closing FROM fore)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.cost + 5 * len(closing), 0)::BIGINT AS cost, coalesce(e.audit || repeat('I', len(closing)), '') AS audit, sha256(coalesce(array_to_string(list_concat(e.said, closing), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN done ON i.conv_id IS NOT DISTINCT FROM done.conv_id
"""


OP11_SQL = _op11_sql()


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of weights 5, 2, 1 takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and what they lose."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = kept(vector_codes.encode(vectors, books), "codes")
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """The same by plain comparison with all entries, a round at a time."""
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT id, part, entry, d FROM (SELECT id, part, entry, d, row_number() OVER (PARTITION BY id, part ORDER BY d, entry) AS r FROM (
      SELECT id, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{k} USING (part, pos) GROUP BY id, part, entry)) WHERE r = 1)"""  # noqa: E731
    new = lambda k: f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
      SELECT part, entry, pos, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM x JOIN a{k} USING (id, part) GROUP BY ALL) USING (part, entry, pos))"""  # noqa: E731
    rounds = ", ".join(f"{near(k)}, {new(k)}" for k in range(6))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS pos, CAST(floor(4096 * embedding[i]::DOUBLE) AS BIGINT) AS x FROM (SELECT id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x AS c FROM x WHERE id <= 16), {rounds}, {near(6)},
e AS (SELECT id, string_agg('0' || lower(hex(entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY id),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS s FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM v JOIN e USING (id), h
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_passages, op2_quality, op3_near_dedup, op4_fingerprint, op5_toxicity, op6_decontamination, op7_chat, op8_secrets, op9_packing, op10_suffix_dedup, op11_repair, op12_mixing, op13_vector_codes)}
ORACLES: dict[str, str] = {"op3_near_dedup": OP3_SQL, "op7_chat": OP7_SQL, "op8_secrets": OP8_SQL, "op11_repair": OP11_SQL, "op13_vector_codes": OP13_SQL}
