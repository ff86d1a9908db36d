"""Retrieval: clauses of many queries at once against the index tables.

A query's clauses are rows. Their terms join the postings on (field, term), so
a batch of queries and a single one are the same plan, and only the postings of
asked terms move. Scores are BM25 (k1 1.2, b 0.75) with exact lengths.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from . import parts, places
from .index import K1, B, Index
from .store import kept

#: Letters of a beginning by which terms are found; longer ones are compared.
FENCE = 4
#: Documents that come together for each query that asks the same.
BUNDLE = 256


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avg_dl))


def bm25(queries: DataFrame, index: Index, field: str, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query's distinct terms in one field."""
    asked = queries.select("query_id", F.explode(F.array_distinct(X.analyze(F.col("text")))).alias("term"))
    # The postings of asked terms, written once: their number is a term's df, and a document's hits lie together.
    wanted = asked.select("term").distinct()
    own = kept(index.postings.where(F.col("field") == field).select("term", "doc_id", "tf", "dl").join(wanted, "term", "left_semi"), "asked")
    stats = index.fields.where(F.col("field") == field).select("n_docs", "avg_dl")
    df = own.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    known = kept(asked.join(df, "term").select("query_id", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_dl"), "known")
    total = known.join(own, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))), 6).alias("score"))
    return top(total, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by document."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def edits(term: Column) -> Column:
    """Edits that fuzziness allows: none up to 2 characters, one up to 5, else two."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def pieces(term: Column, most: int) -> Column:
    """A term cut into most + 1 pieces of even length, each with the term's length and its place."""
    n, parts = F.length(term), most + 1
    begin = lambda i: F.floor(F.lit(i) * n / parts).cast("int")
    return F.array(*[F.concat_ws(":", F.lit(parts), n, F.lit(i), F.substr(term, begin(i) + 1, begin(i + 1) - begin(i))) for i in range(parts)])


def near_pieces(term: Column, most: int) -> Column:
    """The pieces that a term within ``most`` edits may have: for each length, each piece's text as it stands here, moved by the edits at most."""
    n, parts = F.length(term), most + 1
    moves = F.sequence(F.lit(-most), F.lit(most))

    def piece(length: Column, i: Column) -> Column:
        begin = F.floor(i * length / parts).cast("int")
        size = F.floor((i + 1) * length / parts).cast("int") - begin
        here = F.filter(F.transform(moves, lambda m: begin + m), lambda at: (at >= 0) & (at + size <= n))
        return F.transform(here, lambda at: F.concat_ws(":", F.lit(parts), length, i, F.substr(term, at + 1, size)))

    lengths = F.filter(F.transform(moves, lambda m: n + m), lambda x: x >= 1)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: piece(x, i))))))


def fuzzy_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, asked_term, term, weight): vocabulary terms within the allowed edits.

    Of a word cut into k + 1 pieces one is whole in every word within k edits, at
    most k places away. So this is an equi-join on (length, piece): five rows for
    a vocabulary term at most, whatever its length, and a bounded number for an
    asked one; then an exact distance.
    """
    none = F.expr("cast(array() as array<string>)")
    whole = lambda c: F.array(F.concat(F.lit("0:"), F.col(c)))
    n = F.length("asked_term")
    forms = F.when(n <= 2, whole("asked_term")).when(n <= 5, near_pieces(F.col("asked_term"), 1)).otherwise(near_pieces(F.col("asked_term"), 2))
    a = asked.select("field", F.col("term").alias("asked_term")).distinct().withColumn("form", F.explode(forms))
    m = F.length("term")
    # Terms of 2 characters or fewer are asked whole, of up to 5 with one edit, longer ones with two.
    own = F.concat(F.when(m <= 2, whole("term")).otherwise(none), F.when((m >= 2) & (m <= 6), pieces(F.col("term"), 1)).otherwise(none), F.when(m >= 4, pieces(F.col("term"), 2)).otherwise(none))
    v = vocabulary.select("field", "term").withColumn("form", F.explode(own))
    d = F.levenshtein("asked_term", "term")
    near = a.join(v, ["field", "form"]).select("field", "asked_term", "term").distinct().where(d <= edits(F.col("asked_term")))
    return near.withColumn("weight", 1 - d / F.least(F.length("asked_term"), F.length("term")))


def phrase_frequency(places: Column, slop: Column | int) -> Column:
    """How often terms stand in order: ``places`` holds for each term its positions less its place in the phrase."""
    every = F.array_distinct(F.flatten(places))
    # A term at x serves every phrase that begins at x or up to slop places before: the starts that all terms serve, by hashing.
    return F.size(F.aggregate(places, every, lambda begins, p: F.array_intersect(begins, F.flatten(F.transform(p, lambda x: F.sequence(x - slop, x))))))


KEY = ["query_id", "clause_id", "grp", "must", "kind", "field", "boost", "tie", "n_places"]


def asked_terms(clauses: DataFrame, index: Index, kinds: Collection[str] = ("match", "term", "phrase", "fuzzy", "prefix")) -> DataFrame:
    """The terms that clauses ask for, expanded, with the statistics of each: ``KEY``, place, term, weight, idf, avg_dl.

    A clause: query_id, clause_id, its group (whose fields compete), whether the
    group must match, how its text is matched, where, and its weight. ``kinds``
    are those that occur; the vocabulary is not cut up for others.
    """
    terms = clauses.withColumn("terms", X.analyze(F.col("text"))).where(F.size("terms") > 0)
    asked = terms.select(*KEY[:-1], F.size("terms").alias("n_places"), F.posexplode("terms").alias("place", "asked_term"))
    exact = asked.withColumnRenamed("asked_term", "term").withColumn("weight", F.lit(1.0))
    last = F.col("place") == F.col("n_places") - 1
    parts = [exact.where(F.col("kind").isin("match", "term", "phrase") | ((F.col("kind") == "prefix") & ~last))]
    if "fuzzy" in kinds:
        wide = asked.where("kind = 'fuzzy'")
        parts.append(wide.join(fuzzy_terms(wide.select("field", F.col("asked_term").alias("term")), index.terms), ["field", "asked_term"]).drop("asked_term"))
    if "prefix" in kinds:
        begun = asked.where("kind = 'prefix'").where(last)
        starts = prefix_terms(begun.select("field", "asked_term"), index.terms)
        parts.append(begun.join(starts, ["field", "asked_term"]).drop("asked_term").withColumn("weight", F.lit(1.0)))
    found = reduce(DataFrame.unionByName, parts)
    known = found.join(index.terms, ["field", "term"]).join(F.broadcast(index.fields), "field")  # a row for each field
    return known.select(*KEY, "place", "term", "weight", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_dl")


def prefix_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, asked_term, term): vocabulary terms that begin with an asked one, of any length.

    Terms meet by the first letters of the asked one: all of them up to ``FENCE``,
    then those, so a term stands ``FENCE`` times at most, whatever its length.
    """
    a = asked.distinct().withColumn("begin", F.substring("asked_term", 1, FENCE))
    v = vocabulary.select("field", "term", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(FENCE), F.length("term"))), lambda n: F.substring("term", 1, n))).alias("begin"))
    return a.join(v, ["field", "begin"]).where(F.col("term").startswith(F.col("asked_term"))).select("field", "asked_term", "term")


def scored_clauses(spots: DataFrame, index: Index, slop: int, kinds: Collection[str], on: list[str]) -> DataFrame:
    """(query_id, clause_id, grp, must, field, doc_id, score, tie) of asked terms, whose postings are found by the columns ``on``."""
    key = [*KEY, "doc_id"]

    def hits(kind: Column, *columns: str | Column) -> DataFrame:
        """Postings of terms; what follows groups by query and document, so rows move once."""
        return spots.where(kind).join(index.postings, on).select(*key, "place", *columns).repartition("query_id", "doc_id")

    one = F.when(F.col("kind") == "prefix", 1.0).otherwise(F.col("idf") * F.when(F.col("kind") == "term", 1.0).otherwise(saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))) * F.col("weight"))
    # The best expansion of each asked term counts.
    out = lambda df: df.select("query_id", "clause_id", "grp", "must", "field", "doc_id", (F.col("boost") * F.col("s")).alias("score"), "tie")
    every = F.col("kind").isin("term", "phrase") & ((F.col("kind") == "phrase") | (F.col("n_places") > 1))
    each = hits(~every, one.alias("s")).groupBy(*key, "place").agg(F.max("s").alias("s"))
    texts = each.groupBy(*key).agg(F.sum("s").alias("s"))
    if not {"term", "phrase"} & set(kinds):
        return out(texts)
    # Where all terms have to be there, only documents of the rarest are looked up in the others.
    asked = rarest_first(spots.where(every), on)
    own = [c for c in on if c not in KEY and c != "term"]
    meet = kept(asked.where("nth = 1").join(index.postings.select(*on, "doc_id"), on).select(*KEY, *own, "doc_id"), "met")
    at = F.when(F.col("kind") == "phrase", F.transform("positions", lambda p: p - F.col("place")))
    placed = meet.join(asked, [*KEY, *own]).join(index.postings, [*on, "doc_id"]).select(*key, "idf", "dl", "avg_dl", at.alias("at"))
    whole = placed.groupBy(*key).agg(F.sum("idf").alias("i"), F.count("*").alias("matched"), F.collect_list("at").alias("places"), F.first("dl").alias("dl"), F.first("avg_dl").alias("avg_dl")).where("matched = n_places")
    runs = whole.withColumn("freq", F.when(F.col("kind") == "phrase", phrase_frequency(F.col("places"), slop))).where("kind = 'term' or freq > 0")
    runs = runs.withColumn("s", F.when(F.col("kind") == "term", F.col("i")).otherwise(F.col("i") * saturation(F.col("freq"), F.col("dl"), F.col("avg_dl"))))
    return out(runs) if set(kinds) == {"phrase"} else out(texts).unionByName(out(runs))


def rarest_first(spots: DataFrame, on: list[str]) -> DataFrame:
    """Terms of clauses all of whose terms are known, numbered (``nth``) from the rarest on: only its documents can hold them all."""
    whole = Window.partitionBy(*KEY, *[c for c in on if c not in KEY and c != "term"])
    numbered = spots.withColumns({"known": F.count("*").over(whole), "nth": F.row_number().over(whole.orderBy(F.col("idf").desc(), "place"))})
    return kept(numbered.where("known = n_places").drop("known"), "phrases")


def clause_scores(clauses: DataFrame, index: Index, slop: int = 2, kinds: Collection[str] = ("match", "term", "phrase", "fuzzy", "prefix")) -> DataFrame:
    """(query_id, clause_id, grp, must, field, doc_id, score, tie) of clause rows (see ``asked_terms``), over all their postings.

    What several clauses ask is scored once and then dealt out to them: a join of
    what is scored with the clauses, without any further grouping. What many ask is
    cut by document into parts and by query into blocks, so that no task holds all
    of its rows. They come a bundle of documents at a time, the same for one query
    after the other: there may be very many rows, and a file of rows that go on so
    is a small part of them, whereas long lists of queries are not.
    """
    what = ["kind", "field", "boost", "text"]
    share = lambda most, size: F.least(F.lit(most), F.ceil(F.count("*") / size)).cast("int")
    asks = kept(clauses.where("text is not null").groupBy(*what).agg(share(8, 64).alias("parts"), share(16, 512).alias("blocks")).withColumn("ask", F.monotonically_increasing_id()), "asks")
    once = asks.select(F.col("ask").alias("query_id"), F.col("blocks").alias("clause_id"), F.col("parts").alias("grp"), F.lit(False).alias("must"), *what, F.lit(0.0).alias("tie"))
    scored = scored_clauses(asked_terms(once, index, kinds), index, slop, kinds, ["field", "term"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    scored = scored.select(F.col("query_id").alias("ask"), F.pmod(F.xxhash64("doc_id"), "grp").cast("int").alias("part"), each("clause_id").alias("block"), "doc_id", "score")
    cell = ["ask", "part", "block"]
    block = F.pmod(F.xxhash64("query_id", "clause_id"), "blocks").cast("int").alias("block")
    askers = clauses.join(asks, what).select("ask", block, each("parts").alias("part"), "query_id", "clause_id", "grp", "must", "field", "tie")
    # As many tasks as there are partitions, since few rows here may be very many there.
    dealt = scored.repartition(int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id")) - 1
    bundles = dealt.withColumn("bundle", F.floor(nth / BUNDLE)).groupBy(*cell, "bundle").agg(F.collect_list(F.struct("doc_id", "score")).alias("docs"))
    met = bundles.hint("merge").join(askers, cell).withColumn("d", F.explode("docs"))
    return met.select("query_id", "clause_id", "grp", "must", "field", "d.doc_id", "d.score", "tie")


def combined(scored: DataFrame, clauses: DataFrame, what: str) -> DataFrame:
    """(query_id, ``what``, text_score) of scored clauses: a group's best field counts, the others with ``tie``; every group that must match has to."""
    groups = scored.groupBy("query_id", what, "grp", "must").agg((F.max("score") + F.max("tie") * (F.sum("score") - F.max("score"))).alias("s"))
    needed = clauses.where("must").groupBy("query_id").agg(F.countDistinct("grp").alias("needed"))
    docs = groups.groupBy("query_id", what).agg(F.sum("s").alias("text_score"), F.count_if("must").alias("met"))
    docs = docs.join(needed, "query_id", "left").where(F.col("met") >= F.coalesce("needed", F.lit(0)))
    return docs.select("query_id", what, (F.col("text_score") + F.when(F.col("needed").isNull(), 1.0).otherwise(0.0)).alias("text_score"))


def range_bounds(spots: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query_id, range, text_score): no document of the range scores more for the query; ranges in which none can match are left out.

    ``spots`` are asked terms with the ranges that hold them and the greatest
    saturation there. A phrase stands no more often than its rarest term.
    """
    most = F.when(F.col("kind") == "prefix", 1.0).when(F.col("kind") == "term", F.col("idf")).otherwise(F.col("idf") * F.col("top") * F.col("weight"))
    each = spots.groupBy(*KEY, "range", "place").agg(F.max(most).alias("s"), F.max("idf").alias("idf"), F.max("top").alias("top"))
    whole = each.groupBy(*KEY, "range").agg(F.sum("s").alias("s"), F.sum("idf").alias("i"), F.min("top").alias("least"), F.count("*").alias("matched")).where("kind not in ('term', 'phrase') or matched = n_places")
    score = F.col("boost") * F.when(F.col("kind") == "phrase", F.col("i") * F.col("least")).otherwise(F.col("s"))
    return combined(whole.select("query_id", "grp", "must", "range", score.alias("score"), "tie"), clauses, "range")


def retrieve(plans: DataFrame, clauses: DataFrame, index: Index, k: int = 100, figures: dict[str, int] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of plans (query_id, and optionally filters, lat, lon, radius_km) and their clause rows.

    A group's best field counts, the others with ``tie``; every group that must
    match has to; without such a group some clause has to, and 1 is added to the
    score. Queries without any clause match all documents that pass the filters
    (pincode, address hash, radius): those of a place, an address or a pincode, or
    else the k documents of the best quality.

    An index without ranges answers the queries together: those with a filter score
    only the documents that it leaves, the others all documents, part by part.
    Where the index has ranges of documents, each query first takes the ranges in
    which a document may score most, about 4 k documents; the k-th best score there
    is one that a range has to reach, or else its postings are not read.
    ``figures`` is given how many postings were read and how many the terms have.
    """
    if index.ranges is None:
        return top(whole(plans, clauses, index, k), k)
    free = matched_all(plans.join(clauses.select("query_id").distinct(), "query_id", "left_anti"), index, k).withColumn("text_score", F.lit(1.0))
    free = filtered(free, plans, index)
    kinds = ("match", "term", "phrase", "fuzzy", "prefix")
    spots = kept(asked_terms(clauses, index, kinds).join(index.ranges, ["field", "term"]), "spots")
    docs = kept(index.docs.select("range", quality_of(index).alias("q"), *[c for c in ("pincode",) if c in index.docs.columns]), "ranges")
    bounds = range_bounds(spots, clauses)
    if "pincode" in docs.columns and "filters" in plans.columns and "pincode" in plans.schema["filters"].dataType.names:
        own = plans.select("query_id", F.col("filters.pincode").alias("pin"))
        pinned = own.where("pin is not null").join(docs.select("range", F.col("pincode").alias("pin")).distinct(), "pin").select("query_id", "range")
        bounds = bounds.join(own.where("pin is null").select("query_id"), "query_id", "left_semi").unionByName(bounds.join(pinned, ["query_id", "range"], "left_semi"))
    best_quality = docs.groupBy("range").agg(F.max("q").alias("q"))
    bounds = bounds.join(best_quality, "range").select("query_id", "range", (F.col("text_score") + 0.05 * F.col("q")).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "range"))
    bounds = kept(bounds.withColumn("nth", nth), "bounds")
    first_ranges = max(4, -(-4 * k // index.docs_of_range))

    def scored(allowed: DataFrame) -> DataFrame:
        own = spots.join(allowed.select("query_id", "range"), ["query_id", "range"], "left_semi")
        if figures is not None:
            figures["read"] = figures.get("read", 0) + (own.agg(F.sum("n")).first()[0] or 0)
        return filtered(combined(scored_clauses(own, index, 2, kinds, ["field", "term", "range"]), clauses, "doc_id"), plans, index)

    first = kept(top(scored(bounds.where(F.col("nth") <= first_ranges)), k).drop("rank"), "first")
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    # Scores are rounded, bounds are not.
    rest = bounds.where(F.col("nth") > first_ranges).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-5 >= F.col("least")))
    if figures is not None:
        figures["all"] = spots.agg(F.sum("n")).first()[0] or 0
    return top(free.unionByName(first).unionByName(scored(rest)), k)


def whole(plans: DataFrame, clauses: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, doc_id, score) of plans and their clause rows: all documents that pass a query's filters, or those that may be among the k best of all."""
    rows = kept(ways(plans, index).join(clauses.select("query_id").distinct().withColumn("asks", F.lit(True)), "query_id", "left"), "ways")
    free, narrow, wide = (rows.where(c).select("query_id") for c in ("asks is null and way = 'all'", "way <> 'all'", "asks and way = 'all'"))
    near = kept(passing(rows, index), "passing")
    alone = near.join(rows.where("asks is null").select("query_id"), "query_id", "left_semi").unionByName(free.crossJoin(F.broadcast(best_documents(index, k)))).withColumn("text_score", F.lit(1.0))  # k rows
    # A document's postings are looked up for the queries whose filters it passes.
    asked = kept(clauses.join(narrow, "query_id", "left_semi"), "narrow")
    own = Index(index.docs, kept(near.join(index.postings, "doc_id"), "own"), index.fields, index.terms)
    spots = kept(asked_terms(asked, index), "spots")
    few = combined(scored_clauses(spots, own, 2, ("match", "term", "phrase", "fuzzy", "prefix"), ["query_id", "field", "term"]), asked, "doc_id")
    out = filtered(alone.unionByName(few), plans, index)
    docs = index.docs.select("doc_id", quality_of(index).alias("q"))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))
    many = parts.best(clauses.join(wide, "query_id", "left_semi"), lambda c: asked_terms(c, index), index.postings, docs, norm, k)
    return out.unionByName(many.select("query_id", "doc_id", F.round(F.col("text_score") + 0.05 * F.col("q"), 6).alias("score")))


def quality_of(index: Index) -> Column:
    return F.coalesce("quality_score", F.lit(0.0)) if "quality_score" in index.docs.columns else F.lit(0.0)


def filtered(docs: DataFrame, plans: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score) of documents (query_id, doc_id, text_score) that pass their query's filters, quality added."""
    about = [c for c in ("pincode", "address_hash", "location") if c in index.docs.columns]
    asked = [c for c in ("filters", "lat", "lon", "radius_km") if c in plans.columns]
    docs = docs.join(plans.select("query_id", *asked), "query_id").join(index.docs.select("doc_id", *about, quality_of(index).alias("q")), "doc_id")
    for c in ("pincode", "address_hash"):
        if "filters" in asked and c in about and c in plans.schema["filters"].dataType.names:
            docs = docs.where(f"filters.{c} is null or {c} = filters.{c}")
    if {"lat", "lon", "radius_km"} <= set(asked) and "location" in about:
        docs = docs.where(F.col("lat").isNull() | (S.haversine(F.col("lat"), F.col("lon"), F.col("location.lat"), F.col("location.lon")) <= F.col("radius_km")))
    return docs.select("query_id", "doc_id", F.round(F.col("text_score") + 0.05 * F.col("q"), 6).alias("score"))


def ways(plans: DataFrame, index: Index) -> DataFrame:
    """Plans with the narrowest of their filters that the documents know (``way``: hash, place, pincode, or all)."""
    own = set(index.docs.columns)
    have = lambda *cs: set(cs) <= set(plans.columns)
    fields = plans.schema["filters"].dataType.names if have("filters") else []
    none = F.lit(None).cast("string")
    by_hash = F.col("filters.address_hash") if "address_hash" in fields and "address_hash" in own else none
    by_pin = F.col("filters.pincode") if "pincode" in fields and "pincode" in own else none
    placed = (F.col("lat").isNotNull() & F.col("lon").isNotNull()) if have("lat", "lon", "radius_km") and "location" in own else F.lit(False)
    way = F.when(by_hash.isNotNull(), "hash").when(placed, "place").when(by_pin.isNotNull(), "pincode").otherwise("all")
    return plans.select("query_id", *[c for c in ("lat", "lon", "radius_km") if have(c)], way.alias("way"), by_hash.alias("wanted_hash"), by_pin.alias("wanted_pin"))


def passing(rows: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id) of queries (see ``ways``) with a filter: the documents that pass the narrowest, by one equi-join."""
    own = set(index.docs.columns)
    found = []
    if "address_hash" in own:
        found.append(rows.where("way = 'hash'").join(index.docs.select("doc_id", F.col("address_hash").alias("wanted_hash")), "wanted_hash").select("query_id", "doc_id"))
    if "pincode" in own:
        found.append(rows.where("way = 'pincode'").join(index.docs.select("doc_id", F.col("pincode").alias("wanted_pin")), "wanted_pin").select("query_id", "doc_id"))
    if {"lat", "lon", "radius_km"} <= set(rows.columns) and "location" in own:
        points = rows.where("way = 'place'").select("query_id", "lat", "lon", "radius_km")
        docs = index.docs.where("location is not null").select("doc_id", "location.lat", "location.lon")
        if not points.isEmpty():  # else no tree of places is built
            found.append(within(points, docs).select("query_id", "doc_id"))
    return reduce(DataFrame.unionByName, found) if found else rows.select("query_id", F.lit(None).cast(index.docs.schema["doc_id"].dataType).alias("doc_id")).limit(0)


def best_documents(index: Index, k: int) -> DataFrame:
    """(doc_id) of the k documents of the best quality."""
    return index.docs.select("doc_id", quality_of(index).alias("q")).orderBy(F.col("q").desc(), "doc_id").limit(k).select("doc_id")


def matched_all(plans: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, doc_id) of queries that ask for no text: by one equi-join with the narrowest of their filters, never with all documents."""
    rows = ways(plans, index)
    return rows.where("way = 'all'").select("query_id").crossJoin(F.broadcast(best_documents(index, k))).unionByName(passing(rows, index))  # k rows


def radius_km(distance: Column) -> Column:
    """``3km`` or ``500m`` in km; null for other texts."""
    n = F.regexp_extract(distance, r"^(\d+(?:\.\d+)?)(km|m)$", 1).try_cast("double")
    return F.when(distance.endswith("km"), n).when(distance.rlike(r"^[\d.]+m$"), n / 1000)


def within(points: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, distance_km): documents (doc_id, lat, lon) in the radius of points (query_id, lat, lon, radius_km)."""
    return places.within(points, places.build(docs))


def candidate_dedup(hits: DataFrame) -> DataFrame:
    """The best hit of each address of a query, by hash, else address text, else id; ranks begin again at 1. Hits without a key all stay."""
    address = F.lower(X.squeeze(F.col("full_address")))
    key = F.coalesce(F.concat(F.lit("hash:"), F.nullif("address_hash", F.lit(""))), F.concat(F.lit("addr:"), F.nullif(address, F.lit(""))), F.concat(F.lit("id:"), F.col("doc_id").cast("string")))
    keyed = hits.withColumn("_key", F.coalesce(key, F.concat(F.lit("none:"), F.col("rank").cast("string"))))
    best = keyed.groupBy("query_id", "_key").agg(F.min("rank").alias("rank"))
    kept = keyed.join(best, ["query_id", "_key", "rank"]).drop("_key")
    return kept.withColumn("retrieval_position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def best_match(ranked: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """One row per query: the candidate of the highest confidence, then score, then text score; the earliest of equals."""
    names = list(fields or [c for c in ranked.columns if c != "query_id"])
    order = F.struct("confidence", "score", "bm25_score", -F.col("retrieval_position"))
    return ranked.groupBy("query_id").agg(F.max_by(F.struct(*names), order).alias("best")).select("query_id", "best.*")


def alternatives(ranked: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_id, place): after the best match, candidates of another address, ``most`` at most."""
    w = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), F.col("score").desc(), F.col("bm25_score").desc(), "retrieval_position")
    placed = ranked.withColumn("n", F.row_number().over(w))
    first = placed.where("n = 1").select("query_id", F.col("full_address").alias("best_address"))
    rest = placed.join(first, "query_id").where("not (full_address <=> best_address)")
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("place") <= most).select("query_id", "doc_id", "place")
