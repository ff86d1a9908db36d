"""The inverted index as tables: documents, postings, statistics of fields and terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import words
from ..session import spread
from .store import kept

RANGE_DOCS = 16
#: Words whose postings are made at a time, but for one document of more.
MOST_WORDS = 1 << 19
#: What makes a place of a document.
PLACE = ("state_name", "city_name", "locality")
#: Fixed values of BM25.
K1, B = 1.2, 0.75
FIELDS = ("full_address", "building_name", "office_name", "road_name", "locality", "city_name", "district_name", "state_name", "subdistrict_name", "block_name", "pincode", "searchable_text")


@dataclass
class Index:
    """``docs``: one row per document; ``postings``: (field, term, doc_id, tf, positions, dl); ``fields``: (field, n_docs, avg_dl); ``terms``: (field, term, df).

    With ``ranges``, (field, term, range, n, top): documents and postings have a ``range`` too, and each term is known in each range by its postings and their
    greatest saturation.
    """

    docs: DataFrame
    postings: DataFrame
    fields: DataFrame
    terms: DataFrame
    ranges: DataFrame | None = None
    docs_of_range: int = RANGE_DOCS

    def write(self, path: str) -> None:
        """As Parquet; postings by field, sorted by term, so a search reads the row groups of its terms."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
        self.fields.write.mode("overwrite").parquet(f"{path}/fields")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "fields", "terms")])


def number(c: Column, bound: float) -> Column:
    value = X.coordinate(c.cast("string"), bound)
    return value.try_cast("double")


def document_id(order: str) -> Column:
    """The address hash, else a name made of the row's number, pincode and locality."""
    made = F.concat(F.lit("row-"), F.col(order).cast("string"), F.lit("-"), F.coalesce("pincode", F.lit("na")), F.lit("-"), F.coalesce(F.substring("locality", 1, 40), F.lit("na")))
    return F.coalesce("address_hash", made)


def documents(df: DataFrame, order: str) -> DataFrame:
    """Index documents: cleaned values, id, location and numeric quality; rows without address, locality and pincode are left out."""
    text = [c for c, kind in df.dtypes if kind == "string" and c not in ("latitude", "longitude", order)]
    out = df.withColumns({c: X.clean_value(F.col(c)) for c in text})
    for c in {"address_hash", "pincode", "locality", "full_address", "latitude", "longitude"} - set(out.columns):
        out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.where("full_address is not null or locality is not null or pincode is not null")
    lat, lon = number(F.col("latitude"), 90), number(F.col("longitude"), 180)
    out = out.withColumns({"doc_id": document_id(order), "location": F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))})
    if "quality_score" in out.columns:
        out = out.withColumn("quality_score", F.col("quality_score").cast("double"))
    return out.drop("latitude", "longitude")


def both_ways() -> dict[str, str]:
    """Synonyms of one word hold in both directions."""
    out = {k: [v] for k, v in words.SYNONYMS.items()}
    for k, v in words.SYNONYMS.items():
        if " " not in v:
            out.setdefault(v, []).append(k)
    return {k: " ".join(dict.fromkeys(v)) for k, v in out.items()}


def term_rows(docs: DataFrame, fields: Iterable[str], synonyms: bool) -> DataFrame:
    """(doc_id, field, dl, pos, term), synonyms at their word's position."""
    own = [f for f in fields if f in docs.columns]
    long = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), X.analyze(F.col(f).cast("string")).alias("terms")) for f in own])).alias("x"))
    rows = long.select("doc_id", "x.field", F.size("x.terms").alias("dl"), F.posexplode("x.terms").alias("pos", "term"))
    if synonyms:
        rows = rows.withColumn("term", F.explode(X.with_synonyms(F.array("term"), both_ways())))
    return rows


def posting_rows(docs: DataFrame, fields: Iterable[str], synonyms: bool) -> DataFrame:
    """(field, term, doc_id, tf, positions, dl) of documents; rows of one id are one document.

    A document's words are counted where it lies: documents move once, words not at
    all, and no table of words is held or spilled.
    """
    own = [f for f in fields if f in docs.columns]
    dealt = spread(docs.select("doc_id", *own), "doc_id").sortWithinPartitions("doc_id")
    long = dealt.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), X.analyze(F.col(f).cast("string")).alias("terms")) for f in own])).alias("x"))
    rows = long.select("doc_id", "x.field", F.size("x.terms").alias("dl"), F.col("x.terms").alias("terms"))
    if synonyms:
        each = rows.withColumn("each", F.transform("terms", lambda t: X.with_synonyms(F.array(t), both_ways())))
        rows = each.select("doc_id", "field", "dl", F.flatten("each").alias("terms"), F.flatten(F.transform("each", lambda ts, i: F.transform(ts, lambda t: i))).alias("at"))
    kind = docs.schema["doc_id"].dataType
    ints = T.IntegerType()
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("doc_id", kind), T.StructField("tf", ints), T.StructField("positions", T.ArrayType(ints)), T.StructField("dl", ints)])
    return rows.mapInArrow(_counted, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (doc_id, field, dl, terms and perhaps their places) that are sorted by document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        if not len(ids):
            continue
        if held and held[-1].column("doc_id")[-1] != batch.column("doc_id")[0]:
            yield from _postings(held)
            held = []
        # The last document may go on in the next batch.
        size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).cumsum()
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        begin = 0
        for edge in edges[1:].tolist():
            if held or edge == edges[-1] or size[edge - 1] - (size[begin - 1] if begin else 0) >= MOST_WORDS:
                held.append(batch.slice(begin, edge - begin))
                yield from _postings(held)
                held, begin = [], edge
        held.append(batch.slice(begin))
    if held:
        yield from _postings(held)


def _postings(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole documents."""
    table = pa.Table.from_batches(rows).combine_chunks()
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    terms = column["terms"].flatten().dictionary_encode()
    if not len(terms):
        return
    sizes = pc.list_value_length(column["terms"]).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = column["at"].flatten().to_numpy() if "at" in column else np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    doc, field = (column[c].dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for c in ("doc_id", "field"))
    text = doc * (field.max() + 1) + field
    lengths = np.bincount(text, weights=column["dl"].to_numpy()).astype(np.int32)
    words_of = terms.indices.to_numpy().astype(np.int64)
    key = text[owner] * len(terms.dictionary) + words_of
    order = np.lexsort((place, key))
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key))).astype(np.int32)
    one = order[first]
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    at = pa.array(owner[one])
    yield pa.RecordBatch.from_arrays([column["field"].take(at), terms.dictionary.take(pa.array(words_of[one])), column["doc_id"].take(at), pa.array(tf), positions, pa.array(lengths[text[owner[one]]])], names=["field", "term", "doc_id", "tf", "positions", "dl"])


def lengths_of(docs: DataFrame, fields: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    """(keys, field, dl): words of each field of each document."""
    sizes = [F.struct(F.lit(f).alias("field"), F.size(X.analyze(F.col(f).cast("string"))).alias("dl")) for f in fields if f in docs.columns]
    return docs.select(*keys, F.explode(F.array(*sizes)).alias("x")).select(*keys, "x.*")


def build(docs: DataFrame, fields: Iterable[str] = FIELDS, synonyms: bool = True) -> Index:
    """The index of a table with ``doc_id`` and text fields."""
    postings = posting_rows(docs, fields, synonyms)
    # A field's length needs no postings: one pass over the documents.
    per_field = lengths_of(docs, fields).where("dl > 0").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    terms = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(docs, postings, per_field, terms)


def stored(index: Index) -> Index:
    """The same index with its tables written, so that a search reads them instead of building them again. Documents are left where they are."""
    postings = kept(index.postings, "postings")
    terms = kept(postings.groupBy("field", "term").agg(F.count("*").alias("df")), "terms")
    return Index(index.docs, postings, kept(index.fields, "fields"), terms)


def with_ranges(index: Index, docs_of_range: int = RANGE_DOCS, by: Iterable[str] = PLACE) -> Index:
    """A stored index whose documents lie in ranges of one place each, of about so many documents at most.

    Documents of a place share its terms, so what a range may score is close to what
    its documents do. ``by`` goes from wide to narrow: documents that agree in all but
    the last are dealt by the last, and what is then still too many by hash.
    """
    *wide, narrow = [F.lower(F.trim(c)) for c in by if c in index.docs.columns] or [F.lit("")]
    docs = index.docs.withColumns({"place": F.xxhash64(F.lit(0), *wide), "within": F.xxhash64(F.lit(0), narrow)})
    for least in (docs_of_range, 2 * docs_of_range):
        parts = docs.groupBy("place").agg(F.count("*").alias("n")).select("place", F.when(F.col("n") > least, F.ceil(F.col("n") / docs_of_range)).otherwise(1).alias("parts"))
        docs = docs.join(parts, "place").withColumn("place", F.xxhash64("place", F.pmod("within", "parts"))).drop("parts").withColumn("within", F.xxhash64("doc_id"))
    docs = docs.withColumnRenamed("place", "range").drop("within")
    docs = kept(docs, "docs")
    postings = kept(index.postings.join(docs.select("doc_id", "range"), "doc_id"), "postings")
    saturated = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    tops = postings.join(F.broadcast(index.fields), "field").groupBy("field", "term", "range").agg(F.count("*").alias("n"), F.max(saturated).alias("top"))
    return Index(docs, postings, index.fields, index.terms, kept(tops, "ranges"), docs_of_range)


def stats(index: Index) -> DataFrame:
    """One row: documents, postings, distinct terms."""
    return index.docs.agg(F.count("*").alias("documents")).crossJoin(index.terms.agg(F.sum("df").alias("postings"), F.countDistinct("term").alias("terms")))
