"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import contamination, near_dedup, packing, quality, secrets
from placewright.llm.queries import held_out, table
from placewright.llm.store import fresh, kept
from placewright.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier grades at least 1 more likely than not.

    Null and empty texts get the grade that is likeliest without words and stay
    if that is 1 or more; texts are read whole; equal texts are judged alike;
    repeated rows and rows without id stay or go like others; an empty table gives
    none; no column is lost, whatever its name. Without labels all rows stay.
    """
    ship(spark)
    model = quality.fit(table(spark, sf_dir, "documents"), quality.grades(table(spark, sf_dir, "labels").where(~held_out())), 3)
    name = fresh(docs.columns, "tails")
    return quality.score(docs, model, name).where(quality.selected(name=name)).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of the smallest id.

    Null, empty and wordless texts have no shingles, are like nothing and stay;
    texts are compared whole; ties go to the smallest id. Rows of one id are one
    document: they stay or go together; of those with the same text too, one row
    stays, the smallest by its other columns. Rows without id stay. An empty table
    gives none; no column is lost, whatever its name.
    """
    ship(spark)
    gone = near_dedup.groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    repeated = out.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("none"), *others)).alias("least"))
    one = repeated.select(*[F.col(c) if c in ("doc_id", "text") else F.col("least")[c].alias(c) for c in docs.columns])
    return out.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a window of a benchmark item.

    Null, empty and wordless texts hold no window and stay; texts are searched
    whole; repeated rows and rows without id are judged each for itself; items
    without words, and an empty benchmark, match nothing; an empty table gives
    none; no column is lost, whatever its name.
    """
    ship(spark)
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text where it changes.

    Null and empty texts stay as they are; texts are scanned whole; overlapping
    spans are replaced together; repeated rows and rows without id are changed
    each for itself; an empty table gives none; no column is lost, whatever its
    name.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("text", *(["n_chars"] if "n_chars" in docs.columns else []), F.struct(F.lit(0).alias("none"), *others).alias("others"))
    text, found = F.col("text"), F.size("spans") > 0
    new = F.when(text.isNotNull() & found, secrets.redacted(text, F.col("spans"))).otherwise(text)
    changed = {"text": new} | ({"n_chars": F.when(found, F.length(new).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return secrets.scan(rows).select(*[changed[c].alias(c) if c in changed else F.col("others")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    Null and empty texts are one end token; long texts are cut into pieces of at
    most the longest window; repeated rows and rows without id are packed each
    for itself; an empty table gives none; extra columns are left out.
    """
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", contamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: SQL has no tokenizer and no fitted classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(docs, f"stage{i}")
    return docs
