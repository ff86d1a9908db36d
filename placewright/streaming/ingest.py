"""Files that arrive, cleaned as they come.

``cleaned`` has the steps that look at one row. The whole of preprocessing also
looks at others: of equal rows and of equal addresses the first stays, and a
missing name is the first name of its code, which may arrive later than the row
that needs it. ``Preprocessing`` keeps rows, cleaned rows, names and results as upsert tables.
A batch adds its rows and names and works out again what they change: rows that
are new or come before an equal one, and rows without name whose code has
another first name now. So results are right after every batch, and any split
into files gives what ``preprocess`` gives for all of them. A state store would
hold all rows that wait for a code in one key's state; tables are joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import words
from ..operators import clean
from ..operators.store import kept
from ..session import spread
from . import upsert

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in words.STANDARD_COLUMNS])


def arriving(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """A stream of standard rows from the files of a folder."""
    return spark.readStream.schema(SCHEMA).format(kind).option("maxFilesPerTrigger", 100).load(folder)


def cleaned(stream: DataFrame) -> DataFrame:
    """The row-wise steps, address, hash and quality of a stream."""
    df = clean.validate(clean.standardize(stream, words.NAME_COLUMNS))
    df = df.withColumn("full_address", clean.full_address(df))
    return df.withColumns({"address_hash": clean.address_hash(F.col("full_address")), "quality_score": clean.quality_score(df)})


@dataclass
class Preprocessing:
    """``order``, a whole number, says which row comes first."""

    spark: SparkSession
    path: str
    order: str

    def _table(self, name: str, key: str, order: str) -> upsert.UpsertTable:
        return upsert.UpsertTable(self.spark, f"{self.path}/{name}", key, (order,))

    @property
    def tables(self) -> tuple[upsert.UpsertTable, upsert.UpsertTable, upsert.UpsertTable, upsert.UpsertTable]:
        """Rows as they came, by what equal ones agree on; the same cleaned; names by column and code; results by row. The least order is the greatest ``_first``."""
        return self._table("rows", "_row_key", "_first"), self._table("cleaned", "_row_key", "_first"), self._table("names", "_name_key", "_first"), self._table("results", "_row_key", "_batch")

    def put(self, batch: DataFrame, number: int) -> None:
        """Take a batch in. The same number again gives the same."""
        rows, cleaned, names, results = self.tables
        own = [c for c in batch.columns if c not in ("serial_number", self.order)]
        # A batch may be few files: its rows are dealt to all tasks first.
        some = clean.drop_empty_rows(spread(batch), [self.order]).withColumns({"_row_key": clean.row_key(own), "_first": -F.col(self.order).cast("long")})
        rows.put(some, number)
        text = clean.strings(batch, [self.order])
        pairs = [(c, n) for c, n in words.HIERARCHY if {c, n} <= set(batch.columns)]
        # A row is cleaned once, as it comes; later batches read it cleaned.
        cleaned.put(clean.cleaned(rows.batch(number), text), number)
        came = cleaned.batch(number)
        if pairs:
            cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.trim(c).alias("code"), F.trim(n).alias("name")) for c, n in pairs])).alias("x")
            found = came.select("_first", cells).select("_first", "x.*").where("code <> '' and name <> ''")
            names.put(found.withColumn("_name_key", F.to_json(F.struct("column", "code"))), number)
        every = cleaned.versions()
        waiting = [came.select("_row_key")]
        if pairs:
            first = kept(names.read(), "names")
            new = first.join(names.batch(number).select("_name_key"), "_name_key", "left_semi")
            for code, name in pairs:
                changed = new.where(F.col("column") == name).select(F.col("code").alias("_code"))
                waiting.append(every.where(F.col(name).isNull()).join(changed, F.trim(code) == F.col("_code"), "left_semi").select("_row_key"))
        # Equal rows agree on codes and names, so whichever version waits, its key does.
        keys = reduce(DataFrame.unionByName, waiting).distinct()
        touched = upsert.latest(every.join(keys, "_row_key", "left_semi"), "_row_key", ("_first",))
        filled = clean.fill_names(touched, first, pairs) if pairs else touched
        results.put(clean.addressed(clean.written_out(filled)).withColumn("_batch", F.lit(number)), number)

    def read(self) -> DataFrame | None:
        """What ``preprocess`` gives for all rows that came."""
        rows, _, _, results = self.tables
        now, came = results.read(), rows.versions()
        if now is None:
            return None
        df = now.drop("_row_key", "_first", "_batch", *clean.empty_columns(came.drop("_row_key", "_first")))
        df = clean.address_dedup(df, self.order)
        return df.withColumn("quality_score", clean.quality_score(df))

    def run(self, stream: DataFrame, state: str) -> StreamingQuery:
        """Take in what is there now and stop; ``state`` remembers the files."""
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", state).trigger(availableNow=True).start()

    def compact(self) -> None:
        for table in self.tables:
            table.compact()


def run(spark: SparkSession, folder: str, out: str, state: str, kind: str = "parquet") -> StreamingQuery:
    """Take in what is there now, each file once, and stop; ``state`` remembers the files."""
    return cleaned(arriving(spark, folder, kind)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
