"""Keyed upserts: the last version of each key, whatever is replayed or comes late.

Each micro-batch is written as it comes, without a shuffle, in a folder named by
its number, so a batch that is tried again writes over itself. Which version of
a key is the last one is said by its ``order`` columns, not by when it came:
taking the greater of two versions may be repeated and done in any order, so a
replayed or reordered stream gives what one batch would. Reading takes the
last version over all batches; compaction writes it down as a base, and says in
a manifest, valid once it is whole, which batches the base has. Older versions
take room until then.

Defined cases: of versions of equal order the greatest row stays; rows without
key are left out; a table without rows has none; a late version of an order
below the one that is there changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import folders


def latest(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest ``order`` of each key, else the greatest row; reduced before the shuffle."""
    own = F.struct(*rows.columns)
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(own, F.struct(*order, F.to_json(own).alias("_row"))).alias("_best"))
    return best.select("_best.*")


@dataclass
class UpsertTable:
    spark: SparkSession
    path: str
    key: str
    order: tuple[str, ...]

    def put(self, rows: DataFrame, batch: int, source: str = "stream") -> None:
        """Take a batch in; the same number again changes nothing but to write it once more."""
        rows.where(F.col(self.key).isNotNull()).write.mode("overwrite").parquet(f"{self.path}/batches/{source}-{batch:012d}")

    def sink(self, source: str = "stream") -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` calls."""
        return lambda rows, batch: self.put(rows, batch, source)

    def run(self, stream: DataFrame, state: str, source: str = "stream") -> StreamingQuery:
        """Take in what is there now and stop; ``state`` remembers how far it came."""
        return stream.writeStream.foreachBatch(self.sink(source)).option("checkpointLocation", state).trigger(availableNow=True).start()

    def _manifest(self) -> tuple[int, str | None, set[str]]:
        done = folders(self.spark, f"{self.path}/manifest")
        if not done:
            return 0, None, set()
        row = json.loads(self.spark.read.text(f"{self.path}/manifest/{done[-1]}").first()[0])
        return int(done[-1]), row["base"], set(row["batches"])

    def versions(self) -> DataFrame | None:
        """All versions that are there, without a shuffle; None before anything came."""
        _, base, within = self._manifest()
        paths = [f"{self.path}/batches/{b}" for b in folders(self.spark, f"{self.path}/batches") if b not in within]
        parts = [self.spark.read.parquet(p) for p in ([f"{self.path}/{base}"] if base else []) + paths]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self) -> DataFrame | None:
        """The last version of each key; None before anything came."""
        every = self.versions()
        return None if every is None else latest(every, self.key, self.order)

    def batch(self, batch: int, source: str = "stream") -> DataFrame:
        """What was put in as that batch."""
        return self.spark.read.parquet(f"{self.path}/batches/{source}-{batch:012d}")

    def compact(self) -> None:
        """Write what is there down as the base. A batch of a base that is tried again later is not read again: it is the same."""
        number, _, within = self._manifest()
        now, batches = self.read(), folders(self.spark, f"{self.path}/batches")
        if now is None:
            return
        base = f"base-{uuid.uuid4().hex}"
        now.write.parquet(f"{self.path}/{base}")
        row = json.dumps({"base": base, "batches": sorted(within | set(batches))})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/manifest/{number + 1:09d}")
