"""Tables that a plan ends in, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, about, that may be broadcast.
LIGHT = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="placewright-")
    return folder.rstrip("/")


def width(kind: T.DataType) -> int:
    """Bytes of a value, about."""
    if isinstance(kind, T.StructType):
        return sum(width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 4 * width(kind.elementType)
    return 24 if isinstance(kind, (T.StringType, T.BinaryType, T.MapType)) else 8


def light(df: DataFrame, rows: int) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * width(df.schema) <= LIGHT


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder (spark.checkpoint.dir), where the plan ends.

    Files of rows that repeat are a fraction of the rows, so a table is held too
    large to be broadcast by its rows, counted as they are written, and not by its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/placewright-{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out if light(df, seen.get["rows"]) else out.hint("merge")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that were written whole, sorted; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
