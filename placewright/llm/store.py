"""Where an operator keeps what it must not compute twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_placewright_folder", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="placewright-")
            spark._placewright_folder = folder
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; their lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/placewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._placewright_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a ``kept`` result that nothing reads any more."""
    spark, path = df.sparkSession, df._placewright_path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
