"""The session, and this package on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if not getattr(context, "_placewright_sent", False):
        path = Path(tempfile.mkdtemp(prefix="placewright-")) / "placewright.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(p.relative_to(PACKAGE.parent)))
        context.addPyFile(str(path))
        context._placewright_sent = True
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt to as many tasks as there are shuffle partitions: for small rows with much to work out, which few tasks would read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
