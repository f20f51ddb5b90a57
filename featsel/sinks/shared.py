"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Only in local mode, where there is one machine, a temporary folder stands in for it; on
    a cluster its absence is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='featsel-')}"
        sc.setCheckpointDir(named)
    return f"{named}/featsel-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df`, computed once: written to a new shared folder and read back."""
    at = new_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, through Spark's own file systems. Nothing that is still to be computed may read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """Mark `df` for broadcast if a count shows that it has at most `most_rows` rows of a few short values each (some tens of MB); beyond
    that Spark joins by shuffle. `df` must be cheap to read twice, for example a written table."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
