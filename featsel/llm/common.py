"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks between words in every contract of this subpackage.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary one stands in for it in local
    mode only, where there is a single machine; on a cluster its absence is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='featsel-')}"
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, scratch: Scratch | None = None, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write `df` into the shared folder and read it back. With `scratch` the table goes when that is dropped."""
    at = f"{scratch.at if scratch else shared_dir(df.sparkSession)}/featsel-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """A folder for written tables that a job needs for a while only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/featsel-{uuid.uuid4().hex}"

    def drop(self) -> None:
        """Delete its tables. No DataFrame that is still to be computed may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches (or arrays) in slices of a few rows, so that a task holds few texts as Python values at once. At the end
    the memory that Arrow and the C library keep for later goes back to the system: workers live on after a task."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch[k : k + rows] if isinstance(batch, pa.Array) else batch.slice(k, rows)
    released()


def released() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, most_rows: int = 500_000, most_bytes: int | None = None) -> DataFrame:
    """Mark `df` for broadcast if a count shows that it has at most `most_rows` rows of a few
    numbers each (some 16 MB), and if its texts have `most_bytes` bytes at most, where a bound is given for them; beyond
    that Spark joins by shuffle. `df` must be cheap to read twice, for example a written table."""
    few = df.limit(most_rows + 1)
    if most_bytes is None:
        return F.broadcast(df) if few.count() <= most_rows else df
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(sum(texts[1:], texts[0])), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and size <= most_bytes else df


def words_of(text) -> "F.Column":
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    found = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(found, lambda w: w != "")
