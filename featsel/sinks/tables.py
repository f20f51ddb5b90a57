"""Writing prepared tables and results as files."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsel.operators.prepare import Prepared, significant
from featsel.sinks.shared import dropped


def csv_columns(prepared: Prepared, digits: int = 10) -> DataFrame:
    """What `write_csv` writes: the inputs under their names as texts of `digits` significant digits, then the target (as 0 or
    1 for a classification)."""
    inputs = [significant(F.col(c), digits).alias(name) for c, (name, *_) in zip(prepared.columns, prepared.features)]
    label = F.col("label").cast("int").cast("string") if prepared.task == "classification" else significant(F.col("label"), digits)
    return prepared.data.select(*inputs, label.alias(prepared.target))


def write_csv(prepared: Prepared, path: str, digits: int = 10, mode: str = "errorifexists") -> None:
    """A prepared table as CSV files with a header."""
    csv_columns(prepared, digits).write.mode(mode).option("header", True).csv(path)


def result_tables(result) -> dict[str, DataFrame]:
    """Name -> table of the DataFrames that a result (with `tables`, or a dataclass) holds."""
    if hasattr(result, "tables"):
        return result.tables()
    found = {f.name: getattr(result, f.name) for f in dataclasses.fields(result)}
    return {name: df for name, df in found.items() if isinstance(df, DataFrame)}


def write_report(result, path: str, format: str = "json", mode: str = "errorifexists") -> list[str]:
    """A result as one folder for each of its tables, in the given format. Returns the names of the tables."""
    tables = result_tables(result)
    for name, df in tables.items():
        df.write.mode(mode).format(format).save(f"{path}/{name}")
    return list(tables)


#: Tables of a result that a document holds as one object, not as a list; tables of rows (`data`) are in none.
SINGLE, ROWS = ("selection", "insight"), ("data",)


def document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a struct for each table of one row, a list of structs for the others, in the order of their columns' values. The tables are
    as large as the feature set; each is gathered by an aggregate of its own and joined to the others by a constant key."""
    whole = None
    for name, df in tables.items():
        rows = F.array_sort(F.collect_list(F.struct("*")))
        one = df.agg((F.get(rows, F.lit(0)) if name in SINGLE else rows).alias(name)).withColumn("_key", F.lit(0))
        whole = one if whole is None else whole.join(one, "_key")
    return whole.drop("_key")


def write_document(result, path: str, overwrite: bool = False) -> None:
    """A result (a dataclass, or name -> DataFrame) as one JSON document in one file. It is written aside and then takes its place by a
    rename, so that a reader finds the old document, or none, or the new one, but no part."""
    tables = result if isinstance(result, dict) else result_tables(result)
    tables = {name: df for name, df in tables.items() if name not in ROWS}
    spark = next(iter(tables.values())).sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) and not overwrite:
        raise ValueError(f"{path} exists already")
    aside = f"{path.rstrip('/')}._writing"
    document(tables).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(aside)
    part = next(s.getPath() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(aside)) if s.getPath().getName().startswith("part-") and s.getLen())
    if fs.exists(to):
        fs.delete(to, True)
    fs.mkdirs(to.getParent())
    renamed = fs.rename(part, to)
    dropped(spark, aside)
    if not renamed:
        raise OSError(f"the document could not take its place at {path}")
