"""Helpers shared by the training-data operators: tables, shared scratch, files in tasks, skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a partition of their own.
FEW_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, which has that many rows at most, in as many partitions as these need, or its own where they are fewer: small tables then make few tasks and files."""
    return df.coalesce(rows // FEW_ROWS + 1)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that tasks and the driver can both open."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


#: A key is hot when it holds more than one row in HOT_SHARE, so at most HOT_SHARE keys are ever hot.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left ⋈ right on key without a skewed task, however many of left's rows share one key.

    right has one row per key, with the number of left's rows in the column count (dropped from the result); total is left's
    number of rows. Keys with more than total / HOT_SHARE rows number under HOT_SHARE, whatever the input: their side is
    broadcast. All others are joined by a shuffle. With how="left", keys that right lacks must not be hot either, as nothing
    counts them: give right a row for each key that may be, or keep such rows out of left.
    """
    floor = max(1, total // HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(count) > floor).drop(count))
    rest = right.filter(F.col(count) <= floor).drop(count)
    with_hot = left.join(hot, key, "inner")
    others = left.join(hot.select(key), key, "left_anti")
    return with_hot.unionByName(others.join(rest.hint("merge"), key, how))


def unused(columns: list[str], name: str) -> str:
    """name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(df: DataFrame, column: str, run: Callable[[], Callable[[list], list]], fields: str) -> DataFrame:
    """df without column, and with new fields made of its values; all other columns pass through untouched, whatever they hold.

    run is called once a task and gives a function from a batch's values to its new columns, each a list.
    """
    rest = [f for f in df.schema.fields if f.name != column]
    new = T.StructType.fromDDL(fields).fields
    names = [f.name for f in rest + new]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, kinds = run(), [to_arrow_type(f.dataType) for f in new]
        for b in batches:
            at = b.schema.get_field_index(column)
            made = make(b.column(at).to_pylist())
            kept = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)], names=names)

    return df.mapInArrow(each, T.StructType(rest + new))


def whole(values: list[int | None]) -> pd.api.extensions.ExtensionArray:
    """Whole numbers and nulls for a pandas column, without a detour over floating point."""
    return pd.array(values, dtype="Int64")
