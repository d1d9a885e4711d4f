"""Readers and writers of plant data: CSV, JSON lines, tag maps, work-order exports, tables at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers of the cycle export and the names they get.
HEADERS = {
    "UDI": "udi", "Product ID": "product_id", "Type": "product_type", "Air temperature [K]": "air_temperature_k", "Process temperature [K]": "process_temperature_k",
    "Rotational speed [rpm]": "rotational_speed_rpm", "Torque [Nm]": "torque_nm", "Tool wear [min]": "tool_wear_min", "Machine failure": "machine_failure",
    "TWF": "twf", "HDF": "hdf", "PWF": "pwf", "OSF": "osf", "RNF": "rnf",
}
_TEXT = {"Product ID", "Type"}
_WHOLE = {"UDI", "Machine failure", "TWF", "HDF", "PWF", "OSF", "RNF"}


def cycle_schema() -> T.StructType:
    kind = lambda h: T.StringType() if h in _TEXT else T.LongType() if h == "UDI" else T.IntegerType() if h in _WHOLE else T.DoubleType()
    return T.StructType([T.StructField(h, kind(h)) for h in HEADERS])


def read_cycles(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """The CSV export with a declared schema (no inference pass) and clean names."""
    r = spark.readStream if streaming else spark.read
    return r.schema(cycle_schema()).option("header", True).option("enforceSchema", True).csv(path).withColumnsRenamed(HEADERS)


def with_place(df: DataFrame, *, machine: str = "unknown", start: float = 0.0, period: float = 1.0, order: str = "udi") -> DataFrame:
    """df with machine_id and t where they are missing: an unknown machine, and seconds from start by the row's number in order."""
    have = set(df.columns)
    m = F.coalesce(F.col("machine_id"), F.lit(machine)) if "machine_id" in have else F.lit(machine)
    made = F.lit(start) + F.col(order) * F.lit(max(period, 1.0))
    return df.withColumns({"machine_id": m, "t": F.coalesce(F.col("t"), made) if "t" in have else made})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, streaming: bool = False) -> DataFrame:
    """One JSON object a line; a corrupt line keeps its first 200 characters in _malformed."""
    full = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    r = spark.readStream if streaming else spark.read
    df = r.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").json(path)
    return df.withColumn("_malformed", F.substring("_malformed", 1, 200))


def build_source(spark: SparkSession, kind: str, path: str, *, schema: T.StructType | None = None, streaming: bool = False) -> DataFrame:
    if kind == "csv":
        return read_cycles(spark, path, streaming=streaming)
    if kind == "jsonl":
        return read_jsonl(spark, path, schema or T.StructType([T.StructField(v, T.DoubleType()) for v in HEADERS.values()]), streaming=streaming)
    raise ValueError(f"unknown source: {kind}")


def tag_map(messages: DataFrame, tags: dict[str, str], *, keys: tuple[str, ...] = ("machine_id", "t")) -> DataFrame:
    """Tag-per-row messages (tag, value) to a channel-per-column row; unmapped tags are dropped. The channels are given, so no pass finds them."""
    m = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.lit(v))])
    named = messages.withColumn("channel", F.element_at(m, F.col("tag"))).filter("channel IS NOT NULL")
    return named.groupBy(*keys).agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in sorted(set(tags.values()))])


def parse_time(c: Column) -> Column:
    """Epoch seconds from seconds, milliseconds or ISO text (UTC without a zone); null otherwise."""
    n = c.try_cast("double")
    iso = F.try_to_timestamp(c).cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e18), F.when(F.abs(n) > 1e11, n / 1000.0).otherwise(n)).otherwise(iso)


def number(c: Column) -> Column:
    """A finite double or null."""
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1.7e308), n)


def read_work_orders(spark: SparkSession, path: str) -> DataFrame:
    """A maintenance export under either header set; rows without a number are skipped."""
    df = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    truthy = F.lower(F.trim(pick("found_fault"))).isin("1", "true", "yes", "y")
    out = df.select(pick("raised_at", "cycle").try_cast("bigint").alias("at"), pick("machine_id", "asset").alias("machine_id"), pick("kind", "work_type").alias("kind"), truthy.alias("found_fault"), pick("mode").alias("mode"), pick("reference", "wo").alias("reference"))
    return out.filter("at IS NOT NULL")


def write_table(df: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> None:
    """Parquet at rest; sorted inside files by the partition's key so that statistics prune."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def page(df: DataFrame, order: str, columns: tuple[str, ...], *, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page by a whitelisted column, the key settling ties."""
    if order not in columns:
        raise ValueError(f"can't order by {order}")
    return df.orderBy(F.desc(order) if descending else F.asc(order), "udi").offset(offset).limit(limit)


def append_stream(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True):
    """A running stream appended to Parquet at path, exactly once by its checkpoint; once: all that is there, then it ends."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def write_examples(df: DataFrame, path: str, columns: tuple[str, ...] = ("question", "plan")) -> None:
    """Verified examples as JSON lines; read_examples gives them back."""
    df.select(*columns).write.mode("overwrite").json(path)


def read_examples(spark: SparkSession, path: str, columns: tuple[str, ...] = ("question", "plan")) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path)
