"""A training-data pipeline over documents: quality rules, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, pii, quality, queries, simhash
from tidemark.llm.common import stored, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ..., so that none can clash with an operator's own, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and empty texts have no words and go; rows without an id are documents like any others; each of repeated rows is
    judged, alike, by itself; extra columns of any name stay; an empty table stays one.
    """
    d, n = _numbered(docs)
    judged = quality.with_verdict(d, text_col=n["text"], lang_col=n["lang"], source_col=n["source"])
    return _named(judged.filter("__kept"), n)


def _row_key(docs: DataFrame) -> list:
    """128 bits over all columns of a row, nulls told apart by place; equal for equal rows only."""
    cols = [F.col(c) for c in docs.columns]
    nulls = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *nulls).alias("h1"), F.xxhash64(F.lit(1), *cols, *nulls).alias("h2")]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: the one with the smallest doc_id, of equal ids the smallest row key; a row without an id only where no row has one.

    Rows are told apart by all their columns, so rows of one id (or of none) with other texts are other documents; repeated
    rows are one. Null and wordless texts have fingerprint zero and are near-duplicates of each other; extra columns of any
    name stay; an empty table stays one.
    """
    d, n = _numbered(docs)
    key = ["h1", "h2"]
    light = d.select(F.col(n["doc_id"]).alias("doc_id"), F.col(n["text"]).alias("text"), *_row_key(d))
    light = stored(simhash.with_fingerprint(light, carry=["doc_id", *key]), "fingerprints")
    classes = stored(simhash.components(light.select("doc_id", "fp")), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)
    best = light.groupBy("fp").agg(F.min(first).alias("best")).join(classes.select("fp", "root"), "fp")
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select("best.h1", "best.h2")
    return _named(d.select("*", *_row_key(d)).join(kept, key, "left_semi").dropDuplicates(key), n)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and wordless texts hold none and stay; each of repeated rows, and rows without an id, are looked at by themselves;
    extra columns of any name stay; an empty table stays one.
    """
    d, n = _numbered(docs)
    found = decontaminate.find(d, table(spark, sf_dir, "benchmark"), id_col=n["doc_id"], text_col=n["text"], carry=d.columns)
    return _named(found.filter("__n_hit = 0"), n)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; n_chars follows the text.

    All rows stay, repeated ones and those without an id too; a null text stays null, an empty one empty; extra columns of any
    name stay; an empty table stays one.
    """
    d, n = _numbered(docs)
    found = pii.detect(d, text_col=n["text"], carry=[c for c in d.columns if c != n["text"]], redacted=True)
    found = found.withColumnRenamed("__redacted", n["text"])
    if "n_chars" in n:
        changed = F.size("__base") + F.size("__added") > 0
        size = F.when(changed, F.length(n["text"])).otherwise(F.col(n["n_chars"]))
        found = found.withColumn(n["n_chars"], size.cast(docs.schema["n_chars"].dataType))
    return _named(found, n)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens under op10's limits: one row per piece, with its ids.

    Null and empty texts are the end id alone; repeated rows and rows without an id are packed each; extra columns aren't read.
    """
    docs = docs.select("doc_id", "text")
    return packing.pack(docs, queries.tokenizer(packing.BYTE_BPE), limits=packing.QUERY_LIMITS, prompt=packing.first_line())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: No stage but the third can be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
