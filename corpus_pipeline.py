"""A corpus from raw documents to token files: five stages, each over what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
The tables beside ``documents`` are read from ``sf_dir``. Stages judge rows by their own text or doc_id; other
columns are passed on untouched. Rows that share a doc_id or have none are separate documents, and an empty
table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.llm import decontaminate, langid, mixing, simhash, token_files
from hostvane.operators.joins import join_checked
from hostvane.session import materialize

MAX_REPEATS = 1.25
ORACLE_SQL = None  # language models, fingerprints and token ids are beyond SQL; tests compare with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject."""
    held_out = F.coalesce(langid.in_fold(F.col("doc_id"), 4, 2), F.lit(False))
    predict = langid.predictor(spark, langid.train(docs.where(~held_out)))
    return docs.where(~predict(F.col("text").cast("string"))["rejected"])


def numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(``docs`` with a number for each row, its column, whether that is the doc_id itself).

    Rows that share a doc_id, or have none, are rows of their own: only then all rows are written with new numbers.
    """
    name = "row_number"
    while name in docs.columns:
        name += "_"
    unnamed = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if unnamed.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, True
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name, False


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id; of several, and without one, any one of the least text."""
    rows, number, named = numbered(docs)
    grouped = simhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    if not named:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(number))
        member = grouped.select(F.col("doc_id").alias(number), "component_id")
        member = rows.select(number, order.alias("place")).join(member, number)
        least = member.groupBy("component_id").agg(F.min("place").getField(number).alias("stays"))
        grouped = member.join(least, "component_id").select(F.col(number).alias("doc_id"), F.col("stays").alias("component_id"))
    dropped = grouped.where("doc_id != component_id").select(F.col("doc_id").alias(number))
    return join_checked(rows, dropped, [number], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The most even mix of sources in which every document appears, and no source more than MAX_REPEATS times."""
    return mixing.realise(docs, mixing.plan(docs, max_repeats=MAX_REPEATS)).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, described as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mixing", mix),
    ("token_files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
