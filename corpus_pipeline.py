"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.llm.common import durable, table, unused
from stratakeep.llm.decontamination import contaminated
from stratakeep.llm.mixing import mix_sources, sized, times_taken
from stratakeep.llm.near_duplicates import near_duplicates
from stratakeep.llm.quality import keep_good
from stratakeep.llm.sharding import shard_documents


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name: doc_id where it does, else a written row number."""
    name = unused(docs, "row_id")[0]
    ids = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if ids.rows == ids.ids:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return durable(docs.withColumn(name, F.monotonically_increasing_id()), "identified"), name


def without(rows: DataFrame, name: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose number ``name`` is not in the one column of ``gone``."""
    return rows.join(gone.toDF(name), name, "left_anti").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject.

    Null and empty texts go, as they fail the base rules; repeated rows are judged alike. No rows give
    none. Columns pass unchanged, whatever they are called.
    """
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id.

    Null and empty texts are no duplicates and stay. Of rows with null or repeated ids, the first written
    stays. No rows give none. Columns pass unchanged, whatever they are called.
    """
    rows, name = identified(docs)
    groups = near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), width=5, percent=80)
    # those that go are fewer than those that stay, and more likely small enough for a broadcast
    gone = durable(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "duplicates")
    return without(rows, name, gone, docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike. No rows give none, no
    items keep all. Columns pass unchanged, whatever they are called.
    """
    rows, name = identified(docs)
    found = contaminated(rows.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, name, durable(found.select("doc_id").distinct(), "contaminated"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, from never to three times.

    Null and empty texts have no words to take and go; a null source is a source. Repeated rows
    are documents of their own. No rows give none. Columns pass unchanged, whatever they are called.
    """
    rows, name = identified(docs)
    times, copy = unused(rows, "times", "copy")
    mixed = mix_sources(sized(rows.select(F.col(name).alias("doc_id"), "source", "text")))
    return times_taken(rows, name, mixed, times).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix; nulls and repeats are rows like any other, no rows give none."""
    return shard_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]
#: The posterior of the quality rules, the latent search and both hash orders have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, "stage")
    return docs
