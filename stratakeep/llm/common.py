"""Durable intermediate tables and null-safe input handling shared by the corpus operators."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path of each table that is still there, and the file system handles that delete it, also after the session.
_written: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where it is unset, a temporary one on a local master; on a cluster, whose machines share no temporary folder, an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="stratakeep-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def owned(spark: SparkSession, path: str) -> str:
    """Note that ``path`` is to be deleted by :func:`discard` or at the end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written[path] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs a re-read and no
    recomputation, and values drawn while writing (row numbers) never change afterwards. The files
    go with :func:`discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = owned(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    fs, where = _written.pop(path)
    fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`durable` that nothing will read again."""
    for df in tables:
        if getattr(df, "stored_at", None) in _written:
            _delete(df.stored_at)


def forget_tables() -> None:
    """Delete all tables that are left; also done at exit, whether the session has been stopped or not."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone; the others are tried all the same
            continue


atexit.register(forget_tables)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as no column of ``df`` needs to clash, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcast ``value``, of bounded size, with its classes, so that workers need not import them."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent: Broadcast):
    return pickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_totals(cells: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier cells of the same group, for a table of small, bounded groups."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def block_sums(parts: DataFrame, add, blocks: int, tasks: int = 64) -> DataFrame:
    """Sums by ``block`` of what each task has added up, in two levels.

    Parts of about so many tasks are summed first, wherever Spark deals them, and their sums by block after that, so
    the tasks of the last level read one part from each group and not one from every task. ``add`` takes and gives
    Arrow batches of the same columns and merges the rows of a block.
    """
    group = F.floor(F.spark_partition_id() / tasks)
    once = parts.withColumn("group", group).repartition("block", "group").drop("group").mapInArrow(add, parts.schema)
    return once.repartition(blocks, "block").mapInArrow(add, parts.schema)
