"""Session helpers shared by all operators: tables, lineage cuts, spreading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where it is unset a temporary folder is made, but only for a master that
    runs in this one process, as in tests; on a cluster other machines couldn't
    read it, and so that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not named and held.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        named = tempfile.mkdtemp(prefix="intentlake-")
    if held.isEmpty():
        context.setCheckpointDir(named)
    return (named or held.get()).rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing lies yet."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it from there.

    This cuts its lineage; unlike cached blocks the files outlive any executor,
    and later plans read only the columns they need.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.

    Only inputs of less than one split per core are moved, so a large table is
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str, columns: list[str], when: str = "loaded_at") -> DataFrame:
    """One row per `key` of a table in which rows come again; the latest wins.

    All `columns` are shuffled by the key, so project long texts to what is
    wanted of them first, or use newest(). A null key is a key of its own. A
    table without the time column keeps the greatest row, so that the choice
    doesn't depend on the partitioning.
    """
    order = [F.col(when)] if when in df.columns else []
    rest = [c for c in columns if c != key]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


#: Keys of rows that come again up to which their list is sent to all executors (at about 16 bytes each, 16 MB).
MOST_SENT = 1_000_000


def newest(df: DataFrame, key: str, columns: list[str], when: str = "loaded_at") -> DataFrame:
    """The rows of latest(), for wide columns: only rows whose key comes again are shuffled.

    The keys that come again are found by the key column alone and written
    down; up to MOST_SENT of them are sent to all executors, more meet the
    table in a join by the key.
    """
    again = store(df.groupBy(key).count().where(F.col("count") > 1).select(F.col(key).alias("_again")))
    side = F.broadcast(again) if again.count() <= MOST_SENT else again
    comes_again = F.col(key).eqNullSafe(F.col("_again"))
    kept = [key, *[c for c in columns if c != key]]
    once = df.join(side, comes_again, "left_anti").select(*kept)
    return once.unionByName(latest(df.join(side, comes_again, "left_semi"), key, kept, when))
