"""Tables in the folder that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of hot keys has at most so many rows, whatever the input: a key is hot only above that share of all rows.
MOST_HOT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none (unit tests on one machine) gets a folder under the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and a
    nondeterministic id column becomes fixed. Folders are named at random. ``discard`` removes one whose readers
    have all been written themselves; those that a lazily evaluated result still reads are left to the
    cluster's clean-up of the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, by: str, how: str = "inner", least: int = 256) -> DataFrame:
    """Join ``rows`` with ``table``, which has one row for a key, without a hot task.

    ``table`` has in column ``n`` how many rows have the key (or an upper estimate). A key with more than
    ``least`` of them, and more than 1 of ``MOST_HOT`` of all, is dealt to several tasks: its rows by the
    hash of column ``by``, its row of the table once to each. The list of such keys is what is
    broadcast: by their definition there are at most ``MOST_HOT``.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    limit = max(least, -(-(total or 0) // MOST_HOT))
    if (most or 0) <= limit:
        return rows.join(table, keys, how)
    hot = table.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    some = F.broadcast(hot)
    left = rows.join(some, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = table.join(some, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, small: int = 128 << 20) -> DataFrame:
    """Deal out the rows of a small table that lies in fewer files than there are cores; any other table stays as it is.

    A file below ``small`` bytes is mostly one row group, so one task would read it all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < small and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
