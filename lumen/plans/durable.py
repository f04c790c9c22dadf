"""Tables in the folder that driver and executors share, and joins whose hot keys are split."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys can hold more than one part in HOT_KEYS of all rows: the bound of what `join_hot` broadcasts.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session, where it is unset, gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir().get()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends there, a lost executor costs nothing.

    Plans made from the table may run at any later time, so it stays until `clean` or until the folder is cleaned. What this
    returned is not written again.
    """
    if getattr(df, "_stored", False) and not partition_by:
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored = True
    return kept


def clean(spark: SparkSession) -> None:
    """Removes all tables that `stored` wrote in the session's shared folder; frames made from them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, known: DataFrame, key: str, counts: DataFrame, total: int, by: Column, least: int = 256, how: str = "inner") -> DataFrame:
    """rows joined with known on key, with the rows of hot keys dealt to many tasks.

    `counts` has (key, n), the number of rows of each key; `total` is their sum. A key of more than max(least, total /
    HOT_KEYS) rows is hot: its rows are dealt by `by`, a long of each row, and what is known of it is repeated as often.
    At most HOT_KEYS keys can be hot, whatever the size, so their table is broadcast.
    """
    size = max(least, total // HOT_KEYS)
    if total <= size:
        return rows.join(known, key, how)
    hot = F.broadcast(counts.where(F.col("n") > size).select(F.col(key), F.ceil(F.col("n") / size).cast("int").alias("_bins")))
    bins = F.coalesce("_bins", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(by, bins.cast("long")).cast("int")).drop("_bins")
    right = known.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), bins - 1))).drop("_bins")
    return left.join(right, [key, "_salt"], how).drop("_salt")
