"""Helpers that several corpus operators share: Arrow batches, hold-out folds, bounded samples for classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.plans.durable import stored

#: Rows in an Arrow batch: whole texts are long, and two Python workers share an executor's memory.
BATCH = 512
#: What a sample's features may take on the driver, in indices of four bytes.
FEATURES = 16_000_000
#: What of it goes to the driver at once: a task's result is held several times there, in the heap and beside it.
PIECE = 2_000_000


def small_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Bounds the rows that Python workers hold at once, for this session; it keeps a smaller bound of its own.

    The bound must hold when the query runs, which is after it is made, so it cannot be set back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the columns asked for."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("*",))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, skip_fold: int = 0) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled rows outside the hold-out fold, those with the smallest hashes.

    Null ids or labels are left out; of repeated labels of an id the largest counts.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != skip_fold))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def sampled(rows: DataFrame, indices: Callable[[str | None], np.ndarray], limit: int, budget: int = FEATURES) -> tuple[list[np.ndarray], np.ndarray]:
    """(indices of each row, y) of a bounded sample of rows (doc_id, text, y): at most `limit` rows and `budget` indices.

    Rows are taken by the hash of id and text until either bound is met, so the sample is the same at every run, repeated
    ids do not enlarge it, and very long texts only shorten it. Texts are read whole.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([indices(t.as_py()).astype(np.int32).tobytes() for t in b.column(1)], pa.binary())], ["at", "y", "idx"])

    at = F.xxhash64(F.xxhash64("doc_id"), "doc_id", "text")
    found = stored(rows.select(at.alias("at"), "text", F.col("y").cast("int").alias("y")).mapInArrow(run, "at long, y int, idx binary"))
    order = ["at", "y", "idx"]
    sizes = found.select(*order).orderBy(*order).limit(limit).select("at", F.length("idx").alias("n")).toArrow()
    total = np.cumsum(sizes["n"].to_numpy()) // 4
    n = int(np.searchsorted(total, budget, "right"))
    if not n:
        return [], np.zeros(0, np.int64)
    # One block for all rows: it goes back to the system at once, unlike thousands of small ones.
    flat, held, y, after, ats = np.empty(total[n - 1], np.int32), [], [], None, sizes["at"].to_numpy()
    while len(held) < n:  # rows of the same hash are one piece
        last = int(ats[max(len(held), int(np.searchsorted(total[:n], (total[len(held) - 1] if held else 0) + PIECE, "right")) - 1)])
        more = found.where(F.col("at") <= last) if after is None else found.where((F.col("at") > after) & (F.col("at") <= last))
        got = more.orderBy(*order).limit(n - len(held)).toArrow()
        for x in got["idx"]:
            k = len(held)
            held.append(flat[total[k - 1] if k else 0 : total[k]])
            held[k][:] = np.frombuffer(x.as_buffer(), np.int32)
        y.append(got["y"].to_numpy().astype(np.int64))
        after = last
    return held, np.concatenate(y)
