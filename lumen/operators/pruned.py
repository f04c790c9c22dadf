"""Exact similarity join that rules out blocks of vectors by angles.

Angles obey the triangle inequality: two vectors are at least as far apart as their angles to any third one, a pivot,
differ. Vectors are put in order by their nearest pivot and the angle to it and cut into blocks of equal size, so that a
block's vectors lie together and no pivot makes a large block. A block knows the range of its angles to every pivot; two
blocks whose ranges lie further apart at any pivot than the threshold allows have no pair and never meet. All other
blocks meet as in `similarity`, so the pairs are those of the plain join, whatever the pivots are.

Each pair of blocks that meets is a group of its own, so more than MOST blocks would only cost: from there on blocks get
larger instead, and the number of groups does not grow with the rows.

Pivots come from a sample of SAMPLE vectors of each common size (a documented bound: they decide about speed only). Ranges
of blocks are compared in tiles of TILE blocks, dealt over the tasks; nothing but the sample passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.operators import similarity as S
from lumen.plans.durable import stored

#: Vectors from which pivots are chosen; sizes of vectors beyond the commonest few have no pivots and are not pruned.
SAMPLE, SIZES, PIVOTS, TILE = 1024, 4, 32, 2048
#: Blocks of the vectors of one size in a batch, if these are more than MOST blocks of the size asked for.
MOST = 256
#: What the arithmetic of angles may be off, in radians.
SLACK = 1e-6


def choose(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by size of vector: from a sample, one after another the vector that is furthest from those chosen."""
    common = [r["size"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(SIZES).collect()]
    out = {}
    for size in common:
        found = rows.where(F.col("size") == size).select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
        x = S._vectors(found)
        picked, nearest = [0], x @ x[0]
        while len(picked) < min(pivots, len(x)) and nearest.min() < 1 - 1e-9:
            picked.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[picked[-1]])
        out[size] = x[picked]
    return out


def placed(rows: DataFrame, pivots: dict[int, np.ndarray], block: int) -> DataFrame:
    """rows (id, v, batch, size, row) with `angles` to the pivots, and `block`: rows by nearest pivot and angle, cut evenly."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            near, far, angles = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), [b""] * b.num_rows
            sizes = b.column("size").to_numpy()
            for size, p in sent.value.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    x = S._vectors(pa.Table.from_batches([b.take(pa.array(at))]))
                    angle = np.arccos(np.clip(x @ p.T, -1, 1))
                    near[at] = angle.argmin(1)
                    far[at] = angle.min(1)
                    for k, a in zip(at, angle):
                        angles[k] = a.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far), pa.array(angles, pa.binary())], [*b.schema.names, "near", "far", "angles"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "v", "batch", "size", "row").mapInArrow(run, f"id {kind}, v array<double>, batch int, size int, row long, near int, far double, angles binary")
    numbered = stored(S.row_index(found, "batch", "size", "near", "far", "row"))
    first = numbered.groupBy("batch", "size").agg(F.min("idx").alias("first"), F.greatest(F.lit(block), F.ceil(F.count("*") / MOST)).alias("each"))
    return numbered.join(first, ["batch", "size"]).withColumn("block", F.floor((F.col("idx") - F.col("first")) / F.col("each")).cast("int")).drop("idx", "first", "each", "near", "far", "row")


def ranges(rows: DataFrame) -> DataFrame:
    """(batch, size, block, low, high): the least and largest angle to every pivot, packed as doubles."""

    def run(table: pa.Table) -> pa.Table:
        a = np.frombuffer(b"".join(table["angles"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        first = {c: table[c][:1] for c in ("batch", "size", "block")}
        low, high = (a.min(0), a.max(0)) if a.shape[1] else (a[0], a[0])
        return pa.table(first | {"low": pa.array([low.tobytes()]), "high": pa.array([high.tobytes()])})

    return stored(rows.select("batch", "size", "block", "angles").groupBy("batch", "size", "block").applyInArrow(run, "batch int, size int, block int, low binary, high binary"))


def meeting(known: DataFrame, least: float) -> DataFrame:
    """(batch, size, lo, hi) of the blocks (ranges) that may hold a pair with a cosine of `least` or more, lo <= hi."""
    limit = math.acos(min(1.0, max(-1.0, least))) + SLACK

    def run(table: pa.Table) -> pa.Table:
        tile, lo = table["tile"].to_numpy(), table["left"][0].as_py()
        same = lo == table["right"][0].as_py()
        left, right = table.filter(pa.array(tile == lo)), table if same else table.filter(pa.array(tile != lo))
        read = lambda t, c: np.frombuffer(b"".join(t[c].to_pylist()), np.float64).reshape(t.num_rows, -1)
        low, high, names = read(right, "low"), read(right, "high"), right["block"].to_numpy()
        x, y = [], []
        for name, a, b in zip(left["block"].to_pylist(), read(left, "low"), read(left, "high")):
            apart = np.maximum(low - b, a - high).max(1) if low.shape[1] else np.zeros(len(names))
            other = names[(apart <= limit) & ((names >= name) if same else True)]
            x.append(np.minimum(name, other))
            y.append(np.maximum(name, other))
        x, y = np.concatenate(x).astype(np.int32), np.concatenate(y).astype(np.int32)
        return pa.table({c: pa.array(np.full(len(x), table[c][0].as_py(), np.int32)) for c in ("batch", "size")} | {"lo": pa.array(x), "hi": pa.array(y)})

    rows = known.withColumn("tile", F.floor(F.col("block") / TILE).cast("int"))
    tiles = rows.groupBy("batch", "size").agg(F.max("tile").alias("last"))
    rows = rows.join(tiles, ["batch", "size"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    rows = rows.withColumns({"left": F.least("tile", "other"), "right": F.greatest("tile", "other")}).drop("other")
    return stored(rows.groupBy("batch", "size", "left", "right").applyInArrow(run, "batch int, size int, lo int, hi int"))


def prepare(df: DataFrame, id: str, vec: str, least: float, batch: str | None = None, block: int = S.BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in blocks, the blocks' ranges, and which blocks meet."""
    rows = S._rows(df.where(F.col(id).isNotNull()), id, vec, batch)
    rows = stored(placed(rows, choose(rows, pivots), block))
    known = ranges(rows)
    return rows, known, meeting(known, least)


def cosine_pairs(df: DataFrame, id: str, vec: str, least: float, batch: str | None = None, block: int = S.BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The same rows (a, b, score) as `similarity.cosine_pairs`, without work on blocks that cannot have a pair."""
    rows, _, met = prepare(df, id, vec, least, batch, block, pivots)
    both = met.select("batch", "size", F.col("lo").alias("block"), F.col("hi").alias("other")).unionByName(met.where("lo < hi").select("batch", "size", F.col("hi").alias("block"), F.col("lo").alias("other")))
    sent = rows.drop("angles").join(both, ["batch", "size", "block"])
    return S._met(sent, S._pairs(least, S._arrow(df, id)), S._pair_schema(df, id))


def pruning(df: DataFrame, id: str, vec: str, least: float, batch: str | None = None, block: int = S.BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row: blocks, block_pairs, met and the share of pairs of blocks that are skipped."""
    _, known, met = prepare(df, id, vec, least, batch, block, pivots)
    sizes = known.groupBy("batch", "size").agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.coalesce(F.sum(F.expr("n * (n + 1) div 2")), F.lit(0)).alias("block_pairs"))
    counts = all_.crossJoin(F.broadcast(met.agg(F.count("*").alias("met"))))  # one row each
    return counts.withColumn("skipped", 1 - F.try_divide(F.col("met"), F.col("block_pairs")))
