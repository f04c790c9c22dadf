"""Similarity joins: batches, blocked all-pairs scores, face matches, bonuses, and the pipelines that fuse them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumen.functions import vectors as V
from lumen.operators.components import forest
from lumen.plans.durable import stored

#: Rows of a block, and of a slice of a block's product; the other block is cut into slices of WIDE rows.
BLOCK, WIDE = 1024, 4096
#: Beyond so many blocks they get larger instead, up to BYTES of doubles: a row is copied once for each block.
BLOCKS, BYTES = 24, 32 << 20
#: Pairs of two blocks leave their task in pieces of so many.
PIECE = 1 << 17


@dataclass(frozen=True)
class Settings:
    text_threshold: float = 0.9
    face_threshold: float = 0.46
    base_bonus: float = 0.1
    max_bonus: float = 0.3
    batch_size: int | None = 1000
    #: How texts are scored: bertscore_f1, bertscore_precision_recall (both need descriptions) or sbert_cosine (needs vectors).
    method: str = "bertscore_f1"


def row_index(df: DataFrame, *order: str) -> DataFrame:
    """Adds `idx`, the row's place in the order, without gathering rows: ranges are numbered, then shifted by the sizes before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the generated id are the partition, the lower ones count from 0 in it.
    local = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_before")


def batches(df: DataFrame, order: str, batch_size: int) -> DataFrame:
    """Adds `batch` from 0: rows in order, in max(1, n div batch_size) batches, the first ones one row longer."""
    rows = row_index(df, order)
    n = rows.count()
    k = max(1, n // batch_size)
    q, r = divmod(n, k)
    i = F.col("idx")
    return rows.withColumn("batch", F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1))).cast("int"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _tile(x: np.ndarray, y: np.ndarray, least: float, same: bool):
    """(i, j, cosine) of the rows of two blocks of unit vectors that reach `least`, slice by slice; each pair once if they are the same."""
    for s, e, score in _slices(x, y, same):
        i, j = np.nonzero(score >= least)
        if same:
            i, j = i[j + e > i + s], j[j + e > i + s]
        if len(i):
            yield i + s, j + e, score[i, j]


def _slices(x: np.ndarray, y: np.ndarray, same: bool):
    """(first row of x, first row of y, product) of the slices of two blocks; of one block only those that reach over the diagonal."""
    for s in range(0, len(x) if len(y) else 0, BLOCK):
        for e in range(0, len(y), WIDE):
            if not same or e + WIDE > s:
                yield s, e, x[s : s + BLOCK] @ y[e : e + WIDE].T


def _rows(df: DataFrame, id: str, vec: str, batch: str | None, *others: str, kind: str = "array<double>") -> DataFrame:
    """(id, v, batch, size, row): usable vectors, their number of places, and a number of the row."""
    columns = [F.col(id).alias("id"), F.col(vec).cast(kind).alias("v"), (F.col(batch) if batch else F.lit(0)).cast("int").alias("batch"), *others]
    return stored(df.select(*columns).where(V.usable(F.col("v"))).withColumns({"size": F.size("v"), "row": F.monotonically_increasing_id()}))


def _blocked(df: DataFrame, id: str, vec: str, batch: str | None, meet, schema: str, *others: str, fresh: str | None = None) -> DataFrame:
    """meet(table, table, same block) of every pair of blocks, as columns of the schema; the tables have id, v and the other columns.

    Rows are dealt by number to blocks of about BLOCK, vectors of different sizes to different ones; each pair of blocks of a
    batch meets in one task. A block is copied once for each other block of its batch. From BLOCKS blocks on they get larger
    instead, so what is shuffled grows with the rows (until a block has BYTES), and only the products are quadratic. With `fresh`, a column that is true for new rows, these have blocks of their own and only pairs of blocks with
    a new one meet: every pair of rows with a new end, and no other.
    """
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    rows = _rows(df, id, vec, batch, *others, *([F.col(fresh).alias("fresh")] if fresh else []), kind=kind)
    most = F.greatest(F.lit(BLOCK), F.floor(F.lit(BYTES // 8) / F.first("size")))
    return _met(in_blocks(rows, ["batch", "size"], BLOCK, bool(fresh), broadcast=not batch, most=most), meet, schema, *others)


def in_blocks(rows: DataFrame, group: list[str], size: int, fresh: bool, broadcast: bool = False, most: Column | None = None) -> DataFrame:
    """rows (row, fresh if asked for, ...) of each group with `block`, once for each `other` block they meet: blocks of about
    `size` rows, or BLOCKS larger ones of up to `most` rows, an aggregate."""
    new = F.col("fresh") if fresh else F.lit(True)

    def number(c):
        n = F.count_if(c)
        small = F.ceil(n / size)
        return (small if most is None else F.least(small, F.greatest(F.lit(BLOCKS), F.ceil(n / most)))).cast("int")

    sizes = rows.groupBy(*group).agg(number(new).alias("new"), number(~new).alias("old"))
    rows = rows.join(F.broadcast(sizes) if broadcast else sizes, group)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(new, deal("new")).otherwise(F.col("new") + deal("old")))
    last = F.when(new, F.col("new") + F.col("old")).otherwise(F.col("new")) - 1
    return rows.withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))


def _met(rows: DataFrame, meet, schema: str, *others: str) -> DataFrame:
    """The tables that meet() yields for the blocks that rows (batch, size, block, other, id, v, ...) are sent to, each pair of
    blocks in a task of its own."""
    rows = rows.select("batch", "size", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "v", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own, same = table["block"].to_numpy() == table["lo"][0].as_py(), table["lo"][0].as_py() == table["hi"][0].as_py()
        for part in meet(table.filter(pa.array(own)), table if same else table.filter(pa.array(~own)), same):
            yield from part.combine_chunks().to_batches(max_chunksize=PIECE)

    return rows.groupBy("batch", "size", "lo", "hi").applyInArrow(run, schema)


def _vectors(table: pa.Table) -> np.ndarray:
    if not table.num_rows:  # a block that no row was dealt to
        return np.zeros((0, 1))
    return _unit(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1))


def _pairs(least: float, kind: pa.DataType):
    """meet() that gives the pairs (a, b, score) of `least` or more."""

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        for i, j, s in _tile(_vectors(left), _vectors(right), least, same):
            yield _ordered(x[i], y[j], kind, s)

    return meet


def _ordered(a: np.ndarray, b: np.ndarray, kind: pa.DataType, score: np.ndarray | None = None) -> pa.Table:
    """(a, b, score if given) of pairs of different ids, the smaller first."""
    keep = np.asarray(a != b, bool)
    a, b = a[keep], b[keep]
    turn = np.asarray(a > b, bool)
    ends = {"a": pa.array(np.where(turn, b, a), kind), "b": pa.array(np.where(turn, a, b), kind)}
    return pa.table(ends if score is None else ends | {"score": pa.array(score[keep])})


def cosine_links(df: DataFrame, id: str, vec: str, least: float, strict: bool = False) -> DataFrame:
    """(a, b) with a < b that connect exactly what the pairs of `cosine_pairs` (`strict`: those over `least`) connect; a row need not
    be such a pair itself.

    A pair of blocks gives a forest, so there are at most as many rows as copies of vectors, not as many as pairs.
    """
    kind, df = _arrow(df, id), df.where(F.col(id).isNotNull())

    def meet(left: pa.Table, right: pa.Table, same: bool):
        ids, first = left["id"].to_numpy(), 0 if same else left.num_rows
        ids = ids if same else np.concatenate((ids, right["id"].to_numpy()))
        a = b = np.zeros(0, np.int64)
        for i, j, s in _tile(_vectors(left), _vectors(right), least, same):
            i, j = (i[s > least], j[s > least]) if strict else (i, j)
            a, b = np.concatenate((a, i)), np.concatenate((b, j + first))
            if len(a) > 4 * len(ids) + PIECE:
                a, b = forest(a, b)
        a, b = forest(a, b)
        yield _ordered(ids[a], ids[b], kind)

    return _blocked(df, id, vec, None, meet, _pair_schema(df, id).rsplit(",", 1)[0])


def cosine_pairs(df: DataFrame, id: str, vec: str, least: float, batch: str | None = None, fresh: str | None = None) -> DataFrame:
    """(a, b, score) with a < b for all pairs of rows with a cosine of `least` or more, within batches if given; with `fresh`, a
    column that is true for new rows, only pairs with a new end.

    One matrix product scores a pair of blocks, and only pairs over the threshold leave a task. Null ids and null, empty and
    zero vectors have no pairs, nor have vectors of different sizes; rows of a repeated id each count, but not with each
    other; ids of any ordered type keep it.
    """
    df = df.where(F.col(id).isNotNull())
    return _blocked(df, id, vec, batch, _pairs(least, _arrow(df, id)), _pair_schema(df, id), fresh=fresh)


def labelled_pairs(df: DataFrame, id: str, vec: str, label: str, least: float) -> DataFrame:
    """(a, b, score, label_a, label_b): the pairs of `cosine_pairs` with the labels of both rows, which travel with the blocks."""
    kind = _arrow(df, id)

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y, first = left["id"].to_numpy(), right["id"].to_numpy(), left.num_rows
        labels = pa.concat_arrays([left["label"].combine_chunks(), right["label"].combine_chunks()])
        for i, j, s in _tile(_vectors(left), _vectors(right), least, same):
            keep = np.asarray(x[i] != y[j], bool)
            i, j, s = i[keep], j[keep], s[keep]
            turn = np.asarray(x[i] > y[j], bool)
            own, other = labels.take(pa.array(np.where(turn, j + first, i))), labels.take(pa.array(np.where(turn, i, j + first)))
            yield _ordered(x[i], y[j], kind, s).append_column("label_a", own).append_column("label_b", other)

    of = df.schema[label].dataType.simpleString()
    return _blocked(df.where(F.col(id).isNotNull()), id, vec, None, meet, f"{_pair_schema(df, id)}, label_a {of}, label_b {of}", F.col(label).alias("label"))


def _arrow(df: DataFrame, id: str) -> pa.DataType:
    return to_arrow_type(df.schema[id].dataType)


def _pair_schema(df: DataFrame, id: str) -> str:
    kind = df.schema[id].dataType.simpleString()
    return f"a {kind}, b {kind}, score double"


def pair_moments(df: DataFrame, id: str, vec: str, batch: str | None = None) -> DataFrame:
    """One row: number, mean and population deviation of the cosines of all pairs; each pair of blocks gives three sums."""

    def meet(left: pa.Table, right: pa.Table, same: bool):
        n, total, square = 0, 0.0, 0.0
        for *_, score in _tile(_vectors(left), _vectors(right), -2.0, same):
            n, total, square = n + len(score), total + float(score.sum()), square + float(score @ score)
        yield pa.table({"n": [n], "total": [total], "square": [square]})

    sums = _blocked(df, id, vec, batch, meet, "n long, total double, square double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.sum("total").alias("t"), F.sum("square").alias("q"))
    mean = F.try_divide(F.col("t"), F.col("pairs"))
    return sums.select(mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("pairs")) - mean * mean, F.lit(0.0))).alias("std"), "pairs")


def _judged(least: float):
    """(first row of either block, score, whether it is `least` or more, equal labels, pairs that count) of two blocks in slices."""

    def slices(left: pa.Table, right: pa.Table, same: bool):
        x, y, a, b = _vectors(left), _vectors(right), left["label"].to_numpy(), right["label"].to_numpy()
        left_known, right_known = left["label"].is_valid().to_numpy(), right["label"].is_valid().to_numpy()
        for s, e, score in _slices(x, y, same):
            use = left_known[s : s + BLOCK, None] & right_known[None, e : e + WIDE]
            if same:
                use = use & ((e + np.arange(score.shape[1]))[None, :] > (s + np.arange(len(score)))[:, None])
            yield s, e, score, score >= least, np.asarray(a[s : s + BLOCK, None] == b[None, e : e + WIDE], bool), use

    return slices


def judged_counts(df: DataFrame, id: str, vec: str, label: str, least: float) -> DataFrame:
    """One row tp, tn, fp, fn, scored, n over all pairs of labelled vectors: a cosine of `least` or more predicts equal labels.

    Each pair of blocks gives four counts. Rows without a label or a usable vector take part in no pair.
    """

    def meet(left: pa.Table, right: pa.Table, same: bool):
        n = np.zeros(4, np.int64)
        for _, _, _, said, true, use in _judged(least)(left, right, same):
            n += [(cell & use).sum() for cell in (said & true, ~said & ~true, said & ~true, ~said & true)]
        yield pa.table({c: [x] for c, x in zip(("tp", "tn", "fp", "fn"), n.tolist())})

    cells = _blocked(df, id, vec, None, meet, "tp long, tn long, fp long, fn long", F.col(label).alias("label"))
    sums = cells.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")))
    return sums.withColumn("n", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).withColumn("scored", F.col("n"))


def wrong_pairs(df: DataFrame, id: str, vec: str, label: str, least: float) -> DataFrame:
    """(a, b, true_label, similarity_score, error) with a < b, only of the pairs that `judged_counts` has as fp (FP) or fn (FN)."""
    kind = _arrow(df, id)

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        for s, e, score, said, true, use in _judged(least)(left, right, same):
            i, j = np.nonzero((said != true) & use)
            a, b, true, score = x[i + s], y[j + e], true[i, j], score[i, j]
            turn = np.asarray(a > b, bool)
            error = pa.array(["FP", "FN"]).take(pa.array(true.astype(np.int32)))
            yield pa.table({"a": pa.array(np.where(turn, b, a), kind), "b": pa.array(np.where(turn, a, b), kind), "true_label": pa.array(true.astype(np.int32)), "similarity_score": pa.array(score), "error": error})

    pair = _pair_schema(df, id).rsplit(",", 1)[0]
    return _blocked(df.where(F.col(id).isNotNull()), id, vec, None, meet, f"{pair}, true_label int, similarity_score double, error string", F.col(label).alias("label"))


def z_pairs(df: DataFrame, id: str, vec: str, least: float, batch: str | None = None) -> DataFrame:
    """(a, b, score): pairs whose cosine lies `least` or more population deviations over the mean of all pairs."""
    mean, std, n = pair_moments(df, id, vec, batch).first()
    if not n:
        return cosine_pairs(df.limit(0), id, vec, 2.0, batch)
    found = cosine_pairs(df, id, vec, mean + least * (std + 1e-6) - 1e-9, batch)
    return found.withColumn("score", (F.col("score") - F.lit(mean)) / F.lit(std + 1e-6)).where(F.col("score") >= least)


def cosine_pairs_join(df: DataFrame, id: str, vec: str, least: float, batch: str) -> DataFrame:
    """The same as a join on the batch with higher-order functions; for short vectors in small batches."""
    rows = df.select(F.col(id).alias("id"), F.col(vec).alias("v"), F.col(batch).alias("batch")).where(V.usable(F.col("v")))
    a, b = rows.select(F.col("id").alias("a"), F.col("v").alias("x"), "batch"), rows.select(F.col("id").alias("b"), F.col("v").alias("y"), "batch")
    return a.join(b, "batch").where("a < b").select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)


def face_matches(faces: DataFrame, threshold: float, batch: str | None = None, fresh: str | None = None) -> DataFrame:
    """(a, b, score) of faces (face_id, image_id, embedding) with a cosine strictly above the threshold, same-image pairs included."""
    pairs = cosine_pairs(faces, "face_id", "embedding", threshold, batch, fresh)
    return pairs.where(F.col("score") > threshold)


def face_links(faces: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect what the matches of `face_matches` connect."""
    return cosine_links(faces, "face_id", "embedding", threshold, strict=True)


def image_matches(faces: DataFrame, matches: DataFrame) -> DataFrame:
    """(i, j, face_count) with i < j: matching faces of different images."""
    own = faces.select("face_id", "image_id")
    named = matches.join(own.withColumnsRenamed({"face_id": "a", "image_id": "ia"}), "a").join(own.withColumnsRenamed({"face_id": "b", "image_id": "ib"}), "b")
    return named.where("ia <> ib").groupBy(F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j")).agg(F.count("*").alias("face_count"))


def image_counts(faces: DataFrame, threshold: float) -> DataFrame:
    """(i, j, face_count) with i < j, as `image_matches` has of `face_matches`, for faces whose face_id is unique.

    Blocks carry the images and count their pairs themselves, so no match is shuffled, only counts of pairs of images.
    """
    kind = _arrow(faces, "image_id")

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y, p, q = left["id"].to_numpy(), right["id"].to_numpy(), left["image"].to_numpy(), right["image"].to_numpy()
        for i, j, s in _tile(_vectors(left), _vectors(right), threshold, same):
            keep = np.asarray((s > threshold) & (x[i] != y[j]), bool)
            pairs = _ordered(p[i[keep]], q[j[keep]], kind).group_by(["a", "b"]).aggregate([([], "count_all")])
            yield pairs.rename_columns(["i", "j", "face_count"])

    usable = faces.where("face_id is not null and image_id is not null").withColumnRenamed("image_id", "image")
    image = faces.schema["image_id"].dataType.simpleString()
    cells = _blocked(usable, "face_id", "embedding", None, meet, f"i {image}, j {image}, face_count long", F.col("image"))
    return cells.groupBy("i", "j").agg(F.sum("face_count").alias("face_count"))


def any_match(faces: DataFrame, threshold: float) -> bool:
    """Whether `image_counts` has a row; each pair of blocks says so in one."""

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y, p, q = left["id"].to_numpy(), right["id"].to_numpy(), left["image"].to_numpy(), right["image"].to_numpy()
        found = (((s > threshold) & (x[i] != y[j]) & (p[i] != q[j])).any() for i, j, s in _tile(_vectors(left), _vectors(right), threshold, same))
        yield pa.table({"hit": [any(found)]})

    usable = faces.where("face_id is not null and image_id is not null").withColumnRenamed("image_id", "image")
    return not _blocked(usable, "face_id", "embedding", None, meet, "hit boolean", F.col("image")).where("hit").isEmpty()


def bonus(count, s: Settings = Settings()):
    return F.least(F.lit(s.base_bonus) * count, F.lit(s.max_bonus))


def fuse(text: DataFrame, faces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(i, j, similarity_score, face_bonus, face_count): bonus first, then at most 1, then the threshold (>=).

    `text` needs every pair whose score plus the largest bonus can reach the threshold; pairs without faces get 0.
    """
    n = F.coalesce("face_count", F.lit(0))
    joined = text.join(faces, ["i", "j"], "left").select("i", "j", "score", n.cast("int").alias("face_count"), bonus(n, s).alias("face_bonus"))
    total = F.least(F.col("score") + F.col("face_bonus"), F.lit(1.0))
    return joined.select("i", "j", total.alias("similarity_score"), "face_bonus", "face_count").where(F.col("similarity_score") >= s.text_threshold)


def fuse_after_threshold(text: DataFrame, faces: DataFrame, s: Settings = Settings(text_threshold=0.8, face_threshold=0.85)) -> DataFrame:
    """The older order: the threshold on the text score alone, then bonus and clamp."""
    return fuse(text.where(F.col("score") >= s.text_threshold), faces, s)


def _albums(images: DataFrame, faces: DataFrame) -> DataFrame:
    """Images (image_id, embedding) with `faces`, the usable vectors of their faces (face_id, image_id, embedding) in a list."""
    own = faces.where("face_id is not null").where(V.usable(F.col("embedding")))
    lists = own.groupBy(F.col("image_id")).agg(F.collect_list(F.struct(F.col("face_id").alias("id"), F.col("embedding").alias("v"))).alias("faces"))
    return images.where("image_id is not null").join(lists, "image_id", "left")


def _faces(table: pa.Table) -> dict[int, tuple]:
    """(ids, places of their images in the block, unit vectors) of the faces of a block's images, by the size of their vectors."""
    lists = table["faces"].combine_chunks()
    flat, at = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    ids, v = flat.field("id").to_numpy(zero_copy_only=False), flat.field("v")
    sizes, out = v.value_lengths().to_numpy(), {}
    for size in np.unique(sizes).tolist():
        k = np.flatnonzero(sizes == size)
        x = v.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(k), size)
        out[size] = ids[k], at[k], _unit(x)
    return out


def _face_cells(left: pa.Table, right: pa.Table, same: bool, threshold: float, verify: bool):
    """(keys, counts): the pairs of images of two blocks that share faces, as row * rows of the other block + other row, in order.

    Of one block a pair is counted under the key of its smaller row."""
    own, other, width = _faces(left), _faces(right), right.num_rows
    cells = [np.zeros(0, np.int64)]
    for size in own.keys() & other.keys():
        (a, p, x), (b, q, y) = own[size], other[size]
        for i, j, s in _tile(x, y, threshold, same):
            keep = np.asarray((s > threshold) & (a[i] != b[j]), bool)
            u, w = p[i[keep]], q[j[keep]]
            cells.append(np.minimum(u, w) * width + np.maximum(u, w) if same else u * width + w)
    keys, counts = np.unique(np.concatenate(cells), return_counts=True)
    return keys, np.minimum(counts, 1) if verify else counts


def fused_pairs(images: DataFrame, faces: DataFrame, s: Settings = Settings(), shift: tuple[float, float] | None = None, verify: bool = False) -> DataFrame:
    """What `fuse` gives of all pairs of images by their vectors and of `image_counts` (`verify`: of `verified`), for images
    (image_id, embedding) whose ids are unique.

    The faces of an image travel with its vector, and two blocks fuse their pairs themselves: neither scores nor counts are
    shuffled or joined. `shift` (mean, deviation) makes scores of the cosines.
    """
    kind, least = _arrow(images, "image_id"), s.text_threshold - s.max_bonus
    mean, unit = shift or (0.0, 1.0)

    def meet(left: pa.Table, right: pa.Table, same: bool):
        x, y, width = left["id"].to_numpy(), right["id"].to_numpy(), right.num_rows
        keys, counts = _face_cells(left, right, same, s.face_threshold, verify)
        for i, j, score in _tile(_vectors(left), _vectors(right), mean + least * unit - 1e-9, same):
            score = (score - mean) / unit if shift else score
            cell = i * width + j
            at = np.minimum(np.searchsorted(keys, cell), max(len(keys) - 1, 0))
            n = np.where(keys[at] == cell, counts[at], 0) if len(keys) else np.zeros(len(cell), np.int64)
            extra = np.minimum(s.base_bonus * n, s.max_bonus)
            total = np.minimum(score + extra, 1.0)
            keep = np.asarray((score >= least) & (total >= s.text_threshold) & (x[i] != y[j]), bool)
            found = _ordered(x[i[keep]], y[j[keep]], kind, total[keep])
            yield found.rename_columns(["i", "j", "similarity_score"]).append_column("face_bonus", pa.array(extra[keep])).append_column("face_count", pa.array(n[keep].astype(np.int32)))

    id = images.schema["image_id"].dataType.simpleString()
    return _blocked(_albums(images, faces), "image_id", "embedding", None, meet, f"i {id}, j {id}, similarity_score double, face_bonus double, face_count int", F.col("faces"))


def fused_z(images: DataFrame, faces: DataFrame, s: Settings) -> DataFrame:
    """What `fuse_z` gives of `z_pairs` and `image_counts`, see `fused_pairs`; the clamp to 1 holds only if faces match at all."""
    mean, std, n = pair_moments(images, "image_id", "embedding").first()
    if not n:
        return fused_pairs(images.limit(0), faces, s)
    if not any_match(faces, s.face_threshold):
        z = z_pairs(images, "image_id", "embedding", s.text_threshold)
        return fuse_z(z.select(F.col("a").alias("i"), F.col("b").alias("j"), "score"), z.limit(0), s)
    return fused_pairs(images, faces, s, (mean, std + 1e-6))


def verified(matches: DataFrame) -> DataFrame:
    """At most one match for each image pair, as a verifier of whole images counts."""
    return matches.withColumn("face_count", F.least("face_count", F.lit(1)))


def fuse_z(z: DataFrame, faces: DataFrame, s: Settings = Settings(text_threshold=0.8, face_threshold=0.85)) -> DataFrame:
    """Fusion of z-scores (i, j, score): the clamp to 1 holds only if there are faces at all."""
    if faces.isEmpty():
        return z.where(F.col("score") >= s.text_threshold).select("i", "j", F.col("score").alias("similarity_score"), F.lit(0.0).alias("face_bonus"), F.lit(0).alias("face_count"))
    return fuse(z, faces, s)


def write_back(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Images (image_path, face_embeddings) with the match_id of groups (image_path, pos, match_id) set in each face, by position."""
    faces = images.select("image_path", F.posexplode("face_embeddings").alias("pos", "f")).join(groups, ["image_path", "pos"], "left")
    lists = faces.groupBy("image_path").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("f.embedding").alias("embedding"), "match_id").alias("face")))).alias("l"))
    joined = images.drop("face_embeddings").join(lists.select("image_path", F.transform("l", lambda x: x["face"]).alias("face_embeddings")), "image_path", "left")
    return joined.select(*images.columns)
