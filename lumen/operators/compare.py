"""The live comparison of images: texts by a method, faces, fusion; all of it, or only pairs with a new end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.operators import bertscore, pruned
from lumen.operators import similarity as S
from lumen.plans.durable import stored


def text_pairs(images: DataFrame, least: float, s: S.Settings = S.Settings(), token_vectors: DataFrame | None = None, batch: str | None = None, fresh: str | None = None) -> DataFrame:
    """(i, j, score) of images (image_id, description or embedding) whose texts score `least` or more by the method of the settings.

    sbert_cosine takes the vectors in `embedding`; the others match the tokens of `description`, softly by token_vectors if
    given. Without batches vectors meet in a join that rules out blocks by angles. With `fresh` only pairs with a new end.
    """
    if s.method == "sbert_cosine":
        plain = batch or fresh
        found = S.cosine_pairs(images, "image_id", "embedding", least, batch, fresh) if plain else pruned.cosine_pairs(images, "image_id", "embedding", least)
    else:
        found = bertscore.all_pairs(images, "image_id", "description", least, s.method, token_vectors, batch, fresh=fresh)
    return found.select(F.col("a").alias("i"), F.col("b").alias("j"), "score")


def compare_all(images: DataFrame, faces: DataFrame, s: S.Settings = S.Settings(), token_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The live comparison of images (image_id, description or embedding) and their faces (face_id, image_id, embedding), batch by batch.

    Gives (i, j, similarity_score, face_bonus, face_count) and the matches (a, b, score) of faces, both only within batches.
    """
    rows = stored(S.batches(images, "image_id", s.batch_size) if s.batch_size else images.withColumn("batch", F.lit(0)))
    batch = "batch" if s.batch_size else None
    text = text_pairs(rows, s.text_threshold - s.max_bonus, s, token_vectors, batch)
    matches = stored(S.face_matches(faces.join(rows.select("image_id", "batch"), "image_id"), s.face_threshold, "batch"))
    return S.fuse(text, S.image_matches(faces, matches), s), matches


def compare_new(images: DataFrame, faces: DataFrame, s: S.Settings = S.Settings(), token_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As `compare_all` without batches, but only of pairs with a new end: images and faces have `fresh`, true for new ones.

    What earlier comparisons gave stays as it is, so runs over parts of the images, one after another, add up to one run.
    """
    text = text_pairs(images, s.text_threshold - s.max_bonus, s, token_vectors, fresh="fresh")
    matches = stored(S.face_matches(faces, s.face_threshold, fresh="fresh"))
    return S.fuse(text, S.image_matches(faces, matches), s), matches
