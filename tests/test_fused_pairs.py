"""Scores of texts and counts of faces are fused in the blocks, with what the joined tables give."""

import numpy as np
import pytest

from lumen import queries as Q
from lumen.operators import similarity as S


def album(spark):
    rng = np.random.default_rng(6)
    images = [(f"i{k:02}", rng.normal(size=3).tolist()) for k in range(60)] + [("none", None), (None, [1.0, 0.0, 0.0]), ("two", [1.0, 2.0])]
    faces = [(k, f"i{int(rng.integers(50)):02}", rng.normal(size=3 if k % 4 else 2).tolist()) for k in range(150)]
    faces += [(3, "i50", [1.0, 0.1, 0.0]), (3, "i51", [1.0, 0.1, 0.0]), (None, "i52", [1.0, 0.0, 0.0]), (900, None, [1.0, 0.0, 0.0]), (901, "i53", None), (902, "lost", [1.0, 0.0, 0.0])]
    return spark.createDataFrame(images, "image_id string, embedding array<double>"), spark.createDataFrame(faces, "face_id long, image_id string, embedding array<float>")


def rows(df):
    return sorted((r.i, r.j, round(r.similarity_score, 9), round(r.face_bonus, 9), r.face_count) for r in df.collect())


@pytest.mark.parametrize("block", [1024, 16])
def test_blocks_fuse_as_the_tables_do(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    images, faces = album(spark)
    s = S.Settings(text_threshold=0.6, face_threshold=0.7)
    text = S.cosine_pairs(images, "image_id", "embedding", 0.3).withColumnsRenamed({"a": "i", "b": "j"})
    counts = S.image_counts(faces, 0.7)
    assert rows(S.fused_pairs(images, faces, s)) == rows(S.fuse(text, counts, s)) != []
    assert rows(S.fused_pairs(images, faces, s, verify=True)) == rows(S.fuse(text, S.verified(counts), s))
    for some in (faces, faces.limit(0)):
        z = S.z_pairs(images, "image_id", "embedding", 0.3).withColumnsRenamed({"a": "i", "b": "j"})
        assert rows(S.fused_z(images, some, s)) == rows(S.fuse_z(z, S.image_counts(some, 0.7), s)) != []


@pytest.mark.parametrize("name", ["v01_text_and_faces", "v02_verify", "v03_z_scores"])
def test_scores_and_counts_are_not_joined(spark, sf, name):
    assert "LeftOuter" not in Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
