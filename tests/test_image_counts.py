"""Matches of images counted in the blocks: nothing but counts is shuffled."""

import random

import pytest

from lumen.operators import similarity as S


@pytest.mark.parametrize("key", ["long", "string"])
def test_image_counts_equal_joined_matches(spark, monkeypatch, key):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(5)
    name = (lambda k: k) if key == "long" else (lambda k: f"img{k:03}")
    rows = [(k, name(k // 4) if k % 29 else None, [rng.gauss(0, 1) for _ in range(4)]) for k in range(150)] + [(200, name(3), None), (201, name(4), [0.0] * 4), (None, name(5), [1.0] * 4)]
    faces = spark.createDataFrame(rows, f"face_id long, image_id {key}, embedding array<float>")
    want = sorted(map(tuple, S.image_matches(faces, S.face_matches(faces, 0.6)).collect()))
    made = S.image_counts(faces, 0.6)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 300 and max(w[2] for w in want) > 1
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins(made) < joins(S.image_matches(faces, S.face_matches(faces, 0.6)))  # matches meet no table of faces
