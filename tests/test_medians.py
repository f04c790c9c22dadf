"""Medians over neighbours are found where the neighbours lie, without a row for each edge and tag."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import graph as G


@pytest.mark.parametrize("meet", [1 << 21, 7])
def test_medians_of_lists_are_those_of_joined_rows(spark, monkeypatch, meet):
    monkeypatch.setattr(G, "MEET", meet)
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (160, 2)).tolist() if p[0] != p[1]}
    rows = [(f"n{a:02}", f"n{b:02}", float(rng.uniform(0.1, 1))) for a, b in pairs]
    e = spark.createDataFrame(rows + rows[:9], "a string, b string, weight double")  # some edges twice
    conf = spark.createDataFrame([(f"n{k % 45:02}", f"t{k % 4}", float(rng.integers(1, 9)) / 8) for k in range(0, 130, 3)], "node string, tag string, conf double")
    near = G.neighbours(e)
    want = near.join(conf, near.dst == conf.node).groupBy("src", "tag").agg(F.median("conf").alias("conf"))
    made = G.medians(G.near_lists(e), conf)
    key = lambda df: sorted((r[0], r[1], round(r[2], 12)) for r in df.collect())
    assert key(made) == key(want) != []
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert G.medians(G.near_lists(e), conf.limit(0)).count() == 0
