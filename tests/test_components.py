"""Rounds of the component search, and both ways of a round, against plain union-find."""

import random

import pytest

from lumen.operators import components as C


def by_hand(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.fixture
def written(monkeypatch):
    tables = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df: tables.append(1) or keep(df))
    return tables


def test_stars_need_no_round(spark, written):
    """Whichever end is written first; no further round and table only to see that nothing changes."""
    edges = [(1, 5), (6, 1), (1, 7), (9, 8)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == by_hand(edges) and len(written) == 1


@pytest.mark.parametrize("hub", [C.HUB, 3])
def test_random_graphs(spark, monkeypatch, hub):
    """Chains, hubs, repeated and turned edges; with hubs dealt out and without."""
    monkeypatch.setattr(C, "HUB", hub)
    draw = random.Random(3)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(200, k) for k in range(201, 230)] + [(k + 1, k) for k in range(300, 330)]
    edges = [e for e in edges if e[0] != e[1]]
    edges += [(b, a) for a, b in edges[:10]] + edges[:5]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == by_hand(edges)
