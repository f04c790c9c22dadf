"""Operators that must hold at size, against brute force on small graphs and vectors with odd rows."""

from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import graph as G
from lumen.operators import hops as H
from lumen.operators import pruned as P
from lumen.operators import similarity as S
from lumen.operators import tags as T
from lumen.plans import durable as D
from lumen.sources import sinks


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    return [(f"n{a:03}", f"n{b:03}", 0.5 + (a * b % 7) / 10) for a, b in sorted(pairs)]


def brute_hops(rows):
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        far, line = {s: 0}, deque([s])
        while line:
            v = line.popleft()
            for u in near[v]:
                if u not in far:
                    far[u] = far[v] + 1
                    line.append(u)
        out[s] = (len(far), sum(far.values()), round(sum(1 / d for d in far.values() if d), 9))
    return out


@pytest.mark.parametrize("block,hub", [(64, 4096), (4096, 2)])
def test_hops_equal_searching_from_every_node(spark, monkeypatch, block, hub):
    """Two components, a chain, a hub, an edge twice and a loop; blocks of sources; hub edges dealt out."""
    monkeypatch.setattr(H, "HUB", hub)
    rows = random_graph(2, 90, 130) + [(f"z{k:02}", f"z{k + 1:02}", 1.0) for k in range(4)] + [("hub", f"n{k:03}", 0.4) for k in range(0, 90, 3)]
    e = frame(spark, rows + rows[:3] + [("hub", "hub", 1.0)])
    got = {r.node: (r.reached, r.total, round(r.inverse, 9)) for r in H.hops(G.both_ways(e), G.nodes(e), block).collect()}
    assert got == brute_hops(rows)
    assert H.hops(G.both_ways(e).limit(0), G.nodes(e).limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [4, 10**6])
def test_betweenness_by_blocks_of_sources(spark, monkeypatch, pairs):
    e = frame(spark, random_graph(4, 9, 12))
    local = {r.node: r.score for r in G.betweenness(e).collect()}
    monkeypatch.setattr(G, "PATH_EDGES", 0)
    monkeypatch.setattr(G, "PAIRS", pairs * 9)
    assert {r.node: r.score for r in G.betweenness(e).collect()} == pytest.approx(local)


def test_rank_of_nodes_that_pass_nothing_on(spark, monkeypatch):
    rows = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 0.0), ("d", "e", None), ("a", "c", 2.0)]
    found = []
    for most in (5_000_000, 0):
        monkeypatch.setattr(G, "LOCAL_EDGES", most)
        found.append({r.node: r.score for r in G.pagerank(frame(spark, rows), tol=1e-12).collect()})
        assert abs(sum(found[-1].values()) - 1) < 1e-9
        assert {r.node for r in G.eigenvector(frame(spark, rows)).collect()} == set("abcde")
        assert G.pagerank(frame(spark, rows).limit(0)).count() == 0
    assert found[0] == pytest.approx(found[1])
    n = {"a": {"b": 1, "c": 2}, "b": {"a": 1, "c": 0.5}, "c": {"b": 0.5, "a": 2}, "d": {}, "e": {}}
    x = dict.fromkeys(n, 0.2)
    for _ in range(300):
        lost = x["d"] + x["e"]
        x = {v: 0.15 / 5 + 0.85 * (lost / 5 + sum(x[u] * w[v] / sum(w.values()) for u, w in n.items() if v in w)) for v in n}
    assert found[0] == pytest.approx(x)


def test_neighbours_of_hubs_and_ties(spark):
    rows = [("h", f"x{k:04}", 0.1 + (k % 50) / 500) for k in range(3000)] + [("s", f"x{k:04}", 0.9) for k in range(5)] + [("t", "x0000", 0.5), ("t", "x0001", 0.1), ("t", "x0002", 0.1), ("t", "x0003", 0.1), ("u", "x0009", None)]
    got = {}
    for r in G.neighbours(frame(spark, rows), 0.3).collect():
        got.setdefault(r.src, []).append((r.dst, r.weight))
    both = {}
    for a, b, w in rows:
        both.setdefault(a, []).append((b, w))
        both.setdefault(b, []).append((a, w))
    for node, near in both.items():
        strong = [x for x in near if x[1] is not None and x[1] >= 0.3]
        want = strong if len(strong) >= 3 else sorted(near, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:3]
        assert sorted(got[node], key=str) == sorted(want, key=str)
    assert len(got["h"]) == 3


def brute_pairs(rows, least):
    out = Counter()
    for k, (i, v) in enumerate(rows):
        for j, u in rows[:k]:
            if i is None or j is None or not v or not u or len(v) != len(u) or i == j or not any(v) or not any(u):
                continue
            s = float(np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u))
            if s >= least:
                out[min(i, j), max(i, j), round(s, 6)] += 1
    return out


@pytest.mark.parametrize("least", [0.97, 0.5, -1.0])
def test_pruned_join_loses_no_pair(spark, monkeypatch, least):
    """Text ids, repeated ids, many copies, vectors of several sizes, null and zero vectors; tiles of few blocks."""
    monkeypatch.setattr(P, "TILE", 3)
    rng = np.random.default_rng(7)
    rows = [(f"i{k:03}", rng.normal(size=3).tolist()) for k in range(150)] + [(f"c{k:03}", [1.0, 2.0, 3.0]) for k in range(60)]
    rows += [(f"d{k}", rng.normal(size=2).tolist()) for k in range(9)] + [("none", None), ("zero", [0.0, 0.0, 0.0]), ("empty", []), (None, [1.0, 2.0, 3.0]), ("i000", [1.0, 0.0, 0.1]), ("i000", [1.0, 0.0, 0.2])]
    d = spark.createDataFrame(rows, "id string, v array<double>")
    want = brute_pairs(rows, least)
    for found in (P.cosine_pairs(d, "id", "v", least, block=16, pivots=6), S.cosine_pairs(d, "id", "v", least)):
        assert Counter((r.a, r.b, round(r.score, 6)) for r in found.collect()) == want
    stats = P.pruning(d, "id", "v", least, block=16, pivots=6).first()
    assert stats.met <= stats.block_pairs and (stats.skipped > 0.2 if least == 0.97 else stats.skipped == 0 if least == -1.0 else True)


def test_pruned_join_within_batches_and_of_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, v array<float>, batch int")
    plain = {(r.a, r.b) for r in S.cosine_pairs(d, "id", "v", 0.6, "batch").collect()}
    assert plain == {(r.a, r.b) for r in P.cosine_pairs(d, "id", "v", 0.6, "batch", block=8).collect()} and plain
    assert all(a % 3 == b % 3 for a, b in plain)
    assert P.cosine_pairs(d.limit(0), "id", "v", 0.6).count() == 0
    assert P.pruning(d.limit(0), "id", "v", 0.6).first().blocks == 0


def test_label_counts_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3).tolist(), int(rng.integers(3)) if k % 9 else None) for k in range(70)] + [(70, None, 1)]
    d = spark.createDataFrame(rows, "id long, v array<double>, label int")
    want, wrong = Counter(), set()
    for i, v, a in rows:
        for j, u, b in rows:
            if i < j and v and u and a is not None and b is not None:
                s = np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u) >= 0.4
                want["tp" if s and a == b else "tn" if not s and a != b else "fp" if s else "fn"] += 1
                if s != (a == b):
                    wrong.add((i, j, int(a == b), "FP" if s else "FN"))
    got = S.judged_counts(d, "id", "v", "label", 0.4).first()
    assert {c: got[c] for c in want} == dict(want) and got.n == sum(want.values())
    assert {(r.a, r.b, r.true_label, r.error) for r in S.wrong_pairs(d, "id", "v", "label", 0.4).collect()} == wrong


def test_seeds_keep_the_spelling_of_the_graph(spark):
    nodes = spark.createDataFrame([("IMG_1.JPG",), ("img_1.jpg",), ("b.png",)], "node string")
    tags = spark.createDataFrame([(" img_1.JPG ", "Cat "), ("B.PNG", "dog"), ("B.PNG", "DOG"), (None, "x"), ("b.png", None)], "node string, tag string")
    assert {(r.node, r.tag, r.conf) for r in T.seeds(tags, nodes).collect()} == {("IMG_1.JPG", "cat", 1.0), ("img_1.jpg", "cat", 1.0), ("b.png", "dog", 1.0)}
    edges = frame(spark, [("IMG_1.JPG", "b.png", 0.95), ("b.png", "c.png", 0.5)])
    found = T.propagate(edges, T.seeds(tags.where("tag like 'Cat%'"), G.nodes(edges)))
    assert found.where("node = 'IMG_1.JPG' and tag = 'cat' and conf = 1").count() == 1
    with pytest.raises(KeyError):
        T.seeds(tags.select(F.lit("gone").alias("node"), "tag"), nodes)


def test_larger_blocks_give_the_same_pairs_and_fewer_copies(spark, monkeypatch):
    """From BLOCKS blocks on blocks grow: a row is copied BLOCKS times, whatever the number of rows; floats stay floats."""
    rng = np.random.default_rng(5)
    rows = [(k % 290, rng.normal(size=3).astype(np.float32).tolist()) for k in range(300)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute_pairs(rows, 0.9)
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "WIDE", 16)
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "BLOCKS", 3)
    for most, copies in ((32 << 20, 3), (8 * 3 * 60, 5)):
        monkeypatch.setattr(S, "BYTES", most)
        assert Counter((r.a, r.b, round(r.score, 6)) for r in S.cosine_pairs(d, "id", "v", 0.9).collect()) == want
        kept = S._rows(d, "id", "v", None, kind="array<float>")
        assert S.in_blocks(kept, ["batch", "size"], 8, False, most=F.greatest(F.lit(8), F.floor(F.lit(most // 8) / F.first("size")))).count() == 300 * copies


@pytest.mark.parametrize("strict", [False, True])
def test_links_connect_what_pairs_connect(spark, monkeypatch, strict):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "BLOCKS", 4)
    monkeypatch.setattr(S, "PIECE", 10)
    rng = np.random.default_rng(6)
    near = lambda k: (np.eye(4)[k] + rng.normal(size=4) / 50).tolist()
    rows = [(f"i{k:03}", near(k % 3)) for k in range(120)] + [("i000", near(3)), ("x", near(3)), (None, near(0)), ("none", None), ("alone", [-1.0, 0.0, 0.0, 0.0]), ("y", [0.0, 0.0, 3.0, 4.0]), ("z", [0.0, 0.0, 4.0, -3.0])]
    d = spark.createDataFrame(rows, "id string, v array<double>")
    for least in (0.9, 0.0):
        pairs = S.cosine_pairs(d, "id", "v", least)
        pairs = (pairs.where(pairs.score > least) if strict else pairs).select("a", "b").distinct()
        links = S.cosine_links(d, "id", "v", least, strict)
        groups = [{(r.node, r.component) for r in G.components(x).collect()} for x in (links, pairs)]
        assert groups[0] == groups[1] and groups[0]
        assert least == 0.0 or links.count() * 3 < pairs.count()


def test_both_ways_read_the_edges_once(spark):
    e = frame(spark, [("a", "b", 1.0), ("b", "c", None)])
    assert Counter(map(tuple, G.both_ways(e).collect())) == Counter([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", None), ("c", "b", None)])
    for plan in (G.both_ways(e), G.nodes(e)):
        assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_hops_with_the_graph_in_tasks_equal_those_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"n{a:03}", f"n{b:03}", 1.0) for a, b in rng.integers(0, 90, (150, 2)).tolist() if a != b]
    e = frame(spark, rows + rows[:5] + [("far1", "far2", None), ("loop", "loop", 1.0), ("hub", "n000", 1.0)])
    found = []
    for most in (G.HELD_EDGES, 0):
        monkeypatch.setattr(G, "HELD_EDGES", most)
        found.append({r.node: (r.reached, r.total, round(r.inverse, 9)) for r in G.paths(e).collect()})
    assert found[0] == found[1] and found[0]["loop"] == (1, 0, 0.0)
    assert G.paths(e.limit(0)).count() == 0
    _, packed = G._packed(e.select("a", "b", "weight"))
    small = {r.idx: (r.reached, r.total) for r in H.held_hops(packed, len(found[0]), 64).collect()}
    assert sorted(small.values()) == sorted(v[:2] for v in found[0].values())


def test_paths_by_passes_equal_paths_by_nodes():
    """Ties, several components and a path of many steps; weights too small to count are left to the search by nodes."""
    rng = np.random.default_rng(4)
    for n, m in ((40, 60), (30, 200), (200, 230)):
        p = np.unique(np.sort(rng.integers(0, n, (m, 2)), axis=1), axis=0)
        p = p[p[:, 0] < p[:, 1]]
        names, ends = np.unique(p.T, return_inverse=True)
        a, b = ends.reshape(2, -1)
        g = (names, *G._csr(len(names), np.concatenate((a, b)), np.concatenate((b, a)), np.tile(rng.integers(1, 4, len(a)) / 2, 2)))
        src = np.repeat(np.arange(len(names)), np.diff(g[1]))
        for s in range(len(names)):
            assert G._dependent(g, src, s) == pytest.approx(G._brandes(g, s))
    tiny = (np.arange(3), *G._csr(3, np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([1.0, 1.0, 1e-300, 1e-300])))
    assert G._dependent(tiny, np.array([0, 1, 1, 2]), 0) is None


def test_spectra_agree_at_every_size(spark, monkeypatch):
    rows = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 0.0), ("d", "e", None), ("a", "c", 2.0)] + [(f"x{k}", f"x{k + 1}", 1.0) for k in range(4)]
    e, found = frame(spark, rows), []
    for local, few in ((5_000_000, 1_000_000), (0, 1_000_000), (0, 0)):
        monkeypatch.setattr(G, "LOCAL_EDGES", local)
        monkeypatch.setattr(G, "NODES", few)
        found.append({(m, r.node): r.score for m, f in (("p", G.pagerank(e, rounds=9, tol=0.0)), ("e", G.eigenvector(e, 9, 0.0))) for r in f.collect()})
        assert G.eigenvector(e.limit(0)).count() == 0
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2])


def test_what_is_stored_is_not_written_again(spark):
    once = D.stored(spark.range(3))
    assert D.stored(once) is once and D.stored(once.where("id > 0")) is not once


def test_neighbours_by_broadcast_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"n{a:02}", f"n{b:02}", float(w)) for a, b, w in zip(rng.integers(0, 40, 200), rng.integers(40, 80, 200), rng.random(200).round(2))]
    e, found = frame(spark, rows), []
    for most in (G.WEAK, 0):
        monkeypatch.setattr(G, "WEAK", most)
        found.append(Counter(map(tuple, G.neighbours(e, 0.7).collect())))
        assert G.neighbours(e.limit(0)).count() == 0
    assert found[0] == found[1] and found[0]


def test_compacted_tables_have_files_by_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 30)
    sinks.compact(spark.range(100).repartition(10), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "t")).count() == 100
    sinks.compact(spark.range(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_many_blocks_get_larger_instead(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST", 5)
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(103)], "id long, v array<float>")
    assert P.pruning(d, "id", "v", 0.9, block=4).first().blocks == 5
    pairs = lambda m: {(r.a, r.b) for r in m.cosine_pairs(d, "id", "v", 0.9, **({"block": 4} if m is P else {})).collect()}
    assert pairs(P) == pairs(S) and pairs(S)


def test_copies_of_the_graph_are_not_shuffled(spark):
    """Each block of sources reads the lists of neighbours in a task of its own; an exchange before it would copy them for each block."""
    e = spark.createDataFrame([(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in np.random.default_rng(5).integers(0, 60, (150, 2)).tolist()} if a != b], "a long, b long")
    names, packed = G._packed(e, keep=False)
    found = H.held_hops(packed, len(names), 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1 and "FlatMapGroupsInArrow" not in plan
