import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import graph as G
from lumen.plans.api import Albums
from lumen.sources import readers, sinks


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "a string, b string, weight double")


def scores(df):
    return {r.node: r.score for r in df.collect()}


def test_path_of_three(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 1))
    assert scores(G.degree(e)) == {"a": 0.5, "b": 1.0, "c": 0.5}
    assert scores(G.closeness(e)) == pytest.approx({"a": 2 / 3, "b": 1, "c": 2 / 3})
    assert scores(G.harmonic(e)) == {"a": 1.5, "b": 2.0, "c": 1.5}
    assert scores(G.betweenness(e)) == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_star_and_triangle(spark):
    star = edges(spark, *(("h", x, 1) for x in "xyz"))
    assert scores(G.closeness(star)) == pytest.approx({"h": 1, "x": 0.6, "y": 0.6, "z": 0.6})
    k3 = edges(spark, ("a", "b", 1), ("a", "c", 1), ("b", "c", 1))
    assert scores(G.pagerank(k3)) == pytest.approx(dict.fromkeys("abc", 1 / 3))
    assert scores(G.eigenvector(k3)) == pytest.approx(dict.fromkeys("abc", 1 / math.sqrt(3)))


def test_betweenness_takes_similarity_as_length(spark):
    e = edges(spark, ("a", "b", 0.9), ("b", "d", 0.9), ("a", "c", 1), ("c", "d", 1))
    assert scores(G.betweenness(e)) == pytest.approx({"a": 1 / 6, "b": 1 / 3, "c": 0, "d": 1 / 6})


def test_two_components(spark):
    e = edges(spark, ("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("x", "y", 1))
    assert scores(G.closeness(e)) == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.5, "x": 0.25, "y": 0.25})
    assert {(r.node, r.component) for r in G.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_joins_and_arrays_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = {tuple(sorted(p)) for p in rng.integers(0, 12, (25, 2)).tolist() if p[0] != p[1]}
    e = edges(spark, *((f"n{a:02}", f"n{b:02}", 0.5 + (a + b) / 50) for a, b in rows))
    local = [scores(G.pagerank(e, rounds=4, tol=0)), scores(G.eigenvector(e, 4, 0)), scores(G.betweenness(e))]
    monkeypatch.setattr(G, "LOCAL_EDGES", 3)
    monkeypatch.setattr(G, "PATH_EDGES", 3)
    joined = [scores(G.pagerank(e, rounds=4, tol=0)), scores(G.eigenvector(e, 4, 0)), scores(G.betweenness(e))]
    for x, y in zip(local, joined):
        assert x == pytest.approx(y)
    ties = edges(spark, ("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1), ("d", "e", 1))
    assert scores(G.betweenness(ties)) == pytest.approx({"a": 1 / 12, "b": 1 / 6, "c": 1 / 6, "d": 7 / 12, "e": 0})


def test_long_chain_is_one_component(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in G.components(e).collect()} == {0}


def test_build_collapses_names_and_top_reads_parameters(spark):
    s = spark.createDataFrame([("/x/a.jpg", "C:\\y\\b.jpg", 0.8, 1), ("/z/b.jpg", "/z/a.jpg", 0.9, 2), ("/x/a.jpg", "/y/a.jpg", 1.0, 3), ("/x/a.jpg", "/c.jpg", 0.79, 4)], "image1 string, image2 string, score double, pos int")
    assert [tuple(r) for r in G.build(s, 0.8, "pos").collect()] == [("a.jpg", "b.jpg", 0.9)]
    m = spark.createDataFrame([("degree", x, float(k % 2)) for k, x in enumerate("abc")], "metric string, node string, score double")
    assert [len(G.top(m, "degree", n).collect()) for n in ("", "all", "x", "-1", "2", None)] == [3, 3, 3, 0, 2, 3]
    assert [r.node for r in G.top(m, "degree").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        G.top(m, "size")


def test_graph_document_in_parts(spark, tmp_path):
    """Parts joined by name are valid JSON with everything in order; quotes, ties and repeated edges survive; empty graphs too."""
    rows = [(f'n"{k % 7}', f"m{k}", k / 10) for k in range(40)] + [('n"0', "m0", 0.0)]
    e = edges(spark, *rows)
    nodes = G.nodes(e).select(F.col("node").alias("id"))
    for k, (some, parts) in enumerate(((e, 5), (e, 1), (e.limit(0), 3))):
        known = nodes if some is e else nodes.limit(0)
        sinks.write_graph(known, some, str(tmp_path / f"g{k}"), parts)
        files = sorted((tmp_path / f"g{k}").glob("part-*"))
        doc = json.loads("".join(f.read_text() for f in files))
        assert [n["id"] for n in doc["nodes"]] == sorted(r.id for r in known.collect())
        assert [(x["source"], x["target"], x["weight"]) for x in doc["links"]] == (sorted(rows) if some is e else [])
        read = readers.graph_parts(spark, str(tmp_path / f"g{k}"))
        assert (read[0].count(), read[1].count()) == (len(doc["nodes"]), len(doc["links"]))
    assert max(len(line) for f in (tmp_path / "g1").glob("part-*") for line in f.read_text().splitlines()) < 80


def test_saved_tags_become_lists(spark, tmp_path):
    albums = Albums(spark, str(tmp_path))
    albums.create_album("a")
    albums.run_pipeline("a", spark.createDataFrame([("/x/IMG_1.JPG", "/x/b.png", 0.95), ("/x/b.png", "/x/c.png", 0.85)], "image1 string, image2 string, score double"))
    albums.save_tags("a", spark.createDataFrame([("img_1.jpg", "Bob, Ann", "Rome", "", ["Sea", "boat"])], "filename string, person string, place string, period string, objects array<string>"))
    got = {r.node: {t.tag: t.confidence for t in r.tags} for r in albums.propagated("a").collect()}
    assert got["IMG_1.JPG"] == dict.fromkeys(("bob", "ann", "rome", "sea", "boat"), 1.0) and set(got) == {"IMG_1.JPG", "b.png", "c.png"}
    path = albums.graph_document("a")
    assert {r.id for r in readers.graph_parts(spark, path)[0].collect()} == {"IMG_1.JPG", "b.png", "c.png"}
