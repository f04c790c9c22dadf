"""Uploads one after another give what one upload gives, faces keep their identity, and the status outlives failures."""

import pytest
from pyspark.sql import functions as F

from lumen.operators import compare as C
from lumen.operators import graph as G
from lumen.operators import similarity as S
from lumen.operators.components import components, merged
from lumen.plans.api import Albums

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
#: Name, description, faces: f4 ties the two groups that the first upload had.
FILES = [("f0", "cat on mat", [[1.0, 0.0]]), ("f1", "cat on mat", [[0.0, 1.0], [1.0, 0.02]]), ("f2", "dog in fog", [[0.05, 1.0]]), ("f3", "cat on hat", []), ("f4", "cat on mat", [[0.7, 0.72]]), ("a5", "dog in fog", [[-1.0, 0.0]])]
FACES = {d + n: f for n, d, f in FILES}


def upload(albums, album, files):
    for name, text, _ in files:
        albums.upload(album, f"{name}.png", PNG + (text + name).encode())


def models():
    text = lambda content: bytes(content)[len(PNG) :].decode()
    known = dict(FACES)
    return (lambda: lambda c: text(c)[:-2]), (lambda: lambda c: known[text(c)])


def read(spark, root, album):
    table = lambda t: spark.read.parquet(f"{root}/{album}/{t}")
    name = lambda p: p.rsplit("/", 1)[-1]
    pairs = {(name(r.image1_path), name(r.image2_path)): (round(r.similarity_score, 6), round(r.face_bonus, 6), r.face_count) for r in table("similarities").collect()}
    last = table("results").agg(F.max("run")).first()[0]
    faces = {(name(r.image_path), k): f.match_id for r in table("results").where(F.col("run") == last).collect() for k, f in enumerate(r.face_embeddings or [])}
    groups = {frozenset(k for k in faces if faces[k] == v) for v in faces.values()}
    metrics = {(r.metric, r.node): round(r.score, 9) for r in table("metrics").collect()}
    return pairs, groups, metrics, faces


def test_two_uploads_equal_one(spark, tmp_path):
    root = str(tmp_path)
    albums = Albums(spark, root)
    s = S.Settings(text_threshold=0.6, face_threshold=0.6)
    albums.create_album("one")
    upload(albums, "one", FILES)
    albums.process("one", *models(), s, 0.6)
    albums.create_album("two")
    upload(albums, "two", FILES[:4])
    albums.process("two", *models(), s, 0.6)
    before = read(spark, root, "two")
    upload(albums, "two", FILES[4:])
    albums.process("two", *models(), s, 0.6)
    one, two = read(spark, root, "one"), read(spark, root, "two")
    assert one[:3] == two[:3] and one[0] and one[1] != before[1]
    # Only pairs with a new end were compared, and no pair twice.
    second = spark.read.parquet(f"{root}/two/similarities/run=2").collect()
    assert second and all({r.image1_path[-6:-4], r.image2_path[-6:-4]} & {"f4", "a5"} for r in second)
    assert spark.read.parquet(f"{root}/two/similarities").count() == len(two[0])
    # A group that grows keeps its name, one that is tied to an older one takes the older name.
    assert two[3]["f0.png", 0] == before[3]["f0.png", 0] and len(set(before[3].values())) == 2
    assert {two[3][k] for k in before[3]} == {before[3]["f0.png", 0]}
    albums.process("two", *models(), s, 0.6)  # nothing new
    assert read(spark, root, "two") == two and albums.status("two")["run"] == 3


def test_status_ends_on_failure_and_the_run_is_made_again(spark, tmp_path, monkeypatch):
    albums = Albums(spark, str(tmp_path))
    albums.create_album("a")
    upload(albums, "a", FILES[:2])
    monkeypatch.setattr(G, "centralities", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        albums.process("a", *models(), S.Settings(text_threshold=0.5))
    assert albums.status("a") == {"processing": False, "last": None, "run": 0, "error": "ZeroDivisionError: division by zero"}
    monkeypatch.undo()
    thread = albums.start("a", *models(), S.Settings(text_threshold=0.5))
    thread.join()
    again = Albums(spark, str(tmp_path)).status("a")  # another process reads the same
    assert again["run"] == 1 and again["last"] and again["error"] is None and not again["processing"]
    assert spark.read.parquet(f"{tmp_path}/a/images").count() == 2
    (tmp_path / "a/.status.json.crc").unlink()
    (tmp_path / "a/status.json").write_text('{"processing": true, "run": 1, "by": "some other session"}')
    assert albums.status("a")["error"] == "interrupted"
    assert albums.status("none") == {"processing": False, "last": None, "run": 0, "error": None}


def test_pairs_with_a_new_end(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = [(k, [float(k % 5), 1.0, float(k % 3)], k >= 20, f"w{k % 4} w{k % 3}") for k in range(30)]
    d = spark.createDataFrame(rows, "image_id long, embedding array<double>, fresh boolean, description string")
    for method in ("sbert_cosine", "bertscore_f1"):
        s = S.Settings(method=method)
        every = {(r.i, r.j) for r in C.text_pairs(d, 0.5, s).collect()}
        new = [(r.i, r.j) for r in C.text_pairs(d, 0.5, s, fresh="fresh").collect()]
        assert len(new) == len(set(new)) and set(new) == {p for p in every if max(p) >= 20} and every - set(new)
        for none in (d.withColumn("fresh", F.lit(False)), d.limit(0)):
            assert C.text_pairs(none, 0.5, s, fresh="fresh").count() == 0


def test_groups_merge_as_components_do(spark):
    edges = [(1, 2), (2, 3), (5, 6), (8, 9), (3, 6), (10, 11), (11, 9), (12, 12), (None, 1)]
    known = spark.createDataFrame([(k, k) for k in range(1, 8)], "node long, root long")
    for part in (edges[:3], edges[3:5], edges[5:]):
        known = merged(known, spark.createDataFrame(part, "a long, b long"))
    want = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r.node: r.root for r in known.collect()} == {k: want.get(k, k) for k in [*range(1, 13)]}
