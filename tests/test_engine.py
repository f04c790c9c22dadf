import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumen import queries as Q
from lumen.functions import text as X
from lumen.functions import vectors as V
from lumen.operators import evaluate as E
from lumen.operators import providers, tags as T
from lumen.operators import similarity as S
from lumen.plans.api import Albums
from lumen.sources import readers, sinks
from lumen.streaming.ingest import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["j01_similar_pairs", "c05_pagerank", "c06_betweenness", "v03_z_scores", "v06_live_pairs", "g08_count_metrics", "j11_match_errors", "x06_methods", "t01_persons", "t10_tag_propagation"])
def test_query_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, sql = Q.QUERIES[name](spark, sf), c.sql(Q.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    at = [sql.columns.index(x) for x in cols]
    clean = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, (clean(r[x] for x in cols) for r in df.collect()))) == sorted(map(repr, (clean(r[i] for i in at) for r in sql.fetchall())))


def test_names_and_lists(spark):
    df = spark.createDataFrame([("C:\\a\\X.Y.JPG", " a  b\n c "), ("/p/.hidden", None)], "p string, t string")
    got = df.select(X.basename(F.col("p")), X.stem(F.col("p")), X.clean_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("X.Y.JPG", "x.y", "a b c"), (".hidden", ".hidden", None)]
    assert spark.sql("select 'A, ,b ,' s").select(X.split_list(F.col("s"))).first()[0] == ["A", "b"]


def test_blocks_and_joins_give_the_same_pairs(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("batch", F.expr("int(vec_id div 125)"))
    monkeypatch.setattr(S, "BLOCK", 40)
    blocks = {(r.a, r.b) for r in S.cosine_pairs(rows, "vec_id", "embedding", 0.3, "batch").collect()}
    joined = {(r.a, r.b) for r in S.cosine_pairs_join(rows, "vec_id", "embedding", 0.3, "batch").collect()}
    assert blocks == joined and blocks


def test_unusable_vectors_have_no_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id long, v array<double>")
    assert [(r.a, r.b) for r in S.cosine_pairs(df, "id", "v", 0.5).collect()] == [(1, 5)]
    assert [r[0] for r in df.select(V.usable(F.col("v"))).collect()] == [True, False, False, False, True]


def test_batches_give_the_first_ones_more(spark):
    got = S.batches(spark.range(5), "id", 2).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [3, 2]


def test_bonus_is_capped_and_same_image_counts_nothing(spark):
    faces = spark.createDataFrame([(k, k // 2, [1.0, 0.0]) for k in range(4)], "face_id long, image_id long, embedding array<double>")
    hits = S.image_matches(faces, S.face_matches(faces, 0.9))
    assert [(r.i, r.j, r.face_count) for r in hits.collect()] == [(0, 1, 4)]
    assert hits.select(S.bonus(F.col("face_count"))).first()[0] == pytest.approx(0.3)
    assert S.face_matches(faces, 1.0).count() == 0


def test_write_back_by_position(spark):
    images = spark.createDataFrame([("p", [([1.0], None), ([2.0], None)])], "image_path string, face_embeddings array<struct<embedding:array<double>,match_id:string>>")
    groups = spark.createDataFrame([("p", 1, "g")], "image_path string, pos int, match_id string")
    assert [f.match_id for f in S.write_back(images, groups).first().face_embeddings] == [None, "g"]


def test_conflicting_labels_both_count(spark):
    gt = spark.createDataFrame([("a.jpg", "b.jpg", 0), ("B.jpg", "A.jpg", 1)], "img1 string, img2 string, true_label int")
    model = spark.createDataFrame([("x/a.jpg", "x/b.jpg", 0.9), ("x/a.jpg", None, 0.9)], "image1_path string, image2_path string, similarity_score double")
    r = E.confusion(E.pair_truth(gt), E.pair_scores(model)).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.coverage) == (1, 1, 0, 0, 1.0)


def test_row_filter_of_propagation(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.95)], "a string, b string, weight double")
    seed = T.seeds(spark.createDataFrame([(" A ", "Cat")], "node string, tag string"), spark.createDataFrame([("a",), ("b",), ("c",)], "node string"))
    got = {(r.node, r.tag): r.conf for r in T.propagate(e, seed).collect()}
    assert got[("a", "cat")] == 1.0
    with pytest.raises(KeyError):
        T.seeds(spark.createDataFrame([("z", "cat")], "node string, tag string"), spark.createDataFrame([("a",)], "node string"))


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"degree": {"a": 0.5}}))
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b", "weight": "0.5"}]}))
    (tmp_path / "t.json").write_text(json.dumps({" A.jpg": {"face_tags": [{"name": "Bob", "face_id": "1"}], "general_tags": ["Sea "]}}))
    assert [tuple(r) for r in readers.metrics_document(spark, str(tmp_path / "m.json")).collect()] == [("degree", "a", 0.5)]
    assert [tuple(r) for r in readers.graph_document(spark, str(tmp_path / "g.json")).collect()] == [("a", "b", 0.5)]
    assert {(r.node, r.kind, r.tag) for r in readers.tag_document(spark, str(tmp_path / "t.json")).collect()} == {("a.jpg", "face", "bob"), ("a.jpg", "general", "sea")}
    assert sinks.report({"x": spark.range(2), "empty": spark.range(0)}, str(tmp_path / "r")) == ["x"]


def test_albums_and_stream(spark, tmp_path):
    albums = Albums(spark, str(tmp_path / "root"))
    albums.create_album("one")
    with pytest.raises(ValueError):
        albums.create_album("one")
    s = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95)], "image1 string, image2 string, score double")
    albums.run_pipeline("one", s)
    assert albums.list_albums() == ["one"] and albums.status("one")["last"]
    assert [r.node for r in albums.top_central("one", "degree", 1).collect()] == ["b"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.bin").write_bytes(b"123")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.select("path", "length")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_provider_gives_null_where_it_fails(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    assert [r.embedding is None for r in providers.with_vectors(df, "t").collect()] == [False, True, True]
    got = providers.with_model(df, "t", "faces", "array<array<double>>", lambda: lambda x: [[float(len(x))]], []).collect()
    assert [r.faces for r in got] == [[[3.0]], [[0.0]], []]


def test_text_methods_and_a_missing_library(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("", "x"), ("q", "q")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(*(providers.text_score(m, a, b).alias(m) for m in providers.TEXT_METHODS), providers.text_score("none", a, b, {"none": None}).alias("none")).collect()
    assert rows[0].bertscore_f1 == pytest.approx(2 / 3) and rows[0].bertscore_precision_recall == pytest.approx(2 / 3)
    assert rows[2].sbert_cosine == pytest.approx(1) and rows[1].bertscore_f1 == 0 and rows[1].sbert_cosine is None
    assert all(r.none != r.none for r in rows)
    with pytest.raises(ValueError):
        providers.text_score("other", a, b)


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (9).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"\x01\x01\x11\x00"


def test_image_info(spark):
    df = spark.createDataFrame([(PNG,), (JPEG,), (b"GIF89a\x03\x00\x02\x00",), (b"text",), (None,)], "content binary")
    got = providers.with_image_info(df, exif=lambda x: {"Make": b"maker"} if x[:2] == b"\xff\xd8" else {}).collect()
    assert [r.dimensions for r in got] == ["7x5", "4x9", "3x2", "", ""]
    assert [r.exif for r in got] == [{}, {"Make": "maker"}, {}, {}, {}]


def test_album_from_files_to_metrics(spark, tmp_path):
    albums = Albums(spark, str(tmp_path / "root"))
    albums.create_album("a")
    with pytest.raises(KeyError):
        albums.upload("b", "x.png", PNG)
    for k, extra in enumerate(["cat on mat", "cat on mat", "cat on mat", "dog in fog"]):
        albums.upload("a", f"C:\\x\\i{k}.png", PNG + extra.encode())
    describe = lambda: lambda content: bytes(content)[len(PNG) :].decode()
    faces = lambda: lambda content: [[1.0, 0.0]] if b"cat" in bytes(content) else []
    for _ in range(2):
        albums.process("a", describe, faces)
    assert spark.read.parquet(str(tmp_path / "root/a/images")).count() == 4
    assert {r.dimensions for r in spark.read.parquet(str(tmp_path / "root/a/images")).collect()} == {"7x5"}
    assert sorted(r.node for r in albums.top_central("a", "degree").collect()) == ["i0.png", "i1.png", "i2.png"]
    assert spark.read.parquet(str(tmp_path / "root/a/identities/run=2")).select("match_id").distinct().count() == 1
    assert albums.status("a")["last"]


def test_checkpoint_and_conversion(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",)], "image_path string")
    at = str(tmp_path / "ck")
    assert readers.processed(spark, at).count() == 0
    sinks.mark_processed(files.limit(1), at)
    sinks.mark_processed(files.limit(1), at)
    assert readers.processed(spark, at).count() == 1
    for stamp, k in (("20250101_000000", 1), ("20250102_000000", 2)):
        spark.createDataFrame([(k, [1.0])], "k int, v array<double>").write.parquet(str(tmp_path / f"d/t_{stamp}.parquet"))
    assert sinks.parquet_to_csv(spark, str(tmp_path / "d"), "t", str(tmp_path / "o")) == "t_20250102_000000.parquet"
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "o")).collect()] == [("2", "[1.0]")]
    assert sinks.parquet_to_csv(spark, str(tmp_path / "d"), "t", str(tmp_path / "o"), "20250101_000000") == "t_20250101_000000.parquet"
    with pytest.raises(FileNotFoundError):
        sinks.parquet_to_csv(spark, str(tmp_path / "d"), "u", str(tmp_path / "o"))


def test_reports(spark):
    truth = spark.createDataFrame([("b.jpg", 2), ("a.jpg", 1)], "image_id string, true_faces int")
    found = spark.createDataFrame([("/x/B.png", 3)], "image_id string, face_count int")
    assert [tuple(r) for r in E.count_report(truth, found).collect()] == [("a", 1, 0, 0, 0, 1), ("b", 2, 3, 2, 1, 0)]
    assert [r.image_id for r in E.unmatched(truth, found).collect()] == ["a.jpg"]
    with pytest.raises(ValueError):
        E.count_report(truth, found.drop("face_count"))
    model = spark.createDataFrame([("x/a.jpg", "sea")], "image_path string, description string")
    with pytest.raises(ValueError):
        E.by_stem(model, spark.createDataFrame([("b.jpg", "sea")], "image_path string, summary string"))
    last = E.match_errors(spark.createDataFrame([("B", "a", 2), ("c", "d", 1)], "img1 string, img2 string, face_count int"), spark.createDataFrame([("a", "b", 1.0, 1), ("A", "B", None, 2)], "img1 string, img2 string, true_count double, pos int"))
    assert {r.a: (r.error, r.magnitude) for r in last.collect()} == {"a": ("correct", None), "c": ("not_processed", None)}


def test_average_method_of_propagation(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "a string, b string, weight double")
    seed = spark.createDataFrame([("a", "cat", 1.0)], "node string, tag string, conf double")
    got = T.step(e, seed, seed.select("node"), 1, method="average").collect()
    assert got == []  # tagged images give nothing after the first round
    first = {(r.node, r.tag): r.conf for r in T.step(e, seed, seed.select("node"), 0, method="average").collect()}
    assert first == {}  # one value under 1 is dropped
    strong = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.5)], "a string, b string, weight double")
    value = T.step(strong, seed, seed.select("node"), 0, method="average").collect()[0]
    assert (value.node, value.conf) == ("b", pytest.approx(0.95 / (1 + 0.25 * math.log(1.01)) * (1 / (1 + 0.25 / 1.5 * math.log(1.01)) + 0.7)))
