"""The pipeline's near copies are linked by fingerprints too."""

from lumen.llm import simhash


def test_pipeline_stage_links_fingerprints(spark):
    line = " ".join(f"line{k}" for k in range(13))
    tail = lambda x: " ".join(f"{x}{k}" for k in range(30))
    texts = [(3, f"{line} " * 200 + tail("a")), (2, f"{line} " * 200 + tail("b")), (5, tail("c")), (4, None), (1, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (simhash.fingerprint(t) for _, t in texts[:2])
    assert (a ^ b).bit_count() <= 2  # by their sets of shingles the two are not similar
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df).collect()) == sorted(set(groups.values())) == [1, 2, 5]
    assert {r.doc_id for r in simhash.similar_texts(df).where("doc_id = component_id").collect()} == {1, 2, 3, 5}
