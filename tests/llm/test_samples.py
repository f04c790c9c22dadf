"""Samples are gathered in pieces."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from lumen.llm import shared


def test_samples_come_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(k, "x" * (k % 7 + 1), k % 2) for k in range(60)] + [(3, "xxxx", 1)] * 5, "doc_id long, text string, y int")
    indices = lambda t: np.arange(len(t), dtype=np.int32)
    sent, to_arrow = [], DataFrame.toArrow

    def counted(self):
        table = to_arrow(self)
        if "idx" in table.column_names:
            sent.append(sum(len(x.as_py()) // 4 for x in table["idx"]))
        return table

    monkeypatch.setattr(DataFrame, "toArrow", counted)
    for limit, budget in ((100, 10_000), (64, 10_000), (40, 10_000), (100, 90)):
        whole, y = shared.sampled(df, indices, limit, budget)
        sent.clear()
        monkeypatch.setattr(shared, "PIECE", 24)
        pieces, z = shared.sampled(df, indices, limit, budget)
        monkeypatch.undo()
        monkeypatch.setattr(DataFrame, "toArrow", counted)
        assert [x.tolist() for x in pieces] == [x.tolist() for x in whole] and y.tolist() == z.tolist()
        assert len(sent) > 2 and max(sent) <= 24 + 6 * 4  # rows of one hash stay together


def test_sample_is_one_block(spark):
    """All rows of a sample lie in one array, which the driver can give back at once; an empty row and pieces included."""
    texts = ["a b c", "", "d", "e f g h", "i j"]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, y int")
    held, y = shared.sampled(rows, lambda t: np.frombuffer("".join(t.split()).encode(), np.uint8), 10)
    assert sorted(bytes(x.astype(np.uint8)) for x in held) == sorted("".join(t.split()).encode() for t in texts)
    assert len(y) == len(texts) and len({id(x.base) for x in held}) == 1
