"""Models as pluggable providers. Each maps batches; defaults need no model and are deterministic.

A provider that fails on a row gives the default (null, an empty text or list), never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions import text as X
from lumen.functions import vectors as V
from lumen.sources.exif import tags as exif_tags


def with_model(df: DataFrame, column: str, out: str, kind: str, make: Callable[[], Callable[[Any], Any]], failed: Any = None) -> DataFrame:
    """df with `out`: what the model made by `make`, one for each partition, gives for the column, or `failed` where it raises.

    Captions are kind string with failed "", faces array<array<double>> with failed [], vectors array<double>.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def safe(x):
            try:
                return model(x)
            except Exception:  # a row that a model cannot take has the default
                return failed

        for s in batches:
            yield s.map(safe, na_action=None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, kind)(F.col(column)))


def with_vectors(df: DataFrame, column: str, out: str = "embedding", make: Callable[[], Callable[[str | None], list[float] | None]] | None = None) -> DataFrame:
    """df with a vector of the text; without a model of your own the words' hashes make a unit vector."""
    if make is not None:
        return with_model(df, column, out, "array<double>", make)
    v = X.hashed_vector(F.col(column))
    return df.withColumn(out, F.when(V.usable(v), V.normalised(v)))


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF or JPEG image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8":
        return struct.unpack("<HH", content[6:10])
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def with_image_info(files: DataFrame, content: str = "content", exif: Callable[[bytes], dict[str, str]] = exif_tags) -> DataFrame:
    """files with `dimensions` ("WxH" or empty) and `exif`, the tags by name; unreadable images have none."""

    def info(data):
        size = image_size(bytes(data))
        return {"dimensions": "x".join(map(str, size)) if size else "", "exif": {str(k): v.decode(errors="replace") if isinstance(v, bytes) else str(v) for k, v in exif(bytes(data)).items()}}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                try:
                    rows.append(info(x))
                except Exception:  # no image
                    rows.append({"dimensions": "", "exif": {}})
            yield pd.DataFrame(rows, columns=["dimensions", "exif"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return files.withColumn("_info", F.pandas_udf(run, "dimensions string, exif map<string,string>")(F.col(content))).select("*", "_info.dimensions", "_info.exif").drop("_info")


def _sbert(a: Column, b: Column) -> Column:
    return X.bound(F.struct(X.hashed_vector(a).alias("a"), X.hashed_vector(b).alias("b")), lambda s: V.cosine(s["a"], s["b"]))


#: How two texts are scored, by name; each takes two columns. Others, such as ones with a model, can be given in their place.
TEXT_METHODS: dict[str, Callable[[Column, Column], Column]] = {
    "bertscore_f1": lambda a, b: X.token_overlap(a, b)[2],
    "bertscore_precision_recall": lambda a, b: (X.token_overlap(a, b)[0] + X.token_overlap(a, b)[1]) / 2,
    "sbert_cosine": _sbert,
}


def text_score(name: str, a: Column, b: Column, methods: dict[str, Callable[[Column, Column], Column] | None] = TEXT_METHODS) -> Column:
    """The score of two texts by the method of that name; a method that is None (its library is missing) gives NaN."""
    if name not in methods:
        raise ValueError(f"unknown method {name}; there are {tuple(methods)}")
    method = methods[name]
    return F.lit(float("nan")) if method is None else method(a, b)
