"""Greedy soft matching of tokens by their vectors (BERTScore, Zhang et al., 2020), over a table of token vectors.

Precision is the mean over a candidate's tokens of the best cosine with any token of the reference, recall the same the
other way, F1 their harmonic mean; with weights (idf of a corpus) the means are weighted. The vectors come from a provider
as a table (token, vector[, weight]). A token that the table lacks is a zero vector, so it matches nothing, and has the
weight `unknown`; a text without tokens scores 0; a null text, or no table at all (the model is missing), scores null.

How Spark runs it: a table of up to BROADCAST bytes goes to the tasks and pairs are scored where they lie, without a
shuffle. A larger one is joined by token (the rows of frequent tokens are dealt to many tasks), and the tokens of a pair
meet by its number. All pairs of a batch meet in pairs of blocks of texts, as vectors do in `similarity`: the tokens of
two blocks are compared once, and only pairs over the threshold leave a task. Matrices are built in slices of SLICE tokens.

Where many tokens share a vector, `keys` (token, key[, weight]) tells which of vectors (key, vector) a token has: then a
token takes 20 bytes in the tasks, its hashes, and no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.text import tokens
from lumen.operators.similarity import _arrow, _pair_schema, in_blocks
from lumen.plans.durable import join_hot, stored

BROADCAST, SLICE = 256 << 20, 1024
#: Texts in a block when all pairs are scored.
BLOCK = 128
SCORES = ("precision", "recall", "f1")


def with_idf(vectors: DataFrame, corpus: DataFrame, text: str = "text") -> tuple[DataFrame, float]:
    """vectors (token, vector) or keys (token, key) with the weight of tokens, and the weight of unknown ones: ln((M + 1) / (df + 1))
    over the M texts of the corpus, null ones left out."""
    texts = corpus.where(F.col(text).isNotNull())
    m = texts.count()
    df = texts.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    weight = F.log(F.lit(m + 1.0) / (F.coalesce("df", F.lit(0)) + 1))
    kept = [c for c in vectors.columns if c != "weight"]
    return vectors.join(df, "token", "left").select(*kept, weight.alias("weight")), float(np.log(m + 1.0))


def _table(vectors: DataFrame) -> DataFrame:
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in vectors.columns else F.lit(1.0)
    return vectors.where("token is not null and vector is not null").groupBy("token").agg(F.max(F.struct(F.col("vector").cast("array<double>").alias("v"), weight.cast("double").alias("w"))).alias("t")).select("token", "t.*")


class Vectors:
    """Unit vectors and weights of tokens by number; number 0 is the unknown token."""

    def __init__(self, names: list[str], v: np.ndarray, weights: np.ndarray, unknown: float):
        self.known = {t: k + 1 for k, t in enumerate(names)}
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if len(v) else v
        self.v = np.concatenate((np.zeros((1, v.shape[1]), np.float64), v)).astype(np.float64)
        self.w = np.concatenate(([unknown], weights))

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, weights) of the different tokens of a text; a weight counts every occurrence. Unknown tokens are one."""
        at, n = np.unique(np.array([self.known.get(t, 0) for t in words], np.int64), return_counts=True)
        return at, self.w[at] * n


class Hashed:
    """Unit vectors and weights of tokens by the tokens' hashes (h: 64 bits, each once; c: 32 more that must agree too)."""

    def __init__(self, h: np.ndarray, c: np.ndarray, place: np.ndarray, weights: np.ndarray, v: np.ndarray, unknown: float):
        order = np.argsort(h)
        self.h, self.c, self.place = h[order], c[order].astype(np.uint32), place[order].astype(np.int32) + 1
        values, code = np.unique(weights[order], return_inverse=True)
        self.w, self.code = np.concatenate((values, [unknown])), code.astype(np.int32)
        self.v = np.concatenate((np.zeros((1, v.shape[1])), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    def read(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the vectors, weights) of the different tokens of a text, as `Vectors.read`; place 0 is the unknown token."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        known = (self.h[at] == h) & (self.c[at] == c) if len(self.h) else np.zeros(len(h), bool)
        at, n = np.unique(np.where(known, at, -1), return_counts=True)
        held = at >= 0
        return np.where(held, self.place[at], 0) if len(self.h) else at * 0, self.w[np.where(held, self.code[at], -1) if len(self.h) else at] * n


def matched(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> tuple[float, float, float]:
    """(precision, recall, f1) of unit vectors x, the candidate's tokens, and y, the reference's, with their weights."""
    if not len(x) or not len(y):
        return 0.0, 0.0, 0.0
    to_x, to_y = np.empty(len(x)), np.full(len(y), -np.inf)
    for s in range(0, len(x), SLICE):
        cos = x[s : s + SLICE] @ y.T
        to_x[s : s + SLICE] = cos.max(1)
        to_y = np.maximum(to_y, cos.max(0))
    return _means(to_x, wx, to_y, wy)


def _means(to_x: np.ndarray, wx: np.ndarray, to_y: np.ndarray, wy: np.ndarray) -> tuple[float, float, float]:
    p = float(to_x @ wx / wx.sum()) if wx.sum() > 0 else 0.0
    r = float(to_y @ wy / wy.sum()) if wy.sum() > 0 else 0.0
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def pair_scores(pairs: DataFrame, vectors: DataFrame | None, candidate: str = "candidate", reference: str = "reference", unknown: float = 1.0, limit: int = BROADCAST, keys: DataFrame | None = None) -> DataFrame:
    """The rows of pairs with precision, recall and f1 of the candidate against the reference; columns of these names give way.

    With `keys` (token, key[, weight]) the vectors are (key, vector), each key once.
    """
    kept = [c for c in pairs.columns if c.lower() not in SCORES]
    if keys is not None and vectors is not None:
        if (sent := _hashes(keys, vectors, unknown, limit)) is not None:
            found = _sent_hashed(pairs.select(F.struct(*(pairs[c] for c in kept)).alias("row"), tokens(pairs[candidate]).alias("x"), tokens(pairs[reference]).alias("y")), sent)
            return found.select(*(F.col("row")[c].alias(c) for c in kept), *SCORES)
        vectors = keys.join(vectors, "key").select("token", "vector", *(["weight"] if "weight" in keys.columns else []))
    if vectors is None:
        return pairs.select(*(pairs[c] for c in kept), *(F.lit(None).cast("double").alias(c) for c in SCORES))
    table = stored(_table(vectors))
    size = table.agg(F.coalesce(F.sum(F.size("v") * 8 + F.octet_length("token") + 100), F.lit(0))).first()[0]
    rows = pairs.select(F.struct(*(pairs[c] for c in kept)).alias("row"), tokens(pairs[candidate]).alias("x"), tokens(pairs[reference]).alias("y"))
    found = _sent(rows, table, unknown) if size <= limit else _joined(rows, table, unknown)
    return found.select(*(F.col("row")[c].alias(c) for c in kept), *SCORES)


def _load(table: DataFrame, unknown: float) -> Vectors:
    t = table.orderBy("token").toArrow().combine_chunks()
    if len(set(pc.list_value_length(t["v"]).to_pylist())) > 1:
        raise ValueError("the token vectors are of different sizes")
    v = pc.list_flatten(t["v"]).to_numpy()
    return Vectors(t["token"].to_pylist(), v.reshape(t.num_rows, -1) if len(v) else np.zeros((t.num_rows, 1)), t["w"].to_numpy(), unknown)


def _sent(rows: DataFrame, table: DataFrame, unknown: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(_load(table, unknown))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        known = sent.value
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if x is None or y is None:
                    out.append((None,) * 3)
                    continue
                (at, wx), (to, wy) = known.read(x), known.read(y)
                out.append(matched(known.v[at], wx, known.v[to], wy))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in (zip(*out) if out else [()] * 3))], ["row", *SCORES])

    return rows.mapInArrow(run, f"row {kind}, precision double, recall double, f1 double")


def _hashes(keys: DataFrame, vectors: DataFrame, unknown: float, limit: int) -> Hashed | None:
    """What the tasks need of keys and vectors; None if it takes more than `limit` bytes or two tokens have one hash."""
    known = stored(vectors.where("key is not null and vector is not null").select("key", F.col("vector").cast("array<double>").alias("v")))
    weight = F.coalesce("weight", F.lit(1.0)).cast("double") if "weight" in keys.columns else F.lit(1.0)
    one = keys.where("token is not null").join(known.select("key"), "key", "left_semi").groupBy("token").agg(F.max(F.struct("key", weight.alias("w"))).alias("t"))
    table = stored(one.select(F.xxhash64("token").alias("h"), F.crc32("token").alias("c"), "t.*"))
    size = table.count() * 20 + known.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()[0]
    if size > limit:
        return None
    t, u = table.toArrow(), known.orderBy("key").toArrow().combine_chunks()
    h = t["h"].to_numpy()
    if len(np.unique(h)) < len(h):
        return None
    if len(set(pc.list_value_length(u["v"]).to_pylist())) > 1:
        raise ValueError("the token vectors are of different sizes")
    v = pc.list_flatten(u["v"]).to_numpy()
    place = pc.index_in(t["key"], value_set=u["key"].combine_chunks()).to_numpy()
    return Hashed(h, t["c"].to_numpy(), place, t["w"].to_numpy(), v.reshape(u.num_rows, -1) if len(v) else np.zeros((u.num_rows, 1)), unknown)


def _sent_hashed(rows: DataFrame, table: Hashed) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema["row"].dataType.simpleString()
    hashes = lambda c: (F.transform(c, lambda t: F.xxhash64(t)).alias(f"h{c}"), F.transform(c, lambda t: F.crc32(t)).alias(f"c{c}"))

    def run(batches):
        known = sent.value
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x, cx, y, cy = (b.column(i)[k] for i in range(1, 5))
                if not x.is_valid or not y.is_valid:
                    out.append((None,) * 3)
                    continue
                (at, wx), (to, wy) = (known.read(h.values.to_numpy(), c.values.to_numpy()) for h, c in ((x, cx), (y, cy)))
                out.append(matched(known.v[at], wx, known.v[to], wy))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in (zip(*out) if out else [()] * 3))], ["row", *SCORES])

    return rows.select("row", *hashes("x"), *hashes("y")).mapInArrow(run, f"row {kind}, precision double, recall double, f1 double")


def _joined(rows: DataFrame, table: DataFrame, unknown: float) -> DataFrame:
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    side = lambda c, k: rows.where("x is not null and y is not null").select("at", F.lit(k).alias("side"), F.explode(c).alias("token")).groupBy("at", "side", "token").agg(F.count("*").alias("n"))
    words = stored(side("x", 0).unionByName(side("y", 1)))
    counts = stored(words.groupBy("token").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_hot(words, table, "token", counts, total, F.col("at"), how="left").select("at", "side", "n", "v", F.coalesce("w", F.lit(unknown)).alias("w"))

    def run(t: pa.Table) -> pa.Table:
        found = []
        values = t["v"].to_pylist()
        places = max((len(v) for v in values if v is not None), default=1)
        for k in (0, 1):
            at = np.flatnonzero(t["side"].to_numpy() == k)
            v = np.array([values[i] if values[i] is not None else [0.0] * places for i in at], np.float64).reshape(len(at), places)
            found += [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), t["w"].to_numpy()[at] * t["n"].to_numpy()[at]]
        return pa.table({"at": t["at"][:1]} | {c: pa.array([s]) for c, s in zip(SCORES, matched(*found))})

    scored = met.groupBy("at").applyInArrow(run, "at long, precision double, recall double, f1 double")
    empty = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 0.0)  # no token on either side: the pair is in no group
    return rows.join(scored, "at", "left").select("row", *(F.coalesce(c, empty).alias(c) for c in SCORES))


def all_pairs(texts: DataFrame, id: str, text: str, least: float, method: str = "bertscore_f1", vectors: DataFrame | None = None, batch: str | None = None, unknown: float = 1.0, fresh: str | None = None) -> DataFrame:
    """(a, b, score) with a < b for all pairs of texts that score `least` or more, within batches if given; with `fresh`, a column
    that is true for new rows, only pairs with a new end.

    The smaller id is the candidate. Methods: bertscore_f1, or bertscore_precision_recall, the mean of both. Without vectors
    tokens match only equal ones. `vectors` must fit into BROADCAST bytes, which is checked. Null ids and texts have no pairs.
    """
    if method not in ("bertscore_f1", "bertscore_precision_recall"):
        raise ValueError(f"no soft matching by the name of {method}")
    known = None
    if vectors is not None:
        table = stored(_table(vectors))
        if (size := table.agg(F.coalesce(F.sum(F.size("v") * 8 + F.octet_length("token") + 100), F.lit(0))).first()[0]) > BROADCAST:
            raise ValueError(f"the token vectors take {size} bytes, more than {BROADCAST}")
        known = _load(table, unknown)
    sent = texts.sparkSession.sparkContext.broadcast(known)
    kind = _arrow(texts, id)
    rows = texts.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), tokens(F.col(text)).alias("t"), (F.col(batch) if batch else F.lit(0)).cast("int").alias("batch"), *([F.col(fresh).alias("fresh")] if fresh else []))
    rows = in_blocks(stored(rows.withColumn("row", F.monotonically_increasing_id())), ["batch"], BLOCK, bool(fresh))
    rows = rows.select("batch", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "t")

    def run(table: pa.Table) -> pa.Table:
        lo, same = table["lo"][0].as_py(), table["lo"][0].as_py() == table["hi"][0].as_py()
        own = table["block"].to_numpy() == lo
        left = table.filter(pa.array(own))
        right = left if same else table.filter(pa.array(~own))
        use = sent.value
        if use is None:  # every token of the blocks is a vector of its own
            names = sorted({w for t in table["t"].to_pylist() for w in t})
            use = Vectors(names, np.zeros((len(names), 1), np.float64), np.ones(len(names)), 1.0)
        ids, read = [t["id"].to_pylist() for t in (left, right)], [[use.read(words) for words in t["t"].to_pylist()] for t in (left, right)]
        vocab, place = [], []
        for side in read:
            at = np.unique(np.concatenate([a for a, _ in side])) if side else np.zeros(0, np.int64)
            vocab.append(at)
            place.append([np.searchsorted(at, a) for a, _ in side])
        cos = (vocab[0][:, None] == vocab[1][None, :]).astype(np.float64) if sent.value is None else use.v[vocab[0]] @ use.v[vocab[1]].T
        out = []
        for i, (x, px) in enumerate(zip(ids[0], place[0])):
            part = cos[px]
            for j, (y, py) in enumerate(zip(ids[1], place[1])):
                if (same and j <= i) or x == y:
                    continue
                p = r = f = 0.0
                if len(px) and len(py):
                    met = part[:, py]
                    p, r, f = _means(met.max(1), read[0][i][1], met.max(0), read[1][j][1])
                score = f if method == "bertscore_f1" else (p + r) / 2
                if score >= least:
                    out.append((min(x, y), max(x, y), score))
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("a", "b", "score"), zip(*out) if out else [()] * 3, (kind, kind, pa.float64()))})

    return rows.groupBy("batch", "lo", "hi").applyInArrow(run, _pair_schema(texts, id))
