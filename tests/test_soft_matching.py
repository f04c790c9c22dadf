"""Soft matching of tokens against brute force, both ways of meeting the vectors, all pairs, and what is missing."""

import math
from collections import Counter

import numpy as np
import pytest

from lumen.operators import bertscore as B

RNG = np.random.default_rng(2)
WORDS = {f"w{k}": RNG.normal(size=5).tolist() for k in range(20)}
TEXTS = ["w1 w2 W3 w3", "w4", "", None, "zz yy w5", "zz", "w1 w2 w3 w3", " ".join(f"w{k % 20}" for k in range(3000)), "w7 zz w7"]


def brute(a, b, weights, unknown):
    if a is None or b is None:
        return None
    a, b = a.lower().split(), b.lower().split()
    if not a or not b:
        return (0.0, 0.0, 0.0)

    def cos(x, y):
        if x not in WORDS or y not in WORDS:
            return 0.0
        u, v = np.array(WORDS[x]), np.array(WORDS[y])
        return float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))

    w = lambda t: weights.get(t, unknown) if t in WORDS else unknown
    mean = lambda xs, ys: sum(w(x) * max(cos(x, y) for y in set(ys)) for x in xs) / sum(w(x) for x in xs)
    p, r = mean(a, b), mean(b, a)
    return (p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0)


def table(spark):
    return spark.createDataFrame([*WORDS.items(), ("w1", [0.0] * 5), (None, [1.0] * 5), ("gone", None)], "token string, vector array<double>").where("not (token <=> 'w1' and vector[0] = 0)")


@pytest.mark.parametrize("limit", [B.BROADCAST, 0])
def test_pairs_equal_brute_force(spark, limit):
    rows = [(k, a, b, "x") for k, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS if (a, b) != (TEXTS[7], TEXTS[7]))]
    pairs = spark.createDataFrame(rows + rows[:1], "id long, candidate string, reference string, f1 string")
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    vectors, unknown = B.with_idf(table(spark), corpus)
    held = [set(t.lower().split()) for t in TEXTS if t is not None]
    weights = {w: math.log((len(held) + 1) / (sum(w in h for h in held) + 1)) for w in WORDS}
    assert unknown == pytest.approx(math.log(len(held) + 1))
    got = {r.id: (r.precision, r.recall, r.f1) for r in B.pair_scores(pairs, vectors, unknown=unknown, limit=limit).collect()}
    assert len(got) == len(rows)
    for k, a, b, _ in rows:
        want = brute(a, b, weights, unknown)
        assert got[k] == ((None,) * 3 if want is None else pytest.approx(want))
    assert B.pair_scores(pairs.limit(0), vectors, limit=limit).count() == 0


@pytest.mark.parametrize("limit", [B.BROADCAST, 0])
def test_tokens_that_share_vectors(spark, limit):
    """Keys and vectors apart give what a vector for each token gives, weighted or not; only the former grows with the vocabulary."""
    keys = spark.createDataFrame([(f"w{k}", k % 7, 1.0 + k) for k in range(20)] + [("w1", 99, 5.0), ("zz", 99, 1.0), (None, 1, 1.0), ("yy", None, 1.0)], "token string, key long, weight double")
    vectors = spark.createDataFrame([(k, WORDS[f"w{k}"]) for k in range(7)] + [(None, [1.0] * 5), (50, None)], "key long, vector array<double>")
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)], "id long, candidate string, reference string")
    for k in (keys, keys.drop("weight")):
        whole = B.pair_scores(pairs, k.join(vectors, "key").drop("key"), unknown=2.5)
        got = B.pair_scores(pairs, vectors, unknown=2.5, limit=limit, keys=k)
        assert got.columns == whole.columns
        want = {r.id: tuple(r)[1:] for r in whole.collect()}
        assert {r.id: tuple(r)[1:] for r in got.collect()} == {i: tuple(pytest.approx(x) if isinstance(x, float) else x for x in w) for i, w in want.items()}
    assert B.pair_scores(pairs, vectors.limit(0), limit=limit, keys=keys).where("f1 > 0").count() == 0
    if limit:
        sent = B._hashes(keys, vectors, 2.5, limit)
        assert sent.v.shape == (8, 5) and len(sent.h) == 20


def test_missing_model_gives_null(spark):
    pairs = spark.createDataFrame([(1, "a", "a")], "id long, candidate string, reference string")
    assert B.pair_scores(pairs, None).first()[3:] == (None, None, None)


@pytest.mark.parametrize("method", ["bertscore_f1", "bertscore_precision_recall"])
def test_all_pairs_in_blocks(spark, monkeypatch, method):
    monkeypatch.setattr(B, "BLOCK", 3)
    rows = [(f"t{k}", t, k % 2) for k, t in enumerate(TEXTS)] + [("t0", "w1", 0), (None, "w1", 0)]
    d = spark.createDataFrame(rows, "id string, text string, batch int")
    for vectors in (table(spark), None):
        want = Counter()
        for k, (i, t, b) in enumerate(rows):
            for j, u, c in rows[:k]:
                if i is None or j is None or i == j or b != c or t is None or u is None:
                    continue
                if vectors is None:
                    x, y = t.lower().split(), u.lower().split()
                    p, r = (sum(w in y for w in x) / len(x), sum(w in x for w in y) / len(y)) if x and y else (0, 0)
                    f = 2 * p * r / (p + r) if p + r else 0
                else:
                    p, r, f = brute(t, u, {}, 1.0)
                s = f if method == "bertscore_f1" else (p + r) / 2
                if s >= 0.3:
                    want[min(i, j), max(i, j), round(s, 6)] += 1
        assert Counter((r.a, r.b, round(r.score, 6)) for r in B.all_pairs(d, "id", "text", 0.3, method, vectors, "batch").collect()) == want
    with pytest.raises(ValueError):
        B.all_pairs(d, "id", "text", 0.3, "other")
