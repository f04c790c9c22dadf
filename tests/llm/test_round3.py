"""Interactions of filters, prefix tries and languages against brute force on small tables with odd rows."""

import hashlib
import zlib
from pathlib import Path
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.llm import interactions, language, licenses, trie

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for ch in text + " ":
        if ch in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += ch
    return out


def brute_audit(docs, labels):
    """Walks every order document by document; docs: (doc_id, text, source)."""
    lab = {}
    for i, q, t in labels:
        if i is not None:
            a, b = lab.get(i, (0, 0))
            lab[i] = (max(a, q or 0), max(b, t or 0))
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((part or "", fails, *lab.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            live = own
            for k, x in enumerate(order):
                gone = [r for r in live if r[1][x]]
                live = [r for r in live if not r[1][x]]
                failing = sum(r[1][x] for r in own)
                out[part, "".join(order), k + 1] = [len(live), len(gone), failing - len(gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[x] += len(gone)
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_interactions_equal_walking_every_order(spark):
    long = " ".join(f"w{k}" for k in range(300))
    docs = [
        (0, long, "a"), (1, long, "b"), (1, long, "b"), (2, None, None), (3, "", ""), (4, "word " * 300, "a"), (5, long + " #", "a"), (6, long.upper(), "a"), (7, " ".join(f"é{k}" for k in range(250)) + "\x1cA", "b"),
        (None, long, "a"), (None, None, "b"), (8, "X" * 50_000, "a"), (9, "a\x85b\xa0c " * 220, None), (-1, "w1 w2", "a"), (4, "word " * 300, "a"), (10, "w1 w2", None),
    ]
    labels = [(0, 1, 0), (1, None, 1), (1, 1, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (99, 1, 1), (6, 0, 1), (9, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, source string, mask int, digest string")
    found = interactions.audit(d, spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}
    assert got == brute_audit(docs, labels) and len(got) == 3 * 600
    none = d.limit(0)
    assert interactions.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert interactions.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("good_lost > 0 or toxic_lost > 0").isEmpty()


def test_zeta_transform_of_other_filters(spark):
    """Any number of filters, and survivors are what plain set inclusion says."""
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, 8).tolist()
    row = interactions.survivors(spark.createDataFrame([(n,)], "n array<long>"), 3, "n").first()
    assert row.n == [sum(n[m] for m in range(8) if m & s == 0) for s in range(8)]
    d = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x"), (3, "a b", "x")], "doc_id long, text string, source string")
    out = interactions.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"S": "n_words < 2"})
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in out.collect()} == {("SE", 1): (2, 1, 2), ("SE", 2): (1, 1, 2), ("ES", 1): (2, 1, 2), ("ES", 2): (1, 1, 2)}


def brute_trie(rows, block=5, most=8):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - int(np.fmod(c, block))
        new[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in inside if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in inside) for p in inside)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        ends = ",".join(map(str, sorted(c for c in members if len(new[c]) == len(path))))
        out[min(members), len(path)] = (min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


ROWS = "conv_id long, turn long, role string, text string, k int, node string"


@pytest.mark.parametrize("chunk,large", [(1 << 16, 4096), (2, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, chunk, large):
    """Shared prefixes, exact copies, ties, null turns, absent bases, turnless and negative ids; small chunks and hot keys."""
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "LARGE", large)
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(40), 1001, 1002, -3, -7, 5003, 77, 79]:
        n = int(rng.integers(1, 7))
        for k in range(n):
            rows.append((c, None if rng.random() < 0.15 else k, ["user", "bot", None][int(rng.integers(3))] if k > 1 else "user", ["hi", "wé", "", None, "long text " * 20][int(rng.integers(5))] if k else "hi"))
    rows += [(c, k, "user", "same" * k) for c in range(100, 160) for k in range(12)]
    rows += [(None, 1, "user", "lost"), (3, 1, "user", "hi"), (3, 1, "user", "hi")]
    found = trie.nodes(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(got) == len(found) and got == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    empty = spark.createDataFrame([], ROWS)
    assert trie.nodes(empty).count() == 0
    rows = [(7, k, "user", "x") for k in range(20)]
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.nodes(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)).collect()}
    assert got == brute_trie(rows)


def test_places_of_turns_over_partitions(spark):
    """A conversation that lies in many partitions is numbered from 1 without gaps."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(2000).select(F.lit(1).alias("conv_id"), (F.col("id") * 7 % 2000).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
        found = trie.ordered(rows)
        assert [r.k for r in found.select("k").orderBy("k").collect()] == list(range(1, 2001))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def brute_path(scores, penalty):
    """The best path of one text, state by state."""
    best = [(scores[0][k], [k]) for k in range(len(scores[0]))]
    for row in scores[1:]:
        new = []
        for k, x in enumerate(row):
            value, path = max(((v - (p[-1] != k) * penalty, p) for v, p in best), key=lambda y: y[0])
            new.append((value + x, [*path, k]))
        best = new
    return max(best, key=lambda y: y[0])


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(30, 3)) * 2
    texts = [rng.integers(0, 30, n) for n in (0, 1, 5, 40, 2, 17)]
    for words_of, path in zip(texts, language.search(texts, scores, 1.5)):
        assert len(path) == len(words_of)
        if len(path):
            value = scores[words_of, path].sum() - 1.5 * (np.diff(path) != 0).sum()
            assert abs(value - brute_path(scores[words_of].tolist(), 1.5)[0]) < 1e-9


def test_ngrams_are_those_of_each_word():
    cells, of = language.grams(["ab", "Ç", "abc"], 1 << 40)
    alone = [set(language.grams([w], 1 << 40)[0].tolist()) for w in ("ab", "ç", "abc")]
    for k, own in enumerate(alone):
        assert set(cells[of == k].tolist()) == own
    assert [len(c) for c in alone] == [3 + 2 + 1, 2 + 1, 4 + 3 + 2 + 1]


def test_languages_of_mixed_texts(spark):
    en, de, ru = "the house and the garden are green ", "das haus und der garten sind sehr schön ", "дом и сад очень зелёные "
    train = [(k, t * 3, lang, 1) for k, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 8)]
    odd = [(100, None, "en", 1), (101, "", None, 1), (102, "12 — ²½ !", "de", 1), (103, en * 4 + ru * 9, None, 1), (None, de, None, 1), (None, de, "de", 1), (104, "x" * 60_000, None, 1), (105, en * 3000, None, 1), (106, "中文 字", None, 1)]
    d = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score int")
    rows = language.identify(d).collect()
    assert len(rows) == len(train) + len(odd)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in rows)
    assert all(by[k].lang_pred == lang and by[k].score == 1.0 and [tuple(s) for s in by[k].lang_spans] == [(0, len(t.rstrip()) , lang)] for k, t, lang, _ in train)
    assert all((by[k].lang_pred, by[k].score, by[k].lang_spans) == ("und", 0.0, []) for k in (100, 101, 102))
    mixed = by[103]
    text = odd[3][1]
    assert mixed.lang_pred == "ru" and [(text[a:b].strip()[:3], x) for a, b, x in mixed.lang_spans] == [("the", "en"), ("дом", "ru")]
    assert abs(mixed.score - sum(map(str.isalpha, ru * 9)) / sum(map(str.isalpha, text))) < 1e-9
    assert by[105].lang_pred == "en" and by[104].lang_pred in ("de", "en") and by[106].lang_pred in ("de", "en", "ru")
    none = language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert language.identify(d.limit(0)).count() == 0


def test_language_counts_do_not_depend_on_the_tasks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    one = {(r.lang, r.cell): r.n for r in language.counts(rows.coalesce(1), 1 << 10).collect()}
    monkeypatch.setattr(language, "WORDS", 50)
    assert one == {(r.lang, r.cell): r.n for r in language.counts(rows.repartition(5), 1 << 10).collect()}
    n = Counter()
    for r in rows.where("text is not null and lang is not null").collect():
        n[r.lang] += sum(len(w) for w in language.RUN.findall(r.text) if any(map(str.isalpha, w)))
    assert n == Counter({lang: sum(v for (x, c), v in one.items() if x == lang and c >= 1 << 10) for lang in n})


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0


def test_license_digests_are_those_of_the_texts(spark):
    """The digests of whole texts, against the texts that this machine has, if it has any."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    files = {k: Path("/usr/share/common-licenses", v) for k, v in names.items()}
    rows = [(k, f.read_text()) for k, f in files.items() if f.exists()]
    if not rows:
        pytest.skip("no licence texts here")
    found = licenses.scan(spark.createDataFrame([(k, t.upper().replace("\n", " \r\n")) for k, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert {rows[r.doc_id][0]: r.license for r in found.collect()} == {k: k for k, _ in rows}


@pytest.mark.parametrize("columns", ["doc_id long, text string, lang string, source string, score double, part string, mask int, lang_pred string, held_out string"])
def test_new_operators_keep_apart_clashing_columns(spark, columns):
    row = (1, "a b c", "en", "s", 0.5, "p", 3, "x", "y")
    d = spark.createDataFrame([row, (None,) * 9], columns)
    assert language.identify(d).columns == ["doc_id", "held_out", "lang_pred", "score", "lang_spans"]
    model = language.Model(["en"], np.ones((language.BUCKETS + len(language.NAMES), 1), np.int64))
    assert [c for c in language.label(d, model).columns] == ["doc_id", "lang", "source", "part", "mask", "held_out", "lang_pred", "score", "lang_spans"]
    assert interactions.audit(d, spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")).count() == 2 * 600
