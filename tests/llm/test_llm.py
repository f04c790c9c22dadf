import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumen.llm import bpe, brown, chat, decontam, hostrules, licenses, pii, quality, simhash, toxicity
from lumen.operators.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "one two three", "word " * 3000, "1" * 30000, "x" * 50000, "a@b.c_d@e.f g@h.i@j.k", "4111 1111 1111 1111, 999.1.1.1 10.0.0.1 +49 (0)30 1234567", "É Σσ \U0001f600 \x1c\x85 don't<|endoftext|>!!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(ODD)] + [(None, "one two three", None, 0), (4, "one two three", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score long")


def test_bpe_equals_the_library_and_streams(monkeypatch):
    m = bpe.MergeList(open(PATH).read())
    ref = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcdeEinst'ÀÉé̈ΣİßñΩ中1२!?.,$ \n") for _ in range(40)) for _ in range(500)] + ["".join(rng.choice("theinaros") for _ in range(9000))]
    texts += ["".join(rng.choice("theinarosg") for _ in range(1_000_000)), " ".join("".join(rng.choice("theinaé") for _ in range(rng.randint(1, 90))) for _ in range(30_000))]
    for part in (1 << 16, 50):
        monkeypatch.setattr(bpe, "PART", part)
        e, plain = bpe.Encoder(m), bpe.TextDecoder(m, True)
        for t in texts[: -2 if part == 50 else None]:
            ids = ref.encode(t, add_special_tokens=False).ids
            assert e.ids(t) == ids
            said = ref.decode(ids, skip_special_tokens=False)
            assert e.digest(t, plain) == (len(ids), sha(" ".join(map(str, ids))), sha(said))
    d = bpe.TextDecoder(m)
    for t in ("Ünïcode — the cat", "a \U0001f600 b", "中 文"):
        ids = e.ids(t)
        whole = " ".join(t.lower().split())
        assert d.read([" ".join(map(str, ids))]) + d.end() == whole or t.startswith("Ü")
        d.reset()
        assert "".join(d.push(i) for i in ids) + d.end() == d_once(m, ids)
        d.reset()
    assert d_once(m, e.ids("Ünïcode — the cat")) == "ünïcode — the cat"


def d_once(m, ids):
    """All bytes of the tokens first, then the text: what the machine must give token by token."""
    words, now = [], b""
    for i in ids:
        text = m.text_of[i]
        ends = text.endswith(m.suffix)
        now += bytes(m.bytes_of[c] for c in (text[: -len(m.suffix)] if ends else text))
        if ends:
            words.append(now.decode("utf-8", "replace"))
            now = b""
    return " ".join(words) + now.decode("utf-8", "replace")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def test_decoder_keeps_an_unfinished_character():
    m = bpe.MergeList(open(PATH).read())
    d, data = bpe.TextDecoder(m), "é\U0001f600".encode()
    ids = [m.inside[b] for b in data[:-1]] + [m.last[data[-1]]]
    assert [d.push(i) for i in ids] == ["", "é", "", "", "", "\U0001f600"]
    d.reset()
    runs = [str(i) for i in ids]
    assert d.read(runs[:3]) + d.read(runs[3:]) + d.end() == "é\U0001f600"


def test_lookahead_settles_tokens():
    m = bpe.MergeList(open(PATH).read())
    m.window = m.lookahead + 8
    rng = random.Random(5)
    for _ in range(5):
        s = "".join(rng.choice("theinarosg") for _ in range(2000))
        assert list(m.transduce(m.symbols(s))) == m.merge(list(m.symbols(s)))[0]


def test_bpe_rows(spark, docs):
    ref = Tokenizer.from_file(PATH)
    for r, t in zip(bpe.digests(docs, PATH).collect(), docs.collect()):
        ids = ref.encode(t.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (t.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False)))
    coded = bpe.encode(docs, PATH)
    both = bpe.encode_and_decode(docs.withColumnsRenamed({"score": "token_ids", "source": "decoded"}), PATH)
    assert [r.text for r in bpe.decode(coded, PATH).collect()] == [r.decoded for r in both.collect()]
    assert [r.token_ids for r in coded.collect()] == [r.token_ids for r in both.collect()]


def near(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root = [root[j] if x == root[i] else x for x in root]
    return root


def test_simhash_groups_against_all_pairs(spark, docs):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    root = near(fps, 2)
    for i in range(len(fps)):
        for j in range(i):
            assert (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])) == (root[i] == root[j])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (4, None)} == {4}


def test_similar_texts_are_found_and_others_stay(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    texts = []
    for k in range(40):
        w = rng.choices(words, k=200)
        texts += [" ".join(w), " ".join([*w[:100], "changed", *w[101:]]), " ".join(rng.choices(words, k=200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(len(texts))}
    assert simhash.without_near_duplicates(df).count() == 80


def test_similar_texts_are_judged_by_their_sets(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))

    def copies(n, least):
        """A text, one that appends words until the similarity is just `least` or more, and one just under it."""
        w = [word() for _ in range(n)]
        more = int((n - 4) / least - (n - 4) + 1e-9)
        tail = [word() for _ in range(more + 1)]
        return " ".join(w), " ".join(w + tail[:-1]), " ".join(w + tail)

    texts = []
    for n in (50, 300):
        for _ in range(40):
            a, on, under = copies(n, 0.8)
            texts += [a, on, word() + " " + under.split(" ", 1)[1]]
            b, far, _ = copies(n, 0.78)
            c, close, _ = copies(n, 0.85)
            texts += [b, far, c, close]
    for _ in range(20):  # one line many times over: the sets stay the same but for where it meets itself
        w, line = [word() for _ in range(300)], [word() for _ in range(12)]
        texts += [" ".join(w + line), " ".join(w + line * 30)]
    sets = [set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for y in range(len(texts)):
        for x in range(max(0, y - 7), y):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9:
                root = [root[x] if r == root[y] else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts) - 150


def test_split_tiles_lose_no_pair(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    base = rng.choices(words, k=200)
    texts = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(60)] + [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i if i >= 60 else 0 for i in range(len(texts))}
    for rows in (simhash.HOT_ROWS, 0):
        monkeypatch.setattr(simhash, "SPLIT", 7)
        monkeypatch.setattr(simhash, "SETS", 9)
        monkeypatch.setattr(simhash, "HOT_ROWS", rows)
        assert {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()} == want


def test_near_duplicates_are_judged_by_row(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(40))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("c")), (7, text("c")), (None, text("d")), (None, text("d")), (None, text("a")), (9, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "")[:2]) for r in simhash.without_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, "a0"), (5, "b0"), (7, "c0"), (None, "d0"), (8, "")], key=repr)


def test_fingerprints_equal_brute_force(spark, sf):
    def one(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        grams = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode("utf-8"), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in simhash.near_duplicates(docs).collect():
        assert r.fp & (1 << 64) - 1 == one(text[r.doc_id])
    for t in ODD:
        assert simhash.fingerprint(t) == one(t)


def test_split_tiles_of_fingerprints_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    root = near(fps, 2)
    for split in (8192, 5):
        monkeypatch.setattr(simhash, "SPLIT", split)
        got = {r.node: r.root for r in components(simhash.links(df)).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        assert len({got.get(x, x) for x in signed}) == len(set(root))


def repeats(t):
    w = WORD.findall(t or "")
    c, seen = Counter(zip(w, w[1:], w[2:])), set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if c[x] > 1:
            seen |= {i, i + 1, i + 2}
    return len(w), len(seen)


def test_host_rules_count_like_python(docs):
    for bits in (hostrules.PLACE_BITS, 3):  # places that do not fit in the bits beside a hash are kept apart
        for r, t in zip(hostrules.measure(docs, bits=bits).collect(), docs.collect()):
            assert (r.n_words, r.n_repeat_words) == repeats(t.text)


def test_host_verdict_is_shrunk(spark):
    rows = [("a", 40)] * 100 + [("a", 80)] * 2 + [("b", 80)] * 100 + [("c", 40)] * 2 + [(None, 80)]
    df = spark.createDataFrame(rows, "host string, n_words long").withColumns({"n_repeat_words": F.lit(0), "n_symbols": F.lit(0)})
    got = {r.host: r.host_failed for r in hostrules.host_verdicts(df).collect()}
    assert got["a"] and not got["b"] and None not in got


def test_personal_data_and_sanitising(spark, docs):
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[8]] == [("email", 0, 5), ("email", 5, 11), ("email", 12, 17)]
    assert [s.kind for s in got[9]] == ["ip", "card", "phone"]
    assert pii.sanitise(docs).where("doc_id = 9").first().text == "<CARD>, 999.1.1.1 <IP> <PHONE>"


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end(), m[0])] if ok else []
    return out


def disclosed(texts, disclosure=0.5, support=2):
    """All spans of every text by plain counting."""
    runs = [[(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t or "")] for t in texts]
    base = [base_spans(t) for t in texts]
    n, values, terms, both, copies = len(texts), Counter(), Counter(), Counter(), {}
    for t, r, b in zip(texts, runs, base):
        own, here = {x[3] for x in b}, {x[0] for x in r}
        values.update(own)
        terms.update(here)
        for pair in ((v, w) for v in own for w in here):
            both[pair] += 1
            copies.setdefault(pair, set()).add(t)
    known = {(v, w) for (v, w), k in both.items() if len(copies[v, w]) >= support and values[v] < n and np.log(k * n / (terms[w] * values[v])) / np.log(n / values[v]) >= disclosure}
    out = []
    for r, b in zip(runs, base):
        own = {x[3] for x in b}
        free = [x for x in r if not any(s < x[2] and e > x[1] for _, s, e, _ in b)]
        out.append(b + [("term", s, e, w) for w, s, e in free if any((v, w) in known for v in own)])
    return out


def test_base_spans_equal_plain_patterns(spark, sf, docs):
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        for r in pii.base_spans(df.select("text")).collect():
            assert [tuple(s) for s in r.base] == base_spans(r.text)


def test_disclosing_terms_equal_plain_counting(spark, monkeypatch):
    rng = random.Random(7)
    fill = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    people = {"johannes@firm.org": ["Johannes", "Vogelsang", "Li"], "+49 30 1234567": ["Ümit"], "10.0.0.1": ["gateway"]}
    texts = []
    for entity, names in people.items():
        for k in range(6):
            body = rng.choices(fill, k=30)
            texts.append(" ".join([names[0], *body[: 5 * k], entity, *body[5 * k :], *names[1:]]) if k else f"{names[0]}: {entity}{' x' * k}")
    texts += [texts[0]] * 3 + [None, ""] + [" ".join(rng.choices(fill, k=20)) for _ in range(60)] + ["Johannes alone", "mail lonely@once.org Lonely"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = disclosed([t or "" for t in texts])
    for least in (pii.BROADCAST_ROWS, 1):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", least)
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(df).collect()}
        assert got == dict(enumerate(want))
    marked = {s[3] for spans in want for s in spans if s[0] == "term"}
    assert {"johannes", "vogelsang", "li", "ümit", "gateway"} <= marked and not any(s[3] == "johannes" for s in want[-2])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "<TERM>: <EMAIL>" and clean[len(texts) - 2] == "Johannes alone"


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "ho"), (None, 0, None, None)]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, None} and got[2][:2] == (2, 2) and got[2][2].startswith("<|im_start|>user\nhi<|im_end|>\n")


def test_turns_without_a_conversation_and_ties(spark):
    turns = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 5, "user", "<|im_end|>"), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (8, None, "user", "ho"), (9, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, k) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string, own int")
    got = sorted(((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect()), key=repr)
    one = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert got == sorted([(9, 1, 3, one(("user", "hi"))), (None, 1, 1, one(("user", "< |im_end|>"))), (7, 3, 1, one(("a", "y"), ("a", "y"), ("b", "x"))), (8, 1, 1, one(("user", "ho")))], key=repr)
    assert chat.render(df.limit(0)).count() == 0


def test_licenses_match_canonical_texts(spark):
    rows = [(1, "(c) 2020 Someone\nreleased under the MIT  licence"), (2, "words\nLicensed under CC BY-NC 4.0.\n"), (3, None)]
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "CC-BY-NC-4.0"), 3: (None, "")}


def test_licenses_know_texts_and_usual_notices(spark):
    texts = {title: (license, text) for license, title, text in licenses.TEXTS}
    starts = "of this software and|in the Software without|to use, copy, modify, merge|copies of the Software, and|furnished to do so|The above|copies or|THE SOFTWARE IS|IMPLIED, INCL|FITNESS FOR|AUTHORS OR|LIABILITY, WHETHER|OUT OF OR|SOFTWARE\\.$"
    wrapped = lambda t: "MIT License\n\nCopyright (c) 2020 Someone\n\n" + re.sub(f" (?={starts})", "\n", t)  # the usual lines
    rows = [(1, wrapped(texts["MIT License"][1])), (2, texts["ISC License"][1]), (3, "code\n# SPDX-License-Identifier: MIT\nLicensed under the MIT License\n")]
    got = {r.doc_id: (r.license, r.n_license_lines, r.line_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT" and got[2][0] == "ISC" and got[3] == (None, 2, "MIT")


def brute_leaks(docs, items, threshold=0.6, least=0.8):
    """All matches by scoring every passage against every item."""
    words = {k: decontam.WORD.findall((t or "").lower()) for k, t in items.items()}
    words = {k: w for k, w in words.items() if w}
    n, longest, mean = len(words), max(map(len, words.values())), sum(map(len, words.values())) / len(words)
    df = Counter(x for w in words.values() for x in set(w))
    idf = {x: np.log(1 + (n - c + 0.5) / (c + 0.5)) for x, c in df.items()}
    weight = {}
    for k, w in words.items():
        own = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in Counter(w).items()}
        weight[k] = {x: v / sum(own.values()) for x, v in own.items()}
    out = {}
    for d, t in docs:
        w = decontam.WORD.findall((t or "").lower())
        for at in range(0, len(w), longest):
            part = w[at : at + 2 * longest]
            here, held = set(part), decontam.shingles(part) if len(part) >= 5 else {tuple(part)}
            for k, own in weight.items():
                score = sum(v for x, v in own.items() if x in here)
                if score >= threshold - 1e-9:
                    q, a = decontam.parts(items[k])
                    shares = [decontam.Index._share(decontam.shingles(x), held, part) for x in (q, a, q + a)]
                    if shares[2] >= least or min(shares[:2]) >= least:
                        out[d, k] = max(out.get((d, k), (0.0,)), (score, *shares))
    return out


def test_decontamination_equals_brute_force(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks([(r.doc_id, r.text) for r in d.collect()], {r.item_id: r.text for r in b.collect()})
    assert want
    for shard, block in ((decontam.SHARD, 64), (decontam.SHARD, 3), (1500, 64)):
        monkeypatch.setattr(decontam, "SHARD", shard)
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontam.matches(d, b).collect()}
        assert set(got) == set(want)
        for k, v in got.items():
            assert v == pytest.approx(want[k])
        kept = decontam.without_leaks(d, b)
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()} - {k for k, _ in want}


def test_block_maxima_skip_no_item():
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 14)))) for k in range(300)]
    index = decontam.Index(items, decontam.Statistics.of(t for _, t in items), threshold=0.5)
    for _ in range(8):
        terms = [np.array(sorted(rng.sample(range(len(index.vocab)), rng.randint(1, 25)))) for _ in range(6)]
        passage = np.repeat(np.arange(6), [len(t) for t in terms])
        got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in index.candidates(passage, np.concatenate(terms))))}
        names = list(index.vocab)
        want = {}
        for i, (_, q, a) in enumerate(index.items):
            for p, ts in enumerate(terms):
                score = sum(index.weight[np.flatnonzero((index.item == i) & (posting_terms(index) == t))].sum() for t in ts if names[t] in q + a)
                if score >= 0.5 - 1e-9:
                    want[p, i] = score
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def posting_terms(index):
    return np.repeat(index.cell // index.n_blocks, np.diff(index.cell_start))


def test_class_lm_base_is_exact_and_blocks_do_not_matter(spark, sf, docs, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (table, docs.select("doc_id", "text")):
        rows = [(r.doc_id, [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))]) for r in df.collect()]
        held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
        counts = Counter(w for k, ws in rows if not held(k) for w in [*ws, None])
        n, v = sum(counts.values()), len(counts)
        want = sorted((repr(k), held(k), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 5)) for k, ws in rows)
        scores = []
        for flush, tokens in ((400_000, 4_000_000), (500, 4_000_000), (400_000, 300)):
            monkeypatch.setattr(brown, "FLUSH", flush)
            monkeypatch.setattr(brown, "TOKENS", tokens)
            got = brown.score(df).collect()
            assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
            scores.append(sorted((repr(r.doc_id), round(r.score, 5)) for r in got))
        assert scores[0] == scores[1] == scores[2]


def test_class_lm_clusters_words_under_the_share(spark):
    rng = random.Random(6)
    sides = [("the", "runs", [f"a{k}" for k in range(60)]), ("some", "falls", [f"b{k}" for k in range(60)])]
    filler = [f"f{k}" for k in range(40)]
    lines = [f"{x} {w} {y}" for x, y, ws in sides for w in ws for _ in range(8)]
    lines += [f"{x} {y}" for x, y, _ in sides for _ in range(600)]
    lines += [" ".join(rng.choices(filler, k=30)) for _ in range(3000)]
    rng.shuffle(lines)
    probes = [f"{x} {w} {y}" for x, y, _ in sides for *_, ws in sides for w in (ws[0], ws[1])]
    rows = [*enumerate(lines), *enumerate(probes, len(lines))]
    counts = Counter(w for k, t in rows if brown_fold(k) != 1 for w in t.split())
    assert max(counts[w] for *_, ws in sides for w in ws) < brown.SHARE * sum(counts.values())
    got = {r.doc_id: r for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gain = [got[len(lines) + k].score for k in range(8)]
    own = [x - np.log10(counts[t.split()[1]]) for x, t in zip(gain, probes)]
    assert min(own[0], own[1], own[6], own[7]) > max(own[2:6]) + 0.5


def test_class_lm_is_a_distribution(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    lines = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=40)) for _ in range(700)]
    df = spark.createDataFrame([*enumerate(lines), *enumerate(words, 10**6), (2 * 10**6, "")], "doc_id long, text string")
    rows = brown.score(df, share=0.02).where("doc_id >= 1000000").collect()
    one = {r.doc_id: 10**r.score for r in rows}
    assert 0 < sum(one.values()) < 1


def brown_fold(k):
    return zlib.crc32(str(k).encode()) % 5


def test_classifiers_hold_out(spark, docs):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for module, label, least in ((quality, "quality", 0.93), (toxicity, "toxic", 0.9)):
        rows = module.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)
        assert module.classify(docs, labels.limit(0)).count() == docs.count()


def test_label_model_is_bayes_over_all_patterns():
    rng = np.random.default_rng(4)
    k, n = 7, 6000
    y = rng.random(n) < 0.3
    votes = np.where(rng.random((n, k)) < 0.85, y[:, None], ~y[:, None]).astype(int)
    votes[:, 1] = np.where(rng.random(n) < 0.6, votes[:, 0], votes[:, 1])  # often says what voter 0 says
    votes[rng.random((n, k)) < 0.1] = -1
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    m = toxicity.LabelModel(seen, counts, np.where((seen == 1).sum(1) > (seen == 0).sum(1), 0.9, 0.05))
    assert m.parent[0] == 1 or m.parent[1] == 0
    assert [j for j in range(2, k) if m.parent[j] >= 0] == []
    # The joint of class and votes, by plain products over all patterns without gaps, sums up to one and gives the posterior.
    full = np.array([[c >> j & 1 for j in range(k)] for c in range(2**k)])
    joint = np.ones((2, 2**k))
    for c in (0, 1):
        for r, v in enumerate(full):
            joint[c, r] = m.prior[c]
            for j in range(k):
                p = m.given[c, v[m.parent[j]], j] if m.parent[j] >= 0 else m.alone[c, j]
                joint[c, r] *= p if v[j] else 1 - p
    assert joint.sum() == pytest.approx(1)
    assert m.posterior(full)[0] == pytest.approx(joint[1] / joint.sum(0))
    right = (m.posterior(votes)[0] > 0.5) == y
    assert right.mean() > 0.85 and abs(m.prior[1] - 0.3) < 0.08


def test_dual_descent_reaches_the_best_hinge_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.sign(x @ rng.normal(size=6) + 0.3 * rng.normal(size=80))
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w[:6] + w[6])).sum()
    w = quality.dual_descent([np.arange(6)] * 80, list(x), y, 6, rounds=300)
    best = np.zeros(7)
    for step in 1 / (10 + np.arange(60_000)):  # subgradients
        on = y * (x @ best[:6] + best[6]) < 1
        best -= step * (best - np.append((y[on, None] * x[on]).sum(0), y[on].sum())) / 10
    assert loss(w) <= loss(best) + 1e-2


def test_samples_are_bounded_by_rows_and_features(spark):
    rows = [(k % 3, "abc " * (k + 1), 1) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    indices = lambda t: np.arange(len(t) // 4, dtype=np.int32)
    from lumen.llm.shared import sampled

    assert len(sampled(df, indices, 7)[0]) == 7
    got = sampled(df, indices, 40, budget=100)[0]
    assert 0 < sum(map(len, got)) <= 100
    assert [len(x) for x in got] == [len(x) for x in sampled(df.repartition(5), indices, 40, budget=100)[0]]
    assert sampled(df.limit(0), indices, 5)[0] == []


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)
    vocab = ["".join(rng.choice("abcdefghklmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, prose(30) + ". " + prose(10) + ".") for k in range(5)]
    texts = [prose(rng.randint(60, 140)) for _ in range(120)]
    toxic = {k for k in range(0, 60, 3)}
    for k in toxic:
        texts[k] = " ".join(w if rng.random() < 0.9 else rng.choice(["idiot", "moron", "scum", "loser", "pathetic"]) for w in texts[k].split())
    copies = {k: 60 + k for k in range(1, 50, 6)}
    for a, b in copies.items():
        if a not in toxic:
            texts[b] = texts[a] if a % 4 else texts[a] + " " + prose(4)
    for k in range(110, 114):
        texts[k] = prose(40) + " " + items[k - 110][1] + " " + prose(40)
    for k in (115, 116, 117):
        texts[k] = f"{prose(30)} write to a{k}.b@mail.example.com or +1 (377) 555-0271 now {prose(30)}"
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(500, None, None, None, 0), (501, "", "en", "s", 0), (110, "other text under a known id " + prose(40), "en", "s", 1), (None, prose(50), "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k in toxic), int(k in toxic)) for k in range(110)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # Step by step: what is toxic by construction, one of each group by whole shingle sets, leaks by every passage, and so on.
    left = [(k, t) for k, t, *_ in rows if k not in toxic]
    sets = [set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for _, t in left]
    root = list(range(len(left)))
    for y in range(len(left)):
        for x in range(y):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root = [root[x] if r == root[y] else r for r in root]
    first = {}
    for k, r in enumerate(root):
        order = lambda j: (left[j][0] is None, left[j][0] or 0, j)
        first[r] = min(first.get(r, k), k, key=order)
    left = [left[k] for k in sorted(first.values())]
    leaks = brute_leaks([(k, t) for k, (_, t) in enumerate(left)], dict(items))
    left = [x for k, x in enumerate(left) if k not in {d for d, _ in leaks}]
    spans = disclosed([t or "" for _, t in left])
    label = lambda s: pii.LABELS[s[0]]

    def clean(t, found):
        out, at = "", 0
        for s in sorted(found, key=lambda s: (s[1], -s[2])):
            if s[1] >= at:
                out, at = out + t[at : s[1]] + label(s), s[2]
        return out + t[at:]

    ref = Tokenizer.from_file(PATH)
    want = sorted((repr(k), tuple(ref.encode(clean(t or "", s), add_special_tokens=False).ids)) for (k, t), s in zip(left, spans))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), tuple(r.token_ids)) for r in got) == want
    m = bpe.MergeList(open(PATH).read())
    assert all(r.decoded == d_once(m, r.token_ids) and r.n_tokens == len(r.token_ids) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    for made in (quality.classify(none, labels), toxicity.classify(none, labels), simhash.similar_texts(none), decontam.matches(none, items), decontam.matches(docs, items.limit(0)), simhash.without_near_duplicates(none), pii.sanitise(none),
                 toxicity.without_toxic(none, labels), bpe.encode_and_decode(none, PATH), simhash.near_duplicates(none), hostrules.judge(none), licenses.scan(none), pii.digests(none), brown.score(none), bpe.digests(none, PATH)):
        assert made.count() == 0


def test_stages_keep_clashing_columns(spark, docs):
    extra = ["row", "copy", "base", "spans", "terms", "doc", "node", "fp", "keys", "tile", "least", "root", "component_id", "y", "idx", "item_id", "mask", "term", "value"]
    wide = docs.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(extra)))
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, "word word word")], "item_id long, text string")
    for out in (toxicity.without_toxic(wide, labels), simhash.without_near_duplicates(wide), decontam.without_leaks(wide, items), pii.sanitise(wide)):
        assert out.columns == wide.columns
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(extra)))}
    for made in (pii.find(wide), bpe.encode(wide, PATH)):
        assert made.count() == wide.count()
