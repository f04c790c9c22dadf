"""Operator 3: toxicity by weak supervision.

1. Voters. Each says toxic, clean or nothing of a text:
   - four seed lexicons (insults of the mind, of worth, disgust, mockery), which need no labels;
   - four lexicons of word beginnings (4, 5, 6 bytes, and whole words to 8) that the labelled sample's toxic texts hold far
     oftener than its clean ones: an entry's excess must have a chance of under exp(-RARE) (Chernoff's bound);
   - a lexicon of beginnings that clean texts hold far oftener, which votes for clean;
   - patterns: second person beside an entry, capitals or rows of exclamation marks, letters hidden by marks, two
     different entries of the lexicons.
   A voter says toxic where it finds what it looks for, clean where a text of LONG different words or more has none of it (the
   clean lexicon the other way round), and else nothing.
2. Label model: a generative model of the votes with a hidden class, fitted without labels by expectation maximisation to
   the votes of all documents outside the hold-out fold, counted by Spark. Correlations are part of it: given the class, every
   voter depends on one other (the tree of the largest mutual information given the class, Chow and Liu, found anew from
   the expected counts), so voters that repeat each other count once. Accuracies are the tables at its nodes.
3. Classifier: a linear (logistic) model over word beginnings, trained on the posterior labels of labelled and unlabelled
   texts alike; the rare class weighs more.

Near copies in the samples count once, or the words of one toxic text that was copied often would pass for signs.
The beginnings of a lexicon come from at most SAMPLE labelled rows, the classifier is trained on these and at most as many
rows without a label (the documented bounds, besides shared.FEATURES); votes, counts and scores cover all rows and whole texts.

Defined results: a null text is empty and scored like an empty text; every row gives one row, repeated and null ids
too; without labels of both classes the seeds and patterns vote alone; without any toxic vote every score is the smoothed
share of toxic labels; an empty table gives an empty table. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import fold, labelled, sampled

BITS, SAMPLE, LONG, RARE, LOOSE, SURE = 20, 8_000, 20, 20.0, 0.5, 0.85
#: Chosen among 0, 1/4, 1/2, 3/4 and 1 on folds 1 to 4 alone: the most toxic texts found without one more clean text accused.
BALANCE = 0.25
#: Words that insult, by what they aim at.
SEEDS = {
    "mind": "idiot idiots idiotic moron moronic stupid stupidity dumb imbecile fool brainless dummkopf dumm blöd imbécile débile estúpido",
    "worth": "worthless loser losers pathetic trash garbage scum useless waste wertlos versager abschaum minable nul basura inútil",
    "disgust": "disgusting disgust vile filthy gross revolting vermin ekelhaft widerlich dégoûtant ordure asqueroso",
    "mockery": "clown clowns joke ridiculous laughable freak creep lächerlich ridicule bouffon payaso ridículo",
}
#: Words that address a person.
SECOND = "you your yours youre u du dich dein deine ihr tu toi vous votre usted ustedes"
#: Bits of the lexicons that an index may be in; the voters are the first nine and four patterns.
LEXICONS = ("mind", "worth", "disgust", "mockery", "four", "five", "six", "whole", "clean", "second", "sure")
VOTERS = (*LEXICONS[:9], "address", "shout", "hidden", "some", "many")
#: So many different words of the lexicons.
MANY = (2, 4)
#: Indices that say that a text shouts, or hides letters.
SHOUTS, HIDES = 1 << BITS, (1 << BITS) + 1
#: Indices of the classifier alone: so many different words of the lexicons or more; the length, by powers of two.
HITS = (1, 2, 3, 4, 6, 8, 12, 16)
SIZE = (1 << BITS) + 2 + len(HITS) + 24
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
#: Keeps the first bytes of eight.
FIRST = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)
MARKS = ("**", "##", "@@", "$$")
HIDDEN = re.compile(r"[A-Za-z](?:\*\*|##|@@|\$\$)[*#@$]*[A-Za-z]")


def shouted(text: str, letters: int) -> bool:
    """Are over a third of the letters capitals (A-Z), and twenty or more?"""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(((raw - np.uint8(65)) < 26).sum())
    return capitals >= 20 and 3 * capitals > letters


def _hashed(code: np.ndarray, kind: int) -> np.ndarray:
    """Indices of beginnings given as numbers; the two upper bits are the kind: 4, 5 or 6 bytes, or whole words to 8."""
    return (np.int32(kind << (BITS - 2)) | ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(66 - BITS)).astype(np.int32)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Four indices for every different word of a text: its beginnings of 4, 5, 6 bytes and itself (its first eight
    bytes); -1 where it is shorter. The first row says what the patterns find."""
    text = text or ""
    raw = text.lower().encode("utf-8", "surrogatepass") + bytes(9)
    letter = LETTER[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate(([0], edge))
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(raw) - 8, ">u8", raw, strides=(1,))  # the eight bytes from each place on
    code = np.unique(eight[start].astype(np.uint64) & FIRST[np.minimum(length, 8)])
    out = np.full((len(code) + 1, 4), -1, np.int32)
    out[0, :2] = SHOUTS if "!!" in text or shouted(text, int(letter.sum())) else -1, HIDES if any(x in text for x in MARKS) and HIDDEN.search(text) else -1
    for kind, cut in enumerate((32, 24, 16)):
        head = code >> np.uint64(cut)
        out[1:, kind] = np.where(head & np.uint64(255) > 0, _hashed(head, kind), -1)
    out[1:, 3] = _hashed(code, 3)
    return out


def whole(words: str) -> np.ndarray:
    """Indices of whole words (their first eight bytes)."""
    return _hashed(np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "big") for w in words.split()], np.uint64), 3)


def excess(k: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Chernoff's bound, as a negative logarithm, of the chance that k or more of n are of a class of that share; 0 under it."""
    p = np.clip(k / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    return np.where(p > share, n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))), 0.0)


#: Hash functions whose least values over a text's words name it, four together.
MIXES = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def unlike(rows: list[np.ndarray]) -> list[int]:
    """Places of the rows that are no near copies of earlier ones, so that a text that was copied often counts once.

    Rows whose words agree in all four least values of one of eight groups of hash functions are taken for copies: of texts
    that share nine words in ten nearly all, of texts that share two in ten one in eighty.
    """
    seen, kept = set(), []
    for k, m in enumerate(rows):
        words = m[1:, 3].astype(np.uint64)
        least = ((words * MIXES[:, None]) >> np.uint64(20)).min(1, initial=np.uint64(2**64 - 1)).reshape(8, 4)
        names = {(g, x.tobytes()) for g, x in enumerate(least)}
        if not names & seen:
            kept.append(k)
        seen |= names
    return kept


def frequencies(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the texts that hold each index."""
    out = np.zeros(SIZE + 1)
    for m, w in zip(rows, weights):
        out[np.unique(m)] += w  # -1 is the last place
    out[-1] = 0
    return out


def lexicons(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each index the bit mask of the lexicons (as in LEXICONS) that hold it; the last place, for -1, is in none."""
    of = np.zeros(SIZE + 1, np.uint16)
    for k, words in enumerate([*SEEDS.values()]):
        of[whole(words)] |= np.uint16(1 << k)
    of[whole(SECOND)] |= np.uint16(1 << 9)
    if 0 < y.sum() < len(y):
        toxic, clean = frequencies(rows, y == 1), frequencies(rows, y == 0)
        share = float(y.mean())
        bad = np.flatnonzero((excess(toxic, toxic + clean, share) > RARE) & (toxic >= LOOSE * (toxic + clean)))
        bad = bad[bad < 1 << BITS]
        of[bad] |= np.uint16(16) << (bad >> (BITS - 2)).astype(np.uint16)
        of[bad[toxic[bad] >= SURE * (toxic + clean)[bad]]] |= np.uint16(1 << 10)
        of[np.flatnonzero(excess(clean, toxic + clean, 1 - share) > RARE)] |= np.uint16(1 << 8)
    return of


def vote(m: np.ndarray, of: np.ndarray) -> int:
    """The votes as a number to base three, a place for each voter: 0 nothing, 1 toxic, 2 clean.

    A lexicon says toxic for one word that is sure (a seed, or of toxic texts nearly always), or for two others.
    """
    none = 2 if len(m) > LONG else 0
    words = np.bitwise_or.reduce(of[m[1:]], axis=1)
    words = words[words > 0]
    held, hits = words[:, None] >> np.arange(10, dtype=np.uint16) & 1, int((words & 0xFF > 0).sum())
    n, sure = held.sum(0), held[(words >> 10 & 1 | words & 15) > 0].sum(0)
    found = [1 if sure[k] or n[k] > 1 else 0 if n[k] else none for k in range(8)]
    found += [2 if n[8] else int(none > 0), 1 if hits and n[9] else none]
    found += [1 if k >= 0 else none for k in m[0, :2].tolist()]
    found += [1 if hits >= k else 0 if hits > k // 2 else none for k in MANY]
    return sum(v * 3**k for k, v in enumerate(found))


def summed_up(m: np.ndarray, of: np.ndarray) -> np.ndarray:
    """All indices, as often as words have them, with those that say how many words are in lexicons and how long the text is."""
    hits = int((np.bitwise_or.reduce(of[m[1:]], axis=1) & 0xFF > 0).sum())
    own = [HIDES + 1 + k for k, n in enumerate(HITS) if hits >= n] + [HIDES + 1 + len(HITS) + min(len(m).bit_length(), 23)]
    return np.concatenate((m[m >= 0], np.array(own, np.int32)))


def votes_of(codes: np.ndarray, voters: int = len(VOTERS)) -> np.ndarray:
    """A row of votes for each code: 1 toxic, 0 clean, -1 nothing."""
    digits = codes[:, None] // 3 ** np.arange(voters) % 3
    return np.array([-1, 1, 0])[digits]


class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent); voters that say nothing are left out.

    Where the parent says nothing, or there is none, P(vote | class) takes its place.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 60):
        self.n = counts.astype(float)
        self.parent = np.full(votes.shape[1], -1)
        q, self.trace = np.clip(start, 1e-3, 1 - 1e-3), []
        for _ in range(3):
            for _ in range(rounds):
                self._learn(votes, q)
                new, fit = self.posterior(votes)
                self.trace.append(float(self.n @ fit))
                moved = np.abs(new - q).max(initial=0)
                q = new
                if moved < 1e-6:
                    break
            parent = self._tree(votes, q)
            if (parent == self.parent).all():
                break
            self.parent = parent
        self._learn(votes, q)

    def _learn(self, votes: np.ndarray, q: np.ndarray) -> None:
        weight = np.stack([self.n * (1 - q), self.n * q])
        self.prior = (weight.sum(1) + [2.0, 1.0]) / (weight.sum() + 3)
        toxic = weight @ (votes == 1)
        self.alone = (toxic + 0.5) / (toxic + weight @ (votes == 0) + 1)  # [class, voter]
        self.given = np.repeat(self.alone[:, None], 2, 1)  # [class, vote of the parent, voter]
        for j, p in enumerate(self.parent):
            for v in (0, 1) if p >= 0 else ():
                both = weight[:, votes[:, p] == v]
                own = votes[votes[:, p] == v, j]
                up = both @ (own == 1)
                self.given[:, v, j] = (up + 2 * self.alone[:, j]) / (up + both @ (own == 0) + 2)

    def posterior(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic | votes), log P(votes)) of each row."""
        log = np.repeat(np.log(self.prior)[:, None], len(votes), 1)
        for j, p in enumerate(self.parent):
            of = votes[:, p] if p >= 0 else np.full(len(votes), -1)
            for y in (0, 1):
                chance = np.where(of < 0, self.alone[y, j], self.given[y, np.maximum(of, 0), j])
                log[y] += np.select([votes[:, j] == 1, votes[:, j] == 0], [np.log(chance), np.log1p(-chance)], 0.0)
        both = np.logaddexp(log[0], log[1])
        return np.exp(log[1] - both), both

    def _tree(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Parents along the tree of the largest mutual information of two voters given the class."""
        k = votes.shape[1]
        score = np.zeros((k, k))
        for a in range(k):
            for b in range(a):
                said = (votes[:, a] >= 0) & (votes[:, b] >= 0)
                for w in (self.n * (1 - q), self.n * q):
                    t = np.bincount(votes[said, a] * 2 + votes[said, b], w[said], 4).reshape(2, 2) + 0.25
                    share = t / t.sum()
                    score[a, b] += t.sum() * (share * np.log(share / np.outer(share.sum(1), share.sum(0)))).sum()
                score[b, a] = score[a, b]
        parent, near, at = np.full(k, -1), np.zeros(k, int), {0}
        while len(at) < k:
            left = [j for j in range(k) if j not in at]
            j = max(left, key=lambda j: score[j, near[j]])
            parent[j] = near[j] if score[j, near[j]] > np.log(len(votes) + 2) else -1
            at.add(j)
            near = np.where(score[:, j] > score[np.arange(k), near], j, near)
        return parent


def logistic(rows: list[np.ndarray], target: np.ndarray, keep: np.ndarray, rounds: int = 300, decay: float = 1e-3, balance: float = BALANCE) -> tuple[np.ndarray, float]:
    """Weights (dense, zero outside `keep`) and bias of a logistic model fitted to soft targets by accelerated gradient steps.

    A class of share p weighs p ** -balance a row: 0 leaves the rare class as rare as it is, 1 makes both weigh the same.
    """
    toxic = np.clip(target.mean(), 1e-6, 1 - 1e-6)
    mass = target * toxic**-balance + (1 - target) * (1 - toxic) ** -balance
    mass = mass / mass.sum()
    place = np.full(SIZE, -1, np.int64)
    place[keep] = np.arange(len(keep))
    cols = [c[c >= 0] for c in (place[r] for r in rows)]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    w, b, best_w, best_b, t = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0, 1.0
    lip = 0.25 * (1 + max((len(c) for c in cols), default=1)) * 0.25 + decay
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, best_w[col], len(rows)) + best_b, -30, 30)))
        e = (p - target) * mass
        nw = best_w - (np.bincount(col, e[row], len(keep)) + decay * best_w / 10) / lip * 4
        nb = best_b - e.sum() / lip * 4
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        best_w, best_b = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    dense = np.zeros(SIZE, np.float32)
    dense[keep] = w
    return dense, float(b)


class Model:
    def __init__(self, of: np.ndarray, weights: np.ndarray | None, bias: float):
        self.of, self.weights, self.bias = of, weights, bias

    def score(self, idx: np.ndarray) -> float:
        z = self.bias + (float(self.weights[summed_up(idx, self.of)].sum()) if self.weights is not None else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def vote_patterns(docs: DataFrame, of: np.ndarray) -> DataFrame:
    """(code, n): how many documents outside the hold-out fold have each pattern of votes; 3 ** len(VOTERS) rows at most."""
    sent = docs.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            counts.update(vote(features(t.as_py()), sent.value) for t in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["code", "n"])

    return docs.where(fold(F.col("doc_id")) != 0).select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def any_rows(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, y = -1) of about `limit` rows outside the hold-out fold, labelled or not: those with the smallest hashes."""
    rows = docs.where(fold(F.col("doc_id")) != 0).withColumn("y", F.lit(-1))
    at = F.xxhash64(F.lit(3), "doc_id")
    last = rows.select(at.alias("at")).orderBy("at").limit(limit).agg(F.max("at")).first()[0]
    return rows.where(at <= F.lit(last)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    rows, y = sampled(labelled(docs, labels, label, sample), features, sample)
    rows = [r.reshape(-1, 4) for r in rows]
    once = unlike(rows)
    rows, y = [rows[k] for k in once], y[once]
    share = float((y.sum() + 1) / (len(y) + 2))
    of = lexicons(rows, y)
    patterns = vote_patterns(docs, of).toArrow().sort_by("code")
    votes = votes_of(patterns["code"].to_numpy())
    told = (votes[:, :8] == 1).any(1)
    if not told.any():
        return Model(of, None, float(np.log(share / (1 - share))))
    model = LabelModel(votes, patterns["n"].to_numpy(), np.where(told, 0.9, 0.01))
    rows += [r.reshape(-1, 4) for r in sampled(any_rows(docs, sample), features, sample)[0]]
    rows = [rows[k] for k in unlike(rows)]
    target = model.posterior(votes_of(np.array([vote(r, of) for r in rows], np.int64)))[0]
    for k, r in enumerate(rows):  # one by one, or the driver holds all indices twice
        rows[k] = summed_up(r, of)
    on, all_ = frequencies(rows, target), frequencies(rows, np.ones(len(rows)))
    m = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    keep = np.flatnonzero((all_ > 2) & (np.maximum(excess(on, all_, m), excess(all_ - on, all_, 1 - m)) > RARE / 3))
    return Model(of, *logistic(rows, target, keep))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches):
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(features(t.as_py())) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is `least` or more)."""
    scored = score(docs, fit(docs, labels, sample=sample))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of docs that are not rejected; judged row by row, so repeated ids are no matter.

    Without labels of both classes nothing tells texts apart, and all stay.
    """
    model = fit(docs, labels, sample=sample)
    if model.weights is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([m.score(features(t.as_py())) < least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
