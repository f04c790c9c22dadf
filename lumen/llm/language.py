"""Operator 13: the language of texts and of the spans inside them.

Words are runs of letters. The script of a word leaves those languages as candidates that are written in it (a share of
`written` or more of their training letters; a script that no language has leaves all). A word's score in a language is
the logarithm of the probability of its character n-grams (2 to 5, with the word's ends), averaged over the four lengths.
Viterbi search over the words, with a penalty for every change of language, labels each word; equal neighbours make a
span. The language of a text is the one with most letters in its spans, and the score is their share of all letters.

Training counts every text with a language: words are counted in the tasks, and their n-grams fall into `buckets` hash
cells, so what a task emits and what the driver and the workers hold is one table of buckets x languages, whatever the
size of the corpus. Labelling is one map without a shuffle; many texts are searched at once, a step a word.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn
from; languages that tie take the smaller name; a null language teaches nothing, a null id counts as the empty text for
the fold; every row gives one row, repeated ids too; a very long text is labelled whole; other columns are not looked at,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumen.llm.shared import fold

#: First and last code points of blocks of letters, and the script they belong to (Unicode).
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"),
    (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3130, 0x318F, "Hangul"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0x20000, 0x3FFFF, "Han"),
]
NAMES = [*dict.fromkeys(s for *_, s in SCRIPTS), "other"]
_FIRST, _LAST = np.array([a for a, *_ in SCRIPTS]), np.array([b for _, b, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for *_, s in SCRIPTS])

RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BUCKETS, LENGTHS, PENALTY, WRITTEN, SMOOTH = 1 << 17, (2, 3, 4, 5), 8.0, 0.01, 0.5
#: Different words that a task remembers, and words whose texts are searched together.
WORDS, STEP = 200_000, 1_000_000
#: What a word costs in a language that is no candidate.
FAR = -1e6


def scripts(points: np.ndarray) -> np.ndarray:
    """The number of the script of each code point."""
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _SCRIPT[at], len(NAMES) - 1)


def grams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word): the hash cell of every n-gram of every word in lower case, and the number of its word, in that order
    for each length."""
    points = np.frombuffer(("_" + "_".join(w.lower() for w in words) + "_").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = points == ord("_")
    of = np.cumsum(edge) - 1
    cells, numbers = [], []
    for n in LENGTHS:
        last = len(points) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, np.uint64)
        inside = np.zeros(last, np.int32)
        for k in range(n):
            h = (h ^ points[k : last + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inside += edge[k : last + k]
        # An n-gram may hold the marks of its word's ends, but not reach into another word.
        own = np.flatnonzero(inside == 0)
        cells.append((h[own] % np.uint64(buckets)).astype(np.int64))
        numbers.append(of[own])
    return np.concatenate(cells), np.concatenate(numbers)


def letters(words: list[str]) -> np.ndarray:
    """Letters of every word by script: an array words x scripts."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(of * len(NAMES) + scripts(points), minlength=len(words) * len(NAMES)).reshape(-1, len(NAMES))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, cell, n) over rows (text, lang): n-grams by cell, and from `buckets` on the letters by script."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        table = defaultdict(lambda: np.zeros(buckets + len(NAMES), np.int64))

        def settle():
            for lang, words in held.items():
                known = [w for w in words if any(map(str.isalpha, w))]
                if known:
                    n = np.array([words[w] for w in known])
                    cells, of = grams(known, buckets)
                    np.add.at(table[lang], cells, n[of])
                    table[lang][buckets:] += n @ letters(known)
            held.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                if text.is_valid:
                    held[lang].update(RUN.findall(text.as_py()))
            if sum(map(len, held.values())) > WORDS:
                settle()
        settle()
        for lang, n in table.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "cell", "n"])

    found = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return found.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Languages by name, log-probabilities of cells (buckets x languages) and which scripts each is written in."""

    def __init__(self, langs: list[str], n: np.ndarray, written: float = WRITTEN):
        cells, by_script = n[: -len(NAMES)].astype(np.float64), n[-len(NAMES) :]
        self.langs, self.buckets = langs, len(cells)
        self.logs = np.log((cells + SMOOTH) / (cells.sum(0) + SMOOTH * len(cells))).astype(np.float32)
        self.written = by_script >= written * np.maximum(by_script.sum(0), 1)
        self.written[~self.written.any(1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of every word in every language."""
        cells, of = grams(words, self.buckets)
        out = np.stack([np.bincount(of, self.logs[cells, k], len(words)) for k in range(len(self.langs))], 1) / len(LENGTHS)
        out[~self.written[letters(words).argmax(1)]] = FAR
        return out


def train(rows: DataFrame, buckets: int = BUCKETS, written: float = WRITTEN) -> Model:
    """The model of rows (text, lang), from counts over all of them; the driver receives one table of buckets x languages."""
    t = counts(rows, buckets).toArrow()
    names = sorted(set(t["lang"].to_pylist()))
    n = np.zeros((buckets + len(NAMES), len(names)), np.int64)
    if names:
        n[t["cell"].to_numpy(), np.searchsorted(np.array(names, object), t["lang"].to_numpy())] = t["n"].to_numpy()
    return Model(names, n, written)


def search(texts: list[np.ndarray], scores: np.ndarray, penalty: float = PENALTY) -> list[np.ndarray]:
    """The best languages of the words of all texts, given as numbers of rows of scores: Viterbi search, one step a word,
    over all texts that are that long."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    words = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # how many texts have a word at each step
    now, stays, tops = np.zeros((len(order), scores.shape[1])), [], []
    for t in range(longest):
        a = int(live[t])
        s = now[:a]
        if t:
            top = s.argmax(1)
            change = s[np.arange(a), top] - penalty
            stay = s >= change[:, None]
            stays.append(stay)
            tops.append(top.astype(np.int16))
            s = np.maximum(s, change[:, None])
        now[:a] = s + scores[words[first[:a] + t]]
        if t % 64 == 63:
            now[:a] -= now[:a].max(1, keepdims=True)
    path, at = np.zeros(len(words), np.int16), now.argmax(1) if len(order) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a = int(live[t])
        path[first[:a] + t] = at[:a]
        if t:
            at[:a] = np.where(stays[t - 1][np.arange(a), at[:a]], at[:a], tops[t - 1])
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        out[i] = path[first[k] : first[k] + sizes[k]]
    return out


class Numbers(dict):
    """Numbers words as they are first seen, -1 for those without a letter; `fresh` has the new ones."""

    def __init__(self):
        self.fresh: list[str] = []
        self.size = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = self.size if any(map(str.isalpha, word)) else -1
        if n >= 0:
            self.size += 1
            self.fresh.append(word)
        return n


class Labeller:
    """Labels texts, remembering the scores of words from one batch to the next."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.scores, self.sizes = np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64)

    def settle(self) -> None:
        """Scores what is new among the known words."""
        if fresh := self.known.fresh:
            self.scores = np.concatenate((self.scores, self.model.scores(fresh)))
            self.sizes = np.concatenate((self.sizes, [sum(map(str.isalpha, w)) for w in fresh]))
            fresh.clear()

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]] | None]]:
        """(language, score, spans) of each text; a span is (start, end, language), in characters."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        if len(self.known) > WORDS:
            self.clear()
        raw = [np.array([self.known[w] for w in RUN.findall(t or "")], np.int64) for t in texts]
        self.settle()
        out = []
        for t, n, path in zip(texts, raw, search([n[n >= 0] for n in raw], self.scores, self.penalty)):
            if not len(path):
                out.append((UNKNOWN, 0.0, []))
                continue
            share = np.bincount(path, self.sizes[n[n >= 0]], len(self.model.langs))
            best = int(share.argmax())
            out.append((self.model.langs[best], float(share[best] / share.sum()), self._spans(t, np.flatnonzero(n >= 0), path)))
        return out

    def _spans(self, text: str, at: np.ndarray, path: np.ndarray) -> list[tuple[int, int, str]]:
        """Where spans begin and end: `at` has the places of the words with letters among all runs. Texts of one span, the
        most, are not walked again."""
        cuts = np.flatnonzero(np.diff(path)) + 1
        if not len(cuts):
            first = next(m for m in RUN.finditer(text) if any(map(str.isalpha, m[0])))
            end = len(text)
            while not text[end - 1].isalpha():
                end -= 1
            last = RUN.match(text, end - 1)  # a run may go on with signs that are no letters
            return [(first.start(), last.end(), self.model.langs[path[0]])]
        firsts, lasts = at[np.concatenate(([0], cuts))].tolist(), at[np.concatenate((cuts, [len(path)])) - 1].tolist()
        wanted = {*firsts, *lasts}
        places = {k: m.span() for k, m in enumerate(RUN.finditer(text)) if k in wanted}
        return [(places[a][0], places[b][1], self.model.langs[x]) for a, b, x in zip(firsts, lasts, path[np.concatenate(([0], cuts))])]


def label(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The rows of docs without the text, with lang_pred, score and lang_spans: array of (start, end, lang) in characters.

    Columns of these names give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score", "lang_spans")]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        work = Labeller(sent.value, penalty)

        def done(held):
            rows = work.label([t for b in held for t in b.column(0).to_pylist()])
            at = 0
            for b in held:
                part = rows[at : at + b.num_rows]
                at += b.num_rows
                spans = [[{"start": s, "end": e, "lang": x} for s, e, x in r[2]] for r in part]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.float64()), pa.array(spans, kinds)],
                    [*b.schema.names[1:], "lang_pred", "score", "lang_spans"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(0).nbytes
            if size > 6 * STEP:
                yield from done(held)
                held, size = [], 0
        yield from done(held)

    plain = [F.col(f"`{c}`") for c in others]
    made = StructType.fromDDL("lang_pred string, score double, lang_spans array<struct<start:bigint,end:bigint,lang:string>>")
    schema = StructType([*docs.select(*plain).schema.fields, *made.fields])
    return docs.select(docs[text].cast("string").alias("_text"), *plain).mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", held_fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_spans of every whole text; learns from the texts with a language outside the
    hold-out fold."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang")).withColumn("held_out", fold(F.col("doc_id"), folds) == held_fold)
    model = train(rows.where("not held_out"))
    return label(rows.select("doc_id", "held_out", "text"), model)
