"""Operator 9: benchmark decontamination by a BM25 inverted index of the test items, searched with block-max bounds (WAND).

Every training text is cut into overlapping passages, long enough that any item lies whole in one of them. A passage is
a query; an item's score is BM25 divided by the score of the item itself, so 1 means that all its words are there.

Search, as WAND does it: a passage's terms are ordered by the largest weight in their posting lists; those whose largest
weights sum up to less than the threshold cannot bring any item over it, so only the lists of the others (the essential
ones) name candidates. Postings are cut into blocks of BLOCK neighbouring items, and every block of a list keeps its largest
weight. A block of items is skipped unless the block maxima of the essential lists, with the list maxima of the rest, reach the
threshold; then unless the block maxima of all lists do. In what is left every posting is scored. Only items that cannot
reach the threshold are skipped; what reaches it is found. Passages of many texts are searched together, in slices.

All items over the threshold are then verified by the share of the item's five-word shingles, of its question part and of
its answer part that the passage holds. Items have no parts of their own here: the answer is the last sentence (of one
sentence: the last third of the words), the question what stands before.

Statistics (document frequencies, mean and greatest length) are those of all items, whatever an index holds. Items up to
SHARD letters are one index that is broadcast. More are dealt to shards by their ids; texts meet every shard in tasks that
read its items first, so no index is larger than a shard, and none is held by the driver.

Defined results: null or empty texts and items match nothing; every match is one row (doc_id, item_id), repeated ids
repeat; an item id with several texts is one item for each; an item with fewer than five words is one shingle; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.plans.durable import stored

WORD = re.compile(r"\w+")
#: An index holds at most so many letters of items.
SHARD = 32 << 20
#: Neighbouring items under one maximum.
BLOCK = 64
#: Passages and words that are searched together.
SLICE, WORDS = 512, 1 << 16


def shingles(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    cuts = [m.start() for m in re.finditer(r"(?<=[.!?])\s+", text.strip())]
    words = WORD.findall(text.lower())
    n = len(WORD.findall(text.strip()[: cuts[-1]])) if cuts else 0
    if not 0 < n < len(words):
        n = len(words) - max(len(words) // 3, 1)
    return words[:n], words[n:]


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the places start .. start + n of every row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]


class Statistics:
    """What all items say together: their number, greatest and mean length, and how many hold each word."""

    def __init__(self, n: int, longest: int, mean: float, df: dict[str, int]):
        self.n, self.longest, self.mean, self.df = n, max(longest, 1), mean or 1.0, df

    @classmethod
    def of(cls, texts: Iterable[str]) -> "Statistics":
        lengths, df = [], {}
        for t in texts:
            words = WORD.findall((t or "").lower())
            if words:
                lengths.append(len(words))
                for w in set(words):
                    df[w] = df.get(w, 0) + 1
        return cls(len(lengths), max(lengths, default=1), float(np.mean(lengths)) if lengths else 1.0, df)


class Index:
    """Inverted index of items (id, text) with normalised BM25 weights, and maxima of lists and of their blocks."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics, threshold: float = 0.6, k1: float = 1.2, b: float = 0.75):
        self.threshold, self.longest = threshold, known.longest
        self.items = [(i, *parts(t)) for i, t in items if t and WORD.search(t)]
        self.vocab: dict[str, int] = {}
        term, item, weight = [], [], []
        for i, (_, q, a) in enumerate(self.items):
            words, tf = np.unique(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in q + a]), return_counts=True)
            term.append(words)
            item.append(np.full(len(words), i))
            weight.append(tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(q + a) / known.mean)))
        if not self.items:
            return
        df = np.array([known.df[w] for w in self.vocab])
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        for k, t in enumerate(term):
            weight[k] = weight[k] * idf[t]
            weight[k] = weight[k] / weight[k].sum()
        term, item, weight = (np.concatenate(x) for x in (term, item, weight))
        order = np.lexsort((item, term))
        self.item, self.weight, term = item[order], weight[order], term[order]
        size, n_blocks = len(self.vocab), -(-len(self.items) // BLOCK)
        self.top = np.zeros(size)
        np.maximum.at(self.top, term, self.weight)
        # Blocks of each list: where its postings begin, and their largest weight.
        code = term * n_blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        self.cell, self.cell_start = code[first], np.append(first, len(code))
        self.cell_top = np.maximum.reduceat(self.weight, first)
        self.cells = np.searchsorted(self.cell, np.arange(size + 1) * n_blocks)
        self.n_blocks = n_blocks
        self.shingles = [tuple(shingles(x) for x in (q, a, q + a)) for _, q, a in self.items]

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items that reach the threshold; (passage, term) must be different and passages from 0 on."""
        least, n_items = self.threshold - 1e-9, len(self.items)
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        n = np.bincount(passage)
        total = np.cumsum(self.top[term])
        within = total - np.repeat(np.concatenate(([0.0], total))[np.cumsum(n) - n], n)  # maxima of the lighter lists and the own
        essential = within >= least
        rest = np.bincount(passage, np.where(essential, 0.0, self.top[term]), len(n))
        # The blocks that essential lists name; then those that all lists together can bring over the threshold.
        row, cell = _spread(self.cells[term], self.cells[term + 1] - self.cells[term])
        spot = passage[row] * self.n_blocks + self.cell[cell] % self.n_blocks
        own = essential[row]
        live, where = np.unique(spot[own], return_inverse=True)
        if not len(live):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        bound = np.bincount(where, self.cell_top[cell[own]], len(live))
        live = live[bound + rest[live // self.n_blocks] >= least]
        at = np.searchsorted(live, spot)
        kept = np.flatnonzero((at < len(live)) & (live[np.minimum(at, max(len(live) - 1, 0))] == spot)) if len(live) else np.zeros(0, np.int64)
        bound = np.bincount(at[kept], self.cell_top[cell[kept]], len(live))
        kept = kept[bound[at[kept]] >= least]
        # What is left is scored posting by posting.
        cell, owner = cell[kept], passage[row[kept]]
        row, post = _spread(self.cell_start[cell], self.cell_start[cell + 1] - self.cell_start[cell])
        pair, where = np.unique(owner[row] * n_items + self.item[post], return_inverse=True)
        score = np.bincount(where, self.weight[post], len(pair))
        found = score >= least
        return pair[found] // n_items, pair[found] % n_items, score[found]

    def search_many(self, texts: list[str | None], least: float = 0.8) -> list[list[tuple[int, float, float, float, float]]]:
        """For every text (item_id, score, question, answer, whole) of the items that a passage of it is verified to hold."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        held, size = [], 0
        for k, t in enumerate(texts if self.items else ()):
            words = WORD.findall((t or "").lower())
            if words:
                held.append((k, words))
                size += len(words)
            if size >= WORDS:
                self._search(held, out, least)
                held, size = [], 0
        if held:
            self._search(held, out, least)
        return [[(self.items[i][0], *v) for i, v in sorted(found.items())] for found in out]

    def _search(self, held: list[tuple[int, list[str]]], out: list[dict[int, tuple]], least: float) -> None:
        known, stride, size = self.vocab.get, self.longest, len(self.vocab)
        for s in range(0, len(held), SLICE):
            group = held[s : s + SLICE]
            ids = np.array([known(w, -1) for _, words in group for w in words], np.int64)
            lengths = np.array([len(words) for _, words in group])
            own = np.repeat(np.arange(len(group)), lengths)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # A word lies in two passages: the one that begins in its stride and the one before.
            n = -(-lengths // stride)
            base = np.cumsum(n) - n
            at = np.flatnonzero(ids >= 0)
            here = base[own[at]] + place[at] // stride
            before = np.maximum(place[at] // stride - 1, 0) + base[own[at]]
            slots = np.unique(np.concatenate((here, before)) * size + np.tile(ids[at], 2))
            for first in range(0, int(n.sum()), SLICE):
                lo, hi = np.searchsorted(slots, (first * size, (first + SLICE) * size))
                if lo == hi:
                    continue
                passages, items, scores = self.candidates(slots[lo:hi] // size - first, slots[lo:hi] % size)
                for p, i, score in zip((passages + first).tolist(), items.tolist(), scores.tolist()):
                    g = int(np.searchsorted(base, p, "right")) - 1
                    k, words = group[g]
                    k_first = (p - int(base[g])) * stride
                    self._verify(words[k_first : k_first + 2 * stride], i, score, out[k], least)

    def _verify(self, words: list[str], i: int, score: float, found: dict[int, tuple], least: float) -> None:
        held = shingles(words) if len(words) >= 5 else {tuple(words)}
        q, a, whole = (self._share(s, held, words) for s in self.shingles[i])
        if whole >= least or q >= least and a >= least:
            found[i] = max(found.get(i, (0.0,)), (score, q, a, whole))

    @staticmethod
    def _share(own: set, held: set, words: list[str]) -> float:
        if not own:
            return 1.0
        if len(own) == 1 and len(next(iter(own))) < 5:
            (one,) = own
            return float(any(tuple(words[i : i + len(one)]) == one for i in range(len(words) - len(one) + 1)))
        return len(own & held) / len(own)


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Different items (item_id, text) and the letters of all."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and length(text) > 0").dropDuplicates(["item_id", "text"])
    return items, items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, make, schema, **settings) -> DataFrame:
    """make(batch, found) of every Arrow batch of docs, found being what search_many gives for its texts, with one index."""
    items, _ = _items(benchmark)
    rows = sorted((r[0], r[1]) for r in items.toLocalIterator())  # at most SHARD letters
    index = Index(rows, Statistics.of(t for _, t in rows), **settings)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield make(b, sent.value.search_many(b.column(place).to_pylist()))

    return docs.mapInArrow(run, schema)


def _sharded(rows: DataFrame, items: DataFrame, chars: int, **settings) -> DataFrame:
    """(row, item_id, scores) of rows (row, text) and more items than one index may hold.

    Tasks are keys (shard, salt): each reads the items of its shard, with the number of items that hold each of their words,
    and then its share of the texts, so an index is built in the tasks and gone with them.
    """
    n, salts = -(-chars // SHARD), rows.sparkSession.sparkContext.defaultParallelism * 2
    shape = Statistics.of([])
    sized = stored(items.mapInArrow(_word_rows, "item_id long, text string, words array<string>"))
    shape.n, shape.longest, shape.mean = sized.where("size(words) > 0").agg(F.count("*"), F.coalesce(F.max(F.size("words")), F.lit(1)), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    df = sized.select("item_id", "text", F.explode(F.array_distinct("words")).alias("word"))
    df = df.join(df.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))
    shard = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = df.select(shard.alias("shard"), each(salts).alias("salt"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), "text", "df")
    right = rows.select(each(n).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("row").alias("id"), "text", F.lit(None).cast("map<string,bigint>").alias("df"))
    dealt = left.unionByName(right).repartition(n * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches):
        now, held, known, index = None, [], {}, None
        for b in batches:
            got = []
            shards, salts_, kinds, ids, texts, dfs = b.columns
            keys = list(zip(shards.to_pylist(), salts_.to_pylist(), kinds.to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s][:2] != now:
                    now, held, known, index = keys[s][:2], [], {}, None
                if keys[s][2] == 0:
                    held += zip(ids[s:e].to_pylist(), texts[s:e].to_pylist())
                    for m in dfs[s:e].to_pylist():
                        known.update(m)
                    continue
                if index is None:
                    index = Index(sorted(held), Statistics(shape.n, shape.longest, shape.mean, known), **settings)
                    held, known = [], {}
                got += [(ids[s + k].as_py(), m) for k, found in enumerate(index.search_many(texts[s:e].to_pylist())) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), *_columns([m for _, m in got])], ["row", *NAMES])

    return dealt.mapInArrow(run, f"row long, {SCHEMA}")


def _word_rows(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([WORD.findall((t or "").lower()) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "text", "words"])


NAMES = ["item_id", "score", "question_overlap", "answer_overlap", "item_overlap"]
SCHEMA = "item_id long, score double, question_overlap double, answer_overlap double, item_overlap double"


def _columns(found: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*found)) or [()] * 5
    return [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, item_overlap: every verified match."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    items, chars = _items(benchmark)
    if chars > SHARD:
        keyed = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        return keyed.select("row", "doc_id").join(_sharded(keyed.select("row", "text"), items, chars, **settings), "row").drop("row")

    def make(b, found):
        got = [(i, m) for i, ms in enumerate(found) for m in ms]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in got], pa.int64())), *_columns([m for _, m in got])], ["doc_id", *NAMES])

    return _searched(rows, benchmark, "text", make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}", **settings)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows and columns of docs that hold no item; judged row by row."""
    items, chars = _items(benchmark)
    if chars > SHARD:
        keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), docs[text].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("doc")))
        gone = stored(_sharded(keyed.select("row", "text"), items, chars, **settings).select("row").distinct())
        return keyed.join(gone, "row", "left_anti").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
    return _searched(docs, benchmark, text, lambda b, found: b.filter(pa.array([not f for f in found], pa.bool_())), docs.schema, **settings)
