"""Operator 7: language-model scoring with class-based n-grams (Brown et al., 1992; exchange clustering, Martin et al., 1998).

Words that make up a share of `share` or more of the training tokens (so at most 1 / share words) are assigned to
classes by exchange: each word in turn moves to the class that raises the likelihood of the class bigrams most, until
nothing moves. Every other word that occurs `least` times or more then goes to the class under which it and its
neighbours are likeliest while those class bigrams stay fixed; so the vocabulary grows with the corpus. Words under `least`, and unknown
ones, are one class of their own, and so is the end of a text. The model's probability of a token is its class given the
class before, times the word given its class; both come from counts over all assigned words and are smoothed.

How Spark runs it: words are counted in every task and then by key. Texts are encoded once, block by block, against a
dictionary that belongs to the block; only the block dictionaries (not the tokens) are joined with the corpus counts,
and return to their blocks. The frequent words' bigrams, and every other word's frequent neighbours, are counted in the
same pass; words are assigned in the tasks, dealt by word, and their classes go back with the counts. Then the class
bigrams are counted anew from the texts' classes. All counts cover the whole corpus. The driver holds the frequent words'
bigrams, of which there are (1 / share + 2) ** 2 at most, and tables by class.

Defined results: a null text is empty (one token, the end); every row gives one row, repeated and null ids too; a null
id counts as a training row; without training rows every base score is 0 and n_known is 0; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import fold
from lumen.plans.durable import stored

#: What Python takes for white space beyond the six ASCII marks.
OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD = re.compile("[^ \t-\r]+")
SHARE, LEAST, CLASSES, SWEEPS, FLUSH, MIX = 2e-4, 5, 48, 10, 400_000, 5.0
#: A block ends with FLUSH different words or so many tokens, whichever comes first.
TOKENS = 4_000_000
#: Rows that workers build or hold at once.
SLICE = 4096
#: A word's neighbours: place (the symbol before, or past all symbols the one after) and count.
CELL = np.dtype([("at", "<u4"), ("n", "<u4")])


def words(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z in lower case."""
    if not text:
        return []
    if text.isascii() and not OTHER.search(text):
        return text.lower().split()
    low = text.encode().lower().decode()
    return WORD.findall(low) if OTHER.search(low) else low.split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the rows (text, held) that are not held out."""

    def run(batches):
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0):
                counts.update(words(t.as_py()))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return docs.where("not held").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(rows: DataFrame, frequent: list[str]) -> DataFrame:
    """One table of four kinds: 0 texts (tokens as numbers), 1 block dictionaries, 2 bigrams of the training texts, 3 the
    neighbours there of each word beyond the frequent ones, in as many rows as it takes.

    Numbers: frequent words as listed, then the block's own words from len(frequent) on. For bigrams all of these are
    the symbol len(frequent), and the end, which also stands before the first word, is one more.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequent)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, doc_id {id_type}, held boolean, tokens binary, word string, at long, n long, cells binary"

    def run(batches):
        k = len(sent.value)
        fixed = {w: i for i, w in enumerate(sent.value)}
        known, pairs, seen, around, size = dict(fixed), {}, 0, [], 0
        block = uuid.uuid4().int >> 65
        names = ["kind", "block", "doc_id", "held", "tokens", "word", "at", "n", "cells"]

        def table(kind, size, id_kind, **cols):
            kinds = (pa.int32(), pa.int64(), id_kind, pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            cols = {"kind": np.full(size, kind, np.int32), "block": np.full(size, block, np.int64)} | cols
            return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(names, kinds)], names)

        def neighbours(id_kind):
            """Rows for the neighbours met so far, a slice at a time."""
            if around:
                codes, n = _merged(around)
                around.clear()
                own, at = list(known)[k:], np.unique(codes // (2 * k + 4))
                for s in range(0, len(at), SLICE):
                    part = at[s : s + SLICE]
                    ends = np.searchsorted(codes, np.append(part, part[-1] + 1) * (2 * k + 4))
                    yield table(3, len(part), id_kind, word=[own[x] for x in part.tolist()], cells=_cells(codes, n, ends, 2 * k + 4))

        def flush(id_kind):
            yield from neighbours(id_kind)
            own = list(known)[k:]
            yield table(1, len(own), id_kind, word=own, at=np.arange(len(own)))
            codes = np.array(list(pairs), np.int64)
            yield table(2, len(codes), id_kind, at=codes, n=np.array(list(pairs.values()), np.int64))

        id_kind = pa.int64()
        for b in batches:
            id_kind = b.column(0).type
            out, first, raw = [], [], []
            for i in range(b.num_rows):
                toks = words(b.column(1)[i].as_py())
                seq = np.array([known.setdefault(w, len(known)) for w in toks], np.int32)
                out.append(seq.view(np.uint8).reshape(-1, 4).T.tobytes())
                if not b.column(2)[i].as_py():
                    first.append(np.concatenate((np.minimum(seq, k), [k + 1])))
                    raw.append(seq)
                size += len(seq)
                if len(known) - k > FLUSH or size > TOKENS:
                    # The texts so far go out with their dictionary; a new block begins with the next text.
                    yield table(0, len(out) - seen, id_kind, doc_id=b.column(0)[seen : i + 1], held=b.column(2)[seen : i + 1], tokens=pa.array(out[seen:], pa.binary()))
                    _count(first, k, pairs)
                    _meet(raw, k, around)
                    yield from flush(id_kind)
                    known, pairs, seen, first, raw, size = dict(fixed), {}, i + 1, [], [], 0
                    block = uuid.uuid4().int >> 65
            yield table(0, len(out) - seen, id_kind, doc_id=b.column(0)[seen:], held=b.column(2)[seen:], tokens=pa.array(out[seen:], pa.binary()))
            _count(first, k, pairs)
            _meet(raw, k, around)
            seen = 0
            if sum(len(x[0]) for x in around) > 2 * FLUSH:
                yield from neighbours(id_kind)
        yield from flush(id_kind)

    return rows.select("doc_id", "text", "held").mapInArrow(run, schema)


def _count(texts: list[np.ndarray], k: int, into: dict[int, int]) -> None:
    """Adds the bigrams of texts that each close with the end symbol k + 1."""
    if texts:
        line = np.concatenate(([k + 1], *texts)).astype(np.int64)
        codes, n = np.unique(line[:-1] * (k + 2) + line[1:], return_counts=True)
        for c, x in zip(codes.tolist(), n.tolist()):
            into[c] = into.get(c, 0) + x


def _meet(texts: list[np.ndarray], k: int, into: list) -> None:
    """Adds (code, count) of the neighbours of words beyond the frequent ones; parts of like size are merged."""
    if not texts:
        return
    line = np.concatenate(([-1], *(x for t in texts for x in (t, [-1])))).astype(np.int64)
    symbol = np.where(line < 0, k + 1, np.minimum(line, k))
    at = np.flatnonzero(line >= k)
    own = (line[at] - k) * (2 * k + 4)
    into.append(np.unique(np.concatenate((own + symbol[at - 1], own + k + 2 + symbol[at + 1])), return_counts=True))
    while len(into) > 1 and len(into[-2][0]) < 2 * len(into[-1][0]):
        into[-2:] = [_merged(into[-2:])]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, where, np.concatenate([p[1] for p in parts]))
    return codes, n


def _cells(codes: np.ndarray, n: np.ndarray, ends: np.ndarray, size: int) -> pa.Array:
    """The cells of the words whose codes lie between one of the ends and the next."""
    cells = np.empty(ends[-1] - ends[0], CELL)
    cells["at"], cells["n"] = codes[ends[0] : ends[-1]] % size, n[ends[0] : ends[-1]]
    places = ((ends - ends[0]) * CELL.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(places), pa.py_buffer(cells.tobytes())])


def smoothed(table: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """Log10 of the probability of each class after each class."""
    share = (by_class + 1) / (by_class.sum() + len(table))
    return np.log10((table + MIX * share) / (table.sum(1, keepdims=True) + MIX))


def best(table: np.ndarray, inn: np.ndarray, out: np.ndarray) -> np.ndarray:
    """For each row of inn and out (a word's neighbours by class), the class under which the word and its neighbours are
    likeliest by the class bigrams as they stand; the two last classes take none."""
    c, by_class = len(table) - 2, table.sum(0)
    step = smoothed(table, by_class)
    return np.argmax(inn @ step[:, :c] + out @ step[:c].T - inn.sum(1, keepdims=True) * np.log10(by_class[:c] + 1), 1)


def assigned(tail: DataFrame, cells: DataFrame, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, n, class) of every word of tail (word, n); cells (word, cells) may have many rows of a word, and other words.

    Both meet by word in one exchange, without a join.
    """
    sent = tail.sparkSession.sparkContext.broadcast((of, table))

    def run(batches):
        of, table = sent.value
        size, m = len(of), len(table)
        place = np.concatenate((of, of + m))
        held: list[pa.RecordBatch] = []

        def runs(words: np.ndarray):
            new = np.concatenate(([True], words[1:] != words[:-1]))
            return np.flatnonzero(new), np.cumsum(new) - 1

        def done(t: pa.Table):
            words, n = t["word"].to_numpy(), t["n"].fill_null(0).to_numpy()
            first, run_of = runs(words)
            rows = np.flatnonzero(np.maximum.reduceat(n, first)[run_of] > 0)
            if not len(rows):
                return
            words, n, raw = words[rows], n[rows], [x or b"" for x in t["cells"].take(rows).to_pylist()]
            first, run_of = runs(words)
            c = np.frombuffer(b"".join(raw), CELL)
            where = np.repeat(run_of, [len(x) // CELL.itemsize for x in raw])
            both = np.bincount(where * (2 * m) + place[c["at"]], c["n"], len(first) * 2 * m).reshape(-1, 2 * m)
            cls = best(table, both[:, :m], both[:, m:])
            yield pa.RecordBatch.from_arrays([pa.array(words[first], pa.string()), pa.array(np.maximum.reduceat(n, first)), pa.array(cls, pa.int32())], ["word", "n", "class"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= SLICE and held[0]["word"][0] != b["word"][-1]:
                t = pa.Table.from_batches(held)
                words = t["word"].to_numpy()
                cut = int(np.flatnonzero(words[1:] != words[:-1])[-1]) + 1
                held = t.slice(cut).combine_chunks().to_batches()
                yield from done(t.slice(0, cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    both = tail.select("word", "n", F.lit(None).cast("binary").alias("cells")).unionByName(cells.select("word", "cells"), allowMissingColumns=True)
    return both.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n long, class int")


def exchange(pairs: np.ndarray, counts: np.ndarray, k: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the symbols 0 .. k + 1: words 0 .. k - 1 move between `classes` classes, the two last symbols stay alone.

    Objective: sum of g over class bigrams less sum of g over the classes' left and right counts, g(x) = x log x.
    """
    g = lambda x: x * np.log(np.maximum(x, 1e-12))
    classes = max(1, min(classes, k))
    size, total = k + 2, classes + 2
    of = np.concatenate((np.arange(k) % classes, [classes, classes + 1]))
    left, right = pairs // size, pairs % size
    n = counts.astype(float)
    table = np.zeros((total, total))
    np.add.at(table, (of[left], of[right]), n)
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    cut_l, cut_r = np.searchsorted(left[by_left], np.arange(size + 1)), np.searchsorted(right[by_right], np.arange(size + 1))
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            after, before = by_left[cut_l[w] : cut_l[w + 1]], by_right[cut_r[w] : cut_r[w + 1]]
            own = float(n[after[right[after] == w]].sum())
            out = np.bincount(of[right[after]], n[after], total)
            inn = np.bincount(of[left[before]], n[before], total)
            a = of[w]
            out[a] -= own
            inn[a] -= own
            table[a] -= out
            table[:, a] -= inn
            table[a, a] -= own
            row, col, diag = table.sum(1), table.sum(0), np.diag(table)
            gain = (g(table + inn[:, None]) - g(table)).sum(0) + (g(table + out[None, :]) - g(table)).sum(1)
            gain += g(diag + inn + out + own) - g(diag + inn) - g(diag + out) + g(diag)
            gain -= g(row + out.sum() + own) - g(row) + g(col + inn.sum() + own) - g(col)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            table[b] += out
            table[:, b] += inn
            table[b, b] += own
        if not moved:
            break
    return of


def class_bigrams(coded: DataFrame, m: int) -> np.ndarray:
    """Counts of class after class over the training texts in coded (held, classes)."""

    def run(batches):
        n = np.zeros(m * m, np.int64)
        for b in batches:
            for raw in b.column(0):
                c = np.frombuffer(raw.as_py(), np.uint8).astype(np.int64)
                n += np.bincount(c[:-1] * m + c[1:], minlength=m * m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    found = coded.where("not held").select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(m * m)
    table[found["at"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(m, m)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_fold: int = 1, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; learns from the other folds."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    rows = rows.withColumn("held", fold(F.col("doc_id")) == held_fold)
    counts = stored(word_counts(rows))
    n_texts = rows.where("not held").count()
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = tokens + n_texts
    types += n_texts > 0
    core = max(share * total, 1)
    top = counts.where(F.col("n") >= core).orderBy(F.desc("n"), "word").toArrow()  # at most 1 / share rows
    frequent, own_n = top["word"].to_pylist(), top["n"].to_numpy().astype(float)
    k = len(frequent)
    coded = stored(encode(rows, frequent), "kind")
    bigrams = coded.where("kind = 2").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs, pair_counts = bigrams["at"].to_numpy(), bigrams["n"].to_numpy()
    of = exchange(pairs, pair_counts, k).astype(np.int32)
    m = int(of.max()) + 1
    rare, end = m - 2, m - 1
    table = np.zeros((m, m))
    np.add.at(table, (of[pairs // (k + 2)], of[pairs % (k + 2)]), pair_counts)
    tail = counts.where((F.col("n") >= least) & (F.col("n") < core))
    tail = stored(assigned(tail, coded.where("kind = 3"), of, table))
    by_class = np.bincount(of[:k], own_n, m)
    rare_types = types - k - (n_texts > 0)
    for c, n, size in tail.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        by_class[c] += n
        rare_types -= size
    by_class[rare], by_class[end] = max(total - n_texts - by_class.sum(), 0), n_texts
    base_word, base_end, base_floor = np.log10(own_n + 0.5), float(np.log10(n_texts + 0.5)), float(np.log10(total + 0.5 * (types + 1)))
    sent = rows.sparkSession.sparkContext.broadcast((of, own_n, base_word))
    classed = counts.join(tail.select("word", "class"), "word", "left")
    own = coded.where("kind = 1").select("block", "word", "at").join(classed, "word", "left").select("block", F.lit(1).alias("kind"), "at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(rare)).alias("class"))
    texts = coded.where("kind = 0").select("block", F.lit(0).alias("kind"), "doc_id", "held", "tokens")
    # Blocks are of like size; a task gets some TOKENS of them, however many there are.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TOKENS))
    dealt = texts.unionByName(own, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", F.desc("kind"))
    known_end = int(n_texts > 0)

    def run(batches):
        of, own_n, base_word = sent.value
        block, parts, base = None, [], None
        cls = alone = known = None
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1, [b.num_rows]))
            got = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if s == e:
                    continue
                if blocks[s] != block:
                    block, parts, base = blocks[s], [], None
                if kinds[s] == 1:
                    parts.append((b.column(5)[s:e].to_numpy(), b.column(6)[s:e].to_numpy(), b.column(7)[s:e].to_numpy()))
                    continue
                if base is None:
                    size = sum(len(p[0]) for p in parts)
                    n, c = np.zeros(size), np.zeros(size, np.uint8)
                    for at, x, y in parts:
                        n[at], c[at] = x, y
                    cls = np.concatenate((of[:k].astype(np.uint8), c))
                    base = np.concatenate((base_word, np.log10(n + 0.5)))
                    alone = np.concatenate((np.log10(np.maximum(own_n, 1e-9)), np.log10(np.where(c == rare, n + 0.5, np.maximum(n, 1)))))
                    known = np.concatenate((np.ones(k, bool), n > 0))
                for i in range(s, e):
                    seq = np.frombuffer(b.column(4)[i].as_py(), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
                    full = len(seq) + 1
                    line = np.concatenate(([end], cls[seq], [end])).astype(np.uint8).tobytes()
                    got.append((b.column(2)[i].as_py(), b.column(3)[i].as_py(), full, int(known[seq].sum()) + known_end, float(base[seq].sum() + base_end - full * base_floor), float(alone[seq].sum()), line))
            if got:
                kinds_out = (b.column(2).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), kinds_out)], ["doc_id", "held", "n_tokens", "n_known", "base_score", "alone", "classes"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    read = stored(dealt.select("block", "kind", "doc_id", "held", "tokens", "at", "n", "class").mapInArrow(run, f"doc_id {id_type}, held boolean, n_tokens long, n_known long, base_score double, alone double, classes binary"))
    table = class_bigrams(read, m)
    step = smoothed(table, by_class)
    inside = np.log10(np.maximum(by_class, 1e-9))
    inside[rare], inside[end] = np.log10(by_class[rare] + 0.5 * (max(rare_types, 0) + 1)), 0.0
    step -= inside  # the word given its class: its own logarithm less that of its class

    def finish(batches):
        for b in batches:
            got = []
            for raw, x in zip(b.column(6), b.column(5).to_pylist()):
                c = np.frombuffer(raw.as_py(), np.uint8)
                got.append(float(step[c[:-1], c[1:]].sum()) + x)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([total] * b.num_rows, pa.int64()), b.column(4), pa.array(got, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return read.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
