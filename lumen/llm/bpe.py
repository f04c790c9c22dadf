"""Operator 4: BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list decides, for every pair of neighbouring tokens, whether they join. What stands far to the right can
change a token only through a chain of conflicts: a merge (u, v) fails because a merge of lower rank takes the right
edge of v first, which in turn depends on a merge of still lower rank, and so on. `sufficient_lookahead` follows the
longest such chain once for the whole merge list. While encoding, a token is emitted as soon as that many symbols
behind it have been read, and its symbols are forgotten; so besides the text itself (and the normal form of a word that is
being read) memory is constant however long a run of letters is, and so it is for the digests, which are fed while tokens
come. Decoding is a state machine too: it keeps at most the bytes of one unfinished character.

Defined results: a null text is the empty text (no tokens); ids stay in row order; every row gives one row; other
columns of the input are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points with the property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Only these split Python's words and are no white space for the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORD, BREAK = re.compile(f"[^{SPACE}]+"), re.compile(f"[{SPACE}]")
#: Results of words and pre-tokens under SHORT letters are kept, CACHE at a time; texts are cut at white space after PART letters.
CACHE, SHORT, PART = 150_000, 64, 1 << 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def code_points(category: str) -> str:
    """The inside of a character class: all code points of a general category."""
    known = "".join("x" if unicodedata.category(chr(c))[0] == category else "." for c in range(sys.maxunicode + 1))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer("x+", known))


class Cache(dict):
    """Keeps at most two generations of `size` results of `compute`, for keys of under 4 * SHORT letters."""

    def __init__(self, compute, size: int = CACHE):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
            if len(key) >= 4 * SHORT:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.old = {}


class MergeList:
    """Vocabulary and merges of a tokenizer file (BPE with word ends, lower case, white space dropped)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE with an optional end-of-word suffix is supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in self.vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(self.pairs)}.get
        self.made = [c for _, _, c in self.pairs]
        letters = byte_letters()
        self.inside = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = self._pattern(data)
        self.piece_re = re.compile(pattern.replace("\\p{L}", code_points("L")).replace("\\p{N}", code_points("N")))
        self.ascii_re = re.compile(pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"))
        self.bytes_of = {x: b for b, x in enumerate(letters)}
        self.lookahead = self.sufficient_lookahead()
        self.window = self.lookahead + 256

    @staticmethod
    def _pattern(data: dict) -> str:
        """The pattern of the pre-tokenizer, with white space written out."""
        steps = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next(s for s in steps if s["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the pre-tokenizer must keep exactly what its pattern matches")
        return split["pattern"]["Regex"].replace("\\s", SPACE)

    def sufficient_lookahead(self) -> int:
        """So many symbols behind a token settle it.

        reach[t] is the most that a merge with left part t looks to the right: the length of its right part and what
        that part's own right edge depends on, by merges of lower rank only.
        """
        size = dict.fromkeys([*self.inside, *self.last], 1)
        right: dict[int, int] = {}
        reach: dict[int, int] = {}
        for a, b, c in self.pairs:
            size[c], right[c] = size.get(a, 1) + size.get(b, 1), b
            chain, edge = 0, b
            while edge is not None:
                chain = max(chain, reach.get(edge, 0))
                edge = right.get(edge)
            reach[a] = max(reach.get(a, 0), size.get(b, 1) + chain)
        return max(reach.values(), default=0)

    def merge(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of a short run and the number of symbols in each: the lowest rank first, leftmost of equals."""
        sizes = [1] * len(ids)
        if len(ids) > 40:
            return self._merge_long(ids, sizes)
        rank, made, never = self.rank, self.made, len(self.made)
        found = [rank(p, never) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == never:
                break
            at = found.index(best)
            ids[at] = made[best]
            sizes[at] += sizes[at + 1]
            del ids[at + 1], sizes[at + 1], found[at]
            if at < len(found):
                found[at] = rank((ids[at], ids[at + 1]), never)
            if at:
                found[at - 1] = rank((ids[at - 1], ids[at]), never)
        return ids, sizes

    def _merge_long(self, ids: list[int], sizes: list[int]) -> tuple[list[int], list[int]]:
        n, rank, made = len(ids), self.rank, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[best], -1
            sizes[i] += sizes[j]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        kept = [i for i in range(n) if ids[i] >= 0]
        return [ids[i] for i in kept], [sizes[i] for i in kept]

    def transduce(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of symbols, each emitted once no later symbol can change it; at most `window` symbols are held."""
        source, held = iter(symbols), []
        while True:
            held += islice(source, self.window - len(held))
            if len(held) < self.window:
                yield from self.merge(held)[0]
                return
            tokens, sizes = self.merge(held[:])
            settled = end = 0
            for size in sizes:
                if end + size > self.window - self.lookahead:
                    break
                end += size
                settled += 1
            yield from tokens[:settled]
            del held[:end]

    def symbols(self, piece: str) -> Iterable[int]:
        """The symbols of a pre-token's bytes; the last one closes it."""
        if len(piece) >= SHORT:
            return self._stream(piece)
        data, inside = piece.encode("utf-8", "surrogatepass"), self.inside
        return [*[inside[b] for b in data[:-1]], *[self.last[b] for b in data[-1:]]]

    def _stream(self, piece: str) -> Iterator[int]:
        inside = self.inside
        for k in range(0, len(piece), 4096):
            data = piece[k : k + 4096].encode("utf-8", "surrogatepass")
            if k + 4096 < len(piece):
                yield from [inside[b] for b in data]
            else:
                yield from [inside[b] for b in data[:-1]]
                yield self.last[data[-1]]


class Encoder:
    """The transducer over whole texts. Nothing crosses white space and no merge crosses pre-tokens, so it is in its start
    state there; what it emits for a short word or pre-token from that state is kept and not worked out again."""

    def __init__(self, merges: MergeList, cache: int = CACHE):
        self.m = merges
        self.words = Cache(self._short, cache)
        self.pieces = Cache(lambda piece: tuple(merges.transduce(merges.symbols(piece))), cache)
        self.shown = Cache(self._shown, cache)

    def _short(self, word: str) -> tuple[int, ...]:
        low, pieces = self.normal(word), self.pieces
        if low.isalpha():
            return pieces[low]
        if "<" in word:
            return tuple(self._word(word))
        return tuple([i for p in (self.m.ascii_re if low.isascii() else self.m.piece_re).findall(low) for i in pieces[p]])

    def _shown(self, word: str) -> tuple[int, str]:
        ids = self._short(word)
        return len(ids), " ".join(map(str, ids))

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, letter by letter (a final sigma is like any other)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _word(self, word: str) -> Iterator[int]:
        """Tokens of a word as they are settled."""
        m = self.m
        for part in m.special_re.split(word) if m.special_re and "<" in word else [word]:
            if part in m.special:
                yield m.special[part]
                continue
            low = self.normal(part)
            for found in (m.ascii_re if low.isascii() else m.piece_re).finditer(low):
                if found.end() - found.start() < SHORT:
                    yield from self.pieces[found[0]]
                else:
                    yield from m.transduce(m.symbols(found[0]))

    @staticmethod
    def split(text: str | None) -> Iterator[list[str]]:
        """The words of a text, some PART letters at a time; a word is never cut."""
        text, at = text or "", 0
        while at < len(text):
            end = at + PART
            if end < len(text) and (gap := BREAK.search(text, end)):
                end = gap.start()
            elif end < len(text):
                end = len(text)
            part = text[at:end]
            yield WORD.findall(part) if SEPARATORS.search(part) else part.split()
            at = end

    def runs(self, text: str | None) -> Iterator[list[tuple[int, str]]]:
        """Lists of (number, ids joined by one space) of the tokens of words, or of parts of a very long word."""
        shown = self.shown
        for words in self.split(text):
            if max(map(len, words), default=0) < SHORT:
                yield [shown[w] for w in words]
                continue
            for w in words:
                if len(w) < SHORT:
                    yield [shown[w]]
                else:
                    source = self._word(w)
                    while part := list(islice(source, 1024)):
                        yield [(len(part), " ".join(map(str, part)))]

    def ids(self, text: str | None) -> list[int]:
        words = self.words
        return list(chain.from_iterable(words[w] if len(w) < SHORT else self._word(w) for part in self.split(text) for w in part))

    def digest(self, text: str | None, decoder: "TextDecoder") -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of what the decoder makes of them, both fed while they come."""
        total, ids, said, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        decoder.reset()
        for part in self.runs(text):
            runs = [run for n, run in part if n]
            if runs:
                total += sum([n for n, _ in part])
                ids.update((gap + " ".join(runs)).encode())
                gap = " "
                said.update(decoder.read(runs).encode("utf-8", "surrogatepass"))
        said.update(decoder.end().encode("utf-8", "surrogatepass"))
        return total, ids.hexdigest(), said.hexdigest()


class TextDecoder:
    """Incremental token-to-text machine. State: the bytes of one unfinished character, and what is due before the next token.

    `plain` is what a tokenizer file without a decoder asks for: every token as it stands in the vocabulary, one space
    between tokens. Otherwise bytes become text as soon as a character is whole, and word ends become spaces.
    """

    def __init__(self, m: MergeList, plain: bool = False, cache: int = CACHE):
        self.m, self.plain = m, plain
        self.special = set(m.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.known = Cache(self._whole, cache)
        self.reset()

    def reset(self) -> None:
        self.utf8.reset()
        self.due = self.open = False

    def push(self, token: int) -> str:
        text = self.m.text_of.get(token)
        if text is None:
            return ""
        due, self.due = " " if self.due else "", True
        if self.plain:
            return due + text
        if token in self.special:
            out = self.utf8.decode(b"", True) + due + text
            self.utf8.reset()
            self.open = False
            return out
        self.due = ends = bool(self.m.suffix) and text.endswith(self.m.suffix)
        data = bytes(self.m.bytes_of[c] for c in (text[: -len(self.m.suffix)] if ends else text))
        out = due + self.utf8.decode(data, ends)
        if ends:
            self.utf8.reset()
        self.open = bool(self.utf8.getstate()[0])
        return out

    def end(self) -> str:
        return self.utf8.decode(b"", True)

    def _whole(self, run: str) -> str | None:
        """Text of a run of ids from the start state; None if it leaves a character unfinished or no space due."""
        if self.plain:
            return " ".join([self.m.text_of[i] for i in map(int, run.split()) if i in self.m.text_of]) or None
        self.reset()
        text = "".join([self.push(int(x)) for x in run.split()])
        found = None if self.open or not self.due else text
        self.reset()
        return found

    def read(self, runs: list[str]) -> str:
        """Text of runs of ids, each joined by one space; the state goes on from run to run. Runs after which a space is due
        and no character is unfinished are kept and not worked out again."""
        out, known, due, open_ = [], self.known, self.due, self.open
        if not open_:
            found = [known[run] for run in runs]
            if None not in found:
                self.due, self.open = True, False
                return " " + " ".join(found) if due else " ".join(found)
        self.due, self.open = due, open_
        for run in runs:
            out += [self.push(int(x)) for x in run.split()]
        return "".join(out)


def _loader(spark, path: str):
    """The whole tokenizer file, read on the driver and sent to executors, which need not see its path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@functools.lru_cache(1)
def encoder(spec: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(MergeList(spec))


@functools.lru_cache(2)
def decoder(spec: str, plain: bool) -> TextDecoder:
    return TextDecoder(encoder(spec).m, plain)


def _mapped(docs: DataFrame, tokenizer: str, columns: list[str], doc_id: str, work, kinds: list[tuple[str, pa.DataType, str]], after=lambda spec: None) -> DataFrame:
    """doc_id and what work(spec) makes of each row's columns, row by row; after(spec) is called when a task's rows end."""
    sent = _loader(docs.sparkSession, tokenizer)

    def run(batches):
        one = work(sent.value)
        for b in batches:
            got = [one(*(x.as_py() for x in row)) for row in zip(*(b.column(1 + k) for k in range(len(columns))))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], t) for k, (_, t, _) in enumerate(kinds))], ["doc_id", *(n for n, _, _ in kinds)])
        after(sent.value)

    rows = docs.select(docs[doc_id].alias("doc_id"), *(docs[c].alias(f"c{k}") for k, c in enumerate(columns)))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, _, t in kinds))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, token_ids."""

    def work(spec):
        e = encoder(spec)
        return lambda t: (lambda ids: (len(ids), ids))(e.ids(t))

    return _mapped(docs, tokenizer, [text], doc_id, work, [("n_tokens", pa.int64(), "long"), ("token_ids", pa.list_(pa.int32()), "array<int>")])


def encode_and_decode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded, the readable text of the ids as `decode` gives it.

    Known words are forgotten at the end of a task: workers live on, and other work shares their memory.
    """

    def work(spec):
        e, d = encoder(spec), decoder(spec, False)

        def one(t):
            runs = [run for part in e.runs(t) for n, run in part if n]
            d.reset()
            ids = [int(x) for run in runs for x in run.split()]
            return len(ids), ids, (d.read(runs) if runs else "") + d.end()

        return one

    return _mapped(docs, tokenizer, [text], doc_id, work, [("n_tokens", pa.int64(), "long"), ("token_ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")], release)


def release(spec: str) -> None:
    """Empties the memory for words of this worker's encoder and decoder; their tables stay."""
    e, d = encoder(spec), decoder(spec, False)
    for held in (e.words, e.pieces, e.shown, d.known):
        held.forget()


def decode(tokens: DataFrame, tokenizer: str, ids: str = "token_ids", doc_id: str = "doc_id") -> DataFrame:
    """Readable text of token ids: doc_id, text. Lower case, one space after each word: the vocabulary keeps no more."""

    def work(spec):
        d = decoder(spec, False)

        def one(x):
            d.reset()
            return ("".join([d.push(i) for i in x or []]) + d.end(),)

        return one

    return _mapped(tokens, tokenizer, [ids], doc_id, work, [("text", pa.string(), "string")])


def digests(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (as the file's own decoder has it)."""

    def work(spec):
        e, d = encoder(spec), decoder(spec, True)
        return lambda t: e.digest(t, d)

    return _mapped(docs, tokenizer, [text], doc_id, work, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")])
