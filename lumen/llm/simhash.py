"""Operator 2: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy: exclusive-or of one tile with another, then bit counts. A tile holds the
distinct fingerprints whose eight bytes have the same eight population counts. Two fingerprints within the radius
differ by at most that much in the sum of the differences of their counts, so all other tile pairs are skipped without
loss: the comparison stays exact. One of two near tiles visits the other, so every pair of near tiles meets once.
Within a block of pairs only a forest that spans its links is kept, never all pairs of a group.

In the pipeline (`without_near_duplicates`) two texts are linked if their fingerprints are, as above, or if they are similar.
Tiles by counts suit radii up to three, and fingerprints miss copies with more changes. `similar_texts` links texts by the similarity of their sets of five-word shingles
instead. It deals texts to tiles by their least shingle under each of six hash functions (a pair that similar shares at
least one with a probability of 1 - 0.2 ** 6). Within a tile a sketch of 128 bins only sorts out: what falls short of the
similarity by five standard errors or less stays a candidate, and so does every pair of short texts whose sets are of
like size. Candidates that connect are a group; each group meets once more, with the whole shingle sets, and a pair is
linked if those sets say so. Of either kind, a tile of more than SPLIT members (a group: of more than SETS) is cut into
bins, and every two bins meet in a task of their own: no pair is lost, and no task grows with a group of near copies.

Exact copies collapse before anything is compared: a third of all rows with one text is one fingerprint.

Defined results: a null text is an empty text, whose fingerprint is zero and links like any other; every row gives one
row, repeated ids too; a null id never becomes a component's id unless the component has no other; extra columns of docs
have no influence, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.operators.components import components, forest
from lumen.plans.durable import join_hot, stored

BLOCK = 1024
#: A tile of more members than this is split; the table of such tiles is broadcast up to HOT_ROWS rows (16 bytes each).
SPLIT, HOT_ROWS = 8192, 1_000_000
#: So many whole shingle sets meet in a task, twice as many of a split group.
SETS = 512


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of fewer words the whole sequence; of none nothing."""
    n = max(min(len(words), 1), len(words) - width + 1)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(line, seed)] * n, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is set if over half of the hashes have it set."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(words(text), width, seed))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, for every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _tile(fp: Column) -> Column:
    """The population counts of the eight bytes, four bits each."""
    out = F.lit(0).cast("long")
    for k in range(8):
        out = out + F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))).cast("long"), 4 * k)
    return out


def _steps(radius: int) -> list[int]:
    """Offsets from a tile to those that it visits: half of all tiles whose counts differ by at most the radius."""
    found = {()}
    unit = [s * (1 << 4 * k) for k in range(8) for s in (1, -1)]
    for n in range(1, radius + 1):
        found |= set(combinations(sorted(unit * n), n))
    sums = {sum(f) for f in found}
    return sorted(s for s in sums if s > 0)


def _compare(homes: np.ndarray, guests: np.ndarray, radius: int):
    """Spanning links among the homes of a tile and between homes and guests."""
    for i in range(0, len(homes), BLOCK):
        own = homes[i : i + BLOCK]
        for other in (*(homes[j : j + BLOCK] for j in range(i, len(homes), BLOCK)), *(guests[j : j + BLOCK] for j in range(0, len(guests), BLOCK))):
            x, y = np.nonzero(np.bitwise_count(own[:, None] ^ other[None, :]) <= radius)
            differ = own[x] != other[y]
            if differ.any():
                yield forest(own[x[differ]], other[y[differ]])


def links(fps: DataFrame, radius: int = 2, fp: str = "fp") -> DataFrame:
    """Edges (a, b) between different fingerprints that connect exactly what differences of `radius` bits or fewer connect.

    `fps` must hold each fingerprint once.
    """
    own = fps.select(F.col(fp).alias("fp"))
    home = own.withColumn("tile", _tile(F.col("fp")))
    visits = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(s).cast("long") for s in _steps(radius)))).alias("step")
    dealt = home.select("fp", "tile", visits).select("fp", (F.col("tile") + F.col("step")).alias("tile"), (F.col("step") != 0).alias("guest"))
    # A count above eight in any place is no tile; a borrow or carry always leaves one.
    t = F.col("tile")
    over = F.shiftright(t.bitwiseAND(F.lit(0x88888888)), 3).bitwiseAND(t.bitwiseOR(F.shiftright(t, 1)).bitwiseOR(F.shiftright(t, 2)).bitwiseAND(F.lit(0x11111111)))
    real = (t >= 0) & (t < (1 << 32)) & (over == 0)
    # Members of a tile, guests included, from the counts of homes: a row for each tile that has any.
    sizes = home.groupBy("tile").agg(F.count("*").alias("n")).select("n", "tile", visits).select("n", (F.col("tile") + F.col("step")).alias("tile"))
    dealt = _split(dealt.where(real), sizes.where(real).groupBy("tile").agg(F.sum("n").alias("n")), "fp")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "guest")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(tile, code, guest):
            cuts = np.flatnonzero(np.diff(tile)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(tile)]))
            full = (~guest[starts]) & (ends - starts > 1)
            got = []
            for s, e in zip(starts[full].tolist(), ends[full].tolist()):
                first = s + int(np.searchsorted(guest[s:e], True))
                got += _compare(code[s:first], code[first:e], radius)
            if got:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
                if held[0][0][0] == held[-1][0][-1] or sum(len(h[0]) for h in held) < 50_000:
                    continue
                tile, code, guest = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(tile, tile[-1]))
                held = [(tile[cut:], code[cut:], guest[cut:])]
                yield from done(tile[:cut], code[:cut], guest[:cut])
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held)))

    return dealt.select("fp", "tile", "guest").mapInArrow(run, "a long, b long")


def _least(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """Every row's (key columns of rows, component_id): known is (key, root), and the component's id the least of its rows.

    Null ids come last. A key or component with a great share of all rows is dealt to many tasks.
    """
    own = stored(rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(known, key, "left").withColumn("root", F.coalesce("root", key)))
    ids = stored(own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    of = join_hot(own.select(key, "root"), ids.select("root", "component_id"), "root", ids, total, F.xxhash64(key)).select(key, "component_id")
    return join_hot(rows, of, key, own, total, F.xxhash64("doc_id", F.rand(7)))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id that links reach."""
    rows = stored(fingerprints(docs, text, doc_id, width))
    total = rows.count()
    roots = components(links(rows.select("fp").distinct(), radius))
    return _least(rows, roots.select(F.col("node").alias("fp"), "root"), "fp", total).select("doc_id", "fp", "component_id")


SALTS = [np.uint64((0x9E3779B97F4A7C15 * (k + 1) ** 3) & (2**64 - 1)) for k in range(6)]
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BINS = 128
#: Hashed ids of texts whose sets are needed are marked in a table of so many bits; a mark too many costs a set, no result.
PLACES = 1 << 24


def mixed(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Another hash function of the same shingles: multiply and shift twice, so that orders under two salts are unrelated."""
    z = (hashes ^ salt) * MIX_A
    z = (z ^ (z >> np.uint64(31))) * MIX_B
    return z ^ (z >> np.uint64(29))


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """(six tile keys, one-permutation sketch of 128 bins of 16 bits) of a set of shingle hashes."""
    if not len(hashes):
        return [0] * len(SALTS), b"\0" * (2 * BINS)
    keys = [int(mixed(hashes, salt).min().view(np.int64)) for salt in SALTS]
    none = np.uint64(2**64 - 1)
    least = np.full(BINS, none)
    np.minimum.at(least, (hashes >> np.uint64(57)).astype(np.int64), hashes << np.uint64(7))
    full = np.flatnonzero(least != none)
    ahead = full[np.searchsorted(full, np.arange(BINS)) % len(full)]  # an empty bin takes the next full one's
    least = least[ahead] + ((np.arange(BINS) - ahead) % BINS).astype(np.uint64) * MIX_B
    return keys, ((least * MIX_A) >> np.uint64(48)).astype(np.uint16).tobytes()


def signature(text: str | None) -> tuple[int, int, list[int], bytes, np.ndarray]:
    """(hash of the set, size, keys, sketch, set) of the five-word shingles, each counted once."""
    hashes = np.unique(shingle_hashes(words(text), 5))
    node = xxhash.xxh64_intdigest(hashes.tobytes())
    return (node, len(hashes), *sketch(hashes), hashes)


def signatures(rows: DataFrame, with_fp: bool = False) -> DataFrame:
    """(row, doc_id, node, size, keys, sketch, fp) for every row (row, doc_id, text); texts of one shingle set are one node; fp is
    null if it is not asked for."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            nodes, sizes, keys, sketches = zip(*got) if (got := [signature(t)[:4] for t in texts]) else ((), (), (), ())
            fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)) if with_fp else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), fps], ["row", "doc_id", "node", "size", "keys", "sketch", "fp"])

    rows = rows.select("row", "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, size long, keys array<long>, sketch binary, fp long")


def shingle_sets(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """(node, sorted set as bytes) of the rows (row, text) that hash to one of the places (below PLACES), and of no others."""
    marked = np.zeros(PLACES // 8, np.uint8)
    np.bitwise_or.at(marked, places >> 3, (128 >> (places & 7)).astype(np.uint8))
    sent = rows.sparkSession.sparkContext.broadcast(marked)

    def run(batches):
        marked = np.unpackbits(sent.value).view(bool)
        for b in batches:
            held = np.flatnonzero(marked[b.column(0).to_numpy()])
            sets = [np.unique(shingle_hashes(words(b.column(1)[k].as_py()), 5)).tobytes() for k in held.tolist()]
            nodes = np.array([xxhash.xxh64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], ["node", "hashes"])

    return rows.select(F.pmod(F.xxhash64("row"), F.lit(PLACES)).alias("at"), "text").mapInArrow(run, "node long, hashes binary")


def _limit(size: np.ndarray, similarity: float) -> np.ndarray:
    """The share of equal bins that a pair of the similarity may fall to: five standard errors below it.

    A set of n shingles fills 128 (1 - exp(-n / 128)) bins; the others are copies, which doubles the variance at most.
    """
    return similarity - 5 * np.sqrt(2 * similarity * (1 - similarity) / np.maximum(BINS * -np.expm1(-size / BINS), 1))


def _groups(marks: np.ndarray, size: np.ndarray, similarity: float, confirm=None):
    """Yields (members, links) of each group that candidates, or those that `confirm` keeps, connect.

    Every member looks once at all members that no group has yet, so a group of near copies costs no pairs.
    """
    left = np.arange(len(size))
    while len(left) > 1:
        members, links, left = [left[0]], [], left[1:]
        for x in members:
            if not len(left):
                break
            low, high = np.minimum(size[x], size[left]), np.maximum(size[x], size[left])
            near = np.flatnonzero(low >= similarity * high - 1e-9)
            at = left[near]
            near = near[(marks[at] == marks[x]).mean(1) >= _limit(low[near], similarity)]
            if confirm is not None:
                near = np.array([k for k in near.tolist() if confirm(x, left[k])], np.int64)
            if len(near):
                members += left[near].tolist()
                links += [(x, y) for y in left[near].tolist()]
                left = np.delete(left, near)
        if links:
            yield members, links


def _by_key(dealt: DataFrame, key: str, schema: str, work) -> DataFrame:
    """work(columns of one key) makes lists of columns; rows are dealt by key and keys of one row are left out."""
    out, names = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")]), dealt.columns
    place = names.index(key)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table):
            of = t[key].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
            many = np.flatnonzero(np.diff(cuts) > 1)
            found = [x for s, e in zip(cuts[many].tolist(), cuts[many + 1].tolist()) for x in work(t.slice(s, e - s))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(place)[0].as_py() != batch.column(place)[-1].as_py():
                t = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(np.diff(t[key].to_numpy()))[-1]) + 1
                held = t.slice(cut).combine_chunks().to_batches()
                yield from done(t.slice(0, cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return dealt.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _split(dealt: DataFrame, sizes: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """The rows with every tile of more than `most` members (SPLIT) replaced by tiles of two of its bins; sizes: (tile, n).

    A member of a tile of m bins goes to the m - 1 tiles that its bin shares with another, so any two members still meet.
    """
    most = most or SPLIT
    hot = stored(sizes.where(F.col("n") > most).select("tile", F.ceil(F.col("n") / most).alias("bins")))
    n_hot = hot.count()
    if not n_hot:
        return dealt
    own = F.pmod(F.xxhash64(by, F.lit("bin")), F.col("bins"))
    others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1), lambda j: j != F.col("own")), lambda j: F.xxhash64("tile", F.least("own", j), F.greatest("own", j)))
    joined = dealt.join(F.broadcast(hot) if n_hot <= HOT_ROWS else hot, "tile", "left").withColumn("own", own)
    rest = [c for c in dealt.columns if c != "tile"]
    return joined.select(*rest, F.explode(F.when(F.col("bins").isNull(), F.array("tile")).otherwise(others)).alias("tile")).select(*dealt.columns)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, text, doc): every row of docs with a key of its own, in a durable table."""
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"), doc))


def _by_fingerprint(found: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of nodes that connect what the fingerprints of their texts (node, fp) connect, one at most for a node and fp."""
    own = stored(found.select(F.col("node").alias("doc_id"), "fp").distinct())
    roots = components(links(own.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    return _least(own, roots, "fp", own.count()).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b")


def _similar(rows: DataFrame, similarity: float, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, node) of every row (row, doc_id, text), and (node, root) of the nodes that have links; with `radius`, links
    of fingerprints count too."""
    found = stored(signatures(rows, radius is not None))
    least = stored(found.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))
    dealt = least.select("node", "size", "sketch", F.explode(F.array_distinct("keys")).alias("tile"))
    dealt = _split(dealt, dealt.groupBy("tile").agg(F.count("*").alias("n")), "node")

    def meet(t: pa.Table):
        node, size = t["node"].to_numpy(), t["size"].to_numpy()
        for members, _ in _groups(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(-1, BINS), size, similarity):
            together = np.sort(node[members])
            name = np.uint64(xxhash.xxh64_intdigest(together.tobytes())).view(np.int64)
            yield np.full(len(together), name), together

    def judge(t: pa.Table):
        node, sets = t["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        marks, size = np.stack([np.frombuffer(sketch(h)[1], np.uint16) for h in sets]), np.array([len(h) for h in sets])

        def alike(x, y):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            return both >= similarity * (size[x] + size[y] - both) - 1e-9

        for _, links in _groups(marks, size, similarity, alike):
            a, b = np.array(links).T
            yield node[a], node[b]

    groups = stored(_by_key(dealt.select("node", "size", "sketch", "tile"), "tile", "group long, node long", meet).distinct())
    wanted = least.join(groups.select("node").distinct(), "node", "left_semi").select(F.pmod(F.xxhash64("row"), F.lit(PLACES)).alias("at")).distinct()
    sets = shingle_sets(rows, wanted.toArrow()["at"].to_numpy()).groupBy("node").agg(F.first("hashes").alias("hashes"))
    tiles = groups.select("node", F.col("group").alias("tile"))
    tiles = _split(tiles, tiles.groupBy("tile").agg(F.count("*").alias("n")), "node", SETS)
    tied = _by_key(tiles.join(sets, "node").select("node", "hashes", "tile"), "tile", "a long, b long", judge)
    return found.select("row", "doc_id", "node"), components(tied if radius is None else tied.unionByName(_by_fingerprint(found, radius)))


def similar_texts(docs: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) for every row: texts linked by similar sets of five-word shingles; component_id is the
    smallest doc_id."""
    rows, roots = _similar(_keyed(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", "doc_id"), similarity)
    return _least(rows, roots, "node", rows.count()).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """The rows and columns of docs, one row of each group of near copies: that with the smallest id (rows without an id
    after all others), and of equal ids the first. Texts are linked if their fingerprints differ by `radius` bits or fewer, as
    in `near_duplicates`, or if they are similar, as in `similar_texts`.

    Rows are judged, not ids: unlike texts of one id all stay, and of equal rows, or rows without an id, one stays.
    """
    keyed = _keyed(docs, text, doc_id)
    rows, roots = _similar(keyed, similarity, radius)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = rows.groupBy("node").agg(F.min(first).alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = own.groupBy("root").agg(F.min("first")["row"].alias("row"))
    gone = stored(rows.select("row").join(kept, "row", "left_anti"))
    return keyed.join(gone, "row", "left_anti").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
