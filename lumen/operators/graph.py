"""Graphs as canonical edge tables (a < b, weight) and their centralities.

Nodes are the ends of edges, so isolated images are not in the graph. Betweenness and PageRank see weights, the others
do not; betweenness takes the weight as a length, although it is a similarity, as the reference results do.

Hops are counted for blocks of sources at once, see `hops`. Spectra and weighted paths need the whole graph at hand: up to
LOCAL_EDGES (weighted paths: PATH_EDGES) edges it is sent to the driver or the tasks. Spectra of larger graphs of up to NODES
nodes keep a number for each node on the driver and send no edge; still larger graphs take the joins over tables below,
weighted paths a block of sources after another. All ways give the same values. A weight that is null is 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.text import basename
from lumen.operators.components import HUB
from lumen.operators.components import components as reach
from lumen.operators.hops import SLICE, held_hops, hops, neighbour_lists, read_lists
from lumen.operators.similarity import row_index
from lumen.plans.durable import join_hot, stored

LOCAL_EDGES = 5_000_000
#: Weighted paths are searched in the tasks up to so many edges, a pass over all edges for each step of a source's longest path.
PATH_EDGES = 5_000_000
#: Spectra of larger graphs keep a number for each node on the driver if there are at most so many nodes, and the edges in tasks.
NODES = 1_000_000
#: Edges of a row of packed edges, and tasks that a round of a spectrum takes.
PACK, TASKS = 1 << 16, 24
#: Hops are searched with the whole graph in every task up to so many edges (8 bytes each); larger ones by joins.
HELD_EDGES = 48_000_000
#: Pairs of a source and a node that weighted paths over tables keep at once.
PAIRS = 50_000_000
#: Nodes with few strong neighbours that are broadcast.
WEAK = 1_000_000
METRICS = ("degree", "closeness", "harmonic", "eigenvector", "pagerank", "betweenness")


def build(similarities: DataFrame, threshold: float, position: str | None = None) -> DataFrame:
    """(a, b, weight): pairs (image1, image2, score) of `threshold` or more between basenames; of repeated pairs the last
    by `position` counts (without one the largest weight); loops, which same names in two folders give, are dropped."""
    x, y = basename(F.col("image1")), basename(F.col("image2"))
    rows = similarities.where(F.col("score") >= threshold).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col("score").alias("weight"), (F.col(position) if position else F.col("score")).alias("pos"))
    return rows.where("a <> b").groupBy("a", "b").agg(F.max_by("weight", "pos").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): every edge in either direction, made in one pass over the edges."""
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")
    return edges.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Neighbours / (n - 1)."""
    counts = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    n = counts.agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("node", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("k") / (F.col("n") - 1)).alias("score"))


def _local(edges: DataFrame):
    """(names, source, target, weight) as arrays if the graph has at most LOCAL_EDGES edges, else None; names are sorted."""
    if edges.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        return None
    t = edges.select("a", "b", F.coalesce("weight", F.lit(0.0)).alias("weight")).toArrow()
    a, b = t["a"].to_numpy(zero_copy_only=False), t["b"].to_numpy(zero_copy_only=False)
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    return names, np.concatenate((x, y)), np.concatenate((y, x)), np.tile(t["weight"].to_numpy().astype(float), 2)


def _csr(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
    order = np.lexsort((dst, src))
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order], w[order]


def _per_source(edges: DataFrame, run, columns: str) -> DataFrame:
    names, src, dst, w = _local(edges)
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast((names, *_csr(len(names), src, dst, w)))

    def work(batches):
        for b in batches:
            yield from run(sent.value, b.column(0).to_numpy())

    return spark.range(len(names)).repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 2))).mapInArrow(work, columns)


def paths(edges: DataFrame) -> DataFrame:
    """(node, reached, total, inverse): of every node the nodes it reaches (itself included), the sum of hops, of 1 / hops."""
    edges = edges if getattr(edges, "_stored", False) else stored(edges.select("a", "b"))  # hops see no weights
    if edges.limit(HELD_EDGES + 1).count() <= HELD_EDGES and (held := _packed(edges, keep=False)) is not None:
        names, packed = held
        found = held_hops(packed, len(names))
        named = edges.sparkSession.createDataFrame(pa.table({"idx": np.arange(len(names)), "node": pa.array(names)})).select("idx", F.col("node").cast(dict(nodes(edges).dtypes)["node"]).alias("node"))
        return found.join(F.broadcast(named), "idx").select("node", "reached", "total", "inverse")
    return hops(both_ways(edges.select("a", "b", F.lit(1.0).alias("weight"))), nodes(edges))


def closeness(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """((r - 1) / total) * ((r - 1) / (n - 1)); 0 if nothing is reached."""
    p = stored(paths(edges)) if known is None else known  # read twice
    n = p.agg(F.count("*").alias("n"))
    r = F.col("reached") - 1
    return p.crossJoin(F.broadcast(n)).select("node", F.when(F.col("total") > 0, (r / F.col("total")) * (r / (F.col("n") - 1))).otherwise(0.0).alias("score"))


def harmonic(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sum of 1 / hops, not normalised."""
    return (paths(edges) if known is None else known).select("node", F.col("inverse").alias("score"))


def _scores(edges: DataFrame, names: np.ndarray, score: np.ndarray) -> DataFrame:
    kind = dict(nodes(edges).dtypes)["node"]
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(names), "score": pa.array(score)})).select(F.col("node").cast(kind).alias("node"), "score")


def eigenvector(edges: DataFrame, rounds: int = 1000, tol: float = 1e-12) -> DataFrame:
    """Leading eigenvector of the unweighted graph, length 1, by power iteration on A + I (which also converges on
    two-sided graphs; several components: the mass goes to the one with the largest eigenvalue)."""
    edges = stored(edges)
    if (g := _local(edges)) is None:
        return _iterate(edges, rounds, tol, None)
    names, src, dst, _ = g
    x = np.full(len(names), 1.0)
    for _ in range(rounds):
        new = x + np.bincount(src, x[dst], len(names))
        new /= np.linalg.norm(new) or 1.0
        if np.abs(new - x).sum() < tol * len(names):
            x = new
            break
        x = new
    return _scores(edges, names, x)


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Weighted PageRank with uniform teleport; ends when the scores move by less than n * tol in sum.

    A node whose weights are all 0 passes nothing on: its score goes to all nodes in equal parts.
    """
    edges = stored(edges)
    if (g := _local(edges)) is None:
        return _iterate(edges, rounds, tol, alpha)
    names, src, dst, w = g
    n = len(names)
    if not n:
        return _scores(edges, names, np.zeros(0))
    out = np.bincount(src, w, n)
    x = np.full(n, 1.0 / n)
    for _ in range(rounds):
        flow = np.bincount(dst, w * x[src] / np.where(out[src] > 0, out[src], 1), n)
        new = alpha * (flow + x[out <= 0].sum() / n) + (1 - alpha) / n
        moved = np.abs(new - x).sum()
        x = new
        if moved < n * tol:
            break
    return _scores(edges, names, x)


def _packed(edges: DataFrame, weights: bool = False, keep: bool = True, of: DataFrame | None = None):
    """(sorted names, rows (a, b[, w]) of PACK edges as bytes: numbers of the ends, weights); None if there are over NODES nodes or a null one.
    Rows that are read but once need no table of their own (`keep`). `of` are other pairs (a, b) of the nodes to be packed.

    Edges stay where they lie: the nodes' names go to the tasks, which number the ends.
    """
    known = stored(nodes(edges))
    if known.limit(NODES + 1).count() > NODES or not known.where("node is null").isEmpty():
        return None
    names = np.unique(known.toArrow()["node"].to_numpy(zero_copy_only=False))
    sent, columns = edges.sparkSession.sparkContext.broadcast(names), ["a", "b", "w"][: 2 + weights]

    def run(batches):
        index = pd.Index(sent.value)
        at = lambda column: index.get_indexer(pd.Index(column.to_numpy(zero_copy_only=False))).astype(np.int32)
        held, n = [], 0
        for b in batches:
            held.append([at(b.column(0)), at(b.column(1)), *([b.column(2).to_numpy(zero_copy_only=False)] if weights else [])])
            n += b.num_rows
            if n >= PACK:
                yield _bytes_row(held, columns)
                held, n = [], 0
        if n:
            yield _bytes_row(held, columns)

    rows = (edges if of is None else of).select("a", "b", *([F.coalesce("weight", F.lit(0.0)).cast("double").alias("w")] if weights else []))
    packed = rows.mapInArrow(run, ", ".join(f"{c} binary" for c in columns))
    return names, stored(packed) if keep else packed


def _bytes_row(held: list, columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*held)], columns)


def _flow(packed: DataFrame, x: np.ndarray) -> np.ndarray:
    """What every node gets when each node sends x (times the weight, if packed) along its edges; a task gives one sum a node."""
    sent = packed.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        x, total, any_ = sent.value, np.zeros(len(sent.value)), False
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(i)[k].as_buffer(), np.int32) for i in (0, 1))
                w = np.frombuffer(batch.column(2)[k].as_buffer(), np.float64) if batch.num_columns > 2 else 1.0
                total += np.bincount(a, x[b] * w, len(x)) + np.bincount(b, x[a] * w, len(x))
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["flow"])

    found = packed.coalesce(TASKS).mapInArrow(run, "flow binary").toArrow()["flow"]
    sent.unpersist()
    return sum((np.frombuffer(f.as_buffer(), np.float64) for f in found), np.zeros(len(x)))


def _iterate_packed(edges: DataFrame, names: np.ndarray, packed: DataFrame, rounds: int, tol: float, alpha: float | None) -> DataFrame:
    """Power iteration with the numbers of nodes on the driver and the edges in the tasks; no edge is shuffled."""
    n = len(names)
    x = np.full(n, 1.0 if alpha is None else 1.0 / max(n, 1))
    out = _flow(packed, np.ones(n)) if alpha is not None else None
    for _ in range(rounds if n else 0):
        if alpha is None:
            new = x + _flow(packed, x)
            new /= np.linalg.norm(new) or 1.0
        else:
            flow = _flow(packed, x / np.where(out > 0, out, 1))
            new = alpha * (flow + x[out <= 0].sum() / n) + (1 - alpha) / n
        moved = np.abs(new - x).sum()
        x = new
        if moved < n * tol:
            break
    return _scores(edges, names, x)


def _iterate(edges: DataFrame, rounds: int, tol: float, alpha: float | None) -> DataFrame:
    """Power iteration for graphs that no single machine should hold: with numbers of nodes on the driver if they are few, else
    by joins, where lineage is cut at every round, and one aggregate a round gives the length or the mass that stays, another
    what has moved."""
    if (held := _packed(edges, alpha is not None)) is not None:
        return _iterate_packed(edges, *held, rounds, tol, alpha)
    e = both_ways(edges).withColumn("weight", F.coalesce("weight", F.lit(0.0)) if alpha is not None else F.lit(1.0))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    out = stored(out)
    n, n_steps = out.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return out.select(F.col("src").alias("node"), F.col("out").alias("score"))
    e, start = stored(e), 1.0 / n if alpha is not None else 1.0
    x = stored(out.select(F.col("src").alias("node"), F.lit(start).alias("score"), "out", F.lit(0.0).alias("moved")))
    for _ in range(rounds):
        share = x.select(F.col("node").alias("src"), (F.try_divide("score", "out") if alpha is not None else F.col("score")).alias("share")).where("share is not null")
        flow = join_hot(e, share, "src", out.select("src", "n"), n_steps, F.xxhash64("dst")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("weight")).alias("flow"))
        new = x.join(flow, "node", "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
        if alpha is not None:
            left = x.agg(F.coalesce(F.sum(F.when(F.col("out") <= 0, F.col("score"))), F.lit(0.0))).first()[0]
            new = new.select("node", "score", "out", (alpha * (F.col("flow") + left / n) + (1 - alpha) / n).alias("new"))
        else:
            length = F.sqrt(F.sum((F.col("score") + F.col("flow")) * (F.col("score") + F.col("flow")))).alias("length")
            new = new.crossJoin(F.broadcast(new.agg(length))).select("node", "score", "out", ((F.col("score") + F.col("flow")) / F.col("length")).alias("new"))  # one row
        x = stored(new.select("node", F.col("new").alias("score"), "out", F.abs(F.col("new") - F.col("score")).alias("moved")))
        if x.agg(F.sum("moved")).first()[0] < n * tol:
            break
    return x.select("node", "score")


def _brandes(graph, source: int) -> np.ndarray:
    """Dependencies of one source on weighted shortest paths; ties by exact equality of the sums."""
    _, start, dst, w = graph
    n = len(start) - 1
    dist, paths_, before, order = {}, np.zeros(n), [[] for _ in range(n)], []
    paths_[source] = 1.0
    seen = {source: 0.0}
    heap, c = [(0.0, 0, source)], 1
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        order.append(v)
        for k in range(start[v], start[v + 1]):
            u, far = int(dst[k]), d + w[k]
            if u not in dist and (u not in seen or far < seen[u]):
                seen[u] = far
                heapq.heappush(heap, (far, c, u))
                c += 1
                paths_[u], before[u] = paths_[v], [v]
            elif u in seen and far == seen[u] and u not in dist:
                paths_[u] += paths_[v]
                before[u].append(v)
    out = np.zeros(n)
    for v in reversed(order):
        for u in before[v]:
            out[u] += paths_[u] / paths_[v] * (1 + out[v])
    out[source] = 0
    return out


def _dependent(graph, src: np.ndarray, source: int) -> np.ndarray:
    """The same as `_brandes`, a pass over all edges (sorted by src) at a time; None if weights are so small that they add nothing.

    Distances are the least sums from the source on, as `_brandes` has them. The steps of shortest paths have no cycles: paths
    are counted forwards by their number of steps, shares go back the same way.
    """
    _, start, dst, w = graph
    n = len(start) - 1
    far = np.full(n, np.inf)
    far[source] = 0.0
    while True:
        new = np.minimum(far, np.minimum.reduceat(far[dst] + w, start[:-1]))
        if (new == far).all():
            break
        far = new
    there = far[src]
    k = np.flatnonzero((far[dst] + w == there) & np.isfinite(there))
    a, b = dst[k], src[k]
    now = count = np.bincount([source], minlength=n).astype(float)
    for _ in range(n):
        if not (now := np.bincount(b, now[a], n)).any():
            break
        count = count + now
    else:
        return None
    share = count[a] / count[b]
    now = total = np.isfinite(far).astype(float)
    while (now := np.bincount(a, share * now[b], n)).any():
        total = total + now
    total[np.isfinite(far)] -= 1
    total[source] = 0.0
    return total


def betweenness(edges: DataFrame) -> DataFrame:
    """Share of shortest paths through a node, 2 / ((n - 1) (n - 2)) normalised, ends excluded; every task takes its share
    of the sources and adds up what they give before the shuffle. Weights must be above 0."""
    edges, most = stored(edges), min(PATH_EDGES, LOCAL_EDGES)
    if edges.limit(most + 1).count() > most:
        return _normalised(edges, dependencies_by_joins(edges))
    kind = dict(nodes(edges).dtypes)["node"]

    def run(graph, sources):
        plain, src, total = (graph[3] <= 0).any(), np.repeat(np.arange(len(graph[0])), np.diff(graph[1])), np.zeros(len(graph[0]))
        for s in sources:
            found = None if plain else _dependent(graph, src, int(s))
            total += _brandes(graph, int(s)) if found is None else found
        yield pa.RecordBatch.from_arrays([pa.array(graph[0]), pa.array(total)], ["node", "part"])

    return _normalised(edges, _per_source(edges, run, f"node {kind}, part double"))


def _normalised(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, score) from the dependencies (node, part), summed over the sources."""
    sums = nodes(edges).join(parts.groupBy("node").agg(F.sum("part").alias("part")), "node", "left")
    n = nodes(edges).agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)
    return sums.crossJoin(F.broadcast(n)).select("node", (F.coalesce("part", F.lit(0.0)) / scale).alias("score"))


def lengths_by_joins(step: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, far): weighted distances from the sources (node) over step (src, dst, weight); only what got shorter goes on."""
    far = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("far")))
    front = far
    while not front.isEmpty():
        tried = front.join(step, front.node == step.src).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("far") + F.col("weight")).alias("new"))
        both = stored(far.join(tried, ["source", "node"], "full"))
        front = both.where("new < far or far is null").select("source", "node", F.col("new").alias("far"))
        far = both.select("source", "node", F.least("far", "new").alias("far"))
    return far


def dependencies_by_joins(edges: DataFrame, pairs: int | None = None) -> DataFrame:
    """(node, part): what all sources depend on each node, for graphs that no single machine should hold.

    Sources are taken in blocks of so many that a block has at most `pairs` rows (source, node); a block's distances, steps
    and walks are dropped when its dependencies have been added to the nodes' sums.
    """
    step = stored(both_ways(edges))
    numbered = stored(row_index(nodes(edges), "node"))
    n, total = numbered.count(), None
    size = max(1, (pairs or PAIRS) // max(n, 1))
    for low in range(0, n, size):
        part = _dependencies(step, numbered.where(F.col("idx").between(low, low + size - 1)).select("node"))
        total = stored((part if total is None else part.unionByName(total)).groupBy("node").agg(F.sum("part").alias("part")))
    return numbered.limit(0).select("node", F.lit(0.0).alias("part")) if total is None else total


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, part) of every source (node) that depends on others, over edges (src, dst, weight) in both directions.

    The steps of all shortest paths form a graph without cycles for each source. Paths are counted forwards by their
    number of steps, shares go back the same way; both end after the longest path.
    """
    far = stored(lengths_by_joins(edges, sources))
    to = far.select("source", F.col("node").alias("dst"), F.col("far").alias("there"))
    step = stored(far.join(edges, F.col("node") == F.col("src")).join(to, ["source", "dst"]).where("there = far + weight").select("source", "src", "dst"))

    def walked(first: DataFrame, along: DataFrame, start: str, end: str, share: str) -> DataFrame:
        now = total = first
        while not now.isEmpty():
            moved = now.withColumnRenamed("node", start).join(along, ["source", start])
            now = stored(moved.groupBy("source", F.col(end).alias("node")).agg(F.sum(F.expr(f"x * {share}")).alias("x")))
            total = total.unionByName(now)
        return stored(total.groupBy("source", "node").agg(F.sum("x").alias("x")))

    own = far.where("source = node").select("source", "node", F.lit(1.0).alias("x"))
    count = walked(own, step, "src", "dst", "1")
    shares = step.join(count.select("source", F.col("node").alias("src"), F.col("x").alias("a")), ["source", "src"])
    shares = shares.join(count.select("source", F.col("node").alias("dst"), F.col("x").alias("b")), ["source", "dst"])
    back = walked(far.select("source", "node", F.lit(1.0).alias("x")), stored(shares.select("source", "src", "dst", (F.col("a") / F.col("b")).alias("share"))), "dst", "src", "share")
    return back.where("source <> node").select("node", (F.col("x") - 1).alias("part"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable."""
    return reach(edges).withColumnRenamed("root", "component")


def face_groups(faces: DataFrame, matches: DataFrame) -> DataFrame:
    """(face_id, match_id) for every face; faces without a match are groups of their own."""
    found = components(matches.select("a", "b"))
    return faces.join(found, faces.face_id == found.node, "left").select("face_id", F.coalesce("component", "face_id").alias("match_id"))


def centralities(edges: DataFrame, wanted: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, node, score), only what is wanted; hops are searched once for closeness and harmonic."""
    if unknown := set(wanted) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {METRICS}")
    edges = stored(edges) if len(wanted) > 1 else edges  # a single metric reads them once, or stores them itself
    known = stored(paths(edges)) if {"closeness", "harmonic"} & set(wanted) else None
    made = {"degree": degree, "closeness": lambda e: closeness(e, known), "harmonic": lambda e: harmonic(e, known), "eigenvector": eigenvector, "pagerank": pagerank, "betweenness": betweenness}
    out = None
    for m in wanted:
        part = made[m](edges).select(F.lit(m).alias("metric"), "node", "score")
        out = part if out is None else out.unionByName(part)
    return out


def enrich(edges: DataFrame, metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with the attributes of image results (by basename; of several the largest path) and a column for each metric."""
    wide = metrics.groupBy("node").pivot("metric", list(METRICS)).agg(F.first("score"))
    meta = results.withColumn("node", basename(F.col("image_path")))
    keep = [c for c in results.columns if c not in (*METRICS, "node")]
    meta = meta.groupBy("node").agg(F.max_by(F.struct(*keep), "image_path").alias("m")).select("node", "m.*")
    return nodes(edges).join(meta, "node", "left").join(wide, "node", "left")


def neighbours(edges: DataFrame, least: float = 0.3, few: int = 3) -> DataFrame:
    """(src, dst, weight): neighbours of weight `least` or more; a node with fewer than `few` of them keeps its `few` heaviest.

    The strong neighbours are only counted, and the heaviest are only sought for nodes with too few of them: each task
    keeps `few` edges of a node before the shuffle (a window's group limit). Up to WEAK such nodes go to the tasks, so that
    their edges only are shuffled; of more, joins deal the edges of hubs to many tasks. Equal weights go by dst.
    """
    edges = stored(edges)
    both = both_ways(edges)
    degrees = stored(both.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("weight") >= least).alias("strong")))
    total, enough = degrees.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], degrees.where(F.col("strong") >= few).select("src")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    weak = degrees.where(F.col("strong") < few).select("src")
    if weak.limit(WEAK + 1).count() <= WEAK:
        kept = both.where(F.col("weight") >= least).join(F.broadcast(weak), "src", "left_anti")
        heaviest = both.join(F.broadcast(weak), "src", "left_semi").withColumn("rank", rank).where(F.col("rank") <= few)
        return kept.select("src", "dst", "weight").unionByName(heaviest.select("src", "dst", "weight"))
    of = lambda rows, how: join_hot(rows, enough, "src", degrees.select("src", "n"), total, F.xxhash64("dst"), HUB, how)
    kept = of(both.where(F.col("weight") >= least), "left_semi")
    heaviest = of(both, "left_anti").withColumn("rank", rank).where(F.col("rank") <= few)
    return kept.select("src", "dst", "weight").unionByName(heaviest.select("src", "dst", "weight"))


def near_lists(edges: DataFrame):
    """(sorted names, lists, type of a node) of what `neighbours` gives, each node's neighbours in one row of lists; None beyond NODES nodes.

    Numbers of neighbours are dealt and kept as gaps, a byte or two each, once for all rounds that read them.
    """
    held = _packed(edges, keep=False, of=neighbours(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return held and (held[0], neighbour_lists(held[1], both=False), dict(nodes(edges).dtypes)["node"])


#: Confidences of neighbours whose medians are sought at once in a task.
MEET = 1 << 21


def medians(near, conf: DataFrame) -> DataFrame:
    """(node, tag, conf): for each node of `near_lists` the median of each tag over its neighbours' confidences (node, tag, conf).

    Confidences go to the tasks, where a node's neighbours lie together; nothing is shuffled.
    """
    names, lists, kind = near
    t = conf.select("node", "tag", "conf").toArrow()
    tags, tag = np.unique(t["tag"].to_numpy(zero_copy_only=False), return_inverse=True)
    values, rank = np.unique(t["conf"].to_numpy(), return_inverse=True)
    at = pd.Index(names).get_indexer(pd.Index(t["node"].to_numpy(zero_copy_only=False)))
    order = np.argsort(at, kind="stable")[(at < 0).sum() :]
    start = np.searchsorted(at[order], np.arange(len(names) + 1))
    sent = conf.sparkSession.sparkContext.broadcast((names, tags, values, start, tag[order], rank[order]))

    def run(batches):
        names, tags, values, start, tag, rank = sent.value
        for b in batches:
            for k in range(b.num_rows):
                counts, near = read_lists(b["counts"][k].as_py(), b["gaps"][k].as_py())
                src, each = np.repeat(np.arange(SLICE), counts), np.diff(start)[near]
                ends = np.cumsum(each)
                cuts = np.flatnonzero(np.diff(src, prepend=-1))  # where a node's neighbours begin
                pieces, low = np.searchsorted(ends, np.arange(MEET, ends[-1] if len(ends) else 0, MEET)), 0
                for high in [*np.unique(cuts[np.searchsorted(cuts, pieces[pieces <= cuts[-1]])] if len(cuts) else []).tolist(), len(near)]:
                    if high > low:
                        yield from middle(b["slice"][k].as_py(), src[low:high], near[low:high], each[low:high])
                    low = high

    def middle(at, src, near, each):
        names, tags, values, start, tag, rank = sent.value
        own = np.repeat(start[near] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        if not len(own):
            return
        key = np.sort((np.repeat(src, each) * len(tags) + tag[own]) * len(values) + rank[own])
        group, v = key // len(values), values[key % len(values)]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        n = np.diff(first, append=len(group))
        found = (v[first + (n - 1) // 2] + v[first + n // 2]) / 2
        of = group[first]
        yield pa.RecordBatch.from_arrays([pa.array(names[at * SLICE + of // len(tags)]), pa.array(tags[of % len(tags)], pa.string()), pa.array(found)], ["node", "tag", "conf"])

    return lists.mapInArrow(run, f"node {kind}, tag string, conf double")


def top(metrics: DataFrame, metric: str = "eigenvector", n: str | int | None = None) -> DataFrame:
    """(node, score) by score, then node; n: '', 'all' or what is no whole number give all, negative ones none."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; there are {METRICS}")
    rows = metrics.where(F.col("metric") == metric).select("node", "score").orderBy(F.desc("score"), "node")
    try:
        return rows.limit(max(0, int(str(n).strip())))
    except ValueError:
        return rows


def last_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row for each key: that with the largest position."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(*key, "r.*")
