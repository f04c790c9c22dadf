"""Operator 12: the prefix trie of conversations, built level by level.

A node is a different sequence of first turns; its depth is their number, its members the conversations that begin with
them, its name the smallest of these. Going down, the live conversations of a depth are grouped by (parent node, next
turn) and every group is a node. Going up, leaves and savings are summed by parent and joined to the level above.

How Spark runs it: a turn is a digest of role and text and a length, so texts are read once and shuffled once, when
turns are put in order (a global sort; the places in a conversation come from the sizes of its runs in the partitions
before, so a conversation of any length is spread over tasks). Groups aggregate in every task before the shuffle; the
members of a large one are dealt to many tasks when the node's name goes back to them (`join_hot`). A conversation that
is alone in its node leaves the levels: its further nodes are its own turns, and closed forms give their rows. So there
are as many levels as the longest prefix that two conversations share has turns. Each level is a durable table.

ends_sha256 must take the ids of a node in order, which is one after another: ids are sorted over all tasks and joined to
chunks there, and one task a node feeds their chunks to the hash as a stream, in constant memory.

Defined results: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; repeated
rows are turns of their own; a row without a conv_id belongs to no conversation and is left out; a very long text is only
its digest and length; other columns are not looked at, whatever their names; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.plans.durable import join_hot, stored

#: Ids in a chunk of an ends_sha256.
CHUNK = 1 << 16
#: Conversations of a node, or turns of a conversation, that one task takes in any case.
LARGE = 4096
NONE_ENDED = hashlib.sha256(b"").hexdigest()


def ordered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, k, digest, bytes): the place of every turn in its conversation, from 1, its digest, and the length of its text."""
    rows = rows.select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the generated id are the partition, the lower ones count from 0 in it.
    local = stored(ranged.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id")))
    local = local.withColumn("run", F.shiftright("id", 33))
    runs = local.groupBy("conv_id", "run").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    runs = runs.select("conv_id", "run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return local.join(runs, ["conv_id", "run"]).select("conv_id", (F.col("id") + F.col("shift")).alias("k"), "digest", "bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """(conv_id, n): how many turns every conversation has."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def rebuilt(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv_id, k, digest, bytes) and (conv_id, n), n = 0 included.

    `base` (of conv_id) names the conversation whose first `taken` (of conv_id, `most` at most) turns replace as many of a
    conversation's own; all of them count if there are fewer, none if it does not exist. Own turns after that number follow.
    """
    turns = stored(turns)
    own = stored(sizes(turns))
    plan = own.select("conv_id", "n", base.cast("long").alias("base"), taken.cast("long").alias("taken"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    plan = stored(plan.withColumn("given", F.least("taken", F.coalesce("there", F.lit(0)))))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = join_hot(turns, plan.select("conv_id", "taken", "given"), "conv_id", own, total, F.col("k"), LARGE).where("k > taken")
    rest = rest.select("conv_id", (F.col("k") - F.col("taken") + F.col("given")).alias("k"), "digest", "bytes")
    first = turns.where(F.col("k") <= most).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "given"), "base").where("k <= given")
    counts = plan.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("n"))
    return stored(rest.unionByName(first.select("conv_id", "k", "digest", "bytes"))), stored(counts)


def _named(live: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (key, conv_id, parent, bytes, n_convs) of live conversations (conv_id, key, parent, bytes, ...), and each
    conversation with its node's name and size."""
    nodes = stored(live.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.count("*").alias("n_convs")))
    total = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    counts = nodes.select("key", F.col("n_convs").alias("n"))
    named = join_hot(live, nodes.select("key", F.col("conv_id").alias("node"), "n_convs"), "key", counts, total, F.col("conv_id"), LARGE)
    return nodes.withColumn("depth", F.lit(depth).cast("long")), stored(named)


def build(turns: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` (conv_id, k, digest, bytes) has k from 1 without gaps, `counts` (conv_id, n) every conversation once, also those
    without turns. saved_tokens: bytes of the last turn times the members but one, over a node's subtree.
    """
    root = counts.select("conv_id", "n", F.lit(b"").alias("key"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    levels, alone, ended, depth = [], [], [], 0
    nodes, live = _named(root, 0)
    while True:
        levels.append(nodes)
        alone.append(live.where("n_convs = 1").select("conv_id", "n", "parent", "bytes", F.lit(depth).cast("long").alias("at")))
        shared = live.where("n_convs > 1")
        ended.append(shared.where(F.col("n") == depth).select("conv_id", "node", F.lit(depth).cast("long").alias("depth")))
        going = shared.where(F.col("n") > depth).select("conv_id", "n", F.col("node").alias("parent"))
        if going.isEmpty():
            break
        depth += 1
        step = turns.where(F.col("k") == depth).select("conv_id", "digest", "bytes")
        nodes, live = _named(going.join(step, "conv_id").select("conv_id", "n", F.concat(F.col("parent").cast("string").cast("binary"), "digest").alias("key"), "parent", "bytes"), depth)
    ends = digests(_union(ended))
    above, done = None, []
    for nodes in reversed(levels):
        rows = nodes.where("n_convs > 1").select("conv_id", "depth", "parent", "n_convs", (F.col("bytes") * (F.col("n_convs") - 1)).alias("own"))
        if above is not None:
            rows = rows.join(above.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")), "conv_id", "left")
            rows = rows.select("conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        else:
            rows = rows.select("conv_id", "depth", "parent", "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
        done.append(rows := stored(rows))
        above = rows.select("parent", "n_leaves", "saved_tokens").unionByName(nodes.where("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    shared = _union(done).join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_ENDED)))
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return shared.select(*columns).unionByName(_chains(turns, stored(_union(alone))).select(*columns))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _chains(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, n, parent, at) that are alone from the depth `at` on: one a depth up to n."""
    total = alone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    below = join_hot(turns.select("conv_id", "k"), alone.select("conv_id", "n", "at"), "conv_id", alone.select("conv_id", "n"), total, F.col("k"), LARGE)
    below = below.where("k > at").select("conv_id", F.col("k").alias("depth"), F.col("conv_id").alias("parent"), "n")
    rows = below.unionByName(alone.select("conv_id", F.col("at").alias("depth"), "parent", "n"))
    last, one, none = F.col("depth") == F.col("n"), F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE_ENDED)
    return rows.select("conv_id", "depth", "parent", one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))


def digests(ended: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes (node, depth) from the conversations (conv_id, node, depth) that end there."""

    def chunks(batches):
        node, held = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([held[0]]), pa.array([",".join(map(str, held))])], ["node", "depth", "first", "ids"])

        for b in batches:
            for n, d, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (n, d) != node or len(held) >= CHUNK:
                    if held:
                        yield row()
                    node, held = (n, d), []
                held.append(c)
        if held:
            yield row()

    def fed(batches):
        node, h = None, None
        done: list[tuple] = []
        for b in batches:
            for n, d, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if (n, d) != node:
                    if h is not None:
                        done.append((*node, h.hexdigest()))
                    node, h = (n, d), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if len(done) >= LARGE:
                yield made(done)
                done = []
        if h is not None:
            done.append((*node, h.hexdigest()))
        yield made(done)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    order = ["node", "depth", "conv_id"]
    parts = ended.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(chunks, "node long, depth long, first long, ids string")
    return stored(stored(parts).repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(fed, "conv_id long, depth long, ends_sha256 string"))


#: crc32 of the decimal conv_id, bit by bit; 0xEDB88320 is the polynomial, 4294967295 all ones.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: list_reduce(list_prepend(xor(h, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"
TRIE_SQL = f"""
WITH o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS MATERIALIZED (SELECT c, count(*) AS n, c - c % 5 AS base, {_CRC} % 9 AS h FROM o GROUP BY c),
q AS MATERIALIZED (SELECT p.*, least(h, coalesce(b.there, 0)) AS given FROM p LEFT JOIN (SELECT c AS base, n AS there FROM p) b USING (base)),
r AS MATERIALIZED (SELECT q.c, o.k, role, text FROM q JOIN o ON o.c = q.base AND o.k <= q.given UNION ALL SELECT q.c, o.k - h + given AS k, role, text FROM q JOIN o ON o.c = q.c AND o.k > q.h),
s AS MATERIALIZED (SELECT c, k, octet_length(encode(text)) AS bytes, string_agg(chr(30) || role || chr(31) || text, '') OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix FROM r
  UNION ALL SELECT c, 0, 0, '' FROM q),
z AS MATERIALIZED (SELECT s.c, k, bytes, min(s.c) OVER (PARTITION BY k, prefix) AS node, k = max(k) OVER (PARTITION BY s.c) AS ends FROM s),
n AS MATERIALIZED (SELECT node, k, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM z GROUP BY 1, 2),
e AS MATERIALIZED (SELECT n.node, n.k, u.node AS up FROM n JOIN z u ON u.c = n.node AND u.k = n.k - 1),
l AS MATERIALIZED (SELECT up AS node, k - 1 AS k, count(*) AS n_children FROM e GROUP BY 1, 2),
t AS MATERIALIZED (SELECT a.node, a.k, count(*) FILTER (l.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM n LEFT JOIN l ON l.node = n.node AND l.k = n.k
  JOIN z a ON a.c = n.node AND a.k <= n.k GROUP BY 1, 2)
SELECT n.node AS conv_id, n.k AS depth, e.up AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n LEFT JOIN e ON e.node = n.node AND e.k = n.k LEFT JOIN l ON l.node = n.node AND l.k = n.k JOIN t ON t.node = n.node AND t.k = n.k
"""


def nodes(conversations: DataFrame, block: int = 5, most: int = 8, **names) -> DataFrame:
    """The trie of conversations rebuilt so that each begins with some turns of the first of its block of ids: c - c % block,
    crc32(c) % (most + 1) turns."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    return build(*rebuilt(ordered(conversations, **names), F.col("conv_id") - F.col("conv_id") % block, taken, most))
