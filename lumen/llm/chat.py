"""Operator 5: chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs often hold a conversation again after every turn. A rolling hash over the turns names every prefix of every
conversation; one whose whole hash is a proper prefix of another is a snapshot of it and goes by an anti-join. Of equal
conversations the one with the smallest id stays. What stays is rendered as one text with role markers.

Defined results: turns are ordered by turn, role and text (nulls first), so ties and repeated rows have one result;
null roles and texts are empty; a row with a null conv_id is a conversation of one turn, whose null id only wins over
equals that have no id either; "<|" in roles and texts becomes "< |", so that no text can pass for a marker; other columns
are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.plans.durable import stored

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, own (set only where conv_id is null), k, last, two rolling 64-bit hashes of the first k turns, and the rendered turn.

    Exclusive-or of hashes that take in the turn's place: order counts, and each turn costs one step.
    """
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", own.alias("own"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("last", F.lead("k").over(order).isNull())
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    for name, salt in (("p1", "a"), ("p2", "b")):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "k", "role", "text")).over(rolling))
    shown = F.concat(F.lit(START), F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(END + "\n"))
    return rows.select("conv_id", "own", "k", "last", "p1", "p2", shown.alias("shown"))


def collapse(prefixes: DataFrame) -> DataFrame:
    """conv_id, own, n_turns, n_copies of the conversations that are no snapshot of another."""
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "own"))
    whole = prefixes.where("last").groupBy("k", "p1", "p2").agg(first.alias("c"), F.count("*").alias("n_copies"))
    inner = prefixes.where("not last").select("k", "p1", "p2").distinct()
    return whole.join(inner, ["k", "p1", "p2"], "left_anti").select("c.conv_id", "c.own", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies (equal ones, itself included), rendered."""
    rows = turns.select(turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
    prefixes = stored(turn_prefixes(rows))
    kept = collapse(prefixes)
    # One of both keys is null in every row; together they are different for every conversation.
    joined = prefixes.alias("p").join(kept.alias("c"), F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & F.col("p.own").eqNullSafe(F.col("c.own")))
    texts = joined.groupBy("c.conv_id", "c.own", "c.n_turns", "c.n_copies").agg(F.array_sort(F.collect_list(F.struct("p.k", "p.shown"))).alias("turns"))
    return texts.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.transform("turns", lambda t: t["shown"])).alias("rendered"))


RENDER_SQL = """
WITH r AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations),
t AS (SELECT conv_id, own, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM r),
s AS (SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS shown,
  chr(30) || role || chr(31) || text AS raw, count(*) OVER (PARTITION BY conv_id, own) AS n FROM t),
p AS (SELECT conv_id, k, n, string_agg(shown, '') OVER w AS rendered, string_agg(raw, '') OVER w AS prefix FROM s
  WINDOW w AS (PARTITION BY conv_id, own ORDER BY k ROWS UNBOUNDED PRECEDING)),
c AS (SELECT min(conv_id) AS conv_id, n, count(*) AS n_copies, prefix, min(rendered) AS rendered FROM p WHERE k = n GROUP BY n, prefix)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = c.prefix)
"""
