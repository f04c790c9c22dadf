"""Operator 11: audit of how filters interact, by a subset-zeta transform.

Every document gets a mask with a bit for each filter it fails. Documents are counted by part and mask once; the zeta
transform turns the 2 ** n counts of a part into the survivors of every set of filters: those whose mask lies inside the
complement. Whatever an order of filters does is then a difference of neighbouring sets: a step removes surv(before) -
surv(before and the filter). The same holds for the counts of documents with a label.

How Spark runs it: texts are read once, and what is left of a document is a digest, a mask and its part; that table is
written. The duplicate filter needs the smallest id of each digest, which aggregates in every task before the shuffle,
and a join on (digest, id), so neither a text nor a part with a third of all rows makes a large task. Masks are counted in
every task, then by part; from there on everything is an expression over one row a part.

Defined results: a null text is empty; a null part counts as the empty string; a null id is smaller and larger than none,
so such a row is no duplicate and has no label; rows that repeat an id with the same text each count, and all are the first
of their text if one is; of repeated labels of an id the largest counts, a label that is null or absent is 0; a very long
text is read whole; other columns are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.plans.durable import stored


#: Filters by letter, as conditions under which a text fails, over its measures; DUPLICATE is the letter of the duplicate
#: filter, which looks at all texts.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_marks > 0",
}
DUPLICATE = "E"
MARKS = b"#$%&*|"
CAPITALS, FOLLOWING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
MEASURES = "n_words long, n_distinct long, n_capitals long, n_chars long, n_marks long, digest binary"


def measures(text: bytes) -> tuple:
    """Words, different words, capitals A-Z, code points and marks of a text in UTF-8, and its digest."""
    words = text.split()  # bytes are split at the six ASCII marks of white space only
    without = lambda some: len(text.translate(None, some))
    return len(words), len(set(words)), len(text) - without(CAPITALS), without(FOLLOWING), len(text) - without(MARKS), hashlib.sha256(text).digest()


def measured(rows: DataFrame) -> DataFrame:
    """(doc_id, part, measures) of rows (doc_id, part, text)."""

    def run(batches):
        for b in batches:
            found = zip(*(measures(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist())) if b.num_rows else [()] * 6
            columns = [pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "part", *(m.split()[0] for m in MEASURES.split(", "))])

    return rows.select("doc_id", "part", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, {MEASURES}")


def failures(docs: DataFrame, filters: dict[str, str] = FILTERS, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many of the rows of an id fail which filters, the bits in the order of the filters, the
    duplicate filter last."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text].alias("text"))
    mask = sum((F.when(F.expr(c), 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    rows = measured(rows).select("doc_id", "part", "digest", mask.alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left")
    known = known.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(filters))).alias("mask"), "n")
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask", "n"))


def mask_counts(failed: DataFrame, labels: DataFrame, bits: int) -> DataFrame:
    """(part, n, good, toxic), one row a part: arrays of the counts of documents, and of those with either label, by mask."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    rows = failed.where("doc_id is not null").join(own, "doc_id", "left").unionByName(failed.where("doc_id is null"), allowMissingColumns=True)
    one = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    cells = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # 2 ** bits at most
    by_mask = lambda c: F.expr(f"transform(sequence(0, {(1 << bits) - 1}), k -> coalesce(m[k].{c}, 0L))").alias(c)
    return cells.select("part", *(by_mask(c) for c in ("n", "good", "toxic")))


def survivors(counts: DataFrame, bits: int, *columns: str) -> DataFrame:
    """The arrays by mask become arrays by set of filters: how many of the part pass all filters of the set.

    One pass a bit adds to each set's count that of the set without the bit (the zeta transform); a set of filters passes
    what the complement holds.
    """

    def added(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, m: x + F.when(m.bitwiseAND(bit) > 0, F.get(F.col(c), m - bit)).otherwise(0))

    for b in range(bits):
        counts = counts.withColumns({c: added(c, 1 << b) for c in columns})
    return counts.withColumns({c: F.reverse(c) for c in columns})


def shapley(survive: str, bit: int, bits: int) -> Column:
    """Documents that the filter removes, summed over all orders: a set that comes before it does so in |S|! (n - 1 - |S|)! of them."""
    sets = [s for s in range(1 << bits) if not s >> bit & 1]
    weigh = lambda s: factorial(s.bit_count()) * factorial(bits - 1 - s.bit_count())
    return F.expr(" + ".join(f"({survive}[{s}] - {survive}[{s | 1 << bit}]) * {weigh(s)}L" for s in sets))


def orders(letters: str) -> Column:
    """Array of all steps (filter_order, step, bit, own = 2 ** bit, before) of all orders of the filters: n! * n, independent
    of the data. It is read from one literal, which the optimizer turns into a constant."""
    steps = []
    for order in permutations(letters):
        before = 0
        for k, x in enumerate(order):
            own = 1 << letters.index(x)
            steps.append({"filter_order": "".join(order), "step": k + 1, "bit": letters.index(x), "own": own, "before": before})
            before |= own
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,own:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    All filters are listed by one letter each; there are n! * n steps a part, so n is small.
    """
    letters = "".join(filters) + DUPLICATE
    bits = len(letters)
    known = survivors(mask_counts(failures(docs, filters, text, doc_id, part), labels, bits), bits, "n", "good", "toxic")
    known = stored(known.withColumn("shapley", F.array(*(shapley("n", b, bits) for b in range(bits)))))
    rows = known.select("*", F.explode(orders(letters)).alias("s")).select("part", "n", "good", "toxic", "shapley", "s.*")
    rows = rows.withColumns({"after": F.col("before") + F.col("own"), "others": F.lit((1 << bits) - 1) - F.col("own")})
    at = lambda c, s: F.get(F.col(c), F.col(s))
    lost = lambda c: at(c, "before") - at(c, "after")
    return rows.select(
        "part", "filter_order", "step", at("n", "after").alias("kept"), lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - at("n", "own") - lost("n")).alias("redundant"), (at("n", "others") - F.get("n", F.lit((1 << bits) - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", "bit").alias("shapley"),
    )


#: The same by walking all orders over the counts by mask.
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, doc_id IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
m AS MATERIALIZED (SELECT part, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask,
  count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
  CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
