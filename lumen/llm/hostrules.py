"""Operator 6: quality rules judged by host. DataFrame functions only.

Every document is measured once; rule failures are summed by host; each host's rates are shrunk towards the mean of all
hosts by a beta prior fitted to the hosts' own rates (method of moments); a host fails if a shrunk rate passes the
limit, and its verdict is joined back to its documents. Sums by host are pre-aggregated in every task, so a host with a
third of all rows is no hot spot; the join back is on one row a host and salt, so such a host's documents are dealt to
SALTS tasks.

Defined results: a null text has no words (and so fails the base rules); a null host has no verdict and its documents
stay if they pass the base rules; every row gives one row, repeated and null ids too; an empty table gives an empty
table. Counts of words are whole texts', of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.plans.durable import stored

SPACES = "[\\x20\\x09-\\x0D]+"
#: A host's documents are dealt to so many tasks when its verdict is joined back; verdicts, one a host, are repeated as often.
SALTS = 32
#: Bits for the place of a window beside its hash.
PLACE_BITS = 24
#: A document fails a rule; the first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
}


def _near_equal(sorted_col: str, bits: int) -> Column:
    """Places of the packed values that share all but their lower bits with a neighbour in sorted order."""
    s = F.col(sorted_col)

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(F.get(s, k)), bits) == 0, F.lit(False))

    low = F.lit((1 << bits) - 1).cast("long")
    return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.bitwiseAND(low))


def _equal(sorted_col: str) -> Column:
    """Places of the (hash, place) pairs that share their hash with a neighbour in sorted order."""
    s = F.col(sorted_col)
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["k"])


def measure(docs: DataFrame, text: str = "text", bits: int = PLACE_BITS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to the rows; drops nothing.

    Windows of three words are compared by 64-bit hashes: sorted once by their lower and once by their upper 64 - bits
    (packed with the place in the text), and only what is found twice in both orders counts. Texts of more than 2 ** bits
    windows, whose places do not fit, are sorted as pairs of hash and place, with the same result.
    """
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.withColumn("_t", t)
    rows = rows.withColumn("_w", F.filter(F.split("_t", SPACES), lambda w: w != ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    w = F.col("_w")
    hashes = F.transform(F.when(F.size(w) >= 3, F.slice(w, 1, F.size(w) - 2)).otherwise(F.array().cast("array<string>")), lambda x, k: F.xxhash64(x, F.get(w, k + 1), F.get(w, k + 2)))
    rows = rows.withColumn("_h", hashes)
    low, fits = F.lit((1 << bits) - 1).cast("long"), F.size("_h") <= 1 << bits
    rows = rows.withColumn("_a", F.when(fits, F.sort_array(F.transform("_h", lambda h, k: F.shiftleft(h, bits).bitwiseOR(k.cast("long"))))))
    rows = rows.withColumn("_b", F.when(fits, F.sort_array(F.transform("_h", lambda h, k: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(k.cast("long"))))))
    rows = rows.withColumn("_c", F.when(~fits, F.sort_array(F.transform("_h", lambda h, k: F.struct(h.alias("h"), k.cast("long").alias("k"))))))
    rows = rows.withColumn("_p", F.sort_array(F.coalesce(F.array_intersect(_near_equal("_a", bits), _near_equal("_b", bits)), _equal("_c"))))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), x - F.coalesce(F.get(p, k - 1), F.lit(-3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, host: str = "host", limit: float = 0.5, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n_docs, a shrunk rate for each rule, host_failed), one row for each host that is not null.

    Prior of a rule: mean m and population variance v of the hosts' rates give a strength k = m (1 - m) / v - 1, at
    least 0; a host's shrunk rate is (failures + m k) / (documents + k). Without variance every host has the mean.
    """
    counts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *(F.sum(F.expr(f"cast({rule} as long)")).alias(f"f_{name}") for name, rule in rules.items())
    )
    prior = counts.agg(*(x for name in rules for x in (F.avg(F.col(f"f_{name}") / F.col("n_docs")).alias(f"m_{name}"), F.var_pop(F.col(f"f_{name}") / F.col("n_docs")).alias(f"v_{name}"))))
    joined = counts.crossJoin(F.broadcast(prior))  # one row
    rates = {}
    for name in rules:
        f, m, v = F.col(f"f_{name}"), F.col(f"m_{name}"), F.col(f"v_{name}")
        k = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
        rates[f"rate_{name}"] = F.when(v > 0, (f + m * k) / (F.col("n_docs") + k)).otherwise(m)
    return joined.select("host", "n_docs", *(r.alias(n) for n, r in rates.items())).withColumn("host_failed", F.greatest(*(F.col(n) for n in rates), F.lit(0.0)) > limit)


def judge(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", limit: float = 0.5) -> DataFrame:
    """Every document's measures, whether it fails the base rules, its host's verdict, and whether it is kept."""
    rows = stored(measure(docs.select(docs[doc_id].alias("doc_id"), docs[host].alias("host"), docs[text].alias("text"))).drop("text"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
    failing = host_verdicts(rows, "host", limit).where("host_failed").select("host", "host_failed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    base = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    return rows.join(failing, ["host", "salt"], "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"), (~base & F.col("host_failed").isNull()).alias("kept"),
    )


def judge_sql(limit: float = 0.5) -> str:
    """The same in DuckDB's SQL, over documents with different ids and their sources as hosts."""
    moments = ", ".join(f"avg(f_{n} / n) AS m_{n}, var_pop(f_{n} / n) AS v_{n}" for n in RULES)
    rates = ", ".join(
        f"CASE WHEN v_{n} > 0 THEN (f_{n} + m_{n} * greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, 0.0)) / (n + greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, 0.0)) ELSE m_{n} END" for n in RULES
    )
    fails = ", ".join(f"CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS DOUBLE) AS f_{n}" for n, rule in RULES.items())
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
y AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM y) GROUP BY 1),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*) AS n, {fails} FROM m WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT {moments} FROM h),
v AS (SELECT source FROM h, p WHERE greatest({rates}, 0.0) > {limit})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES['short']} OR {RULES['repeats']}) AS base_failed,
  NOT ({RULES['short']} OR {RULES['repeats']}) AND (source IS NULL OR source NOT IN (SELECT source FROM v)) AS kept FROM m
"""
