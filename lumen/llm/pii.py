"""Operator 10: personal data. DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, found by patterns and checked. Java's matcher
gives no places, so a text is split at the matches, and the lengths of the pieces and of the matches between them add
up to the places (code points).

Method: information-theoretic sanitisation. A protected entity is the value of a base span. How strongly a term t
reveals an entity e is estimated from the corpus: the share of e's information that t gives,
log(p(t, e) / (p(t) p(e))) / -log p(e), over whole documents. Terms are runs of letters, in lower case, of any length.
Those that stand with an entity in at least `support` distinct texts and give `disclosure` of its information or more are,
wherever they stand in a text that holds the entity, spans of the kind "term"; sanitising generalises entities to their
kind and removes such terms. Counts cover all documents, nothing is capped.

An entity of fewer than `support` distinct texts can have no such term, so only the others' texts are spread into terms, each
distinct text once with the number of its copies. An entity, or a text, with a great share of all rows is dealt to many tasks.

Defined results: a null text is empty; every row gives one row, repeated and null ids too; exact copies of a text count
once for the support; an empty table gives an empty table. Of overlapping spans all are listed; sanitising replaces the
leftmost, and of those the longest, and drops what overlaps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.plans.durable import join_hot, stored

#: The four patterns. Loops that nothing follows are possessive, and a run is entered only at its start or where the
#: last match ended; both find the same matches without recursion or restarts in long runs.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What any match of a kind holds: texts without it are not searched.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
TERM = "\\p{L}+"
#: Candidate terms up to this many are broadcast.
BROADCAST_ROWS = 200_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Sum of the digits, every second from the right doubled (less 9 above 9), is a multiple of ten."""
    d = F.split(F.reverse(_digits(match)), "")
    d = F.filter(d, lambda x: x != "")
    total = F.aggregate(
        F.transform(d, lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").cast("decimal(38,0)") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(13, 19) & _luhn(match)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, value) of the valid matches, in order."""
    pattern = F.lit(PATTERNS[kind])
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    walked = F.aggregate(
        F.arrays_zip(pieces.alias("piece"), matches.alias("found")),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["found"]), F.lit(0))).cast("long").alias("at"),
            F.when(x["found"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(x["piece"])).cast("long").alias("start"),
                (a["at"] + F.length(x["piece"]) + F.length(x["found"])).cast("long").alias("end"), x["found"].alias("value"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    kept = F.transform(F.filter(walked, lambda s: _valid(kind, s["value"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"]))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    hint = text.rlike("[0-9]") if HINTS[kind] is None else text.contains(HINTS[kind])
    if kind == "ip":
        hint = text.rlike("[0-9]\\.[0-9]")
    return F.when(hint, kept).otherwise(none)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base`: array of (kind, start, end, value) by kind as listed, then start; nothing is dropped."""
    t = F.coalesce(docs[text], F.lit(""))
    return docs.withColumn("base", F.concat(*(_spans_of(k, t) for k in KINDS)))


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != ""))


def _by_value(texts: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """texts (copy, value, ...) joined with known by value; counts: (value, n_copies) of the values in question."""
    n = counts.select("value", F.col("n_copies").alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(texts, known, "value", n, total, F.col("copy"))


def disclosing(rows: DataFrame, one: DataFrame, disclosure: float = 0.5, support: int = 2) -> tuple[DataFrame, DataFrame]:
    """(value, term, share) of the terms that give `disclosure` of an entity's information or more, and (value, n_copies) of
    the entities in `support` distinct texts or more. `one` has each distinct text with base spans once: copy, w, text, base."""
    spread = one.select("copy", "w", F.explode(F.array_distinct("base.value")).alias("value"))
    values = stored(spread.groupBy("value").agg(F.sum("w").alias("n_value"), F.count("*").alias("n_copies")).where(F.col("n_copies") >= support))
    texts = one.select("copy", "w", "text", F.explode(F.array_distinct("base.value")).alias("value"))
    with_terms = _by_value(texts, values.select("value"), values).select("value", "w", F.explode(_terms(F.col("text"))).alias("term"))
    pairs = stored(with_terms.groupBy("value", "term").agg(F.sum("w").alias("n_both"), F.count("*").alias("n_copies")).where(F.col("n_copies") >= support))
    candidates = stored(pairs.select("term").distinct())
    n_candidates = candidates.count()
    held = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    if n_candidates == 0:
        held = held.limit(0)
    elif n_candidates <= BROADCAST_ROWS:
        held = held.join(F.broadcast(candidates), "term", "left_semi")
    held = held.groupBy("term").agg(F.count("*").alias("n_term"))
    total = rows.agg(F.count("*").alias("n"))
    joined = pairs.join(held, "term").join(values.select("value", "n_value"), "value").crossJoin(F.broadcast(total))  # one row
    n, both = F.col("n").cast("double"), F.col("n_both")
    share = F.when(F.col("n_value") >= F.col("n"), F.lit(0.0)).otherwise(F.log(both * n / (F.col("n_term") * F.col("n_value"))) / F.log(n / F.col("n_value")))
    return stored(joined.select("value", "term", share.alias("share")).where(F.col("share") >= disclosure)), values


def occurrences(one: DataFrame, known: DataFrame, values: DataFrame) -> DataFrame:
    """(copy, terms): the places of the known terms (value, term) in every text (copy, text, base) that holds their entity,
    outside base spans, by start. Runs of letters are numbered and their lengths summed up in order, text by text."""
    entities = one.select("copy", F.explode(F.array_distinct("base.value")).alias("value"))
    wanted = _by_value(entities, known.select("value", "term"), values).select("copy", "term").distinct()
    texts = one.join(wanted.select("copy").distinct(), "copy", "left_semi")
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    runs = texts.select("copy", F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("k", "r")).where("r.word is not null")
    before = Window.partitionBy("copy").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("r.gap") + F.length("r.word")).over(before)
    runs = runs.select("copy", F.lower("r.word").alias("term"), (end - F.length("r.word")).alias("start"), end.alias("end"))
    span = F.struct(F.lit("term").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("term").alias("value"))
    lists = runs.join(wanted, ["copy", "term"], "left_semi").groupBy("copy").agg(F.array_sort(F.collect_list(span), lambda x, y: F.when(x["start"] < y["start"], -1).otherwise(1)).alias("terms"))
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return lists.join(one.select("copy", "base"), "copy").select("copy", free.alias("terms"))


def find(docs: DataFrame, text: str = "text", disclosure: float = 0.5, support: int = 2) -> DataFrame:
    """The rows with `spans`: array of (kind, start, end, value), base kinds as listed, then terms, each by start.

    Other columns stay, whatever their names; one named spans gives way. The rows are held in a durable table, since the
    spans of the corpus decide on each text.
    """
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "spans")]
    rest = F.struct(*(docs[c] for c in others)) if others else F.struct(F.lit(0))  # the text itself is kept once
    rows = docs.select(rest.alias("doc"), F.monotonically_increasing_id().alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = stored(base_spans(rows).withColumn("copy", F.xxhash64("text", F.reverse("text"))))
    one = stored(rows.where(F.size("base") > 0).groupBy("copy").agg(F.count("*").alias("w"), F.first("text").alias("text"), F.first("base").alias("base")))
    known, values = disclosing(rows, one, disclosure, support)
    terms = stored(occurrences(one, known, values))
    counts = one.join(terms.select("copy"), "copy", "left_semi").select("copy", F.col("w").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_hot(rows, terms, "copy", counts, total, F.col("row"), how="left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    found = found.withColumn("spans", F.concat("base", F.coalesce("terms", none)))
    return found.select(*(F.col("doc")[c].alias(c) for c in others), F.col("text").alias(text), "spans")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's label; removed terms leave their label too."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    walked = F.aggregate(
        order, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            (-s["back"]).alias("at"),
            F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), label[s["kind"]])).alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.concat_ws("", walked["out"]), F.substring(text, (walked["at"] + 1).cast("int"), F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows and columns of docs, whatever the names of the others, with their texts sanitised."""
    others = [c for c in docs.columns if c.lower() != text.lower()]
    packed = docs.select((F.struct(*(docs[c] for c in others)) if others else F.struct(F.lit(0))).alias("doc"), docs[text].alias("text"))
    found = find(packed, "text", **settings)
    clean = sanitised(F.col("text"), F.col("spans"))
    return found.select(*((clean if c.lower() == text.lower() else F.col("doc")[c]).alias(c) for c in docs.columns))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined) of every row."""
    found = find(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", **settings)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
