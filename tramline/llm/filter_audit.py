"""How document filters interact, for every order in which they may be applied.

Each document fails a set of the five filters. A step of an order, its filter
after those before it, is an edge of the lattice of filter sets: 80 edges of
(already applied subset, next filter) carry all that 600 steps of 120 orders
need. Documents are counted per part, failure set and label first, those counts
contribute to every edge, and an order's steps are a path of edges.

The filters on whole texts (null is empty; words are maximal runs of characters
other than space and 0x09-0x0D, case counts): A under 100 words; B distinct
words under 80 % of words; C capitals A-Z over 10 % of the code points; D holds
any of ``#$%&*|``; E equals the text of a smaller doc_id.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BIT = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
ORDERS = ["".join(p) for p in permutations(BIT)]
EDGES = [(applied, bit) for applied in range(32) for bit in BIT.values() if not applied & bit]
_BLANKS = " \t\n\x0b\x0c\r"


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest`` of the text, and ``mask``, the filters A to D that it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # a text of blanks alone gives one empty word
    src = src.withColumn("words", F.split(F.btrim("text", F.lit(_BLANKS)), r"[\x20\x09-\x0D]+"))
    n = F.size("words") - (F.size("words") == 1).cast("int") * (F.element_at("words", 1) == "").cast("int")
    src = src.withColumns({"n": n, "n_distinct": F.size(F.array_distinct("words")), "capitals": F.length(F.regexp_replace("text", "[^A-Z]+", ""))})
    fails = {"A": F.col("n") < 100, "B": (F.col("n") > 0) & (100 * F.col("n_distinct").cast("long") < 80 * F.col("n").cast("long")),
             "C": 100 * F.col("capitals").cast("long") > 10 * F.length("text").cast("long"), "D": F.col("text").rlike("[#$%&*|]")}
    return src.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(f.cast("int") * BIT[k] for k, f in fails.items()).alias("mask"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by all filters that they fail.

    A text's first document is the one with the least doc_id; all others fail E,
    so their number is what remains of the total. Only narrow rows move: by
    doc_id to the labels, then by digest, pre-aggregated to one row a text and
    task, so a text that a third of all documents share is no large group.
    """
    rows = measure(docs)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    one = ["doc_id", "digest", "mask", "good", "toxic"]
    facts = materialize(named.groupBy(*one, "part").agg(F.count("*").alias("n")).groupBy(*one).agg(F.collect_list(F.struct("part", "n")).alias("parts")), "audit")
    first = facts.groupBy("digest").agg(F.min(F.struct("doc_id", "mask", "good", "toxic", "parts")).alias("f")).select("f.mask", "f.good", "f.toxic", F.inline("f.parts"))
    every = facts.select("mask", "good", "toxic", F.inline("parts"))
    # rows without doc_id have no smaller one and are none
    lost = rows.where(F.col("doc_id").isNull()).select("mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "part", F.lit(1).cast("long").alias("n"))
    again = F.col("mask").bitwiseOR(F.lit(BIT["E"])).alias("mask")
    rest = ["good", "toxic", "part"]
    parts = [every.select(again, *rest, "n"), first.select(again, *rest, (-F.col("n")).alias("n")), first.select("mask", *rest, "n"), lost.select("mask", *rest, "n")]
    total = None
    for p in parts:
        p = p.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        total = p if total is None else total.unionByName(p)
    return total.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counts: DataFrame) -> DataFrame:
    """What the filter ``bit`` does after those of ``applied``, for all 80 edges of each part."""
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(b).alias("bit")) for a, b in EDGES]))
    rows = counts.withColumn("edge", edge).select("part", "mask", "good", "toxic", "n", "edge.*")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("applied")) != 0

    def number(which: Column, name: str) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)

    return rows.groupBy("part", "applied", "bit").agg(
        number(~hit & ~earlier, "kept"), number(hit & ~earlier, "removed"), number(hit & earlier, "redundant"), number(F.col("mask") == F.col("bit"), "unique_fails"),
        number(hit & ~earlier & (F.col("good") == 1), "good_lost"), number(hit & ~earlier & (F.col("toxic") == 1), "toxic_lost"),
    )


def order_steps(edges: DataFrame) -> DataFrame:
    """Every step of every order as the edge it is, with its filter's ``shapley``: all that it removes over the 120 orders."""
    orders = edges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    place = {b: F.locate(k, F.col("filter_order")) for k, b in BIT.items()}
    steps = orders.select(
        "filter_order", "step",
        sum(F.when(at < F.col("step"), b).otherwise(0) for b, at in place.items()).alias("applied"), sum(F.when(at == F.col("step"), b).otherwise(0) for b, at in place.items()).alias("bit"),
    )
    # 600 rows, whatever the input
    out = edges.join(F.broadcast(steps), ["applied", "bit"])
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang; null is the empty string), order and step, zeros included.

    Needs ``doc_id, text, lang`` and of ``labels`` ``doc_id, quality, toxic``;
    other columns are ignored. A null or empty text fails A alone, besides E.
    Rows of one doc_id with one text fail E only by a smaller doc_id; a null
    doc_id neither fails it nor makes others fail. A document is good or
    toxic if any of its label rows says so; null labels say nothing. An empty
    table gives an empty result.
    """
    return order_steps(lattice_edges(failure_counts(docs, labels)))


#: The same in SQL.
ORACLE = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(w.doc_id > first, false) THEN 16 ELSE 0 END AS mask
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    f AS (SELECT letter, bit FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS applied FROM o, (SELECT unnest(range(1, 6)) AS step)),
    g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
    e AS (SELECT part, filter_order, step, bit,
            coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
            coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0 AND toxic), 0) AS toxic_lost
          FROM g, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM e
"""
