"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Weights are integers q (by default thousandths of the whole, one at least)
with sum Q. Block j = 0, 1, ... of a source may not start before slot
floor(j Q / q) and must be placed by slot ceil((j + 1) Q / q). Earliest
deadline first over these windows (ties: the smaller weight, then the source's
name) fills every slot and keeps each source less than one block from its
share of every prefix. After Q slots each source has had exactly q blocks, so
the schedule repeats: one period is worked out and every block finds its slot
by integer division and a join with that period's table.

The period is a fold over Q slots after the weights' common divisor is taken
out. Sources of equal weight take turns in the order of their names, so the
fold's state is one counter per distinct weight (at most the square root of
2 Q), and it works in chunks, so its cost grows with Q. Q above ``LIMIT`` is
an error, never cut.

Ranks inside a source come from key ranges of about ``ROWS`` rows, as many as
the measured number of rows asks for: rows are numbered inside a range and
shifted by the counts of the ranges before it, so a source that holds most
rows is spread over many groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, packed

BLOCK, SCALE, PRIME, ROWS = 16, 1000, 1000003, 2000
#: Slots of a period at most, and slots that one step of the fold works out.
LIMIT, CHUNK = 1_000_000, 256

#: One step: among the weights with a released block left, the one whose block is due first.
_PICK = """
    array_min(transform(
        filter(sequence(0, size(w) - 1), i -> st.done[i] < w[i].m * w[i].q AND (st.done[i] div w[i].m) * total div w[i].q <= t),
        i -> struct(((st.done[i] div w[i].m + 1L) * total + w[i].q - 1L) div w[i].q AS due, i AS i))).i
"""
_STEP = f"""
    aggregate(array({_PICK}), st, (s, p) -> struct(transform(s.done, (x, i) -> if(i = p, x + 1L, x)) AS done, concat(s.picks, array(p)) AS picks))
"""
_FOLD = f"""
    aggregate(sequence(0L, (total - 1L) div {CHUNK}L), struct(transform(w, x -> 0L) AS done, CAST(array() AS array<array<int>>) AS all),
        (o, c) -> aggregate(sequence(c * {CHUNK}L, least(total, (c + 1L) * {CHUNK}L) - 1L), struct(o.done AS done, CAST(array() AS array<int>) AS picks),
            (st, t) -> {_STEP}, st -> struct(st.done AS done, concat(o.all, array(st.picks)) AS all)),
        o -> flatten(o.all))
"""
_DIVISOR = "aggregate(w, 0L, (a, x) -> aggregate(sequence(1, 92), struct(a AS a, x.q AS b), (s, k) -> if(s.b = 0L, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a))"


def period(target: DataFrame) -> DataFrame:
    """``src, q, total, turn, slot``: the slot of each block of one period; q and total without their common divisor."""
    target = target.select("src", F.col("q").cast("long").alias("q"))
    members = target.withColumn("member", F.row_number().over(Window.partitionBy("q").orderBy("src")) - 1)
    # one row holds the distinct weights
    one = target.groupBy("q").agg(F.count("*").alias("m")).agg(F.sort_array(F.collect_list(F.struct("q", "m"))).alias("w")).where("size(w) > 0")
    one = one.withColumn("g", F.expr(_DIVISOR)).withColumn("total", F.expr("aggregate(w, 0L, (a, x) -> a + x.q * x.m) div g"))
    large = F.raise_error(F.concat(F.lit(f"the weights need a period beyond {LIMIT} slots: "), F.col("total").cast("string")))
    one = one.select("g", F.when(F.col("total") > LIMIT, large.cast("long")).otherwise(F.col("total")).alias("total"), F.expr("transform(w, x -> struct(x.q div g AS q, x.m AS m))").alias("w"))
    picks = one.select("g", "total", "w", F.posexplode(F.expr(_FOLD)).alias("slot", "k"))
    picks = picks.select("g", "total", F.expr("w[k].q").alias("q"), F.expr("w[k].m").alias("m"), F.col("slot").cast("long"))
    turns = picks.withColumn("c", F.row_number().over(Window.partitionBy("q").orderBy("slot")).cast("long") - 1)
    turns = turns.select((F.col("q") * F.col("g")).alias("whole"), F.col("q").alias("q1"), "total", F.expr("c div m").alias("turn"), F.expr("c % m").alias("member"), "slot")
    return turns.join(members, (turns.whole == members.q) & (turns.member == members.member)).select("src", F.col("q1").alias("q"), "total", "turn", "slot")


def mix(docs: DataFrame, target: DataFrame | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``block``, ``place``, ``slot``, ``release``, ``deadline`` (long) and ``in_mix``; read it by (slot, place).

    ``target`` has src and q (positive integers); default: ``weights_of``. Needs
    doc_id and the source column. Rows of a source without a target are in no
    slot: their schedule columns are null and ``in_mix`` is false. Documents
    fill the blocks of their source in a pseudo-random order of doc_id; rows
    without doc_id are placed by a hash of the whole row; rows with equal
    doc_id are neighbours, in the order of that hash. A null source counts as the empty one. ``in_mix``
    marks the slots before the first one that a source can't fill any more; up
    to there every prefix is within one block of the target, and later slots
    go on without the exhausted sources. An empty table gives an empty result.
    Texts pass through whole. Columns with the names above are replaced; all
    others keep their names and values.
    """
    new = ["block", "place", "slot", "release", "deadline", "in_mix"]
    docs = docs.drop(*new)
    rows = packed(docs, src=F.coalesce(F.col(source).cast("string"), F.lit("")), id=F.col("doc_id").cast("long"))
    scattered = F.expr(f"pmod(pmod(coalesce(id, -1L), {PRIME}) * 7919L + 104729L, {PRIME}L)")
    simple = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    loose = F.pmod(F.xxhash64(*[F.col("row").getField(c) for c in simple]), F.lit(PRIME).cast("long"))
    keyed = rows.withColumn("key", F.when(F.col("id").isNull(), loose).otherwise(scattered))
    sizes = materialize(keyed.groupBy("src").agg(F.count("*").alias("n")), "sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = min(PRIME, max(1, -(-n // ROWS)))
    keyed = keyed.withColumn("range", F.expr(f"key * {ranges} div {PRIME}"))
    counts = keyed.groupBy("src", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("src", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    slots = materialize(period(weights_of(sizes) if target is None else target), "period")
    per_source = materialize(slots.select("src", "q", "total").distinct(), "weights")
    used = sizes.select("src", F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    gone = per_source.join(used, "src", "left").select("src", "q", "total", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"))
    ends = gone.withColumn("turn", F.expr("blocks % q")).join(slots.select("src", "turn", "slot"), ["src", "turn"])
    # one row
    horizon = materialize(ends.agg(F.min(F.expr("blocks div q * total + slot")).alias("horizon")), "horizon")
    discard(sizes)
    # rows of one doc_id go by a hash of the whole row, so only equal rows change places
    order = Window.partitionBy("src", "range").orderBy("key", F.col("id").asc_nulls_first(), F.xxhash64(*[F.col("row").getField(c) for c in simple]))
    ranked = keyed.withColumn("nth", F.row_number().over(order)).join(offsets, ["src", "range"])
    ranked = ranked.withColumn("at", F.col("nth") - 1 + F.col("before")).withColumns({"block": F.expr(f"at div {block}"), "place": F.expr(f"at % {block}")})
    ranked = ranked.join(per_source, "src", "left").withColumn("turn", F.expr("block % q"))
    ranked = ranked.join(slots.select("src", "turn", F.col("slot").alias("first")), ["src", "turn"], "left").join(F.broadcast(horizon))
    start = "block div q * total"
    cols = {
        "block": F.expr("CASE WHEN q IS NOT NULL THEN block END"),
        "place": F.expr("CASE WHEN q IS NOT NULL THEN place END").cast("long"),
        "slot": F.expr(f"{start} + first"),
        "release": F.expr(f"{start} + turn * total div q"),
        "deadline": F.expr(f"{start} + ((turn + 1) * total + q - 1) div q"),
        "in_mix": F.expr(f"coalesce({start} + first < horizon, false)"),
    }
    return ranked.select("row.*", *[cols[c].alias(c) for c in new])


def weights_of(sizes: DataFrame) -> DataFrame:
    """``src, q`` from ``src, n``: each source by the square root of its size, in thousandths, one at least."""
    roots = sizes.select("src", F.floor(F.sqrt("n") * 1000).cast("long").alias("r"))
    return roots.join(F.broadcast(roots.agg(F.sum("r").alias("total")))).select("src", F.expr(f"greatest(1L, {SCALE} * r div total)").alias("q"))
