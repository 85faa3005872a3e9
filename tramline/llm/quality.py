"""Quality rules with thresholds read from mergeable quantile sketches.

Each document is measured once (vectorised over its bytes). The shares derived
from the measures go into log-bucketed histograms per language, source and
share: a quantile sketch of bounded relative error whose merge is the
addition of counts, so it comes out the same however the rows are partitioned.
Documents where a share is zero are counted apart, since a share that most
documents don't have at all says nothing about its spread.

Thresholds are Tukey's outer fences on the scale of the sketch, the logarithm:
a share may exceed its group's upper quartile by at most the ratio of the
quartiles to the third power. No fence holds a constant in units of a share.
Quartiles of a group are weighted with those of its language, and these with
those of everything, by n documents against ``PRIOR``, at every group size.
The fences meet the measures again in a join on language and source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, packed
from .textkernel import SPACE, U64, Words, flat, mix, slices, span_hashes

WINDOW = 8
#: Sketch: shares are counted in millionths; buckets grow by this factor.
GROWTH = 1.01
#: A parent's quartiles weigh as much as this many documents.
PRIOR = 50
#: Tukey's outer fence, in quartile ranges.
REACH = 3
#: Share -> whether there is a lower fence as well.
SHARES = {"symbols": False, "marks": False, "capitals": False, "dup_lines": False, "repeats": False, "word_length": True}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_lines"]


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _repeated(h: np.ndarray, doc: np.ndarray, later_only: bool) -> np.ndarray:
    """Which entries have an equal (document, hash) elsewhere, or an earlier one."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if not later_only:
        same[:-1] |= same[1:].copy()
    out = np.zeros(len(h), dtype=bool)
    out[order] = same
    return out


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a batch, by name."""
    words = Words(raw, off)
    out = {"n_words": words.count, "n_symbols": _per_doc(_SYMBOL[raw], off), "n_marks": _per_doc(_MARK[raw], off)}
    out["word_chars"] = _per_doc(((raw & 0xC0) != 0x80) & ~SPACE[raw], off)
    upper, lower = np.concatenate([[0], np.cumsum(_UPPER[raw])]), np.concatenate([[0], np.cumsum(_LOWER[raw])])
    shout = (upper[words.end] - upper[words.start] >= 2) & (lower[words.end] == lower[words.start])
    out["n_capitals"] = np.bincount(words.doc[shout], minlength=words.n_docs)

    # lines: cut at \n and at document ends
    cut = np.union1d(np.flatnonzero(raw == 10) + 1, off[1:])
    begin = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
    begin, cut = begin[cut > begin], cut[cut > begin]
    stop = cut - (raw[cut - 1] == 10) if len(cut) else cut
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[has_word], stop[has_word]
    line_doc = np.searchsorted(off, begin, side="right") - 1
    inside = np.zeros(len(raw) + 1, dtype=np.int64)
    inside[begin] += 1
    np.subtract.at(inside, stop, 1)
    hashes = span_hashes(raw[np.cumsum(inside[:-1]) > 0], stop - begin)
    out["n_lines"] = np.bincount(line_doc, minlength=words.n_docs)
    out["n_dup_lines"] = np.bincount(line_doc[_repeated(hashes, line_doc, True)], minlength=words.n_docs)

    # words inside a window that occurs twice
    n = len(words.hash)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        m = n - WINDOW + 1
        total = np.zeros(m, U64)
        for k in range(WINDOW):
            total += words.hash[k : k + m] * mix(np.array([k + 1], U64))[0]
        whole = words.doc[:m] == words.doc[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        hit = at[_repeated(mix(total[at]), words.doc[at], False)]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(covered[:-1]) > 0], minlength=words.n_docs)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            got = measure(*flat(part.column("text")))
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in rest] + [pa.array(got[m].astype(np.int64)) for m in MEASURES], names=rest + MEASURES
            )


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the measures of each row's whole text (null: no words)."""
    src = docs.select(*keep, F.col("text").cast("string"))
    schema = T.StructType([*src.drop("text").schema.fields, *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return src.mapInArrow(_measured, schema)


def _share(name: str) -> Column:
    part = {
        "symbols": "n_symbols",
        "marks": "n_marks",
        "capitals": "n_capitals",
        "repeats": "n_repeat_words",
        "word_length": "word_chars",
        "dup_lines": "n_dup_lines",
    }
    whole = "n_lines" if name == "dup_lines" else "n_words"
    return F.expr(f"{part[name]} * 1000000 div greatest({whole}, 1)")


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, share, bucket, n``: mergeable sketches of the documents that pass the base rules; bucket -1 holds zeros."""
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), _share(s).alias("v")) for s in SHARES])
    rows = measured.where("NOT base_failed").select("lang", "source", F.inline(pairs))
    bucket = F.when(F.col("v") <= 0, -1).otherwise(F.floor(F.log("v") / float(np.log(GROWTH)))).cast("int")
    return rows.groupBy("lang", "source", "share", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, share, n, q1, q3`` of sketches merged by ``keys``: documents above zero, and the buckets of their quartiles (null without any)."""
    merged = sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col("bucket") >= 0, F.col("n")).otherwise(F.lit(0)))
    w = Window.partitionBy(*keys, "share")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    above = lambda part: F.min(F.when((F.col("n") > 0) & (F.col("upto") * 4 >= F.col("total") * part), F.col("bucket"))).cast("double")
    return ranked.groupBy(*keys, "share").agg(F.max("total").alias("n"), above(1).alias("q1"), above(3).alias("q3"))


def _weighted(n: Column, own: Column, parent: Column) -> Column:
    """A group's quartile drawn to its parent's; the parent's alone where the group has none."""
    return F.when(own.isNull(), parent).when(parent.isNull(), own).otherwise((n * own + PRIOR * parent) / (n + PRIOR))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and a map of share -> (low, high) in millionths, one row per pair seen; null where no document is above zero."""
    own, by_lang, all_ = quantiles(sketch, ["lang", "source"]).alias("o"), quantiles(sketch, ["lang"]).alias("l"), quantiles(sketch, []).alias("a")
    got = own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.share") == F.col("l.share"))).join(all_, F.col("o.share") == F.col("a.share"))
    q = {}
    for c in ("q1", "q3"):
        lang = _weighted(F.col("l.n"), F.col(f"l.{c}"), F.col(f"a.{c}"))
        q[c] = _weighted(F.col("o.n"), F.col(f"o.{c}"), lang)
    got = got.select(F.col("o.lang"), F.col("o.source"), F.col("o.share"), q["q1"].alias("q1"), q["q3"].alias("q3"))
    lower = F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair])
    spread = REACH * (F.col("q3") - F.col("q1"))
    # a value of bucket b lies below GROWTH to the power b + 1
    low = F.when(lower[F.col("share")], F.pow(F.lit(GROWTH), F.col("q1") - spread)).otherwise(F.when(F.col("q1").isNotNull(), F.lit(-1.0)))
    fence = F.struct(low.alias("low"), F.pow(F.lit(GROWTH), F.col("q3") + 1 + spread).alias("high"))
    return got.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("share", fence.alias("fence")))).alias("fences"))


_BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _inside(fences: Column) -> Column:
    """Whether every share lies within its fences; a share without fences does."""
    fine = F.lit(True)
    for s in SHARES:
        fine = fine & F.coalesce(_share(s).between(fences[s]["low"], fences[s]["high"]), F.lit(True))
    return fine


def verdicts(docs: DataFrame, *keep: str) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row; ``keep`` names further columns.

    Null or blank texts have no words and fail the base rule. Null language or
    source is a group of its own. Repeated rows each count and each get a row.
    Equal values are on the same side of a fence. An empty table gives an empty
    result. A long text is measured whole, alone in its slice. A column in
    ``keep`` that has the name of a measure, base_failed or kept gives way to it.
    """
    own = [c for c in keep if c not in ("lang", "source", "text", "base_failed", "kept", *MEASURES)]
    src = docs.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    measured = materialize(measures(src, *own, "lang", "source").withColumn("base_failed", F.expr(_BASE_FAILED)), "measured")
    sketch = materialize(sketches(measured), "sketches")
    limits = materialize(thresholds(sketch), "limits")
    discard(sketch)
    m, t = measured.alias("m"), limits.alias("t")
    joined = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    kept = F.when(F.col("base_failed"), False).otherwise(_inside(F.col("t.fences")))
    return joined.select(*[F.col(f"m.{c}") for c in measured.columns], kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, columns unchanged whatever their names; rows without doc_id are judged like others.

    The verdict is looked up by language, source and the row's own measures:
    the thresholds join the documents and the texts are measured again, which
    costs less than a shuffle of all texts by doc_id and needs no row key.
    """
    lang, source, text = (F.col(c).cast("string") for c in ("lang", "source", "text"))
    slim = measures(docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")), "lang", "source").withColumn("base_failed", F.expr(_BASE_FAILED))
    sketch = materialize(sketches(slim), "sketches")
    limits = materialize(thresholds(sketch), "limits")
    discard(sketch)
    # measured beside the whole row: the text passes through the kernel untouched
    m = measures(packed(docs, text=text, lang=lang, source=source), "row", "lang", "source").where(f"NOT ({_BASE_FAILED})").alias("m")
    t = limits.alias("t")
    joined = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    return joined.where(_inside(F.col("t.fences"))).select("m.row.*")
