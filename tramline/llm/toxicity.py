"""Toxic passages: maximum-scoring segments over token log-odds.

Learning. From at most ``SAMPLE`` labelled documents (distinct texts, chosen
by a hash of the text) each feature - a word, and its leading 4 to 8 bytes
when longer - gets the log-odds of occurring in toxic against other documents
under an informative Dirichlet prior. Features whose log-odds less
``MARGIN`` deviations reach ``LEAST_GAIN`` form the lexicon; all of them, and as they come
from the sample, their number is bounded with it.

Scoring. A word scores its best feature's log-odds, any other word a constant
loss. One linear scan finds all maximal scoring segments of the whole text
(every segment that can't be improved by growing or shrinking). Segment scores
become E-values by the extreme-value law of segment scores, whose scale is the
root of the moment equation of single words' scores in documents that aren't
toxic (a word counts once per document, so one that repeats a word without end
doesn't set the law for all) and whose location is fitted on their best segments. Segments with E below ``SIGNIFICANT`` are the
toxic passages; the surprise of all of them is the document's evidence, which
a logistic curve fitted on the sample maps to a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .textkernel import U64, Cores, flat, mix, slices, span_hashes

#: Labelled documents that are learnt from, at most: the documented bound of what is gathered.
SAMPLE = 20_000
#: Files of a table of the sample, at most, however many partitions a shuffle has: each file that is written starts
#: helper processes beside the executor (chmod, where Hadoop has no native library), which count with its memory until they run.
FILES = 16
PREFIXES = (4, 5, 6, 7, 8)
#: The prior weighs as much as this share of the sample.
PRIOR, MARGIN, LEAST_GAIN, LOSS, SIGNIFICANT = 0.025, 1.5, 2.0, -0.4, 0.5


def features(cores: Cores, n_docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, word index) for whole words and each prefix length."""
    out = [(cores.hash, np.arange(len(cores.hash)))]
    length = cores.end - cores.begin
    for p in PREFIXES:
        at = np.flatnonzero(length > p)
        if len(at):
            data = cores.low[(cores.begin[at][:, None] + np.arange(p)).ravel()]
            out.append((mix(span_hashes(data, np.full(len(at), p)) + U64(p)), at))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and class, summed over each slice."""
    for batch in batches:
        for part in slices(batch):
            cores = Cores(*flat(part.column("text")))
            toxic = part.column("toxic").to_numpy()
            fs = features(cores, part.num_rows)
            h = np.concatenate([f for f, _ in fs])
            d = np.concatenate([cores.doc[at] for _, at in fs])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, t = h[new], toxic[d[new]]
            values, back = np.unique(h, return_inverse=True)
            yes = np.bincount(back, weights=t, minlength=len(values)).astype(np.int64)
            no = np.bincount(back, weights=1 - t, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(yes), pa.array(no)], names=["feature", "yes", "no"])


def maximal_segments(place: np.ndarray, gain: np.ndarray, loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), left to right.

    ``place`` are the word positions that score ``gain`` > 0; all other words
    score ``loss`` < 0. Each new positive word is merged leftwards with the
    candidates whose prefix sum lies below its own, as long as that pays.
    """
    kept: list[list[float]] = []  # start, end, prefix sum before, prefix sum after
    total, at = 0.0, 0
    for p, g in zip(place.tolist(), gain.tolist(), strict=True):
        before = total + loss * (p - at)
        total, at = before + g, p + 1
        cand = [p, p, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= cand[2]:
                j = int(kept[j][4])
            if j < 0 or kept[j][3] >= cand[3]:
                kept.append([*cand, j])
                break
            cand = [kept[j][0], cand[1], kept[j][2], cand[3]]
            del kept[j:]
    return [(int(s), int(e), b - a) for s, e, a, b, _ in kept]


class Lexicon:
    def __init__(self, hashes: np.ndarray, gains: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.gain = hashes[order], gains[order]

    def word_gains(self, cores: Cores, n_docs: int) -> np.ndarray:
        """Each word's best log-odds, 0 where no feature is known."""
        out = np.zeros(len(cores.hash))
        if len(self.hash):
            for h, at in features(cores, n_docs):
                i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                hit = self.hash[i] == h
                np.maximum.at(out, at[hit], self.gain[i[hit]])
        return out

    def segments(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]], dict[int, np.ndarray]]:
        """Words per document; of those with a gain the maximal segments, and the gains of their distinct words."""
        cores = Cores(raw, off)
        gain = self.word_gains(cores, len(off) - 1)
        hot = np.flatnonzero(gain > 0)
        doc = cores.doc[hot]
        out, gains = {}, {}
        for d in np.unique(doc).tolist():
            mine = hot[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
            out[d] = maximal_segments(mine - cores.first[d], gain[mine])
            gains[d] = gain[mine[np.unique(cores.hash[mine], return_index=True)[1]]]
        return np.diff(cores.first), out, gains


class Model:
    """Lexicon, extreme-value law (scale, location) and the curve from evidence to score."""

    def __init__(self, lexicon: Lexicon, scale: float, location: float, slope: float, offset: float):
        self.lexicon, self.scale, self.location, self.slope, self.offset = lexicon, scale, location, slope, offset

    def e_value(self, score: float, n_words: int) -> float:
        return float(self.location * max(1, n_words) * np.exp(-self.scale * score))

    def evidence(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        """Surprise of the significant segments together, on a scale that flattens out."""
        return float(np.log1p(sum(max(0.0, -np.log(max(self.e_value(s, n_words), 1e-300)) - np.log(1 / SIGNIFICANT)) for _, _, s in segments)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * evidence + self.offset)))


def _gain(n_yes: float, n_no: float) -> Column:
    """Log-odds under a Dirichlet prior proportional to overall frequency, less MARGIN deviations, as a column over yes and no."""
    n, mass = n_yes + n_no, PRIOR * (n_yes + n_no)
    prior = PRIOR * (F.col("yes") + F.col("no"))
    a, b = F.col("yes") + prior * n_yes / n, F.col("no") + prior * n_no / n
    odds = F.log(a / F.greatest(n_yes + mass - a, F.lit(1e-9))) - F.log(b / F.greatest(n_no + mass - b, F.lit(1e-9)))
    return odds - MARGIN * F.sqrt(1 / a + 1 / b)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``size`` labelled documents outside the held-out fold, distinct texts."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    ids = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    return chosen.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").coalesce(FILES)


def moment_root(hits: np.ndarray, words: float, times: np.ndarray | float = 1.0) -> float:
    """The scale at which scores of ``hits`` (each ``times``), and LOSS for the rest of ``words``, have an exponential moment of one."""
    times = np.broadcast_to(times, hits.shape)
    lo, hi = 0.0, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        moment = (times * np.exp(np.minimum(mid * hits, 600))).sum() / words + (1 - times.sum() / words) * np.exp(mid * LOSS)
        lo, hi = (mid, hi) if moment < 1 else (lo, mid)
    return max(lo, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learn lexicon and calibration; without labels of both kinds, or without texts, every text scores 0."""
    train = materialize(sample(docs, labels, size), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_yes, n_no = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n_yes or not n_no:
        return Model(Lexicon(np.zeros(0, U64), np.zeros(0)), 1.0, 1.0, 0.0, -50.0)
    counts = train.mapInArrow(_count, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # the gain test runs where the counts are; what passes it is the lexicon
    top = counts.withColumn("gain", _gain(n_yes, n_no)).where(F.col("gain") >= LEAST_GAIN).select("feature", "gain").toPandas()
    lexicon = Lexicon(top["feature"].to_numpy().astype(np.int64).view(np.uint64), top["gain"].to_numpy(float))
    shared = train.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, found, gains = shared.value.segments(*flat(part.column("text")))
                scores = [[s for _, _, s in found.get(d, ())] for d in range(part.num_rows)]
                single = [gains.get(d, ()) for d in range(part.num_rows)]
                best = [max(x, default=0.0) for x in scores]
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(words.astype(np.int64)), pa.array(best, pa.float64()), pa.array(scores, kind), pa.array(single, kind)], names=["toxic", "words", "best", "scores", "gains"])

    seen = materialize(train.mapInArrow(scan, "toxic int, words long, best double, scores array<double>, gains array<double>").coalesce(FILES), "toxic-scan")
    calm = seen.where("toxic = 0")
    # score distribution of other text: mostly the loss, some hits (as many rows as the lexicon has gains), and one unseen hit of the largest gain
    hits = calm.select(F.explode("gains").alias("gain")).groupBy("gain").agg(F.count("*").alias("n")).toPandas()
    gains, times = np.append(hits["gain"].to_numpy(float), lexicon.gain.max(initial=1.0)), np.append(hits["n"].to_numpy(float), 1.0)
    total = calm.agg(F.sum("words").alias("words"), F.count("*").alias("docs")).first()
    scale = moment_root(gains, float(total["words"]) + 1, times)
    law = calm.agg(F.sum(F.greatest("words", F.lit(1)) * F.exp(-scale * F.col("best"))).alias("z")).first()["z"]
    model = Model(lexicon, scale, float(total["docs"]) / float(law), 1.0, 0.0)
    known = train.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, scores = batch.column("words").to_pylist(), batch.column("scores").to_pylist()
            got = [known.value.evidence([(0, 0, s) for s in sc], w) for sc, w in zip(scores, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.float64())], names=["toxic", "evidence"])

    # two numbers per document of the sample
    pairs = seen.select("toxic", "words", "scores").mapInArrow(weigh, "toxic int, evidence double").toPandas()
    discard(train, seen)
    x, y = pairs["evidence"].to_numpy(float), pairs["toxic"].to_numpy(float)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.1 * w
        hess = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 0.1 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.slope, model.offset = float(max(w[0], 1e-6)), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_segments, passages`` for every row.

    ``passages`` are the significant segments (first word, last word, score,
    e_value); words are counted without those of punctuation alone. Null and
    empty texts have none, an empty table gives an empty result. Repeated rows
    each get a row; a null doc_id is not held out. Of segments with equal
    scores both are kept. A long text is scanned whole, alone in its slice.
    Only the text enters the score; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                words, found, _ = m.lexicon.segments(*flat(part.column("text")))
                n = part.num_rows
                evidence, passages = np.zeros(n), [[] for _ in range(n)]
                for d, segs in found.items():
                    w = int(words[d])
                    evidence[d] = m.evidence(segs, w)
                    for a, b, s in segs:
                        e = m.e_value(s, w)
                        if e < SIGNIFICANT:
                            passages[d].append({"first": a, "last": b, "score": s, "e_value": e})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(evidence)), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    got = src.mapInArrow(run, "doc_id long, score double, passages array<struct<first:long,last:long,score:double,e_value:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_segments"), "passages")
