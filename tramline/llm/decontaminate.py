"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: words without outer punctuation, case
folded, with numbers, units after numbers and names (capitalised words inside
a sentence) replaced by typed placeholders. A capitalised word that opens a
sentence or line may be a name or not, so it is read both ways. Windows of eight
such tokens are hashed, once for every reading; a document's windows meet the
benchmark's in a hash join. Matches on
one diagonal (document place minus item place) form an alignment. Each value
that the item has in placeholders stands for the one document value that it
meets at more than half of its places there (two values of the item may have
become the same one); a window that holds a place with
another value does not count, unless it agrees word for word. Templates need three
literal tokens; beside them every window is also compared word for word, so that
copies of passages that are mostly numbers or names are found. A document is
contaminated by an item if the windows that count cover six of the item's
windows (13 tokens), or all of an item that has fewer (all of its templates
are enough if the template windows alone cover them). An item of one or two
tokens is too short for a passage: it is found in documents that are that item
and nothing else.

Plan. (1) The windows of all items are written as a table of hashes, and their
leading bits as a filter of a fixed 8 MB, which goes to every task. (2) One
pass over the documents keeps, per distinct text, the hashes that pass the
filter; nothing else of a text moves. (3) These hashes join the item windows;
a pair of text and item stays if it shares as many of the item's windows as
could be enough. (4) Only texts of such pairs move, to their items' texts, and
are aligned there. Neither benchmark nor documents are gathered anywhere, and
an alignment is worked out in runs of diagonals of bounded size, so a passage
that repeats without end costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, meet, packed
from .textkernel import PUNCT, U64, Cores, flat, mix, slices, span_hashes

SIZE, ENOUGH, LITERALS = 8, 6, 3
#: Readings of windows, and pairs of windows, that are held at once.
READINGS, PAIRS = 1 << 20, 1 << 21
#: Leading bits of a hash that address the filter: 8 MB.
FILTER_BITS = 26
#: Items that are compared with a text in one go.
ITEMS = 64
#: Items that may share a window before it counts as a common phrase.
COMMON = 64

UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd mph kph h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years l ml litre litres liter liters gal usd eur dollar dollars euro euros cent cents percent % °c °f degrees kwh w kw v"

_PUNCT = PUNCT.copy()
_PUNCT[ord("%")] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-%$"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;\"|"]] = True

_NUM, _UNIT, _NAME, _VERBATIM = mix(np.array([101, 102, 103, 104], dtype=U64))


def _unit_hashes() -> np.ndarray:
    words = [u.encode() for u in UNITS.split()]
    return np.unique(span_hashes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])))


class Tokens:
    """Canonical tokens of a batch: ``hash``, ``value`` (hash before a placeholder took its place), ``slot``, ``open`` (a name or a word: capitalised where a sentence or line starts), ``doc``, ``first``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        cores = Cores(raw, off, _PUNCT)
        begin, end, h = cores.begin, cores.end, cores.hash
        self.doc, self.first = cores.doc, cores.first
        if not len(h):
            self.hash = self.value = np.zeros(0, U64)
            self.slot = self.open = np.zeros(0, bool)
            return
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        numeric = np.concatenate([[0], np.cumsum(_NUMERIC[raw])])
        has = digits[end] - digits[begin] > 0
        number = has & (numeric[end] - numeric[begin] == end - begin)
        # a number with letters behind it is a number with its unit: 5kg
        number |= has & _DIGIT[raw[begin]] & (end - begin - (numeric[end] - numeric[begin]) <= 3)
        unit = np.zeros(len(h), dtype=bool)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = self.doc[1:] == self.doc[:-1]
        unit[1:] = number[:-1] & same[1:] & ~number[1:] & np.isin(h[1:], _unit_hashes())
        upper = (raw[begin] >= 65) & (raw[begin] <= 90)
        accent = (raw[begin] == 0xC3) & (raw[np.minimum(begin + 1, len(raw) - 1)] <= 0x9E)
        capital = upper | accent
        # the previous word ends a sentence, or a line break or another document lies between
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        ended = np.ones(len(h), dtype=bool)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        ended[1:] = (stops[begin[1:]] - stops[end[:-1]] > 0) | (breaks[begin[1:]] - breaks[end[:-1]] > 0) | ~same[1:]
        second = raw[np.minimum(begin + 1 + accent, len(raw) - 1)]
        shouted = (second >= 65) & (second <= 90)
        proper = capital & ~shouted & ~number & ~unit
        name = proper & ~ended
        self.open = proper & ended
        self.value = h
        self.slot = number | unit | name
        self.hash = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h)))

    def _readable(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, literal tokens, readings at most) of all windows of ``size`` tokens that hold enough literal ones."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return (np.zeros(0, np.int64),) * 3
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        opens = np.concatenate([[0], np.cumsum(self.open)])
        literal = size - (slots[size:] - slots[:m])
        at = np.flatnonzero((self.doc[:m] == self.doc[size - 1 :]) & (literal >= LITERALS))
        return at, literal[at], 1 << (opens[at + size] - opens[at])

    def verbatim(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first token, hash of the words as they stand) of all windows of ``size`` tokens."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        total = np.full(m, U64(size))
        for k in range(size):
            total += self.value[k : k + m] * mix(np.array([k + 1], U64))[0]
        own = self.doc[:m] == self.doc[size - 1 :]
        if size < LITERALS:
            # too short for a passage: the whole text or nothing
            own &= np.diff(self.first)[self.doc[:m]] == size
        at = np.flatnonzero(own)
        return at, mix(total[at] ^ _VERBATIM)

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In pieces of bounded size, (place of the first token, hash) of every reading of the windows of ``size`` tokens that holds enough literal ones."""
        at, literal, n = self._readable(size)
        piece = np.cumsum(n) // READINGS
        place = mix(np.arange(1, size + 1).astype(U64))
        for at, left in zip(*(np.split(x, np.flatnonzero(np.diff(piece)) + 1) for x in (at, literal)), strict=True):
            total = np.zeros(len(at), U64)
            for k in range(size):
                total += self.hash[at + k] * place[k]
            for k in range(size):
                pick = np.flatnonzero(self.open[at + k] & (left > LITERALS))
                if len(pick):
                    named = total[pick] + (_NAME - self.hash[at[pick] + k]) * place[k]
                    at, total, left = np.concatenate([at, at[pick]]), np.concatenate([total, named]), np.concatenate([left, left[pick] - 1])
            yield at, mix(total + U64(size))


class Index:
    """Places by hash, in the order of hashes and places."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]]):
        self.place = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in pieces)])
        self.hash = np.concatenate([np.zeros(0, U64), *(h for _, h in pieces)])
        order = np.lexsort((self.place, self.hash))
        self.hash, self.place = self.hash[order], self.place[order]

    def known(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        return self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)

    def entries(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``h``, entry) of all entries with these hashes."""
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        return _spread(lo, hi)

    def pairs(self, at: np.ndarray, h: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document place, item place) of equal windows, whole diagonals at a time, about ``PAIRS`` of them or those of one diagonal.

        ``n`` is the number of item places. A diagonal holds each item place once at most.
        """
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        if (hi - lo).sum() <= PAIRS:
            hit, idx = _spread(lo, hi)
            yield at[hit], self.place[idx]
            return
        _, rank = np.unique(self.hash, return_inverse=True)
        key = rank * (n + 1) + self.place
        base = rank[np.minimum(lo, len(rank) - 1)] * (n + 1)
        run = max(1, PAIRS // max(1, n))
        order = np.argsort(at, kind="stable")
        at, base, lo, hi = at[order], base[order], lo[order], hi[order]
        for first in range(int(at[0]) - n, int(at[-1]) + 1, run):
            # diagonals first .. first + run - 1: item places above p - first - run, up to p - first
            mine = slice(int(np.searchsorted(at, first)), int(np.searchsorted(at, first + run + n)))
            p, b = at[mine], base[mine]
            up = np.searchsorted(key, b + np.clip(p - first, -1, n), "right")
            down = np.searchsorted(key, b + np.clip(p - first - run, -1, n), "right")
            down, up = np.clip(down, lo[mine], hi[mine]), np.clip(up, lo[mine], hi[mine])
            hit, idx = _spread(down, np.maximum(down, up))
            if len(hit):
                yield p[hit], self.place[idx]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, element) for all elements of the ranges lo .. hi - 1."""
    c = hi - lo
    return np.repeat(np.arange(len(c)), c), np.repeat(lo, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)


class Benchmark:
    """Windows of some benchmark items, ready to be probed."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw, off = flat(pa.array(texts, pa.large_string()))
        self.ids, self.tokens = ids, Tokens(raw, off)
        count = np.diff(self.tokens.first)
        self.sizes = sorted({int(min(c, SIZE)) for c in count if c})
        readings, words = [], []
        for size in self.sizes:
            for out, found in ((readings, self.tokens.windows(size)), (words, [self.tokens.verbatim(size)])):
                for at, h in found:
                    mine = (count[self.tokens.doc[at]] == size) | (size == SIZE)
                    out.append((at[mine], h[mine]))
        self.read, self.said = Index(readings), Index(words)
        # windows with a template, and all windows
        self.windows_of = np.bincount(self.tokens.doc[np.unique(self.read.place)], minlength=len(ids))
        self.words_of = np.bincount(self.tokens.doc[self.said.place], minlength=len(ids))
        # which of the same windows of its item an entry is
        item, n = self.tokens.doc[self.said.place], np.arange(len(self.said.place))
        new = np.ones(len(n), dtype=bool)
        new[1:] = (self.said.hash[1:] != self.said.hash[:-1]) | (item[1:] != item[:-1])
        self.nth = n - np.maximum.accumulate(np.where(new, n, 0))

    def probe(self, tokens: Tokens) -> dict[int, list[tuple[int, int, int]]]:
        """For each document that shares windows: (item index, windows that consistent alignments cover, those and windows covered word for word)."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        covered = [np.zeros((4, 0), np.int64)]
        for size in self.sizes:
            at, hit = tokens.verbatim(size)
            some = self.said.known(hit)
            at, hit = at[some], hit[some]
            if len(at):
                # a window that a document has n times covers at most n of an item's that are the same
                doc, h = tokens.doc[at], hit
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
                times = np.diff(np.append(new, len(doc)))
                which, idx = self.said.entries(h[new])
                own = self.nth[idx] < times[which]
                q = self.said.place[idx[own]]
                covered.append(np.stack([doc[new][which[own]], self.tokens.doc[q], q, np.zeros_like(q)]))
            n = len(self.tokens.hash)
            spots = [np.zeros(0, np.int64)]
            hashes = [np.zeros(0, U64)]
            for at, h in tokens.windows(size):
                some = self.read.known(h)
                spots.append(at[some])
                hashes.append(h[some])
            at, h = np.concatenate(spots), np.concatenate(hashes)
            if not len(at):
                continue
            for p, q in self.read.pairs(at, h, n):
                # several readings of two windows may agree
                p, q = np.divmod(np.unique(p * n + q), n)
                doc, item = tokens.doc[p], self.tokens.doc[q]
                sound = self._consistent(tokens, doc, item, p, q, size)
                part = np.unique(np.stack([doc[sound], item[sound], q[sound], np.ones_like(q[sound])]), axis=1)
                covered.append(part)
        key = np.concatenate(covered, axis=1)
        # one row for each covered window, of the two kinds the template if there
        key = key[:, np.lexsort((-key[3], key[2], key[1], key[0]))]
        key = key[:, np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)])[: key.shape[1]]]
        first = np.flatnonzero(np.concatenate([[True], (key[:2, 1:] != key[:2, :-1]).any(axis=0)])[: key.shape[1]])
        if len(first):
            read = np.add.reduceat(key[3], first)
            both = np.diff(np.append(first, key.shape[1]))
            for d, i, k, n in zip(key[0, first].tolist(), key[1, first].tolist(), read.tolist(), both.tolist(), strict=True):
                found.setdefault(d, []).append((i, k, n))
        return found

    def _consistent(self, tokens: Tokens, doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Which matches hold no slot place that contradicts the rest of its alignment, or agree word for word."""
        _, group = np.unique(np.stack([doc, item, p - q]), axis=1, return_inverse=True)
        sp = p[:, None] + np.arange(size)
        sq = q[:, None] + np.arange(size)
        mine, other = self.tokens.value[sq], tokens.value[sp]
        # a word that may be a name is one here unless it stands for itself
        slot = self.tokens.slot[sq] | tokens.slot[sp] | (mine != other)
        if not slot.any():
            return np.ones(len(p), dtype=bool)
        # every place of an alignment has one vote, however many windows hold it
        n = len(self.tokens.value)
        _, vote, place = np.unique((np.repeat(group.ravel(), size) * n + sq.ravel())[slot.ravel()], return_index=True, return_inverse=True)
        g, a, b = np.repeat(group.ravel(), size)[slot.ravel()][vote], mine[slot][vote], other[slot][vote]
        order = np.lexsort((b, a, g))
        g, a, b = g[order], a[order], b[order]
        new_a = np.ones(len(g), dtype=bool)
        new_a[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
        new_b = new_a.copy()
        new_b[1:] |= b[1:] != b[:-1]
        run_a, run_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
        minority = np.empty(len(g), dtype=bool)
        minority[order] = 2 * np.bincount(run_b)[run_b] <= np.bincount(run_a)[run_a]
        against = np.zeros(slot.shape, dtype=bool)
        against[slot] = minority[place.ravel()]
        return ~against.any(axis=1) | ~(slot & (mine != other)).any(axis=1)

    def enough(self, item: int, read: int, both: int) -> bool:
        return read >= min(ENOUGH, int(self.windows_of[item])) > 0 or both >= min(ENOUGH, int(self.words_of[item])) > 0


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item each window's place and hashes, and how many windows a document must share at least."""
    for batch in batches:
        for part in slices(batch):
            bench = Benchmark(list(range(part.num_rows)), part.column("text").to_pylist())
            place = np.concatenate([bench.read.place, bench.said.place])
            h = np.concatenate([bench.read.hash, bench.said.hash])
            item = bench.tokens.doc[place]
            some = np.where(bench.windows_of > 0, np.minimum(bench.windows_of, ENOUGH), ENOUGH)
            need = np.minimum(some, np.minimum(bench.words_of, ENOUGH))
            ids = part.column("iid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(place - bench.tokens.first[item]), pa.array(h.view(np.int64)), pa.array(need[item].astype(np.int64)), pa.array(np.minimum(np.diff(bench.tokens.first), SIZE)[item].astype(np.int32))], names=["iid", "place", "hash", "need", "size"])


def _filter(windows: DataFrame) -> np.ndarray:
    """Which leading bits occur, as bytes of eight bits: always 2 to the power ``FILTER_BITS`` bits."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = windows.select(F.shiftright(bit, 6).alias("at"), one.alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out.astype("<u8").view(np.uint8)


def _shared_hashes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``id, p1, p2, hashes``: for every row its id, the key of its text, and the hashes of windows that an item may have."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 .. SIZE
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens(*flat(part.column("text")))
                spots, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
                for size in sizes:
                    for at, h in (tokens.verbatim(size), *tokens.windows(size)):
                        bit = (h >> U64(64 - FILTER_BITS)).astype(np.int64)
                        maybe = (seen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        spots.append(tokens.doc[at[maybe]])
                        hashes.append(h[maybe])
                doc, h = np.concatenate(spots), np.concatenate(hashes)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                doc, h = doc[new], h[new]
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("p1"), part.column("p2"), lists], names=["id", "p1", "p2", "hashes"])

    return docs.mapInArrow(run, "id long, p1 long, p2 long, hashes array<long>")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of text and item that hold, of texts with the items each may contain."""
    for batch in batches:
        for part in slices(batch):
            own = part.column("items").to_pylist()
            known: dict[int, tuple[int, str]] = {x["iid"]: (x["item_id"], x["text"]) for xs in own for x in xs}
            at = {iid: n for n, iid in enumerate(known)}
            bench = Benchmark([known[i][0] for i in known], [known[i][1] for i in known])
            found = bench.probe(Tokens(*flat(part.column("text"))))
            p1, p2, item = [], [], []
            for d, xs in enumerate(own):
                wanted = {at[x["iid"]] for x in xs}
                for i, k, n in found.get(d, ()):
                    if i in wanted and bench.enough(i, k, n):
                        p1.append(part.column("p1")[d].as_py())
                        p2.append(part.column("p2")[d].as_py())
                        item.append(bench.ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p1, p2, item)], names=["p1", "p2", "item_id"])


def _keyed(docs: DataFrame) -> tuple[Column, Column, Column]:
    text = F.col("text").cast("string")
    return text, F.xxhash64(text), F.xxhash64(F.lit(13), text)


def _candidates(once: DataFrame, windows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``p1, p2, iid``: texts and the items of which they may have windows enough; and the written tables that it reads.

    A window that over ``COMMON`` items have (a phrase of many questions) names
    no item. An item that can't have enough of such windows alone needs another
    one besides, and only those are joined with the texts: ``COMMON`` rows for a text's
    window at most. For the other items the texts' sets of common windows are
    joined, each distinct set once however many texts have it, and the pairs that have
    enough go to all texts of the set. Both ways let more through than hold; nothing is lost.
    """
    common = materialize(windows.groupBy("hash").agg(F.countDistinct("iid").alias("n")).where(F.col("n") > COMMON).select("hash"), "common-windows")
    shared_by = windows.join(common, "hash", "left_semi").groupBy("iid").agg(F.countDistinct("place").alias("also"))
    rare = windows.join(common, "hash", "left_anti").join(shared_by, "iid", "left").select("hash", "iid", "place", "need", F.coalesce("also", F.lit(0).cast("long")).alias("also"))
    hits = once.select("p1", "p2", F.explode("hashes").alias("hash")).join(rare, "hash")
    out = hits.groupBy("p1", "p2", "iid").agg(F.countDistinct("place").alias("n"), F.max("need").alias("need"), F.max("also").alias("also")).where("n + also >= need").select("p1", "p2", "iid")
    if common.isEmpty():
        return out, [common]
    alone = windows.join(common, "hash", "left_semi").join(shared_by, "iid").where("also >= need").select("hash", "iid", "place", "need")
    sets = once.select("p1", "p2", F.explode("hashes").alias("hash")).join(common, "hash", "left_semi").groupBy("p1", "p2").agg(F.sort_array(F.collect_set("hash")).alias("set"))
    sets = materialize(sets.withColumn("k", F.xxhash64("set")), "common-sets")
    pairs = sets.select("k", "set").dropDuplicates(["k", "set"]).select("k", F.explode("set").alias("hash")).join(alone, "hash")
    pairs = pairs.groupBy("k", "iid").agg(F.countDistinct("place").alias("n"), F.max("need").alias("need")).where("n >= need").select("k", "iid")
    return out.unionByName(sets.select("p1", "p2", "k").join(pairs, "k").select("p1", "p2", "iid")).distinct(), [common, sets]


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, p1, p2`` of every row, and ``p1, p2, items``: the sorted items of each text that contains any."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = materialize(items.withColumn("iid", F.xxhash64("item_id", "text")), "items")
    windows = materialize(items.select("iid", "text").mapInArrow(_item_windows, "iid long, place long, hash long, need long, size int"), "windows")
    text, p1, p2 = _keyed(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), p1.alias("p1"), p2.alias("p2"))
    shared = materialize(_shared_hashes(keyed, windows), "shared-windows")
    once = shared.where("size(hashes) > 0").groupBy("p1", "p2").agg(F.any_value("hashes").alias("hashes"))
    candidates, used = _candidates(once, windows)
    pairs = materialize(candidates, "pairs")
    discard(*used)
    several = pairs.groupBy("p1", "p2").agg(F.ceil(F.count("*") / ITEMS).alias("parts"))
    with_items = pairs.join(several, ["p1", "p2"]).join(items, "iid").withColumn("part", F.expr("pmod(xxhash64(iid), parts)"))
    lists = materialize(with_items.groupBy("p1", "p2", "part").agg(F.collect_list(F.struct("iid", "item_id", "text")).alias("items")), "lists")
    wanted = materialize(pairs.select("p1", "p2").distinct(), "wanted-texts")
    texts = meet(keyed.select("text", "p1", "p2"), ["p1", "p2"], wanted, "inner").dropDuplicates(["p1", "p2"]).join(lists, ["p1", "p2"])
    held = texts.select("p1", "p2", "text", "items").mapInArrow(_aligned, "p1 long, p2 long, item_id long")
    found = materialize(held.groupBy("p1", "p2").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "contaminated")
    discard(items, windows, pairs, lists, wanted)
    return shared, found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, items`` (sorted item ids) for every row of ``docs``.

    A null or blank text contains nothing. Items without text or id match
    nothing. Repeated items and rows are each treated alike; an id with
    several texts is found by any of them. An empty benchmark leaves every row
    clean, and an empty table stays empty. A long text is read whole, alone in
    its slice. Exactly half of a value's places is not more than half: such
    places contradict. Other columns are ignored.
    """
    rows, found = _matches(docs, benchmark)
    out = rows.select("id", "p1", "p2").join(found, ["p1", "p2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, columns unchanged whatever their names."""
    slim = docs.select("doc_id", "text")
    rows, found = _matches(slim, benchmark)
    discard(rows)
    _, p1, p2 = _keyed(docs)
    return meet(packed(docs, p1=p1, p2=p2), ["p1", "p2"], found.select("p1", "p2"), "left_anti").select("row.*")
