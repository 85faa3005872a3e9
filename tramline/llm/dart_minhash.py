"""Near-duplicate classes by DartMinHash signatures, banding and exact checks.

Similarity is the weighted Jaccard index of two documents' five-word shingles,
a shingle weighing as often as it occurs (lower-cased words). Two documents at
0.8 or more are linked; a class is a connected component of links.

Signature. Each shingle owns an infinite strip of weight times rank on which
hashed darts land as a Poisson process of unit intensity. The weight axis is
cut into dyadic regions [2^v - 1, 2^(v+1) - 1); the darts of a region are drawn
in order of rank, gap by gap, from hashes of (shingle, region, number), so all
documents see the same darts. A document keeps the darts inside its own
weights; each dart belongs to one of k coordinates, and the earliest dart of
each coordinate is the signature. The darts drawn for a document are those of
rank below (k ln k + 2k) / total weight, so the cost is the number of shingles
plus k ln k however the weight is spread; the rare document with an empty
coordinate is drawn again with twice the rank. Coordinates of two documents
agree with the probability of their similarity.

Plan. (1) Exact copies collapse by a 128-bit key of the word sequence.
(2) Signatures of the distinct texts are banded; a band key that occurs once
is dropped after a map-side count. (3) Inside a bucket whole signatures are
compared and only a spanning forest of the pairs that agree in ``screen`` of
the coordinates leaves, never all pairs. (4) Components of that forest bring
texts together, where exact similarities are computed, and again only a
spanning forest leaves. Texts outside any cluster don't move. (5) Components
of the exact links are the classes.

Large groups (``forest``) are cut into blocks, one task each. A block's
components are named by their least members, and these leaders alone are
compared across blocks, level by level, which joins a group of copies of one
text with work in proportion to its size. What is then still apart from the
group's largest component is compared with all of the group, block by block,
so no link is lost; that last step is quadratic only in a group whose members
are mostly unlike each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, meet, packed, split_by
from .components import components
from .textkernel import U64, Words, flat, mix, sequence_keys, slices, unit, windows

BANDS, ROWS, SHINGLE, THRESHOLD = 24, 4, 5, 0.8
#: Share of coordinates that must agree before texts are compared. A pair at
#: 0.8 shares no bucket with a probability of 3e-6, and its 96 coordinates
#: Bytes of text whose groups are compared exactly at once; a larger group is taken alone.
VERIFY_BYTES = 4 << 20
#: fall below 0.6 with a probability of about 1e-6.
SCREEN = 0.6
BLOCK, BLOCK_BYTES = 4096, 8_000_000


def counted(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs in order, and how often each occurs."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    return v[begin], d[begin], np.diff(np.append(begin, len(v)))


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """DartMinHash of weighted sets: an array (n_docs, k) of 32-bit dart names.

    ``element`` are hashes, ``doc`` indices below ``n_docs``, ``weight``
    positive numbers. A document without elements has a row of zeros.
    """
    sig = np.zeros((n_docs, k), dtype=np.uint32)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo, reach = total > 0, k * np.log(k) + 2 * k
    while todo.any():
        mine = todo[doc]
        best = np.full(n_docs * k, np.inf)
        limit = np.where(total > 0, reach / np.maximum(total, 1e-300), 0.0)
        slots, ranks, names = [], [], []
        region, el, dc, wt = 0, element[mine], doc[mine], weight[mine]
        while len(el):
            size = float(1 << region)
            stream, rank = mix(el ^ mix(np.array([region + 1], U64))), np.zeros(len(el))
            d, w, number, partial = dc, wt, 0, bool(region or (wt < 1).any())
            while len(stream):
                # few streams left: several darts of each at a time
                g = int(min(256, max(1, (1 << 14) // len(stream))))
                h = mix(stream[:, None] + np.arange(number, number + g, dtype=U64))
                gaps = np.log(unit(h))
                gaps /= -size
                gaps[:, 0] += rank
                ranks_here = np.cumsum(gaps, axis=1)
                low = ranks_here <= limit[d][:, None]
                row, col = np.nonzero(low)
                name = mix(h[row, col] ^ U64(0xD6E8FEB86659FD93))
                r, slot = ranks_here[row, col], d[row] * k + (name % U64(k)).astype(np.int64)
                if partial:
                    inside = size - 1 + size * unit(mix(name)) < w[row]
                    name, r, slot = name[inside], r[inside], slot[inside]
                slots.append(slot)
                ranks.append(r)
                names.append((name >> U64(32)).astype(np.uint32))
                on = low[:, -1]
                stream, rank, d, w = stream[on], ranks_here[on, -1], d[on], w[on]
                number += g
            region += 1
            more = wt > float(1 << region) - 1
            el, dc, wt = el[more], dc[more], wt[more]
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        flat_sig = np.zeros(n_docs * k, dtype=np.uint32)
        flat_sig[slot[first]] = name[first]
        full = np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        done = todo & full
        sig[done] = flat_sig.reshape(n_docs, k)[done]
        todo &= ~full
        reach *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), bands, rows).astype(U64)
        key = np.broadcast_to(mix(np.arange(bands, dtype=U64)), (len(sig), bands)).copy()
        for r in range(rows):
            key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BANDS * ROWS
    for batch in batches:
        for part in slices(batch):
            words = Words(*flat(part.column("text"), lower=True))
            one, two = sequence_keys(words)
            el, doc, weight = counted(*windows(words, SHINGLE))
            n = part.num_rows
            sig = signatures(el, doc, weight.astype(np.float64), n, k)
            keys = band_keys(sig, BANDS, ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(words.count, pa.int64()),
                    pa.array(np.diff(words.off), pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array([row.tobytes() for row in sig.astype(np.uint16)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_words", "size", "k1", "k2", "sig", "bands"],
            )


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], target: int = 1 << 14, text_bytes: int | None = None) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as tables of about ``target`` rows, or with about ``text_bytes`` of text, that never cut a key."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    if text_bytes is not None:
        batches = (part for batch in batches for part in slices(batch, limit=text_bytes))
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += 0 if text_bytes is None else batch.column("text").nbytes
        if rows >= target or text_bytes is not None and size >= text_bytes:
            t = pa.Table.from_batches(held)
            last = np.ones(t.num_rows, dtype=bool)
            for c in key:
                v = t.column(c).to_numpy()
                last &= v == v[-1]
            cut = int(np.argmax(last))
            if cut:
                yield t.slice(0, cut)
            held, rows, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut, 0
    if held:
        yield pa.Table.from_batches(held)


def _bounds(t: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in key:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _found(edges: tuple[list, list], members: tuple[list, list, list]) -> pa.RecordBatch:
    """Links (kind 0: a, b), and for groups of more than one block each member's component (kind 1: key, a, b)."""
    n, m = len(edges[0]), len(members[0])
    cols = [np.repeat([0, 1], [n, m]), np.array([0] * n + members[0]), np.array(edges[0] + members[1]), np.array(edges[1] + members[2])]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["kind", "key", "a", "b"])


FOUND = "kind long, key long, a long, b long"
#: A group of one task: its key, the block, and the block that it is compared with (-1: itself).
GROUP = ["key", "blk", "other"]


def _start(t: pa.Table, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row its group, its first equal component in the group, its side, and whether the group has two sides."""
    n = t.num_rows
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
    order = np.lexsort((np.arange(n), comp, group))
    new = np.ones(n, dtype=bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (comp[order][1:] != comp[order][:-1])
    root = np.empty(n, dtype=np.int64)
    root[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return group, root, side, t.column("other").to_numpy() >= 0


def _members(t: pa.Table, group: np.ndarray, root: np.ndarray) -> tuple[list, list, list]:
    big = np.flatnonzero((t.column("nb").to_numpy() > 1) & (t.column("other").to_numpy() < 0))
    node = t.column("node").to_numpy()
    return t.column("key").to_numpy()[big].tolist(), node[big].tolist(), node[root[big]].tolist()


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of the pairs of a group whose signatures agree in SCREEN of the coordinates."""
    for t in _groups(batches, GROUP):
        edge = _bounds(t, GROUP)
        n = t.num_rows
        group, root, side, cross = _start(t, edge)
        node = t.column("node").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(n, -1)
        need = SCREEN * sig.shape[1]
        out_a, out_b = [], []
        step = 1
        live = np.arange(n)
        while True:
            live = live[live + step < n]
            live = live[group[live] == group[live + step]]
            if not len(live):
                break
            i = live[root[live] != root[live + step]]
            i = i[~cross[i] | (side[i] != side[i + step])]
            for s in range(0, len(i), 1 << 15):
                x = i[s : s + (1 << 15)]
                y = x + step
                hit = (sig[x] == sig[y]).sum(axis=1) >= need
                for p, q in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                    rp, rq = root[p], root[q]
                    while root[rp] != rp:
                        rp = root[rp]
                    while root[rq] != rq:
                        rq = root[rq]
                    if rp != rq:
                        root[max(rp, rq)] = min(rp, rq)
                        out_a.append(int(node[p]))
                        out_b.append(int(node[q]))
            root = _roots(root)
            step += 1
        yield _found((out_a, out_b), _members(t, group, root))


class Overlaps:
    """Similarities of the documents of a group from their distinct weighted values."""

    def __init__(self, value: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int):
        self.n, self.weight = n, weight
        self.total = np.bincount(doc, weights=weight, minlength=n)
        _, self.ident = np.unique(value, return_inverse=True)
        order = np.argsort(self.ident, kind="stable")
        self.post_doc, self.post_w = doc[order], weight[order]
        self.size = np.bincount(self.ident)
        self.begin = np.cumsum(self.size) - self.size
        self.edge = np.searchsorted(doc, np.arange(n + 1))

    def row(self, i: int) -> np.ndarray:
        """Document i's similarity to all n."""
        own = slice(self.edge[i], self.edge[i + 1])
        mine = self.ident[own]
        c = self.size[mine]
        where = np.repeat(self.begin[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        common = np.bincount(self.post_doc[where], weights=np.minimum(self.post_w[where], np.repeat(self.weight[own], c)), minlength=self.n)
        return common / np.maximum(self.total + self.total[i] - common, 1e-300)


def _shingles(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct weighted shingles of all rows, from slices of bounded text."""
    parts, at = [], 0
    for batch in t.select(["text"]).to_batches():
        for part in slices(batch):
            el, doc, weight = counted(*windows(Words(*flat(part.column("text"), lower=True)), SHINGLE))
            parts.append((el, doc + at, weight))
            at += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of a spanning forest inside each group; a document beside which no other component is left is not compared."""
    for t in _groups(batches, GROUP, 256, VERIFY_BYTES):
        edge = _bounds(t, GROUP)
        el, doc, weight = _shingles(t)
        group, start, side, cross = _start(t, edge)
        node = t.column("node").to_numpy()
        span = np.searchsorted(doc, edge)
        out_a, out_b = [], []
        whole = start.copy()
        for g in range(len(edge) - 1):
            s, n = edge[g], edge[g + 1] - edge[g]
            part = slice(span[g], span[g + 1])
            root, two, which = start[s : s + n] - s, bool(cross[s]), side[s : s + n]
            apart = int((root != root[0]).sum())
            pairs = Overlaps(el[part], doc[part] - s, weight[part].astype(np.float64), n) if apart else None
            for i in range(n if apart else 0):
                if not (root != root[i]).any():
                    break
                near = (pairs.row(i) >= THRESHOLD) & (root != root[i])
                if two:
                    near &= which != which[i]
                for j in np.flatnonzero(near).tolist():
                    if root[j] != root[i]:
                        low, high = sorted((root[i], root[j]))
                        root[root == high] = low
                        out_a.append(int(node[s + i]))
                        out_b.append(int(node[s + j]))
            whole[s : s + n] = root + s
        yield _found((out_a, out_b), _members(t, group, whole))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each group in one task, its rows side by side, the least node first."""
    return rows.repartition("key", "blk", "other").sortWithinPartitions("key", "blk", "other", "node", "side")


def _block(n_blocks: Column, level: int) -> Column:
    # beyond the first block the key alone would still name one task
    return F.pmod(F.xxhash64("node", F.lit(7 + level)), n_blocks).cast("int")


def forest(rows: DataFrame, kernel, limit: int, label: str) -> DataFrame:
    """``a, b``: links that join what ``kernel`` links, directly or through others, inside each group.

    ``rows``: key and node (long), w (a node's size), nb (blocks of ``limit``
    that the sizes of its key fill), and what the kernel reads.
    """
    own = {"comp": F.col("node"), "side": F.lit(0), "other": F.lit(-1)}
    made: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, f"{label}-{name}"))
        return made[-1]

    def run(part: DataFrame, name: str) -> DataFrame:
        return put(_dealt(part).mapInArrow(kernel, FOUND), name)

    def links(found: DataFrame) -> DataFrame:
        return found.where("kind = 0").select("a", "b")

    def done(edges: DataFrame) -> DataFrame:
        out = materialize(edges.where("a != b").distinct(), label)
        discard(*made)
        return out

    found = run(rows.withColumn("blk", _block(F.col("nb"), 0)).withColumns(own), "blocks")
    edges = links(found)
    # key, node, comp: only groups of more than one block are left
    comp = found.where("kind = 1").select("key", F.col("a").alias("node"), F.col("b").alias("comp")).distinct()
    if comp.isEmpty():
        return done(edges)
    big = put(rows.where("nb > 1"), "big")
    level, left = 0, None
    while True:
        lead = put(comp.select("key", F.col("comp").alias("node")).distinct(), "leaders")
        many = put(lead.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "apart")
        now = many.agg(F.sum("n")).first()[0] or 0
        if not now:
            return done(edges)
        if now == left:
            break
        level, left = level + 1, now
        chosen = big.join(lead.join(many.select("key"), "key"), ["key", "node"], "left_semi")
        size = chosen.groupBy("key").agg(F.ceil(F.sum("w") / limit).alias("nb"))
        blocks = chosen.drop("nb").join(size, "key").withColumn("blk", _block(F.col("nb"), level)).withColumns(own)
        # the leaders' own components are wanted whatever the number of blocks
        found = run(blocks.withColumn("nb", F.lit(2)), f"level{level}")
        edges = edges.unionByName(links(found))
        up = found.where("kind = 1").select("key", F.col("a").alias("comp"), F.col("b").alias("top")).distinct()
        comp = put(comp.join(up, ["key", "comp"], "left").select("key", "node", F.coalesce("top", "comp").alias("comp")), "members")
    apart = comp.join(many.select("key"), "key")
    sizes = apart.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = put(sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main")), "main")
    rest = big.join(apart, ["key", "node"]).join(main, "key").withColumn("blk", _block(F.col("nb"), 0))
    rest = put(rest.withColumn("odd", F.col("comp") != F.col("main")).drop("main"), "rest")
    odd = put(rest.where("odd").groupBy("key").agg(F.ceil(F.sum("w") / limit).cast("int").alias("parts")), "odd")
    rest = rest.join(odd, "key")
    all_of = rest.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("side", F.lit(0))
    some = rest.where("odd").withColumn("other", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    some = some.withColumn("blk", F.explode(F.expr("sequence(0, cast(nb as int) - 1)"))).withColumn("side", F.lit(1)).select(*all_of.columns)
    return done(edges.unionByName(links(run(all_of.unionByName(some), "apart-pairs"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, copy_id`` for each row of ``docs`` (needs doc_id, text).

    ``class_id`` is the least doc_id of the class, ``copy_id`` the least doc_id
    with the same word sequence. A document of fewer than five words has one
    shingle, all its words. A text without words (null, empty, blank) is like
    no other: it is its own class. Rows that repeat a doc_id each get a row. A
    row without doc_id takes the class of its exact copies that have one, else
    null. Rows that repeat a doc_id with other texts are one document: what any
    of them resembles joins the class. Other columns are ignored.
    """
    sketch = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _sketch, "doc_id long, n_words long, size long, k1 long, k2 long, sig binary, bands array<long>"
        ),
        "sketch",
    )
    worded = sketch.where("n_words > 0")
    reps = materialize(
        worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"), F.max("size").alias("size")).where("node IS NOT NULL"),
        "reps",
    )
    rows = reps.select("node", F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = rows.join(shared, "key").join(reps.select("node", "sig"), "node").select("key", "node", "sig", F.lit(1).alias("w"), F.ceil(F.col("n") / BLOCK).alias("nb"))
    screened = forest(members, _screen, BLOCK, "screen")
    clusters = materialize(components(screened), "clusters")
    members = reps.select("node", "size").join(clusters, "node")
    sizes = materialize(members.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("nb")), "sizes")
    wanted = materialize(members.join(sizes, "component").select("node", F.col("component").alias("key"), F.col("size").alias("w"), "nb").distinct(), "wanted")
    discard(shared, screened, clusters, sizes)
    # only the texts of clusters move
    texts = meet(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")), ["node"], wanted, "inner").dropDuplicates(["node", "text"])
    exact = forest(texts, _verify, BLOCK_BYTES, "verify")
    classes = components(exact)
    named = materialize(
        reps.select("k1", "k2", "node").join(classes, "node", "left").select("k1", "k2", F.col("node").alias("copy_id"), F.coalesce("component", "node").alias("class_id")),
        "classes",
    )
    found = worded.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "class_id", "copy_id")
    discard(reps, wanted, exact)
    blank = sketch.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"))
    return found.unionByName(blank)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` less every document whose class has one with a smaller doc_id.

    Of rows that repeat a doc_id with the same text one stays. Rows without
    doc_id stay. Columns are those of ``docs``, whatever their names.
    """
    classes = materialize(near_duplicates(docs), "near")
    gone = materialize(classes.where("doc_id != class_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    repeated = materialize(classes.groupBy(F.col("doc_id").alias("id")).count().where("id IS NOT NULL AND count > 1").select("id"), "repeated")
    discard(classes)
    left = meet(packed(docs, id=F.col("doc_id").cast("long")), ["id"], gone, "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    again, once = split_by(left, ["id"], repeated)
    alone = again.join(repeated, "id", "left_anti").select("row")
    several = again.join(repeated, "id", "left_semi").withColumn("text", F.col("row").getField("text").cast("string"))
    # of rows that differ elsewhere the one with the least hash stays, whatever the order they come in
    simple = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    first = Window.partitionBy("id", "text").orderBy(F.xxhash64(*[F.col("row").getField(c) for c in simple]))
    several = several.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row")
    return once.select("row").unionByName(alone).unionByName(several).select("row.*")
