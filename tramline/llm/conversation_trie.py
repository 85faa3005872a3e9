"""A prefix trie of conversations: what many of them share from the start.

A turn is known by a cryptographic digest of its role and text, and a prefix by
the digest of the one before it chained with its last turn's, so equal prefixes
have equal digests and no text moves. Every prefix of a conversation is a row;
grouped by (depth, digest) they are the nodes.

A sum over a node's subtree reaches it from every node below. A node belongs to
its smallest member, so a conversation's own nodes are the end of its path: their
values are first summed along the path, and each conversation then gives one
value to each of its ancestors. That is a row per prefix at most, while a row
per node and ancestor would grow with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bytes of a prefix digest, and the digest of the prefix without turns.
WIDTH = 16
ROOT = hashlib.sha256(b"").digest()[:WIDTH]
#: Turns that a rebuilt conversation takes from another one at most, and how many conversations share a lead.
BORROWED, FAMILY = 5, 100
#: Bytes of decimal ids in one row.
BLOCK = 1 << 16
_PREFIXES = "conv_id long, depth long, digest binary, parent binary, chars long, last boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), ``digest`` of role and text, ``chars`` (code points of the text).

    Turns go by ``turn``, null first, equal ones by digest; null role and text
    are empty; rows without conv_id are no conversation's and left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "chars")


def rebuilt(placed: DataFrame) -> DataFrame:
    """Conversations that start with turns of their lead; ``placed`` is written, see ``turns``.

    Conversation c takes the first h turns of conversation c - c % 100 (all if
    fewer, none if absent), h = crc32(decimal c) % 6, and goes on with its own
    after its first h. A row of place 0 stands for each conversation, so one
    without turns is not lost. Of a lead, five narrow rows at most move.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (BORROWED + 1)).cast("int")
    ids = placed.where("place = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lead"))
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") <= BORROWED)).groupBy(F.col("conv_id").alias("lead")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    taken = ids.join(heads, "lead").select("conv_id", F.inline(F.slice("head", F.lit(1), F.col("h"))))
    own = placed.where(F.col("place") > h)
    nothing = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(taken).unionByName(nothing)


def prefixes(placed: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``conv_id, depth, digest, parent, chars`` of its last text, ``last`` if it is the whole.

    Rows stream in order of (conv_id, place), so memory does not grow with a
    conversation; its chain is one task's, since each digest needs the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, until it is known whether more follow
        for batch in batches:
            out: list[tuple] = []
            for conv, place, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "digest", "chars")), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append((*held, True))
                    held = (conv, 0, ROOT, None, 0)
                if place:
                    out.append((*held, False))
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + digest).digest()[:WIDTH], held[2], chars)
            yield _batch(out)
        if held is not None:
            yield _batch([(*held, True)])

    rows = placed.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "digest", "chars")
    return rows.mapInArrow(run, _PREFIXES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "chars", "last"])


def ends(paths: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: SHA-256 of the ids of the conversations that end at a node, ascending, with commas.

    Ids are dealt by range of (digest, conv_id), so a node at which a third
    of all conversations end is spread; each task joins its ids to blocks, and
    the blocks of a node stream through one hash in order.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            out = []
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if digest != key or size > BLOCK:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = digest, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield block(out)
        if ids:
            yield block([(key, first, ",".join(ids))])

    def block(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pairs(out)
        if key is not None:
            yield pairs([(key, state.hexdigest())])

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["digest", "ends_sha256"])

    whole = paths.where("last").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = whole.mapInArrow(blocks, "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(digests, "digest binary, ends_sha256 string")


def subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depth, digest, saved_tokens, n_leaves, n_children`` of every node, from written prefixes and nodes."""
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), F.lit(1).cast("long").alias("own"), ((F.col("n_convs") - 1) * F.col("chars")).alias("value"), F.col("childless").cast("long").alias("leaf"))
    none = F.lit(0).cast("long")
    rows = paths.select("conv_id", "depth", "digest", none.alias("own"), none.alias("value"), none.alias("leaf")).unionByName(own)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    # a frame by range holds both rows of a depth
    below = deeper.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    given = rows.select(
        "depth", "digest", F.sum("value").over(below).alias("value"), F.sum("leaf").over(below).alias("leaf"),
        F.coalesce(F.sum("own").over(deeper.rangeBetween(-1, -1)), none).alias("child"),
    ).where("digest IS NOT NULL AND (value > 0 OR leaf > 0 OR child > 0)")
    return given.groupBy("depth", "digest").agg(F.sum("value").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))


def trie(placed: DataFrame) -> DataFrame:
    """The nodes of a trie over placed turns (see ``turns``), the textless root included.

    Per node: ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` the
    parent's conv_id, ``n_convs`` members, ``n_children``, ``n_leaves`` childless
    nodes in its subtree, ``saved_tokens`` (per node of the subtree, members but
    one times code points of the last text), ``ends_sha256`` over the ids of members that end there,
    and ``digest`` in hex. Repeated turns are turns; without conversations there is no node.
    """
    paths = materialize(prefixes(placed), "paths")
    keys = ["depth", "digest", "parent", "chars"]
    nodes = materialize(paths.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.bool_and("last").alias("childless")), "nodes")
    found = nodes.join(subtree_sums(paths, nodes), ["depth", "digest"]).join(ends(paths), "digest", "left")
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; see ``turns`` and ``trie`` for odd rows."""
    return trie(turns(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt from their leads' first turns."""
    placed = materialize(turns(conversations), "turns")
    out = trie(rebuilt(placed))
    discard(placed)
    return out


#: The trie of rebuilt conversations in SQL; crc32 bit by bit.
ORACLE = """
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS place, {'r': role, 't': text} AS turn FROM t),
    ids AS (SELECT DISTINCT c, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)) AS bytes FROM t),
    h AS (SELECT c, xor(list_reduce(list_concat([4294967295], bytes), lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)),
              lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM ids),
    own AS (SELECT p.c, place, turn FROM p JOIN h ON p.c = h.c WHERE place > h),
    taken AS (SELECT h.c, place, turn FROM h JOIN p ON p.c = h.c - h.c % 100 WHERE place <= h),
    lists AS (SELECT h.c, coalesce(list(r.turn ORDER BY r.place) FILTER (r.place IS NOT NULL), []) AS ts FROM h LEFT JOIN (SELECT * FROM own UNION ALL SELECT * FROM taken) r ON r.c = h.c GROUP BY h.c),
    prefix AS (SELECT c, d, ts[1:d] AS key, len(ts) = d AS last FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM lists)),
    nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, bool_and(last) AS childless, CASE WHEN d = 0 THEN 0 ELSE length(key[d].t) END AS chars,
              sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM prefix GROUP BY d, key),
    up AS (SELECT k, key[1:k] AS top, (n - 1) * chars AS value, CASE WHEN childless THEN 1 ELSE 0 END AS leaf, CASE WHEN k = d - 1 THEN 1 ELSE 0 END AS child
           FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes)),
    sums AS (SELECT k, top, sum(value) AS value, sum(leaf) AS leaf, sum(child) AS child FROM up GROUP BY k, top)
    SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, CAST(child AS BIGINT) AS n_children, CAST(leaf AS BIGINT) AS n_leaves, CAST(value AS BIGINT) AS saved_tokens, a.ends_sha256
    FROM nodes a JOIN sums ON k = a.d AND top = a.key LEFT JOIN nodes b ON b.d = a.d - 1 AND a.d > 0 AND b.key = a.key[1:a.d - 1]
"""
