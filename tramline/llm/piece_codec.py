"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text's characters are symbols in a row; an agenda holds every adjacent pair
whose union is a piece, the best score first and the leftmost of equal ones,
and the first pair of the agenda is merged until none is left. Pieces hold the
white-space mark only in front, so no merge crosses from another character to
a mark: a text is cut there into segments, each distinct segment is encoded
once, and a text's ids are its segments' ids in a row.

Short segments stand as rows of an array, the agenda of each is its row of pair
ranks, and all take their next merge together. Longer ones are cut wherever
two neighbours stand in no piece, and what is still long has a heap for its
agenda. Every segment that is encoded is checked against the library
within its Arrow batch; a difference is an error.

A Python worker remembers the ids of ``MEMO`` segments of up to ``LONGEST``
characters, and of as many that came before them. Nothing leaves the task but the result, so
a lost executor costs its own batches only.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

#: Segments a worker remembers, the longest one among them, and characters up to which a segment is a row of an array.
MEMO, LONGEST, ROW = 400_000, 64, 32
#: Rows of one array, characters of one array of characters, ids decoded at once.
ROWS, PART = 1 << 14, 1 << 16
MARK = "▁"
_SHIFT = 21
_NEVER = np.iinfo(np.int32).max
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The tables of one model file.

    A symbol is the id of its piece, or the size of the vocabulary plus its code
    point where a character is no piece. The model must be of merge type with
    byte fallback, without normalisation rules, user-defined or unused pieces.
    """

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        norm, train, kinds = model.normalizer_spec, model.trainer_spec, model.SentencePiece
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type vocabulary with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("needs a vocabulary without normalisation rules")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not known here")
        self.library = SentencePieceProcessor(model_proto=data)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.size = len(model.pieces)
        self.byte = np.zeros(256, dtype=np.uint32)
        self.surface: list[bytes] = []
        piece: dict[str, int] = {}
        for i, p in enumerate(model.pieces):
            text = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                text = bytes([value])
            elif p.type == kinds.CONTROL:
                text = b""
            elif p.type == kinds.UNKNOWN:
                text = train.unk_surface.encode()
            else:
                piece[p.piece] = i
            self.surface.append(text)
        self.bytes_of = {int(i) for i in self.byte}
        self.silent = np.array([i for i, x in enumerate(self.surface) if not x])
        self.marked = {i for w, i in piece.items() if w.startswith(MARK)}
        self.by_marks = not any(MARK in w.lstrip(MARK) for w in piece)
        self.symbol = {w: i for w, i in piece.items() if len(w) == 1}
        at_char = np.arange(0x110000, dtype=np.int32) + self.size
        for w, i in self.symbol.items():
            at_char[ord(w)] = i
        self.at_char = at_char
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        bigrams: set[int] = set()
        for w, i in piece.items():
            bigrams.update(ord(a) << _SHIFT | ord(b) for a, b in zip(w, w[1:], strict=False))
            for k in range(1, len(w)):
                a, b = (piece.get(x, self.size + ord(x) if len(x) == 1 else None) for x in (w[:k], w[k:]))
                if a is not None and b is not None:
                    pairs[a << _SHIFT | b] = (order[model.pieces[i].score], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.union = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.bigrams = np.array(sorted(bigrams), dtype=np.int64)
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and unions of symbol pairs; pairs that never merge, and those with a negative symbol, have the last rank."""
        key = a.astype(np.int64) << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NEVER), self.union[at]

    def rows(self, segments: list[str]) -> list[bytes]:
        """Packed ids of short segments after all merges: one agenda a row, one merge of each row a step."""
        n, width = len(segments), max(map(len, segments))
        size = np.array([len(s) for s in segments])
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        filled = np.arange(width) < size[:, None]
        sym = np.full((n, width + 1), -1, dtype=np.int32)
        sym[:, :width][filled] = self.at_char[chars]
        rank = np.full((n, width + 1), _NEVER, dtype=np.int32)
        union = np.zeros((n, width + 1), dtype=np.int32)
        rank[:, :width], union[:, :width] = self.look_up(sym[:, :-1], sym[:, 1:])
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            some = rank[live, best] < _NEVER
            live, best = live[some], best[some]
            right = after[live, best]
            beyond = after[live, right]
            sym[live, best] = union[live, best]
            sym[live, right] = -1
            rank[live, right] = _NEVER
            after[live, best] = beyond
            inside = beyond <= width
            before[live[inside], beyond[inside]] = best[inside]
            # the union's pairs with its neighbours enter the agenda; a row's last column is never a symbol
            left = before[live, best]
            first = left < 0
            a = np.concatenate([np.where(first, -1, sym[live, left]), sym[live, best]])
            b = np.concatenate([sym[live, best], sym[live, np.minimum(beyond, width)]])
            r, u = self.look_up(a, b)
            m = len(live)
            rank[live, best], union[live, best] = r[m:], u[m:]
            keep = ~first
            rank[live[keep], left[keep]], union[live[keep], left[keep]] = r[:m][keep], u[:m][keep]
        found = sym >= 0
        return self._packed(sym[found], found.sum(axis=1))

    def heap(self, segment: str) -> bytes:
        """Packed ids of one long segment after all merges: a heap of (rank, place, both symbols)."""
        sym = self.at_char[np.frombuffer(segment.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []
        pairs = self.pairs

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := pairs.get(sym[i] << _SHIFT | sym[j])):
                heapq.heappush(agenda, (p[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = pairs[a << _SHIFT | b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            enter(before[i], i)
            enter(i, after[i])
        out = np.array(sym, dtype=np.int32)
        out = out[out >= 0]
        return self._packed(out, np.array([len(out)]))[0]

    def cut(self, segment: str) -> list[str]:
        """A long segment in parts between which no merge can be, since no piece holds both neighbours."""
        out, open_ = [], ""
        for s in range(0, len(segment), PART):
            part = open_ + segment[s : s + PART]
            chars = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            key = chars[:-1] << _SHIFT | chars[1:]
            at = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
            ends = [0, *(np.flatnonzero(self.bigrams[at] != key) + 1).tolist()]
            out += [part[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            open_ = part[ends[-1] :]
        return [*out, open_]

    def _packed(self, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Packed ids of each run of symbols: a symbol without a piece becomes its bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            own = [chr(c).encode() for c in (symbols[odd] - self.size).tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[odd] = [len(x) for x in own]
            wide = np.repeat(symbols, times)
            wide[wide >= self.size] = self.byte[np.frombuffer(b"".join(own), dtype=np.uint8)]
            counts = np.add.reduceat(times, np.cumsum(counts) - counts)
            symbols = wide
        data = symbols.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _short(self, segments: list[str]) -> Iterator[tuple[str, bytes]]:
        segments.sort(key=len)
        for k in range(0, len(segments), ROWS):
            group = segments[k : k + ROWS]
            yield from zip(group, self.rows(group), strict=True)

    def _long(self, segments: list[str]) -> Iterator[tuple[str, bytes]]:
        for s in segments:
            parts = self.cut(s)
            known = dict(self._short([x for x in set(parts) if len(x) <= ROW]))
            yield s, b"".join(known[x] if x in known else self.heap(x) for x in parts)

    def _checked(self, known: dict[str, bytes]) -> dict[str, bytes]:
        """The same segments, held against the library's ids; a lone prefix, which the library never sees alone, is no merge."""
        lead, alone = len(self.prefix), known.pop(self.prefix, None)
        theirs = self.library.encode([s[lead:].replace(MARK, " ") for s in known], num_threads=1)
        counts = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), dtype="<u4", count=int(counts.sum()))
        if flat.tobytes() != b"".join(known.values()) or (4 * counts).tolist() != list(map(len, known.values())):
            odd = next(s for (s, ids), x in zip(known.items(), theirs, strict=True) if np.array(x, dtype="<u4").tobytes() != ids)
            raise ValueError(f"the library encodes {odd[:80]!r} otherwise")
        return known if alone is None else {**known, self.prefix: alone}

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", MARK)
        return _SEGMENT.findall(text) if self.by_marks else [text]

    def encode(self, texts: list[str | None], check: bool = True) -> list[bytes]:
        """Packed ids of whole texts, begin and end ids around them; null is empty."""
        cut = [self.segments(t or "") for t in texts]
        distinct = set().union(*cut)
        new = distinct.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            # what is in use is taken over from the memory before
            self.memo, self.before = {}, self.memo
            new = distinct
        if self.before:
            old = {s: self.before[s] for s in new if s in self.before}
            self.memo.update(old)
            new = new.difference(old)
        short = [s for s in new if len(s) <= ROW]
        known = dict(self._short(short))
        long = [s for s in new if len(s) > ROW] if len(short) < len(new) else []
        known.update(self._long(long))
        self.memo.update(self._checked(known) if check else known)
        a, b = np.array([[self.begin], [self.end]], dtype="<u4")
        out = [b"".join([a.tobytes(), *map(self.memo.__getitem__, s), b.tobytes()]) for s in cut]
        for s in long:
            if len(s) > LONGEST:
                del self.memo[s]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: one mark that the prefix made goes, bytes are joined, each byte that is no UTF-8 becomes a replacement."""
        surface, out, lead = self.surface, [], True
        for s in range(0, len(ids), PART):
            part = ids[s : s + PART].tolist()
            if lead:
                first = next((k for k, i in enumerate(part) if surface[i]), None)
                if first is not None:
                    lead = False
                    if self.prefix and part[first] in self.marked:
                        out.append(surface[part[first]][1:])
                        part = part[first + 1 :]
            out.append(b"".join(map(surface.__getitem__, part)))
        text = b"".join(out)
        try:
            text.decode()
        except UnicodeDecodeError:
            return self._by_runs(ids)
        return self._by_runs(ids) if np.isin(ids[1:-1], self.silent).any() else text

    def _by_runs(self, ids: np.ndarray) -> bytes:
        """The same where a run of bytes is broken or no UTF-8."""
        out, run, lead = [], bytearray(), True

        def close() -> None:
            while run:
                try:
                    out.append(run.decode().encode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode().encode() + "�".encode())
                    del run[: e.start + 1]

        for i in ids.tolist():
            if i in self.bytes_of:
                run += self.surface[i]
                lead = False
                continue
            close()
            text = self.surface[i]
            if lead and text:
                lead = False
                text = text[1:] if self.prefix and i in self.marked else text
            out.append(text)
        close()
        return b"".join(out)


_loaded: dict[bytes, Pieces] = {}


def _pieces(data: bytes) -> Pieces:
    """The tables of a model, made once in a Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(data)
    return _loaded[key]


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """``doc_id, ids`` (array of int, begin and end ids included) for every row of ``docs``; see ``round_trip`` for odd rows."""
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            for part in slices(batch):
                found = pieces.encode(part.column("text").to_pylist(), check)
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)])
                flat = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(table: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. Null ids are none; an id that the vocabulary lacks is an error."""
    shared = _shared(table, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], dtype=np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return table.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    Ids are those of the whole text with begin and end ids, digested as
    little-endian unsigned 32-bit integers; the decoded text is made from the
    ids alone. A null text is empty and has the two ids; an empty table gives an
    empty result. Repeated rows each get a row, a null doc_id stays null,
    other columns are ignored. A long text is alone in its slice; memory
    grows with the longest text, not with the table.
    """
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            for part in slices(batch):
                n, ids_hex, text_hex = [], [], []
                for ids in pieces.encode(part.column("text").to_pylist(), check):
                    n.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(pieces.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
