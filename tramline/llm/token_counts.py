"""Token counts by counting pieces once per distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's token count is
the sum over its pre-tokens of their piece counts. A batch of whole texts is
cut into pre-tokens, each distinct one is numbered, its pieces are counted
once, and the counts are joined to the documents' pre-token frequencies and
summed, with no id ever kept. Strings of special tokens are cut out first and
count one each, as the tokenizer library does by default.

The join lives inside the task. A join across the cluster would shuffle a row
per document and distinct pre-token, about 300 a document, which is more bytes
than the texts themselves; a task instead remembers the counts of pre-tokens of
up to ``MEMO`` characters together and starts afresh beyond that. Pre-tokens
above ``LONGEST`` characters are counted and not remembered, so memory stays
bounded and a lost executor costs only its own batches.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

#: Characters of remembered pre-tokens, each counted with ``ENTRY`` more for its place; the longest one remembered.
MEMO, ENTRY, LONGEST = 16_000_000, 64, 256
#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceCounter:
    """Pieces of pre-tokens by a tokenizer file; remembers a bounded number of them."""

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("needs a byte-level tokenizer without normalizer and prefix space")
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}
        self.held = 0

    def pieces(self, distinct: list[str]) -> list[int]:
        """Piece counts of pre-tokens, each encoded at most once while it is remembered."""
        out = [self.memo.get(p, -1) for p in distinct]
        new = [i for i, n in enumerate(out) if n < 0]
        for s in range(0, len(new), 4096):
            part = new[s : s + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch([distinct[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e)
                size = len(distinct[i])
                if size <= LONGEST:
                    if self.held + size + ENTRY > MEMO:
                        self.memo, self.held = {}, 0
                    self.memo[distinct[i]] = out[i]
                    self.held += size + ENTRY
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of whole texts; null is empty."""
        number: dict[str, int] = {}
        doc, ident, freq = [], [], []
        total = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            seen: Counter[str] = Counter()
            parts = [text]
            if self.special is not None and self.special.search(text):
                total[i] += sum(1 for _ in self.special.finditer(text))
                parts = self.special.split(text)
            for part in parts:
                seen.update(self.split.findall(part))
            for p in seen:
                ident.append(number.setdefault(p, len(number)))
            freq.extend(seen.values())
            doc.extend([i] * len(seen))
        if doc:
            size = np.array(self.pieces(list(number)), dtype=np.int64)
            np.add.at(total, np.array(doc), size[np.array(ident)] * np.array(freq, dtype=np.int64))
        return total


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer_path`` is read where the query is built and its text is sent
    to the tasks. Null and empty texts have no bytes and no tokens, an empty
    table gives an empty result. A text of exactly ``limit`` tokens is not over
    it. A long text is cut whole, alone in its slice. Repeated rows each get a
    row; other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            for part in slices(batch):
                n = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(n)], names=["doc_id", "text", "n_tokens"])

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for part in run(batches):
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, part.column("n_tokens")], names=["doc_id", "n_bytes", "n_tokens"])

    return src.mapInArrow(slim, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
