"""Licence scan by canonical digests.

A text is canonicalised whole: lower case, punctuation and white space to
single spaces, copyright lines and titles dropped, lines joined, and then equivalent
spellings made one, so neither wrapping nor a spelling across a line break
matters. The digest of the canonical text is hash-joined to the digests of
known licence texts; so are the digests of its single lines, which finds
one-line notices inside other text. Known texts are a table and may be given;
the default holds public licence texts and notices. Only lines of a length
that some known text has are looked up, and only digests move, never texts.
The SQL form of the same steps comes from the same constants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .license_texts import DIGESTS, LICENSES
from .textkernel import slices

#: Pattern -> replacement on a lower-cased line, in this order; the same in RE2 and Python.
PATTERNS = [
    (r"\(c\)|©", " copyright "),
    (r"https?://", " "),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—]+", " "),
]
#: Equivalent spellings in canonical text, in this order.
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
]
#: A line that starts with copyright names its owner, unless it goes on as a sentence of a licence does.
COPYRIGHT = r"^(portions )?copyright |^all rights reserved$"
SENTENCE = r"^(portions )?copyright (notices?|statements?|representations?|you|holders?|owners?|licen[sc]es?|laws?|law or|rights?|interests?|treat(y|ies)|protection|permission|permissions|disclaimers?|acts?|registration|infringement|resulting|relinquished|exceptions?|also|and|or|is|are|in|to|of|on|for|by any|with|that|this|under|as used|treatment|doctrines?|status|term|terms|works?|ownership|assignment|claims?|line|lines|page|information|file|files|directory|legend|as a|applies|if|does|may|shall|will|can|the)( |$)"
#: A line that is a licence's title and no part of its text.
TITLE = r"^(the )?(mit|isc|zlib|x11|((new|modified|simplified|revised|original) )?bsd( [0-9] clause)?|[0-9] clause bsd|bsd zero clause|zero clause bsd|boost software) licen[sc]e( mit| x11| zlib| isc)?$"


def _spelled(text: pa.Array) -> pa.Array:
    for old, new in SPELLINGS:
        text = pc.replace_substring(text, old, new)
    return text


def _flat_lines(text: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Canonical lines of all texts, spellings apart, without empty and copyright lines; each text's offset into them; which are titles."""
    lines = pc.split_pattern(pc.fill_null(text.cast(pa.string()), ""), "\n")
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))])
    line = pc.utf8_lower(pc.list_flatten(lines))
    for pattern, to in PATTERNS:
        line = pc.replace_substring_regex(line, pattern, to)
    line = pc.utf8_trim(line, " ")
    owner = pc.and_not(pc.match_substring_regex(line, COPYRIGHT), pc.match_substring_regex(line, SENTENCE))
    stay = pc.and_(pc.not_equal(line, ""), pc.invert(owner))
    kept = np.concatenate([[0], np.cumsum(stay.to_numpy(zero_copy_only=False))])
    line = line.filter(stay)
    return line, kept[edge], pc.match_substring_regex(line, TITLE)


def canonical(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Canonical texts, without title lines; canonical lines; and each text's offset into the lines."""
    line, edge, title = _flat_lines(text)
    body = pc.invert(title)
    upto = np.concatenate([[0], np.cumsum(body.to_numpy(zero_copy_only=False))])
    lists = pa.ListArray.from_arrays(pa.array(upto[edge].astype(np.int32)), line.filter(body))
    return _spelled(pc.binary_join(lists, " ")), _spelled(line), edge


def canonical_text(text: str) -> str:
    return canonical(pa.array([text], pa.string()))[0][0].as_py()


def _sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """``digest, license, n_chars``: a table of known texts, from ``license, text`` or the built-in ones.

    A text given twice keeps the name that comes first in the alphabet. Rows
    without name, and texts that are empty when canonical, are left out.
    """
    if texts is None:
        rows = {(_sha(c), n, len(c)) for n, t in LICENSES for c in [canonical_text(t)]} | {(d, n, k) for n, d, k in DIGESTS}
        table = spark.createDataFrame(sorted(rows), "digest string, license string, n_chars long")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    whole = canonical(part.column("text"))[0].to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([_sha(x) for x in whole]), part.column("license"), pa.array([len(x) for x in whole], pa.int64())], names=["digest", "license", "n_chars"])

        table = texts.select(F.col("license").cast("string"), F.col("text").cast("string")).where("license IS NOT NULL AND text IS NOT NULL")
        table = table.mapInArrow(run, "digest string, license string, n_chars long").where("n_chars > 0")
    return table.groupBy("digest").agg(F.min("license").alias("license"), F.max("n_chars").alias("n_chars"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license, notices`` for every row of ``docs``.

    ``digest`` (SHA-256, hex) is of the whole canonical text, ``license`` the
    known licence with that digest or null, ``notices`` the sorted known
    licences whose text is a single line of the document. ``texts`` (license,
    text) replaces the built-in known texts. Null, blank and copyright-only
    texts have the digest of the empty text and no licence. Repeated rows each
    get a row; of equal known texts the first name holds. An empty table gives
    an empty result. A long text is canonicalised whole, alone in its slice.
    Other columns are ignored.
    """
    table = materialize(known(docs.sparkSession, texts), "known-licences")
    # as many as there are lengths of known texts, at most one per character of the longest
    sizes = pa.array([r[0] for r in table.select("n_chars").distinct().collect()], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                whole, line, edge = canonical(part.column("text"))
                fits = pc.is_in(pc.utf8_length(line).cast(pa.int32()), value_set=sizes)
                doc = np.repeat(np.arange(part.num_rows), np.diff(edge))[fits.to_numpy(zero_copy_only=False)]
                hashes = pa.array([_sha(x) for x in line.filter(fits).to_pylist()], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)), hashes)
                digest = pa.array([_sha(x) for x in whole.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), digest, lists], names=["doc_id", "k1", "k2", "digest", "lines"])

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"), text.alias("text"))
    slim = materialize(src.mapInArrow(run, "doc_id long, k1 long, k2 long, digest string, lines array<string>"), "licence-digests")
    names = table.select("digest", "license")
    hits = slim.select("k1", "k2", F.explode("lines").alias("digest")).join(names, "digest")
    hits = materialize(hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("license")).alias("notices")), "notices")
    found = slim.join(hits, ["k1", "k2"], "left").join(names, "digest", "left")
    return found.select("doc_id", "digest", "license", F.coalesce("notices", F.expr("CAST(array() AS array<string>)")).alias("notices"))


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    line = "lower(s)"
    for pattern, to in PATTERNS:
        line = f"regexp_replace({line}, {quote(pattern)}, {quote(to)}, 'g')"

    def spelled(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return x

    rows: dict[str, str] = {}
    for d, n in sorted([(_sha(canonical_text(t)), n) for n, t in LICENSES] + [(d, n) for n, d, _ in DIGESTS]):
        rows.setdefault(d, n)
    values = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in rows.items())
    return f"""
        WITH known(kd, kl) AS (VALUES {values}),
        raw AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        cut AS (SELECT r, doc_id, list_filter(list_transform(ls, lambda s: trim({line})), lambda s: s <> '' AND NOT (regexp_matches(s, {quote(COPYRIGHT)}) AND NOT regexp_matches(s, {quote(SENTENCE)}))) AS ls FROM raw),
        dig AS (SELECT r, doc_id, list_transform(ls, lambda s: {spelled("s")}) AS ls, sha256({spelled(f"array_to_string(list_filter(ls, lambda s: NOT regexp_matches(s, {quote(TITLE)})), ' ')")}) AS digest FROM cut),
        hits AS (SELECT r, list_sort(list_distinct(list(kl))) AS notices FROM (SELECT r, unnest(ls) AS s FROM dig) JOIN known ON sha256(s) = kd GROUP BY r)
        SELECT d.doc_id, d.digest, k.kl AS license, coalesce(h.notices, CAST([] AS VARCHAR[])) AS notices
        FROM dig d LEFT JOIN known k ON d.digest = k.kd LEFT JOIN hits h ON h.r = d.r
    """
