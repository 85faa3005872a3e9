"""Boilerplate lines by site-relative frequency.

A host's documents are its pages; by default copies of a text count as one
page, so a thousand copies of an article don't make its lines boilerplate. The
pages that contain a line (spaces trimmed) are divided by the host's page
total, and a line that stands on two pages or more and exceeds ``ratio`` is
dropped from all of that host's documents, at every host size. All steps are
DataFrame functions. Lines travel as 128-bit hashes and are counted before
each shuffle. A page meets its own boilerplate in a join on host and line, so
no host's lines are ever gathered in one row. Texts don't move as long as the
pages with boilerplate are a small table, measured in bytes; beyond, only those
of pages that may hold some do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, meet, packed

RATIO = 0.05


def _key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(11), text)


def _line_key(line: Column) -> Column:
    one, two = _key(line)
    return F.struct(one.alias("h1"), two.alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def pages(docs: DataFrame, host: str = "source") -> DataFrame:
    """``host, p1, p2, copies, lines``: each distinct text of a host, how often it occurs, and the keys of its lines."""
    text = F.col("text").cast("string")
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(text), lambda s: F.trim(s)), lambda s: s != ""), _line_key))
    p1, p2 = _key(text)
    rows = docs.where(text.isNotNull()).select(_host(host).alias("host"), p1.alias("p1"), p2.alias("p2"), keys.alias("lines"))
    return rows.groupBy("host", "p1", "p2").agg(F.count("*").alias("copies"), F.any_value("lines").alias("lines"))


def boilerplate(found: DataFrame, ratio: float = RATIO, distinct_pages: bool = True) -> DataFrame:
    """``host, line``: the boilerplate of each host, from the table ``pages``."""
    weight = F.lit(1).cast("long") if distinct_pages else F.col("copies")
    totals = materialize(found.groupBy("host").agg(F.sum(weight).alias("total")), "totals")
    lines = found.select("host", weight.alias("w"), F.explode("lines").alias("line"))
    hits = lines.groupBy("host", "line").agg(F.sum("w").alias("n")).where("n >= 2")
    return hits.join(totals, "host").where(F.col("n") > ratio * F.col("total")).select("host", "line")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, distinct_pages: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``n_lines``, ``n_dropped`` (long) added.

    A null text stays null with no lines. A null host counts as the empty
    host. Blank lines are never boilerplate. A line at exactly the ratio
    stays. Rows are neither dropped nor merged; repeated rows are copies of a
    page, one page or several by ``distinct_pages``. An empty table stays
    empty. A long text is one row of line keys, and no step gathers more.
    Columns named n_lines or n_dropped are replaced; all others keep their
    names and values.
    """
    found = materialize(pages(docs, host), "pages")
    bad = materialize(boilerplate(found, ratio, distinct_pages), "boilerplate")
    # per page at most its own lines
    hits = found.select("host", "p1", "p2", F.explode("lines").alias("line")).join(bad, ["host", "line"])
    hits = materialize(hits.groupBy("host", "p1", "p2").agg(F.collect_list("line").alias("bad")), "page-lines")
    discard(found, bad)
    p1, p2 = _key(F.col("text").cast("string"))
    marked = meet(packed(docs, host=_host(host), p1=p1, p2=p2), ["host", "p1", "p2"], hits, "left", 16 * F.size("bad") + F.length("host"))
    lines = _lines(F.col("row").getField("text").cast("string"))
    stay = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda s: ~F.array_contains(F.col("bad"), _line_key(F.trim(s)))))
    out = marked.withColumn("stay", stay).select(
        *[(F.array_join("stay", "\n") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("stay"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out


def cut_lines(docs: DataFrame) -> DataFrame:
    """The documents with boilerplate cut and n_chars counted anew; one that was nothing but boilerplate goes.

    Columns are those of ``docs``, whatever their names.
    """
    cut = drop_boilerplate(packed(docs, text=F.col("text"), source=F.col("source"))).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    changed = F.col("n_dropped") > 0

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == "text":
            return F.when(changed, F.col("text").cast(docs.schema["text"].dataType)).otherwise(old).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return cut.select(*[column(c) for c in docs.columns])
