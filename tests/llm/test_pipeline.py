"""The pipeline against its stages' brute-force versions, and all operators on awkward tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tramline.llm import common, dart_minhash, decontaminate, license_scan, line_dedup, pfair_mix, pii, quality, token_counts, toxicity, warc
from tramline.llm.common import split_by

from .test_corpus_operators import brute_classes, brute_items, brute_lines, slow_schedule
from .test_text_operators import brute_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"
#: Names that a careless operator would use itself.
CLASHES = "row host page p1 p2 lines bad stay copies line src key range at nth turn first q total horizon id items _items _text _src _host _bad hashes iid node class_id cluster fences base_failed n_words kept m t".split()


def corpus(n=220):
    rng = random.Random(21)
    word = lambda: rng.choice("bcdfgl") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") + str(rng.randint(0, 300)) * rng.randint(0, 1)
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(50, None), (None, "x y z"), (51, "")]
    rows, i = [], 0
    for _ in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(4, 16))) for _ in range(rng.randint(3, 8))]
        source, lang = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "de", None])
        if source == "a" and rng.random() < 0.5:
            lines.append("read more on our site")
        if rng.random() < 0.08:
            lines.insert(1, items[rng.randrange(6)][1])
        if rng.random() < 0.08:
            lines = [x.replace(" ", "### ") for x in lines]
        rows.append((i, "\n".join(lines), lang, source))
        i += 1
        for k in range(rng.choice([0, 0, 0, 0, 1, 2, 4])):
            near = "\n".join(lines).split(" ")
            near[rng.randrange(len(near))] = f"zz{k}"
            rows.append((i, " ".join(near) if k else "\n".join(lines), lang, source))
            i += 1
    rows += [(i, None, None, None), (i + 1, "", "en", "a"), (i + 2, "one two", "en", "a"), (i + 3, "read more on our site\n" * 12, "en", "a"), (i + 4, "tick " * 4000, "en", "b")]
    return [(d, t, la, s, len(t or "")) for d, t, la, s in rows], items


def brute_pipeline(docs, items):
    kept = [r for r, (_, fine) in zip(docs, brute_kept([r[1:4] for r in docs]), strict=True) if fine]
    cut = brute_lines([(r[0], r[1], r[3]) for r in kept], line_dedup.RATIO)
    kept = [(r[0], t, r[2], r[3], len(t) if gone else r[4]) for r, (_, t, _, gone) in zip(kept, cut, strict=True) if not gone or t.strip()]
    best = dict(brute_classes([(r[0], r[1], r[3]) for r in kept]))
    kept = [r for r in kept if best[r[0]] == r[0]]
    return [r for r in kept if not any(t and brute_items(r[1], t) for k, t in items if k is not None)]


@pytest.mark.parametrize("small", [common.SMALL_BYTES, -1])
def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch, small):
    # with key tables of any size: broadcast, and behind a filter
    monkeypatch.setattr(common, "SMALL_BYTES", small)
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = brute_pipeline(docs, items)
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert 0.4 * len(docs) < len(want) < 0.9 * len(docs)
    # the schedule: earliest deadline first over the default weights
    sizes = Counter(r[3] or "" for r in want)
    roots = {s: int(n**0.5 * 1000) for s, n in sizes.items()}
    order = slow_schedule({s: max(1, 1000 * r // sum(roots.values())) for s, r in roots.items()})
    blocks = {r.slot: r.source or "" for r in got if r.in_mix}
    assert blocks and all(order[s % len(order)] == x for s, x in blocks.items()) and sorted(blocks) == list(range(len(blocks)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_awkward_tables(spark, tmp_path, name):
    docs, items = corpus(12)
    spark.createDataFrame(items, BENCH).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = [c for c in CLASHES]
    odd = docs + [(None, None, None, None, None), (None, "a b c " * 9, "en", None, 3), docs[0], docs[0]]
    schema = ", ".join([SCHEMA, *(f"`{c}` string" for c in extra)])
    df = spark.createDataFrame([(*r, *(f"{c} {r[0]}" if i % 2 else None for i, c in enumerate(extra))) for r in odd], schema).checkpoint()
    out = stage(spark, df, f"file://{tmp_path}")
    assert out.columns[: len(df.columns)] == df.columns and (name == "mixing" or out.columns == df.columns)
    given = {(r.doc_id, tuple(r[c] for c in extra)) for r in df.collect()}
    rows = out.collect()
    assert rows and {(r.doc_id, tuple(r[c] for c in extra)) for r in rows} <= given
    plain = stage(spark, df.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")), f"file://{tmp_path}").collect()
    assert Counter(r.doc_id for r in plain) == Counter(r.doc_id for r in rows)
    assert stage(spark, df.limit(0), f"file://{tmp_path}").count() == 0
    # all columns null
    nothing = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    left = stage(spark, nothing, f"file://{tmp_path}").count()
    assert left == (0 if name == "quality_rules" else 3)


def test_operators_on_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], BENCH)
    labels, pages = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "page_id long, url string, html string")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    results = [
        warc.round_trip(pages), dart_minhash.near_duplicates(docs), dart_minhash.keep_representatives(docs), pii.find(docs), toxicity.score(docs, toxicity.fit(docs, labels)),
        quality.verdicts(docs, "doc_id"), quality.keep_good(docs), license_scan.scan(docs), line_dedup.drop_boilerplate(docs), line_dedup.cut_lines(docs),
        token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), pfair_mix.mix(docs), decontaminate.contaminated(docs, bench), decontaminate.drop_contaminated(docs, bench),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_operators_ignore_clashing_columns(spark):
    docs, items = corpus(10)
    extra = [c for c in CLASHES if c not in ("doc_id", "text")]
    plain = spark.createDataFrame(docs, SCHEMA)
    wide = spark.createDataFrame([(*r, *extra) for r in docs], ", ".join([SCHEMA, *(f"`{c}` string" for c in extra)]))
    bench = spark.createDataFrame([(*r, "u", "v") for r in items], BENCH + ", hash string, place string")
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2, "x") for r in docs], "doc_id long, quality int, toxic int, text string")
    for run in (
        dart_minhash.near_duplicates, pii.find, lambda d: toxicity.score(d, toxicity.fit(d, labels)).drop("passages"), lambda d: quality.verdicts(d, "doc_id"),
        license_scan.scan, lambda d: decontaminate.contaminated(d, bench),
    ):
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(plain).collect()))
    again = quality.verdicts(wide, "doc_id", "n_words", "kept", "host")
    assert again.columns.count("n_words") == again.columns.count("kept") == 1 and "host" in again.columns


def test_rows_are_split_by_what_a_key_table_may_hold(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 7 AS other")
    held = spark.range(0, 20_000, 50).select("id").checkpoint()
    some, none = split_by(rows, ["id"], held)
    a, b = {r.id for r in some.collect()}, {r.id for r in none.collect()}
    assert a | b == set(range(20_000)) and not a & b and set(range(0, 20_000, 50)) <= a and len(a) < 4000
    some, none = split_by(rows, ["id"], held.limit(0))
    assert some.count() == 0 and none.count() == 20_000
