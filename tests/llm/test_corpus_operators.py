"""Operators that look across rows, against brute force on small tables with awkward rows."""

import base64
import hashlib
import math
import os
import random
import re
import textwrap
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tramline.llm import dart_minhash, decontaminate, license_scan, line_dedup, pfair_mix, queries, warc
from tramline.llm.components import components
from tramline.llm.license_texts import LICENSES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"z{rng.randint(0, 10_000)}"
    return out


def brute_classes(rows):
    """Least id of each row's class: components of weighted Jaccard >= 0.8 on five-word shingles."""
    bags = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] is not None and bags[j] is not None:
                low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
                if low >= 0.8 * high:
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for n, (i, _, _) in enumerate(rows):
        groups[find(n)].append(i)
    return sorted((i, min(g)) for g in groups.values() for i in g)


def near_rows():
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(25):
        base = prose(rng, rng.randint(3, 250))
        for k in (0, 0, 1, 2, 4, 8, 16):
            rows.append((i, " ".join(edited(rng, base, k)), "s"))
            i += 1
    chain = prose(rng, 300)
    for _ in range(12):
        rows.append((i, " ".join(chain), "s"))
        chain = edited(rng, chain, 4)
        i += 1
    rows += [(i + k, t, "s") for k, t in enumerate([None, "", " \n", "one", "ONE", "a b c", "a b c", "same line\n" * 50, "same line\n" * 60, "x" * 50_000])]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = dart_minhash.near_duplicates(frame(spark, rows).withColumnRenamed("lang", "class_id")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_blocks_find_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 3)
    monkeypatch.setattr(dart_minhash, "BLOCK_BYTES", 4000)
    rows = near_rows()
    got = dart_minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    el = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 9, 60), rng.uniform(0.1, 9, 60)
    a[:10], b[10:20] = 0, 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    keep_a, keep_b = a > 0, b > 0
    k = 4000
    sig = dart_minhash.signatures(np.concatenate([el[keep_a], el[keep_b]]), np.repeat([0, 1], [keep_a.sum(), keep_b.sum()]), np.concatenate([a[keep_a], b[keep_b]]), 2, k)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)


def test_representatives_keep_one_of_each_class(spark):
    rows = near_rows() + [(0, near_rows()[0][1], "s"), (None, "only here " * 9, "s")]
    left = dart_minhash.keep_representatives(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {c for _, c in brute_classes(near_rows())}
    got = [r.doc_id for r in left.collect()]
    assert Counter(got) == Counter(list(want) + [None])


def test_near_duplicates_of_nothing(spark):
    assert dart_minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert dart_minhash.keep_representatives(frame(spark, [(1, None, "s")])).count() == 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# ---- lines

def brute_lines(rows, ratio, distinct_pages=True):
    pages = defaultdict(set if distinct_pages else list)
    for _, t, s in rows:
        if t is not None:
            (pages[s or ""].add if distinct_pages else pages[s or ""].append)(t)
    bad = {}
    for host, ts in pages.items():
        n = Counter(line for t in ts for line in {x.strip(" ") for x in t.split("\n")} if line)
        bad[host] = {x for x, k in n.items() if k >= 2 and k > ratio * len(ts)}
    out = []
    for i, t, s in rows:
        keep = None if t is None else [x for x in t.split("\n") if x.strip(" ") not in bad.get(s or "", ())]
        out.append((i, None if t is None else "\n".join(keep), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(keep)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lines = [f"line {rng.randint(0, 80)}" for _ in range(rng.randint(0, 9))] + (["Share this"] if i % 3 else []) + ([" Share this "] if i % 7 == 0 else [])
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None, "small"] if i < 10 else ["a", "b", None])))
    rows += [(400, None, "a"), (401, "", "a"), (402, "Share this\n" * 3000, "a"), (403, rows[0][1], rows[0][2]), (None, "Share this", None)] + [(500 + i, "copied article\nwith two lines", "a") for i in range(200)]
    df = frame(spark, rows).withColumnRenamed("lang", "n_lines")
    for distinct in (True, False):
        got = line_dedup.drop_boilerplate(df, ratio=0.1, distinct_pages=distinct).select("doc_id", "text", "n_lines", "n_dropped").collect()
        want = brute_lines(rows, 0.1, distinct)
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert ("copied article" in next(r.text for r in got if r.doc_id == 500)) is distinct
    cut = line_dedup.cut_lines(frame(spark, rows))
    assert cut.columns == df.withColumnRenamed("n_lines", "lang").columns
    assert line_dedup.drop_boilerplate(frame(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_line_dedup_at_every_host_size(spark):
    rows = [(100 * n + i, f"page {i} of {n}\nAll pages of this host", f"h{n}") for n in (3, 9, 19, 20) for i in range(n)]
    rows += [(9000 + i, f"first words {i}\nthe rest is the same\non both pages", "pair") for i in range(2)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(frame(spark, rows)).collect()}
    assert got == {i: (len(t.split("\n")) - 1, t.split("\n")[0]) for i, t, h in rows}


# ---- mixing

def slow_schedule(q):
    """Earliest deadline first over Pfair windows, slot by slot."""
    total, done, out = sum(q.values()), dict.fromkeys(q, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // q[s]), q[s], s) for s in sorted(q) if done[s] < q[s] and done[s] * total // q[s] <= t]
        s = min(ready)[2]
        out.append(s)
        done[s] += 1
    return out


def test_period_is_earliest_deadline_first_with_lag_below_one(spark):
    for q in ({"a": 500, "b": 300, "c": 200}, {"a": 1}, {"a": 7, "b": 3, "c": 3, "d": 1, "e": 1}, {"x": 333, "y": 333, "z": 334}):
        rows = pfair_mix.period(spark.createDataFrame(list(q.items()), "src string, q long")).orderBy("slot").collect()
        divisor = math.gcd(*q.values())
        assert {(r.src, r.q * divisor, r.total * divisor) for r in rows} == {(x, k, sum(q.values())) for x, k in q.items()}
        got = [r.src for r in rows] * divisor
        assert got == slow_schedule(q)
        total, seen = sum(q.values()), Counter()
        for t, s in enumerate(got, 1):
            seen[s] += 1
            assert all(abs(q[x] * t - total * seen[x]) < total for x in q)


def test_a_period_of_a_hundred_thousand_slots_and_many_equal_sources(spark):
    start = time.time()
    for q in ({"a": 60_001, "b": 25_000, "c": 14_998, "d": 1}, {f"s{i}": 1 + i % 3 for i in range(3000)}):
        rows = pfair_mix.period(spark.createDataFrame(list(q.items()), "src string, q long")).collect()
        total = sum(q.values())
        assert sorted(r.slot for r in rows) == list(range(total)) and Counter(r.src for r in rows) == Counter(q)
        assert all(r.turn * total // q[r.src] <= r.slot < -(-(r.turn + 1) * total // q[r.src]) for r in rows)
    assert time.time() - start < 60
    with pytest.raises(Exception, match="period beyond"):
        pfair_mix.period(spark.createDataFrame([("a", 10**7), ("b", 1)], "src string, q long")).collect()


def test_mix_keeps_every_prefix_within_a_block(spark):
    rng = random.Random(6)
    rows = [(i, "t", rng.choice(["a"] * 12 + ["b", "b", "c", None])) for i in range(3000)] + [(None, "t", "a"), (5, "t", "a"), (5, "t", "a")]
    df = frame(spark, rows).withColumnRenamed("lang", "slot")
    got = pfair_mix.mix(df, block=4).collect()
    assert len(got) == len(rows) and not [c for c in df.columns if c not in got[0].asDict()][1:]
    blocks = sorted({(r.slot, r.source or "") for r in got if r.in_mix})
    assert [s for s, _ in blocks] == list(range(len(blocks)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    sizes = Counter((r.source or "", r.block) for r in got)
    assert all(n == 4 for (s, b), n in sizes.items() if (s, b + 1) in sizes)
    assert len({(r.source, r.block, r.place) for r in got}) == len(rows)


def test_mix_without_target_or_rows(spark):
    target = spark.createDataFrame([("a", 3), ("gone", 1)], "src string, q long")
    got = pfair_mix.mix(frame(spark, [(1, "t", "a"), (2, "t", "b")]), target).collect()
    assert {r.source: (r.slot is None, r.in_mix) for r in got}["b"] == (True, False)
    assert pfair_mix.mix(frame(spark, [(1, "t", "a")]).limit(0)).count() == 0


# ---- decontamination

def test_decontamination_catches_copies_and_new_parameters(spark):
    rng = random.Random(8)
    w = lambda n: " ".join(f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}{chr(97 + rng.randint(0, 25))}" for _ in range(n))
    item = "A train leaves at 9 and travels 60 km to the town where Alice waits for 9 hours before Alice walks home again slowly"
    moved = item.replace("9", "7").replace("60 km", "85 miles").replace("Alice", "Robert")
    mixed = item.replace("9", "7", 1).replace("Alice", "Robert")
    bench = spark.createDataFrame([(1, w(40)), (2, item), (3, w(5)), (4, None), (5, ""), (None, "zz"), (1, w(30)), (6, w(200))], "item_id long, text string")
    texts = {r.item_id: r.text for r in bench.collect() if r.text}
    big = texts[6]
    rows = [
        (0, w(300), []), (1, w(50) + " " + texts[3] + ", " + w(40), [3]), (2, w(30) + ".\n" + moved + "\n" + w(10), [2]), (3, w(20) + ". " + mixed, []),
        (4, None, []), (5, "", []), (6, w(9_000) + " " + big.upper(), [6]), (7, big[: len(big) // 2], [6]), (8, " ".join(big.split()[:9]), []), (9, item, [2]), (9, item, [2]),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, items string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, tuple(r.items)) for r in got) == sorted((i, tuple(x)) for i, _, x in rows)
    assert all(r.contaminated == bool(r.items) for r in got)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 3, 4, 5, 8]
    assert decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_windows(text):
    """Canonical tokens of a text without names: (token, word) with numbers and units as placeholders, by plain Python."""
    units, out = set(decontaminate.UNITS.split()), []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        w = w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "%"))
        if w:
            num = bool(re.fullmatch(r"[0-9][0-9.,:/%$-]*", w))
            unit = bool(out) and out[-1][0] == "NUM" and w in units
            out.append(("NUM" if num else "UNIT" if unit else w, w))
    return out


def brute_items(text, item):
    """The definition for lower-case texts, one pair of windows at a time."""
    d, b = brute_windows(text), brute_windows(item)
    size = min(len(b), 8)
    if not size:
        return False
    if size < 3:
        return [w for _, w in d] == [w for _, w in b]
    literal = lambda x, i: sum(t not in ("NUM", "UNIT") for t, _ in x[i : i + size]) >= 3
    at, of = range(len(d) - size + 1), range(len(b) - size + 1)
    same = [(p, q) for p in at for q in of if literal(b, q) and [t for t, _ in d[p : p + size]] == [t for t, _ in b[q : q + size]]]
    votes = defaultdict(dict)
    for p, q in same:
        for k in range(size):
            if b[q + k][0] in ("NUM", "UNIT"):
                votes[p - q][q + k] = (b[q + k][1], d[p + k][1])
    read = set()
    for p, q in same:
        fine = True
        for k in range(size):
            if q + k in votes[p - q]:
                mine, other = votes[p - q][q + k]
                all_of = [o for m, o in votes[p - q].values() if m == mine]
                fine &= 2 * all_of.count(other) > len(all_of)
        if fine or [w for _, w in d[p : p + size]] == [w for _, w in b[q : q + size]]:
            read.add(q)
    have = Counter(tuple(w for _, w in d[p : p + size]) for p in at)
    said, used = set(), Counter()
    for q in of:
        w = tuple(x for _, x in b[q : q + size])
        if used[w] < have[w]:
            used[w] += 1
            said.add(q)
    templates = sum(literal(b, q) for q in of)
    return len(read) >= min(6, templates) > 0 or len(read | said) >= min(6, len(of)) > 0


@pytest.mark.parametrize("common", [decontaminate.COMMON, 0, 1])
def test_decontamination_equals_brute_force(spark, monkeypatch, common):
    # also where windows of one or two items already count as common phrases
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(12)
    word = lambda: rng.choice(["red", "blue", "tall", "dog", "cat", "saw", "ran", "the", "of", "kg", "km", str(rng.randint(1, 9)), str(rng.randint(10, 99))])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 20, 30])))) for i in range(40)]
    docs = []
    for i in range(150):
        parts = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(items)[1].split()
            t = t[: rng.randint(1, len(t))] if rng.random() < 0.3 else t
            if rng.random() < 0.6:
                swap = {x: str(rng.randint(1, 99)) for x in t if x.isdigit()}
                t = [swap.get(x, x) if rng.random() < 0.95 else x for x in t]
            parts += t + [word() for _ in range(rng.randint(0, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(1000 + i, t) for i, t in items] + [(2000, " ".join(["the dog 5 saw"] * 400)), (2001, items[0][1] + " " + items[0][1])]
    items += [(100, "the dog 5 saw " * 6), (101, "the dog 5 saw " * 6 + "a 6")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: sorted(n for n, b in items if brute_items(t, b)) for i, t in docs}
    assert {r.doc_id: r.items for r in got} == want
    assert sum(bool(x) for x in want.values()) > 60


def test_long_repeats_in_runs_of_diagonals(monkeypatch):
    item, text = "the dog 5 saw " * 6 + "a 6 cat ran", "the dog 7 saw " * 300 + "a 8 cat ran " + "the dog 5 saw " * 50
    want = items_found(text, item)
    bench = decontaminate.Benchmark([1], [item])
    tokens = decontaminate.Tokens(*decontaminate.flat(pa.array([text])))
    whole = bench.probe(tokens)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert bench.probe(tokens) == whole and items_found(text, item) == want == [1]


def items_found(text, item):
    bench = decontaminate.Benchmark([1], [item])
    found = bench.probe(decontaminate.Tokens(*decontaminate.flat(pa.array([text])))).get(0, ())
    return [bench.ids[i] for i, *k in found if bench.enough(i, *k)]


def test_one_changed_repeat_does_not_hide_a_passage():
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(43)]
    words[10] = words[30] = "Paris"
    item = " ".join(words)
    assert items_found(item.replace("Paris", "Lyon", 1), item) == [1]
    # a value that stands for one value at most places; the odd place costs its own windows only
    words[5] = words[20] = words[38] = "Paris"
    item = " ".join(words)
    assert items_found(item.replace("Paris", "Rome").replace("Rome", "Lyon", 1), item) == [1]
    # two unrelated slots that share a value
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(40)]
    words[3] = words[38] = "9"
    item = " ".join(words)
    assert items_found(item.replace("9", "7", 1).replace("9", "5"), item) == [1]


def test_a_names_position_does_not_decide(monkeypatch):
    item = "Tom has 5 apples. Anna has 3 apples. Sam has 7 apples. How many apples do they have?"
    other = item.replace("Tom", "Bill").replace("Anna", "Joan").replace("Sam", "Rob")
    moved = other.replace(". ", ", ").replace("How", "how")
    odd = "green tea was poured while nobody looked at " + other.replace(" has", "\nhas")
    for text in (item, other, moved, odd, item.replace(" ", "\n")):
        assert items_found(text, item) == [1] and items_found(item, text) == [1]
    assert items_found("Tom had five pears. Anna had three plums. Sam got seven apples. How many apples do you want?", item) == []
    # many readings, in pieces
    lines = "\n".join(f"{c}el" for c in "ABCDEFGHIJKLMNOP")
    assert items_found(lines, lines) == [1]
    monkeypatch.setattr(decontaminate, "READINGS", 7)
    assert items_found(moved, item) == [1] and items_found(lines, lines) == [1]


def test_passages_of_numbers_and_names_are_compared_word_for_word():
    calc = "Compute 12 + 7 - 3 * 4 / 2 + 18 - 5 * 9 + 6 - 14"
    assert items_found("so then " + calc + ", he said", calc) == [1]
    assert items_found(calc.replace("18", "19"), calc) == []
    names = "The Grand Old Duke Of York Had Ten Thousand Men And One Small Dog"
    assert items_found("we sang\n" + names.lower(), names) == [1]
    # as many equal windows as the item has
    zeros = " ".join(["0"] * 30)
    assert items_found(zeros, zeros) == [1] and items_found(" ".join(["0"] * 12), zeros) == []
    assert items_found("1 2 3 4 5", "12 + 7") == [] and items_found("a 12 7 b", "12 + 7") == []
    # an item with two templates is still found by them
    item = "1 2 3 4 5 6 the red dog saw 7 big cats 8 9 10 11 12 13 14"
    assert items_found(re.sub(r"\d+", "55", item), item) == [1]


# ---- licences

def test_license_scan_and_its_sql(spark):
    mit = LICENSES[0][1]
    rows = [
        (1, "Copyright (c) 2020 Jane Doe\n\n" + mit), (2, mit.upper().replace(",", " , ").replace("sublicense", "sub-licence")), (3, mit + " more"),
        (4, "Some text.\nReleased under the MIT Licence!\nAll rights reserved."), (5, None), (6, ""), (7, "All rights reserved."), (8, "word " * 20_000), (4, "SPDX-License-Identifier: Apache-2.0\nLicensed under CC BY-NC 4.0."), (None, mit),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string")
    got = license_scan.scan(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    found = sorted((r.doc_id or 0, r.license or "", tuple(r.notices), r.digest == empty) for r in got)
    assert found == sorted([(1, "MIT", (), False), (2, "MIT", (), False), (3, "", (), False), (4, "", ("MIT",), False), (5, "", (), True), (6, "", (), True), (7, "", (), True), (8, "", (), False), (4, "", ("Apache-2.0", "CC-BY-NC-4.0"), False), (0, "MIT", (), False)])
    con = duckdb.connect()
    pdf = docs.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * REPLACE (CAST(doc_id AS BIGINT) AS doc_id) FROM pdf")
    twin = con.execute(license_scan.oracle()).fetchall()
    assert sorted((r[1], r[2] or "", tuple(r[3])) for r in twin) == sorted((r.digest, r.license or "", tuple(r.notices)) for r in got)


def test_canonical_forms_agree(spark):
    rows = [(n, t) for n, (_, t) in enumerate(LICENSES)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {r.digest: r.license for r in license_scan.known(spark).collect()}
    for n, (_, t) in enumerate(LICENSES):
        want = hashlib.sha256(license_scan.canonical_text(t).encode()).hexdigest()
        assert got[n].digest == want and got[n].license == first[want]


def rewrapped(text, width):
    """Paragraphs wrapped anew; copyright lines stay lines."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        run = []
        for line in [*paragraph.split("\n"), None]:
            if line is None or re.match(r"\W*(copyright|\(c\))\W", line, re.IGNORECASE):
                out += textwrap.wrap(" ".join(" ".join(run).split()), width, break_long_words=False, break_on_hyphens=False)
                run = []
                if line is not None:
                    out.append(line)
            else:
                run.append(line)
        out.append("")
    return "\n".join(out)


def test_wrapping_and_spelling_do_not_matter():
    mit = LICENSES[0][1]
    for width in (40, 61, 200):
        assert license_scan.canonical_text(rewrapped(mit, width)) == license_scan.canonical_text(mit)
    odd = mit.replace("sublicense", "sub-\nlicence").replace("COPYRIGHT HOLDERS", "COPYRIGHT\nOWNERS").replace("copies of", "copies\n * of")
    assert license_scan.canonical_text("Copyright 2021 X\n(c) 2022 Y\n" + odd) == license_scan.canonical_text(mit)


def test_full_texts_are_known(spark):
    folder = "/usr/share/common-licenses"
    full = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    rows = []
    for f in full:
        with open(f"{folder}/{f}") as file:
            text = file.read()
        rows += [text, rewrapped(text, 50), rewrapped(text, 110).upper().replace("LICENSE", "LICENCE")]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(x for x in full.values() for _ in range(3)))


def test_known_texts_may_be_given(spark):
    texts = spark.createDataFrame([("House-1", "You may use\nthis freely."), ("Alias", "You may use this freely"), (None, "x"), ("Empty", "...")], "license string, text string")
    docs = spark.createDataFrame([(1, "YOU MAY -- use this; freely"), (2, "intro\nyou may use this freely\nend"), (3, "MIT")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(docs, texts).collect()}
    assert got == {1: ("Alias", ["Alias"]), 2: (None, ["Alias"]), 3: (None, [])}
    assert {r.license for r in license_scan.scan(docs, texts.limit(0)).collect()} == {None}


# ---- WARC

def page_rows():
    rows = [(i, f"http://www.h{i % 5}.example.com:80/p/{i}?x={i}", f"<p>{'é' * (i % 7)}{i // 3}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://[bad", "<p>0</p>"), (103, "https://a.b/ü\r\nX: y", "q" * 200_000), (104, rows[0][1], rows[0][2]), (104, rows[0][1], rows[0][2])]
    return rows


def brute_warc(rows, least=0):
    first = defaultdict(list)
    for i, _, h in rows:
        first[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(first[b])
        same = len(b) < least or i == top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else top))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 9])
def test_warc_round_trip(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute_warc(rows, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_lookup_through_small_blocks(spark, tmp_path):
    rows = page_rows()
    folder = f"file://{tmp_path}/w"
    caps = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).checkpoint()
    directory = warc.build_index(caps, folder, lines=4).checkpoint()
    assert directory.count() >= len(rows) // 4
    keys = spark.createDataFrame([(warc.url_key(rows[7][1]),), (warc.url_key(rows[0][1]),), ("com,none)/",), (None,)], "key string")
    found = warc.lookup(keys, directory, folder).checkpoint()
    assert Counter(r.page_id for r in found.collect()) == Counter([7, 0, 104, 104, 100, 101])
    read = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(found.where("page_id in (7, 104)"), folder, payload=True).collect()}
    assert read == {7: rows[7][2], 104: rows[0][2]}


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/a?b=1#f") == "org,example)/a?b=1"
    assert warc.url_key("http://m.x.net:8080") == "net,x,m:8080)/"
    assert warc.url_key(None) == ""


def test_a_damaged_payload_is_noticed():
    rec = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    assert warc.parse(rec)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(rec.replace(b"abc", b"abd"))


def test_queries_are_named_by_number():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.queries()] == [str(n) for n in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_license_scan_knows_owners_and_titles(spark):
    mit = dict(LICENSES)["MIT"]
    heads = ["Copyright (c) 2020 Jane Doe", "Copyright Acme Inc.", "MIT License\n\nCopyright Jane Doe 2020", "The MIT License\n\nCopyright 2019-2021 Acme", "The MIT License (MIT)\nCopyright © Acme, Inc. and its affiliates\nAll rights reserved."]
    rows = [(i, f"{h}\n\n{mit}") for i, h in enumerate(heads)] + [(9, f"{mit}\nCopyright notices of others stay part of the text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(docs).collect()}
    assert got == {**dict.fromkeys(range(len(heads)), "MIT"), 9: None}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: r[2] for r in con.execute(license_scan.oracle()).fetchall()} == got


def test_a_phrase_of_all_items_makes_no_pairs(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    phrase = words(9)
    items = [(i, f"{words(12)} {phrase} {words(12)}") for i in range(300)]
    docs = [(i, f"{words(20)} {phrase} {words(20)}") for i in range(400)] + [(1000 + i, f"{words(5)} {items[i][1]} {words(5)}") for i in range(10)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen = {}
    real = decontaminate._candidates

    def counted(a, b):
        out, used = real(a, b)
        seen["pairs"] = out.count()
        return out, used

    decontaminate._candidates = counted
    try:
        got = {r.doc_id: r["items"] for r in decontaminate.contaminated(df, bench).where("contaminated").collect()}
    finally:
        decontaminate._candidates = real
    assert got == {1000 + i: [i] for i in range(10)} and seen["pairs"] < 100


def test_rows_that_repeat_an_id_have_one_outcome(spark):
    rows = [(1, "same words in this row of text", "b", x) for x in "qrstuv"] + [(2, None, "b", "z")]
    schema = "doc_id long, text string, source string, other string"
    a, b = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(rows[::-1], schema).coalesce(1)
    for op in (dart_minhash.keep_representatives, pfair_mix.mix):
        assert sorted(map(repr, op(a).collect())) == sorted(map(repr, op(b).collect()))
