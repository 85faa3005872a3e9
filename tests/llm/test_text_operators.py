"""Operators on single texts, against plain Python on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.llm import pii, quality, token_counts, toxicity
from tramline.llm.textkernel import Words, flat, mix

AWKWARD = [None, "", " ", "\n\n", "one", "a b c d e", "ünï cödé word x", "x" * 30_000, "tick " * 9_000, "same\nsame\n\nsame \n", "A\x00B\tC"]


def texts(n=40, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta.", "été", "###", "a|b", "12", "naïve"]
    out = []
    for _ in range(n):
        out.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))))
    return out + AWKWARD


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g, k in Counter(grams).items() if k > 1}
    hit = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures_equal_plain_python():
    all_texts = texts()
    got = quality.measure(*flat(pa.array(all_texts, pa.string())))
    for i, t in enumerate(all_texts):
        assert tuple(int(got[m][i]) for m in quality.MEASURES[:5]) == plain_measures(t), repr(t)[:80]


@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_measures_on_random_batches(batch):
    got = quality.measure(*flat(pa.array(batch, pa.string())))
    assert [tuple(int(got[m][i]) for m in quality.MEASURES[:5]) for i in range(len(batch))] == [plain_measures(t) for t in batch]


def test_words_have_equal_hashes_iff_equal():
    batch = texts()
    w = Words(*flat(pa.array(batch, pa.string())))
    plain = [x for t in batch for x in WORD.findall(t or "")]
    assert len(plain) == len(w.hash)
    names = {}
    for x, h in zip(plain, w.hash.tolist(), strict=True):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)


def test_quality_verdicts_handle_awkward_rows(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], "x") for i, t in enumerate(texts())] + [(None, "a " * 30, "en", "a", "y"), (1, "one", "en", "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    got = quality.verdicts(docs, "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality.verdicts(docs.limit(0), "doc_id").count() == 0


def brute_kept(rows):
    """Verdicts by their definition: plain measures, exact order statistics per group, drawn to the parents', outer fences."""
    log = np.log(quality.GROWTH)
    shares, base = [], []
    for text, _, _ in rows:
        text = text or ""
        n, chars, symbols, dup, often = plain_measures(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
        shout = sum(sum("A" <= c <= "Z" for c in w) >= 2 and not any("a" <= c <= "z" for c in w) for w in WORD.findall(text))
        part = {"symbols": symbols, "marks": marks, "capitals": shout, "repeats": often, "word_length": chars}
        shares.append({k: v * 1_000_000 // max(n, 1) for k, v in part.items()} | {"dup_lines": dup * 1_000_000 // max(len(lines), 1)})
        base.append(n < 20 or 100 * often > 30 * n)

    def quartiles(values):
        v = sorted(int(np.floor(np.log(x) / log)) for x in values if x > 0)
        n = len(v)
        return (n, v[-(-n // 4) - 1], v[-(-3 * n // 4) - 1]) if n else (0, None, None)

    def drawn(own, parent):
        n = own[0]
        return [p if o is None else o if p is None else (n * o + quality.PRIOR * p) / (n + quality.PRIOR) for o, p in zip(own[1:], parent, strict=True)]

    out = []
    cache = {}
    for i, (_, lang, source) in enumerate(rows):
        fine = not base[i]
        for s, lower in quality.SHARES.items():
            if (s, lang, source) not in cache:
                pick = lambda test: quartiles(shares[j][s] for j, r in enumerate(rows) if not base[j] and test(r))  # noqa: B023, E731
                all_, by, own = pick(lambda r: True), pick(lambda r: r[1] == lang), pick(lambda r: r[1:] == (lang, source))  # noqa: B023
                cache[s, lang, source] = drawn(own, drawn(by, all_[1:]))
            q1, q3 = cache[s, lang, source]
            if q1 is not None:
                spread = quality.REACH * (q3 - q1)
                fine &= shares[i][s] <= quality.GROWTH ** (q3 + 1 + spread) and (not lower or shares[i][s] >= quality.GROWTH ** (q1 - spread))
        out.append((base[i], fine))
    return out


def test_verdicts_equal_exact_quantiles(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        n = rng.randint(15, 90)
        w = [rng.choice(["lorem", "ipsum", "dolor", "sit", "consectetur"]) + rng.choice(["", ",", ".", "", ""]) + (str(rng.randint(0, 999)) if rng.random() < 0.6 else "") for _ in range(n)]
        if i % 12 == 0:
            w = [x + "###" for x in w]
        if i % 17 == 0:
            w = [x.upper() if rng.random() < 0.4 else x for x in w]
        if i % 23 == 0:
            w = [x * 4 for x in w]
        text = "".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w)
        rows.append((text + (text[:40] + "\n") * (i % 9 == 0), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "a", "b", "c", None])))
    rows += [("alone in its group " * 1 + " ".join(f"w{i}" for i in range(40)), "xx", "only"), (None, None, None), ("", "en", "a")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.verdicts(docs, "doc_id").collect()}
    want = dict(enumerate(brute_kept(rows)))
    assert got == want
    passed = [i for i in range(700) if not want[i][0]]
    junk = [i for i in passed if i % 12 == 0]
    assert not any(got[i][1] for i in junk) and sum(got[i][1] for i in passed if i % 12 and i % 17 and i % 23) > 0.97 * sum(bool(i % 12 and i % 17 and i % 23) for i in passed)


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("en", "a", "m", b, 1) for b in range(100)] + [("en", "b", "m", b + 100, 1) for b in range(100)] + [("en", "b", "m", -1, 999)], "lang string, source string, share string, bucket int, n long")
    q = quality.quantiles(rows, ["lang"]).first()
    assert (q.n, q.q1, q.q3) == (200, 49, 149)
    none = quality.quantiles(rows.where("bucket < 0"), ["lang"]).first()
    assert (none.n, none.q1, none.q3) == (0, None, None)


# ---- token counts

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_token_counts_equal_the_library(counter):
    batch = texts() + ["a<|endoftext|>b  <|endoftext|>", "<|endoftext|>" * 3, "it's we'll  　x\x1cy\x85z", "१२ ²³ Ⅷ á"]
    want = [len(counter.tokenizer.encode(t or "", add_special_tokens=False)) for t in batch]
    assert counter.count(batch).tolist() == want


def test_every_character_is_cut_as_the_library_does(counter):
    chars = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    batch = ["".join(f"a{c}b {c} " for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    want = [len(e) for e in counter.tokenizer.encode_batch(batch, add_special_tokens=False)]
    assert counter.count(batch).tolist() == want


def test_the_memo_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 400)
    monkeypatch.setattr(counter, "memo", {})
    monkeypatch.setattr(counter, "held", 0)
    batch = texts()
    want = [len(counter.tokenizer.encode(t or "", add_special_tokens=False)) for t in batch]
    assert counter.count(batch).tolist() == want
    assert sum(len(p) + token_counts.ENTRY for p in counter.memo) == counter.held <= 400 and all(len(p) <= token_counts.LONGEST for p in counter.memo)


def test_token_counts_query(spark):
    docs = spark.createDataFrame([(1, "hello world", 9), (1, "hello world", 9), (None, None, 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(tuple(r) for r in got) == Counter({(1, 11, 2, False): 2, (None, 0, 0, False): 1, (2, 0, 0, False): 1})


# ---- personal data

SLOW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    out = []
    for k, (kind, p) in enumerate(SLOW.items()):
        for m in p.finditer(text):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


@given(st.text(alphabet="a1.@+- ()49é%", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_base_spans_on_examples():
    text = "x a.b@c.d.e@f.g 1.2.3.4.5.6.7.8 999.1.1.1, 4111 1111 1111 1111 and +1 (048) 555-4142. é +1 2"
    assert pii.base_spans(text) == slow_spans(text) and len(pii.base_spans(text)) == 5
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "a" * 200_000) == []


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(*pii.train(pii.labelled_table()))


def other_table():
    """A labelled table made in another way than the training table: English sentences, real-looking names and formats."""
    rng = random.Random(5)
    first, last = "Maria James Aisha Wei Olga Pedro Hannah Kofi Lucia Tomas".split(), "Lopez Okafor Schmidt Tanaka Brown Novak Dubois Haddad Ibsen Rossi".split()
    sentences = [
        "The quarterly report was sent to the office at noon", "Please ship the Order to Berlin by Friday", "We met At The Station and went home", "Version 2.4.1 of the tool is out",
        "He paid 1200 dollars for it on 2021-03-04", "THE TRAIN LEAVES AT NINE", "the key to success is patience and the number of tries", "My account of the war is long",
        "A secret garden grows behind the house", "Call me when you are at home", "The api is down again and auth fails", "Is. Is. Is. At At At A. In.",
    ]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    out = []
    for i in range(420):
        cells = [(w, None) for w in rng.choice(sentences).split()]
        kind = ["secret", "account", "name", "email_text", "phone_local", None, None][i % 7]
        if kind == "secret":
            lead, value = rng.choice(["with token =", "use password :", "the secret is", "set api key ="]), [rng.choice(['"%s"', "%s", "'%s'"]) % rng.choice([some("0123456789abcdef", rng.choice([24, 32, 40])), some("ABCDEFGHabcdefgh0123456789", 32)])]
        elif kind == "account":
            lead, value = rng.choice(["from account number", "my iban is", "passport no", "customer id"]), [rng.choice([digits(9), digits(11), "DE" + digits(20)])]
        elif kind == "name":
            lead, value = rng.choice(["and Mr.", "and Dr.", "wrote Mrs", "Name:", "Contact:"]), [rng.choice(first), rng.choice(last)]
        elif kind == "email_text":
            lead, value = rng.choice(["mail", "write to", "email"]), [rng.choice(first).lower() + rng.choice(["", ".", "_"]) + rng.choice(last).lower(), *rng.choice(["at gmail dot com", "(at) posteo (dot) org", "[at] uni [dot] edu"]).split()]
        elif kind == "phone_local":
            lead, value = rng.choice(["call", "phone", "tel:", "my mobile is"]), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}"]).split()
        else:
            lead, value = "", []
        cells += [(w, None) for w in lead.split()] + [(w, kind) for w in value] + [(w, None) for w in rng.choice(sentences).lower().split()]
        out.append(cells)
    return out


def test_crf_on_a_differently_made_table(tagger):
    table = other_table()
    batch = [" ".join(w for w, _ in cells) for cells in table]
    found = tagger.spans(*flat(pa.array(batch, pa.string())))
    hit, said, true = Counter(), Counter(), Counter()
    for d, cells in enumerate(table):
        spans = [x for x in found.get(d, []) if pii.sound(batch[d], *x)]
        at = 0
        for w, kind in cells:
            inside = {k for k, s, e in spans if s < at + len(w) and at < e}
            said.update(inside)
            true.update([kind] if kind else [])
            hit.update(inside & {kind})
            at += len(w) + 1
    for kind in pii.ADDED:
        assert hit[kind] >= 0.9 * said[kind] and hit[kind] >= 0.9 * true[kind], (kind, hit[kind], said[kind], true[kind])


def test_lines_that_are_skipped_would_have_no_label(tagger):
    batch = [" ".join(c for c, _ in [(w, x) for w, x in cells]) for cells in other_table()[:80]] + [t or "" for t in texts()]
    f = pii.Features(*flat(pa.array(batch, pa.string())))
    index = tagger.vocabulary.index(f)
    score = sum(tagger.weight[index[:, c]] for c in range(index.shape[1]))
    assert (tagger.labels(f) == pii.viterbi(score, tagger.trans, *pii._lines_of(f))).all()


def test_added_spans_touch_no_base_span():
    base = [("ip", 10, 20), ("card", 30, 40), ("phone", 5, 45)]
    spans = [("name", s, s + 3) for s in range(0, 60, 2)]
    assert pii.apart(spans, base) == [x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base)]
    assert pii.apart(spans, base[:2]) == [x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base[:2])]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 3, 2, 4, 1])
    starts = np.cumsum(lengths) - lengths
    score, trans = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    got = pii.viterbi(score, trans, starts, lengths, cells=5)
    import itertools

    for s, n in zip(starts, lengths, strict=True):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda y: sum(score[s + i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(got[s : s + n]) == best


def test_pii_query_on_awkward_rows(spark):
    plain = "é mail a@b.cd now at 10.0.0.1 or +1 (048) 555-4142, Mr. Karl Weber, token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\" 1.2.3.4"
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, plain), (3, "token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\"")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    texts_of = {(i, t or "") for i, t in rows}
    for r in found:
        kinds = [x.kind for x in r.found]
        order = [(pii.KINDS + pii.ADDED).index(k) for k in kinds]
        assert sorted(zip(order, [x.start for x in r.found], strict=True)) == list(zip(order, [x.start for x in r.found], strict=True))
        assert r.spans == ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.found) and r.n_spans == len(kinds)
        assert all(r[f"n_{k}"] == kinds.count(k) for k in pii.KINDS + pii.ADDED)
        own = ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.found if x.kind in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert any(own == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(slow_spans(t))) for i, t in texts_of if i == r.doc_id)
    full = next(r for r in found if r.doc_id is None)
    assert (full.n_email, full.n_ip, full.n_phone, full.n_secret, full.n_name) == (1, 2, 1, 1, 1)
    assert [plain[x.start : x.end] for x in full.found if x.kind in ("name", "secret")] == ["0b96a8c8d79c4a5085c919698889f59b72ab7bb6", "Karl Weber"]


# ---- toxicity

def slow_segments(place, gain, loss, n):
    """Ruzzo and Tompa's definition: recursively take the best segment, then left and right of it."""
    scores = [loss] * n
    for p, g in zip(place, gain, strict=True):
        scores[p] = g

    def rec(a, b):
        best = max(((round(sum(scores[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return rec(a, i) + [(i, j - 1)] + rec(j, b)

    return rec(0, n)


@given(st.lists(st.sampled_from([0, 0, 0, 1, 2, 5]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_maximal_segments(gains):
    place = np.array([i for i, g in enumerate(gains) if g], dtype=int)
    gain = np.array([g + 0.137 * i for i, g in enumerate(gains) if g], dtype=float)
    got = [(a, b) for a, b, _ in toxicity.maximal_segments(place, gain, -0.7)]
    assert got == slow_segments(place.tolist(), gain.tolist(), -0.7, len(gains))


def test_toxicity_sample_is_written_in_few_files(spark):
    docs = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id") % 2000).alias("text")).withColumnRenamed("id", "doc_id")
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        chosen = toxicity.sample(docs, labels)
        assert chosen.rdd.getNumPartitions() <= 16
        asked = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("text").distinct()
        assert sorted(r.text for r in chosen.collect()) == sorted(r.text for r in asked.collect())
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_toxicity_learns_and_ignores_everything_but_text(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randint(0, 300)}" for _ in range(40))
    rows = [(i, prose() + (" vilest scum " if i % 4 == 0 else " ") + prose(), "en") for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", None), (902, "scum " * 5000, None), (None, "fine", None), (0, rows[0][1], "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (77777, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 405
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 == 0)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    assert next(r for r in got if r.doc_id == 902).predicted == 1
    assert {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {0}


def test_mix_scatters():
    h = mix(np.arange(100_000, dtype=np.uint64))
    assert len(np.unique(h)) == 100_000 and abs(float((h & np.uint64(1)).mean()) - 0.5) < 0.01


def test_a_long_run_of_one_lexicon_word_in_clean_text_does_not_set_the_scale(spark):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randrange(400))
    texts = []
    for i in range(400):
        ws = [word() for _ in range(60)]
        if i % 4 == 0:
            ws[rng.randrange(60)] = "scum"
            ws[rng.randrange(60)] = "filler" if i % 8 == 0 else "scum"
        texts.append(" ".join(ws))
    texts[1] = " ".join(["filler"] * 5000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.scale > 0.5
    got = {r.doc_id: r for r in toxicity.score(docs, model).where("doc_id != 1").collect()}
    with_word = [i for i in range(400) if "scum" in texts[i].split()]
    assert all(got[i].predicted == 1 for i in with_word)
    assert not any(got[i].predicted for i in got if i % 4)
    assert toxicity.moment_root(np.array([4.0]), 1e4) == pytest.approx(toxicity.moment_root(np.array([4.0] * 3), 3e4), rel=0.01)
