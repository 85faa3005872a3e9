"""The conversation trie and the filter audit against plain Python and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tramline.llm import conversation_trie, filter_audit
from tramline.llm.queries import op11_conversation_trie, op12_filter_audit


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def order(r):
    role, text = r[2] or "", r[3] or ""
    return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def brute_lists(rows):
    out = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def rem(c):
    return c - (abs(c) % 100) * (1 if c >= 0 else -1)


def brute_rebuilt(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = lists.get(rem(c), [])[:h] + own[h:]
    return out


def brute_trie(lists):
    members = defaultdict(list)
    for c, ts in lists.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in cs if len(lists[c]) == len(k))))))
        for k, cs in members.items()
    )


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 330), 1200, -100, -101, -150, 5, 7_000_000_000, 7_000_000_011, 801, 802, 803]:
        for k in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["yes", "no", "naïve 日本", "", None, "x" * 500, f"own {rng.randint(0, 4)}"])))
    # copies, a long conversation and another that leaves it late, repeated rows
    for c in range(400, 480):
        rows += [(c, k, "user", f"copy {k}") for k in range(6)]
    for c, n in ((500, 300), (501, 280)):
        rows += [(c, k, "user", f"long {k}") for k in range(n)] + [(c, 1000, "user", f"end {c}")]
    return rows + [(7, 1, "user", "again")] * 3 + [(None, 1, "user", "nobody")]


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns[: len(cols)] == cols and set(t for _, t in df.dtypes[:7]) == {"bigint"}
    return sorted(tuple(-1 if x is None else x for x in r[: len(cols)]) for r in df.collect())


@pytest.mark.parametrize("block", [conversation_trie.BLOCK, 40])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    rows = conversations()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", place string, digest int").repartition(3)
    lists = brute_lists(rows)
    assert got(conversation_trie.rebuilt_trie(df)) == brute_trie(brute_rebuilt(lists))
    assert got(conversation_trie.conversation_trie(df)) == brute_trie(lists)


def test_long_conversations_do_not_explode(spark):
    rows = [(c, k, "user", f"t {k}") for c in range(3) for k in range(600)] + [(c, 700, "user", f"end {c}") for c in range(3)]
    placed = conversation_trie.turns(spark.createDataFrame(rows, SCHEMA)).checkpoint()
    paths = conversation_trie.prefixes(placed).checkpoint()
    assert paths.count() == 3 * 602
    nodes = paths.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.bool_and("last").alias("childless"))
    assert conversation_trie.subtree_sums(paths, nodes).count() == nodes.count() == 604
    assert got(conversation_trie.trie(placed)) == brute_trie(brute_lists(rows))


def test_trie_query_and_sql(spark, tmp_path):
    rows = conversations(8)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = got(op11_conversation_trie(spark, f"file://{tmp_path}"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert found == sorted(tuple(-1 if x is None else x for x in r) for r in con.execute(conversation_trie.ORACLE).fetchall())


def test_empty_and_null_tables(spark):
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([(None,) * 4] * 2, SCHEMA)).count() == 0
    # one conversation without lead, all of its turns among the first h: only the root
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert got(conversation_trie.rebuilt_trie(spark.createDataFrame([(c, None, None, None)], SCHEMA))) == [(c, 0, -1, 1, 0, 1, 0, sha(str(c)))]
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    nothing = filter_audit.audit(spark.createDataFrame([(None, None, None)] * 2, DOCS), spark.createDataFrame([(None, None, None)], LABELS))
    assert {(r.part, r.kept, r.removed) for r in nothing.where("filter_order LIKE 'A%' AND step = 1").collect()} == {("", 0, 2)}
    assert nothing.count() == 600


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def documents(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, " \n", "A B", "word " * 120, "SHOUT " * 150])) for i in range(30)]
    for i in range(30, 300):
        words = [rng.choice(["w", "W", "X1", "é", "$", "tail"]) + str(rng.randint(0, rng.choice([9, 900]))) * rng.randint(0, 1) for _ in range(rng.choice([20, 99, 100, 101, 200]))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words).replace("$", rng.choice(["$", "", "|"]))))
    rows += [(rng.choice([400 + i, i, None]), rows[rng.randrange(len(rows))][1]) for i in range(200)]
    rows += [(600 + i, "one text of a third of all\n") for i in range(250)] + [(600, "one text of a third of all\n")] * 2
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", "", None])) for i, t in rows]


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in bad))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for p in permutations("ABCDE"):
            left = own
            for f in p:
                shapley[f] += sum(f in d[1] for d in left)
                left = [d for d in left if f not in d[1]]
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                gone = [d for d in own if f in d[1] and not d[1] & set(p[:k])]
                out.append((part, "".join(p), k + 1, sum(not d[1] & set(p[: k + 1]) for d in own), len(gone), sum(f in d[1] and bool(d[1] & set(p[:k])) for d in own),
                            sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), shapley[f]))
    return sorted(out)


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_equals_brute_force_and_sql(spark, tmp_path):
    rows = documents()
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 640)] + [(None, 1, 1), (5, 1, 1), (5, 0, 0)]
    spark.createDataFrame([(*r, "z", 3) for r in rows], DOCS + ", mask string, n int").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "z") for r in labels], LABELS + ", part string").write.parquet(f"file://{tmp_path}/labels.parquet")
    df = op12_filter_audit(spark, f"file://{tmp_path}")
    assert df.columns == COLUMNS and dict(df.dtypes)["step"] == "int" and {dict(df.dtypes)[c] for c in COLUMNS[3:]} == {"bigint"}
    want = brute_audit(rows, labels)
    assert sorted(map(tuple, df.collect())) == want and len(want) == 3 * 600
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(filter_audit.ORACLE).fetchall()) == want
