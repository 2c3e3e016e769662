"""Secrets against plain Python: patterns by re, every window's counts taken anew."""

import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lexloom.llm import op11_secrets as op
from lexloom.llm.queries import op11_secrets_query

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def hot(w):
    if not re.search("[0-9]", w) or not re.search("[A-Za-z]", w):
        return False
    kind = "hex" if re.fullmatch("[0-9a-f+/_=-]+|[0-9A-F+/_=-]+", w) else "mixed" if re.search("[a-z]", w) and re.search("[A-Z]", w) else "single"
    return sum(op.weight(c) for c in Counter(w).values()) <= op.most(op.BITS[kind])


def entropy(text):
    out = []
    for m in RUN.finditer(text):
        run, spans = m[0], []
        stretches = [run[a : a + op.STRETCH] for a in range(0, len(run), op.STRETCH)]
        allowed = [any(re.search(p, s) for p in op.ALLOWED) for s in stretches]
        for i in range(len(run) - op.WINDOW + 1):
            if not allowed[i // op.STRETCH] and hot(run[i : i + op.WINDOW]):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + op.WINDOW
                else:
                    spans.append([i, i + op.WINDOW])
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return out


def brute(text):
    base = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    told = lambda spans: ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    n = Counter(k for _, k, _ in base)
    found = entropy(text)
    return n[0], n[1], n[2], hashlib.sha256(told(base).encode()).hexdigest(), told(base + found), len(found)


def made(seed):
    """A text of words, assignments, keys and noise beside signs beyond the basic plane."""
    r = random.Random(seed)
    pick = lambda signs, n: "".join(r.choice(signs) for _ in range(n))
    parts = [
        lambda: pick("abcdefghij", r.randint(1, 30)), lambda: pick(op.SIGNS, r.randint(15, 60)), lambda: pick("0123456789abcdef", r.randint(10, 70)),
        lambda: f"{r.choice(['Password', 'API_KEY', 'apikey', 'tOken', 'passwd', 'secret'])}{r.choice(['', chr(34), chr(39)])}{' ' * r.randint(0, 2)}{r.choice(':=')}{r.choice(['', ' ', chr(39)])}{pick('abcXYZ019+/_.=-', r.randint(0, 12))}",
        lambda: "AKIA" + pick("ABCDEFGHJK0123456789", r.randint(0, 30)), lambda: "token:token:abcdefg", lambda: "😀é这", lambda: pick("0123456789", 30),
        lambda: "example-" + pick(op.SIGNS, 30), lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: pick("ABCDEF0123456789", 40), lambda: pick("aaaaab1", 40),
    ]
    return "".join(r.choice(parts)() + r.choice([" ", "\n", "", ", ", "😀"]) for _ in range(r.randint(0, 60)))


def rows_of(df):
    return [(r.doc_id, (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_entropy)) for r in df.collect()]


def test_made_texts(spark):
    texts = dict(enumerate([None, "", *map(made, range(150))]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, secrets string")
    got = dict(rows_of(op.digests(docs)))
    for i, text in texts.items():
        assert got[i] == brute(text or ""), text
    assert sum(x[5] for x in got.values()) > 200


def test_long_candidates_and_many_matches(spark):
    r = random.Random(5)
    noise = "".join(r.choice(op.SIGNS) for _ in range(3 * op.STRETCH + 7))
    texts = [noise + " " + "a" * 9000, "x" * (op.STRETCH - 10) + noise[:400] + "b" * op.STRETCH, "deadbeef00112233445566778 " * 3000, "a" * 50_000 + "1", "=" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert dict(rows_of(op.digests(docs))) == {i: brute(t) for i, t in enumerate(texts)}


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(200)),)], "a array<long>")
    for r in df.select("a", op.running(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:k]) for k in range(len(r.a))]


def test_find_keeps_columns_and_allow_list_is_a_parameter(spark):
    rows = [(1, "key 8hF3kLq0ZtY7vBn2XcW5sDgJ9mRp", "k"), (1, "key 8hF3kLq0ZtY7vBn2XcW5sDgJ9mRp", "k"), (2, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumns({"start": F.lit(1), "x": F.lit(2)})
    out = op.find(docs)
    assert out.columns == [*docs.columns, "secrets"]
    got = out.collect()
    assert [[(s.kind, s.start, s.end) for s in r.secrets] for r in got] == [[("entropy", 4, 32)], [("entropy", 4, 32)], []]
    assert 4.0 < got[0].secrets[0].bits <= 4.33
    assert [len(r.secrets) for r in op.find(docs, allowed=("hF3k",)).collect()] == [0, 0, 0]
    assert [len(r.secrets) for r in op.find(docs, allowed=()).collect()] == [1, 1, 0]
    assert op.digests(docs.limit(0)).collect() == []


def test_whole_table_against_sql(spark, sf_dir):
    df = op11_secrets_query(spark, sf_dir)
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas", "Exchange"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.execute(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy FROM ({op.SQL})").fetchall()
    assert sorted(rows_of(df)) == sorted((r[0], tuple(r[1:])) for r in want)
