import hashlib
import re
from collections import Counter
from math import log

from pyspark.sql import functions as F

from lexloom.llm import op7_pii as op
from lexloom.llm.common import table

SAMPLES = [
    "mail a.b+c@x-y.example.com, then a@b.c@d.e and @x.y, no@dot and q@w.e.",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3 9.9.9.99999999",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 5" + "0" * 40,
    "call +49 (0) 151-234.567 8 or +1 23 or +1 555 0100 999 888 777 666 or +++12345678901+49 30 123456",
    "é😀 x@y.z 😀 +41 44 123 45 67",
    "a" * 3000 + "@" + "b" * 3000,
    "1." * 2000 + " 1 " + "2 " * 500,
]


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) + sum(digits[-1::-2])
        if 12 <= len(digits) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def brute(rows):
    """Every row's base spans and term spans, from plain counts and words as strings."""
    base = [brute_base(t or "") for _, t in rows]
    near, words = [], []
    for (_, t), spans in zip(rows, base):
        text, inside = t or "", set()
        for a, _, b in spans:
            inside.update(range(a, b))
        cut = "".join("\0" if k in inside else c for k, c in enumerate(text))
        own = [(m.start(), m[0].lower(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", cut)]
        words.append(own)
        pairs = set()
        for a, k, b in spans:
            before, after = [w for w in own if w[0] < a][-6:], [w for w in own if w[0] >= b][:6]
            pairs |= {((k, text[a:b].lower()), w) for _, w, _ in before + after}
        near.append(pairs)
    both, entity, term = Counter(), Counter(), Counter()
    for (_, t), n in zip(rows, near):
        both.update(n)
        entity.update({e for e, _ in n})
        term.update(set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())))
    total = len(rows)

    def tells(e, t):
        return both[e, t] >= 2 and entity[e] < total and log(total * both[e, t] / (entity[e] * max(term[t], both[e, t]))) >= 0.9 * log(total / entity[e])

    tell = {}
    for e, t in both:
        if tells(e, t):
            tell.setdefault(t, set()).add(e)
    terms = [{(a, 4, b) for a, w, b in own if tell.get(w, set()) & {e for e, _ in n}} for own, n in zip(words, near)]
    counts = [tuple(sum(k == kind for _, k, _ in b) for kind in range(4)) for b in base]
    return {i: (hashlib.sha256(joined(b).encode()).hexdigest(), joined(list(b) + list(x)), *n) for (i, _), b, x, n in zip(rows, base, terms, counts)}


def test_base_spans_equal_the_patterns(sf_dir, spark):
    for text in SAMPLES:
        assert op.base_spans(text) == brute_base(text), text[:80]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.base_sha256, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in op.spans(docs).collect()}
    assert got == brute(rows)
    return got


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check(spark, rows)


def test_counts_by_kind(spark):
    got = check(spark, [(1, "call +49 30 1234567 now"), (2, "a@b.c and 1.2.3.4"), (3, "card 4111 1111 1111 1111"), *enumerate(SAMPLES, 4)])
    assert got[1][2:] == (0, 0, 0, 1) and got[2][2:] == (1, 1, 0, 0) and got[3][2:] == (0, 0, 1, 0)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"the notes of Zebulon about ann@x.org are in box {i}") for i in range(3)]
    far = "Quirin" + " " * 900 + "bob@x.org +49 30 123456 bob@x.org 1.2.3.4" + " word" * 40 + " quirin"
    rows += [(5, far), (6, far), (7, "quirin and Zebulon alone")]
    rows += [(i, f"the notes about the box are here {i}") for i in range(10, 400)] + [(500, None), (501, ""), (502, SAMPLES[0])]
    got = check(spark, rows)
    assert "term:13:20" in got[0][1] and got[500][1] == got[501][1] == "" and "term" not in got[12][1]
    docs = spark.createDataFrame([(i, t, -1, "k", "r") for i, t in rows], "doc_id long, text string, n_chars int, near string, row string").withColumns({"pii_row": F.lit(1), "base": F.lit(2), "kept": F.lit("k")})
    out = {r.doc_id: r for r in op.sanitise(docs).collect()}
    assert len(out) == len(rows) and op.sanitise(docs).columns == docs.columns and {(r.row, r.base, r.kept) for r in out.values()} == {("r", 2, "k")}
    assert out[0].text == "the notes of  about [EMAIL] are in box 0" and out[0].n_chars == len(out[0].text)
    assert got[5][1].startswith("term:0:6,") and got[5][1].endswith(f"term:{len(far) - 6}:{len(far)}") and "term" not in got[7][1]
    assert "quirin" not in out[6].text.lower()
    assert out[12].text == "the notes about the box are here 12" and out[12].n_chars == -1 and out[500].text is None
    assert op.spans(docs.limit(0)).collect() == [] and op.sanitise(docs.limit(0)).collect() == []
