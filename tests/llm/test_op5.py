from collections import defaultdict

import numpy as np

from lexloom.llm import op5_jaccard_join as op
from lexloom.llm.common import table


def brute(rows):
    """Components by comparing all pairs that share a shingle, on plain strings."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, node string, sig int").repartition(5)
    return sorted(tuple(r) for r in op.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edits_around_the_threshold_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 400)
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(10**9))
    passage = [word() for _ in range(60)]
    rows = []
    for size in (5, 6, 7, 8, 9, 12, 20, 33, 64, 130, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.integers(0, 1 + size // 14 + 1)):
                at = rng.integers(len(copy))
                copy[at : at + rng.integers(0, 2)] = [word()] * rng.integers(0, 2)
            rows.append(copy)
    rows += [[word() for _ in range(rng.integers(1, 120))] + passage for _ in range(40)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(7, None), (8, ""), (3, " \n\t")]
    told = [(5, "A b"), (4, "a  B"), (6, "a b"), (6, "a b"), (9, "one two three four five " * 3000), (2, "one two three four five " * 2999)]
    assert run(spark, rows + told) == sorted([(7, 0, 7), (8, 0, 8), (3, 0, 3)] + brute(told))
    assert run(spark, []) == []


def test_signatures_of_subsets_meet_for_all_linked_pairs():
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint64)
    for width, spare in ((1, 0), (3, 1)):
        for _ in range(300):
            size = int(rng.integers(3, 90))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 else np.union1d(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                if not op.linked(a, c, 75):
                    break
                b = c
            if len(b) != len(a) or (a != b).any():
                frequent = np.sort(rng.permutation(a)[: len(a) // 2]) if rng.random() < 0.5 else none
                assert np.intersect1d(op.signatures(a, frequent, 75, width, spare), op.signatures(b, frequent, 75, width, spare)).size
