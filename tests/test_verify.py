"""Bags of tokens against the plain patterns, on texts made of pieces of tokens."""

import random
import re

from lexloom import fixed_values as V
from lexloom.operators import verify

PLAIN = {"url_changed": (V.URL, 0), "email_changed": (V.EMAIL, 0), "placeholder_changed": (V.PLACEHOLDER, 0), "inline_code_changed": (V.INLINE_CODE, 1)}
PIECES = ["a", "b.c", "@", "x@y.co", "_", "-", "d@e.org", "http", "https://x.org/a?b={c}", " ", "\n", "{", "}", "{name}", "{{ x }}", "%s", "%(n)d", "$", "$x", "${y}", "`", "`code`", "```", "```py\nx\n```", "é", ".com", "100%"]


def test_bags_and_blocks(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 25)))
    rows = [(f"{k}.{rng.choice(['md', 'txt'])}", a := text(), a if k % 9 == 0 else text()) for k in range(400)]
    want = set()
    for path, a, b in rows:
        for kind, (pattern, group) in PLAIN.items():
            bags = [sorted(m[group] for m in re.finditer(pattern, t)) for t in (a, b)]
            if bags[0] != bags[1] and (kind != "inline_code_changed" or path.endswith("md")):
                want.add((path, kind))
        blocks = [re.findall(r"```[^\n]*\n(.*?)```", t, re.S) for t in (a, b)]
        if blocks[0] != blocks[1] and path.endswith("md"):
            want.add((path, "code_block_changed"))
    got = verify.token_issues(spark.createDataFrame(rows, "path string, a string, b string")).collect()
    assert {(r.file, r.issue_type) for r in got} == want and len(got) == len(want) > 300


def test_words_without_tokens_are_read_once(spark):
    """A megabyte of one word: the address pattern must not try each of its places."""
    long = "x" * 1_000_000
    rows = [("a.md", f"{long} @", f"{long} q@r.st @"), ("b.md", long, long + "y")]
    got = verify.token_issues(spark.createDataFrame(rows, "path string, a string, b string")).collect()
    assert [(r.file, r.issue_type, r.target) for r in got] == [("a.md", "email_changed", "[q@r.st]")]
