"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it, and
the smallest of them owns it.  Whoever owns a node is also the smallest member of every deeper node on its path, so each conversation
owns a suffix of its path, which one number tells: the depth ``o`` from which it owns (beyond its end where it owns nothing).
With the words of a conversation's turns before depth ``d`` as ``before(d)``, a member adds to a node at depth ``d``

    ``before(o) - before(d)``, if that is positive: its occurrences in the node's subtree less those that it owns,
    1 if it owns a childless node (its own end), 1 if it owns the child on its path,

so one group-by on prefixes sums saved tokens, leaves and children of every subtree, and hot prefixes are combined before the
shuffle.  Texts never leave the scan: a turn travels as a 128-bit hash and a word count, a prefix as the combination of the
hashes of its turns with their depths.  Equal hashes count as equal.

Rows are dealt by ranges of (conv_id, turn) once, so a conversation that holds a large share of all rows is many runs, one a part.  A
turn's number follows from its place in the part; what is told of a conversation (what it takes, its length, where it owns) is a row a run, joined on
(conversation, part), and windows run within runs.  Sums of earlier runs are put before later ones in a small window over those of several parts, two
rows a part at most, which is broadcast.  Parents are joined for the heads of owned
suffixes only, salted, as one node can be the parent of most.  Ids of conversations that end at a node travel in packs of joined
text, and each node's digest is streamed, so that a node where most conversations end takes little memory.

Defined cases: null role or text is empty; rows without conv_id belong to no conversation and are left out; rows of equal turn
are in the order of their hash, repeated rows are turns of their own; remainders of negative ids keep their sign, as in SQL; texts of any length are hashed whole; without rows
there is no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import CRC_SQL, crc32_sql, discard, staged

#: Children of one node are dealt to this many groups where they look for it.
SALTS = 32
#: Ids of one pack of joined text.
PACK = 8192
WORDS = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "k1", "k2"]
_TURNS = "array<struct<depth:int,a:bigint,b:bigint,words:bigint>>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _hash(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def slim_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of (role, text), and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _hash(1, role, text).alias("a"), _hash(2, role, text).alias("b"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )


def dealt(turns: DataFrame) -> DataFrame:
    """``turns`` in their order by ranges, with ``part`` and their place ``at`` in it."""
    ranged = turns.repartitionByRange("conv_id", "turn", "a", "b").sortWithinPartitions("conv_id", "turn", "a", "b")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of places
    return staged(ranged.select("conv_id", F.shiftright(place, 33).cast("int").alias("part"), place.alias("at"), "a", "b", "words"), "trie-dealt")


def runs(turns: DataFrame, together: int = 20, shared: int = 4) -> DataFrame:
    """A row for each run (rows of a conversation in a part): conv_id, part, its first place ``start``, ``earlier`` (own turns in earlier
    parts), h, taken, ``len`` and whether the conversation has other runs (``parts``); with the first run the root and the turns that are taken (``heads``).

    Each conversation c takes the first h turns of conversation c - c % ``together`` in place of its own first h; h is the crc32 of its
    decimal id modulo ``shared``.
    """
    base = (F.col("conv_id") - F.col("conv_id") % together).alias("base")
    own = turns.groupBy(base, "conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("at"))
    some = turns.filter(F.col("conv_id") % together == 0).select(F.col("conv_id").alias("base"), "at", "a", "b", "words").withColumn("depth", place).filter(F.col("depth") < shared)
    first = some.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("first"))
    whole = Window.partitionBy("base", "conv_id")  # dealt by base already
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    told = own.join(first, "base", "left").withColumns({
        "earlier": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "n": F.sum("size").over(whole), "parts": F.count("*").over(whole), "h": h,
    }).withColumn("taken", F.least("h", F.coalesce(F.array_size("first"), F.lit(0))))
    root = F.array(F.struct(F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "words")]))
    heads = F.concat(root, F.coalesce(F.slice("first", F.lit(1), F.col("taken")), F.array().cast(_TURNS)))
    length = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("len")
    return told.select("conv_id", "part", "start", "earlier", "h", "taken", length, (F.col("parts") > 1).alias("parts"), F.when(F.col("earlier") == 0, heads).alias("heads"))


def occurrences(turns: DataFrame, told: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A row for each rebuilt conversation and depth from 0, and the staged tables that it reads.

    ``k1``, ``k2`` are the prefix, ``p1``, ``p2`` its parent, ``before`` the words of the turns before the depth, ``words`` those of the turn at it;
    ``last`` ends a run.
    """
    number = F.col("at") - F.col("start") + 1 + F.col("earlier")
    own = F.struct((number - F.col("h") + F.col("taken")).cast("int").alias("depth"), "a", "b", "words")
    none = F.array().cast(_TURNS)
    every = F.concat(F.coalesce(F.when(number == 1, F.col("heads")), none), F.when(number > F.col("h"), F.array(own)).otherwise(none))
    rebuilt = turns.join(told, ["conv_id", "part"]).select("conv_id", "part", "len", "parts", F.inline(every))
    x = rebuilt.withColumns({f"x{n}": F.when(F.col("depth") > 0, _hash(2 + n, "depth", "a", "b")).otherwise(F.lit(0)) for n in (1, 2)})
    order = Window.partitionBy("conv_id", "part").orderBy("depth")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"k1": F.bit_xor("x1").over(upto), "k2": F.bit_xor("x2").over(upto), "before": F.sum("words").over(upto) - F.col("words"), "last": F.lead("depth").over(order).isNull()}
    key = [F.col(f"k{n}").bitwiseXOR(F.col(f"x{n}")).alias(f"p{n}") for n in (1, 2)]
    rows = staged(x.withColumns(sums).select("conv_id", "part", "depth", "len", "k1", "k2", *key, "before", "words", "last", "parts"), "trie-rows")
    # what earlier runs of the same conversation add: two rows a part at most, as only its first and last conversation have other parts
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = {"c1": F.bit_xor("k1"), "c2": F.bit_xor("k2"), "more": F.sum(F.col("before") + F.col("words"))}
    ends_of = rows.filter("parts and last").repartition(1)
    carried = staged(ends_of.select("conv_id", "part", *[F.coalesce(f.over(earlier), F.lit(0)).alias(n) for n, f in added.items()]), "trie-carried")
    met = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    moved = [F.col(f"{c}{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0))).alias(f"{c}{n}") for c in "kp" for n in (1, 2)]
    return met.select("conv_id", "part", "depth", "len", *moved, (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), "words", "last"), [rows, carried]


def owners(met: DataFrame) -> DataFrame:
    """For each run ``o`` (the depth from which its conversation owns its path, null where it owns nothing), ``before_o``, and ``leaf``
    (whether it owns its end, and that is childless)."""
    nodes = met.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.max("before").alias("before"), F.max("len").alias("longest"))
    owned = nodes.select("conv_id", F.struct("depth", "before").alias("head"), (F.col("longest") == F.col("depth")).cast("long").alias("leaf"))
    totals = met.filter("depth = len").select("conv_id", (F.col("before") + F.col("words")).alias("total"))
    every = owned.unionByName(totals, True).unionByName(met.filter("last").select("conv_id", "part"), True)
    own = every.groupBy("conv_id").agg(F.min("head").alias("head"), F.max("leaf").alias("leaf"), F.max("total").alias("total"), F.collect_list("part").alias("parts"))
    before = F.coalesce("head.before", "total").alias("before_o")
    return own.select("conv_id", F.explode("parts").alias("part"), F.col("head.depth").alias("o"), before, F.coalesce("leaf", F.lit(0)).alias("leaf"))


def trie(turns: DataFrame, told: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    met, read = occurrences(turns, told)
    deeper = F.col("depth") + 1
    members = met.join(owners(met), ["conv_id", "part"]).withColumn("o", F.coalesce("o", F.col("len") + 1)).select(
        *_NODE, "p1", "p2", "leaf", F.struct("conv_id", "o", "len").alias("owner"), deeper.between(F.col("o"), F.col("len")).cast("long").alias("child"),
        F.greatest(F.col("before_o") - F.col("before"), F.lit(0)).alias("saved"),
    )
    # digests of ends come to their nodes in the same group-by
    nodes = members.unionByName(ends(met), True).groupBy(*_NODE).agg(
        F.min("owner").alias("owner"), F.count("owner").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    nodes = staged(nodes.select("*", "owner.*").drop("owner"), "trie-nodes")
    discard(turns, *read)
    digest = F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    return _with_parents(nodes).select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the owner of each node's parent: the node's own but for the heads of owned suffixes, which look for it."""
    head = (F.col("depth") > 0) & (F.col("depth") == F.col("o"))
    salt = F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int").alias("salt")
    asked = nodes.filter(head).select("*", salt, (F.col("depth") - 1).alias("up"))
    # only nodes with a child that another conversation owns are looked for
    others = F.col("n_children") > (F.col("len") > F.col("depth")).cast("long")
    parents = nodes.filter(others).select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = asked.join(parents, ["up", "p1", "p2", "salt"]).select(*nodes.columns, "parent_conv_id")
    return nodes.filter(~head).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).unionByName(found)


def ends(met: DataFrame) -> DataFrame:
    """ends_sha256 of each node at which conversations end."""
    # parts are in the order of ids, so packs of later parts follow
    ids = met.filter("depth = len").groupBy(*_NODE, "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    packs = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(PACK)), lambda at: F.slice("ids", at, F.lit(PACK)))
    packed = ids.select(*_NODE, F.explode(packs).alias("pack")).select(*_NODE, F.col("pack")[0].alias("first"), F.array_join(F.col("pack").cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        key = sha = None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
                if own == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, sha.hexdigest())])

    return packed.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, "depth int, k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[*_NODE, "ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = dealt(slim_turns(conversations))
    return trie(turns, runs(turns))


#: The same rows by prefixes as strings and by pairs of each node with those below it.
SQL = rf"""WITH {CRC_SQL}, t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, k + 1000000, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT * FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
last AS (SELECT conv_id, max(depth) AS len FROM o GROUP BY 1),
n AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len) AS ids FROM o JOIN last USING (conv_id) GROUP BY key),
s AS (SELECT a.key, count_if(b.depth = a.depth + 1) AS n_children, count_if(NOT EXISTS (SELECT 1 FROM n x WHERE x.depth = b.depth + 1 AND x.key[:-65] = b.key)) AS n_leaves,
  sum((b.n_convs - 1) * b.words) AS saved_tokens FROM n a JOIN n b ON starts_with(b.key, a.key) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN s ON n.key = s.key LEFT JOIN n p ON p.depth = n.depth - 1 AND p.key = n.key[:-65]"""
