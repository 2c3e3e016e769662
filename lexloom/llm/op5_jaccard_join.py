"""N-gram Jaccard join by PartEnum signatures.

Size bands grow by ``BAND``; a set enters its own band and the next one if a partner can be that large.  In a
band the shingle domain is hashed into disjoint partitions.  Two linked sets of sizes ``s <= r`` differ in
``d <= s // 3`` elements at 0.75, so of any ``d + 1`` partitions that hold elements of ``s`` at least one is
alike in both: a set's signatures are the contents of its first ``d + 1`` filled groups of partitions, for
every subset of ``width - spare`` of a group's ``width`` partitions (``spare`` of them may differ, which then
takes ``d // (spare + 1) + 1`` groups).  Of two sets the one that needs fewer groups settles the argument, so
the other has the same signature among its own.  A set with too few filled groups emits all of them and each
shingle by itself as well; two such sets meet there.

Shingles that are frequent in the corpus have partitions of their own at the end of the order.  That keeps a shared
passage from making signatures and has no influence on the result.  ``width`` 1 (plain partitions, one subset each) is the
default: with 3 and 1 the same guarantee took 2.3 to 2.5 times the signatures here and gave more pairs, as at 0.75 a budget of a third
of the set leaves about two elements a partition either way.

The smallest node of a signature's group is its hub.  All groups with one hub are one unit of work: the hub and every
node that shares a signature with it there, each shipped once however many signatures it shares.  A unit whose members
hold more than ``BLOCK`` elements is dealt in blocks and pairs of blocks.  Units are worked twice.  First on parity
sketches: of about two bits a shingle, bit ``i`` is the parity of the shingles that fall there, so two sketches never
differ in more bits than the sets in elements, and a pair beyond the budget is no link; nodes without a likely partner
go.  Then on the sets of the others: every pair of different components is compared exactly inside the task, components
are united there, and only links that unite two of them leave it, fewer than members.  Pairs of blocks come after all
single blocks, when most of a large group is one component already.  Equal sets are one node throughout; nodes are
64-bit digests of the whole set.

Defined cases: null, empty and blank texts have 0 shingles and are their own component; fewer than five words
make one shingle; repeated rows and ids are separate rows with the same component; a null doc_id counts as the largest
one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import blocks, discard, released, staged
from lexloom.llm.components import components
from lexloom.llm.wordhash import distinct, mix, shingles, words

WIDTH_WORDS = 5
BAND = 4.0
#: Elements a partition at the upper end of a band.
LOAD = 2.2
#: Sets that a frequent shingle is in, the most frequent ones that a task hands on, and the most that are kept.
FREQUENT, TASK_FREQUENT, MAX_FREQUENT = 16, 1 << 15, 1 << 18
#: Shingles that are counted at once.
COUNTED = 1 << 19
#: Elements of the sets of a block of a unit (a larger set is alone with its share of others).
BLOCK = 1 << 20
#: Characters of texts that are hashed at once.
TEXT_BLOCK = 1 << 18
#: Cells of the bitmap of documents whose sets are wanted.
CELLS = 1 << 26


def sets(texts: list[str], width: int = WIDTH_WORDS):
    """Shingle sets of whole texts, in order."""
    for lo, hi in blocks(texts, TEXT_BLOCK):
        hashes, counts = words(texts[lo:hi])
        for part in np.split(hashes, np.cumsum(counts)[:-1]):
            yield shingles(part, width)


def node_of(shingle_set: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingle_set.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements by hash cell; a power of two of cells, at least 64, twice the elements or more."""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length())
    count = np.bincount((mix(s, 5) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(count & 1).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, partitions) that a set of ``size`` enters."""
    most = size * 100 // percent
    own, last = (int(np.log(x) / np.log(BAND) + 1e-9) for x in (size, most))
    return [(b, max(4, round(BAND ** (b + 1) / LOAD))) for b in range(own, last + 1)]


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = 75, width: int = 1, spare: int = 0) -> np.ndarray:
    """PartEnum signatures of one sorted shingle set."""
    size = len(s)
    # of s <= r with 100 i >= percent u, s + r - 2 i is at most this
    differ = (size + size * 100 // percent) * (100 - percent) // (100 + percent)
    if differ <= 0:
        return np.zeros(0, np.uint64)  # only equal sets link, and those are one node
    at = np.searchsorted(frequent, s)
    hot = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(size, bool)
    body, need, out = mix(s, 11), differ // (spare + 1) + 1, []
    for band, parts in bands(size, percent):
        slot = ((mix(s, 100 + band) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        slot[hot] += -(-parts // width) * width
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        filled = slot[first]
        head = np.diff(filled // width, prepend=-1) != 0
        which = np.cumsum(head) - 1
        cells = np.zeros((which[-1] + 1, width), np.uint64)
        cells[which, filled % width] = np.add.reduceat(body[order], first)
        # groups of which no subset is empty count; all groups up to the last of these are used
        good = np.flatnonzero(np.bincount(which) > spare)[:need]
        cells = cells[: good[-1] + 1 if len(good) == need else None]
        number = (filled[head] // width).astype(np.uint64)[: len(cells)]
        for subset in combinations(range(width), width - spare):
            key = mix(number, 1000 + band)
            for cell in subset:
                key = mix(key + cells[:, cell], 2000 + cell)
            out.append(key[cells[:, subset].any(axis=1)])
        if len(good) < need:
            out.append(mix(s, 7))
    return distinct(np.concatenate(out))


def _arrow(docs: DataFrame, schema: str, make, columns=("text",), last=None, asked=None) -> DataFrame:
    """mapInArrow over whole texts; ``make`` maps columns, sets and the task's state to Arrow arrays, as ``last`` does at its end.

    ``asked`` picks rows of a batch before their texts are looked at.
    """
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        state = {}
        for batch in batches:
            batch = batch if asked is None else batch.filter(asked(batch))
            rows = [batch.column(c).to_pylist() for c in columns]
            texts = [t or "" for t in rows[columns.index("text")]]
            for lo, hi in blocks(texts, TEXT_BLOCK):
                out = make([r[lo:hi] for r in rows], list(sets(texts[lo:hi])), state)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays(last(state), names=names)

    return docs.select(*columns).mapInArrow(released(run), schema)


def _fresh(found: list[np.ndarray], state: dict) -> list[int | None]:
    """Nodes of the non-empty sets that this task has not met yet, else None (a bounded memory: it only saves work)."""
    seen, out = state.setdefault("seen", set()), []
    for s in found:
        node = node_of(s) if len(s) else None
        out.append(None if node in seen else node)
        if node is not None:
            seen.add(node)
    if len(seen) > 500_000:
        seen.clear()
    return out


def _tally(state: dict) -> None:
    """Counts the gathered shingles; the most frequent ones stay, all less what the best of the others has."""
    hashes, counts = state.get("held", (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    new, times = np.unique(np.concatenate(state.pop("parts", []) or [hashes[:0]]), return_counts=True)
    every, back = np.unique(np.concatenate([hashes, new]), return_inverse=True)
    total = np.bincount(back, np.concatenate([counts, times]), len(every)).astype(np.int64)
    if len(every) > 8 * TASK_FREQUENT:
        total -= np.partition(total, -8 * TASK_FREQUENT)[-8 * TASK_FREQUENT]
    state["held"], state["size"] = (every[total > 0], total[total > 0]), 0


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that ``FREQUENT`` sets or more have, at most MAX_FREQUENT; a matter of speed only.

    Each task keeps a bounded table of the most frequent ones of all its texts; the tables are added up.  Those
    that a task meets once are left out, so counts are lower bounds.
    """

    def emit(rows, found, state):
        fresh = [s for s, node in zip(found, _fresh(found, state)) if node is not None]
        state.setdefault("parts", []).extend(fresh)
        state["size"] = state.get("size", 0) + sum(map(len, fresh))
        if state["size"] > COUNTED:
            _tally(state)

    def last(state):
        _tally(state)
        hashes, counts = state["held"]
        most = np.sort(np.argsort(-counts, kind="stable")[:TASK_FREQUENT])
        most = most[counts[most] > 1]
        return [pa.array(hashes[most].view(np.int64)), pa.array(counts[most])]

    counted = _arrow(docs, "h long, n long", emit, last=last).groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(top["h"].to_numpy().astype(np.int64).view(np.uint64))


def _measured(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """doc_id, n, node of every row, and sketch and signatures where the set is new to the task."""

    def emit(rows, found, state):
        fresh = _fresh(found, state)
        sig = [signatures(s, frequent.value, percent).view(np.int64) if f is not None else None for s, f in zip(found, fresh)]
        return [
            pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
            pa.array([node_of(s) if len(s) else None for s in found], pa.int64()),
            pa.array([sketch(s) if f is not None else None for s, f in zip(found, fresh)], pa.binary()), pa.array(sig, pa.list_(pa.int64())),
        ]

    dealt = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell"), "text")
    return _arrow(dealt, "doc_id long, cell long, n long, node long, sketch binary, sigs array<long>", emit, ("doc_id", "cell", "text"))


def _units(batches):
    """Tables of the rows of one unit (hub, lo, hi), from rows sorted by them."""
    now, held = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("hub", "lo", "hi")])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if held and (key[:, a] != now).any():
                yield pa.Table.from_batches(held)
                held = []
            now = key[:, a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (hub, node, n) with ``block`` and each unit that a row takes part in, (lo, hi): all pairs of its hub's blocks.

    The hub itself is in every block, and in no pair of two.
    """
    sizes = rows.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.col("node") == F.col("hub")
    lo, hi = (F.when(own, F.col("with")).otherwise(f("block", "with")) for f in (F.least, F.greatest))
    return rows.select(*[c for c in rows.columns if c not in ("blocks", "with")], lo.alias("lo"), hi.alias("hi"))


def _near_sizes(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (hub, node, n) whose hub has another node of a size that can be linked with theirs, by classes of sizes."""
    # sizes that can be linked are in one class or in neighbouring ones
    kind = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).alias("kind")
    counted = rows.groupBy("hub", kind).agg(F.count("*").alias("here"))
    around = counted.select("hub", F.explode(F.array(*[F.col("kind") + d for d in (-1, 0, 1)])).alias("kind"), "here").groupBy("hub", "kind").agg(F.sum("here").alias("here"))
    return rows.withColumn("kind", kind).join(around.filter("here > 1").select("hub", "kind"), ["hub", "kind"], "left_semi").drop("kind")


def _worked(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "node").mapInArrow(released(work), schema)


def partnered(n: np.ndarray, raw: list, block: np.ndarray | None, percent: int) -> np.ndarray:
    """Marks the sets that have a likely partner (in another block, where ``block`` is given) by their sketches."""
    cells, out = np.array([len(x) for x in raw]), np.zeros(len(raw), bool)
    for size in np.unique(cells):  # a partner has as many cells or twice as many, which fold by halves
        short, other = np.flatnonzero(cells == size), np.flatnonzero(cells == 2 * size)
        rows = [np.frombuffer(raw[i], np.uint8) for i in short]
        rows += [x[:size] ^ x[size:] for x in (np.frombuffer(raw[i], np.uint8) for i in other)]
        flat, at = np.stack(rows), np.concatenate([short, other])
        for k in range(len(short)):
            total, apart = n[at[k + 1 :]] + n[at[k]], np.bitwise_count(flat[k + 1 :] ^ flat[k]).sum(axis=1, dtype=np.int64)
            small = np.minimum(n[at[k + 1 :]], n[at[k]])
            ok = (apart * (100 + percent) <= total * (100 - percent)) & (100 * small >= percent * (total - small))
            if block is not None:
                ok &= block[at[k + 1 :]] != block[at[k]]
            if ok.any():
                out[at[k]] = True
                out[at[k + 1 :][ok]] = True
    return out


def _likely(percent: int):
    """The rows of units that have a likely partner there."""
    names = ["hub", "node", "n", "cell"]

    def run(batches):
        out, held = [], 0
        for unit in _units(batches):
            apart = unit["block"].to_numpy() if unit["lo"][0].as_py() != unit["hi"][0].as_py() else None
            keep = partnered(unit["n"].to_numpy(), [x.as_buffer() for x in unit["sketch"]], apart, percent)
            if keep.any():
                out.append([unit[c].to_numpy()[keep] for c in names])
                held += int(keep.sum())
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def forest(found: list[np.ndarray], root: np.ndarray, block: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that unite all components (``root``) of the sets which links join, one for each union.

    With ``block`` only sets of different blocks are compared.
    """
    order = np.argsort([len(s) for s in found], kind="stable")
    size, root = np.array([len(found[i]) for i in order]), root[order].copy()
    ends = np.cumsum(size)
    names, number = np.unique(np.concatenate([found[i] for i in order]), return_inverse=True)
    mark, out = np.zeros(len(names), bool), []
    least = np.searchsorted(size, -(-size * percent // 100), "left")  # partners of at least this size
    for i in range(1, len(order)):
        lo = int(least[i])
        wanted = root[lo:i] != root[i]
        if block is not None:
            wanted &= block[order[lo:i]] != block[order[i]]
        some = lo + np.flatnonzero(wanted)
        if not some.size:
            continue
        mark[number[ends[i] - size[i] : ends[i]]] = True
        if 2 * some.size > i - lo:
            begin = ends[lo] - size[lo]
            both = np.add.reduceat(mark[number[begin : ends[i - 1]]], ends[lo:i] - size[lo:i] - begin, dtype=np.int64)[some - lo]
        else:
            both = np.array([np.count_nonzero(mark[number[ends[j] - size[j] : ends[j]]]) for j in some])
        mark[number[ends[i] - size[i] : ends[i]]] = False
        near = some[100 * both >= percent * (size[i] + size[some] - both)]
        if near.size:
            roots, first = np.unique(root[near], return_index=True)
            out += [(int(order[i]), int(order[j])) for j in near[first]]
            root[np.isin(root, roots)] = root[i]
    return out


def _links(percent: int):
    """(a, b) that unite components within units, by comparison of the sets."""

    def run(batches):
        left, right, unpack = [], [], zstandard.ZstdDecompressor().decompress
        for unit in _units(batches):
            node, first = np.unique(unit["node"].to_numpy(), return_index=True)
            if len(node) > 1:
                found = list(sets([unpack(x.as_buffer()).decode() for x in unit["text"].take(first)]))
                apart = unit["block"].to_numpy()[first] if unit["lo"][0].as_py() != unit["hi"][0].as_py() else None
                for i, j in forest(found, unit["root"].to_numpy()[first], apart, percent):
                    left.append(node[i])
                    right.append(node[j])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _bits(wanted: DataFrame) -> np.ndarray:
    """The cells of ``wanted`` as bits, of fixed size."""
    found = wanted.groupBy((F.col("cell") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(CELLS // 64, np.int64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def cells(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``doc_id`` values; others may share their cells."""
    return _bits(ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")))


def in_cells(docs: DataFrame, bitmap: np.ndarray, hit: bool) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in a cell of the bitmap, or those that are in none."""
    sent, n = docs.sparkSession.sparkContext.broadcast(bitmap), len(docs.columns)

    def run(batches):
        for batch in batches:
            cell = batch.column(n).to_numpy()
            found = (sent.value[cell >> 6] >> (cell & 63) & 1).astype(bool)
            yield batch.filter(pa.array(found == hit)).select(list(range(n)))

    return docs.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))).mapInArrow(released(run), docs.schema)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the documents whose ``cell`` is wanted; others are passed over.

    Texts travel to the units, compressed one by one, and are shingled there: that is a fraction of their sets' size.
    """
    bitmap = _bits(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def asked(batch):
        cell = batch.column("cell").to_numpy()
        return pa.array((sent.value[cell >> 6] >> (cell & 63) & 1).astype(bool))

    def emit(rows, found, state):
        pack = state.setdefault("pack", zstandard.ZstdCompressor(level=6)).compress
        got = [(f, pack((t or "").encode())) for f, t in zip(_fresh(found, state), rows[0]) if f is not None]
        return [pa.array([f for f, _ in got], pa.int64()), pa.array([t for _, t in got], pa.binary())]

    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell"), "text")
    return _arrow(texts, "node long, text binary", emit, ("text", "cell"), asked=asked)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    base = staged(_measured(docs, frequent, percent), "jaccard-base")
    # groups of more than one node; one shuffle, grouped and ranked by sig
    emitted = base.filter("sigs is not null").select(F.explode("sigs").alias("sig"), "node")
    spread = emitted.repartition("sig").sortWithinPartitions("sig", "node")
    pairs = spread.mapInArrow(released(_groups), "sig long, node long, hub long").select("hub", "node").distinct()
    fresh = base.filter("sigs is not null")
    met = staged(_near_sizes(pairs.join(fresh.groupBy("node").agg(F.first("n").alias("n")), "node"), percent), "jaccard-pairs")
    # first() takes any of equal sketches, and any document that has the set
    nodes = fresh.groupBy("node").agg(*(F.first(c).alias(c) for c in ("cell", "sketch")))
    likely = staged(_worked(_dealt(met).join(nodes, "node"), _likely(percent), "hub long, node long, n long, cell long").distinct(), "jaccard-likely")
    discard(met)
    held = staged(_texts_of(docs, likely), "jaccard-texts")
    members = staged(_dealt(likely).select("hub", "node", "block", "lo", "hi"), "jaccard-members")
    links = _worked(members.filter("lo = hi").join(held, "node").withColumn("root", F.col("node")), _links(percent), "a long, b long")
    links = staged(links, "jaccard-links")
    labels = components(links, "a", "b")
    if members.filter("lo < hi").limit(1).count():
        crossed = members.filter("lo < hi").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = _worked(crossed.join(held, "node"), _links(percent), "a long, b long")
        first, labels = labels, components(links.unionByName(more), "a", "b")
        discard(first)
    discard(held, likely, members, links)
    rows = base.select("doc_id", "n", "node")
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = least.join(of_root, "root").select("node", "component_id")
    return rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _groups(batches):
    """Rows sorted by (sig, node) -> distinct rows of groups of two nodes or more, with the group's least node."""
    carry_sig = carry_node = carry_hub = None
    carry_out = True  # whether the carried row is already out or alone so far
    for batch in batches:
        sig, node = (batch.column(c).to_numpy() for c in ("sig", "node"))
        if not len(sig):
            continue
        if carry_sig is not None:
            sig, node = np.concatenate(([carry_sig], sig)), np.concatenate(([carry_node], node))
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        fresh = new.copy()
        fresh[1:] |= node[1:] != node[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hub = node[first][group]
        if carry_sig is not None:
            hub[group == 0] = carry_hub
        many = np.zeros(len(first), bool)
        np.logical_or.at(many, group, node != hub)
        ready = fresh & many[group]
        if carry_sig is not None and carry_out:
            ready[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[ready]) for x in (sig, node, hub)], names=["sig", "node", "hub"])
        # the last group may go on: its last row is carried; it is out if its group has shown a second node
        last = bool(many[group[-1]])
        if carry_sig is not None and group[-1] == 0 and carry_out:
            last = True
        carry_sig, carry_node, carry_hub, carry_out = sig[-1], node[-1], hub[-1], last
