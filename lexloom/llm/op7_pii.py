"""PII: base patterns plus information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers; their values are the protected
entities.  The ``WINDOW`` words before and after an entity, other spans passed over and however far apart, are its
candidates.  Over the whole corpus, with ``D`` documents, a term ``t`` discloses an entity ``e`` to the degree

    ``log(D * n(e,t) / (n(e) * n(t))) / log(D / n(e))``

that is, by their pointwise mutual information as a share of the entity's information (1: whoever sees the term
knows the entity).  A pair that stands together in ``SUPPORT`` documents or more and reaches ``DISCLOSURE``
exceeds the threshold: in every document that holds the entity, each occurrence of the term outside base spans becomes a
span of kind ``term``.  Documents without the entity keep the term, as nothing is protected in them that it could tell.
An entity or pair met in one document only says nothing about the corpus and discloses nothing.  ``sanitise`` generalises
base spans to their kind in brackets and removes terms.

Counts cover all documents.  Terms are held as 64-bit hashes; a bitmap of fixed size (sent to the workers) spares
counting most words that are nobody's candidate.

Defined cases: null and empty texts have no spans; repeated rows count each as a document and are answered row by
row; digits of any length are read whole; an empty table gives an empty table; other columns are ignored
(``spans``) or stay, whatever their names (``sanitise``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm.common import released, staged

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, SUPPORT, DISCLOSURE = 6, 2, 0.9
#: Words whose hashes a task remembers, and counts that it holds, before it begins anew.
REMEMBERED = 100_000
BITMAP = 1 << 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# an address always begins where a run of digits begins, so no run is tried from its middle
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        # what lies before a failed @ can't belong to a later address
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = re.sub("[^0-9]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def words(text: str, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    """Words outside of all spans, in order; a span parts the words beside it."""
    out, at = [], 0
    for a, _, b in [*spans, (len(text), 0, len(text))]:
        if a > at:
            out += _WORD.finditer(text, at, a)
        at = max(at, b)
    return out


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(entity, term) of the WINDOW words outside of all spans before and after each span, each pair once."""
    found = words(text, spans) if spans else []
    begin, out = [m.start() for m in found], {}
    hashes: dict[str, int] = {}
    for a, kind, b in spans:
        entity = _hash(f"{KINDS[kind]}:{text[a:b].lower()}")
        k, n = bisect_left(begin, a), bisect_left(begin, b)
        for m in (*found[max(0, k - WINDOW) : k], *found[n : n + WINDOW]):
            word = m[0].lower()
            if word not in hashes:
                hashes[word] = _hash(word)
            out[entity, hashes[word]] = None
    return list(out)


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
_FOUND = "held string, base array<struct<kind:int,s:long,e:long>>, near array<struct<entity:long,term:long>>"


def _find(batches):
    """Base spans and their candidates beside each batch's first column; ``held`` is the text where it has spans."""
    for batch in batches:
        base, near, held = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            base.append([{"kind": k, "s": a, "e": b} for a, k, b in spans])
            near.append([{"entity": e, "term": t} for e, t in contexts(text or "", spans)])
            held.append(text if spans else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.string()), pa.array(base, _SPAN), pa.array(near, _NEAR)], names=["kept", "held", "base", "near"])


def _found(docs: DataFrame, kept: Column) -> DataFrame:
    """``kept`` of each row beside what :func:`_find` tells of its text; one pass."""
    given = docs.select(kept.alias("kept"), F.col("text").alias("text"))
    schema = StructType([given.schema["kept"], *StructType.fromDDL(_FOUND)])
    return given.mapInArrow(released(_find), schema)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the terms' cells, of fixed size."""
    cells = terms.select(F.pmod("term", F.lit(BITMAP)).alias("c"))
    found = cells.groupBy((F.col("c") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


class _Known:
    """Hashes of words whose bit is set, else None; a bounded memory of words."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.held = bits, {}

    def __call__(self, word: str) -> int | None:
        h = self.held.get(word, 0)
        if h == 0:
            if len(self.held) > REMEMBERED:
                self.held.clear()
            h = _hash(word)
            c = h % BITMAP
            h = self.held[word] = h if self.bits[c >> 6] >> (c & 63) & 1 else None
        return h


def disclosing(docs: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """(entity, term) pairs beyond the threshold, from ``near`` of ``found`` and the words of all ``total`` rows of ``docs``."""
    some = found.filter(F.size("near") > 0)
    pairs = some.select(F.inline("near"))
    entities = some.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    together = staged(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= SUPPORT), "pii-pairs")
    bitmap = _bitmap(together)
    if not bitmap.any():
        return together.select("entity", "term").limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches):
        held: Counter = Counter()
        known = _Known(sent.value)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(h for h in map(known, set(_WORD.findall((text or "").lower()))) if h is not None)
            if len(held) > REMEMBERED:
                yield flush()
                held = Counter()
        if held:
            yield flush()

    terms = docs.select("text").mapInArrow(released(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = together.join(terms, "term").join(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity")
    seen = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    return scored.filter((F.col("n_entity") < total) & (seen >= DISCLOSURE * F.log(F.lit(float(total)) / F.col("n_entity")))).select("entity", "term")


def _with_terms(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` (with ``row``) and ``terms``: all occurrences of terms that disclose an entity of the row."""
    sent = found.sparkSession.sparkContext.broadcast(_bitmap(pairs))

    def occurrences(batches):
        known = _Known(sent.value)
        for batch in batches:
            out = []
            for row, text, base in zip(*(batch.column(c).to_pylist() for c in ("row", "held", "base"))):
                for m in words(text, [(x["s"], x["kind"], x["e"]) for x in base]):
                    term = known(m[0].lower())
                    if term is not None:
                        out.append((row, term, m.start(), m.end()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["row", "term", "s", "e"])

    met = found.filter(F.size("base") > 0).select("row", "held", "base").mapInArrow(released(occurrences), "row long, term long, s long, e long")
    # a term is near the few entities that it discloses, so rows grow by that; the entity must be the row's own
    own = found.filter(F.size("near") > 0).select("row", F.inline("near")).select("row", "entity").distinct()
    told = met.join(pairs, "term").join(own, ["row", "entity"], "left_semi")
    terms = told.groupBy("row").agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "s", "e")).alias("terms"))
    return found.join(terms, "row", "left")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and n_term) of every row of ``docs``."""
    found = staged(_found(docs, F.col("doc_id")).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    every = _with_terms(found, staged(disclosing(docs, found, found.count()), "pii-terms")).withColumnRenamed("kept", "doc_id")

    def told(column):
        name = F.element_at(F.array(*map(F.lit, KINDS)), column["kind"] + 1)
        return F.concat_ws(":", name, column["s"].cast("string"), column["e"].cast("string"))

    def joined(column):
        order = F.array_sort(F.transform(column, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
        return F.array_join(F.transform(order, told), ",")

    full = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<kind:int,s:long,e:long>>")))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long) as n_{KINDS[k]}") for k in range(4)]
    n_term = F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term")
    return every.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(full).alias("spans"), n_term)


def rewrite(text: str, found: list[tuple[int, int, int]]) -> str:
    """Base spans become their kind in brackets, terms go; of overlapping spans the first counts, then the longer."""
    out, at = [], 0
    for a, kind, b in sorted(found, key=lambda x: (x[0], -x[2])):
        if a < at:
            at = max(at, b)  # the rest of an overlapping span goes as well
            continue
        out += [text[at:a], "" if kind == 4 else f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised and disclosing terms removed; columns stay, n_chars follows the text.

    Rows without base spans pass as they are; only the others are staged and joined with what was found.
    """
    names, schema = docs.columns, docs.schema

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array([not base_spans(t or "") for t in batch.column("text").to_pylist()], pa.bool_()))

    def write(batches):
        for batch in batches:
            columns = batch.column("kept").flatten()
            texts = []
            for text, *lists in zip(*(batch.column(c).to_pylist() for c in ("held", "base", "terms"))):
                texts.append(rewrite(text, [(x["s"], x["kind"], x["e"]) for part in lists for x in part or []]))
            columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(list(map(len, texts)), columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # a row's own columns travel in one, so that none can clash with what is found
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    found = staged(_found(docs, whole).filter(F.size("base") > 0).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    pairs = staged(disclosing(docs, found, docs.count()), "pii-terms")
    told = _with_terms(found, pairs).select("kept", "held", "base", "terms")
    return docs.mapInArrow(released(clean), schema).unionByName(told.mapInArrow(released(write), schema))
