"""Secrets [native]: base patterns, and candidate strings with windows of high Shannon entropy.

Column functions only: no Python runs on executors, nothing is shuffled or gathered, and each row is answered alone.

*Base* spans: ``assign`` (a telling name, a sign, a value of six or more), ``access`` (``AKIA`` and capitals or digits,
twenty or more), ``hex`` (twenty-four or more lower-case hexadecimal digits); leftmost, non-overlapping for each kind.

*Method*: candidates are the runs of ``[A-Za-z0-9+/_=-]`` of ``WINDOW`` signs or more with a digit.  A window slides
over a candidate sign by sign; how often each sign stands in it is kept in one short string, of which the entering and
the leaving sign change one place each, and with it changes the sum of ``c*log2(c)``, held in whole millionths of a bit so
that it stays exact however far the window slides; likewise the signs of each class.  The classes of a window, by what it holds
besides ``+/_=-``:

    ``hex``    digits and a-f, or digits and A-F       3.0 bits a sign or more
    ``single`` digits and letters of one case          3.7
    ``mixed``  digits and letters of both cases        3.9

Windows without digits or without letters belong to none and are never reported.  A window at or above its class's bits
is a finding, unless the candidate matches one of ``ALLOWED`` (words that mark samples, keyboard and alphabet rows,
UUIDs, names joined by signs).  Overlapping and touching findings of a candidate become one ``entropy`` span.  Base spans are
never suppressed.

A candidate beyond ``STRETCH`` signs is read in stretches of which each sees the ``WINDOW - 1`` signs after it, so no
window is lost; the allow-list is then asked for each stretch.

Defined cases: null and empty texts have no spans; very long texts and candidates are read whole, in time linear in
their size but for the running sums of match positions (matches to the power 1.5); repeated rows are answered row by row; spans that
begin together are in the order of ``KINDS``; an empty table gives an empty table; other columns stay, whatever their names
(``find``), or are ignored (``digests``).
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short need not be matched to be dropped: no shorter part of a run begins one that is long enough.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6

WINDOW, STRETCH = 20, 4096
SIGNS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
BITS = {"hex": 3.0, "single": 3.7, "mixed": 3.9}
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxx",
    r"(?i)abcdefgh|qwertyui|01234567|12345678",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*[0-9]{0,4}(?:[-_/=+][A-Za-z]*[0-9]{0,4})+$",
)

_RUN = "[A-Za-z0-9+/_=-]"
_PIECE = f"({_RUN}{{{WINDOW},{STRETCH}}})(?=({_RUN}{{0,{WINDOW - 1}}}))"
_SPAN = "array<struct<kind:int,start:long,end:long,bits:double>>"


def weight(n: int) -> int:
    """``n * log2(n)`` in whole millionths."""
    return round(1e6 * n * log2(n)) if n else 0


def most(bits: float) -> int:
    """The largest sum of weights with which a window has ``bits`` a sign or more."""
    return weight(WINDOW) - round(1e6 * WINDOW * bits)


def _let(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _sums(sizes: Column) -> Column:
    """struct(sums, total): the sum of what stands before each element of a short array."""
    start = F.struct(F.array().cast("array<long>").alias("sums"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(sizes, start, lambda a, x: F.struct(F.array_append(a["sums"], a["total"]).alias("sums"), (a["total"] + x).alias("total")))


def running(sizes: Column) -> Column:
    """The sum of what stands before each element.

    Groups of about the root of the length are summed alone and then moved by what stands before them, as an array that grows
    element by element costs the square of its length.
    """

    def grouped(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        count = F.ceil(F.size(all_) / width).cast("int")
        groups = F.transform(F.sequence(F.lit(0), count - 1), lambda k: _sums(F.slice(all_, k * width + 1, width)))
        moved = lambda g: F.zip_with(g, _sums(F.transform(g, lambda x: x["total"]))["sums"], lambda x, by: F.transform(x["sums"], lambda n: n + by))
        return F.flatten(_let(groups, moved))

    return F.when(F.size(sizes) > 0, _let(sizes, grouped)).otherwise(F.array().cast("array<long>"))


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Where each match begins, in code points."""
    gaps = F.split(text, pattern, -1)
    return F.zip_with(running(F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))), gaps, lambda before, g: before + F.length(g))


def _base(text: Column) -> Column:
    """Base spans of all kinds, sorted."""

    def spans(kind: int, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        # there is one gap more than matches, hence the nulls at the end
        made = _let(found, lambda m: F.zip_with(m, _starts(text, pattern, m), lambda x, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x)).alias("end"), F.lit(None).cast("double").alias("bits"))))
        return F.filter(made, lambda x: x["end"].isNotNull())

    assign = F.zip_with(spans(0, ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), 2), lambda s, v: F.when(F.length(v) >= LEAST_VALUE, s))
    none = F.array().cast(_SPAN)
    parts = [F.when(text.rlike(ASSIGN), F.array_compact(assign)), F.when(text.contains("AKIA"), spans(1, ACCESS)), F.when(text.rlike(HEX), spans(2, HEX))]
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]), _in_order)


def _in_order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["start"], x["kind"], x["end"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


_STATE = "held string, sum long, at int, digits int, lower int, upper int, hex_lower int, hex_upper int, open long, until long, best long, out array<struct<start:long,end:long,best:long>>"


def _slide(a: Column, z: Column) -> Column:
    """The window after sign ``z.x`` has entered and sign ``z.y`` (0: none) has left; both are places in SIGNS."""
    gains = F.array(*[F.lit(weight(n + 1) - weight(n)) for n in range(WINDOW)])
    count = lambda held, code: F.ascii(F.substr(held, code, F.lit(1))) - 48
    put = lambda held, code, n: F.overlay(held, F.chr((n + 48).cast("long")), code, F.lit(1))
    x, y = z["x"], z["y"]
    moved = lambda name, low, high: (a[name] + F.when(x.between(low, high), 1).otherwise(0) - F.when(y.between(low, high), 1).otherwise(0)).alias(name)

    def entered(b: Column) -> Column:
        n = count(b["held"], x)
        return F.struct(
            put(b["held"], x, n + 1).alias("held"), (b["sum"] + F.get(gains, n)).alias("sum"), (a["at"] + 1).alias("at"),
            moved("digits", 1, 10), moved("lower", 11, 36), moved("upper", 37, 62), moved("hex_lower", 11, 16), moved("hex_upper", 37, 42),
        )

    left = F.when(y == 0, F.struct(a["held"].alias("held"), a["sum"].alias("sum"))).otherwise(
        _let(count(a["held"], y), lambda n: F.struct(put(a["held"], y, n - 1).alias("held"), (a["sum"] - F.get(gains, n - 1)).alias("sum")))
    )

    def judged(b: Column) -> Column:
        letters = b["lower"] + b["upper"]
        hexed = ((b["upper"] == 0) & (b["lower"] == b["hex_lower"])) | ((b["lower"] == 0) & (b["upper"] == b["hex_upper"]))
        limit = F.when(hexed, most(BITS["hex"])).when((b["lower"] == 0) | (b["upper"] == 0), most(BITS["single"])).otherwise(most(BITS["mixed"]))
        told = (b["at"] >= WINDOW) & (b["digits"] > 0) & (letters > 0) & (b["sum"] <= limit)
        end = b["at"].cast("long")
        apart = told & (a["open"] >= 0) & (end - WINDOW > a["until"])
        fresh = told & ((a["open"] < 0) | apart)
        return F.struct(
            *[b[n].alias(n) for n in ("held", "sum", "at", "digits", "lower", "upper", "hex_lower", "hex_upper")],
            F.when(fresh, end - WINDOW).otherwise(a["open"]).alias("open"), F.when(told, end).otherwise(a["until"]).alias("until"),
            F.when(fresh, b["sum"]).when(told, F.least(a["best"], b["sum"])).otherwise(a["best"]).alias("best"),
            F.when(apart, F.array_append(a["out"], _open(a))).otherwise(a["out"]).alias("out"),
        )

    return _let(_let(left, entered), judged)


def _open(a: Column) -> Column:
    return F.struct(a["open"].alias("start"), a["until"].alias("end"), a["best"].alias("best"))


def _windows(piece: Column) -> Column:
    """(start, end, best) of the findings of one stretch; ``best`` is the least sum of weights, which is the most entropy."""
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(SIGNS), c))
    pairs = lambda all_: F.slice(F.zip_with(all_, F.concat(F.array_repeat(F.lit(0), WINDOW), all_), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.lit(1), F.size(all_))
    none = [F.lit("0" * len(SIGNS)), *[F.lit(0)] * 7, F.lit(-1), F.lit(-1), F.lit(0), F.array()]
    start = F.struct(*[v.cast(kind).alias(name) for v, (name, kind) in zip(none, (part.split(" ", 1) for part in _STATE.split(", ")))])
    return F.aggregate(_let(codes, pairs), start, _slide, lambda a: F.when(a["open"] < 0, a["out"]).otherwise(F.array_append(a["out"], _open(a))))


def _joined(spans: Column) -> Column:
    """Findings in order of place, with those that overlap or touch made one (stretches of one candidate share windows)."""

    def merged(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (F.get(s, k - 1)["start"] > F.get(s, k - 2)["end"]))

        def told(h: Column) -> Column:
            lasts = F.concat(F.transform(F.slice(h, F.lit(2), F.size(h)), lambda k: k - 1), F.array(F.size(s)))
            bits = lambda best: (F.lit(weight(WINDOW)) - best) / (1e6 * WINDOW)
            return F.zip_with(h, lasts, lambda a, b: F.struct(
                F.lit(3).alias("kind"), F.get(s, a - 1)["start"].alias("start"), F.get(s, b - 1)["end"].alias("end"),
                bits(F.array_min(F.transform(F.sequence(a, b), lambda k: F.get(s, k - 1)["best"]))).alias("bits"),
            ))

        return _let(heads, told)

    return F.when(F.size(spans) > 0, _let(spans, merged)).otherwise(F.array().cast(_SPAN))


def _entropy(text: Column, allowed: tuple[str, ...]) -> Column:
    """``entropy`` spans, in order."""
    pieces = lambda k: F.regexp_extract_all(text, F.lit(_PIECE), k)
    held = _let(pieces(1), lambda p: F.zip_with(F.zip_with(p, pieces(2), lambda a, b: F.struct(a.alias("own"), F.concat(a, b).alias("whole"))), _starts(text, _PIECE, p), lambda x, at: F.struct(x["own"].alias("own"), x["whole"].alias("whole"), at.alias("at"))))
    kept = lambda x: x["own"].isNotNull() & x["whole"].rlike("[0-9]") & ~x["own"].rlike("|".join(f"(?:{p})" for p in allowed) if allowed else r"\z.")
    found = F.transform(F.filter(held, kept), lambda x: F.transform(_windows(x["whole"]), lambda w: F.struct((w["start"] + x["at"]).alias("start"), (w["end"] + x["at"]).alias("end"), w["best"].alias("best"))))
    # a run with a digit, long enough: asked first, as most texts have none
    some = text.rlike(f"(?=[A-Za-z+/_=-]{{0,{STRETCH}}}[0-9]){_RUN}{{{WINDOW}}}")
    return F.when(some, _joined(F.flatten(found))).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``secrets``: base and method spans as array<struct<kind, start, end, bits>>, sorted by start and kind.

    ``start`` and ``end`` (exclusive) count code points; ``bits`` is the highest entropy a sign of a span's windows (null
    for base spans).  A column of that name is replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = F.array_sort(F.concat(_base(body), _entropy(body, allowed)), _in_order)
    name = lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"], s["end"], s["bits"])
    return docs.withColumn("secrets", F.transform(told, name))


def digests(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_entropy) of every row of ``docs``."""
    found = find(docs.select("doc_id", "text"), "text", allowed)
    base = lambda s: s["kind"] != KINDS[3]
    joined = lambda all_: F.array_join(F.transform(all_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as long) as n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(F.filter("secrets", base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), counts[3])


_Q = lambda pattern: pattern.replace("'", "''")


def _at(kind: str, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, s, s + length(m) AS e FROM (
  SELECT doc_id, found[i] AS m, given[i] AS v, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT doc_id, string_split_regex(t, '{_Q(pattern)}') AS gaps, regexp_extract_all(t, '{_Q(pattern)}', 0) AS found, regexp_extract_all(t, '{_Q(pattern)}', {2 if kind == "assign" else 0}) AS given FROM d), range(1, len(found) + 1) r(i)) WHERE {keep}"""


_LIMIT = f"""CASE WHEN NOT regexp_matches(w, '[0-9]') OR NOT regexp_matches(w, '[A-Za-z]') THEN -1
    WHEN regexp_full_match(w, '[0-9a-f+/_=-]+|[0-9A-F+/_=-]+') THEN {most(BITS["hex"])} WHEN NOT regexp_matches(w, '[a-z]') OR NOT regexp_matches(w, '[A-Z]') THEN {most(BITS["single"])} ELSE {most(BITS["mixed"])} END"""
_WEIGHTS = ", ".join(str(weight(n)) for n in range(1, WINDOW + 1))

#: The same rows where no candidate is longer than STRETCH: entropy from the counts of each window, taken anew.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_at("assign", ASSIGN, f"length(v) >= {LEAST_VALUE}")} UNION ALL {_at("access", "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_at("hex", "[0-9a-f]+", "length(m) >= 24")}),
runs AS (SELECT doc_id, s, e, substr(t, s + 1, e - s) AS run FROM ({_at("entropy", f"{_RUN}{{{WINDOW},}}", "true")}) JOIN d USING (doc_id)),
windows AS (SELECT doc_id, s, s + i AS a, substr(run, i + 1, {WINDOW}) AS w FROM runs, range(0, e - s - {WINDOW - 1}) r(i)
  WHERE regexp_matches(run, '[0-9]') AND NOT ({" OR ".join(f"regexp_matches(run, '{_Q(p)}')" for p in ALLOWED)})),
hits AS (SELECT doc_id, s, a FROM windows WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ([{_WEIGHTS}])[length(w) - length(replace(w, c, ''))])) <= {_LIMIT}),
marked AS (SELECT *, (coalesce(a - lag(a) OVER (PARTITION BY doc_id, s ORDER BY a), 1000) > {WINDOW})::INT AS head FROM hits),
grouped AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, s ORDER BY a) AS g FROM marked),
found AS (SELECT doc_id, 'entropy' AS kind, 3 AS k, min(a) AS s, max(a) + {WINDOW} AS e FROM grouped GROUP BY doc_id, s, g),
every AS (SELECT * FROM base UNION ALL SELECT * FROM found),
told AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, count_if(kind = 'entropy') AS n_entropy,
  string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k, e) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM d LEFT JOIN told USING (doc_id)"""
