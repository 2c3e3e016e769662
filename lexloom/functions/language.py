"""The main language of a text: by a trained profile, else by scripts and frequent words."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import ngrams
from lexloom.functions import text as T

# Scripts that stand for one language, and frequent words of languages in Latin script.
SCRIPTS = {
    "ru": r"[\x{0400}-\x{04FF}]", "el": r"[\x{0370}-\x{03FF}]", "he": r"[\x{0590}-\x{05FF}]", "ar": r"[\x{0600}-\x{06FF}]",
    "hi": r"[\x{0900}-\x{097F}]", "th": r"[\x{0E00}-\x{0E7F}]",
}
WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "be", "this", "are", "not", "have", "from", "by"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von", "auf", "für", "im", "dem", "sich", "auch", "wird", "sind"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "que", "qui", "pour", "pas", "sur", "au", "avec", "ce", "il", "sont", "du", "nous", "vous"],
    "es": ["el", "los", "las", "que", "y", "en", "una", "por", "con", "para", "es", "del", "se", "no", "su", "al", "lo", "como", "más", "pero"],
    "it": ["il", "che", "di", "e", "la", "per", "un", "non", "sono", "con", "della", "gli", "nel", "anche", "è", "più", "ma", "questo", "alla", "i"],
    "pt": ["o", "os", "que", "e", "do", "da", "em", "um", "uma", "não", "para", "com", "por", "mais", "como", "dos", "na", "ao", "são", "se"],
    "nl": ["de", "het", "een", "en", "van", "is", "dat", "niet", "op", "te", "zijn", "met", "voor", "aan", "er", "ook", "maar", "bij", "nog", "wordt"],
}
KANA, HANGUL = r"[\x{3040}-\x{30FF}]", r"[\x{AC00}-\x{D7AF}]"
#: Characters that are looked at, as in the detector whose answers these stand for.
SEEN = 1000


def _hits(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(own)))


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """The code points of a class of characters."""
    return [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", pattern)]


class _Classes:
    """Which classes a code point is in, one bit each; made once a worker."""

    table: np.ndarray | None = None
    BROAD, KANA, HANGUL, LETTER = range(4)

    @classmethod
    def of(cls) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, np.uint16)
            for bit, pattern in enumerate([V.BROAD, KANA, HANGUL, None, *SCRIPTS.values()]):
                for a, b in _ranges(pattern) if pattern else ():
                    table[a : b + 1] |= 1 << bit
            table[ngrams.letters()] |= 1 << cls.LETTER
            cls.table = table
        return cls.table


def answers(texts: Sequence[str | None], profile: ngrams.Profile, seen: int | None, least: int) -> list[str | None]:
    """The rules of :func:`detect` for texts in memory."""
    told, out = profile.best([t if t is None or seen is None else t[:seen] for t in texts]), []
    c, scripts = _Classes, [(k, lang) for k, lang in enumerate(SCRIPTS, 4) if lang not in profile.languages]
    for text, best in zip(texts, told):
        size = len(text.strip()) if text else 0
        if size < least:
            out.append(None)
            continue
        held = c.of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        part = held if seen is None else held[:seen]
        count = lambda bit, where: int(np.count_nonzero(where & (1 << bit)))
        if count(c.BROAD, held) > 0.1 * size:
            out.append("ja" if count(c.KANA, part) else "ko" if count(c.HANGUL, part) else "zh")
        else:
            some, letters = int(np.bitwise_or.reduce(part, initial=0)), count(c.LETTER, part)
            out.append(next((lang for k, lang in scripts if some >> k & 1 and count(k, part) * 3 > letters), best))
    return out


def detect(text: Column, profile: ngrams.Profile | None = None, seen: int | None = SEEN, least: int = 10) -> Column:
    """ISO 639-1 code, null for fewer than ``least`` characters or without any sign of a language.

    More than a tenth of Chinese, Japanese or Korean characters decide by their script; then scripts of languages that the
    profile does not know, with more than a third of the letters; then the profile, in Arrow batches.  Without a profile the language with most
    frequent words (ties: in the order above), in column functions.  All but the first rule look at ``seen`` characters, or at all (None).
    """
    if profile is not None:

        @F.pandas_udf("string")
        def work(texts: pd.Series) -> pd.Series:
            return pd.Series(answers(texts.tolist(), profile, seen, least), dtype=object)

        return work(text)
    part = text if seen is None else F.left(text, F.lit(seen))
    count = lambda pattern: F.regexp_count(part, F.lit(pattern))
    east = F.when(count(KANA) > 0, "ja").when(count(HANGUL) > 0, "ko").otherwise("zh")
    letters = F.regexp_count(part, F.lit(r"\p{L}"))
    out = F.when(T.count_broad(text) > 0.1 * F.length(T.strip_u(text)), east)
    for lang, pattern in SCRIPTS.items():
        out = out.when(count(pattern) * 3 > letters, lang)
    words = F.split(F.lower(part), r"[^\p{L}]+")
    hits = [(lang, _hits(words, own)) for lang, own in WORDS.items()]
    most = F.greatest(*[n for _, n in hits])
    for lang, n in hits:
        out = out.when((most > 0) & (n == most), lang)
    return F.when(F.length(T.strip_u(text)) >= least, out)


def detect_prose(prose: Column, profile: ngrams.Profile | None = None, seen: int | None = SEEN) -> Column:
    """As :func:`detect`, for the prose of a file, of which at least twenty characters are needed."""
    return detect(prose, profile, seen, 20)
