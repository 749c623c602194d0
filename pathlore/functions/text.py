"""Names and paths: folding, graphemes, words, grams, sort keys, ids and Latin aliases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"
_WIDE = [chr(c) for c in [0x3000, *range(0xFF01, 0xFF5F), *range(0xFF66, 0xFF9E)]]
_NARROW = [unicodedata.normalize("NFKC", c) for c in _WIDE]


def ascii_only(col: Column) -> Column:
    """Whether each character is a byte: a test in generated code, without a pattern."""
    return F.octet_length(col) == F.length(col)


def _icu(method: str, col: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(col, F.lit("")), F.lit(False))


def normalize(col: Column) -> Column:
    """Lower case, without diacritics and in one width; null stays null. ASCII skips the Unicode steps."""
    one_width = F.translate(col, "".join(_WIDE), "".join(_NARROW))
    bare = F.regexp_replace(_icu("decompose", one_width), "[̀-ͯ]", "")
    folded = F.regexp_replace(F.lower(_icu("compose", bare)), "̇", "")
    return F.when(col.isNull(), None).when(~ascii_only(col), folded).otherwise(F.lower(col))


def graphemes(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"\X"), F.lit(0))


def n_graphemes(col: Column) -> Column:
    return F.when(~ascii_only(col) | col.contains("\r\n"), F.size(graphemes(col))).otherwise(F.length(col))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased, empty if none; a dot-file has none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def _plain(col: Column) -> Column:
    """Whether each character is a grapheme."""
    return ascii_only(col) & ~col.contains("\r\n")


def head(col: Column, n: int) -> Column:
    """The first n graphemes."""
    return F.when(_plain(col), F.substring(col, 1, n)).otherwise(F.array_join(F.slice(graphemes(col), 1, n), ""))


def grams(alias: Column, n: int) -> Column:
    """Distinct n-grams of graphemes; none if the alias is shorter. Only aliases that aren't plain are cut into graphemes, once."""
    starts = lambda size: F.sequence(F.lit(1), size - (n - 1))
    plain = F.transform(starts(F.length(alias)), lambda i: F.substring(alias, i, F.lit(n)))
    other = F.transform(F.array(graphemes(alias)), lambda g: F.transform(starts(F.size(g)), lambda i: F.array_join(F.slice(g, i, n), "")))[0]
    return F.when(n_graphemes(alias) >= n, F.array_distinct(F.when(_plain(alias), plain).otherwise(other))).otherwise(F.array().cast("array<string>"))


def natural_key(path: Column) -> Column:
    """Orders digits by value, however many; over the normalized path. A run of digits is written without zeros before
    it, after its length, and that after the length's own length, which is one character: longer numbers come later."""
    runs = F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def number(r: Column) -> Column:
        bare = F.ltrim(r, F.lit("0"))
        size = F.length(bare).cast("string")
        return F.concat(F.length(size).cast("string"), size, bare)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(r)), "")


@F.pandas_udf(T.LongType())
def stable_id(paths: pd.Series) -> pd.Series:
    """64-bit FNV-1a over UTF-8 bytes, as a signed number; a whole batch at a time, byte by byte."""
    data = [(p or "").encode() for p in paths]
    lens = np.array([len(b) for b in data], np.int64)
    order = np.argsort(-lens, kind="stable")  # the rows that still have bytes come first
    flat, starts = np.frombuffer(b"".join(data), np.uint8), (np.cumsum(lens) - lens)[order]
    h = np.full(len(data), 14695981039346656037, np.uint64)
    sorted_lens = -lens[order]
    for j in range(int(lens.max(initial=0))):
        k = int(np.searchsorted(sorted_lens, -j, side="left"))
        h[:k] = (h[:k] ^ flat[starts[:k] + j]) * np.uint64(1099511628211)
    out = np.empty(len(data), np.uint64)
    out[order] = h
    return pd.Series(out.view(np.int64))


#: Scripts whose letters change with their neighbours: what they become is learnt of pairs and longer clusters.
CLUSTERED = {
    "Greek": ((0x370, 0x3FF),), "Armenian": ((0x531, 0x587),), "Hebrew": ((0x5D0, 0x5EA),), "Arabic": ((0x620, 0x64A),), "kana": ((0x3041, 0x3096), (0x30A1, 0x30FC)),
    "Devanagari": ((0x901, 0x94D),), "Bengali": ((0x981, 0x9CD),), "Tamil": ((0xB82, 0xBCD),), "Thai": ((0xE01, 0xE4D),),
}
#: Letters in a cluster at most: a doubled consonant, its letter, a small one and a long mark; a mark, a consonant and its vowel.
LONGEST = {"kana": 4}
#: Scripts of letters that stand alone: Cyrillic, Georgian, Han with its first extension. Hangul has hyphens between
#: some syllables; Han has a space between any two.
ALONE = ((0x400, 0x52F), (0x10A0, 0x10FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
SCRIPTS = tuple(r for ranges in CLUSTERED.values() for r in ranges) + ALONE
_HAN = ("\u3400", "\u9fff")


def _folded(latin: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", latin) if not "\u0300" <= c <= "\u036f")
    return unicodedata.normalize("NFC", bare).lower().replace("\u0307", "")


class Latin:
    """Letter clusters to folded Latin letters, found in a text from left to right, the longest first.

    The table is learnt from the transliterator that Spark ships, once, on the driver: a letter, and any cluster and
    letter that together become something else than one after the other. What follows a cluster is tried only if it
    forms a pair with the cluster's first or last letter.
    """

    def __init__(self, transliterated: Callable[[list[str]], list[str]]) -> None:
        letters = lambda ranges: [chr(c) for a, b in ranges for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in "LM"]
        fold = lambda xs: dict(zip(xs, map(_folded, transliterated(xs)), strict=True)) if xs else {}
        self.table = fold(letters(ALONE))
        for script, ranges in CLUSTERED.items():
            # a space is the end of a word of Thai, which parts of words don't tell
            parts = (lambda xs: {x: v.replace(" ", "") for x, v in fold(xs).items()}) if script == "Thai" else fold
            own = parts(letters(ranges))
            self.table |= own
            found, after = own, {x: own for x in own}
            for _ in range(LONGEST.get(script, 3) - 1):
                tried = parts([x + y for x in found for y in {*after.get(x[-1], ()), *after.get(x[0], ())}])
                found = {x: v for x, v in tried.items() if v != self.table[x[:-1]] + self.table[x[-1]]}
                if found and len(next(iter(found))) == 2:
                    after = {}
                    for x in found:
                        after.setdefault(x[0], []).append(x[1])
                self.table |= found
        self.longest: dict[str, int] = {}
        for x in self.table:
            self.longest[x[0]] = max(len(x), self.longest.get(x[0], 0))
        # between two syllables of Hangul stands what stands between syllables with such an end and such a beginning
        pairs = {(f, i): chr(0xAC00 + f) + chr(0xAC00 + i * 588) for f in range(28) for i in range(19)}
        both = fold(list(pairs.values()))
        self.hyphen = {k for k, p in pairs.items() if both[p] != self.table[p[0]] + self.table[p[1]]}
        self.runs = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS) + "]+")

    def _run(self, m: re.Match) -> str:
        s, i, out, before = m.group(), 0, [], ""
        while i < len(s):
            for k in range(min(self.longest.get(s[i], 1), len(s) - i), 0, -1):
                if (hit := self.table.get(s[i : i + k])) is not None:
                    break
            else:
                hit, k = s[i], 1
            if before:
                if _HAN[0] <= before <= _HAN[1] and _HAN[0] <= s[i] <= _HAN[1]:
                    out.append(" ")
                elif before >= "\uac00" and s[i] >= "\uac00" and ((ord(before) - 0xAC00) % 28, (ord(s[i]) - 0xAC00) // 588) in self.hyphen:
                    out.append("-")
            out.append(hit)
            i += k
            before = s[i - 1]
        return "".join(out)

    def __call__(self, text: str) -> str:
        return self.runs.sub(self._run, text)


_LATIN: list[Latin] = []


def latin_clusters(spark: SparkSession) -> Latin:
    if not _LATIN:
        to_latin = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin")
        _LATIN.append(Latin(lambda xs: to_latin.transliterate("\n".join(xs)).split("\n")))
    return _LATIN[0]


def with_latin(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the Latin form of a column of names: transliterated, folded, apostrophes and runs of space as one space.

    Python sees the rows with other scripts alone: they are a branch of their own. Scripts that SCRIPTS doesn't list
    stay as they are. A word of Thai isn't parted from the next one where no space stands between them, and phrases of
    Han that are read otherwise than their characters alone aren't known.
    """
    clusters = latin_clusters(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def to_latin(names: pd.Series) -> pd.Series:
        return names.map(clusters)

    tidy = lambda c: F.trim(F.regexp_replace(F.replace(c, F.lit("'"), F.lit(" ")), r"\s+", " "))
    known = F.coalesce(F.col(name), F.lit(""))
    other = ~ascii_only(known) & known.rlike("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS) + "]")
    plain = df.where(~other).withColumn(out, tidy(normalize(F.col(name))))
    return plain.unionByName(df.where(other).withColumn(out, to_latin(_icu("compose", F.col(name)))).withColumn(out, tidy(normalize(F.col(out)))))


def compact(latin: Column) -> Column:
    return F.replace(latin, F.lit(" "), F.lit(""))


def initials(latin: Column) -> Column:
    firsts = F.transform(F.split(latin, " "), lambda t: F.substring(t, 1, 1))
    return F.array_join(F.filter(firsts, lambda c: c.between("a", "z")), "")


def byte_size(raw: Column) -> Column:
    """10mb, 1.5gb, 77: bytes with decimal units; null for anything else, negative numbers too."""
    number, unit = F.regexp_extract(raw, r"^([0-9]*\.?[0-9]+(?:e[0-9]+)?)(tb|gb|mb|kb|b)$", 1), F.regexp_extract(raw, "(tb|gb|mb|kb|b)$", 1)
    # Decimal multiples of a byte.
    factor = F.when(unit == "tb", 1e12).when(unit == "gb", 1e9).when(unit == "mb", 1e6).when(unit == "kb", 1e3).otherwise(1.0)
    whole = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("long"))
    return F.when(unit != "", F.floor(number.try_cast("double") * factor).try_cast("long")).otherwise(whole)
