"""Relevance of a catalog row for a query text; null is no match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlore.functions.text import ascii_only, graphemes, n_graphemes


def strict(text: Column, name: Column) -> Column:
    """Equal 10000, prefix 9000 less the extra length, substring 7000 less eight times the offset; each loses 700 at most."""
    extra = n_graphemes(name) - n_graphemes(text)
    offset = n_graphemes(F.substring(name, F.lit(1), F.instr(name, text) - 1))
    return F.when(name == text, 10000).when(name.startswith(text), 9000 - F.least(extra, F.lit(700))).when(name.contains(text), 7000 - F.least(8 * offset, F.lit(700)))


def alias(text: Column, compact: Column, initials: Column) -> Column:
    c, i = compact != "", initials != ""
    return (
        F.when(c & (compact == text), 6800).when(c & compact.startswith(text), 6500).when(c & (n_graphemes(text) >= 3) & compact.contains(text), 6100)
        .when(i & (initials == text), 6200).when(i & initials.startswith(text), 6000)
    )


def tokens(text: Column, words: Column) -> Column:
    """7200 and for each token its best word, 500 less four for each character that the word has more; a word must have
    the token as a subsequence, and every token a word."""

    def worth(token: Column, word: Column) -> Column:
        q, w = graphemes(token), graphemes(word)
        used = F.aggregate(w, F.lit(0), lambda i, ch: F.when((i < F.size(q)) & (ch == F.get(q, i)), i + 1).otherwise(i))
        return F.when(used == F.size(q), F.greatest(F.lit(1), 500 - 4 * (F.size(w) - F.size(q))))

    def worth_plain(token: Column, word: Column) -> Column:
        # the place after each character's, from 1 on; 0 once there is none
        step = lambda start, ch: F.position(ch, word, start) + F.least(F.position(ch, word, start), F.lit(1))
        found = F.aggregate(F.split(token, ""), F.lit(1), step) > 0
        return F.when(found, F.greatest(F.lit(1), 500 - 4 * (F.length(word) - F.length(token))))

    def total(worth: Callable[[Column, Column], Column]) -> Column:
        best = F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: F.array_max(F.transform(words, lambda w: worth(t, w))))
        return 7200 + F.aggregate(best, F.lit(0), lambda a, b: a + b)

    # each character a grapheme: by the strings themselves. Words have no line ends
    plain = ascii_only(text) & ~text.contains("\r\n") & ascii_only(F.array_join(words, " "))
    return F.when(plain, total(worth_plain)).otherwise(total(worth))


def name_score(text: Column, row_words: Column) -> Column:
    """What the search ranks by; 8000 for a query of filters alone."""
    single = F.coalesce(strict(text, F.col("normalized_name")), alias(text, F.col("pinyin_compact"), F.col("pinyin_initials")))
    return F.when(text == "", 8000).when(text.contains(" "), tokens(text, row_words)).otherwise(single)


def fuzzy(query: Column, candidate: Column) -> Column:
    """Equal, prefix and substring with a bonus at a word's start, else a greedy subsequence: 100 for each character,
    80 more next to the last one, 60 more at a word's start; less for a late first hit and for length."""
    at = F.instr(candidate, query)
    before = F.substring(candidate, F.lit(1), at - 1)
    starts = lambda prev: ~prev.rlike(r"[\p{IsAlphabetic}\p{N}]")
    extra = n_graphemes(candidate) - n_graphemes(query)
    inside = 7500 + F.when((before == "") | starts(F.substring(before, -1, 1)), 500).otherwise(0) - F.least(n_graphemes(before), F.lit(1000))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  made once, and not anew wherever f has it

    def greedy(place: Callable[[Column, Column], Column], prev: Callable[[Column], Column], tokens: Column) -> Column:
        """By steps from each character of the query to its first place after the last one's; s is null after one without."""
        state = F.struct(F.lit(0).alias("s"), F.lit(-1).alias("last"), F.lit(-1).alias("first"))

        def step(a: Column, ch: Column) -> Column:
            def to(p: Column) -> Column:
                gain = 100 + F.when((p == a["last"] + 1) & (a["first"] >= 0), 80).otherwise(0) + F.when(F.when(p == 0, True).otherwise(starts(prev(p))), 60).otherwise(0)
                return F.struct(F.when(p >= 0, a["s"] + gain).alias("s"), p.alias("last"), F.when(a["first"] < 0, p).otherwise(a["first"]).alias("first"))

            return F.when(a["s"].isNull(), a).otherwise(bound(place(ch, a["last"] + 1), to))

        return F.aggregate(tokens, state, step, lambda a: F.greatest(a["s"] - F.least(8 * a["first"], F.lit(500)) - F.least(extra, F.lit(500)), F.lit(1) + 0 * a["s"]))

    # each character a grapheme: places by the string itself; else by its graphemes, which are cut once
    plain = ascii_only(query) & ascii_only(candidate) & ~query.contains("\r\n") & ~candidate.contains("\r\n")
    by_character = greedy(lambda ch, start: F.position(ch, candidate, start + 1) - 1, lambda p: F.substring(candidate, p, F.lit(1)), F.split(query, ""))

    def by_grapheme(c: Column) -> Column:
        place = lambda ch, start: bound(F.array_position(F.slice(c, start + 1, F.greatest(F.size(c) - start, F.lit(0))), ch).cast("int"), lambda k: F.when(k > 0, start + k - 1).otherwise(-1))
        return greedy(place, lambda p: F.get(c, p - 1), graphemes(query))

    return (
        F.when(query == "", 1).when(candidate == query, 10000).when(candidate.startswith(query), 9000 - F.least(extra, F.lit(1000)))
        .when(candidate.contains(query), inside).when(plain, by_character).otherwise(bound(graphemes(candidate), by_grapheme))
    )
