"""Personal data: patterns, and a linear-chain conditional random field for what they can't say.

The patterns find the base spans. The field labels the words of a whole text (O, or the begin and inside of a kind), by
features of a word's shape, of its check digits and of the words beside it. It is trained on a small labelled table, by
gradients of the log likelihood from forward and backward sums, and decoded by Viterbi in numpy, many texts at a time.
Its spans are added where they meet no base span: cards written side by side, addresses spelt out, numbers without a plus.

Decoding stays exact though most words are skipped. Words of letters far from any other word all have one emission. If
over a window of such words the best path has O in the middle whatever the labels at the window's ends (which is tried
for the trained weights), so has the best path of a whole text, as its part in the window is a best one: paths are
sought only through the words that no such middle is, between Os.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlore.llm._common import arrow_columns, packed, read, text_or_empty, unpacked

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Rows to train on at most, and words that a task remembers at most.
SAMPLE, MEMO_WORDS = 5_000, 100_000
FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the patterns match, by start and then kind; each character is looked at a few times."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, "email", m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# words and their features

#: Words that tell what stands beside them: fixed values, lower case.
CUES = frozenset(
    "at dot punkt point punto arroba email e-mail mail mailto phone tel telephone telefon téléphone teléfono call fax mobile cell ip host server address card karte tarjeta carte "
    "visa order invoice token version item page ref no nr id total price date isbn serial".split()
)
_EDGE = ".,;:!?\"'`´“”„«»‹›*#$%&|=<>[]{}…~^_/\\"
_SIGNS = re.compile(r"[0-9@]|[(\[{<](?:at|dot|punkt)[)\]}>]")
_SPELT = re.compile(r"[(\[{<](?:at|dot|punkt)[)\]}>]", re.IGNORECASE)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_GROUPS = re.compile(r"[0-9]+(?:-[0-9]+)*")
_RUNS = re.compile(r"([0-9]+)|([^\W\d_]+)")
#: A word of letters that is no cue, and one with no other word within REACH of it.
PLAIN, FAR = ("plain",), ("far",)
REACH = 2


def _count(n: int) -> str:
    return str(n) if n <= 4 else "5-6" if n <= 6 else "7-8" if n <= 8 else "9-11" if n <= 11 else "12-19" if n <= 19 else "20+"


def features(word: str) -> tuple[str, ...]:
    """What the field sees of a word. Words of letters that are no cue are all alike."""
    bare = word.strip(_EDGE)
    low = bare.lower().strip("()+-")
    if not _SIGNS.search(word.lower()):
        return (f"w={low}",) if low in CUES else PLAIN
    digits = re.sub("[^0-9]", "", bare)
    letters = sum(c.isalpha() for c in bare)
    out = ["sign", f"d={_count(len(digits))}", f"a={min(letters, 2)}"]
    shape = _RUNS.sub(lambda m: f"9{{{_count(len(m[1]))}}}" if m[1] else "a", bare)
    out.append(f"s={shape}" if len(shape) <= 24 else "s=long")
    if letters and digits and "@" not in bare:
        out.append("mixed")
    if _MAIL.fullmatch(bare.strip("()")):
        out.append("mail")
    if "@" in bare:
        out.append("@" if len(bare) > 1 else "lone@")
    if _SPELT.search(bare):
        out.append("spelt")
    if _QUAD.fullmatch(bare):
        out.append("quad" if all(map(_small, bare.split("."))) else "badquad")
    if _GROUPS.fullmatch(bare) and 12 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "badluhn")
    return tuple(out)


def _grouped(words: list[str]) -> dict[int, str]:
    """Places of words of a few digits each that stand in a row, and whether a card number is made of all of them."""
    out: dict[int, str] = {}
    run: list[int] = []
    for i, w in enumerate([*words, ""]):
        bare = w.strip(_EDGE)
        if 2 <= len(bare) <= 6 and bare.isascii() and bare.isdigit() and (not run or run[-1] == i - 1):
            run.append(i)
            continue
        digits = "".join(words[k].strip(_EDGE) for k in run)
        if len(run) > 1 and 12 <= len(digits) <= 19:
            out.update(dict.fromkeys(run, "run=luhn" if luhn(digits) else "run=bad"))
        run = []
    return out


def _far(plain: np.ndarray) -> np.ndarray:
    """Plain words (of a row of words) that have plain words alone within REACH."""
    out = plain.copy()
    for i in range(1, REACH + 1):
        out[i:] &= plain[:-i]
        out[:-i] &= plain[i:]
    return out


# the field


@dataclass
class Field:
    names: dict[str, int]  #: feature -> its row
    own: np.ndarray  #: weights (feature, label) of a word's own features, and of those of its neighbours
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray  #: (label, label)

    def sums(self, feats: tuple[str, ...]) -> np.ndarray:
        """(3, labels): what a word gives to itself, to the word after it, and to the word before it."""
        at = [self.names[f] for f in feats if f in self.names]
        return np.stack([w[at].sum(axis=0) for w in (self.own, self.before, self.after)])

    def settled(self, most: int = 8) -> int | None:
        """The least h, if any to ``most``, so that of 2 h + 1 far words in a row the middle one is O on every best path."""
        step = self.moves + self.sums(FAR).sum(axis=0)[None, :]
        into, on = step, self.moves  # to the middle's label, and from it to the label after the window
        for h in range(most + 1):
            best = into[:, :, None] + on[None, :, :]
            if (best[:, 0] > best[:, 1:].max(axis=1) + 1e-6).all():
                return h
            into, on = (into[:, :, None] + step[None]).max(axis=1), (step[:, :, None] + on[None]).max(axis=1)
        return None


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(rows: list[tuple[list[tuple[str, ...]], list[int]]], ridge: float = 5e-5, steps: int = 200, rate: float = 0.2) -> Field:
    """Maximum likelihood (with a ridge) over rows of words' features and labels; every row is between two Os."""
    rows = [r for r in rows if r[0]]
    names = {f: i for i, f in enumerate(sorted({f for feats, _ in rows for x in feats for f in x}))}
    n, longest, k = len(rows), max((len(r[1]) for r in rows), default=0), len(LABELS)
    x = np.zeros((n, longest + 2, len(names)), np.float32)
    y, live = np.zeros((n, longest + 2), int), np.zeros((n, longest + 2), bool)
    for i, (feats, labels) in enumerate(rows):
        for j, f in enumerate(feats):
            x[i, j + 1, [names[v] for v in f]] = 1
        y[i, 1 : len(labels) + 1] = labels
        live[i, 1 : len(labels) + 1] = True
    flat = [v.reshape(-1, len(names)) for v in (x[:, 1:-1], x[:, :-2], x[:, 2:])]
    gold = np.eye(k)[y]
    words = max(1, int(live.sum()))
    size = len(names) * k
    param = np.zeros(3 * size + k * k)
    m, v = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, steps + 1):
        w, t = [param[i * size : (i + 1) * size].reshape(-1, k) for i in range(3)], param[3 * size :].reshape(k, k)
        e = sum(f @ g for f, g in zip(flat, w, strict=True)).reshape(n, longest, k)
        alpha, beta = np.zeros((n, longest + 1, k)), np.zeros((n, longest + 1, k))
        alpha[:, 0] = t[0] + e[:, 0]
        for s in range(1, longest):
            alpha[:, s] = np.where(live[:, s + 1, None], _lse(alpha[:, s - 1, :, None] + t, 1) + e[:, s], alpha[:, s - 1])
        total = _lse(alpha[:, longest - 1] + t[:, 0], 1)
        beta[:, longest - 1] = t[:, 0]
        for s in range(longest - 2, -1, -1):
            beta[:, s] = np.where(live[:, s + 2, None], _lse((beta[:, s + 1] + e[:, s + 1])[:, None, :] + t, 2), t[:, 0])
        prob = np.exp(alpha[:, :-1] + beta[:, :-1] - total[:, None, None]) * live[:, 1:-1, None]
        diff = (prob - gold[:, 1:-1] * live[:, 1:-1, None]).reshape(-1, k)
        pair = alpha[:, : longest - 1, :, None] + t + (beta[:, 1:longest] + e[:, 1:])[:, :, None, :] - total[:, None, None, None]
        moves = (np.exp(np.minimum(pair, 0)) * live[:, 2:-1, None, None]).sum(axis=(0, 1))
        moves[0] += prob[:, 0].sum(axis=0)
        ends = np.exp(alpha[:, longest - 1] + t[:, 0] - total[:, None]).sum(axis=0)
        moves[:, 0] += ends
        seen = np.einsum("nsa,nsb->ab", gold[:, 1:-2] * live[:, 2:-1, None], gold[:, 2:-1])
        seen[0] += gold[:, 1].sum(axis=0)
        last = y[np.arange(n), live.sum(axis=1)]
        seen[:, 0] += np.bincount(last, minlength=k)
        g = np.concatenate([*[(f.T @ diff).ravel() for f in flat], (moves - seen).ravel()]) / words + ridge * param
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    own, before, after = (param[i * size : (i + 1) * size].reshape(-1, k).copy() for i in range(3))
    return Field(names, own, before, after, param[3 * size :].reshape(k, k).copy())


def viterbi(emit: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of many sequences between Os; sequence i is emit[ends[i]:ends[i + 1]]. Sequences of like lengths
    go together."""
    out = np.zeros(len(emit), np.int8)
    size = np.diff(ends)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        # so many that the longest is at most a half longer than the shortest, and all fit in a bounded array
        upto = np.searchsorted(size[order], size[order[at]] * 3 // 2 + 1, side="right")
        upto = max(at + 1, min(upto, at + 2_000_000 // int(size[order[upto - 1]] * len(moves)) + 1))
        own = order[at:upto]
        longest = int(size[own[-1]])
        place = np.minimum(ends[own][:, None] + np.arange(longest), len(emit) - 1)
        back = np.zeros((longest, len(own), len(moves)), np.int8)
        score = moves[0] + emit[place[:, 0]]
        for s in range(1, longest):
            ways = score[:, :, None] + moves
            back[s] = best = ways.argmax(axis=1)
            more = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + emit[place[:, s]]
            score = np.where((s < size[own])[:, None], more, score)
        label = (score + moves[:, 0]).argmax(axis=1)
        for s in range(longest - 1, -1, -1):
            inside = s < size[own]
            out[place[inside, s]] = label[inside]
            if s:
                label = np.where(inside, back[s, np.arange(len(own)), label], label)
        at = upto
    return out


class Reader(dict):
    """word -> the row of its features in ``table``; bounded, of one task."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field, self.depth, self.rows, self.table = field, field.settled(), {}, np.zeros((0, 3, len(LABELS)))
        self.row(())  # 0: between texts
        self.row(PLAIN)  # 1
        self.row(FAR)  # 2

    def row(self, feats: tuple[str, ...]) -> int:
        if (found := self.rows.get(feats)) is None:
            found = self.rows[feats] = len(self.rows)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(64, len(self.table)), 3, len(LABELS)))])
            self.table[found] = self.field.sums(feats)
        return found

    def __missing__(self, word: str) -> int:
        row = self.row(features(word))
        if len(word) <= 40:
            self[word] = row
        return row

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best label of every word of every text."""
        if len(self) > MEMO_WORDS or len(self.rows) > MEMO_WORDS:
            self.clear()
            self.rows.clear()
            for feats in ((), PLAIN, FAR):
                self.row(feats)
        sizes = np.array([len(w) for w in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes  # a 0 stands before each text, and one after the last
        seen = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        for at, words in zip(starts.tolist(), texts, strict=True):
            seen[at : at + len(words)] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
            own = seen[at : at + len(words)]
            if (own[1:][own[:-1] > 1] > 1).any():
                for i, flag in _grouped(words).items():
                    seen[at + i] = self.row((*features(words[i]), flag))
        seen[_far(seen <= 1) & (seen == 1)] = 2
        t, sure = self.table, np.zeros(len(seen), bool)
        if self.depth is not None:
            sure = seen == 2
            for _ in range(self.depth + 1):  # once for the neighbours, which the emission depends on
                sure[1:-1] = sure[1:-1] & sure[2:] & sure[:-2]
        place = np.flatnonzero((seen > 0) & ~sure)
        emit = t[seen[place], 0] + t[seen[place - 1], 1] + t[seen[place + 1], 2]
        out = np.zeros(len(seen), np.int8)
        if len(place):
            ends = np.append(np.flatnonzero(np.append(True, np.diff(place) > 1)), len(place))
            out[place] = viterbi(emit, ends, self.field.moves)
        return [out[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def spans_of(text: str, labels: np.ndarray) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the labelled words of a text, without marks at their edges."""
    words = re.finditer(r"\S+", text)
    kind, start, end = "", 0, 0
    for name, m in zip(labels.tolist(), words, strict=True):
        head, of = (LABELS[name] + "-").split("-")[:2]
        if kind and (head != "I" or of != kind):
            yield _trimmed(text, start, kind, end)
            kind = ""
        if head != "O":
            kind, start, end = of, m.start() if not kind else start, m.end()
    if kind:
        yield _trimmed(text, start, kind, end)


def _trimmed(text: str, start: int, kind: str, end: int) -> tuple[int, str, int]:
    marks = _EDGE + {"phone": "", "email": "()"}.get(kind, "()+-")
    while start < end and text[start] in marks:
        start += 1
    while start < end and text[end - 1] in marks + ("(+-" if kind == "phone" else ""):
        end -= 1
    return start, kind, end


def all_spans(texts: list[str], reader: Reader) -> list[list[dict]]:
    out = []
    for text, labels in zip(texts, reader.labels([t.split() for t in texts]), strict=True):
        spans = [(*s, True) for s in base_spans(text)]
        if labels.any():
            more = [s for s in spans_of(text, labels) if s[0] < s[2] and not any(s[0] < b[2] and b[0] < s[2] for b in spans)]
            spans = sorted([*spans, *[(*s, False) for s in more]], key=lambda s: (s[0], KINDS.index(s[1])))
        out.append([{"kind": k, "start": a, "end": b, "base": base} for a, k, b, base in spans])
    return out


# the labelled table

#: Lines with places for values; what stands in braces with a kind is labelled, the rest isn't. Fixed values, of ours.
TEMPLATES = (
    "w w {email:mail} w w", "w w {email:mail}.", "w {email:spelt} w w w", "email : {email:spelt}", "mail {email:words} w w", "w w {email:words} w", "w ( {email:apart} ) w", "w {email:apart} w w",
    "w w {ip:ip} w w", "host {ip:ip}", "w w {ip:ip} {ip:ip} w", "ip address {ip:ip} , w", "w | {ip:ip} | w", "w {ip:ip}!! w",
    "w w {card:card} w w", "w w {card:card}, w", "w {card:card} {card:card} w", "w {card:card} 0bad w", "w 0bad {card:card} w", "w 0bad {card:card} 0bad w", "card {card:groups} w", "w {card:groups} w w", "w {card:dashes} w w", "w | {card:card} | w", "w {card:card}$$$ w",
    "w w {phone:plus} w w", "tel {phone:plus}", "call {phone:local} w w", "phone : {phone:local}", "w tel {phone:local} w", "fax {phone:local} , w", "w {phone:plus}%%% w", "w {phone:plus} {card:card} w", "w {phone:plus} 0bad w",
    "w w w w w w w", "w, w w. w w", "w at w w w", "w w at w . w dot w", "w 0year w 0number w", "w 0bad w w", "w w 0bad, w", "order 0bad w", "w 0bad 0bad w", "invoice no 0bad", "| 0bad | w |", "0bad", "0bad w", "w 0bad",
    "w 0badquad w w", "version 0version w", "w 0version w", "w 0date w w", "w w 0date w 0time w", "w 0price w", "total 0price 0price", "w 0hex w", "token = 0hex w", "w 0badgroups w", "w 0number 0number 0number w", "item 0year-0year", "page 0number", "w 0number% w", "0number. w w",
    "isbn 0number-0number w", "call w w w", "mail w w w", "w phone w w", "email w . w", "w tel w", "w @ w", "w (at) w", "card w w", "ip w w", "w w 0small w w", "0small. w 0small. w", "w 0small-0small w", "w (0small) w", "0small 0small 0small 0small",
)


def labelled(rows: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """The labelled table, made by rule: templates in turn, with values of a seeded generator. (text, spans)."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñüß", k=rng.randrange(1, 12)))
    latin = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))

    def number(good: bool, n: int = 16) -> str:
        while True:
            if luhn(d := digits(n)) == good:
                return d

    fours = lambda d, by: by.join(d[i : i + 4] for i in range(0, len(d), 4))
    domain = lambda: f"{latin()}{rng.choice(['', digits(1)])}.{rng.choice(['', latin() + '.'])}{rng.choice(['com', 'org', 'net', 'de', 'es'])}"
    local = lambda: rng.choice([latin(), f"{latin()}.{latin()}", f"{latin()}.{digits(2)}", f"{latin()}{digits(3)}"])
    opened = lambda w: rng.choice(["({})", "[{}]", "{{{}}}"]).format(w)
    small = lambda: str(rng.randrange(256))
    made: dict[str, Callable[[], str]] = {
        "mail": lambda: f"{local()}@{domain()}", "spelt": lambda: f"{local()}{opened('at')}{domain().replace('.', opened('dot'))}",
        "words": lambda: f"{latin()} {opened('at')} {latin()} {opened('dot')} {rng.choice(['com', 'org', 'net', 'de'])}", "apart": lambda: f"{local()} @ {domain()}",
        "ip": lambda: ".".join(small() for _ in range(4)), "card": lambda: number(True, rng.choice([16, 16, 16, 15, 13])), "groups": lambda: fours(number(True), " "), "dashes": lambda: fours(number(True), "-"),
        "plus": lambda: rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"]),
        "local": lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}"]),
    }
    decoys: dict[str, Callable[[], str]] = {
        "0badgroups": lambda: fours(number(False), " "), "0badquad": lambda: ".".join(rng.sample([str(rng.randrange(256, 999)), small(), small(), small()], 4)), "0bad": lambda: number(False, rng.choice([16, 16, 16, 14, 12, 15, 18])),
        "0version": lambda: f"{small()}.{small()}" + rng.choice(["", f".{small()}"]), "0date": lambda: rng.choice([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}"]),
        "0time": lambda: f"{digits(2)}:{digits(2)}", "0price": lambda: f"{digits(3)}.{digits(2)}", "0hex": lambda: '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"', "0year": lambda: f"20{digits(2)}",
        "0number": lambda: digits(rng.randrange(1, 12)), "0small": lambda: digits(rng.randrange(1, 4)),
    }
    out = []
    for i in range(rows):
        text, spans = "", []
        for part in re.split(r"(\{\w+:\w+\}|0[a-z]+|\bw\b)", TEMPLATES[i % len(TEMPLATES)]):
            value = part
            if part.startswith("{"):
                kind, how = part[1:-1].split(":")
                value = made[how]()
                spans.append((len(text), kind, len(text) + len(value)))
            elif part in decoys:
                value = decoys[part]()
            elif part == "w":
                value = word()
            text += value
        out.append((text, spans))
    return out


def _row(text: str, spans: list[tuple[int, str, int]]) -> tuple[list[tuple[str, ...]], list[int]]:
    words, labels = [], []
    for m in re.finditer(r"\S+", text):
        hit = next(((a, k) for a, k, b in spans if a < m.end() and m.start() < b), None)
        words.append(m.group())
        labels.append(0 if hit is None else LABELS.index(("B-" if m.start() <= hit[0] else "I-") + hit[1]))
    flags, feats = _grouped(words), [features(w) for w in words]
    far = _far(np.array([f == PLAIN for f in feats], bool)).tolist()
    return [FAR if far[i] else (*f, flags[i]) if i in flags else f for i, f in enumerate(feats)], labels


def train(table: DataFrame | None = None) -> Field:
    """A field of a labelled table (text, spans: array of start, kind, end), of which SAMPLE rows at most are used, by
    the hash of the text; by default of the table that ``labelled`` makes. Null texts and spans are empty."""
    if table is None:
        return fit([_row(*r) for r in labelled()])
    drawn = table.select(text_or_empty("text").alias("text"), "spans").orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()
    return fit([_row(r.text, [(s.start, s.kind, s.end) for s in r.spans or []]) for r in drawn])


def find_personal(docs: DataFrame, field: Field, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (those columns, by default all) with ``found``: spans (kind, start, end in code points, base) of each row's
    whole text, by start and then kind.

    Null and empty texts have none; equal texts have equal spans, rows are never merged or left out, and an own column
    named found gives way. An empty table gives no rows. A text is looked at in one task, by a bounded number of texts
    at a time.
    """
    columns = list(docs.columns) if columns is None else columns
    rows = docs.select(packed(docs.select(*[F.col(f"`{c}`") for c in columns])), text_or_empty(F.col(f"`{text}`")).alias("_text"))

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        reader = Reader(field)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        return lambda part: [pa.array(all_spans(part["_text"].to_pylist(), reader), kind)]

    return unpacked(arrow_columns(rows, start, [("found", FOUND)], drop=["_text"]), columns, ["found"])


def _joined(which: Column) -> Column:
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    found = find_personal(read(spark, sf_dir, "documents"), train(), columns=["doc_id"])
    base = F.filter("found", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
