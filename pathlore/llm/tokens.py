"""Whole texts to token ids with the tokenizers library, remembering the ids of words already seen."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: Parts of words kept at most; beyond it the memory starts anew.
MEMO_PARTS = 600_000

#: The words that no token of these vocabularies crosses: a byte-level vocabulary joins one space to the word after it.
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space, the tokenizers' patterns don't: such texts are encoded as a whole.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Texts of these characters alone (and no special token) are split here; other words by the library's own splitter.
_PLAIN = re.compile("[\n\t -~À-ÖØ-öø-ÿ]*+")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# The published split patterns of the two vocabularies, for the characters of _PLAIN.
_DROPS_SPACE_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
_BYTE_LEVEL_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = {b: 256 + _OTHERS.index(b) for b in _OTHERS}


class _Codes(dict):
    """word -> number, in order of first sight; new ones wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self) + 1
        self.new.append(word)
        return code


class Encoder:
    """Ids of texts, each followed by ``end``; equal to encoding each text as a whole, for vocabularies whose tokens
    don't cross white space (``drops_space``: it is no part of any token either).
    """

    def __init__(self, path: str, end: int, drops_space: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.drops_space = drops_space
        self._clear()

    def _parts(self, text: str) -> list[str]:
        """What the ids of a text are looked up by; a leading NUL marks what the library is to split itself."""
        find = _DROPS_SPACE_PARTS.findall if self.drops_space else _BYTE_LEVEL_PARTS.findall
        if "<|" not in text and _PLAIN.fullmatch(text):
            return find(text.lower() if self.drops_space else text)
        if _SEPARATORS.search(text):
            return ["\0" + text]
        out: list[str] = []
        for word in text.split() if self.drops_space else _BYTE_LEVEL.findall(text):
            if "<|" not in word and _PLAIN.fullmatch(word):
                out += find(word.lower() if self.drops_space else word)
            else:
                out.append("\0" + word)
        return out

    def _ids(self, part: str) -> list[int]:
        if part[0] == "\0":
            return self.tokenizer.encode(part[1:], add_special_tokens=False).ids
        if part.isascii() and part.isprintable():
            part = part.replace(" ", "\u0120")
        else:
            part = part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.tokenizer.model.tokenize(part)]

    def _clear(self) -> None:
        # code 0 is the end id
        self.codes, self.flat, self.n_flat = _Codes(), np.full(1 << 16, self.end, np.uint32), 1
        self.starts, self.lens, self.n = np.zeros(1 << 15, np.int64), np.ones(1 << 15, np.int64), 1

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        for i in range(0, len(new), 20_000):
            ids = [self._ids(part) for part in new[i : i + 20_000]]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(lens.sum())
            while self.n + len(ids) > len(self.lens):
                self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
            while self.n_flat + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.n_flat : self.n_flat + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.lens[self.n : self.n + len(ids)] = lens
            self.starts[self.n : self.n + len(ids)] = self.n_flat + np.cumsum(lens) - lens
            self.n, self.n_flat = self.n + len(ids), self.n_flat + total

    def __call__(self, texts: Iterable[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and how many each text has; null counts as empty."""
        if len(self.codes) > MEMO_PARTS:
            self._clear()
        get, parts, sizes = self.codes.__getitem__, [], []
        tail = np.zeros(int(end), np.int64)
        for text in texts:
            words = self._parts(text or "")
            parts += [np.fromiter(map(get, words), np.int64, len(words)), tail]
            sizes.append(len(words) + len(tail))
        self._learn()
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[codes] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, np.diff(bounds)


_KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, end: int, drops_space: bool) -> Encoder:
    """This Python worker's encoder, made once."""
    if (key := (path, end, drops_space)) not in _KEPT:
        _KEPT[key] = Encoder(path, end, drops_space)
    return _KEPT[key]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
