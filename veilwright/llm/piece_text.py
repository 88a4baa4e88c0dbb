"""Texts cut into the pre-tokens of the byte-level tokenizer, with array operations.

The library's own pre-tokenizer cuts a text at changes between letters, numbers,
white space and the rest, gives a single blank to the piece after it, and keeps
English contractions together. ``Pieces`` finds the same cuts for many texts at
once and groups equal pieces. Texts with code points that this Python does not
know, or with the special string, go to the library itself.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from .common import SliceHash, group_equal, mix

OTHER, LETTER, NUMBER, SPACE, UNKNOWN, EDGE = range(6)

# Code points that the tokenizer's pattern takes as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that follow an apostrophe in one piece.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
SPECIAL = "<|endoftext|>"


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category not in ("Cn", "Co", "Cs"):
            table[c] = of.get(category[0], OTHER)
    table[SPACES] = SPACE
    return table


@lru_cache(1)
def _common_symbols() -> np.ndarray:
    return mix(np.arange(1, 0x401))  # no symbol is zero, which would vanish at the end of a piece


def _symbols(points: np.ndarray) -> np.ndarray:
    common = _common_symbols()
    out = np.take(common, points, mode="clip")
    rare = np.flatnonzero(points >= len(common))
    if len(rare):
        out[rare] = mix(points[rare] + np.uint32(1))
    return out


@lru_cache(4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes_to_symbols() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else the next free one from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


SYMBOLS = str.maketrans({chr(b): s for b, s in _bytes_to_symbols().items()})


def piece_ids(path: str, piece: str) -> list[int]:
    """The ids of one pre-token."""
    symbols = piece.encode("utf-8").decode("latin-1").translate(SYMBOLS)
    return [t.id for t in load_tokenizer(path).model.tokenize(symbols)]


def whole_ids(path: str, text: str) -> list[int]:
    """The library's ids of a whole text."""
    return load_tokenizer(path).encode(text, add_special_tokens=False).ids


class Pieces:
    """The pre-tokens of several texts.

    ``hard``: indices of texts left to the library. ``distinct``: each different
    piece once. ``of``: the index in ``distinct`` of every piece, text after text.
    ``doc``: the text that each piece is in.
    """

    def __init__(self, texts: list[str]):
        self.hard = [i for i, t in enumerate(texts) if SPECIAL in t]
        skip = set(self.hard)
        joined = "".join(("\n" if i in skip else t + "\n") for i, t in enumerate(texts))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([0 if i in skip else len(t) for i, t in enumerate(texts)], np.int64)
        edges = np.cumsum(lengths + 1) - 1
        kind = classes()[points]
        kind[edges] = EDGE
        odd = np.flatnonzero(kind == UNKNOWN)
        if len(odd):
            self.hard = sorted(skip.union(np.searchsorted(edges, odd).tolist()))

        n = len(points)
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        # The last blank before other text goes with it; another white space character stands alone.
        after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE)) + 1
        start[after - 1] = True
        blank = after[points[after - 1] == 32]
        start[blank] = False
        self._contractions(points, kind, start)

        cuts = np.flatnonzero(start)
        real = kind[cuts[:-1]] != EDGE
        first, last = cuts[:-1][real], cuts[1:][real]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, edges), prepend=0))
        if self.hard:
            keep = ~np.isin(self.doc, np.array(self.hard))
            first, last, self.doc = first[keep], last[keep], self.doc[keep]
        hashes = SliceHash(_symbols(points)).slices(first, last)
        representative, self.of = group_equal(hashes)
        self.distinct = [joined[a:b] for a, b in zip(first[representative].tolist(), last[representative].tolist())]

    @staticmethod
    def _contractions(points, kind, start) -> None:
        n = len(points)
        quote = np.flatnonzero(points == ord("'"))
        if not len(quote):
            return
        before = np.where(quote > 0, kind[quote - 1], EDGE)
        blank_before = (quote > 0) & (points[quote - 1] == 32)
        quote = quote[(before != OTHER) & ~blank_before & (quote + 1 < n)]
        quote = quote[kind[quote + 1] == LETTER]
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in ONE_LETTER])
        long = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            long |= (one == ord(a)) & (two == ord(b))
        for chosen, size in ((quote[short], 1), (quote[long], 2)):
            start[chosen + 1] = False
            rest = chosen + 1 + size
            start[rest[kind[np.minimum(rest, n - 1)] == LETTER]] = True
