"""Vectorised pre-tokenisation by the usual byte-level BPE pattern, for texts given as code points."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text starts (with the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def pretoken_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; no pre-token crosses from one text into the next.

    Runs of letters, of numbers and of other signs take one blank before them. White space before them is a
    pre-token but for its last sign, which is one as well if it isn't such a blank. An apostrophe that begins a
    pre-token takes s, t, m, d, re, ve or ll with it.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    space = kind == _SPACE
    first = np.zeros(n, bool)
    first[text_starts[:-1][text_starts[:-1] < n]] = True
    at = first.copy()
    at[1:] |= kind[1:] != kind[:-1]
    inner = ~first[1:]
    word = ~space[1:] & space[:-1] & inner  # white space, then something else
    at[1:] &= ~(word & (cp[:-1] == 32))
    at[:-1] |= word
    quote = np.flatnonzero(at & (cp == 39))
    if len(quote):
        padded = np.append(cp, np.zeros(3, np.uint32))
        ends = np.searchsorted(text_starts, quote, "right")
        room = text_starts[ends] - quote
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (room > 1)
        long = ~short & (room > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            at[q + 1] = False
            after = (q + size)[(q + size) < n]
            at[after] |= kind[after] == _LETTER  # else the run's end is a boundary already, or a blank's rule holds
    return np.flatnonzero(at)


def is_word(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pre-tokens are a blank and letters."""
    return (cp[starts] == 32) & (ends - starts > 1) & (_classes()[cp[np.minimum(starts + 1, ends - 1)]] == _LETTER)
