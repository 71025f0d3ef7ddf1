"""Boundaries of pre-tokens, found with arrays instead of a regular expression.

The byte-level BPE vocabularies split text by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Here a table gives each codepoint a class; class and two following codepoints give it a
symbol; and an automaton of nine states says, from the state before a symbol, whether a
pre-token starts there.  Each symbol is a function from states to states.  Functions
compose associatively and only a few dozen different ones arise, so each has a number and
composing two is one look-up: the state before every codepoint comes from a blocked
parallel scan over these numbers, not from a loop over codepoints.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

_L, _N, _O, _S = 0, 1, 2, 3
#: White space of the pattern: Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that make a contraction after an apostrophe, and pairs of such.
SINGLE, PAIRS = "stmd", ("re", "ve", "ll")

# symbols: letter, number, other, apostrophe before one or two letters of a contraction,
# white space before white space or the text's end, blank or other white space before
# anything else, start of a text
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, BREAK, TEXT = range(9)
# states: nothing open, inside letters, numbers, others, white space, after a blank that
# belongs to what follows, two or one letters of a contraction to come, contraction over
NONE, IN_L, IN_N, IN_O, IN_S, JOIN, TWO, ONE, OVER = range(9)


@cache
def classes() -> np.ndarray:
    """The class of each codepoint."""
    out = np.full(sys.maxunicode + 1, _O, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _L if kind == "L" else _N
    out[WHITE_SPACE] = _S
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at the symbol."""
    if symbol == TEXT:
        return NONE, True
    if symbol == LETTER:
        if state in (TWO, ONE):
            return (ONE if state == TWO else OVER), False
        return IN_L, state not in (IN_L, JOIN)
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, JOIN)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_O, JOIN):
            return IN_O, False
        return {OTHER: IN_O, SHORT: ONE, LONG: TWO}[symbol], True
    if symbol == SPACE:
        return IN_S, state != IN_S
    return (JOIN if symbol == BLANK else NONE), True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function, table of compositions, images, and starts by state and symbol."""
    first = [tuple(_step(s, x)[0] for s in range(9)) for x in range(9)]
    known = {tuple(range(9)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in first:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    images = np.array(list(known), np.uint8)
    table = np.empty((len(known), len(known)), np.uint8)
    for f, a in known.items():
        for g, b in known.items():
            table[a, b] = known[tuple(g[x] for x in f)]
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(9)])
    return np.array([known[f] for f in first], np.uint8), table, images, starts


def scan(ids: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """Exclusive scan: the composition of all functions before each position (0: identity).

    The sequence is laid out in rows of `width`; all rows advance together, column by
    column, each from the identity; the rows' totals are scanned in the same way; and each
    row's carry is then composed in front of its entries.
    """
    n = len(ids)
    flat, size = table.ravel(), table.shape[0]
    if n <= width:
        out = np.zeros(n, np.uint8)
        acc = 0
        for i in range(n):
            out[i] = acc
            acc = table[acc, ids[i]]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = ids
    by_column = np.ascontiguousarray(padded.reshape(rows, width).T)
    inside = np.empty_like(by_column)
    acc = np.zeros(rows, np.uint8)
    for j in range(width):
        inside[j] = acc
        acc = flat[acc.astype(np.uint16) * size + by_column[j]]
    carry = scan(acc, table, width)
    out = flat[carry.astype(np.uint16)[None, :] * size + inside]
    return np.ascontiguousarray(out.T).ravel()[:n]


def symbols(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """The symbol of each codepoint; text_starts: positions of the separators before texts."""
    kind = classes()[points]
    kind[text_starts] = _S
    out = np.array([LETTER, NUMBER, OTHER, SPACE], np.uint8)[kind]
    after = np.empty(len(points), np.uint8)
    after[:-1] = kind[1:]
    after[-1] = _S
    last = (kind == _S) & (after != _S)
    out[last] = np.where(points[last] == 0x20, BLANK, BREAK)
    quotes = np.flatnonzero(points[:-1] == 0x27)
    if len(quotes):
        # separators end a text, so they match no letter here
        one = points[quotes + 1]
        two = points[np.minimum(quotes + 2, len(points) - 1)]
        out[quotes[np.isin(one, [ord(c) for c in SINGLE])]] = SHORT
        pair = np.zeros(len(quotes), bool)
        for a, b in PAIRS:
            pair |= (one == ord(a)) & (two == ord(b)) & (quotes + 2 < len(points))
        out[quotes[pair]] = LONG
    out[text_starts] = TEXT
    return out


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8 behind separators, byte offsets of pre-tokens, and the texts' first.

    Each text follows a separator byte (0), which is a slice of its own.  The third array
    gives, for each text, the index of its separator among the slices.
    """
    joined = "\0" + "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    ids, table, images, starts = monoid()
    syms = symbols(points, text_starts)
    state = images[:, NONE][scan(ids[syms], table)]
    cut = starts.ravel()[state.astype(np.uint16) * 9 + syms]
    # what follows a separator starts anew
    cut[np.minimum(text_starts + 1, len(points) - 1)] = True
    at = np.flatnonzero(cut)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) == len(points):
        offsets = at
    else:
        wide = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(wide, dtype=np.int64)
        offsets = ends[at] - wide[at]
    return data, offsets, np.searchsorted(at, text_starts)
