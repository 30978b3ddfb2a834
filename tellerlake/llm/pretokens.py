"""Boundaries of pre-tokens by composed transition functions, without regular expressions.

The splitting rule is that of the usual byte-level pattern: contractions after an apostrophe,
then runs of letters, numbers or other signs with one blank before them, then white space, of
which a run leaves its last character to what follows.

Every character becomes a symbol that knows one character of what follows; an automaton of
eight states says whether a token starts there. A symbol is a function from state to state, and
composing functions is associative, so that states before all characters come from a scan. The
functions that compositions can give are few; they are numbered, and a table multiplies them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

import numpy as np

# Classes of code points
LETTER, NUMBER, OTHER, SPACE, MARK, BLANK, END = range(7)  # MARK: the apostrophe; BLANK: U+0020; END: behind a text
ENDED = 0x110000  # stands behind each text

# Characters with the property White_Space
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
               0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters that end a contraction, and those that open one of two letters
ENDINGS = "stmd"
PAIRS = {"r": "e", "v": "e", "l": "l"}

# Symbols: a letter, a letter that may end a contraction, one that may open its ending; a number, another sign, the
# apostrophe; white space with more of it (or nothing) behind, a last white space other than blank, a last blank; the
# end of a text
(S_LETTER, S_END, S_OPEN, S_NUMBER, S_OTHER, S_MARK, S_SPACE, S_LAST, S_BLANK, S_STOP) = range(10)

# States: nothing open; inside letters, numbers, other signs, white space; after a blank that joins what follows;
# after an apostrophe that opened a token; within a contraction of two letters
(NEW, LETTERS, NUMBERS, OTHERS, SPACES, JOIN, QUOTE, HALF) = range(8)

#: symbol -> (state it leads to, states in which it goes on with the open token)
RULES = {
    S_LETTER: (LETTERS, {LETTERS, JOIN}), S_END: (LETTERS, {LETTERS, JOIN}), S_OPEN: (LETTERS, {LETTERS, JOIN}),
    S_NUMBER: (NUMBERS, {NUMBERS, JOIN}), S_OTHER: (OTHERS, {OTHERS, JOIN, QUOTE}), S_MARK: (QUOTE, {OTHERS, JOIN, QUOTE}),
    S_SPACE: (SPACES, {SPACES}), S_LAST: (NEW, set()), S_BLANK: (JOIN, set()), S_STOP: (NEW, set()),
}

STEP = 64  # characters that one row of the scan composes in order


@functools.cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points, as run lengths and values: small enough to travel with tasks."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = SPACE
    table[0x20], table[0x27] = BLANK, MARK
    edges = np.flatnonzero(np.diff(table)) + 1
    starts = np.concatenate([[0], edges])
    return np.diff(np.concatenate([starts, [len(table)]])), table[starts]


def _delta(symbol: int, state: int) -> tuple[int, bool]:
    """(next state, whether a token starts) for one symbol."""
    to, goes_on = RULES[symbol]
    if symbol <= S_OPEN and state == HALF:
        return NEW, False
    if symbol == S_END and state == QUOTE:
        return NEW, False
    if symbol == S_OPEN and state == QUOTE:
        return HALF, False
    if symbol == S_MARK and state in goes_on:
        return OTHERS, False
    return to, state not in goes_on


class Splitter:
    """Tables of one automaton; made on the driver, used in tasks."""

    def __init__(self) -> None:
        self.lengths, self.values = class_runs()
        moves = [[_delta(s, q) for q in range(8)] for s in range(len(RULES))]
        generators = [tuple(q for q, _ in row) for row in moves]
        numbers = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *generators]))}
        waiting = list(numbers)
        while waiting:  # closure under composition: a few dozen functions
            f = waiting.pop()
            for g in generators:
                new = tuple(g[q] for q in f)
                if new not in numbers:
                    numbers[new] = len(numbers)
                    waiting.append(new)
        functions = list(numbers)
        self.identity = numbers[tuple(range(8))]
        self.of_symbol = np.array([numbers[g] for g in generators], np.uint16)
        self.product = np.array([[numbers[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint16)
        self.image = np.array(functions, np.uint8)
        self.starts = np.array([[new for _, new in row] for row in moves])

    def classes(self) -> np.ndarray:
        return np.append(np.repeat(self.values, self.lengths), np.uint8(END))

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive products of functions from the left: rows of ``STEP`` in order, then row totals by recursion."""
        if len(f) <= STEP:
            out = np.empty_like(f)
            last = self.identity
            for i, x in enumerate(f):
                out[i] = last = self.product[last, x]
            return out
        rows = -(-len(f) // STEP)
        grid = np.full(rows * STEP, self.identity, np.uint16)
        grid[: len(f)] = f
        grid = np.ascontiguousarray(grid.reshape(rows, STEP).T)
        for k in range(1, STEP):
            grid[k] = self.product[grid[k - 1], grid[k]]
        before = np.empty(rows, np.uint16)
        before[0] = self.identity
        before[1:] = self.scan(grid[-1])[:-1]
        return self.product[before[None, :], grid].T.reshape(-1)[: len(f)]

    def symbols(self, points: np.ndarray, classes: np.ndarray, behind: int) -> np.ndarray:
        """Symbol of each code point; ``behind`` is the one after the last."""
        kind = classes[points]
        last = np.empty(len(points), bool)  # what follows is neither white space nor the end of the text
        last[:-1] = _SHOWN[kind[1:]]
        last[-1] = _SHOWN[classes[behind]]
        out = _SYMBOL[kind + np.uint8(7) * last]
        for c in ENDINGS:
            out[points == ord(c)] = S_END
        for a, b in PAIRS.items():
            at = np.flatnonzero(points == ord(a))
            after = np.where(at + 1 < len(points), points[np.minimum(at + 1, len(points) - 1)], behind)
            out[at[after == ord(b)]] = S_OPEN
        return out

    def boundaries(self, points: np.ndarray, classes: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
        """Places in ``points`` where tokens start, ``ENDED`` included, chunk by chunk; the state is carried over."""
        state, found = NEW, []
        for at in range(0, len(points), chunk):
            part = points[at: at + chunk]
            behind = int(points[at + chunk]) if at + chunk < len(points) else ENDED
            symbols = self.symbols(part, classes, behind)
            states = self.image[self.scan(self.of_symbol[symbols]), state]
            before = np.empty_like(states)
            before[0], before[1:] = state, states[:-1]
            state = int(states[-1])
            found.append(np.flatnonzero(self.starts[symbols, before]) + at)
        return np.concatenate(found) if found else np.empty(0, np.int64)


_SHOWN = np.array([True, True, True, False, True, False, False])
# by class, then by class with something other than white space behind
_SYMBOL = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_MARK, S_SPACE, S_STOP,
                    S_LETTER, S_NUMBER, S_OTHER, S_LAST, S_MARK, S_BLANK, S_STOP], np.uint8)


def split(texts: Sequence[str], splitter: Splitter, classes: np.ndarray) -> tuple[bytes, list[int], np.ndarray]:
    """All texts in one scan: (their bytes, one more byte behind each; where tokens and those bytes start; the
    number of starts up to and with each text's last token)."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    points[ends] = ENDED
    found = splitter.boundaries(points, classes)
    upto = np.searchsorted(found, ends)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) > len(points):
        width = np.ones(len(points), np.int64)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += points > limit
        width[ends] = 1
        found = (np.cumsum(width) - width)[found]
    return data, found.tolist(), upto
