"""Pre-tokenisation without regular expressions, for the usual byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point becomes a symbol: its class, refined by what follows it (a contraction after an apostrophe; something
other than white space after white space) and by whether it opens a text. A symbol is a function from state to state;
composition of such functions is associative, and the functions that symbols generate are few, so a scan over their
numbers by a composition table gives every state: within blocks for all blocks at once, then over the blocks.
"""

from __future__ import annotations

import functools

import numpy as np

# symbols
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_SPACE, LAST_WHITE = range(8)
OPENS = 8  # added to a text's first symbol
# states: what has just been read
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE, ENDED = range(9)
BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token starts at this code point)."""
    if symbol >= OPENS:
        return _step(START, symbol - OPENS)[0], True
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (ENDED if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if symbol == OTHER or state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == SPACES:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == LAST_SPACE else ENDED), True


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of each symbol's function, composition table, values, starts by state and symbol, the identity)."""
    states = range(9)
    base = [tuple(_step(s, y)[0] for s in states) for y in range(16)]
    known = {tuple(states): 0}
    todo = [tuple(states)]
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    each = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in each] for f in each], np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(16)] for s in states])
    return np.array([known[b] for b in base], np.uint8), table, np.array(each, np.uint8), starts, known[tuple(states)]


def _scan(f: np.ndarray, table: np.ndarray, identity: int) -> np.ndarray:
    """Inclusive scan: what the functions up to each place compose to."""
    n = len(f)
    if n <= BLOCK:
        out = f.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, identity, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, size = table.ravel(), table.shape[1]
    for i in range(1, BLOCK):
        grid[i] = flat[grid[i - 1].astype(np.intp) * size + grid[i]]
    before = np.concatenate([[identity], _scan(grid[-1], table, identity)[:-1]]).astype(np.intp) * size
    return flat[before + grid].T.ravel()[:n]


@functools.cache
def classes(library: str = "tiktoken") -> np.ndarray:
    """Class of every code point (LETTER, NUMBER, OTHER or SPACES), as the regular expressions of "tiktoken" or "tokenizers"
    take it: their Unicode version is theirs, not Python's. The library is asked once for all code points."""
    points = np.arange(0x110000, dtype="<u4")
    text = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, inside, outside in ((LETTER, r"\p{L}", r"\P{L}+"), (NUMBER, r"\p{N}", r"\P{N}+"), (SPACES, r"\s", r"\S+")):
        if library == "tiktoken":
            import tiktoken

            found = bytes(tiktoken.Encoding(library, pat_str=inside, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(text)).decode()
        else:
            from tokenizers import Regex, normalizers

            found = normalizers.Replace(Regex(outside), "").normalize_str(text)
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def boundaries(data: bytes, offsets: np.ndarray, library: str = "tiktoken") -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pre-tokens start, and for each text the index of its first (one entry more at the end)."""
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if n == len(data):
        at = np.arange(n + 1)
    else:
        at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int8) + (points >= 0x10000), out=at[1:])
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    kind = classes(library)[points]
    white = kind == SPACES
    symbols = kind.copy()
    # white space before something else
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:] & ~first[1:n]
    last = white & follows
    symbols[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
    # apostrophes before a contraction's letters
    marks = np.flatnonzero(points[:-1] == 0x27)
    marks = marks[~first[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~first[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        symbols[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        symbols[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = LONG
    symbols[first[:n]] += OPENS
    number, table, values, starts, identity = _monoid()
    states = values[:, START][_scan(number[symbols], table, identity)]
    before = np.concatenate([[START], states[:-1]])
    begin = at[:-1][starts[before, symbols]]
    return begin, np.searchsorted(begin, offsets)


def slices(data: bytes, begin: np.ndarray) -> list[bytes]:
    b = begin.tolist()
    return [data[i:j] for i, j in zip(b, [*b[1:], len(data)])]
