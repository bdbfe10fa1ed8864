"""Locally consistent naming of text by rounds of run and pair compression.

Every symbol is a 64-bit fingerprint of the string it stands for, so the same run or pair
gets the same name wherever in the cluster it occurs and no dictionary is exchanged. In a
round, symbols no longer than the round's limit take part: equal neighbours become one run
symbol, then every neighbouring pair of a left-hand and a right-hand symbol (sides are
drawn from the fingerprint and the round) becomes one symbol. What happens to a place
depends on its neighbours alone, so equal substrings are parsed alike but for an edge of
at most ``EDGE`` characters on each side.
"""

from __future__ import annotations

import numpy as np

#: Longest symbols that take part in each round.
LIMITS = (1, 2, 3, 4, 5, 7, 9)
#: Longest symbol after the last round, and most characters that one edge can lose.
LONGEST = 2 * LIMITS[-1]
EDGE = sum(LIMITS) + LONGEST

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_S33 = _U(33)
#: Symbols of separators between texts carry the top length, so nothing merges over them.
_WALL = np.int32(1 << 20)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _runs(h: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours within the limit become one symbol, as far as it stays within twice the limit."""
    same = (h[1:] == h[:-1]) & (n[1:] <= limit)
    if not same.any():
        return h, n
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    count = np.diff(np.append(first, len(h)))
    fits = count * n[first] <= 2 * limit
    many = (count > 1) & fits
    # Longer runs stay apart: their symbols are equal, and pairing leaves equal neighbours alone.
    keep = np.ones(len(h), dtype=bool)
    inner = np.repeat(many, count)
    keep[inner] = False
    keep[first] = True
    h, n = h.copy(), n.copy()
    at = first[many]
    h[at] = mix(h[at] * _U(0x9E3779B97F4A7C15) + count[many].astype(_U))
    n[at] = n[at] * count[many].astype(np.int32)
    return h[keep], n[keep]


def _pairs(h: np.ndarray, n: np.ndarray, limit: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Each left-hand symbol before a right-hand one becomes one symbol with it."""
    side = (h >> _U(7 * turn + 3)) & _U(1)
    may = n <= limit
    left = may & (side == 0)
    join = left[:-1] & (may & (side == 1))[1:]
    at = np.flatnonzero(join)
    h, n = h.copy(), n.copy()
    h[at] = mix(h[at] * _U(0x9E3779B97F4A7C15) ^ (h[at + 1] + _U(turn + 1)))
    n[at] += n[at + 1]
    keep = np.ones(len(h), dtype=bool)
    keep[at + 1] = False
    return h[keep], n[keep]


def parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols of all texts: fingerprint, start in its text, and text number."""
    wall = "\U0010ffff"
    joined = wall.join(texts) + wall
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    n = np.ones(len(code), dtype=np.int32)
    ends = np.cumsum(lengths + 1) - 1
    n[ends] = _WALL
    h = mix(code.astype(_U) + _U(0x5851F42D4C957F2D))
    for turn, limit in enumerate(LIMITS):
        h, n = _runs(h, n, limit)
        h, n = _pairs(h, n, limit, turn)
    wide = n == _WALL
    true = np.where(wide, 1, n).astype(np.int64)
    start = np.cumsum(true) - true
    owner = np.cumsum(wide) - wide
    inside = ~wide
    base = np.concatenate(([0], ends + 1))[:-1]
    owner = owner[inside]
    return h[inside], start[inside] - base[owner], owner


def anchors(
    texts: list[str], window: int, spread: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of runs of final symbols: fingerprint, start, length, text number.

    A run starts at every symbol and takes the fewest symbols that span ``window``
    characters. Of the runs that start within any stretch of ``spread`` characters the one
    of least fingerprint is kept, so that any such stretch keeps one.
    """
    h, start, owner = parse(texts)
    if not len(h):
        e = np.zeros(0, dtype=np.int64)
        return h, e, e, e
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(size) - size
    place = base[owner] + start
    stop = np.append(place[1:], size.sum())
    # prefix fingerprints: the name of symbols i..j-1 is a polynomial in a fixed odd base
    k = np.arange(len(h), dtype=_U)
    power = np.full(len(h) + 1, _U(0x9E3779B97F4A7C15) | _U(1))
    power[0] = 1
    power = np.cumprod(power)
    inverse = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    back = np.full(len(h) + 1, inverse)
    back[0] = 1
    back = np.cumprod(back)
    del k
    prefix = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[:-1])))
    j = np.searchsorted(stop, place + window, side="left") + 1
    end_text = base[owner] + size[owner]
    whole = place + window <= end_text
    i = np.flatnonzero(whole)
    if not len(i):
        e = np.zeros(0, dtype=np.int64)
        return h[:0], e, e, e
    j = np.minimum(j[i], len(h))
    length = stop[j - 1] - place[i]
    name = mix((prefix[j] - prefix[i]) * back[i] + length.astype(_U))
    own, pos = owner[i], place[i]
    # least fingerprint within [pos - spread/2, pos + spread/2): leftmost-free, purely local
    kept = _local_minima(name, pos, own, spread)
    return name[kept], start[i][kept], length[kept], own[kept]


def _local_minima(name: np.ndarray, pos: np.ndarray, own: np.ndarray, spread: int) -> np.ndarray:
    """Places of which some stretch of ``spread`` characters holds no lesser fingerprint."""
    # Winnowing: for every stretch that starts at a run, its least member (ties: all of them).
    n = len(name)
    last = np.searchsorted(pos, pos + spread, side="left")
    bound = np.searchsorted(own, own, side="right")
    last = np.minimum(last, bound)
    width = int((last - np.arange(n)).max())
    table = [name]
    step = 1
    while 2 * step <= width:
        prev = table[-1]
        table.append(np.minimum(prev, np.append(prev[step:], np.full(min(step, n), ~_U(0)))[:n]))
        step *= 2
    span = last - np.arange(n)
    level = np.floor(np.log2(np.maximum(span, 1))).astype(np.int64)
    least = np.empty(n, dtype=_U)
    for lv in np.unique(level):
        at = np.flatnonzero(level == lv)
        t = table[lv]
        least[at] = np.minimum(t[at], t[np.maximum(last[at] - (1 << lv), 0)])
    order = np.zeros(n, dtype=bool)
    # A run is kept if it equals the least of a stretch that starts at or before it and reaches it.
    first = np.searchsorted(pos, pos - spread, side="right")
    first = np.maximum(first, np.searchsorted(own, own, side="left"))
    reach = np.arange(n) - first
    for back in range(int(reach.max()) + 1):
        at = np.flatnonzero((reach >= back) & ~order)
        if not len(at):
            break
        order[at] |= least[at - back] == name[at]
    return np.flatnonzero(order)
