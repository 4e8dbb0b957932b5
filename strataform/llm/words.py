"""Vectorised word splitting and hashing over UTF-8 buffers (numpy, no per-word Python).

A word's hash sums a random number for every byte at its place in the word and is then mixed; from the second
piece of 64 bytes on, sums are mixed with the piece's number first. So no two patterns of letters cancel, as they
do in polynomials modulo a power of two. Sequences of words combine their words' hashes. Everything is a pure
function of the bytes, so all executors agree.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at once.
BLOCK = 1 << 19


def _splitmix(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: By how much each place of a window is multiplied.
PLACE = _splitmix(23, 64) | U(1)
#: Bytes of a piece of a word, and a random number for every byte at every place of a piece.
PIECE = 64
AT_PLACE = _splitmix(11, PIECE * 256)


def byte_set(chars: bytes | list[int]) -> np.ndarray:
    """A table of 256 booleans."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = byte_set([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
HEAD = byte_set([b for b in range(256) if b & 0xC0 != 0x80])  # first bytes of code points


def spans(word: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in ``word``, cut at the offsets; and each text's first run."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ofs), np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = ofs[(ofs > 0) & (ofs < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, ofs)


def _pieces(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of the numbers of all bytes of each ``buf[s:e]`` at their places (at most ``PIECE`` of them)."""
    out = np.empty(len(s), U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK)))
        a, b = int(s[i]), int(e[j - 1])
        begin = s[i:j] - a
        place = np.arange(b - a) - np.repeat(begin, np.diff(begin, append=b - a))
        place &= PIECE - 1  # beyond a piece's end, where nothing is read, it would grow
        place <<= 8
        place |= buf[a:b]
        total = np.zeros(b - a + 1, U)
        np.cumsum(AT_PLACE[place], out=total[1:])
        out[i:j] = total[e[i:j] - a] - total[begin]
        i = j
    return out


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each ``buf[s:e]``; the spans ascend, don't overlap and hold a byte at least."""
    size = e - s
    if len(s) and size.max() > PIECE:
        count = (size + PIECE - 1) // PIECE
        first = np.cumsum(count) - count
        k = np.arange(count.sum()) - np.repeat(first, count)
        at = np.repeat(s, count) + PIECE * k
        h = _pieces(buf, at, np.minimum(at + PIECE, np.repeat(e, count)))
        later = k > 0
        h[later] = mix(h[later] + k[later].astype(U) * PLACE[62])
        out = np.add.reduceat(h, first)
    else:
        out = _pieces(buf, s, e)
    return mix(out + size.astype(U) * PLACE[63])


def same_bytes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each ``buf[s:e]`` equals the ``size`` bytes of ``other`` from ``begin``."""
    out = e - s == size
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK)))  # spans that lie close together, as in a text
        n = np.where(out[i:j], size[i:j], 0)
        upto = np.cumsum(n)
        step = np.arange(upto[-1]) - np.repeat(upto - n, n)
        bad = np.flatnonzero(buf[np.repeat(s[i:j], n) + step] != other[np.repeat(begin[i:j], n) + step])
        out[i + np.searchsorted(upto, bad, side="right")] = False
        i = j
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` words that follow each other (also across texts; callers drop those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m] * PLACE[0]
    for k in range(1, n):
        out += h[k : k + m] * PLACE[k]
    return mix(out + U(n))


def owners(first: np.ndarray) -> np.ndarray:
    """The text's number for every word, from each text's first word (with the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` words lie in one text, as booleans over ``windows(h, n)``."""
    total = int(first[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    own = owners(first)
    return own[:m] == own[n - 1 :]


def sums(x: np.ndarray, ofs: np.ndarray) -> np.ndarray:
    """Sums of ``x`` between neighbouring offsets; of booleans, how many are true."""
    if x.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(x), ofs))
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return np.diff(total[ofs])


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands more than once, and whether an equal one stands earlier."""
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key) < 2:
        return again, later
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again[order[1:]] = same
    again[order[:-1]] |= same
    later[order[1:]] = same
    return again, later


def equal_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, own: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Whether each ``buf[s:e]`` equals an earlier one of the same owner: by hash, then by bytes.

    Should spans of one hash differ, the bytes themselves are the keys.
    """
    _, first, back = np.unique(hashes(buf, s, e) ^ salt[own], return_index=True, return_inverse=True)
    origin = first[back]
    later = np.flatnonzero(origin != np.arange(len(s)))
    at = origin[later]
    if not (same_bytes(buf, s[later], e[later], buf, s[at], e[at] - s[at]) & (own[later] == own[at])).all():
        keys = [(k, buf[a:b].tobytes()) for k, a, b in zip(own.tolist(), s.tolist(), e.tolist(), strict=True)]
        seen: set = set()
        return np.array([k in seen or seen.add(k) is not None for k in keys], bool)
    out = np.zeros(len(s), bool)
    out[later] = True
    return out


def covered_at(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` words that starts at one of ``at`` (ascending, distinct)."""
    out = np.zeros(total, bool)
    for k in range(n):
        out[at + k] = True
    return out
