"""Array kernels over batches of UTF-8 texts.

Every function works on the Arrow layout of a string column: one byte buffer
``buf`` and ``off``, the n + 1 offsets of its n texts. Nothing loops over rows or
characters in Python, so the operators built on it cost nanoseconds a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes; each is inverted modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a hash depend on all its input."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        _POWERS[base] = got = np.cumprod(p)
    return got[:n]


def prefix_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial hash; span_hash() takes any span's hash from it in O(1)."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE[buf] * powers(BASES[which], len(buf)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    inverse = powers(pow(BASES[which], -1, 1 << 64), len(pre))
    return mix((pre[end] - pre[start]) * inverse[start] + (end - start).astype(U64))


def gram_hash(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries of h: len(h) - k + 1 values."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(BASES[which]) + h[j : j + n]
    return mix(out)


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """buf, off of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int):
    """(first, last) runs of whole texts of about ``most`` bytes, one text at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def runs(on: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within texts: starts, ends, and at ``first[i]`` text i's first run."""
    if not len(on):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin, end = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    end[:-1] &= ~on[1:]
    edge = off[(off > 0) & (off < len(on))]
    begin[edge] = on[edge]
    end[edge - 1] = on[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]], of empty segments too."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def positions(count: np.ndarray) -> np.ndarray:
    """0 .. count[0] - 1, 0 .. count[1] - 1, and so on."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def joined_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words lower-cased in A-Z, a space after each: bytes, starts, ends, first word of each text."""
    on = ~BLANK[buf]
    s, e, first = runs(on, off)
    size = e - s
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(s), 0x20, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(s)), size)] = LOWER[buf[on]]
    return out, start, start + size, first


_P = [U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each buf[start:start + size]."""
    p1, p2, p3, p4, p5 = _P
    padded = np.zeros(len(buf) + 40, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,)).copy()
    at = start.astype(np.int64)
    h = np.full(len(start), (seed + int(p5)) % (1 << 64), U64)
    if len(big := np.flatnonzero(size >= 32)):
        acc = [np.full(len(big), x % (1 << 64), U64) for x in (seed + int(p1) + int(p2), seed + int(p2), seed, seed - int(p1))]
        stripes, pos = size[big] // 32, at[big]
        for t in range(int(stripes.max())):
            on = np.flatnonzero(stripes > t)
            for j in range(4):
                acc[j][on] = _rotate(acc[j][on] + eight[pos[on] + 32 * t + 8 * j] * p2, 31) * p1
        v = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for a in acc:
            v = (v ^ (_rotate(a * p2, 31) * p1)) * p1 + p4
        h[big] = v
        at[big] += 32 * stripes
    h += size.astype(U64)
    left = size % 32
    for t in range(3):
        on = np.flatnonzero(left // 8 > t)
        h[on] = _rotate(h[on] ^ (_rotate(eight[at[on]] * p2, 31) * p1), 27) * p1 + p4
        at[on] += 8
    on = np.flatnonzero(left % 8 >= 4)
    h[on] = _rotate(h[on] ^ ((eight[at[on]] & U64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    at[on] += 4
    for t in range(3):
        on = np.flatnonzero(left % 4 > t)
        h[on] = _rotate(h[on] ^ (padded[at[on]].astype(U64) * p5), 11) * p1
        at[on] += 1
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    return h ^ (h >> U64(32))


#: Bit k of a byte, moved to byte k of a word: eight counters in one addition.
_LANES = np.zeros(256, U64)
for _k in range(8):
    _LANES |= ((np.arange(256, dtype=U64) >> U64(_k)) & U64(1)) << U64(8 * _k)


def bit_counts(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of h[off[i]:off[i + 1]] have each bit set: n rows of 64 counts."""
    n = len(off) - 1
    out = np.zeros((n, 64), np.int64)
    count = np.diff(off)
    if not len(h):
        return out
    full = np.flatnonzero(count > 0)
    parts = -(-count[full] // 255)
    head = np.repeat(off[full], parts) + 255 * positions(parts)
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], head, axis=0)
    small = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(head), 64)
    out[full] = np.add.reduceat(small, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return out


def code_points(buf: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 (65535 stands for those above, unless ``whole``), and offsets in them."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    cp = lead.astype(np.int32)
    more = np.zeros(len(buf) + 4, np.uint8)
    more[: len(buf)] = buf & 0x3F
    two, three = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0)), np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
    cp[two] = ((cp[two] & 0x1F) << 6) | more[at[two] + 1]
    cp[three] = ((cp[three] & 0x0F) << 12) | (more[at[three] + 1].astype(np.int32) << 6) | more[at[three] + 2]
    four = np.flatnonzero(lead >= 0xF0)
    tail = [more[at[four] + j].astype(np.int32) for j in (1, 2, 3)] if whole else []
    cp[four] = ((cp[four] & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2] if whole else 0xFFFF
    return cp, np.searchsorted(at, off)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[head], np.add.reduceat(c, head)


def member(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which 64-bit keys are in the sorted, distinct ``found``; a bit table settles most of them."""
    out = np.zeros(len(keys), bool)
    if not len(found) or not len(keys):
        return out
    bits = max(12, min(24, int(len(found)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[(found >> U64(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(keys >> U64(64 - bits)).astype(np.int64)])
    at = np.searchsorted(found, keys[maybe])
    at[at == len(found)] = 0
    out[maybe] = found[at] == keys[maybe]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values that occur twice or more."""
    s = np.sort(keys)
    same = s[1:][s[1:] == s[:-1]]
    return same[np.concatenate([[True], same[1:] != same[:-1]])] if len(same) else same
