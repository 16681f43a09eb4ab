"""A run-length index: the Burrows-Wheeler transform of a set of strings in runs, with samples at run ends."""

from __future__ import annotations

import numpy as np

from murmura.llm import kernels as K

U64 = np.uint64


def _sorted(key: np.ndarray, key_bits: int, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (key, place), and which of them have another key than the one before; key and place share a word where they fit."""
    place_bits = int(places).bit_length()
    if key_bits + place_bits <= 64:
        s = np.sort((key << U64(place_bits)) | place.astype(U64))
        order, key = (s & U64((1 << place_bits) - 1)).astype(np.int64), s >> U64(place_bits)
    else:
        by = np.argsort(key, kind="stable")
        order, key = place[by], key[by]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def suffix_array(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of strings that end in 0, and which rows differ from the one above within ``length`` symbols.

    A string's end sorts by its place, so suffixes never tie. Prefix doubling from 3
    or 6 symbols, of groups that are not settled yet only; the ranks at depth
    ``length`` - 2, which must be 48, tell the classes.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = 6 if 6 * bits + int(n).bit_length() <= 64 else 3
    one = np.zeros(n + depth, U64)
    one[:n] = symbols
    two = (one[:-1] << U64(bits)) | one[1:]
    key = (two[:n] << U64(bits)) | one[2 : n + 2]
    if depth == 6:
        four = (two[:-2] << U64(2 * bits)) | two[2:]
        key = (four[:n] << U64(2 * bits)) | two[4 : n + 4]
    settled, ends = np.zeros(n, bool), np.flatnonzero(symbols == 0)
    for j in range(depth):  # what follows a string's end does not count
        at = ends[ends >= j] - j
        low = U64(bits * (depth - 1 - j))
        key[at] = (key[at] >> low) << low
        settled[at] = True
    sa, new = _sorted(key, depth * bits, np.arange(n), n)
    new |= settled[sa]
    slots = np.arange(n)
    rank, at_48 = np.empty(n, np.int64), None
    order, wide = sa, int(n + 1).bit_length()
    while True:
        head = np.flatnonzero(new)
        rank[order] = np.repeat(slots[head], np.diff(np.append(head, len(order))))
        if depth == length - 2:
            at_48 = rank.copy()
        open_ = ~new
        open_[:-1] |= ~new[1:]
        if not open_.any():
            break
        slots = slots[open_]
        act = order[open_]
        after = np.where(act + depth < n, rank[np.minimum(act + depth, n - 1)] + 1, 0)
        order, new = _sorted((rank[act].astype(U64) << U64(wide)) | after.astype(U64), 2 * wide, act, n)
        sa[slots] = order
        depth *= 2
    at_48 = rank if at_48 is None else at_48
    near = at_48[sa]
    far = np.concatenate([at_48 + 1, [0, 0]])[sa + 2]
    apart = np.ones(n, bool)
    apart[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
    return sa, apart


class RunIndex:
    """Index of distinct byte strings, each with a number (its least document).

    It keeps the transform in runs: each run's symbol, its rows and where they go one
    symbol to the left; the text position at each run's first and last row,
    and nowhere else; and the least number of each class of rows that agree in
    ``length`` symbols.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, length: int = 50):
        used = np.zeros(256, bool)
        used[data] = True
        self.code = np.full(256, int(used.sum()) + 1, np.int16)
        self.code[used] = np.arange(1, int(used.sum()) + 1, dtype=np.int16)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        body = np.ones(len(text), bool)
        body[ends - 1] = False
        text[body] = self.code[data]
        self.length = length
        self.sums = np.zeros(len(text) + 1, U64)
        np.cumsum(K.BYTE[text] * K.powers(K.BASES[0], len(text)), out=self.sums[1:])
        sa, new = suffix_array(text, length)
        transform = text[sa - 1]
        head = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        last = np.append(head[1:], len(sa)) - 1
        runs = last - head + 1
        self.heads, self.lasts, self.symbols = head.astype(np.int32), last.astype(np.int32), transform[head].astype(np.int16)
        self.head_samples, self.last_samples = sa[head], sa[last]
        by = np.argsort(self.symbols.astype(np.uint16), kind="stable")
        targets = np.empty(len(head), np.int64)
        targets[by] = np.cumsum(runs[by]) - runs[by]
        self.shifts = (targets - head).astype(np.int32)  # from a row to that of one symbol more to the left, the same for a whole run
        self.by_symbol = self.symbols[by].astype(np.int64) * len(head) + by  # runs in the order of symbol and place: sorted
        in_runs = np.zeros(len(sa), np.int32)
        in_runs[head[1:]] = 1
        self.run_of = np.cumsum(in_runs, dtype=np.int32)
        class_starts = np.flatnonzero(new)
        self.class_of = np.cumsum(new, dtype=np.int32) - 1
        whose = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.class_least = np.minimum.reduceat(numbers[whose[sa]], class_starts)

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the text is the same for ``size`` symbols from two places on, by its prefix sums."""
        near, far = np.minimum(a, b), np.maximum(a, b)
        end = far + size
        ok = end < len(self.sums)
        end = np.where(ok, end, far)
        span = self.sums[np.where(ok, near + size, near)] - self.sums[near]
        return ok & (span * K.powers(K.BASES[0], len(self.sums))[far - near] == self.sums[end] - self.sums[far])

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols two places of the text share from there on, ``most`` at most, by halving."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            m = (low + high + 1) // 2
            same = self._equal(a, b, m)
            low, high = np.where(same, m, low), np.where(same, high, np.minimum(high, m - 1))
        return low

    def _stream(self, data: np.ndarray, sizes: np.ndarray):
        """All strings through the transform, right to left, the longest first in every array: for each step the strings still in it, their byte, the length of its match, its place and its row.

        Where the row's run has the symbol, the match grows by it. Else it is cut to
        what it shares with the nearest row above or below that has the symbol, the
        better of the two: these rows are a run's last and first, so their places are
        the samples. A symbol that the index lacks ends the match.
        """
        order = np.argsort(-sizes, kind="stable")
        last, by_size = (np.cumsum(sizes) - 1)[order], -sizes[order]
        steps, runs = int(sizes.max(initial=0)), len(self.heads)
        from_right = np.zeros((steps, len(sizes)), np.int16)  # a row of symbols for each step
        column, step = np.repeat(np.arange(len(sizes)), sizes[order]), K.positions(sizes[order])
        from_right[step, column] = self.code[data[last[column] - step]]
        row = np.zeros(len(sizes), np.int32)
        # kept as if each step changed nothing: a match that grows by a symbol moves one place to the left
        size, place = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.head_samples[0], np.int64)
        for t in range(steps):
            n = int(np.searchsorted(by_size, -t - 1, "right"))
            row, place, size, c = row[:n], place[:n], size[:n], from_right[t, :n]
            run = self.run_of[row]
            odd = np.flatnonzero(self.symbols[run] != c)
            if len(odd):
                want = c[odd].astype(np.int64) * runs
                near = np.searchsorted(self.by_symbol, want + run[odd])
                up, down = self.by_symbol[np.maximum(near - 1, 0)] - want, self.by_symbol[np.minimum(near, runs - 1)] - want
                has_up, has_down = (up >= 0) & (up < runs), (down >= 0) & (down < runs)
                up, down = np.where(has_up, up, 0), np.where(has_down, down, 0)
                here, most = place[odd] - t, size[odd] + t
                shared = np.where(has_up & self._equal(here, self.last_samples[up], most), most, -1)
                above = shared == most
                left = np.flatnonzero(~above)
                whole = has_down[left] & self._equal(here[left], self.head_samples[down[left]], most[left])
                shared[left[whole]] = most[left[whole]]
                left = left[~whole]
                if len(left):
                    with_up = np.where(has_up[left], self._common(here[left], self.last_samples[up[left]], most[left]), -1)
                    with_down = np.where(has_down[left], self._common(here[left], self.head_samples[down[left]], most[left]), -1)
                    above[left], shared[left] = with_up >= with_down, np.maximum(with_up, with_down)
                run[odd] = np.where(above, up, down)
                row[odd] = np.where(above, self.lasts[up], self.heads[down])
                place[odd] = np.where(above, self.last_samples[up], self.head_samples[down]) + t
                size[odd] = shared - t
            row += self.shifts[run]
            if len(odd) and len(none := odd[~(has_up | has_down)]):
                row[none], place[none], size[none] = 0, self.head_samples[0] + t + 1, -t - 1
            yield order[:n], last[:n] - t, size + (t + 1), place - (t + 1), row

    def matching_statistics(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of each string: how long the longest match with an indexed string is that begins there, and where in the index it lies."""
        length, place = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for _, at, size, where, _ in self._stream(data, sizes):
            length[at], place[at] = size, where
        return length, place

    def least(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The least number of the indexed strings that hold each window of ``length`` of each string, window after window; -1 where none does. A window is held where the match that begins with it is as long."""
        windows = np.maximum(sizes - self.length + 1, 0)
        shift = np.cumsum(windows) - windows - (np.cumsum(sizes) - sizes)  # from a byte to its window
        out = np.full(int(windows.sum()), -1, np.int64)
        for t, (which, at, size, _, row) in enumerate(self._stream(data, sizes)):
            if t >= self.length - 1:
                out[at + shift[which]] = np.where(size >= self.length, self.class_least[self.class_of[row]], -1)
        return out
