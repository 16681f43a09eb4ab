"""Kneser-Ney character models: counted by Spark, kept in sorted hash arrays.

Characters are first folded to a fixed alphabet, so an n-gram is an integer code of
n * bits bits, a hash without collisions, and the whole model is bounded by that code
space, whatever the corpus: it may go to the driver and be broadcast. A model is its
sorted arrays and nothing else; every lookup is a binary search in them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import by_slices, ship

#: Symbol of a text's edge; it pads the left of each text.
EDGE = 0


def quality_alphabet() -> np.ndarray:
    """65,536 code points to 64 symbols that keep apart what junk overuses: symbols, capitals, digits, separators."""
    out = np.full(65536, 61, np.uint8)
    out[0x80:] = 60
    for cp in range(0xC0, 0x180):
        out[cp] = 36 + cp % 24
    out[0x20], out[0x0A], out[0x0D] = 1, 2, 2
    out[0x61:0x7B] = np.arange(3, 29)
    out[0x41:0x5B] = 29
    out[0x30:0x3A] = 30
    for symbol, chars in ((31, "."), (32, ",;:"), (33, "!?"), (34, "#*$%&|<>"), (35, "-'\"()[]{}/")):
        for c in chars:
            out[ord(c)] = symbol
    return out


def letter_alphabet() -> np.ndarray:
    """65,536 code points to 128 symbols: letters of any script, case folded; all else is a gap."""
    out = np.ones(65536, np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if not c.isalpha():
            continue
        low = ord(c.lower()[0])
        out[cp] = low - 0x61 + 2 if low < 0x80 else 28 + low - 0xDF if 0xDF <= low <= 0xFF else 61 + low % 67
    return out


#: Bits of a page of 64 code points in the codes of letters, and pages.
PAGE, PAGES = 15, 0x110000 >> 6


def letters(buf: np.ndarray, off: np.ndarray, alphabet: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The characters that share their symbol in ``alphabet`` with others, each as itself after the character before it; and offsets in them.

    Two codes a character: its page of 64 code points after the page before, and its
    place in the page after that page and the place before. All code points differ.
    """
    cp, at = K.code_points(buf, off, whole=True)
    on = (np.bincount(alphabet)[alphabet] > 1)[np.minimum(cp, 65535)]
    before = np.concatenate([np.zeros(1, np.int32), cp])[: len(cp)]
    before[at[:-1][np.diff(at) > 0]] = EDGE
    cp, before = cp[on].astype(np.int64), before[on].astype(np.int64)
    page = cp >> 6
    return [(before >> 6) << PAGE | page, ((before & 63) << PAGE | page) << PAGE | cp & 63], np.concatenate([[0], np.cumsum(on)])[at]


def count_letters(docs: DataFrame, alphabet: np.ndarray) -> DataFrame:
    """(kind, code, n): counts of the two codes of letters(), over all whole texts."""
    ship()

    def run(batches):
        held: list[tuple[list, list]] = [([], []), ([], [])]
        for _, buf, off in by_slices(batches, "text"):
            for i, code in enumerate(letters(buf, off, alphabet)[0]):
                for x, y in zip(held[i], np.unique(code, return_counts=True)):
                    x.append(y)
                if len(held[i][0]) >= 16:
                    k, c = K.merge_counts(*held[i])
                    held[i] = ([k], [c])
        for i, (keys, counts) in enumerate(held):
            k, c = K.merge_counts(keys, counts)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[a : a + 100_000]), i, np.int32)), pa.array(k[a : a + 100_000]), pa.array(c[a : a + 100_000])], ["kind", "code", "n"])

    return docs.select("text").mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def codes(buf: np.ndarray, off: np.ndarray, alphabet: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and offsets in them."""
    cp, at = K.code_points(buf, off)
    n = np.diff(at)
    padded = np.full(len(cp) + (order - 1) * len(n), EDGE, np.int32)
    place = np.arange(len(cp)) + np.repeat((order - 1) * np.arange(1, len(n) + 1), n)
    padded[place] = alphabet[cp]
    out = np.zeros(len(cp), np.int32)
    for j in range(order):
        out = (out << bits) | padded[place - (order - 1) + j]
    return out, at


def count(docs: DataFrame, group: str | None, alphabet: np.ndarray, order: int, bits: int) -> DataFrame:
    """(grp, code, n): n-gram counts over all whole texts of ``docs``, in each group (or all in one).

    Each task adds up its own texts first, so a shuffle carries each n-gram once a task.
    """
    ship()
    named = docs.select("text", (F.col(group) if group else F.lit("")).alias("grp"))

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        for rows, buf, off in by_slices(batches, "text"):
            names = rows.column(1).fill_null("").to_pylist()
            found, at = codes(buf, off, alphabet, order, bits)
            which = {x: i for i, x in enumerate(dict.fromkeys(names))}
            label = np.repeat([which[x] for x in names], np.diff(at)).astype(np.int64)
            key, n = np.unique((label << (order * bits)) | found if len(which) > 1 else found.astype(np.int64), return_counts=True)
            for name, i in which.items():
                a, b = np.searchsorted(key, [i << (order * bits), (i + 1) << (order * bits)])
                keys, counts = held.setdefault(name, ([], []))
                keys.append(key[a:b] & ((1 << (order * bits)) - 1))
                counts.append(n[a:b])
                if len(keys) >= 16:
                    k, c = K.merge_counts(keys, counts)
                    held[name] = ([k], [c])
        for name, (keys, counts) in held.items():
            k, c = K.merge_counts(keys, counts)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k[a : a + 100_000])), pa.array(k[a : a + 100_000].astype(np.int32)), pa.array(c[a : a + 100_000])], ["grp", "code", "n"])

    return named.mapInArrow(run, "grp string, code int, n long").groupBy("grp", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Interpolated modified Kneser-Ney. keys[k] are the sorted codes of order k + 1, logp[k] their log probabilities, and gamma[k] the log of the weight that the context sorted at contexts[k] leaves to the next lower order."""

    order: int
    bits: int
    keys: list
    logp: list
    contexts: list
    gamma: list
    symbols: int

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of the highest order: binary searches from there down, with the weight of each context passed on the way."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for k in range(self.order - 1, -1, -1):
            low = code[left] & ((1 << ((k + 1) * self.bits)) - 1)
            at, hit = _found(self.keys[k], low)
            out[left[hit]] += self.logp[k][at[hit]]
            left, context = left[~hit], low[~hit] >> self.bits
            at, known = _found(self.contexts[k], context)
            out[left[known]] += self.gamma[k][at[known]]
        out[left] -= np.log(self.symbols)
        return out

    def size(self) -> int:
        return sum(len(x) for x in (*self.keys, *self.contexts))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked keys in a sorted array, and which of them are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def losses(models: list[Model], buf: np.ndarray, off: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of each text under each model (a column each; 0 without characters), and characters. Each distinct n-gram of the slice is searched once."""
    code, at = codes(buf, off, alphabet, models[0].order, models[0].bits)
    n = np.diff(at)
    distinct, which = np.unique(code, return_inverse=True)
    distinct = distinct.astype(np.int64)
    return np.stack([-K.segment_sum(m.log_probability(distinct)[which], at) / np.maximum(n, 1) for m in models], 1), n


def letter_losses(models: list[Model], buf: np.ndarray, off: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of letters() in each text under the models of its two codes (0 without one), and how many it has."""
    found, at = letters(buf, off, alphabet)
    n, total = np.diff(at), 0.0
    for model, code in zip(models, found):
        distinct, which = np.unique(code, return_inverse=True)
        total = total - K.segment_sum(model.log_probability(distinct)[which], at)
    return total / np.maximum(n, 1), n


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; absolute 0.5 to 0.9 where count-of-counts are missing."""
    c = [float((n == k).sum()) for k in range(5)]
    if min(c[1:5]) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = c[1] / (c[1] + 2 * c[2])
    return np.clip([0, 1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def build(code: np.ndarray, n: np.ndarray, order: int, bits: int, symbols: int | None = None) -> Model:
    """A model from the counts of the highest order; lower orders take continuation counts. The last symbol of an n-gram is one of ``symbols``, or of all that the bits allow. No counts: the uniform model."""
    symbols = symbols or 1 << bits
    by = np.argsort(code)
    key, n = code[by].astype(np.int64), n[by].astype(np.int64)
    levels = [(key, n)]
    for k in range(order - 1, 0, -1):
        low, c = np.unique(levels[0][0] & ((1 << (k * bits)) - 1), return_counts=True)
        levels.insert(0, (low, c))
    model, lower = Model(order, bits, [], [], [], [], symbols), None
    for k, (key, n) in enumerate(levels):
        d = _discounts(n)[np.minimum(n, 3)]
        context, head = np.unique(key >> bits, return_index=True)
        total = np.add.reduceat(n, head) if len(n) else np.zeros(0)
        freed = np.add.reduceat(d, head) if len(n) else np.zeros(0)
        at = np.searchsorted(context, key >> bits)
        if k:
            suffix = key & ((1 << (k * bits)) - 1)
            base = np.exp(lower[1][np.searchsorted(lower[0], suffix)])
        else:
            base = np.full(len(key), 1 / symbols)
        p = (n - d + freed[at] * base) / total[at] if len(key) else np.zeros(0)
        lower = (key, np.log(p))
        model.keys.append(key)
        model.logp.append(np.log(p))
        model.contexts.append(context)
        model.gamma.append(np.log(freed / total) if len(key) else np.zeros(0))
    return model
