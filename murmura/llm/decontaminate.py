"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-gram hashes of a text the least one is kept. Any
span of WINDOW + GRAM - 1 words that a document shares with a benchmark item thus
shares a kept fingerprint. Hits are extended to the item windows around them, which
are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import Sent, filtered, given, mapped, stored

#: A span of SPAN words is certain to be found: GRAM-word grams, WINDOW of them in each window.
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 32 << 20

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True
U64 = np.uint64


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each lower-cased word, and each text's first word."""
    start, end, first = K.runs(WORD[buf], off)
    low = K.LOWER[buf]
    return K.span_hash(K.prefix_hash(low), start, end), K.span_hash(K.prefix_hash(low, 1), start, end, 1), first


def _inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which k-grams of a run of texts lie within one text."""
    ok = np.zeros(max(0, total - k + 1), bool)
    n = np.maximum(np.diff(first) - k + 1, 0)
    ok[np.repeat(first[:-1], n) + K.positions(n)] = True
    return ok


def winnow(gram: np.ndarray, ok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the kept grams: the least of each WINDOW grams within a text (all of them, in a text of fewer)."""
    if not len(gram):
        return np.zeros(0, np.int64)
    top = U64(0xFFFFFFFFFFFFFFFF)
    h = np.where(ok, gram, top)
    n = np.maximum(np.diff(first) - GRAM + 1, 0)
    windows = np.maximum(n - WINDOW + 1, np.minimum(n, 1))
    head = np.repeat(first[:-1], windows) + K.positions(windows)
    padded = np.concatenate([h, np.full(WINDOW, top, U64)])
    least, at = padded[head], head.copy()
    last = head + np.minimum(np.repeat(n, windows), WINDOW)
    for j in range(1, WINDOW):
        here = np.where(head + j < last, padded[head + j], top)
        less = here < least
        least = np.where(less, here, least)
        at[less] = head[less] + j
    return np.unique(at)


class Benchmark:
    """Items as sorted hash arrays: fingerprints, windows by length, and the items of each window."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = ids
        buf, off = K.layout(pa.array(texts, pa.string()))
        one, two, first = _words(buf, off)
        n = np.diff(first)
        gram = K.gram_hash(one, GRAM)
        long = np.repeat(n >= SPAN, n)
        kept = winnow(gram, _inside(first, GRAM, len(one)), first)
        self.prints = np.unique(gram[kept[long[kept]]]) if len(kept) else np.zeros(0, U64)
        item = np.repeat(np.arange(len(n)), n)
        self.windows = {}
        for size in sorted({SPAN, *n[(n > 0) & (n < SPAN)].tolist()}):
            at = np.flatnonzero(_inside(first, size, len(one)))
            at = at[(n[item[at]] == size) if size < SPAN else (n[item[at]] >= SPAN)]
            if len(at):
                a, b = K.gram_hash(one, size)[at], K.gram_hash(two, size, 1)[at]
                order = np.lexsort((item[at], b, a))
                self.windows[size] = (a[order], b[order], item[at][order])

    def hits(self, buf: np.ndarray, off: np.ndarray):
        """Word counts; word spans (text, start, end) that match a window; (text, item) pairs."""
        one, two, first = _words(buf, off)
        n, total = np.diff(first), len(one)
        doc_of = np.repeat(np.arange(len(n)), n)
        spans, pairs = [], []
        for size, (a, b, item) in self.windows.items():
            if total < size:
                continue
            ok = _inside(first, size, total)
            if size == SPAN:
                gram = K.gram_hash(one, GRAM)
                kept = winnow(gram, _inside(first, GRAM, total), first)
                kept = kept[K.member(gram[kept], self.prints)]
                near = (kept[:, None] - np.arange(WINDOW)[None, :]).reshape(-1)
                near = np.unique(near[(near >= 0) & (near < len(ok))])
                at = near[ok[near]]
                if not len(at):
                    continue
                # the grams are taken by gathering, as only few positions are left
                ha, hb = _gram_at(one, at, size, 0), _gram_at(two, at, size, 1)
            else:
                at = np.flatnonzero(ok)
                ha = K.gram_hash(one, size)[at]
                found = K.member(ha, np.unique(a))
                at, ha = at[found], ha[found]
                hb = _gram_at(two, at, size, 1)
            lo, hi = np.searchsorted(a, ha, "left"), np.searchsorted(a, ha, "right")
            many = hi - lo
            entry = np.repeat(lo, many) + K.positions(many)
            whose = np.repeat(np.arange(len(at)), many)
            same = b[entry] == hb[whose]
            entry, whose = entry[same], whose[same]
            pairs.append(np.stack([doc_of[at[whose]], item[entry]], 1))
            head = at[np.unique(whose)]
            spans.append(np.stack([doc_of[head], head - first[doc_of[head]], head - first[doc_of[head]] + size], 1))
        spans = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return n, spans, pairs


def _gram_at(h: np.ndarray, at: np.ndarray, k: int, which: int) -> np.ndarray:
    out = np.zeros(len(at), U64)
    for j in range(k):
        out = out * U64(K.BASES[which]) + h[at + j]
    return K.mix(out)


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal disjoint spans of (text, start, end) rows, by text and start."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.maximum.accumulate(spans[:, 2] + spans[:, 0] * (1 << 32)) - spans[:, 0] * (1 << 32)
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > far[:-1])
    head = np.flatnonzero(new)
    return np.stack([spans[head, 0], spans[head, 1], np.maximum.reduceat(spans[:, 2], head)], 1)


def _block_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, starts, ends, items of each row, for a bounded block of items, and two hashes h1 and h2 of its text."""
    shared = Sent(docs.sparkSession, _benchmark(items))

    def kernel(rows, buf, off):
        bench = shared.value
        n, spans, pairs = bench.hits(buf, off)
        spans = _union(spans)
        cut, got = np.searchsorted(spans[:, 0], np.arange(len(n) + 1)), np.searchsorted(pairs[:, 0], np.arange(len(n) + 1))
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        whole = [K.span_hash(K.prefix_hash(buf, w), off[:-1], off[1:], w).view(np.int64) for w in (0, 1)]
        return [rows.column(0), n, lists(cut, pa.array(spans[:, 1])), lists(cut, pa.array(spans[:, 2])), lists(got, pa.array([bench.ids[i] for i in pairs[:, 1]], pa.string())), *whole]

    return mapped(given(docs, "doc_id", "text"), kernel, "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>, h1 long, h2 long")


def _benchmark(items: DataFrame) -> Benchmark:
    rows = items.collect()
    return Benchmark([r.item for r in rows], [r.text for r in rows])


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """(item, text) of items with both, in blocks of about BLOCK_BYTES."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items for b in range(blocks)]


def _united(parts: list[DataFrame]) -> DataFrame:
    """The rows of all blocks as one row for each row of the documents. Equal texts have equal hits, so these are united by text and joined back to the rows."""
    hits = None
    for p in parts:
        one = p.filter("size(items) > 0").groupBy("h1", "h2").agg(F.max(F.struct("starts", "ends", "items")).alias("x"))
        hits = one if hits is None else hits.unionByName(one)
    found = hits.groupBy("h1", "h2").agg(F.flatten(F.collect_list(F.arrays_zip("x.starts", "x.ends"))).alias("spans"), F.flatten(F.collect_list("x.items")).alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["starts"] <= F.element_at(acc, -1)["ends"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.withColumn("spans", merged).select("h1", "h2", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = parts[0].select("doc_id", "n_words", "h1", "h2").join(found, ["h1", "h2"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("starts", none("long")).alias("starts"), F.coalesce("ends", none("long")).alias("ends"), F.coalesce("items", none("string")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, starts, ends, items of each row of ``docs``.

    A document word is hit if it lies in an occurrence of a window of an item: SPAN
    consecutive words of it, or all its words if it has fewer, but not none. starts
    and ends are the maximal hit runs, in words; items the distinct ids, as sorted
    strings, of items with an occurring window. Null and empty texts have no words;
    items of null id or no words are left out; repeated ids count once; repeated rows
    and null doc_ids each keep their row; an empty table gives none, an empty
    benchmark no hits. Other columns of either table are ignored.

    The benchmark is the stated query set. Up to BLOCK_BYTES of it are broadcast; a
    larger one is taken in blocks of that size, each against all documents.
    """
    parts = [_block_hits(docs, b) for b in _blocks(benchmark)]
    found = parts[0] if len(parts) == 1 else _united([stored(p) for p in parts])
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "starts", "ends", F.array_sort(F.array_distinct("items")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no window of the benchmark occurs in, each judged by its own text; all columns stay.

    One pass for each block, no shuffle. Null and empty texts stay, as do null ids;
    repeated rows stay or go together; an empty table gives an empty one.
    """
    for block in _blocks(benchmark):
        shared = Sent(docs.sparkSession, _benchmark(block))

        def clean(rows, buf, off, shared=shared):
            keep = np.ones(len(off) - 1, bool)
            keep[shared.value.hits(buf, off)[1][:, 0]] = False
            return keep

        docs = filtered(docs, clean)
    return docs
