"""Stupid-backoff scores of all documents under n-gram counts of the whole corpus, as one co-partitioned join.

Each word is exploded into a row: its document, the hash of the two words before it,
its own hash. The rows are dealt out once, by the history's hash. So a partition holds
its part of the count tables of both orders: trigrams are counted by (history, word),
bigrams by history, each row is joined to its two counts in place, and logarithms are
summed by document. A partition sends its sums on as one row for each group of
documents, where those of all partitions are added up. The hash space is taken
in PASSES parts, one after the other, so that only a part of the rows is on disk at a
time, and a partition holds about ROWS rows, whatever the corpus.

Frequent n-grams would make hot keys. A sample names candidates, their counts are
taken exactly over all texts, and these tables, bounded by FREQUENT, are broadcast: a
frequent trigram after a frequent history is never sent, another word after one is
dealt out by the whole trigram. The sample steers the work, never a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import Sent, forget, given, mapped, stored

#: Weight of each step down to a shorter history.
ALPHA = 0.4
#: Parts of the hash space, one shuffle after the other; rows of a partition; documents whose sums come together.
PASSES, ROWS, TOGETHER = 3, 1 << 20, 1 << 14
#: Rows of each broadcast count table at most; sampled texts that propose them; sampled occurrences that make a candidate.
FREQUENT, SAMPLE, LEAST = 1 << 17, 5_000, 16
U64 = np.uint64
#: The two high bits of a row's word tell what it adds: a plain one, the first of its text, one after a frequent history.
KIND = U64(62)
PLAIN, FIRST, AFTER = 0, 1, 2


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and each text's first word."""
    start, end, first = K.runs(~K.BLANK[buf], off)
    return K.span_hash(K.prefix_hash(K.LOWER[buf]), start, end), first


def grams(word: np.ndarray, first: np.ndarray, part: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every bigram (of one part of the hash space) with what follows it: its hash, the next word's (62 bits, 0 at a text's end), the trigram's, the text, whether it opens the text."""
    pair = K.gram_hash(word, 2)
    last, opens = np.zeros(len(word) + 1, bool), np.zeros(len(word) + 1, bool)
    last[first[1:][first[1:] > 0] - 1] = True
    opens[first[:-1]] = True
    at = np.flatnonzero(~last[: len(pair)] if part is None else ~last[: len(pair)] & (pair % U64(PASSES) == U64(part)))
    pair = pair[at]
    after = np.where(last[at + 1], U64(0), np.maximum(word[np.minimum(at + 2, max(len(word) - 1, 0))] >> U64(2), U64(1)))
    return pair, after, K.mix(pair * U64(K.BASES[1]) + after), np.searchsorted(first, at, "right") - 1, opens[at]


class Frequent:
    """Sorted hashes of frequent bigrams and trigrams with their exact counts; empty before they are counted."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.keys = [t[0] for t in tables]
        self.logs = [np.log(np.maximum(t[1], 1)) for t in tables]

    def split(self, pair: np.ndarray, after: np.ndarray, three: np.ndarray):
        """Which bigrams are frequent, which trigrams are settled by the tables, and what these tables add for each row, openings left out."""
        hot = K.member(pair, self.keys[0])
        done = np.zeros(len(pair), bool)
        at = np.flatnonzero(hot & (after != 0))
        done[at] = K.member(three[at], self.keys[1])
        value = np.zeros(len(pair))
        value[at] = -self.logs[0][np.searchsorted(self.keys[0], pair[at])]
        known = np.flatnonzero(done)
        value[known] += self.logs[1][np.searchsorted(self.keys[1], three[known])]
        return hot, done, value


def _counted(docs: DataFrame, only: list[np.ndarray] | None) -> DataFrame:
    """(kind, key, n): counts of bigrams (0) and trigrams (1) by hash: exact ones of those in two sorted arrays, or without these counts of what occurs twice or more in a slice of texts, which finds the frequent ones."""
    shared = Sent(docs.sparkSession, only)

    def kernel(rows, buf, off):
        pair, after, three, _, _ = grams(*words(buf, off))
        out = []
        for kind, key in ((0, pair), (1, three[after != 0])):
            keys, n = np.unique(key if shared.value is None else key[K.member(key, shared.value[kind])], return_counts=True)
            if shared.value is None:
                keys, n = keys[n > 1], n[n > 1]
            out.append((np.full(len(keys), kind), keys.view(np.int64), n))
        return [np.concatenate(x) for x in zip(*out)]

    return mapped(docs.select("text"), kernel, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _tables(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    got = counts.toPandas()
    out = []
    for kind in (0, 1):
        own = got[got["kind"] == kind]
        key = own["key"].to_numpy(np.int64).view(U64)
        by = np.argsort(key)
        out.append((key[by], own["n"].to_numpy(np.int64)[by]))
    return out


def frequent(docs: DataFrame) -> Frequent:
    """Exact counts of the n-grams that are frequent in a sample; at most FREQUENT of either order."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(share)) == 0)
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "key")
    top = _counted(some, None).filter(F.col("n") >= LEAST).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FREQUENT)
    found = _tables(top.select("kind", "key", "n"))
    return Frequent(_tables(_counted(docs, [t[0] for t in found])) if sum(len(t[0]) for t in found) else found)


def _rows(docs: DataFrame, tables, part: int) -> DataFrame:
    """(doc, text, history, word): the exploded n-grams of one part of the hash space."""

    def kernel(rows, buf, off):
        word, first = words(buf, off)
        pair, after, three, text, opens = grams(word, first, part)
        hot, done, _ = tables.value.split(pair, after, three)
        key = np.where(hot, three, pair)
        kind = np.where(hot, U64(AFTER), np.where(opens, U64(FIRST), U64(PLAIN)))
        pick = np.flatnonzero(~done & ~(hot & (after == 0)))
        text = text[pick]
        return [rows.column(0).take(pa.array(text)), _text_hash(buf, off)[text].view(np.int64), key[pick].view(np.int64), (after[pick] | kind[pick] << KIND).view(np.int64)]

    return mapped(docs, kernel, "doc long, text_hash long, history long, word long")


def _text_hash(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return K.span_hash(K.prefix_hash(buf, 1), off[:-1], off[1:], 1)


def _joined(groups: int):
    """The rows of a partition, joined to the counts of their histories and trigrams there: one row for each group of documents, with the sums of those documents."""

    def run(batches):
        table = pa.Table.from_batches([x for x in batches if x.num_rows], schema=pa.schema([(x, pa.int64()) for x in ("doc", "text_hash", "history", "word")]))
        if not table.num_rows:
            return
        doc, text, history, word = (c.to_numpy() for c in table.columns)
        word = word.view(U64)
        after, kind = word & U64((1 << 62) - 1), word >> KIND
        order = np.lexsort((after, history))
        h, a = history[order], after[order]
        new = np.ones(len(order), bool)
        new[1:] = h[1:] != h[:-1]
        two = _log_sizes(new, order)
        new[1:] |= a[1:] != a[:-1]
        value = np.where(after != 0, _log_sizes(new, order) - np.where(kind != AFTER, two, 0.0), 0.0) + np.where(kind == FIRST, two, 0.0)
        doc, text, value = _added_up(doc, text, value)
        group = (K.mix(text.view(U64) + doc.view(U64)) % U64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))])
        some = np.flatnonzero(np.diff(at))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(at[some], len(by)).astype(np.int32)), pa.array(x[by])) for x in (doc, text, value)]
        yield pa.RecordBatch.from_arrays([pa.array(some), *lists], ["grp", "docs", "texts", "parts"])

    return run


def _added_up(doc: np.ndarray, text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of the first two with the sums of the third."""
    order = np.lexsort((text, doc))
    doc, text = doc[order], text[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[head], text[head], np.add.reduceat(value[order], head) if len(head) else value


def _total(table: pa.Table) -> pa.Table:
    found = _added_up(*(pa.concat_arrays([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in table.column(c).chunks]).to_numpy() for c in ("docs", "texts", "parts")))
    return pa.table({"doc": pa.array(found[0]), "text_hash": pa.array(found[1]), "part": pa.array(found[2])})


def _log_sizes(new: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Logarithm of the size of each row's group, where groups begin at ``new`` in the given order."""
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    out = np.empty(len(order))
    out[order] = np.repeat(np.log(size), size)
    return out


def _summed(rows: DataFrame, partitions: int, groups: int) -> DataFrame:
    """(doc, text_hash, part): the exploded n-grams joined to their counts, and logarithms summed by document."""
    found = rows.repartition(partitions, "history").mapInArrow(_joined(groups), "grp long, docs array<long>, texts array<long>, parts array<double>")
    return found.groupBy("grp").applyInArrow(_total, "doc long, text_hash long, part double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_trigrams, log_score, score of each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-blanks, lower-cased in A-Z; counts are those of the whole
    table, the row's own words included, of all orders and however rare. A word with
    two before it scores the trigram's count over that of the history; no such count
    is zero here. A text's second word has no trigram and backs off: ALPHA times the
    bigram's count over the first word's; its first word scores ALPHA squared times
    its share of all words. log_score is the sum of natural logarithms, score the mean
    (null without words). Null, empty and blank texts have no words. Repeated rows
    count repeatedly and get equal scores; null ids keep their rows; an empty table
    gives none. N-grams are compared by 64-bit hashes.
    """
    asked = given(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "text", "doc_id")
    tables = Sent(docs.sparkSession, frequent(asked))

    def kernel(rows, buf, off):
        word, first = words(buf, off)
        n = np.diff(first)
        pair, after, three, text, opens = grams(word, first)
        hot, _, value = tables.value.split(pair, after, three)
        at = np.flatnonzero(hot & opens)
        value[at] += tables.value.logs[0][np.searchsorted(tables.value.keys[0], pair[at])]
        known = np.bincount(text, value, minlength=len(n)).astype(np.float64)[: len(n)]
        lone = np.zeros(len(n), np.int64)
        lone[n == 1] = word[first[:-1][n == 1]].view(np.int64)
        return [rows.column(2), rows.column(0), _text_hash(buf, off).view(np.int64), n, known, pa.array(lone, mask=n != 1)]

    base = stored(mapped(asked, kernel, "doc_id long, doc long, text_hash long, n_words long, known double, lone long"))
    total = base.agg(F.sum("n_words").alias("all_words"))
    size = base.agg(F.sum("n_words").alias("words"), F.count("*").alias("rows")).first()
    partitions, groups = max(1, -(-(size.words or 0) // (PASSES * ROWS))), max(16, -(-size.rows // TOGETHER))
    parts = [stored(_summed(_rows(asked.select("doc", "text"), tables, p), partitions, groups)) for p in range(PASSES)]
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    sums = sums.groupBy("doc", "text_hash").agg(F.sum("part").alias("part"))
    times = base.filter("n_words > 1").groupBy("doc", "text_hash").agg(F.count("*").alias("times"))
    each = stored(sums.join(times, ["doc", "text_hash"]).select("doc", "text_hash", (F.col("part") / F.col("times")).alias("part")))
    forget(*parts)
    lone = base.select("lone").filter("lone is not null").distinct()
    singles = lone.withColumn("n", F.lit(0).cast("long")).limit(0)
    if lone.take(1):
        every = mapped(asked.select("text"), lambda rows, buf, off: [x.view(np.int64) for x in np.unique(words(buf, off)[0], return_counts=True)], "lone long, n long")
        singles = stored(every.join(lone, "lone", "left_semi").groupBy("lone").agg(F.sum("n").alias("n")))
    met = base.join(each, ["doc", "text_hash"], "left").join(singles, "lone", "left").join(F.broadcast(total))
    down = float(np.log(ALPHA))
    long = F.col("known") + F.coalesce("part", F.lit(0.0)) + 3 * down
    log = F.when(F.col("n_words") > 0, F.when(F.col("n_words") > 1, long).otherwise(F.log(F.col("n").cast("double")) + 2 * down) - F.log(F.col("all_words").cast("double"))).otherwise(F.lit(0.0))
    return met.select("doc_id", "n_words", F.greatest(F.col("n_words") - 2, F.lit(0)).alias("n_trigrams"), log.alias("log_score"), F.when(F.col("n_words") > 0, log / F.col("n_words")).alias("score"))
