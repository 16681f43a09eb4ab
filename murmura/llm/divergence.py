"""How far the sources of a language are from each other, term by term, in whole numbers.

Terms become integers: a chunk of a language's vocabulary is a sorted array of kept
terms, a term's id is its place there, so ids order as the UTF-8 bytes do. A chunk's
counts are then dense vectors, one for each source, filled by bincount; sums over
pairs of sources and the ranks of terms work on these vectors and on ids alone.

Chunks are made by a term's hash, of about CHUNK rows each, so neither a large
language nor a large source meets in one task. Each document is read once, and a
task adds up what it has read before anything is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import by_slices, forget, ship, stored

TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = True
TERM[0x80:] = True
#: Bytes of text counted at once, counts a task holds before it sends them, rows of a chunk, cells of a dense block, sources of a block of pairs.
SLICE, HELD, CHUNK, CELLS, SIDE = 8 << 20, 2_000_000, 1 << 19, 1 << 22, 512
#: Probabilities are parts of this.
ONE = 1_000_000_000
COUNTS = ["lang", "source", "term", "n", "df"]


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a run of texts, lower-cased in A-Z, and how many each text has."""
    on = TERM[buf]
    start, end, first = K.runs(on, off)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    data = K.LOWER[buf[on]]
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.diff(first)


def _counted(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a slice; each (lang, source) also with the empty term, 0 times."""
    found, n = terms(buf, off)
    coded = found.dictionary_encode()
    size = len(coded.dictionary) + 1
    lang, source = (rows.column(i).dictionary_encode() for i in (1, 2))
    group, of = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    cell, times = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(), return_counts=True)
    key = np.concatenate([of[cell // size] * size + cell % size, np.arange(len(group)) * size + size - 1])
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    here = key[order][head]
    docs = np.where(here % size == size - 1, 0, np.diff(np.append(head, len(key))))
    every = pa.concat_arrays([coded.dictionary, pa.array([""])])
    at = group[here // size]
    names = [lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary))), every.take(pa.array(here % size))]
    return pa.table([*names, pa.array(np.add.reduceat(np.append(times, np.zeros(len(group), np.int64))[order], head)), pa.array(docs)], COUNTS)


def _added(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables)
    return both.group_by(COUNTS[:3], use_threads=False).aggregate([("n", "sum"), ("df", "sum")]).select([*COUNTS[:3], "n_sum", "df_sum"]).rename_columns(COUNTS) if len(tables) > 1 else both


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): one row or more of each, to be added up; null lang and source are empty."""
    ship()

    def run(batches):
        held: list[pa.Table] = []
        for rows, buf, off in by_slices(batches, "text", SLICE):
            held.append(_counted(rows, buf, off))
            if sum(t.num_rows for t in held) > HELD:
                held = [_added(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _added(held).to_batches(1 << 16)

    asked = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return asked.mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), exact: three decimal digits of the quotient a step."""
    left = count + 1
    out = left // total
    for _ in range(3):
        left = (left % total) * 1000
        out = out * 1000 + left // total
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); at most 10^18, and no sum over a vocabulary is above 2 * 10^18."""
    d = p - q
    return d * d // q


def _compared(top: int):
    """A chunk and its language's sources: what the chunk adds to each ordered pair of sources, and each source's ``top`` terms in it."""

    def run(rows: pa.Table, head: pa.Table) -> pa.Table:
        out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        if not rows.num_rows:
            return out.empty_table()
        lang, vocabulary = head.column("of_lang")[0], head.column("v")[0].as_py()
        sources, sums = (pa.array(head.column(c)[0].as_py()) for c in ("sources", "sums"))
        kept = rows.column("term").combine_chunks().unique()
        kept = kept.take(pc.sort_indices(kept))
        ids = pc.index_in(rows.column("term"), kept).to_numpy().astype(np.int64)
        place = pc.index_in(rows.column("source"), sources).to_numpy().astype(np.int64)
        n, sums = rows.column("n").to_numpy(), sums.to_numpy() + vocabulary

        every = np.zeros(len(kept), np.int64)
        np.add.at(every, ids, n)
        q = share(every, int(sums.sum()) - len(sums) * vocabulary + vocabulary)[ids]
        p = share(n, sums[place])
        more = np.flatnonzero((n > 0) & (p > q))
        value = gap(p[more], q[more])
        order = np.lexsort((ids[more], -value, place[more]))
        first = np.searchsorted(place[more][order], np.arange(len(sources)))
        order = order[np.arange(len(order)) - first[place[more][order]] < top]
        made = [(place[more][order], kept.take(pa.array(ids[more][order])), value[order], "term")]

        width = max(1, CELLS // min(len(sources), SIDE))
        by_id = np.argsort(ids, kind="stable")
        cuts = np.searchsorted(ids[by_id], np.append(np.arange(0, len(kept), width), len(kept)))

        def dense(a: int, b: int, low: int) -> np.ndarray:
            """Shares of the terms from ``low`` in sources a to b, absent ones too."""
            at = by_id[cuts[low // width] : cuts[low // width + 1]]
            at = at[(place[at] >= a) & (place[at] < b)]
            cells = min(width, len(kept) - low)
            filled = np.bincount((place[at] - a) * cells + ids[at] - low, n[at], (b - a) * cells).astype(np.int64)
            return share(filled.reshape(b - a, cells), sums[a:b, None])

        for a in range(0, len(sources), SIDE):
            for b in range(0, len(sources), SIDE):
                ends = min(a + SIDE, len(sources)), min(b + SIDE, len(sources))
                total = np.zeros((ends[0] - a, ends[1] - b), np.int64)
                for low in range(0, len(kept), width):
                    ours = dense(a, ends[0], low)
                    theirs = ours if a == b else dense(b, ends[1], low)
                    for i in range(len(ours)):
                        total[i] += gap(ours[i], theirs).sum(axis=1)
                i, j = np.indices(total.shape).reshape(2, -1)
                apart = np.flatnonzero(i + a != j + b)
                made.append((i[apart] + a, sources.take(pa.array(j[apart] + b)), total.reshape(-1)[apart], "pair"))
        return pa.concat_tables([pa.table([pa.array([lang.as_py()] * len(s), pa.string()), sources.take(pa.array(s)), pa.array([part] * len(s), pa.string()), item, pa.array(v)], schema=out) for s, item, v, part in made])

    return run


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ (of text, lang and source; other columns are ignored).

    Terms are runs of ASCII letters and non-ASCII characters, lower-cased in A-Z. A
    language keeps the terms that at least ``least_docs`` of its rows hold. A source
    gives a kept term it holds c times p = 1 + floor(10^9 (c + 1) / (N + V)), where N
    sums its kept terms and V counts the language's; the language's q is made alike.
    Part ``pair`` has every other source of the language, with floor((p - q)^2 / q)
    summed over all kept terms, q being the other's; part ``term`` has the ``top``
    terms that the source has more of than its language. Ranks go from 1 in each group
    and part, value descending, then item by its bytes. All numbers are whole.

    A null text, lang or source is the empty text. Repeated rows are documents of
    their own. A language without kept terms has pairs of value 0; one with a single
    source has no pairs; an empty table gives no rows. Counts are exact below 9 * 10^15.
    """
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    marked = counts.withColumn("docs", F.sum("df").over(of_term)).withColumn("head", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = stored(marked.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "head"))
    size = kept.count()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count_if(F.col("head") & (F.col("term") != "")).alias("heads"))
    cell = F.sort_array(F.collect_list(F.struct("source", "sum")))
    langs = stored(groups.groupBy("lang").agg(F.sum("heads").alias("v"), cell.alias("c")).select("lang", "v", F.col("c.source").alias("sources"), F.col("c.sum").alias("sums")))
    chunked = kept.filter("term <> ''").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-size // CHUNK)))).alias("chunk"))
    heads = chunked.select("lang", "chunk").distinct().join(langs, "lang").select(F.col("lang").alias("of_lang"), F.col("chunk").alias("of_chunk"), "v", "sources", "sums")
    found = chunked.groupBy("lang", "chunk").cogroup(heads.groupBy("of_lang", "of_chunk")).applyInArrow(_compared(top), "lang string, source string, part string, item string, value long")
    made = stored(found)
    none = langs.filter("v = 0").select("lang", F.explode("sources").alias("source"), "sources")
    none = none.select("lang", "source", F.lit("pair").alias("part"), F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    pairs = made.filter("part = 'pair'").unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = stored(pairs.withColumn("rank", place).unionByName(made.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= top)))
    forget(kept, made)
    return out
