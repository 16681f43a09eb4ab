"""Documents that share most of their n-grams, found by an exact prefix-tree join.

1. A block of texts sends each of its distinct shingles once to the shingle's bucket;
   what other documents have too comes back with its document frequency. A document
   needs ``percent`` of its shingles shared to be similar to any, so most drop out
   here, and of the others only shared shingles go on.
2. Shared shingles are put in one order for all documents, rare ones first. Similar
   documents share one of their first few, so documents are grouped by what they
   reach through these; nearly always that is a group of copies and nothing else.
3. Each group's sets go to one task once, into a prefix tree (trie.py) that links what
   is similar. A large group is dealt into blocks of bounded size, each with the
   group's most central set, which links nearly all; documents of different
   components that still share a leading shingle are then joined block against block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm import trie
from murmura.llm.blocks import UNKNOWN, split_by
from murmura.llm.common import by_slices, forget, given, ship, size_hint, stored
from murmura.llm.components import components

#: Bytes of text of a block, and those hashed at a time; stored bytes of documents for each bucket of shingles.
BLOCK, SLICE, BUCKET = 4 << 20, 1 << 20, 4 << 20
#: Bits of a shingle's hash; its document frequency's bit length goes above them, so that rare shingles come first.
BITS = 48
#: Members and sets of one task's prefix tree at most, about; members joined at a time.
MEMBERS, SETS, HELD = 1 << 21, 2048, 1 << 19
U64 = np.uint64
LOW = U64((1 << BITS) - 1)


def planes(a: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that empty planes shrink to nothing in a compressed shuffle."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, as hashes of BITS bits; and the text of each, ascending."""
    out, start, end, first = K.joined_words(buf, off)
    n = np.diff(first)
    many = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    head = np.repeat(first[:-1], many) + K.positions(many)
    last = head + np.repeat(np.minimum(n, words), many) - 1
    h = K.span_hash(K.prefix_hash(out), start[head], end[last]) >> U64(64 - BITS) if len(head) else np.zeros(0, U64)
    of = np.repeat(np.arange(len(n)), many)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


SENT = "bucket int, block long, kind int, a binary, b binary, c binary, d binary"
SENT_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]


def _sent(words: int, buckets: int):
    """A block's rows: for each bucket its shingles there, with the document (from 1) of those that one document of the block has, else 0 and how many have it; and one row that passes through to the block itself."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for rows, buf, off in by_slices(batches, "text", BLOCK):
            parts = [(a, *shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)) for a, b in K.slices(off, SLICE)]
            h, of = np.concatenate([x[1] for x in parts]), np.concatenate([a + x for a, _, x in parts])
            n = np.bincount(of, minlength=len(off) - 1)
            ends = np.cumsum(n)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(h ^ U64(x)))]) for x in (0, K.BASES[1])]
            marks = [x[ends] - x[ends - n] for x in sums]
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(h)))
            key, lone = h[head], np.where(times == 1, of[head] + 1, 0)
            common = np.repeat(times > 1, times)
            ids = rows.column(0)
            base = np.concatenate([n.astype(U64), *marks, ids.fill_null(0).to_numpy().view(U64), ids.is_null().to_numpy(zero_copy_only=False).astype(U64), rows.column(2).to_numpy().view(U64)])
            cells = [(int(block % buckets), block, 0, planes(key[times > 1]), planes(times[times > 1]), planes(of[common]), planes(base))]
            by, at = split_by((key % U64(buckets)).astype(np.int64), buckets)
            key, lone, times = key[by], lone[by], times[by]
            for b in np.flatnonzero(np.diff(at)):
                part = slice(at[b], at[b + 1])
                cells.append((int(b), block, 1, planes(np.diff(key[part], prepend=U64(0))), planes(lone[part]), planes(times[part][lone[part] == 0]), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), SENT_TYPES)], [x.split()[0] for x in SENT.split(", ")])
            block += 1

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """A bucket's answers: to each block the shingles that two documents or more have, as they came, with the bit length of their document frequency."""
    kinds = rows.column("kind").to_numpy()
    asked = rows.filter(pa.array(kinds == 1))
    keys = [np.cumsum(unplanes(x), dtype=U64) for x in asked.column("a").to_pylist()]
    lone = [unplanes(x) for x in asked.column("b").to_pylist()]
    times = [np.ones(len(x), np.int64) for x in lone]
    for t, x, many in zip(times, lone, asked.column("c").to_pylist()):
        t[x == 0] = unplanes(many).view(np.int64)
    out = []
    if keys:
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        total = np.add.reduceat(np.concatenate(times)[order], head)
        found = np.empty(len(every), np.int64)
        found[order] = np.repeat(total, np.diff(np.append(head, len(every))))
        cuts = np.cumsum([len(x) for x in keys])
        for block, key, of, df in zip(asked.column("block").to_pylist(), keys, lone, np.split(found, cuts[:-1])):
            on = df > 1
            if on.any():
                level = np.ceil(np.log2(df[on] + 1)).astype(np.int64)
                out.append((0, block, 1, planes(np.diff(key[on], prepend=U64(0))), planes(of[on]), planes(level), None))
    names = rows.schema.names
    made = pa.table([pa.array(x, t) for x, t in zip(zip(*out), SENT_TYPES)] if out else [pa.array([], t) for t in SENT_TYPES], names)
    return pa.concat_tables([made, rows.filter(pa.array(kinds == 0)).cast(made.schema)])


MADE = "doc_id long, mark long, n long, h1 long, h2 long, members array<long>"


def _gathered(percent: int):
    """A block's documents: id, hash of the text, number of shingles, a hash of the set; and, ascending in the common order, the shared shingles of those that share enough."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_pylist()
        cell = lambda i, c: unplanes(rows.column(c)[i].as_py())
        own = kind.index(0)
        n, h1, h2, ids, none, mark = cell(own, "d").reshape(6, -1)
        n = n.astype(np.int64)
        got = [(np.cumsum(cell(i, "a"), dtype=U64), cell(i, "b").astype(np.int64), cell(i, "c")) for i, k in enumerate(kind) if k == 1]
        key, of, level = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64))
        key = level << U64(BITS) | key
        several = key[of == 0]
        several = several[np.argsort(several & LOW)]
        common, times, docs = cell(own, "a"), cell(own, "b").astype(np.int64), cell(own, "c").astype(np.int64)
        at = np.searchsorted(several & LOW, common)  # all of them were answered: two documents here have them
        key = np.concatenate([key[of > 0], np.repeat(several[at], times) if len(common) else np.zeros(0, U64)])
        of = np.concatenate([of[of > 0] - 1, docs])
        some = (n > 0) & (100 * np.bincount(of, minlength=len(n)) >= percent * n)
        stay = some[of]
        key, of = key[stay].astype(np.int64), of[stay]
        order = np.lexsort((key, of))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int32)), pa.array(key[order]))
        return pa.table([pa.array(ids.view(np.int64), mask=none.astype(bool)), pa.array(mark.view(np.int64)), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], [x.split()[0] for x in MADE.split(", ")])

    return run


def text_mark(text: Column) -> Column:
    """A 64-bit hash of a text; null counts as empty. With the doc_id it tells rows apart that share one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n, h1, h2 (a hash of the set) of each row, and members: the shingles it shares with others, rare ones first; empty where these are too few for any similar row."""
    ship()
    asked = given(docs, "doc_id", "text").withColumn("mark", text_mark(F.col("text")))
    size = size_hint(docs)
    if size > UNKNOWN:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    sent = asked.mapInArrow(_sent(words, max(4, -(-size // BUCKET))), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answered, SENT)
    return answers.groupBy("block").applyInArrow(_gathered(percent), MADE)


LINKED = "id long, root long"


def _joined(percent: int):
    """Rows sorted by (grp, lo, hi): the sets of each of these, linked in a prefix tree; (id, least linked id there) of all that are linked to another."""

    def done(table: pa.Table):
        g = [table.column(c).to_numpy() for c in ("grp", "lo", "hi")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in g])
        group, ids, comp, side = np.cumsum(new) - 1, *(table.column(c).to_numpy() for c in ("id", "comp", "side"))
        members = table.column("members").combine_chunks()
        at, every = members.offsets.to_numpy().astype(np.int64), members.values.to_numpy()
        _, label = np.unique(np.stack([group, comp], 1), axis=0, return_inverse=True)
        label = trie.linked(group, every[at[0] : at[-1]], at - at[0], table.column("n").to_numpy(), label.reshape(-1), side != 2, side != 1, percent)
        order = np.lexsort((ids, label))
        head = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
        root = np.empty(len(ids), np.int64)
        root[order] = np.repeat(ids[order][head], np.diff(np.append(head, len(order))))
        on = np.flatnonzero(root != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(root[on])], ["id", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cols = [held.column(c).to_numpy() for c in ("grp", "lo", "hi")]
            new = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
            cuts = np.flatnonzero(new) + 1
            size = np.concatenate([[0], np.cumsum(pc.list_value_length(held.column("members")).to_numpy())])
            a = 0
            for cut in cuts.tolist():
                if size[cut] - size[a] >= HELD:
                    yield done(held.slice(a, cut - a))
                    a = cut
            held = held.slice(a)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def _linked(parts: DataFrame, percent: int) -> DataFrame:
    rows = parts.select("grp", "lo", "hi", "id", "comp", "side", "n", "members", "weight")
    return rows.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", F.desc("weight"), "id").mapInArrow(_joined(percent), LINKED)


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-blanks, lower-cased in A-Z. A row's set is its distinct
    shingles of ``words`` words, of its whole text; a text of fewer words has its whole
    sequence as one. Rows are linked when 100 times the size of what their sets share
    is at least ``percent`` times the size of both together; component_id is the least
    doc_id that links reach, the row's own included. Exact: no similar pair is missed,
    up to equal 48-bit hashes of shingles.

    Null, empty and blank texts have an empty set and no links, not even to each
    other. Repeated rows are linked to each other; rows of one doc_id with different
    texts are documents of their own. A null doc_id keeps its row and is the least
    only where its component has no other. An empty table gives no rows.
    """
    return grouped(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, words: int, percent: int, known: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """groups() with the columns doc_id, mark, n, component_id.

    known(rows, sets) may give links (u, v) between the ids of ``sets`` (id, h1, h2, n,
    members) that another method has found; rows has the mark, h1 and h2 of each row
    that may have a link. Those that similar() confirms are linked from the start, and
    the trees are left to find the rest.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(stored(df))
        return made[-1]

    base = stored(shared_sets(docs, words, percent))
    some = base.filter(F.size("members") > 0)
    one = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("members").alias("members"))
    sets = kept(one.withColumn("id", F.monotonically_increasing_id()))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    leading = F.slice("members", F.lit(1), (F.size("members") - least + 1).cast("int"))
    keys = sets.select("id", F.explode(leading).alias("key"))
    heads = keys.groupBy("key").agg(F.count("*").alias("times"), F.min("id").alias("head")).filter("times > 1")
    met = kept(keys.join(heads, "key"))
    found = kept(components(met.select(F.col("id").alias("u"), F.col("head").alias("v"))).withColumnRenamed("node", "id").withColumnRenamed("root", "grp"))
    weight = met.groupBy("id").agg(F.sum("times").alias("weight"))
    members = sets.select("id", "n", "members").join(found, "id").join(weight, "id")
    sure = kept(similar(known(some, sets), sets, percent)) if known else None
    if sure is not None:
        members = members.join(components(sure).withColumnRenamed("node", "id").withColumnRenamed("root", "comp"), "id", "left")
    members = kept(members.withColumn("comp", F.coalesce("comp", "id") if known else F.col("id")))
    blocks = lambda rows: rows.groupBy("grp").agg(F.greatest(F.ceil(F.sum(F.size("members")) / MEMBERS), F.ceil(F.count("*") / SETS)).alias("blocks"), F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"))
    sized = kept(blocks(members).select("grp", "blocks", (-F.col("top.id")).alias("top")))
    dealt = members.join(sized, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("lo", F.explode(F.when(F.col("id") == F.col("top"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = kept(_linked(dealt.withColumn("hi", F.col("lo")).withColumn("side", F.lit(0)), percent))
    if sure is not None:
        links = links.unionByName(sure.select(F.col("u").alias("id"), F.col("v").alias("root")))
    large = sized.filter("blocks > 1").select("grp")
    if large.take(1):
        links = links.unionByName(_between(met, members.drop("comp").join(large, "grp", "left_semi"), links, percent, blocks, kept))
    roots = components(links.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    named = sets.join(roots, "id", "left").select("h1", "h2", "least", F.coalesce("root", "id").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("h1", "h2", "component_id", F.lit(True).alias("similar"))
    lone = base.filter(F.size("members") == 0).select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"))
    out = stored(some.select("doc_id", "mark", "n", "h1", "h2").join(of, ["h1", "h2"]).select("doc_id", "mark", "n", "component_id").unionByName(lone))
    forget(base, *made)
    return out


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose sets are similar. What two sets share others have too, so it is among the members of both."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"members_{x}"))
    met = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("both", F.size(F.array_intersect("members_u", "members_v")))
    return met.filter(100 * F.col("both") >= percent * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v")


def _between(met: DataFrame, members: DataFrame, links: DataFrame, percent: int, blocks, kept) -> DataFrame:
    """Links between sets of large groups that no task has seen together: those that share a leading shingle but no component meet block against block."""
    roots = components(links.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id").withColumnRenamed("root", "comp")
    known = kept(members.join(roots, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    of_key = met.select("key", "id").join(known.select("id", "comp"), "id")
    mixed = of_key.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
    open_ids = of_key.join(mixed, "key", "left_semi").select("id").distinct()
    rest = kept(known.join(open_ids, "id", "left_semi"))
    sized = blocks(rest).select("grp", "blocks")
    dealt = rest.join(sized, "grp").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return kept(_linked(sides.withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("mine") == F.col("lo"), 1).otherwise(2)), percent))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component, the rows of its least doc_id, with all their columns. A row goes by its id and its own text, so another text of the same id stays; rows of null ids stay."""
    return without_others(docs, grouped(docs, words, percent))


def without_others(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their component in ``found`` (doc_id, mark, component_id)."""
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (text_mark(docs["text"]) == gone["_mark"]), "left_anti")
