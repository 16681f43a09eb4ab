"""SimHash near-duplicates, found by pigeonring filtering.

Of two fingerprints with at most ``tau`` differing bits, cut into m segments on a
ring, some segment starts a chain whose first l segments differ in at most
l * tau / m bits together, for every l. Candidates are kept only while such a
chain can exist; what is left gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import jaccard
from murmura.llm import kernels as K
from murmura.llm.common import given, mapped, stored
from murmura.llm.components import components

#: Bits of the three segments on the ring.
SEGMENTS = (22, 21, 21)


def fingerprints(docs: DataFrame, words: int = 5, marked: bool = False) -> DataFrame:
    """(doc_id, fingerprint) of every row: 64 majority bits of XXH64 over word shingles; ``marked`` adds mark, a hash of the text.

    Words are runs of non-blanks, lower-cased in A-Z; shingles count with repeats; a
    text of fewer words has its whole sequence as its one shingle. A null, empty or
    blank text has fingerprint zero. Texts are read whole, however long. Columns
    other than doc_id and text are ignored; repeated rows give repeated rows.
    """

    def kernel(rows, buf, off):
        out, start, end, first = K.joined_words(buf, off)
        n = np.diff(first)
        shingles = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
        head = np.repeat(first[:-1], shingles) + K.positions(shingles)
        last = head + np.repeat(np.minimum(n, words), shingles) - 1
        h = K.xxh64(out, start[head], end[last] - start[head]) if len(head) else np.zeros(0, np.uint64)
        ones = K.bit_counts(h, np.concatenate([[0], np.cumsum(shingles)]))
        bits = np.packbits((2 * ones > shingles[:, None]).astype(np.uint8), axis=1, bitorder="little")
        return rows.column(0), pa.array(bits.view("<i8").reshape(-1)), *rows.columns[2:]

    rows = given(docs, "doc_id", "text")
    return mapped(rows.withColumn("mark", jaccard.text_mark(F.col("text"))) if marked else rows, kernel, "doc_id long, fingerprint long" + ", mark long" * marked)


def chain_survivors(prints: DataFrame) -> DataFrame:
    """Of distinct 64-bit ``fp``, those that have a viable chain with another one, for tau = 2.

    On a ring of three segments the budgets are 0, 1 and 2: some segment is equal,
    and the next one then differs in one bit at most. First come the segments that
    two fingerprints share; then a half of the next segment besides, which one bit
    leaves alone; only those are extended, by one-bit variants of the next segment.
    Groups are only counted, never listed in pairs.
    """
    at = (0, SEGMENTS[0], SEGMENTS[0] + SEGMENTS[1])
    cut = [F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1)) for i in range(3)]
    ring = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), cut[i].alias("seg"), cut[(i + 1) % 3].alias("nxt"), F.lit(SEGMENTS[(i + 1) % 3]).alias("width")) for i in range(3))))
    one = prints.select("fp", ring.alias("c")).select("fp", "c.*")
    shared = one.groupBy("i", "seg").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("i", "seg")
    one = one.join(shared.hint("merge"), ["i", "seg"], "left_semi")
    # one bit of difference leaves one half of the next segment as it is: what shares neither half goes before variants are made
    half = F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("nxt").bitwiseAND(F.lit((1 << 11) - 1)).alias("part")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("nxt", 11).alias("part"))))
    halves = one.withColumn("x", half).select("fp", "i", "seg", "nxt", "width", "x.h", "x.part")
    near = halves.groupBy("i", "seg", "h", "part").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("i", "seg", "h", "part")
    one = halves.join(near.hint("merge"), ["i", "seg", "h", "part"], "left_semi").select("fp", "i", "seg", "nxt", "width").distinct()
    flip = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.expr("transform(sequence(0, width - 1), t -> shiftleft(1L, t))")))
    two = one.withColumn("flip", flip).select("fp", "i", "seg", F.col("nxt").bitwiseXOR(F.col("flip")).alias("nxt"), (F.col("flip") == 0).alias("own"))
    viable = two.groupBy("i", "seg", "nxt").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("own").alias("own")).filter("lo <> hi and own").select("i", "seg", "nxt")
    # sizes are estimated without what explode() multiplies, so a merge is asked for: a broadcast would be many times what the optimizer takes it for
    return two.join(viable.hint("merge"), ["i", "seg", "nxt"], "left_semi").select("fp").distinct()


def hamming_links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct ``fp`` that differ in 1 or 2 bits, enough to connect all that do.

    Two fingerprints differ in at most two bits exactly if some word lies within one
    bit of both. Each survivor visits the 65 words within one bit, and links to the
    least visitor of each: as many edges as visits, never all pairs of a group.
    """
    left = stored(chain_survivors(prints))
    words = F.explode(F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), t -> fp ^ shiftleft(1L, t))")))
    visits = left.select("fp", words.alias("word"))
    least = visits.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).filter("v <> hi").select("word", "v")
    return visits.join(least.hint("merge"), "word").filter("fp <> v and bit_count(fp ^ v) <= 2").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fingerprint, component_id): every row, with the least doc_id that links of two bits or fewer reach.

    Equal fingerprints are linked too. Null ids keep their row and are never the
    least; a component of null ids alone has a null id. An empty table gives no rows.
    """
    of = stored(fingerprints(docs, words))
    prints = stored(of.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    found = components(hamming_links(prints.select("fp")))
    rooted = prints.join(found.hint("merge"), prints.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return of.join(named.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def print_links(docs: DataFrame, words: int = 5) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For jaccard.grouped(): the pairs of sets whose texts have fingerprints of two differing bits or fewer.

    Each set goes with the least one of its fingerprint, and the least ones of two
    linked fingerprints go together: as many pairs as links, never all of a group.
    Only texts that share enough shingles with others have their fingerprints linked.
    """

    def known(rows: DataFrame, sets: DataFrame) -> DataFrame:
        of = fingerprints(docs, words, marked=True).select("mark", F.col("fingerprint").alias("fp")).distinct()
        met = of.join(rows.select("mark", "h1", "h2").distinct(), "mark").join(sets.select("h1", "h2", "id"), ["h1", "h2"])
        held = stored(met.select("id", "fp").distinct())
        least = stored(held.groupBy("fp").agg(F.min("id").alias("least")))
        same = held.join(least.hint("merge"), "fp").select(F.col("id").alias("u"), F.col("least").alias("v"))
        ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}")).hint("merge") for x in "uv"]
        near = hamming_links(least.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
        return same.unionByName(near).filter("u <> v").distinct()

    return known


def _similar(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, mark, component_id) of each row: groups of jaccard.py, with the links of fingerprints known to it, and of texts without words the equal ones together."""
    found = jaccard.grouped(docs, words, round(100 * similarity), print_links(docs, words))
    blank = found.filter("n = 0")
    least = blank.groupBy("mark").agg(F.min("doc_id").alias("component_id"))
    return found.filter("n > 0").select("doc_id", "mark", "component_id").unionByName(blank.select("doc_id", "mark").join(least, "mark").select("doc_id", "mark", "component_id"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row: documents linked by a Jaccard similarity of their distinct word shingles, or equal texts.

    Fingerprints come first: texts that two bits or fewer tell apart are linked if
    their sets are similar. Two of 64 bits miss most texts that share 0.8 of their
    shingles, so the set join of jaccard.py finds the rest: exact. component_id is the least doc_id reachable. Texts
    without words are linked to equal ones only; null ids as in near_duplicates(). Rows
    of one doc_id with different texts are documents of their own.
    """
    return _similar(docs, words, similarity).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of similar_groups(), the rows of the least doc_id, with all their columns. A row goes by its id and its own text; rows of a null id stay, an empty table gives an empty one."""
    return jaccard.without_others(docs, _similar(docs, words, similarity))
