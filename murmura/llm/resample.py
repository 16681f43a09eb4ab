"""Importance resampling towards a target distribution, over hashed n-gram features.

Each block of texts writes its inverted postings: for each bucket the documents that
hold features in it, and how many. Postings of both corpora are shuffled by bucket,
so a bucket's counts in the corpus and in the target meet, and its gain is worked out
there. The gain then runs over the bucket's postings, which emit what they add to each
document, and these contributions are summed by document.

Buckets are dealt out in GROUPS ranges, each range of each block apart. So a bucket
that a third of all features fall into is spread over as many tasks as there are
blocks, and a task never holds more than one block's share of a few buckets at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import by_slices, forget, given, ship, stored
from murmura.llm.decontaminate import WORD

#: Bytes of text whose postings make one block, and ranges of buckets.
BLOCK, GROUPS = 4 << 20, 16
#: Words up to so many bytes have their checksums taken together, a byte a step; longer ones one by one.
SHORT = 64
U32 = np.uint32


def _byte_table() -> np.ndarray:
    """CRC-32 of each byte value: eight steps of the reflected polynomial."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = (t >> U32(1)) ^ np.where(t & U32(1), U32(0xEDB88320), U32(0))
    return t


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, if b, becomes when n zero bytes follow, for n up to SHORT + 1."""
    out = np.zeros((SHORT + 2, 4, 256), U32)
    out[0] = np.arange(256, dtype=U32)[None, :] << (U32(8) * np.arange(4, dtype=U32)[:, None])
    for n in range(1, SHORT + 2):
        out[n] = _BYTE[out[n - 1] & U32(255)] ^ (out[n - 1] >> U32(8))
    return out


_SHIFT = _shift_tables().reshape(-1)


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum as ``n`` following bytes leave it, before their own checksum is added: CRC-32 is linear."""
    crc, n = crc.copy(), n.astype(np.int64)
    while len(far := np.flatnonzero(n > SHORT + 1)):
        crc[far] = _shifted(crc[far], np.full(len(far), SHORT))
        n = n.copy()
        n[far] -= SHORT
    at = n * 1024
    out = _SHIFT[at + (crc & U32(255))]
    for k in (1, 2, 3):
        out ^= _SHIFT[at + 256 * k + ((crc >> U32(8 * k)) & U32(255))]
    return out


def _checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each buf[start:end]."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, U32)
    on = np.flatnonzero(size <= SHORT)
    t = 0
    while len(on := on[size[on] > t]):
        out[on] = _BYTE[(out[on] ^ buf[start[on] + t]) & U32(255)] ^ (out[on] >> U32(8))
        t += 1
    out ^= U32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    return out


def features(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``order`` words of each text, the text of each, and words in each text."""
    start, end, first = K.runs(WORD[buf], off)
    low = K.LOWER[buf]
    size, n = end - start, np.diff(first)
    word = _checksums(low, start, end)
    spaced = _shifted(np.full(len(word), zlib.crc32(b" "), U32), size) ^ word
    text = np.repeat(np.arange(len(n)), n)
    sums, texts, now = [word], [text], word
    for k in range(1, order):
        now = _shifted(now[: max(len(word) - k, 0)], size[k:] + 1) ^ spaced[k:]
        inside = np.flatnonzero(text[k:] == text[: len(now)])
        sums.append(now[inside])
        texts.append(text[inside])
    return np.concatenate(sums), np.concatenate(texts), n


def _bytes_of(values: np.ndarray) -> tuple[bytes, bytes]:
    """Small numbers a byte each; those of 255 and more go beside."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype("<i8").tobytes()


def _numbers_of(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


TILE = "grp int, block long, size long, steps binary, wide_steps binary, counts binary, wide_counts binary, ids array<long>, words array<long>"
TILE_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]


def _postings(buf: np.ndarray, off: np.ndarray, order: int, buckets: int) -> tuple[list[tuple], np.ndarray]:
    """A block's postings by range of buckets: (range, documents, packed steps and counts), and words in each text."""
    sums, texts, n = features(buf, off, order)
    docs, width = len(n), -(-buckets // GROUPS)
    kind = U32 if buckets * docs < 1 << 32 else np.uint64
    keys = np.sort((sums % U32(buckets)).astype(kind) * kind(docs) + texts.astype(kind))
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(keys)))
    keys = keys[head].astype(np.int64)
    cuts = np.searchsorted(keys, np.arange(GROUPS + 1) * width * docs)
    out = []
    for g in range(GROUPS):
        at = slice(cuts[g], cuts[g + 1])
        if cuts[g] < cuts[g + 1]:
            out.append((g, docs, *_bytes_of(np.diff(keys[at], prepend=g * width * docs)), *_bytes_of(count[at])))
    return out, n


def _tiles(corpus: DataFrame, order: int, buckets: int) -> DataFrame:
    """Rows of range ``grp`` (buckets of one block) and, with grp -1, the ids and word counts of a block."""
    ship()

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for rows, buf, off in by_slices(batches, "text", BLOCK):
            found, n = _postings(buf, off, order, buckets)
            cells = [(g, block, *rest, None, None) for g, *rest in found] + [(-1, block, len(n), b"", b"", b"", b"", rows.column(0).to_pylist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), TILE_TYPES)], [x.split()[0] for x in TILE.split(", ")])
            block += 1

    return corpus.select("doc_id", "text").mapInArrow(run, TILE)


def _bucket_sums(tiles: DataFrame, width: int) -> DataFrame:
    """(target, bucket, n): features in each bucket, added up in each task first."""

    def run(batches):
        sums: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            for target, g, size, steps, wide, counts, more in zip(*(c.to_pylist() for c in batch.columns)):
                bucket = np.cumsum(_numbers_of(steps, wide)) // size
                got = sums.setdefault((target, g), np.zeros(width, np.int64))
                np.add.at(got, bucket, _numbers_of(counts, more))
        for (target, g), n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), target)), pa.array(at + g * width), pa.array(n[at])], ["target", "bucket", "n"])

    rows = tiles.filter("grp >= 0").select("target", "grp", "size", "steps", "wide_steps", "counts", "wide_counts")
    return rows.mapInArrow(run, "target boolean, bucket long, n long").groupBy("bucket", "target").agg(F.sum("n").alias("n"))


def _contributions(tiles: DataFrame) -> DataFrame:
    """(block, i, weight): what a range of buckets adds to each document."""

    def run(batches):
        for batch in batches:
            for block, size, steps, wide, counts, more, places, gains in zip(*(c.to_pylist() if pa.types.is_binary(c.type) or pa.types.is_integer(c.type) else [x.values for x in c] for c in batch.columns)):
                key = np.cumsum(_numbers_of(steps, wide))
                gain = np.zeros(int(key[-1]) // size + 1, np.int64)
                places, gains = places.to_numpy(), gains.to_numpy()
                gain[places[places < len(gain)]] = gains[places < len(gain)]
                weight = np.zeros(size, np.int64)
                np.add.at(weight, key % size, gain[key // size] * _numbers_of(counts, more))
                at = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), pa.array(weight[at])], ["block", "i", "weight"])

    rows = tiles.select("block", "size", "steps", "wide_steps", "counts", "wide_counts", "places", "gains")
    return rows.mapInArrow(run, "block long, i long, weight long")


def gains(tiles: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s, t, gain) of each bucket that occurs in either corpus."""
    both = stored(_bucket_sums(tiles, -(-buckets // GROUPS)))
    total = both.groupBy("target").agg(F.sum("n").alias("n")).collect()  # two rows
    s_all, t_all = (next((r.n for r in total if r.target == side), 0) for side in (False, True))
    side = lambda x: F.coalesce(F.sum(F.when(F.col("target") == x, F.col("n"))), F.lit(0)).cast("long")
    met = both.groupBy("bucket").agg(side(False).alias("s"), side(True).alias("t"))
    real = lambda c: c.cast("double")
    share = (real(F.col("t") + 1) * real(F.lit(s_all + buckets))) / (real(F.col("s") + 1) * real(F.lit(t_all + buckets)))
    return met.select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def ranked(rows: DataFrame, order: list[F.Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (1, 2, 3...) in one order over all of them: range-partitioned, numbered within each range, the sizes of the ranges before it added."""
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def importance(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, order: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in
    A-Z; features are all runs of 1 to ``order`` of them, hashed into ``buckets`` by
    CRC-32. A bucket's gain is the floor of 1000 times the natural logarithm of its
    add-one share in the target over that in ``docs``; weight sums the gains over a
    row's features. score adds Gumbel noise that only the id and ``seed`` decide, so
    the ``percent`` highest scores among rows of ``least_words`` words or more are a
    draw without replacement in proportion to the weights. rank is null for others;
    equal scores go by doc_id, then by n_features, null ids last.

    Null, empty and wordless texts have no features and weight 0. Repeated rows count
    repeatedly and are drawn one by one; a null id counts as the empty text in its
    noise. An empty target leaves every t at 0; an empty table gives no rows. Columns
    other than these are ignored. ``docs`` must give the same rows when read again.
    """
    asked = given(docs, "doc_id", "text")
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    every = _tiles(asked, order, buckets).withColumn("target", F.lit(False)).unionByName(_tiles(aimed, order, buckets).withColumn("target", F.lit(True)))
    tiles = stored(every.repartition("grp", "block"))
    width = -(-buckets // GROUPS)
    found = gains(tiles, buckets).withColumn("grp", F.floor(F.col("bucket") / width).cast("int"))
    cell = F.sort_array(F.collect_list(F.struct((F.col("bucket") - F.col("grp") * width).alias("place"), "gain")))
    by_range = found.groupBy("grp").agg(cell.alias("c")).select("grp", F.col("c.place").alias("places"), F.col("c.gain").alias("gains"))  # `buckets` gains in all
    of_docs = tiles.filter("not target")
    parts = _contributions(of_docs.filter("grp >= 0").join(F.broadcast(by_range), "grp"))
    rows = of_docs.filter("grp < 0").select("block", F.posexplode(F.arrays_zip("ids", "words")).alias("i", "x")).select("block", F.col("i").cast("long").alias("i"), F.lit(0).cast("long").alias("weight"), F.col("x.ids").alias("doc_id"), F.col("x.words").alias("n_words"))
    met = rows.unionByName(parts, allowMissingColumns=True).groupBy("block", "i").agg(F.sum("weight").alias("weight"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    n_features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, order)), F.col("n_words"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(met.select("doc_id", "n_words", n_features.cast("long").alias("n_features"), "weight", (F.col("weight") + noise).alias("score")))
    long = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * long.count() // 100
    places = ranked(long, [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")])
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    forget(tiles)
    return places.unionByName(out)


def drawn(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that importance() draws, with all their columns; rows of one doc_id come together, null ids never."""
    ids = importance(docs, target, **options).filter("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
