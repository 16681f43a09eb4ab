"""Blocks of whole texts and buckets of hashes, exchanged as packed arrays.

A block is a few MB of whole texts; it sends each bucket one row that holds all its
hashes there, and gets one row back. So a shuffle carries a few bytes a hash, and
hot hashes come once a block, however often they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import size_hint

#: Stored bytes of a block of texts, at least and at most, and blocks for each bucket.
LEAST_BLOCK, MOST_BLOCK, BLOCKS_A_BUCKET = 1 << 20, 16 << 20, 2
#: An estimate beyond this is none: the optimizer does not know the size, and it is measured.
UNKNOWN = 1 << 52


def block_count(docs: DataFrame) -> int:
    """Blocks for a stored table. They grow with the root of its size, so that a block still has a few dozen hashes for each bucket."""
    size = size_hint(docs)
    if size > UNKNOWN:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(4, size // max(LEAST_BLOCK, min(MOST_BLOCK, int((512 * size) ** 0.5))))


def bucket_count(blocks: int) -> int:
    return max(4, blocks // BLOCKS_A_BUCKET)


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text and the block of each row, which depends on nothing but these two."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpacked(table: pa.Table, name: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def packed_hashes(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
    """Sorted hashes that are all ``bucket`` modulo ``buckets``: their steps in units of ``buckets``, byte plane by byte plane, so that the empty high planes shrink to nothing in a compressed shuffle."""
    steps = np.diff(keys, prepend=np.uint64(bucket)) // np.uint64(buckets)
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_hashes(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def split_by(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part number, and where each part begins in it."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buf, off, ids and which ids are null, of a block."""
    buf, off = K.layout(table.column("text"))
    ids = table.column("doc_id")
    return buf, off, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()
