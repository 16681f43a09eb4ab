"""Exact repeated spans by run-length indexes over repetitive segments.

Each window of LENGTH bytes has an anchor: the least hash of its GRAM-byte grams.
Equal windows have equal anchors, so consecutive windows of one anchor form a
segment, and all copies of a segment meet in the bucket of its anchor. Segments
whose anchor lies in one document only repeat nothing. The others of a bucket, each
distinct one once, make run-length indexes. All of them stream through these, and
their matching statistics tell for each window the least document that holds it;
documents mark what lies in an earlier one.

An anchor around which many different texts lie, a notice amid varied prose, would
bring them all to one bucket. Where more than HOT distinct segments have an anchor,
each of their windows is a segment of its own, with its own hash for an anchor: equal
windows still meet, different ones go to buckets of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.blocks import block_count, blocked, bucket_count, packed, packed_hashes, split_by, texts_of, unpacked, unpacked_hashes
from murmura.llm.common import given, mapped, ship
from murmura.llm.run_index import RunIndex

LENGTH, GRAM = 50, 16
#: Windows of a segment at most; longer runs are cut, no window is lost. A segment and its neighbour then fit the index's 192 symbols.
MOST = 46
CACHE = 256 << 10
#: Bytes of distinct segments in an index. Anchors never share windows, so a bucket's are spread over many small ones that fit a cache.
INDEX_BYTES = 128 << 10
PARTS = 256
#: Distinct segments of an anchor, as estimated, beyond which its windows go apart.
HOT = 2048
U64 = np.uint64


def _anchors(buf: np.ndarray) -> np.ndarray:
    """The least gram hash of each window."""
    pre, n = K.prefix_hash(buf), len(buf)
    inverse = K.powers(pow(K.BASES[0], -1, 1 << 64), n + 1)
    least = K.mix((pre[GRAM:] - pre[:-GRAM]) * inverse[: n - GRAM + 1])
    span, grams = 1, LENGTH - GRAM + 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (grams - span)], least[grams - span :]) if grams > span else least


def segments(buf: np.ndarray, off: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, start, windows and text of every segment; texts to skip have none."""
    found = [(np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))]
    for a, b in K.slices(off, CACHE):
        here, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        count = np.where(skip[a:b], 0, np.maximum(np.diff(at) - LENGTH + 1, 0))
        if not count.any():
            continue
        anchor = _anchors(here)
        ok = np.zeros(len(anchor) + 1, bool)
        ok[np.repeat(at[:-1], count) + K.positions(count)] = True
        ok = ok[:-1]
        edge = at[1:-1][at[1:-1] < len(ok)]
        turn = np.ones(len(ok), bool)
        turn[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        turn[edge] = True
        head = np.flatnonzero(turn)
        run = np.diff(np.append(head, len(ok)))
        head, run = head[ok[head]], run[ok[head]]
        pieces = -(-run // MOST)
        step = K.positions(pieces) * MOST
        start = np.repeat(head, pieces) + step
        found.append((anchor[start], start + off[a], np.minimum(np.repeat(run, pieces) - step, MOST), np.searchsorted(at, start, "right") - 1 + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def apart(buf: np.ndarray, found: tuple, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, those of hot anchors (sorted) as one for each window, with the window's hash for an anchor."""
    anchor, start, windows, text = found
    on = K.member(anchor, hot)
    if not on.any():
        return found
    n = windows[on]
    each = np.repeat(start[on], n) + K.positions(n)
    own = K.span_hash(K.prefix_hash(buf, 1), each, each + LENGTH, 1)
    return np.concatenate([anchor[~on], own]), np.concatenate([start[~on], each]), np.concatenate([windows[~on], np.ones(len(each), np.int64)]), np.concatenate([text[~on], np.repeat(text[on], n)])


def _bucketed(anchor: np.ndarray, buckets: int):
    """Distinct anchors, sorted, an order by bucket, and the buckets' bounds in it."""
    values = np.sort(anchor)
    values = values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
    order, bound = split_by((values % U64(buckets)).astype(np.int64), buckets)
    return values, order, bound


def _bits(x: np.ndarray) -> bytes:
    return packed(np.packbits(x))


def _send_anchors(table: pa.Table, buckets: int) -> pa.Table:
    """To each bucket its anchors of the block; which lie in several documents here; the bit length of the number of their distinct segments; a byte of the first segment's hash."""
    buf, off, ids, null = texts_of(table)
    anchor, start, windows, text = segments(buf, off, null)
    values, order, bound = _bucketed(anchor, buckets)
    whole = K.span_hash(K.prefix_hash(buf, 1), start, start + windows + LENGTH - 1, 1)
    by = np.argsort(anchor, kind="stable")
    head = np.searchsorted(anchor[by], values)
    times = np.diff(np.append(head, len(by)))
    doc = ids[text[by]]
    many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head) if len(doc) else np.zeros(0, bool)
    distinct = np.ones(len(values), np.int64)
    several = np.flatnonzero(times > 1)
    if len(several):
        each = np.repeat(several, times[several])
        pair = np.unique(K.mix(whole[by[np.repeat(times > 1, times)]] + each.astype(U64) * U64(K.BASES[1])) >> U64(32) | each.astype(U64) << U64(32))
        distinct[several] = np.bincount((pair >> U64(32)).astype(np.int64), minlength=len(values))[several]
    amount = (np.floor(np.log2(np.maximum(distinct, 1))) + 1).astype(np.uint8)
    look = (whole[by[head]] >> U64(56)).astype(np.uint8) if len(by) else np.zeros(0, np.uint8)
    used = np.flatnonzero(np.diff(bound))
    pick = [order[bound[b] : bound[b + 1]] for b in used]
    columns = {
        "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
        "bucket": pa.array(used.astype(np.int32)),
        "anchors": pa.array([packed_hashes(values[p], int(b), buckets) for b, p in zip(used, pick)], pa.binary()),
        "many": pa.array([_bits(many[p]) for p in pick], pa.binary()),
        "amounts": pa.array([packed(amount[p]) for p in pick], pa.binary()),
        "looks": pa.array([packed(look[p]) for p in pick], pa.binary()),
    }
    return pa.table(columns)


def _hot(values: np.ndarray, amounts: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """Anchors, sorted, of which more than HOT distinct segments are to be expected.

    Blocks with one segment of an anchor may all have the same one, so of these the
    different bytes count: a few dozen blocks' worth stands for as many, nearly all
    256 for as many as there are blocks.
    """
    one = amounts == 1
    key = np.sort(values[one] >> U64(8) << U64(8) | looks[one].astype(U64))  # a bucket's anchors differ above the last byte, or count together
    several, times = np.unique(key >> U64(8), return_counts=True)
    seen = np.unique(np.unique(key) >> U64(8), return_counts=True)[1]
    more, at = np.unique(values[~one] >> U64(8), return_inverse=True)
    sums = np.bincount(at, 2.0 ** (amounts[~one].astype(np.float64) - 1), minlength=len(more))
    keys, total = K.merge_counts([several, more], [np.where(seen >= 240, times, seen).astype(np.float64), sums])
    return np.unique(values[K.member(values >> U64(8) << U64(8), keys[total > HOT] << U64(8))])


def _find_repeated(table: pa.Table, buckets: int) -> pa.Table:
    each = [unpacked_hashes(x, b, buckets) for x, b in zip(table.column("anchors").to_pylist(), table.column("bucket").to_pylist())]
    many = [np.unpackbits(m, count=len(a)).astype(bool) for a, m in zip(each, unpacked(table, "many", "u1"))]
    values, amounts = np.concatenate(each), np.concatenate(unpacked(table, "amounts", "u1"))
    found = np.union1d(K.repeated(values), values[np.concatenate(many)])
    # only these can be hot: anchors of many blocks, and those with many segments in some
    often, half = np.sort(values), max(1, HOT // 2)
    often = often[half:][often[half:] == often[:-half]]
    several = amounts > 1
    more, total = K.merge_counts([values[several]], [2.0 ** (amounts[several].astype(np.float64) - 1)])
    maybe = K.member(values, np.union1d(often, more[total > HOT / 2])) if len(often) or (total > HOT / 2).any() else np.zeros(len(values), bool)
    hot = _hot(values[maybe], amounts[maybe], np.concatenate(unpacked(table, "looks", "u1"))[maybe])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "repeated": pa.array([_bits(K.member(a, found)) for a in each], pa.binary()), "hot": pa.array([_bits(K.member(a, hot)) if len(hot) else b"" for a in each], pa.binary())})


_SEGMENTS = "block int, bucket int, data binary, sizes binary, parts binary, docs binary, hot binary"


def _send_segments(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """To each bucket the distinct segments of the block whose anchor is repeated, with the least document of each here; to the first one, for its reply, the block's hot anchors."""
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]
    empty = pa.table({n: pa.array([], pa.int32() if n in ("block", "bucket") else pa.binary()) for n in names})
    if not table.num_rows or not replies.num_rows:
        return empty
    buf, off, ids, null = texts_of(table)
    found = segments(buf, off, null)
    values, order, bound = _bucketed(found[0], buckets)
    on, wide = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for b, bits, far in zip(replies.column("bucket").to_pylist(), unpacked(replies, "repeated", "u1"), unpacked(replies, "hot", "u1")):
        own = order[bound[b] : bound[b + 1]]
        on[own] = np.unpackbits(bits, count=len(own)).astype(bool)
        if len(far):
            wide[own] = np.unpackbits(far, count=len(own)).astype(bool)
    pick = np.flatnonzero(K.member(found[0], values[on]))
    if not len(pick):
        return empty
    hot = values[on & wide]
    anchor, start, windows, text = apart(buf, tuple(x[pick] for x in found), hot)
    size, doc = windows + LENGTH - 1, ids[text]
    h = K.span_hash(K.prefix_hash(buf, 1), start, start + size, 1)
    by = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    least, one = np.minimum.reduceat(doc[by], head), by[head]
    order, bound = split_by((anchor[one] % U64(buckets)).astype(np.int64), buckets)
    one, least = one[order], least[order]
    used = np.flatnonzero(np.diff(bound))
    rows = [slice(bound[b], bound[b + 1]) for b in used]
    part = ((anchor[one] >> U64(40)) % U64(PARTS)).astype(np.uint8)
    columns = [
        pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
        pa.array(used.astype(np.int32)),
        pa.array([pa.compress(packed(buf[np.repeat(start[one[r]], size[one[r]]) + K.positions(size[one[r]])]), "zstd", asbytes=True) for r in rows], pa.binary()),
        pa.array([packed(size[one[r]].astype(np.uint8)) for r in rows], pa.binary()),
        pa.array([packed(part[r]) for r in rows], pa.binary()),
        pa.array([packed(least[r].astype(np.int64)) for r in rows], pa.binary()),
        pa.array([packed(hot)] + [b""] * (len(used) - 1), pa.binary()),
    ]
    return pa.table(columns, names)


def _index_bucket(table: pa.Table) -> pa.Table:
    docs, sizes = unpacked(table, "docs", "<i8"), [x.astype(np.int64) for x in unpacked(table, "sizes", "u1")]
    data = np.concatenate([np.frombuffer(pa.decompress(x, int(n.sum()), "zstd", asbytes=True), np.uint8) for x, n in zip(table.column("data").to_pylist(), sizes)])
    size = np.concatenate(sizes)
    start = np.cumsum(size) - size
    every = K.span_hash(K.prefix_hash(data, 1), start, start + size, 1)
    hashes = np.split(every, np.cumsum([len(n) for n in sizes])[:-1])
    by = np.argsort(every, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], every[by][1:] != every[by][:-1]]))
    least, one = np.minimum.reduceat(np.concatenate(docs)[by], head), by[head]
    part = np.concatenate(unpacked(table, "parts", "u1"))[one]
    group = np.concatenate([[0], np.cumsum(np.bincount(part, size[one], PARTS))]).astype(np.int64)[:-1] // INDEX_BYTES
    windows = size[one] - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    window = np.empty(int(first[-1]), np.int64)
    for g in np.unique(group[part]):
        own = np.flatnonzero(group[part] == g)
        pick = one[own]
        texts = data[np.repeat(start[pick], size[pick]) + K.positions(size[pick])]
        window[np.repeat(first[own], windows[own]) + K.positions(windows[own])] = RunIndex(texts, size[pick], least[own], LENGTH).least(texts, size[pick])
    turn = np.ones(len(window), bool)
    turn[1:] = window[1:] != window[:-1]
    turn[first[:-1]] = True
    run = np.flatnonzero(turn)
    run_first = np.searchsorted(run, first)
    run_size = np.diff(np.append(run, len(window)))
    distinct = every[one]
    out = {"runs": [], "lengths": [], "leasts": []}
    for h in hashes:
        own = np.searchsorted(distinct, h)
        n = run_first[own + 1] - run_first[own]
        pick = np.repeat(run_first[own], n) + K.positions(n)
        out["runs"].append(packed(n.astype(np.uint8)))
        out["lengths"].append(packed(run_size[pick].astype(np.uint8)))
        out["leasts"].append(packed(window[run[pick]]))
    return pa.table({"block": table.column("block"), "hashes": pa.array([packed(h) for h in hashes], pa.binary()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}, "hot": table.column("hot")})


def _unmarked(ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> pa.Table:
    return _result(ids, buf, off, np.zeros(len(buf), bool))


def _mark(table: pa.Table, replies: pa.Table) -> pa.Table:
    buf, off, ids, null = texts_of(table)
    removed = np.zeros(len(buf), bool)
    if replies.num_rows:
        h = np.concatenate(unpacked(replies, "hashes", "<u8"))
        runs = np.concatenate(unpacked(replies, "runs", "u1")).astype(np.int64)
        length, least = np.concatenate(unpacked(replies, "lengths", "u1")).astype(np.int64), np.concatenate(unpacked(replies, "leasts", "<i8"))
        by = np.argsort(h, kind="stable")
        at = (np.cumsum(runs) - runs)[by]
        known, runs = h[by], runs[by]
        _, start, windows, text = apart(buf, segments(buf, off, null), np.unique(np.concatenate(unpacked(replies, "hot", "<u8"))))
        own = K.span_hash(K.prefix_hash(buf, 1), start, start + windows + LENGTH - 1, 1)
        hit = np.flatnonzero(K.member(own, known))
        place = np.searchsorted(known, own[hit])
        n = runs[place]
        each = np.repeat(at[place], n) + K.positions(n)
        size = length[each]
        inside = np.cumsum(size) - size
        begin = np.repeat(start[hit] - (np.concatenate([[0], np.cumsum(size)])[np.cumsum(n) - n]), n) + inside
        earlier = least[each] < np.repeat(ids[text[hit]], n)
        edge = np.bincount(begin[earlier], minlength=len(buf) + 1)[: len(buf) + 1] - np.bincount((begin + size + LENGTH - 1)[earlier], minlength=len(buf) + 1)[: len(buf) + 1]
        removed = np.cumsum(edge)[: len(buf)] > 0
    return _result(table.column("doc_id"), buf, off, removed)


def _result(ids: pa.Array, buf: np.ndarray, off: np.ndarray, removed: np.ndarray) -> pa.Table:
    s, e, first = K.runs(removed, off)
    left = buf[~removed].tobytes()
    cut = np.concatenate([[0], np.cumsum(~removed)])[off]
    kept = [left[cut[i] : cut[i + 1]] for i in range(len(off) - 1)]
    base = off[np.searchsorted(off, s, "right") - 1]
    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["start", "end"]))
    columns = [ids, pa.array(np.diff(off)), pa.array(K.segment_sum(removed, off)), lists, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())]
    return pa.table(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept_sha256 of each row of ``docs`` (doc_id, text; other columns are ignored).

    A byte is removed if it lies in a string of LENGTH bytes that also starts in a
    row with a smaller doc_id; spans are the maximal removed runs, in bytes of the
    whole text; with_kept adds the remaining bytes. Null texts are empty. Rows of
    equal id don't remove each other; a null id neither removes nor loses anything;
    an empty table gives no rows.
    """
    ship()
    docs = given(docs, "doc_id", "text")
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * with_kept
    columns = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept
    # rows that can hold no repeat, such as a great many equal ones without id or text, need no block
    can = F.coalesce(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH), F.lit(False))
    plain = mapped(docs.filter(~can), lambda rows, buf, off: [_unmarked(rows.column(0), buf, off).column(n).combine_chunks() for n in names], columns)
    docs = docs.filter(can)
    blocks = block_count(docs)
    buckets = bucket_count(blocks)
    texts = blocked(docs, blocks)
    sent = texts.groupBy("block").applyInArrow(lambda t: _send_anchors(t, buckets), "block int, bucket int, anchors binary, many binary, amounts binary, looks binary")
    repeated = sent.groupBy("bucket").applyInArrow(lambda t: _find_repeated(t, buckets), "block int, bucket int, repeated binary, hot binary")
    again = texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda t, r: _send_segments(t, r, buckets), _SEGMENTS)
    found = again.groupBy("bucket").applyInArrow(_index_bucket, "block int, hashes binary, runs binary, lengths binary, leasts binary, hot binary")
    marked = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda t, r: _mark(t, r).select(names), columns)
    return marked.unionByName(plain)
