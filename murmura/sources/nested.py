"""Records of whole JSON documents, read by as many tasks as the document has byte ranges.

A document that is one list, or holds one, has no line to cut it at. Spark's text source
cuts it at closing braces instead, and every byte range of it is a task's. What a range
starts in, inside a string or not and how deep, follows from the ranges before it:

1. Each range counts quotes, and how much deeper it leads if it starts outside a string
   and if it starts inside one: a row a range. Running sums over these rows give every
   range its true start.
2. Knowing that, each range reports which lists it opens and closes, and whether a
   record is left open at its end; so it is known which list each range starts in.
3. Each range cuts out its records. Of a record that lies across ranges each passes on
   its part, and the parts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which a document may hold its list, the one that counts first.
LISTS = ("records", "results", "data")
QUOTE, ESCAPE = 0x22, 0x5C
STEP = np.zeros(256, np.int64)
STEP[[0x7B, 0x5B]], STEP[[0x7D, 0x5D]] = 1, -1


def _quotes(buf: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: those after an even run of backslashes."""
    place = np.arange(len(buf))
    plain = np.maximum.accumulate(np.where(buf != ESCAPE, place, -1)) if len(buf) else place
    run = np.zeros(len(buf), np.int64)
    run[1:] = place[:-1] - plain[:-1]
    return (buf == QUOTE) & (run % 2 == 0)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Rows of one byte range after the other, as its other columns and its bytes; a range of many batches comes in parts."""
    for batch in batches:
        rest = batch.select([n for n in batch.schema.names if n != "value"]).to_pylist()
        values, a = batch.column(batch.schema.names.index("value")).cast(pa.binary()).to_pylist(), 0
        for b in range(1, len(rest) + 1):
            if b == len(rest) or (rest[b]["file"], rest[b]["start"]) != (rest[a]["file"], rest[a]["start"]):
                yield rest[a], b"}".join(values[a:b]) + b"}"
                a = b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, quotes, and the depth gained by a range that starts outside (0) or inside (1) a string."""
    sums: dict[tuple[str, int], list[int]] = {}
    for at, data in _ranges(batches):
        buf = np.frombuffer(data, np.uint8)
        quote = _quotes(buf)
        inside = np.cumsum(quote) % 2 == 1
        total = sums.setdefault((at["file"], at["start"]), [0, 0, 0])
        odd, steps = total[0] % 2, STEP[buf]
        gained = int(steps[~inside].sum()), int(steps[inside].sum())
        total[0] += int(quote.sum())
        total[1] += gained[odd]
        total[2] += gained[1 - odd]
    if sums:
        yield pa.RecordBatch.from_pydict({"file": [k[0] for k in sums], "start": [k[1] for k in sums], **{n: [v[i] for v in sums.values()] for i, n in enumerate(("quotes", "d0", "d1"))}})


class _Reader:
    """Follows one range: how deep each byte lies, from its known start."""

    def __init__(self, at: dict):
        self.inside, self.depth = at["inside"], at["depth"]

    def take(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Depth after each byte, and the step that each byte makes (0 inside strings)."""
        buf = np.frombuffer(data, np.uint8)
        quote = _quotes(buf)
        inside = (np.cumsum(quote) + self.inside) % 2 == 1
        step = np.where(inside, 0, STEP[buf])
        depth = self.depth + np.cumsum(step)
        self.inside, self.depth = int(inside[-1]), int(depth[-1])
        return depth, step


def _key_before(data: bytes, at: int) -> str | None:
    """The name whose value begins at a byte, if one stands before it."""
    head = data[:at].rstrip()
    if not head.endswith(b":") or not (head := head[:-1].rstrip()).endswith(b'"'):
        return None
    begin = head.rfind(b'"', 0, len(head) - 1)
    return head[begin + 1 : -1].decode("utf-8", "replace") if begin >= 0 else None


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, seq, name, deep: each list that opens where records may be, '' for the document itself, and with a null name each that ends; deep is the depth of its records."""
    out, reader, now, seq = [], None, None, 0
    for at, data in _ranges(batches):
        if (at["file"], at["start"]) != now:
            reader, now, seq = _Reader(at), (at["file"], at["start"]), 0
        depth, step = reader.take(data)
        buf = np.frombuffer(data, np.uint8)
        opens = np.flatnonzero((buf == 0x5B) & (step == 1) & (depth <= 2))
        ends = np.flatnonzero((buf == 0x5D) & (step == -1) & (depth <= 1))
        for i in np.sort(np.concatenate([opens, ends])).tolist():
            deep = int(depth[i]) + (buf[i] == 0x5D)
            name = ("" if deep == 1 else _key_before(data, i)) if buf[i] == 0x5B else None
            if buf[i] == 0x5D or name == "" or name in LISTS:
                out.append((*now, seq, name, int(deep)))
                seq += 1
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["file", "start", "seq", "name", "deep"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, part, value: whole records (part null), and parts of a record that begins in the range (1), ends in it (-1) or does neither (0)."""
    out, now, size = [], None, 0
    reader, deep, active, open_, mine, held = None, 0, False, False, False, b""

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "start", "part", "value"])

    for at, data in _ranges(batches):
        if (at["file"], at["start"]) != now:
            if open_:
                out.append((*now, 1 if mine else 0, held.decode("utf-8", "replace")))
            reader, now, deep = _Reader(at), (at["file"], at["start"]), at["deep"]
            active, mine, held = at["active"], False, b""
            open_ = active and reader.depth > deep
        depth, step = reader.take(data)
        buf, begin = np.frombuffer(data, np.uint8), 0
        record = ((buf == 0x7B) & (step == 1) & (depth == deep + 1)) | ((buf == 0x7D) & (step == -1) & (depth == deep))
        lists = ((buf == 0x5B) & (step == 1) & (depth == deep)) | ((buf == 0x5D) & (step == -1) & (depth == deep - 1))
        for i in np.flatnonzero(record | lists if deep else record).tolist():
            if buf[i] == 0x5B:
                active = deep == 1 or _key_before(data, i) == at["name"]
            elif buf[i] == 0x5D:
                active = False
            elif buf[i] == 0x7B and active and not open_:
                open_, mine, begin = True, True, i
            elif buf[i] == 0x7D and open_:
                out.append((*now, None if mine else -1, (held + data[begin : i + 1]).decode("utf-8", "replace")))
                open_, held, size = False, b"", size + i + 1 - begin
        if open_:
            held += data[begin:]
        if size > 8 << 20:
            yield rows()
            out, size = [], 0
    if open_:
        out.append((*now, 1 if mine else 0, held.decode("utf-8", "replace")))
    if out:
        yield rows()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the text of all files under a path, cut after closing braces; start is where the byte range of a piece begins."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def is_document() -> Column:
    """Whether a file (file, value: its first piece) is one document and not lines of records: by its name, else by how it begins."""
    head = F.ltrim(F.substring("value", 1, 1 << 16))
    listed = "|".join(LISTS)
    return F.when(F.col("file").rlike(r"\.jsonl(\.\w+)?$"), False).when(F.col("file").rlike(r"\.json(\.\w+)?$"), True).otherwise(head.startswith("[") | head.rlike(rf'^\{{\s*"({listed})"\s*:\s*\[') | head.rlike(r"\S[ \t]*\n"))


def documents(parts: DataFrame) -> DataFrame:
    """(value): the text of each record of the documents whose pieces() are given.

    A document's records are its elements if it is a list, else those of the first of
    LISTS that it holds as a list, else it is a record itself. Elements that are no
    objects are left out. What a byte range starts in is a row of about a hundred bytes
    for each range of 128 MB; these rows are sent to all tasks.
    """
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.mapInArrow(_counted, "file string, start long, quotes long, d0 long, d1 long")
    starts = counted.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    gained = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    starts = starts.withColumn("gained", gained).select("file", "start", "inside", F.coalesce(F.sum("gained").over(before), F.lit(0)).cast("int").alias("depth"))
    known = parts.join(F.broadcast(starts), ["file", "start"])
    lists = known.mapInArrow(_lists, "file string, start long, seq long, name string, deep int")
    rank = F.array_position(F.array(F.lit(""), *(F.lit(x) for x in LISTS)), F.col("name"))
    chosen = lists.filter("name is not null and deep = if(name = '', 1, 2)").groupBy("file").agg(F.min_by(F.struct("name", "deep"), rank).alias("c"))
    ranges = starts.join(chosen, "file", "left").select("file", "start", "inside", "depth", F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.deep", F.lit(0)).alias("deep"))
    last = lists.groupBy("file", "start", "deep").agg(F.max_by(F.struct("name"), "seq").alias("last"))
    ranges = ranges.join(last, ["file", "start", "deep"], "left")
    active = F.coalesce(F.last("last", ignorenulls=True).over(before)["name"] == F.col("name"), F.lit(False)) | (F.col("deep") == 0)
    ranges = ranges.select("file", "start", "inside", "depth", "name", "deep", active.alias("active"))
    cut = parts.join(F.broadcast(ranges), ["file", "start"]).mapInArrow(_cut, "file string, start long, part int, value string")
    begun = F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "part"))
    joined = cut.filter("part is not null").withColumn("record", begun).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("x"))
    return cut.filter("part is null").select("value").unionByName(joined.select(F.array_join(F.col("x.value"), "").alias("value")))
