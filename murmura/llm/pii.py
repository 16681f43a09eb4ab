"""Personal data: base patterns, and what a bidirectional LSTM with CRF transitions adds to them.

The tagger learns from texts of the corpus into which spans of every kind are set, in
forms that the patterns know and in spaced, obfuscated and broken ones that they miss,
beside numbers and marks that are none. What it tags is added if it is made of whole
tokens and its canonical form, marks and blanks undone, is valid.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import Sent, by_slices, given, mapped, ship
from murmura.llm.disguise import examples
from murmura.llm.tagger import KINDS, TAGS, WINDOW, Tagger, alphabet

STRIDE = WINDOW // 2
#: Texts that lend their words to the training windows, the first by a hash; windows; characters of a text that are lent.
SAMPLE, EXAMPLES, LENT = 600, 6000, 2000
#: A window without a digit, an @ or a bracketed at or dot cannot hold a span of any form looked for.
TRIGGER = np.zeros(256, bool)
TRIGGER[0x30:0x3A] = TRIGGER[0x40] = True
_OPEN, _AT_DOT = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord(c) for c in "([{"]] = True
_AT_DOT[[ord(c) for c in "aAdD.@"]] = True

# The local part ends at an @ and so is the run before it; a run of digits that fails once fails from each of its digits. So these need no second start.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def _ok(kind: str, found: str) -> bool:
    digits = "".join(_DIGIT.findall(found))
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their test are dropped without retry."""
    out = [(0, s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _ok(KINDS[k], m.group())]
    return out


def triggers(codes: np.ndarray) -> np.ndarray:
    """Which bytes or code points may belong to a span."""
    small = np.minimum(codes, 255).astype(np.int64) * (codes < 256)
    on = TRIGGER[small]
    opened = np.flatnonzero(_OPEN[small])
    after = np.concatenate([small, [0, 0]])
    skip = opened + 1 + (after[opened + 1] == 0x20)
    on[opened[_AT_DOT[after[skip]]]] = True
    return on


def windows(cp: np.ndarray) -> np.ndarray:
    """Starts, by STRIDE, of windows that hold a trigger."""
    last = np.flatnonzero(triggers(cp)) // STRIDE * STRIDE
    both = np.concatenate([last, last - STRIDE])
    return np.unique(both[both >= 0])


def _cut(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([values, np.zeros(WINDOW, values.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)[None, :]] if len(starts) else np.zeros((0, WINDOW), values.dtype)


def reconcile(starts: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """One tag a character: that of the window in which it lies furthest from an edge, the earlier one of equals."""
    out, margin = np.zeros(n + WINDOW, np.int64), np.full(n + WINDOW, -1)
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for s, t in zip(starts, tags):
        depth_here = np.where((np.arange(WINDOW) < STRIDE) & (s == 0), WINDOW, depth)
        more = depth_here > margin[s : s + WINDOW]
        out[s : s + WINDOW][more] = t[more]
        margin[s : s + WINDOW][more] = depth_here[more]
    return out[:n]


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, i = [], 0
    on = np.flatnonzero(tags)
    while len(on) and i < len(on):
        start, kind = int(on[i]), (int(tags[on[i]]) - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 * kind + 2:
            end += 1
        out.append((kind, start, end))
        i = int(np.searchsorted(on, end))
    return out


_MARKS = (
    (re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*", re.I), "@"),
    (re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*", re.I), "."),
    (re.compile(r"\s*@\s*|(?<=\w)\s+\.\s+(?=\w)"), lambda m: m.group().strip()),
)
_GAPS = re.compile(r"\s*\.\s*")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ]\d\d?[-./ ]\d\d?|\d\d?[-./ ]\d\d?[-./ ](?:19|20)?\d\d|(?:19|20)\d\d ?[-/ ] ?(?:19|20)\d\d")
_BOOK = re.compile(r"97[89](?:[- ]?\d){10}")
_CALL = re.compile(r"(?:\+|00)?\(?[0-9]+(?:(?:\) ?|\)?[\s./-])\(?[0-9]+)+")


def canonical(kind: int, found: str) -> str | None:
    """The plain form of what a span spells, or null if that is no address, card or call number: marks and the blanks around them are undone first."""
    plain = found
    for pattern, mark in _MARKS if kind < 2 else ():
        plain = pattern.sub(mark, plain)
    digits = "".join(_DIGIT.findall(found))
    if kind == 0:
        return plain if _ADDRESS.fullmatch(plain) else None
    if kind == 1:
        plain = _GAPS.sub(".", plain)
        parts = plain.split(".")
        return plain if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else None
    if kind == 2:
        return digits if re.fullmatch(r"[0-9](?:[\s./_-]{0,3}[0-9])+", found) and 16 <= len(digits) <= 19 and luhn(digits) else None
    spelled = _CALL.fullmatch(found) and 8 <= len(digits) <= 15 and not _DATE.fullmatch(found) and not _BOOK.fullmatch(found)
    return digits if spelled else None


def trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """A span without blanks at its ends, with both brackets of a pair or none, and an address without the sentence behind it."""
    if start and text[start - 1] == "(" and ")" in text[start:end] and "(" not in text[start:end]:
        start -= 1
    while start < end and (text[start].isspace() or text[start] == "(" and ")" not in text[start:end]):
        start += 1
    while start < end and (text[end - 1].isspace() or text[end - 1] == ")" and "(" not in text[start:end]):
        end -= 1
    if kind == 0 and canonical(kind, text[start:end]) is None:
        stop = re.search(r"(?<=\w)[.,;:!?]?\s+\w*$", text[start:end])
        end = start + stop.start() if stop else end
    return start, end


def whole(text: str, start: int, end: int) -> bool:
    """Whether a span cuts no word, number or dotted chain at its ends."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    if before[-1:].isalnum() or after[:1].isalnum():
        return False
    return not (re.fullmatch(r"[0-9][.,/_-]", before) or re.fullmatch(r"[.,/_-][0-9]", after))


def all_spans(text: str, cp: np.ndarray, model: Tagger, letters: np.ndarray) -> tuple[list, list]:
    """Base spans, and base spans with those that the model adds beside them."""
    base = base_spans(text)
    starts = windows(cp)
    if not len(starts):
        return base, base
    found = tag_spans(reconcile(starts, model.decode(_cut(letters[cp], starts)), len(cp)))
    taken = np.zeros(len(cp) + 1, np.int64)
    for _, s, e in base:
        taken[s:e] = 1
    before = np.concatenate([[0], np.cumsum(taken)])
    found = [(k, *trimmed(k, text, s, e)) for k, s, e in found]
    added = [(k, s, e) for k, s, e in found if s < e and before[e] == before[s] and whole(text, s, e) and canonical(k, text[s:e]) is not None]
    return base, sorted(base + added)


def train(docs: DataFrame) -> Tagger:
    """A tagger of windows, from EXAMPLES windows composed over the words of at most SAMPLE texts of ``docs`` (text; other columns are ignored).

    Null and empty texts lend nothing, repeated ones count once; an empty table
    leaves the composed spans without words around them. Fixed seeds: the same
    texts give the same model.
    """
    texts = docs.select("text", F.xxhash64("text").alias("h")).filter("text is not null and text <> ''")
    chosen = [r.h for r in texts.groupBy("h").agg(F.count("*").alias("n")).select("h").orderBy("h").limit(SAMPLE).collect()]
    # a stretch of each, from a hashed place on
    start = F.pmod(F.xxhash64(F.col("h"), F.lit("lent")), F.greatest(F.char_length("text") - LENT, F.lit(1))).cast("int") + 1
    lent = texts.filter(F.col("h").isin(chosen)).select("h", F.substring("text", start, F.lit(LENT)).alias("text"))
    rows = lent.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if chosen else []
    letters, model = alphabet(), Tagger()
    ids, tags = [], []
    for text, spans in examples([r.text for r in rows], EXAMPLES, WINDOW):
        cp = np.minimum(np.array([ord(c) for c in text], np.int64), 65535)
        tag = np.zeros(WINDOW, np.int64)
        for k, s, e in spans:
            tag[max(s, 0) : e] = 2 * k + 2
            if s >= 0:
                tag[s] = 2 * k + 1
        ids.append(letters[cp].astype(np.int64))
        tags.append(tag)
    model.fit(np.stack(ids), np.stack(tags))
    return model


def _tagged(column: pa.Array, buf: np.ndarray, off: np.ndarray, tagger: Tagger, letters: np.ndarray) -> tuple[list, list, pa.Array]:
    """Base spans and all spans of each text, and the texts with the latter masked."""
    trigger = K.segment_sum(triggers(buf), off)
    base, every, masked = [[] for _ in range(len(trigger))], [[] for _ in range(len(trigger))], {}
    for i in np.flatnonzero(trigger):
        raw = buf[off[i] : off[i + 1]]
        text = raw.tobytes().decode()
        base[i], every[i] = all_spans(text, K.code_points(raw, np.array([0, len(raw)]))[0], tagger, letters)
        if every[i]:
            out, at = [], 0
            for k, s, e in sorted(every[i], key=lambda x: (x[1], x[2])):
                if s >= at:
                    out += [text[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            masked[i] = "".join(out) + text[at:]
    return base, every, pa.array([masked.get(i, t) for i, t in enumerate(column.to_pylist())], pa.string()) if masked else column


def spans(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, base, spans and masked of each row of ``docs`` (doc_id, text; other columns are ignored).

    base and spans are arrays of (kind, start, end), by kind and start, in code
    points of the whole text, end exclusive; masked has each span replaced by its
    kind in brackets, overlapping ones by the first. Null texts are empty, and stay
    null in masked. Null ids and repeated rows keep their rows; an empty table gives
    none.
    """
    shared = Sent(docs.sparkSession, model)
    letters = alphabet()

    def kernel(rows, buf, off):
        base, every, texts = _tagged(rows.column(1), buf, off, shared.value, letters)
        rows_of = lambda spans: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        return [rows.column(0), rows_of(base), rows_of(every), texts]

    kind = "array<struct<kind:string,start:long,end:long>>"
    return mapped(given(docs, "doc_id", "text"), kernel, f"doc_id long, base {kind}, spans {kind}, masked string")


def digest(column: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced, and n_chars following where there is one; all other columns and rows stay. One pass, no shuffle.

    Null texts stay null, empty ones empty; null ids and repeated rows stay as they
    are; an empty table gives an empty one. n_chars follows only where it is a long.
    """
    ship()
    shared = Sent(docs.sparkSession, train(docs))
    letters, at = alphabet(), docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches):
        for rows, buf, off in by_slices(batches, "text"):
            columns = list(rows.columns)
            texts = _tagged(rows.column(at), buf, off, shared.value, letters)[2]
            if texts is not columns[at]:
                if size is not None:
                    same = pc.fill_null(pc.equal(texts, columns[at]), True)
                    columns[size] = pc.if_else(same, columns[size], pc.cast(pc.utf8_length(texts), pa.int64()))
                columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)
