"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import kernels as K
from murmura.llm.common import Sent, given, mapped, stored

#: Rows of the embedding table, its width, filter widths, and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: Bytes of the word beginnings that are hashed beside the whole word.
STEMS = (4, 5)
#: The training sample: so many labelled texts of each class; passes; rate; decay.
SAMPLE, EPOCHS, RATE, DECAY = 3000, 10, 0.1, 1e-4
#: Words of a clean training text that make an example; a longer one makes several, as every piece of it is clean. A toxic text is one example, whole.
PIECE = 4096
#: One in so many labelled texts, by a hash of its id, is kept from the network and sets the thresholds.
CALIBRATE = 5
#: A hashed feature is learned only if so many distinct training texts hold it.
LEAST_TEXTS = 5
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of bucket numbers for each word (the word, and its first bytes), and each text's first word."""
    low = K.LOWER[buf]
    start, end, first = K.runs(WORD[buf], off)
    pre = K.prefix_hash(low)
    ends = [end, *(np.minimum(end, start + n) for n in STEMS)]
    cols = [K.mix(K.span_hash(pre, start, e) + np.uint64(i + 1)) >> np.uint64(64 - 18) for i, e in enumerate(ends)]
    return np.stack(cols, 1).astype(np.int32), first


class Network:
    """Embeddings, convolutions of several widths, max pooling over the text, one logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = np.zeros((BUCKETS, DIM), np.float32)
        self.w = [rng.normal(0, 0.5, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(-1.0)

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations by width; x is padded with zero rows so that each word starts a window."""
        padded = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        out = []
        for k, w, b in zip(WIDTHS, self.w, self.b):
            a = padded[: len(x)] @ w[:DIM]
            for j in range(1, k):
                a += padded[j : len(x) + j] @ w[j * DIM : (j + 1) * DIM]
            out.append(a + b)
        return out

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest activation of each filter in each text, 0 at least. Windows stop at a text's end."""
        n = len(first) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(first) > 0)
        if not len(full):
            return out
        x = self.e[ids].sum(1)
        count = np.diff(first)[full]
        gap = max(WIDTHS) - 1  # zero rows after each text
        place = np.arange(len(x)) + gap * np.repeat(np.arange(len(full)), count)
        spread = np.zeros((len(x) + gap * len(full), DIM), np.float32)
        spread[place] = x
        head = first[full] + gap * np.arange(len(full))
        live = np.zeros(len(spread), bool)
        live[place] = True
        for i, a in enumerate(self.maps(spread)):
            a[~live] = 0
            out[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(a, head, axis=0), 0)
        return out

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(ids, first) @ self.v + self.c).astype(np.float64)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad, a text at a time; only the windows that win the pooling get a gradient."""
        seen = np.zeros(BUCKETS, np.int32)
        for t in texts:
            seen[np.unique(t)] += 1
        known = seen >= LEAST_TEXTS
        rng = np.random.default_rng(seed)
        self.e[known] = rng.normal(0, 0.1, (int(known.sum()), DIM)).astype(np.float32)
        ge = np.full(BUCKETS, 1e-2, np.float32)
        gw, gb = [np.full_like(w, 1e-2) for w in self.w], [np.full_like(b, 1e-2) for b in self.b]
        gv, gc = np.full_like(self.v, 1e-2), 1e-2
        for _ in range(EPOCHS):
            for i in rng.permutation(len(texts)):
                ids = texts[i]
                if not len(ids):
                    continue
                x = (self.e[ids] * known[ids][:, :, None]).sum(1)
                pools, args = [], []
                for a in self.maps(x):
                    args.append(a.argmax(0))
                    pools.append(np.maximum(a.max(0), 0))
                h = np.concatenate(pools)
                d = 1 / (1 + np.exp(-float(h @ self.v + self.c))) - labels[i]
                dh = d * self.v * (h >= 0)
                dv = d * h + DECAY * self.v
                gv += dv * dv
                self.v -= RATE * dv / np.sqrt(gv)
                gc += d * d
                self.c -= np.float32(RATE * d / np.sqrt(gc))
                for m, k in enumerate(WIDTHS):
                    own = dh[m * FILTERS : (m + 1) * FILTERS]
                    on = np.flatnonzero(own)
                    if not len(on):
                        continue
                    dw = np.zeros_like(self.w[m])
                    for j in range(k):
                        at = args[m][on] + j
                        ok = at < len(x)
                        part = slice(j * DIM, (j + 1) * DIM)
                        dw[part, on[ok]] = (x[at[ok]] * own[on[ok], None]).T
                        dx = own[on[ok], None] * self.w[m][part, on[ok]].T
                        for f in range(ids.shape[1]):
                            b = ids[at[ok], f]
                            use = known[b]
                            g = dx[use] + DECAY * self.e[b[use]]
                            np.add.at(ge, b[use], (g * g).mean(1))
                            np.add.at(self.e, b[use], -RATE * g / np.sqrt(ge[b[use]])[:, None])
                    dw += DECAY * self.w[m] * (dw != 0)
                    gw[m] += dw * dw
                    self.w[m] -= RATE * dw / np.sqrt(gw[m])
                    gb[m] += own * own
                    self.b[m] -= RATE * own / np.sqrt(gb[m])
        self.e[~known] = 0


def for_calibration(name: str = "doc_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(name), F.lit("thresholds")), F.lit(CALIBRATE)) == 0


def _toxic(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) with one row for each id: toxic if any of its labels says so."""
    return given(labels.filter("toxic in (0, 1) and doc_id is not null"), "doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); other columns are ignored, null labels, ids and texts left out.

    It is fitted on the bounded sample that SAMPLE states, of those not kept for the
    thresholds: the first texts of each class by a hash of the text, each distinct
    text once. Without both classes, as in empty tables, it scores every text alike.
    """
    texts = given(docs, "doc_id", "text").filter("text is not null").filter(~for_calibration()).join(_toxic(labels), "doc_id")
    one = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    pick = [one.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = stored(pick[0].unionByName(pick[1]).select("doc_id", "h", "toxic"))
    rows = given(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("h", "text", "toxic")

    def kernel(got, buf, off):
        found, first = features(buf, off)
        flat = pa.ListArray.from_arrays(pa.array((first * found.shape[1]).astype(np.int32)), pa.array(found.reshape(-1)))
        return [got.column(0), got.column(2), flat]

    data = mapped(rows, kernel, "h long, toxic long, words array<int>").toArrow().sort_by("h")
    texts, y = [], []
    for words, toxic in zip(data["words"], data["toxic"].to_pylist()):
        ids = np.asarray(words.values, np.int32).reshape(-1, 1 + len(STEMS))
        pieces = [ids] if toxic else [ids[i : i + PIECE] for i in range(0, max(len(ids), 1), PIECE)]
        texts += pieces
        y += [toxic] * len(pieces)
    net = Network()
    if len(set(y)) == 2:
        net.fit(texts, np.array(y))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang and score (0 to 1) of each row; of whole texts, nothing else is looked at. Null and empty texts get the score of no evidence."""
    shared = Sent(docs.sparkSession, net)

    def kernel(rows, buf, off):
        return [rows.column(0), rows.column(2), shared.value.score(*features(buf, off))]

    return mapped(given(docs, "doc_id", "text", "lang"), kernel, "doc_id long, lang string, score double")


def thresholds(scored: DataFrame, default: float = 0.3) -> DataFrame:
    """(lang, threshold): of hundredths, the one of most correct labels among ``scored`` rows (lang, score, toxic) of that language; the middle one of ties.

    Counted over all rows given, in a hundred bins a language; a null lang counts as
    a language. One without both classes takes the default.
    """
    bins = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.least(F.floor(F.col("score") * 100), F.lit(99)).alias("bin")).agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("good"))
    cuts = bins.select("lang").distinct().withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(99))))
    right = cuts.join(bins, "lang").groupBy("lang", "cut").agg(F.sum(F.when(F.col("bin") >= F.col("cut"), F.col("bad")).otherwise(F.col("good"))).alias("right"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = right.groupBy("lang").agg(F.max("right").alias("top"))
    best = right.join(best, "lang").filter("right = top").groupBy("lang").agg(F.avg("cut").alias("mid"), F.first("bad").alias("bad"), F.first("good").alias("good"))
    return best.select("lang", F.when((F.col("bad") > 0) & (F.col("good") > 0), F.col("mid") / 100).otherwise(F.lit(default)).alias("threshold"))


def rated(docs: DataFrame, labels: DataFrame, learn: F.Column, default: float = 0.3) -> DataFrame:
    """doc_id, learned, score, threshold, toxic for each row of ``docs`` (doc_id, text, lang); other columns are ignored.

    Labels are used only of rows where ``learn``, an expression over doc_id, holds:
    most of them train the network, one in CALIBRATE sets the thresholds. lang names
    the threshold and is no input of a score. Null ids, texts and langs and repeated
    rows keep their rows; an empty table gives none.
    """
    own = given(docs, "doc_id", "text", "lang")
    teach = stored(_toxic(labels).filter(learn))
    net = train(own, teach)
    found = stored(score(own, net).withColumn("learned", learn))
    limits = stored(thresholds(found.filter("learned").filter(for_calibration()).join(teach, "doc_id"), default)).withColumnRenamed("lang", "of_lang")
    met = found.join(limits, F.coalesce("lang", F.lit("")) == F.col("of_lang"), "left")
    limit = F.coalesce("threshold", F.lit(default))
    return met.select("doc_id", "learned", "score", limit.alias("threshold"), (F.col("score") >= limit).alias("toxic"))
