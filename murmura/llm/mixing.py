"""Mixing documents to target token weights over soft domains; DataFrame functions only.

A naive Bayes classifier, counted from a labelled table, gives each document a
posterior over domains. Rates of documents are then fitted by projected gradient
least squares, so that the expected tokens of each domain meet their targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.common import forget, given, stored

#: Hashed words of the classifier; labelled rows it is counted on at most, the first by a hash of the id.
BUCKETS, SAMPLE = 8192, 20_000
#: Evidence of a long text counts as that of so many words, so that memberships stay soft.
EVIDENCE = 50.0
#: Steps of the projected gradient at most (a fit that needs more says so), its rate, the pull of rates to 1, the relative miss at which it stops, and steps after which the rates are written out.
STEPS, RATE, PULL, NEAR, WRITE = 200, 1.0, 1e-5, 1e-4, 20


@dataclass(frozen=True)
class Mixture:
    """rates: doc_id, n_tokens, p_0 .. (in the order of domains), rate. reached and wanted: tokens by domain. converged: whether they differ by NEAR of all tokens at most."""

    domains: list[str]
    rates: DataFrame
    reached: list[float]
    wanted: list[float]
    converged: bool


def _words(docs: DataFrame) -> DataFrame:
    """doc_id and bucket of every word; a document without words has a row with a null bucket."""
    words = docs.select("doc_id", F.explode_outer(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word"))
    return words.select("doc_id", F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).alias("bucket"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(bucket, l_0, l_1 ..): log likelihoods of hashed words by domain, and the domains' log priors. BUCKETS rows, whatever the corpus."""
    chosen = labelled.filter("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = stored(chosen)
    known = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(known.values())
    prior = [math.log(known[d] / total) if known.get(d) else float("-inf") for d in domains]
    words = _words(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").filter("bucket is not null")
    counts = words.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n_{i}") for i, d in enumerate(domains)))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    sums = full.agg(*(F.sum(f"n_{i}").alias(f"s_{i}") for i in range(len(domains))))
    return stored(full.join(F.broadcast(sums)).select("bucket", *(F.log((F.col(f"n_{i}") + 0.5) / (F.col(f"s_{i}") + 0.5 * BUCKETS)).alias(f"l_{i}") for i in range(len(domains))))), prior


def posteriors(docs: DataFrame, likelihood: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, n_tokens and p_0 .. of each distinct doc_id: soft memberships from all words of whole texts."""
    k = len(prior)
    scored = _words(docs).join(F.broadcast(likelihood), "bucket", "left")
    sums = scored.groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.sum(f"l_{i}").alias(f"s_{i}") for i in range(k)))
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest("n_tokens", F.lit(1)))
    live = [i for i in range(k) if prior[i] > float("-inf")]
    logs = {i: F.coalesce(f"s_{i}", F.lit(0.0)) * weight + F.lit(prior[i]) for i in live}
    sums = sums.select("doc_id", "n_tokens", *(logs[i].alias(f"z_{i}") for i in live))
    top = F.greatest(*(F.col(f"z_{i}") for i in live)) if len(live) > 1 else F.col(f"z_{live[0]}") if live else F.lit(0.0)
    sums = sums.select("doc_id", "n_tokens", *(F.exp(F.col(f"z_{i}") - top).alias(f"z_{i}") for i in live))
    whole = sum((F.col(f"z_{i}") for i in live), F.lit(0.0))
    return sums.select("doc_id", "n_tokens", *((F.col(f"z_{i}") / whole if i in live else F.lit(0.0)).alias(f"p_{i}") for i in range(k)))


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> Mixture:
    """Rates at which to take each document, for token shares by domain near ``targets``, and as many tokens as there are.

    docs: doc_id, text; labelled: doc_id, domain. Rows of equal doc_id are one
    document, null ids too. Other columns are ignored. Domains without a labelled row can have no posterior;
    their weight goes to the others in proportion. Null and empty texts have no
    tokens and, like every document of no influence, rate 1. An empty table, or
    one without labels, gives rates of 1. Ties and repeated labels take the first
    domain by name.

    Each step is one aggregation of a few sums; rates themselves are an expression
    over the stored posteriors and never leave the executors. Gradients are taken in
    the metric of the domains' second moments, a matrix of domains by domains, so
    that a step is exact but for the rates that it stops at 0. Targets that no
    nonnegative rates reach leave ``converged`` false, with the nearest rates found.
    """
    docs, labelled = given(docs, "doc_id", "text"), given(labelled, "doc_id", "domain")
    domains = sorted(targets)
    likelihood, prior = classifier(docs, labelled, domains)
    found = stored(posteriors(docs, likelihood, prior))
    k = len(domains)
    share = F.col("n_tokens").cast("double")
    start = found.agg(F.sum("n_tokens").alias("all"), *(F.sum(share * F.col(f"p_{i}")).alias(f"a_{i}") for i in range(k)), *(F.sum(share * F.col(f"p_{i}") * F.col(f"p_{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = float(start["all"] or 0)
    have = [float(start[f"a_{i}"] or 0) for i in range(k)]
    open_ = sum(targets[d] for d, h in zip(domains, have) if h > 0) or 1.0
    wanted = [targets[d] / open_ * total if h > 0 else 0.0 for d, h in zip(domains, have)]
    metric = np.linalg.pinv(np.array([[float(start[f"m_{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]), rcond=1e-9, hermitian=True)
    near = lambda now: max((abs(a - w) for a, w in zip(now, wanted)), default=0.0) <= NEAR * total
    rate, reached = F.lit(1.0), have
    for step in range(1, 1 + (STEPS if total and any(h > 0 for h in have) else 0)):
        if near(reached):
            break
        pull = RATE * metric @ (np.array(reached) - np.array(wanted))
        move = sum((F.col(f"p_{i}") * F.lit(float(pull[i])) for i in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.lit(1 - RATE * PULL) * rate + F.lit(RATE * PULL) - move)
        if step % WRITE == 0:
            before, found = found, stored(found.select("doc_id", "n_tokens", *(f"p_{i}" for i in range(k)), rate.alias("rate_so_far")))
            forget(before)
            rate = F.col("rate_so_far")
        now = found.agg(*(F.sum(share * F.col(f"p_{i}") * rate).alias(f"a_{i}") for i in range(k))).first()
        reached = [float(now[f"a_{i}"]) for i in range(k)]
    rates = found.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(F.lit(1.0))).drop("rate_so_far")
    return Mixture(domains, rates, reached, wanted, near(reached))


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs`` with rate and copy: each row as often as its rate says, a fraction by a hash of its id; rows of rate 0 go.

    Columns of these two names are replaced. Rows of one doc_id, null too, have one
    rate; null and empty texts have rate 1 and stay; an empty table gives an empty one.
    """
    docs = docs.drop("rate", "copy")
    rates = mixture.rates.select(F.col("doc_id").alias("rated_id"), "rate")
    met = docs.join(rates, F.col("doc_id").eqNullSafe(F.col("rated_id")), "left").drop("rated_id")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return met.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
