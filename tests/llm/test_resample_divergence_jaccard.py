"""Resampling, divergence and the Jaccard join against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from murmura.llm import divergence, jaccard, resample, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = "doc_id long, text string, lang string, source string, extra int"


def corpus(spark, rows):
    return spark.createDataFrame(rows, NAMES).repartition(3)


def wordy(seed, n, langs=("en", "fr"), sources=("a", "b", "c")):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["été", "Zoë", "naïve", "x" * 70]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))), rng.choice(langs), rng.choice(sources), 1) for i in range(n)]


# Importance resampling


def grams(text, order, buckets):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def importance_by_definition(rows, target, percent, least_words, order, buckets, seed):
    docs = [(r[0], *grams(r[1], order, buckets)) for r in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in grams(x, order, buckets)[1])
    total = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (total[0] + buckets)) / ((s[b] + 1) * (total[1] + buckets)))) for b in s}
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    for place, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("order, buckets, percent", [(3, 10_000, 30), (2, 50, 100), (1, 7, 5)])
def test_importance(spark, monkeypatch, order, buckets, percent):
    monkeypatch.setattr(resample, "BLOCK", 400)  # several blocks
    rows = wordy(1, 80) + [(None, "w1 w2 w3 w4", "en", "a", 1), (3, "w1 w2 w3", "en", "a", 1), (90, None, None, None, 1), (91, "", "en", "a", 1), (92, "héllo " + "y" * 3000 + " w1 " + "é" * 100, "en", "a", 1)]
    target = ["w1 w2 w3 w4 w5", None, "été W7 w8 " * 5, ""]
    found = resample.importance(corpus(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), percent, 4, order, buckets, 7)
    assert sorted((tuple(r) for r in found.collect()), key=str) == importance_by_definition(rows, target, percent, 4, order, buckets, 7)


def test_importance_of_odd_rows(spark, odd, empty):
    target = odd.select("text")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    expected = importance_by_definition(rows, [r[1] for r in rows], 5, 20, 3, 10_000, 42)
    assert sorted((tuple(r) for r in resample.importance(odd, target).collect()), key=str) == expected
    assert resample.importance(empty, target).count() == 0
    assert resample.importance(odd, target.limit(0)).count() == len(rows)
    kept = resample.drawn(odd, target, percent=100, least_words=1)
    assert kept.columns == odd.columns and kept.count() == sum(1 for r in rows if r[0] is not None and grams(r[1], 1, 9)[0] > 0)


def test_drawn_leans_to_the_target(spark):
    rows = [(i, " ".join(["alpha", "beta", "gamma"][(i + j) % 3] if i % 10 == 0 else f"n{(i * j) % 50}" for j in range(30)), "en", "a", 1) for i in range(200)]
    aimed = spark.createDataFrame([("alpha beta gamma " * 20,)], "text string")
    found = [r.doc_id for r in resample.importance(corpus(spark, rows), aimed, percent=10).filter("rank is not null").collect()]
    assert len(found) == 20 and all(i % 10 == 0 for i in found)


def test_checksums_of_long_words():
    texts = ["a" * n + "b" for n in (1, 62, 63, 64, 65, 130, 1000)]
    both = " ".join(texts).encode()
    got, _, _ = resample.features(np.frombuffer(both, np.uint8), np.array([0, len(both)]), 3)
    want = [zlib.crc32(" ".join(texts[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(texts) - k + 1)]
    assert sorted(got.tolist()) == sorted(want)


# Divergence of sources


def divergence_by_definition(rows, least_docs, top):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))) for r in rows]
    held = Counter((lang, t) for lang, _, w in docs for t in set(w))
    groups = sorted({d[:2] for d in docs})
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least_docs:
            kept[lang].append(t)
    count = Counter((lang, source, t) for lang, source, w in docs for t in w if held[lang, t] >= least_docs)
    out = []
    for lang, source in groups:
        terms = kept[lang]
        others = [s for x, s in groups if x == lang]
        total = {s: sum(count[lang, s, t] for t in terms) for s in others}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 1) // (total[s] + len(terms)) for s in others for t in terms}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in others) + 1) // (sum(total.values()) + len(terms)) for t in terms}
        pairs = [(s, sum((p[source, t] - p[s, t]) ** 2 // p[s, t] for t in terms)) for s in others if s != source]
        more = [(t, (p[source, t] - q[t]) ** 2 // q[t]) for t in terms if count[lang, source, t] and p[source, t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", more, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("chunk, cells, side", [(1 << 19, 1 << 22, 512), (40, 16, 2), (7, 3, 1)])
def test_divergence(spark, monkeypatch, chunk, cells, side):
    for name, value in (("CHUNK", chunk), ("CELLS", cells), ("SIDE", side), ("SLICE", 500), ("HELD", 100)):
        monkeypatch.setattr(divergence, name, value)
    rows = wordy(2, 90, sources=("a", "B", "é", "z")) + [(None, "only here once", "xx", "a", 1), (1, None, None, None, 1), (1, "w1 w1", "xx", "b", 1), (2, "", "fr", "new", 1)]
    found = divergence.audit(corpus(spark, rows), top=5)
    assert sorted(tuple(r) for r in found.collect()) == divergence_by_definition(rows, 3, 5)


def test_divergence_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd, least_docs=2).collect()) == divergence_by_definition(rows, 2, 200)
    assert divergence.audit(empty).count() == 0


def test_shares_of_large_counts_are_exact():
    rng = random.Random(3)
    cases = [(c, c + rng.randrange(1, 10**14)) for c in (rng.randrange(0, 10**15) for _ in range(500))]
    got = divergence.share(np.array([c for c, _ in cases]), np.array([t for _, t in cases]))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in cases]


# Jaccard join


def sets_of(rows, words=5):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (r[1] or "").translate(LOWER))
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def groups_by_definition(rows, percent=80):
    sets, up = sets_of(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return sorted([(r[0], len(s), min((x for x in least[top(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets))], key=str)


def copies(seed, groups, size, length=60):
    """Groups of texts around one each, some closer than 0.8 and some not."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}x{i}" for i in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                text[rng.randrange(length)] = f"r{rng.randrange(10**6)}"
            out.append((len(out), " ".join(text) + " the same closing line of many texts", "en", "a", 1))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sets, members, block", [(2048, 1 << 21, 8 << 20), (4, 1 << 21, 3000), (50, 700, 500)])
def test_jaccard_groups(spark, monkeypatch, sets, members, block):
    for name, value in (("SETS", sets), ("MEMBERS", members), ("BLOCK", block), ("HELD", 200)):
        monkeypatch.setattr(jaccard, name, value)
    rows = copies(5, 6, 14)
    assert sorted((tuple(r) for r in jaccard.groups(corpus(spark, rows)).collect()), key=str) == groups_by_definition(rows)


def test_jaccard_at_the_bound(spark):
    base = [f"w{i}" for i in range(13)]  # nine shingles; eight of ten shared is 0.8, and seven of ten is not
    rows = [(9, " ".join(base), "en", "a", 1), (4, " ".join(base[:-1] + ["z"]), "en", "a", 1), (7, " ".join(base[:-2] + ["y", "z"]), "en", "a", 1)]
    assert groups_by_definition(rows)[0][2] == 4
    assert sorted((tuple(r) for r in jaccard.groups(corpus(spark, rows)).collect()), key=str) == groups_by_definition(rows)


def test_jaccard_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in jaccard.groups(odd).collect()), key=str) == groups_by_definition(rows)
    assert jaccard.groups(empty).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns


def test_one_id_with_two_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, " ".join(f"b{i}" for i in range(60)), "en", "s", 1)]
    assert sorted(tuple(r) for r in jaccard.groups(corpus(spark, rows)).collect()) == [(1, 56, 1), (2, 56, 2), (2, 57, 1)]


def test_prefix_tree_links_every_similar_pair():
    rng = np.random.default_rng(0)
    for trial in range(60):
        m, percent = int(rng.integers(1, 40)), int(rng.choice([50, 80, 95]))
        base = [set(rng.choice(300, int(rng.integers(1, 60)), replace=False).tolist()) for _ in range(3)]
        sets = []
        for _ in range(m):
            s = set(base[rng.integers(3)])
            for _ in range(int(rng.integers(0, 6))):
                s.symmetric_difference_update({int(rng.integers(300))})
            sets.append(sorted(s) or [1])
        group, n = np.sort(rng.integers(0, 3, m)), np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        stores = np.ones(m, bool) if trial % 2 else rng.random(m) < 0.5
        probes = np.ones(m, bool) if trial % 2 else ~stores
        got = trie.linked(group, np.concatenate([np.array(s, np.int64) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), n, np.arange(m), stores, probes, percent)
        up = list(range(m))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(m):
            for j in range(m):
                both = len(set(sets[i]) & set(sets[j]))
                if i != j and group[i] == group[j] and stores[i] and probes[j] and both * (100 + percent) >= percent * (n[i] + n[j]):
                    up[top(i)] = top(j)
        assert len({(top(i), x) for i, x in enumerate(got.tolist())}) == len({top(i) for i in range(m)}) == len(set(got.tolist()))
