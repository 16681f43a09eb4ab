import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import backoff, language, quality, toxicity
from murmura.llm import kneser_ney as KN
from murmura.llm.common import doc_hash

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_counts(t):
    t = t or ""
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered)


def test_base_counts_equal_brute_force(odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in quality.base(odd).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id]), r.doc_id


def test_judged_keeps_rows_and_rejects_short_and_repetitive_texts(odd, empty):
    got = quality.judged(odd).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judged(empty).collect() == []
    assert quality.keep_good(empty).columns == empty.columns


def test_bands_reject_symbols_and_keep_prose(spark):
    rng = random.Random(1)
    prose = [(i, " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(120)), "en" if i % 2 else None) for i in range(120)]
    junk = [(1000 + i, " ".join("".join(rng.choices("#%*&|$QXZ", k=5)) for _ in range(120)), "en") for i in range(3)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, _ in prose)
    assert not any(got[i].kept or got[i].base_failed for i, _, _ in junk)


def test_bands_tell_letters_of_other_scripts_apart(spark):
    """Words of rare letters among prose of the same script, with words as long: the 64 symbols cannot tell them from it."""
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(120))
    scripts = [("оеаинтсрвл", "ъэщцжхюфшё"), ("的一是不了人我在有他", "龘靐齉爩鱻麤灪吁鑫淼"), ("𐐨𐐩𐐪𐐫𐐬𐐭𐐮𐐯", "𐑀𐑁𐑂𐑃𐑄𐑅𐑆𐑇")]
    rows = [(100 * k + i, text(prose if i < 60 else junk), f"l{k}") for k, (prose, junk) in enumerate(scripts) for i in range(62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(not r.base_failed and r.low - quality.SHORT / math.sqrt(r.n_scored) <= r.cross_entropy <= r.high + quality.SHORT / math.sqrt(r.n_scored) for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {i for i, _, _ in rows if i % 100 < 60}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_letters_keep_all_code_points_apart(spark):
    alphabet = KN.quality_alphabet()
    texts = ["aZ9é", "", "z", "漢字a🙂𐐨 Я", "я\uffffÿ"]
    alone = {s for s in set(alphabet.tolist()) if (alphabet == s).sum() == 1}
    pairs = [("\0" + t)[i : i + 2] for t in texts for i in range(len(t)) if alphabet[min(ord(t[i]), 65535)] not in alone]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    (pages, places), at = KN.letters(np.frombuffer(raw, np.uint8), off, alphabet)
    want = [(ord(a) >> 6 << 15 | ord(b) >> 6, ((ord(a) & 63) << 15 | ord(b) >> 6) << 15 | ord(b) & 63) for a, b in pairs]
    assert list(zip(pages.tolist(), places.tolist())) == want and at[-1] == len(pairs) > 8
    got = {(r.kind, r.code): r.n for r in KN.count_letters(spark.createDataFrame([(t,) for t in [*texts, None, *texts]], "text string").repartition(3), alphabet).collect()}
    assert got == {k: 2 * n for k, n in Counter((i, c) for w in want for i, c in enumerate(w)).items()}
    grams = Counter(((ord(a) & 63), ord(b) >> 6, ord(b) & 63) for a, b in pairs)
    model = KN.build(np.array([(x << 15 | y) << 15 | z for x, y, z in grams]), np.array(list(grams.values())), 3, KN.PAGE, 64)
    p = brute_kneser_ney(grams, 3, 64)
    every = [(x, y, z) for x, y in {*(g[:2] for g in grams), (7, 7)} for z in range(64)]
    found = np.exp(model.log_probability(np.array([(x << 15 | y) << 15 | z for x, y, z in every])))
    assert np.allclose(found, [p(g) for g in every]) and np.allclose(found.reshape(-1, 64).sum(1), 1)


def brute_kneser_ney(counts, order, size):
    """Interpolated modified Kneser-Ney by its definition, over tuples of symbols."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        lower = Counter()
        for gram in levels[k + 1]:
            lower[gram[1:]] += 1
        levels[k] = lower
    discount = {}
    for k, grams in levels.items():
        c = [sum(n == j for n in grams.values()) for j in range(5)]
        if 0 in c[1:5]:
            discount[k] = [0, 0.5, 0.75, 0.9]
        else:
            y = c[1] / (c[1] + 2 * c[2])
            discount[k] = [0] + [min(max(j - (j + 1) * y * c[j + 1] / c[j], 0.05), j - 0.05) for j in (1, 2, 3)]

    def p(gram):
        if not gram:
            return 1 / size
        grams, d = levels[len(gram)], discount[len(gram)]
        after = {g: n for g, n in grams.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        freed = sum(d[min(n, 3)] for n in after.values())
        n = after.get(gram, 0)
        return (n - d[min(n, 3)] + freed * p(gram[1:])) / total

    return p


@pytest.mark.parametrize("order,bits,length", [(3, 2, 400), (4, 2, 400), (3, 3, 60), (4, 2, 9)])
def test_kneser_ney_equals_its_definition(order, bits, length):
    rng = np.random.default_rng(order)
    text = rng.choice(4, length, p=[0.05, 0.6, 0.3, 0.05])
    grams = Counter(tuple(int(x) for x in text[i : i + order]) for i in range(length - order + 1))
    as_code = lambda g: sum(x << bits * (order - 1 - j) for j, x in enumerate(g))
    model = KN.build(np.array([as_code(g) for g in grams]), np.array(list(grams.values())), order, bits)
    p = brute_kneser_ney(grams, order, 1 << bits)
    every = list(itertools.product(range(1 << bits), repeat=order))
    got = np.exp(model.log_probability(np.array([as_code(g) for g in every])))
    assert np.allclose(got, [p(g) for g in every])
    assert np.allclose(got.reshape(-1, 1 << bits).sum(1), 1)


def test_a_model_of_nothing_is_uniform():
    model = KN.build(np.zeros(0, np.int64), np.zeros(0, np.int64), 3, 2)
    assert np.allclose(model.log_probability(np.arange(64)), -np.log(4)) and model.size() == 0


def test_cross_entropy_and_bands_equal_their_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    rows = docs.collect()
    alphabet = KN.quality_alphabet()
    texts = {r.doc_id: [KN.EDGE] * 3 + [int(alphabet[min(ord(c), 65535)]) for c in r.text] for r in rows}
    grams = Counter(tuple(s[i : i + 4]) for s in texts.values() for i in range(len(s) - 3))
    model = KN.build(np.array([a << 18 | b << 12 | c << 6 | d for a, b, c, d in grams]), np.array(list(grams.values())), 4, 6)
    loss = {}
    for i, s in texts.items():
        code = np.array([s[j] << 18 | s[j + 1] << 12 | s[j + 2] << 6 | s[j + 3] for j in range(len(s) - 3)])
        loss[i] = -model.log_probability(code).mean() if len(code) else None
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(got[i].cross_entropy == pytest.approx(x, abs=1e-9) for i, x in loss.items() if x is not None)
    good = [r for r in rows if not got[r.doc_id].base_failed]

    def band(own):
        values = np.array([round(1000 * got[r.doc_id].cross_entropy) for r in own])
        mid = np.median(values)
        mad = np.median(np.abs(values - mid))
        return (mid - max(quality.DOWN * mad, 1000 * quality.LEAST)) / 1000, (mid + max(quality.UP * mad, 1000 * quality.LEAST)) / 1000

    whole = band(good)
    for lang in {r.lang for r in good}:
        own = [r for r in good if r.lang == lang]
        low, high = ((len(own) * a + quality.PRIOR * b) / (len(own) + quality.PRIOR) for a, b in zip(band(own), whole))
        for r in own:
            room = quality.SHORT / math.sqrt(got[r.doc_id].n_scored)
            assert got[r.doc_id].kept == (low - room <= got[r.doc_id].cross_entropy <= high + room), r.doc_id
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_good_rows_stay_whatever_their_ids(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.keep_good(none).count() == quality.keep_good(docs).count() > 100
    assert quality.judged(odd.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == odd.count()
    with pytest.raises(TypeError):
        quality.judged(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_rejects_poor_documents_and_keeps_good_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    met = quality.judged(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in met}
    assert kept[1] >= 0.99 and kept[0] <= 0.35


def test_counts_over_partitions_equal_one_pass(odd):
    got = {r.code: r.n for r in KN.count(odd, None, KN.quality_alphabet(), 4, 6).collect()}
    want = Counter()
    alphabet = KN.quality_alphabet()
    for r in odd.collect():
        s = [KN.EDGE] * 3 + [int(alphabet[min(ord(c), 65535)]) for c in r.text or ""]
        for i in range(len(s) - 3):
            want[s[i] << 18 | s[i + 1] << 12 | s[i + 2] << 6 | s[i + 3]] += 1
    assert got == want


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    known = docs.filter(doc_hash() % 3 != 1)
    models = language.train(known)
    bounds = language.calibrate(known, models)
    got = {r.doc_id: r for r in language.predict(docs, models, bounds).collect()}
    held = docs.filter(doc_hash() % 3 == 1).collect()
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.98 * len(held) and sum(got[r.doc_id].rejected for r in held) <= 0.05 * len(held)
    alphabet = KN.letter_alphabet()
    for r in held[:20]:
        s = [KN.EDGE] * 2 + [int(alphabet[min(ord(c), 65535)]) for c in r.text or ""]
        code = np.array([s[j] << 14 | s[j + 1] << 7 | s[j + 2] for j in range(len(s) - 2)])
        loss = {x: -m.log_probability(code).mean() for x, m in models.items()} if len(code) else {}
        if loss and got[r.doc_id].lang_pred != "und":
            best = min(sorted(loss), key=loss.get)
            share = 1 / sum(math.exp((loss[best] - x) * math.sqrt(len(code))) for x in loss.values())
            assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(share)
            assert got[r.doc_id].rejected == (loss[best] - language.SLACK / math.sqrt(len(code)) > bounds.get(best, math.inf))


def test_bounds_are_ranks_of_texts_kept_from_the_models(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs.filter(doc_hash() % language.CALIBRATE == 0)
    models = language.train(docs)
    assert all(len(m.keys[-1]) for m in language.train(kept.unionByName(docs)).values()) and not language.train(kept)
    excess = {}
    for r in language.predict(kept, models).collect():
        if r.excess is not None:
            excess.setdefault(r.lang_pred, []).append(math.ceil(round(r.excess * 100, 9)))
    want = {}
    for lang, x in excess.items():
        rank = math.ceil(0.9 * (len(x) + 1))
        if rank <= len(x):
            want[lang] = sorted(x)[rank - 1] / 100
    assert language.calibrate(docs, models, 0.9) == want and want
    assert not language.calibrate(docs, models, 0.9999)


def test_language_of_odd_rows(odd, empty):
    models = language.train(odd)
    got = language.predict(odd, models).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for i in (3, 4, 5):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert all(r.lang_pred in ("en", "de") and 0 <= r.score <= 1 for r in got if r.doc_id not in (3, 4, 5))
    assert language.predict(empty, models).collect() == []
    none = language.predict(odd, language.train(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.rated(docs, labels, doc_hash() % 4 != 2).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if not got[r.doc_id].learned]
    hit = sum(got[r.doc_id].score >= 0.3 for r in held if r.toxic)
    false = sum(got[r.doc_id].score >= 0.3 for r in held if not r.toxic)
    assert hit >= 0.85 * sum(r.toxic for r in held) and false <= 0.02 * len(held)


def test_toxicity_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.rated(odd, labels, doc_hash() % 4 != 2).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.rated(empty, labels, doc_hash() % 4 != 2).collect() == []
    assert len(toxicity.rated(odd, labels.limit(0), doc_hash() % 4 != 2).collect()) == odd.count()


def test_scores_equal_the_network_written_out():
    """Windows of one to three words, the largest activation of each filter over the text, one logistic output; word by word."""
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    net.e = rng.normal(0, 1, net.e.shape).astype(np.float32)
    texts = ["one two three one", "", "solo", "a longer text with é and 漢字, of several words; and more", "x y"]
    buf, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, first = toxicity.features(buf, off)
    got = net.score(ids, first)
    for i in range(len(texts)):
        x = net.e[ids[first[i] : first[i + 1]]].sum(1)
        z = float(net.c)
        for w, b, k, v in zip(net.w, net.b, toxicity.WIDTHS, net.v.reshape(len(toxicity.WIDTHS), -1)):
            best = np.zeros(toxicity.FILTERS)
            for s in range(len(x)):
                window = np.zeros((k, toxicity.DIM))
                window[: len(x[s : s + k])] = x[s : s + k]
                best = np.maximum(best, window.reshape(-1) @ w + b)
            z += float(best @ v)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert [int(n) for n in np.diff(first)] == [4, 0, 1, 12, 2]


def test_network_learns_a_word_wherever_it_stands():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(300):
        ids = rng.integers(100, 400, (30, 3)).astype(np.int32)
        if i % 3 == 0:
            ids[rng.integers(30), 0] = 7
        texts.append(ids)
        y.append(int(i % 3 == 0))
    net = toxicity.Network()
    net.fit(texts[:200], np.array(y[:200]))
    first = np.cumsum([0] + [len(t) for t in texts[200:]])
    score = net.score(np.concatenate(texts[200:]), first)
    assert ((score > 0.5) == np.array(y[200:], bool)).mean() > 0.95


def brute_backoff(rows):
    tokens = [(i, [low(w) for w in words(t)]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, w in tokens:
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    total, out = sum(one.values()), []

    def score(history, x):
        if len(history) == 2 and three[*history, x]:
            return three[*history, x] / two[history]
        if len(history) == 2:
            return 0.4 * score(history[1:], x)
        if len(history) == 1 and two[*history, x]:
            return two[*history, x] / one[history[0]]
        return 0.4 * score((), x) if history else one[x] / total

    for i, w in tokens:
        # a history that the text's start cuts short backs off as an unseen one does
        s = sum(math.log(0.4 ** max(0, 2 - k) * score(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w))
        out.append((i, len(w), max(0, len(w) - 2), round(s, 4)))
    return out


def backoff_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "dd", "é", "X"], k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(i, " ".join(rng.choices([f"w{j}" for j in range(400)], k=rng.randint(0, 8)))) for i in range(90, 200)]
    return rows + [(80, None), (81, " \n "), (82, "a b " * 4000), (83, "lone"), (84, "LONE"), (85, "a"), (86, "a b"), (0, "a b c"), (0, "a b c"), (0, "a b"), (None, "a b c"), (None, "lone")]


@pytest.mark.parametrize("least", [None, 1, 1 << 40])
def test_backoff_equals_brute_force(spark, least, monkeypatch):
    """With the usual number of frequent n-grams, with nearly all of them frequent, and with none."""
    if least:
        monkeypatch.setattr(backoff, "LEAST", least)
    rows = backoff_rows()
    got = backoff.scores(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, history string, part int").repartition(4)).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_trigrams, round(r.log_score, 4)) for r in got), key=str)
    assert found == sorted(brute_backoff(rows), key=str)


def test_a_frequent_trigram_is_not_sent(spark):
    docs = spark.createDataFrame([(i, "of the same " * 40 + f"x{i} y{i}") for i in range(60)], "doc_id long, text string")
    tables = spark.sparkContext.broadcast(backoff.frequent(docs))
    sent = sum(backoff._rows(docs, tables, p).count() for p in range(backoff.PASSES))
    assert len(tables.value.keys[1]) >= 3 and sent <= 60 * 5


def test_backoff_of_odd_rows(odd, empty):
    got = backoff.scores(odd).collect()
    assert len(got) == odd.count() and all((r.score is None) == (r.n_words == 0) for r in got)
    assert backoff.scores(empty).collect() == []
