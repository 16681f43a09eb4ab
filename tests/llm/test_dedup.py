import hashlib
import random
import re

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from murmura.llm import simhash, suffix_dedup
from murmura.llm.components import components
from murmura.llm.run_index import RunIndex


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def fingerprint(t, k):
    w = words(t)
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(spark, seed=3):
    """Texts with near copies at one to four changed words, chains among them."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    rows = []
    for g in range(12):
        w = rng.choices(vocabulary, k=rng.choice([5, 40, 120, 400]))
        for _ in range(rng.choice([1, 3, 6])):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
    return rows


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_links_equal_brute_force(spark):
    rows = near(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3).collect()}
    prints = {i: fingerprint(t, 3) for i, t in rows}
    assert {i: r.fingerprint % (1 << 64) for i, r in got.items()} == prints
    want = brute_components(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_of_two_bits_across_all_segments(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(3):
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    edges = simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(signed, lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 2)
    assert all(got.get(p, p) == want[p] for p in signed)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd, words=3).collect()
    assert len(got) == odd.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r)
    assert of[0].component_id == of[1].component_id == of[None].component_id == 0
    assert of[3].fingerprint == of[4].fingerprint == of[5].fingerprint == 0 and of[5].component_id == 3
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.similar_groups(empty).collect() == []
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(odd).collect()}
    assert groups[1] == 0 and groups[3] == 3 and groups[4] == 3 and groups[50] == 0


def test_similar_groups_find_pairs_over_the_bound(spark):
    rows = near(spark, 8)
    sets = {i: {" ".join(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in rows}
    want = brute_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 0.05 * len(want)
    assert all(want[i] == want[got[i]] for i in want)  # nothing is linked that brute force does not link


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def marked(rows):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and seen[b[k : k + 50]] < i:
                m[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, m) if not x)
        out[i] = (len(b), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("kind", ["prose", "periodic", "bytes"])
def test_repeated_spans_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    letters = {"prose": "abcdefgh   ", "periodic": "ab", "bytes": "aé漢🙂 "}[kind]
    pool = ["".join(rng.choices(letters, k=rng.randint(20, 160))) for _ in range(15)] + ["a" * 300, "ab" * 100]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(letters) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x" * 49), (63, "x" * 50), (64, "x" * 51)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == marked(rows)


def brute_statistics(text, strings):
    """For each byte: the longest prefix of what follows that some string holds."""
    out = []
    for i in range(len(text)):
        n = 0
        while i + n < len(text) and any(text[i : i + n + 1] in s for s in strings):
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "a"])
def test_matching_statistics_of_foreign_strings(letters):
    rng = random.Random(letters)
    pool = ["".join(rng.choices(letters, k=rng.randint(10, 40))) for _ in range(12)]
    strings = sorted({"".join(rng.choices(pool, k=3))[: rng.randint(50, 95)].ljust(50, letters[0]) for _ in range(30)})
    asked = ["".join(rng.choices(pool, k=2)) + rng.choice(["", "z", "y"]) + "".join(rng.choices(letters, k=12)) for _ in range(40)] + strings[:5] + ["zzz", ""]
    raw = np.frombuffer("".join(strings).encode(), np.uint8)
    index = RunIndex(raw, np.array([len(s) for s in strings]), np.arange(len(strings)) + 10)
    sizes = np.array([len(s) for s in asked])
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    length, place = index.matching_statistics(data, sizes)
    assert length.tolist() == [n for s in asked for n in brute_statistics(s, strings)]
    joined = "\0".join(strings) + "\0"
    whole = "".join(asked)
    assert all(joined[p : p + n] == whole[i : i + n] for i, (n, p) in enumerate(zip(length, place)) if n)
    want = [min((k + 10 for k, s in enumerate(strings) if a[i : i + 50] in s), default=-1) for a in asked for i in range(len(a) - 49)]
    assert index.least(data, sizes).tolist() == want


@pytest.mark.parametrize("hot", [1, 8])
def test_windows_of_hot_anchors_go_apart(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    notice = "all rights reserved, see the terms of use that came with this copy of it. "
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    pool = [prose(90) for _ in range(6)]
    rows = [(i, prose(rng.randint(0, 60)) + notice + rng.choice(pool) + prose(rng.randint(0, 60)) + rng.choice(["", notice])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == marked(rows)


def test_one_notice_amid_varied_texts_fills_no_bucket(spark):
    import pyarrow as pa

    rng = random.Random(1)
    notice = "this notice of sixty-four bytes stands somewhere in every text..."[:64]
    rows = [(i, "".join(rng.choices("abcdefghijklmnop ", k=60)) + notice + "".join(rng.choices("abcdefghijklmnop ", k=60))) for i in range(20000)]
    buckets, bytes_in, sent, found = 128, {}, [], []
    tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "block": pa.array([b] * len(part), pa.int32())}) for b, part in enumerate(rows[k::8] for k in range(8))]
    sent = pa.concat_tables([suffix_dedup._send_anchors(t, buckets) for t in tables])
    replies = pa.concat_tables([suffix_dedup._find_repeated(sent.filter(pa.compute.equal(sent["bucket"], b)), buckets) for b in range(buckets)])
    again = pa.concat_tables([suffix_dedup._send_segments(t, replies.filter(pa.compute.equal(replies["block"], b)), buckets) for b, t in enumerate(tables)])
    for b, sizes in zip(again["bucket"].to_pylist(), again["sizes"].to_pylist()):
        bytes_in[b] = bytes_in.get(b, 0) + int(np.frombuffer(sizes, np.uint8).astype(int).sum())
    assert len(bytes_in) == buckets and max(bytes_in.values()) <= 0.02 * sum(bytes_in.values())
    found = pa.concat_tables([suffix_dedup._index_bucket(again.filter(pa.compute.equal(again["bucket"], b))) for b in range(buckets)])
    marks = [suffix_dedup._mark(t, found.filter(pa.compute.equal(found["block"], b))) for b, t in enumerate(tables)]
    removed = {i: n for m in marks for i, n in zip(m["doc_id"].to_pylist(), m["n_removed"].to_pylist())}
    assert removed[0] == 0 and all(64 <= n <= 80 for i, n in removed.items() if i)


def test_repeated_spans_of_odd_rows(odd, empty):
    got = suffix_dedup.repeated_spans(odd, with_kept=True).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == by[1][0].n_bytes and by[1][0].kept == b""
    assert [r.n_removed for r in by[0]] == [0, 0] and by[None][0].n_removed == 0 and by[4][0].n_bytes == 0
    assert suffix_dedup.repeated_spans(empty).collect() == []


def test_similar_groups_join_a_star_whose_centre_has_the_largest_id(spark):
    rng = random.Random(5)
    centre = [f"c{j}" for j in range(604)]
    rows = [(9999, centre)]
    for i in range(2000):
        at = set(rng.sample(range(604), 11))
        rows.append((i, [f"x{i}y{j}" if j in at else w for j, w in enumerate(centre)]))
    sets = {i: {tuple(t[k : k + 5]) for k in range(600)} for i, t in rows}
    assert all(len(sets[9999] & s) >= 0.8 * len(sets[9999] | s) for s in sets.values())
    assert all(len(sets[i] & sets[i + 1]) < 0.8 * len(sets[i] | sets[i + 1]) for i in range(1999))
    given = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_groups(given).collect()} == {0}


def test_similar_groups_miss_no_pair_just_over_the_bound(spark):
    rows = []
    for i in range(500):  # 178 of 222 shingles in common, then 177 of 223
        for j, changed in ((0, 0), (1, 22)) if i < 400 else ((0, 0), (1, 23)):
            rows.append((2 * i + j, " ".join([f"d{i}w{k}" for k in range(204 - changed)] + [f"e{i}w{k}" for k in range(changed)])))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n - n % 2 if n < 800 else n for n in range(1000)}


def test_similar_groups_join_pairs_behind_a_crowded_shingle(spark):
    """600 unlike texts of one template with small ids, and 200 pairs of that template at a similarity of 0.86 behind them."""
    rng = random.Random(2)
    template = [f"t{j}" for j in range(120)]
    rows = [(i, template + [f"a{i}w{j}" for j in range(120)]) for i in range(600)]
    for i in range(200):
        own = [f"b{i}w{j}" for j in range(120)]
        other = list(own)
        at = rng.randrange(10, 100)
        other[at : at + 14] = [f"c{i}w{j}" for j in range(14)]
        rows += [(1000 + 2 * i, template + own), (1001 + 2 * i, template + other)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert all(got[i] == i for i in range(600))
    assert sum(got[1001 + 2 * i] == 1000 + 2 * i for i in range(200)) == 200


def test_rows_that_repeat_nothing_need_no_block(spark):
    rows = [(None, None)] * 50 + [(None, "x" * 60)] * 3 + [(1, "short")] * 20 + [(2, "y" * 60), (3, "y" * 60), (None, "y" * 60)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id int, text string"), with_kept=True).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_removed for r in got} == {None: 0, 1: 0, 2: 0, 3: 60}
    assert sorted(bytes(r.kept) for r in got if r.doc_id is None)[-1] == b"y" * 60


def test_keep_one_judges_rows_by_their_own_text(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, 1), (2, a + " more", 2), (2, " ".join(f"b{i}" for i in range(60)), 3), (None, a, 4), (3, "", 5), (4, None, 6), (5, " ", 7), (1, a, 8)]
    given = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    assert sorted(r.mark for r in simhash.keep_one(given).collect()) == [1, 3, 4, 5, 7, 8]


def test_near_dedup_links_by_fingerprints_before_the_set_join(spark, monkeypatch):
    """Confirmed links of fingerprints are there from the start, those of unlike sets are not; with the trees finding nothing they are all that is left, with them the groups are exact."""
    rng = random.Random(11)
    rows = near(spark, 5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for k in range(6):  # one word in 400 changes few bits
        rows.append((len(rows), " ".join(long[:-1] + [f"z{k}"])))
    # repeats settle the bits, and the sets are unlike
    rows += [(len(rows) + k, " ".join(["a b c d e"] * 200 + [f"q{k}x{j}" for j in range(9)])) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words(t)) for i, t in rows)}
    prints = {i: fingerprint(t, 5) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    assert close(len(rows) - 2, len(rows) - 1) and not alike(len(rows) - 2, len(rows) - 1)
    exact = brute_components(list(sets), alike)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == exact
    monkeypatch.setattr(simhash.jaccard, "_linked", lambda parts, percent: parts.select("id", parts.id.alias("root")).limit(0))
    first = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    both = brute_components(list(sets), lambda a, b: alike(a, b) and close(a, b))
    equal = brute_components(list(sets), lambda a, b: sets[a] == sets[b])
    assert len(set(both.values())) <= len(set(first.values())) < len(set(equal.values()))
    assert all(exact[i] == exact[first[i]] for i in first)  # no link of fingerprints joins what the sets do not
