import numpy as np
import pyarrow as pa
import pytest
import xxhash

from murmura.llm import kernels as K
from murmura.llm.run_index import RunIndex


def test_layout_handles_nulls_slices_and_empty():
    a = pa.array(["ab", None, "", "ç"])
    buf, off = K.layout(a)
    assert off.tolist() == [0, 2, 2, 2, 4] and buf.tobytes().decode() == "abç"
    buf, off = K.layout(a.slice(2, 2))
    assert off.tolist() == [0, 0, 2] and buf.tobytes().decode() == "ç"
    assert K.layout(pa.array([], pa.string()))[1].tolist() == [0]


def test_runs_stop_at_text_ends():
    on = np.array([1, 1, 1, 0, 1], bool)
    s, e, first = K.runs(on, np.array([0, 2, 2, 5]))
    assert s.tolist() == [0, 2, 4] and e.tolist() == [2, 3, 5] and first.tolist() == [0, 1, 1, 3]


@pytest.mark.parametrize("seed", [0, 42])
def test_xxh64_equals_the_library(seed):
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    size = np.array([0, 1, 3, 4, 7, 8, 11, 12, 31, 32, 33, 63, 64, 65, 100, 1000])
    start = np.arange(len(size)) * 17
    got = K.xxh64(data, start, size, seed)
    assert [int(x) for x in got] == [xxhash.xxh64(data[s : s + n].tobytes(), seed=seed).intdigest() for s, n in zip(start, size)]


def test_bit_counts_over_many_and_no_hashes():
    h = np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)
    got = K.bit_counts(h, np.array([0, 0, 700, 1000]))
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert (got == np.stack([bits[:0].sum(0), bits[:700].sum(0), bits[700:].sum(0)])).all()


def test_code_points():
    text = "aé漢🙂z"
    cp, off = K.code_points(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert cp.tolist() == [ord("a"), ord("é"), ord("漢"), 0xFFFF, ord("z")] and off.tolist() == [0, 5]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh ", bytes(range(1, 256)), b"a"])
def test_run_index_finds_the_least_holder_of_each_window(alphabet):
    rng = np.random.default_rng(len(alphabet))
    for _ in range(15):
        base = bytes(rng.choice(list(alphabet), 400).astype(np.uint8))
        cut = [(int(i), int(n)) for i, n in zip(rng.integers(0, 300, 20), rng.integers(50, 96, 20))]
        strings = sorted({base[i : i + n] for i, n in cut})
        numbers = rng.integers(0, 9, len(strings))
        data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        got = RunIndex(data, sizes, numbers).least(data, sizes)
        want = [min(n for t, n in zip(strings, numbers) if s[i : i + 50] in t) for s in strings for i in range(len(s) - 49)]
        assert got.tolist() == want


def test_packed_hashes_come_back():
    from murmura.llm.blocks import packed_hashes, unpacked_hashes

    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.unique(np.append(keys, [np.uint64(0), np.uint64((1 << 64) - 1)]))
    for b in (0, 6):
        own = keys[keys % np.uint64(7) == b]
        assert (unpacked_hashes(packed_hashes(own, b, 7), b, 7) == own).all()
    assert len(unpacked_hashes(packed_hashes(keys[:0], 3, 7), 3, 7)) == 0
