"""Byte-level words and hashes against regular expressions."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute

from rangelake.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \t\n\x0b\r.é😀\u00a0\x00-", max_size=40)), max_size=8)


@settings(deadline=None, max_examples=200)
@given(TEXTS)
def test_words_and_hashes(texts):
    data, offsets = words.flat(pa.array(texts, pa.string()))
    for table, pattern, low in ((words.PLAIN, brute.PLAIN, False), (words.ALNUM, brute.ALNUM, True)):
        raw = words.LOWER[data] if low else data
        starts, ends, bounds = words.cut(raw, offsets, table)
        h = words.hashes(raw, starts, ends)
        found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        want = [pattern.findall((t or "").translate(brute.UPPER) if low else t or "") for t in texts]
        assert found == [w for ws in want for w in ws]
        assert np.diff(bounds).tolist() == [len(w) for w in want]
        assert len(set(h.tolist())) == len(set(found))
        assert words.characters(raw, starts, ends).tolist() == [len(w) for w in found]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7))
def test_window_hashes_name_sequences(values, n):
    h = words.mix(np.array(values, np.uint64) + np.uint64(7))
    windows = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    for got in (words.window_hashes(h, np.array([0, len(h)]), n)[0], words.rolling_hashes(h, n)):
        assert len(got) == len(windows)
        assert len(set(zip(got.tolist(), windows))) == len(set(got.tolist())) == len(set(windows))


def test_hashes_over_many_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abc"), rng.integers(1, 90))) for _ in range(300))
    data, offsets = words.flat(pa.array([text]))
    starts, ends, _ = words.cut(data, offsets)
    whole = words.hashes(data, starts, ends)
    rolled = words.rolling_hashes(whole, 35)
    monkeypatch.setattr(words, "HASH_BYTES", 64)
    assert (words.hashes(data, starts, ends) == whole).all()
    assert (words.rolling_hashes(whole, 35) == rolled).all()


def test_slices_of_arrow_arrays():
    column = pa.array(["skip", "a bc", None, "", "d"])[1:]
    data, offsets = words.flat(column)
    assert data.tobytes() == b"a bcd" and offsets.tolist() == [0, 4, 4, 4, 5]
    assert words.flat(pa.array([], pa.string()))[1].tolist() == [0]
    assert words.flat(pa.array([None], pa.string()))[1].tolist() == [0, 0]
