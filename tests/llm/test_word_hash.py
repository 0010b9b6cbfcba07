"""Different words have different hashes, regular ones too."""

import numpy as np
import pytest

from lakewright.llm import ngram_join


def sets(*texts, words=2):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return [s.tolist() for s in ngram_join.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, words)]


@pytest.mark.parametrize("k", [6, 10, 11, 12, 14])
def test_words_of_a_regular_pattern(k):
    bits = [i.bit_count() & 1 for i in range(1 << k)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    one, two, again = sets(f"x {a} y", f"x {b} y", f"X  {a.upper()}\ty")
    assert not set(one) & set(two) and one == again


def test_words_in_batches_of_any_shape():
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("ab\u00e9"), int(n))) for n in rng.integers(1, 700, 3000)})
    together = sets(*words, words=1)
    assert len({s[0] for s in together}) == len(words)
    assert together[::97] == [sets(w, words=1)[0] for w in words[::97]]
