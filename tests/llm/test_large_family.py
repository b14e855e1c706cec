"""The n-gram join on one large family of near copies, and the parity maps that sort out pairs."""

import random

import numpy as np

from tallyloom.llm import ngram_join
from tests.llm.fixtures import table


def test_a_family_of_five_thousand_sets_is_one_component_with_all_its_links(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = []
    for i in range(5000):
        words = list(base)
        words[i % 60] = f"x{i}"  # those of one place differ in one word, others in two
        texts.append(" ".join(words))
    rows = [(i, t, None, None, 1, "x", "y", "z", 1, False, "q") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in ngram_join.similar_sets(table(spark, rows), words=3, percent=80).collect()}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    assert len(got) == 5000 and {r["component_id"] for r in got.values()} == {0}
    for i in (0, 1, 30, 59, 2500, 4999):
        assert got[i]["n_links"] == sum(100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for s in sets) - 1


def test_parity_maps_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(2)
    pop = lambda a: sum(int(x).bit_count() for x in a)
    for size in (1, 60, 500, 512, 513, 1030, 5000):
        all_ = np.unique(rng.integers(0, 1 << 64, 2 * size, np.uint64))
        one, two = all_[:size], all_[size // 10 : size + size // 10]
        a, b = ngram_join._parity(one), ngram_join._parity(two)
        while len(a) != len(b):
            a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
        assert pop(a ^ b) <= len(np.setxor1d(one, two))
        assert 64 * len(ngram_join._parity(one)) >= len(one)
