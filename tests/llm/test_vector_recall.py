"""Recall of the probes against brute force, with and without the chance of a miss, and the pairs they try."""

import numpy as np
import pytest

from tallyloom.llm import embedding_dedup


def vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 64))
    copies = rng.integers(0, n, n // 4)
    near = x[copies] + rng.normal(size=(len(copies), 64)) * np.linalg.norm(x[copies], axis=1)[:, None] / 8 * rng.uniform(0.05, 0.22, (len(copies), 1))
    return np.concatenate([x, near]).astype(np.float32)


@pytest.mark.parametrize("missed", [0.0, 1e-5])
def test_links_against_brute_force(spark, missed):
    x = vectors(2400, 1)
    rows = [(i, v.tolist(), i % 2, "clash", 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list string, id int").repartition(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.similar_vectors(df, missed=missed).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 300 and (found <= want).all()
    assert found.sum() == want.sum() if missed == 0 else found.sum() >= 0.99 * want.sum()


def test_few_lists_are_probed_and_no_larger_a_share_as_lists_grow():
    shares = []
    for n in (1000, 16000):
        x = embedding_dedup._units(list(vectors(n, 2)), 64)
        model = embedding_dedup.Quantiser.fit(x[: 4 * n // 5], int(n**0.5), subspaces=8, codes=16, rounds=4)
        shares.append(model.probes(x, 0.12)[1].mean())
    assert shares[1] <= shares[0] < 0.1
