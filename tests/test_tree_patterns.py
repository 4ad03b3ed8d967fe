"""rows that a leaf cannot tell apart are worked out once."""

import numpy as np

from scorelens.operators import treeshap as TS


def grown(rng, depth, features):
    """A full tree of random splits; half of its leaves have value 0."""
    n = 2 ** (depth + 1) - 1
    inner = 2 ** depth - 1
    cover = np.zeros(n)
    cover[inner:] = rng.integers(0, 9, n - inner)  # some leaves saw no row
    for i in range(inner - 1, -1, -1):
        cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
    at = np.arange(n)
    return {"left": np.where(at < inner, 2 * at + 1, -1), "right": np.where(at < inner, 2 * at + 2, -1),
            "feature": np.where(at < inner, rng.integers(0, features, n), -1), "threshold": rng.normal(size=n),
            "value": np.where(at < inner, 0.5, rng.integers(0, 2, n) * rng.random(n)), "cover": cover}


def test_equal_patterns_are_worked_out_once(monkeypatch):
    rng = np.random.default_rng(7)
    tree = grown(rng, 6, 5)
    edges, few = TS.leaf_paths(tree), rng.normal(size=(5, 5))
    sizes, shares = [], TS._shares
    monkeypatch.setattr(TS, "_shares", lambda codes, z, value: (sizes.append(len(codes)), shares(codes, z, value))[1])
    phi = np.zeros((1000, 5))
    TS.add_attributions(np.tile(few, (200, 1)), edges, phi, 1.0)
    n_leaves = sum(len(a) for a, _ in edges["leaves"].values())
    assert sum(sizes) <= 5 * n_leaves and n_leaves < 64  # leaves of value 0 are not looked at
    alone = np.zeros((5, 5))
    for row in range(5):
        TS.add_attributions(few[row:row + 1], edges, alone[row:row + 1], 1.0)
    assert np.allclose(phi, np.tile(alone, (200, 1)), atol=1e-12)
    whole = tree["cover"][0]
    mean = sum(tree["cover"][i] / whole * tree["value"][i] for i in range(63, 127))
    assert np.allclose(mean + alone.sum(1), TS.leaf_values(few, tree), atol=1e-9) or (tree["cover"][63:] == 0).any()


def test_long_paths_and_small_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(8)
    edges, x = TS.leaf_paths(grown(rng, 9, 40)), rng.normal(size=(7, 40))
    assert max(edges["leaves"]) >= 8 and 2 ** max(edges["leaves"]) > 4 * len(x)  # both ways of finding patterns
    one, two = np.zeros(x.shape), np.zeros(x.shape)
    TS.add_attributions(x, edges, one, 0.5)
    monkeypatch.setattr(TS, "CELLS", 20)
    monkeypatch.setattr(TS, "ROWS", 3)
    TS.add_attributions(x, edges, two, 0.5)
    assert np.abs(one).max() > 0 and np.allclose(one, two, atol=1e-14)
