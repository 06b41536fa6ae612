"""Forests evaluated by masks of leaves."""

import time

import numpy as np

from thicket.operators import traces as tr


def grown(rng, splits):
    """(node, var, thr, leaf) of a random tree over 4 features."""
    leaves, out = [0], []
    for _ in range(splits):
        node = leaves.pop(int(rng.integers(len(leaves))))
        out.append((node, int(rng.integers(4)), float(rng.integers(9)) / 9, 0.0))
        leaves += [2 * node + 1, 2 * node + 2]
    return sorted(out + [(k, -1, 0.0, float(rng.normal())) for k in leaves])


def packed(trees):
    nodes = [(t, *n) for t, own in enumerate(trees) for n in own]
    of, node, var, thr, leaf = (np.array(c) for c in zip(*nodes, strict=True))
    return tr.PackedForest(tr.pack_forest(of, node, var, thr, leaf))


def test_masks_give_what_a_walk_gives(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (700, 4)) / 9.0 + rng.choice([0.0, 0.01], (700, 4))
    x[::50, 1], x[1::50, 2] = np.nan, np.inf
    for splits in ([0, 1, 5, 30], [61, 62, 100], [12] * 8, [0]):
        forest = packed([grown(rng, k) for k in splits])
        masks = forest(x)
        monkeypatch.setattr(tr, "MANY_ROWS", 10**9)
        assert masks.tolist() == forest(x).tolist()
        monkeypatch.undo()


def test_masks_are_quicker(monkeypatch):
    rng = np.random.default_rng(2)
    forest, x = packed([grown(rng, 24) for _ in range(20)]), rng.random((10_000, 4))
    took = []
    for rows in (10**9, 512):
        monkeypatch.setattr(tr, "MANY_ROWS", rows)
        begun = time.perf_counter()
        for _ in range(3):
            forest(x)
        took.append(time.perf_counter() - begun)
    print(took)
    assert took[1] < took[0] / 2
