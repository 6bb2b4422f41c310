"""Labels of small groups: the same as from all pairs, without holding all pairs."""

import tracemalloc

import numpy as np
import pytest

from rangelake.operators import cluster as cu


def from_all_pairs(x, radius, min_samples):
    with np.errstate(invalid="ignore"):
        near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= radius * radius
    core = near.sum(axis=1) >= min_samples
    root = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        root = np.where(core, np.minimum(root, np.where(near & core, root, len(x)).min(axis=1, initial=len(x))), len(x))
    reached = np.where(near & core, root, len(x)).min(axis=1, initial=len(x))
    return np.where(reached < len(x), np.searchsorted(np.unique(root[core]), reached), -1)


@pytest.mark.filterwarnings("ignore:invalid value")
@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_labels_equal_those_of_all_pairs(dims):
    rng = np.random.default_rng(dims)
    for size in (0, 1, 2, 7, 40, 150):
        for step in (1.0, 0.5, 0.1):
            x = np.round(rng.uniform(-4, 4, (size, dims)) / step) * step  # many equal places, many at the radius
            x[rng.random(size) < 0.05] = 1e16
            x[rng.random(size) < 0.03, 0] = np.inf
            for radius, least in ((0.5, 1), (1.0, 2), (0.3, 3), (1.118, 4), (0.0, 2)):
                assert cu._labels(x, radius, least).tolist() == from_all_pairs(x, radius, least).tolist()


def test_labels_of_a_long_chain():
    x = np.random.default_rng(1).permutation(1024)[:, None].astype(float)
    assert set(cu._labels(x, 1.0, 2).tolist()) == {0}


def test_spread_points_hold_few_pairs():
    x = np.random.default_rng(2).uniform(0, 1000, (1024, 3))
    tracemalloc.start()
    cu._labels(x, 1.0, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20
