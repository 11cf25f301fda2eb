import random

import numpy as np
import pytest

from carelane.llm import components as C
from carelane.llm.components import components


def brute(edges):
    least = {}
    for t, a, b in edges:
        least.setdefault((t, a), a)
        least.setdefault((t, b), b)
    for _ in range(len(least) + 1):
        for t, a, b in edges:
            least[t, a] = least[t, b] = min(least[t, a], least[t, b])
    return sorted((t, n, r) for (t, n), r in least.items() if n != r)


def case(kind):
    rng = random.Random(kind)
    if kind == "path":
        ids = rng.sample(range(1000), 40)
        return [(0, a, b) for a, b in zip(ids, ids[1:], strict=False)]
    if kind == "hub":
        return [(0, 7, k) for k in range(-60, 60)] + [(0, 7, 7)]
    if kind == "two graphs":
        return [(t, rng.randrange(60), rng.randrange(60)) for t in (0, 1) for _ in range(40)] * 2
    return []


@pytest.mark.parametrize("run", [1, 7, 2_000_000])
@pytest.mark.parametrize("kind", ["path", "hub", "two graphs", "none"])
def test_components(spark, monkeypatch, kind, run):
    monkeypatch.setattr(C, "RUN_EDGES", run)
    edges = case(kind)
    got = components(spark.createDataFrame(edges, "tag int, a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == brute(edges)


def test_stars_of_random_edges():
    rng = np.random.default_rng(1)
    for n in (1, 5, 50, 400):
        a, b = rng.integers(0, n + 1, n), rng.integers(0, n + 1, n)
        far, near = C._stars(a, b)
        assert sorted(zip([0] * len(far), far.tolist(), near.tolist(), strict=True)) == brute([(0, int(x), int(y)) for x, y in zip(a, b, strict=True)])
    path = rng.permutation(5000)
    far, near = C._stars(path[1:], path[:-1])
    assert len(far) == 4999 and set(near.tolist()) == {0}
