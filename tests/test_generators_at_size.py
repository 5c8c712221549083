"""Generators whose work must not grow faster than their graphs."""

import hashlib
import math

import numpy as np
import pytest

from graphloom.operators import generate


def draw(*values):
    return int(hashlib.md5(",".join(map(str, values)).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize(("n", "p", "seed"), [(70, 0.2, 1), (41, 0.9, -3), (9, 1.0, 1), (9, 0.0, 1), (1, 0.5, 1), (0, 0.5, 1), (300, 1e-9, 2)])
def test_erdos_renyi_is_the_graph_of_its_gaps(spark, n, p, seed):
    want = set()
    for a in range(n if p else 0):
        at = a
        for k in range(1, n + 1):
            at += 1 if p == 1 else 1 + math.floor(math.log(max(draw(a, k, seed), 1) / 2**52) / math.log1p(-p))
            want |= {(a, at), (at, a)} if at < n else set()
    got = [tuple(r) for r in generate.erdos_renyi(spark, n, p, seed).collect()]
    assert len(got) == len(want) and set(got) == want


def test_erdos_renyi_has_more_tasks_for_more_pairs_and_shuffles_none(spark, monkeypatch):
    monkeypatch.setattr(generate, "DRAWN", 500)
    edges = generate.erdos_renyi(spark, 400, 0.5)
    sizes = edges.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 70 and max(sizes) < 4 * 500 and sum(sizes) == edges.count()
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_erdos_renyi_draws_a_node_piece_by_piece(monkeypatch):
    whole = np.concatenate(list(generate._ends(3, 5000, 0.3, 5000, 1)))
    monkeypatch.setattr(generate, "PIECE", 7)
    parts = list(generate._ends(3, 5000, 0.3, 5000, 1))
    assert max(map(len, parts)) <= 7 and np.array_equal(np.concatenate(parts), whole)
    assert sum(map(len, generate._ends(3, 5000, 0.3, 40, 1))) == 40  # no more draws than ``most``


@pytest.mark.parametrize("power", [0.0, 1.0, 2.0, 3.5])
def test_small_world_rings_are_those_of_the_listed_nodes(power):
    rng = np.random.default_rng(4)
    for side in range(1, 10):
        find, at = generate._rings(side, power), np.arange(side * side)
        u = np.r_[rng.random((20, side * side)), np.zeros((1, side * side)), np.full((1, side * side), 1 - 2.0**-52)]
        far = np.abs(at[:, None] // side - at // side) + np.abs(at[:, None] % side - at % side)
        count = np.array([np.bincount(row, minlength=2 * side) for row in far])[:, 1:]
        upto = np.cumsum(count * np.arange(1, 2 * side, dtype=float) ** -power, axis=1)
        for k, shares in enumerate(u):
            got = find(at, shares)
            if side == 1:
                assert (got == 0).all()
                continue
            assert (np.take_along_axis(count, got[:, None] - 1, 1) > 0).all()
            aim = shares * upto[:, -1]
            want = np.minimum((upto <= aim[:, None]).sum(axis=1) + 1, far.max(axis=1))
            near = np.abs(upto - aim[:, None]).min(axis=1) < 1e-9 * upto[:, -1]
            assert ((got == want) | near).all() and (k >= 20 or not near.any())


def test_small_world_of_a_million_nodes_chooses_quickly():
    find, node = generate._rings(1000, 2.0), np.arange(1_000_000)
    d = find(node, np.random.default_rng(1).random(len(node)))
    assert d.min() == 1 and d.max() > 500
