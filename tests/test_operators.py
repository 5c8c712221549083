"""Kernels against numpy, invariants and round trips."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import admm, assignment, blocks, components, evaluate, generate, graph, objective, pnorm, primal_dual, projection, support
from graphloom.sources import readers, writers
from graphloom.streaming import partitioner


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_simplex_is_feasible_and_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 6))
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(4) for j in range(6)], "u int, v int, x double")
    y = projection.simplex(df, "u", "x", "q").toPandas().pivot(index="u", columns="v", values="q").to_numpy()
    assert (y >= 0).all() and np.allclose(y.sum(axis=1), 1)
    for row, got in zip(x, y):
        s = np.sort(row)[::-1]
        theta = ((np.cumsum(s) - 1) / np.arange(1, 7)).max()
        assert np.allclose(got, np.maximum(row - theta, 0))


def dense_prox(n, p, rho):
    """Prox of the p-norm by bisection in bisection."""
    if p == 1:
        return np.sign(n) * np.maximum(np.abs(n) - 1 / rho, 0)
    a = np.abs(n) * rho
    if (a ** (p / (p - 1))).sum() <= 1:
        return np.zeros_like(n)

    def roots(norm):
        lo, hi = np.zeros_like(a), a.copy()
        for _ in range(80):
            mid = (lo + hi) / 2
            low = mid + norm ** (1 - p) * mid ** (p - 1) < a
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return (lo + hi) / 2

    lo, hi = 0.0, float((a**p).sum() ** (1 / p))
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (roots(mid) ** p).sum() ** (1 / p) > mid else (lo, mid)
    return np.sign(n) * roots((lo + hi) / 2) / rho


def dense_split(d, zbar, y, ups, x, p, rho, rho_in, rounds):
    """The p-norm step with Y split off, on dense matrices: dual ascent, prox, least squares."""
    for _ in range(rounds):
        ups = ups + y - d @ x
        y = dense_prox(d @ x - ups, p, rho_in)
        x = np.linalg.solve(rho * np.eye(d.shape[1]) + rho_in * d.T @ d, rho * zbar + rho_in * d.T @ (y + ups))
    return x, y, ups


@pytest.mark.parametrize("p", [1, 1.5, 2, 3])
def test_dense_prox_is_a_minimum(p):
    rng = np.random.default_rng(1)
    n, rho = rng.normal(size=5) * 2, 1.3
    y = dense_prox(n, p, rho)
    cost = lambda v: np.linalg.norm(v, p) + rho / 2 * ((v - n) ** 2).sum()
    assert all(cost(y) <= cost(y + 1e-3 * rng.normal(size=5)) + 1e-9 for _ in range(200))


@pytest.mark.parametrize("p", [1.2, 1.5, 2.5, 4.0])
def test_prox_p_matches_the_dense_kernel(spark, p):
    n = np.array([1.5, -0.7, 0.0, 2.0, -1e-5, 90.0])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(n)], "key int, n double")
    got = projection.prox_p(df, "n", p, 1.3).orderBy("key").toPandas()["y"].to_numpy()
    assert np.allclose(got, dense_prox(n, p, 1.3), atol=1e-9)
    assert projection.prox_p(df.where("abs(n) < 0.001"), "n", p, 1.3).agg(F.max(F.abs("y"))).first()[0] == 0
    assert projection.prox_p(df.where("n > 1000"), "n", p, 1.3).count() == 0
    with pytest.raises(ValueError, match="exceed"):
        projection.prox_p(df, "n", 1.0, 1.3)


def test_block_solvers_agree_with_closed_forms():
    rng = np.random.default_rng(2)
    d, zbar, rho = rng.integers(-1, 2, size=(3, 6)).astype(float), rng.normal(size=6), 1.7
    x = blocks.solve_l2(d, zbar, rho)
    assert np.allclose(d.T @ d @ x + rho * (x - zbar), 0)
    x = blocks.solve_l1(d, zbar, rho)
    cost = lambda v: np.abs(d @ v).sum() + rho / 2 * ((v - zbar) ** 2).sum()
    assert all(cost(x) <= cost(x + 1e-3 * rng.normal(size=6)) + 1e-9 for _ in range(300))
    a = np.array([[1.0, -1.0, 1.0]])
    z = rng.normal(size=3)
    assert np.allclose(blocks.solve_l1(a, z, rho), z - a[0] / rho * np.clip(rho * (a[0] @ z) / 3, -1, 1))


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for n in (1, 3, 6):
        c = rng.integers(0, 20, size=(n, n)).astype(float)
        got = assignment.assign(c)
        assert sorted(got) == list(range(n))
        assert c[np.arange(n), got].sum() == min(c[np.arange(n), list(p)].sum() for p in permutations(range(n)))


def test_walks_are_matrix_powers(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (0, 2), (3, 0)]
    a = np.zeros((4, 4), int)
    for u, v in pairs:
        a[u, v] = 1
    got = graph.walk_counts(edges(spark, pairs), 3).orderBy("node").toPandas()
    for r in (1, 2, 3):
        m = np.linalg.matrix_power(a, r)
        assert got[f"w{r}"].tolist() == m.sum(axis=1).tolist() and got[f"c{r}"].tolist() == np.diag(m).tolist()


def test_pagerank_exact_keeps_sources(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 1)])
    plain = {r.node: r.score for r in graph.pagerank(e, rounds=3, eps=0).collect()}
    exact = {r.node: r.score for r in graph.pagerank(e, rounds=3, eps=0, exact=True).collect()}
    assert plain[0] == exact[0] == pytest.approx(0.05) and exact[1] > plain[1]


def test_degree_band_equals_expansion_of_both_sides(spark):
    e1, e2 = generate.star(spark, 5), generate.grid(spark, 3, 3)
    d1 = {r.node: r.deg for r in graph.degree_counts(e1).collect()}
    d2 = {r.node: r.deg for r in graph.degree_counts(e2).collect()}
    got = {tuple(r) for r in support.by_degree(e1, e2, 1).collect()}
    assert got == {(u, v) for u in d1 for v in d2 if abs(d1[u] - d2[v]) <= 2}


def test_empty_graph(spark):
    none = edges(spark, [])
    assert graph.pagerank(none).count() == graph.ring_sizes(none, 3).count() == graph.wl_colors(none, 2).count() == 0


def test_alignment_recovers_a_permutation(spark):
    e1 = generate.balanced_tree(spark, 2, 2)
    mapping = spark.createDataFrame([(i, (3 * i + 2) % 7) for i in range(7)], "u long, v long")
    e2 = generate.relabel(e1, mapping)
    sup = support.by_wl(e1, e2, 3)
    t = objective.terms(e1, e2, sup)
    assert objective.violations(t, e1, e2, sup).first()[0] == 0
    state = admm.align(admm.initial(sup, t, 7), 3)
    sums = admm.simplex_condition(state["z"], "u").first()
    assert 0.3 < sums[0] <= sums[1] < 1.7
    best = assignment.assignment(state["z"], "z", maximise=True)
    assert best.count() == 7 and best.join(sup, ["u", "v"], "left_anti").isEmpty()


def test_state_is_saved_and_resumed(spark, tmp_path):
    e = generate.cycle(spark, 4)
    sup = support.all_pairs(e, e)
    t = objective.terms(e, e, sup)
    one = admm.align(admm.initial(sup, t, 4), 1)
    admm.save(one, str(tmp_path))
    a = admm.align(admm.resume(spark, str(tmp_path)), 1)["z"].toPandas().sort_values(["u", "v"])["z"].to_numpy()
    b = admm.align(admm.initial(sup, t, 4), 2)["z"].toPandas().sort_values(["u", "v"])["z"].to_numpy()
    assert np.allclose(a, b)


def test_adaptive_penalties_and_linear_cost(spark):
    e = generate.cycle(spark, 4)
    sup = support.all_pairs(e, e)
    o = admm.Options(adapt=True, lam=0.5)
    cost = spark.createDataFrame([(0, 0, 1.0)], "u long, v long, d double")
    admm.align(admm.initial(sup, objective.terms(e, e, sup), 4, cost, o), 2, o)
    assert len(o.trace) == 2 and {"pres", "qres", "tres", "dual"} <= set(o.trace[0])


def test_generators(spark):
    def size(g):
        assert g.join(graph.reverse(g), ["src", "dst"], "left_anti").isEmpty()
        return graph.nodes(g).count(), g.count() // 2

    assert size(generate.cycle(spark, 5)) == (5, 5)
    assert size(generate.star(spark, 5)) == (6, 5)
    assert size(generate.grid(spark, 3, 4)) == (12, 17)
    assert size(generate.balanced_tree(spark, 2, 3)) == (15, 14)
    assert size(generate.circular_ladder(spark, 4)) == (8, 12)
    assert size(generate.lollipop(spark, 4, 3)) == (7, 9)
    assert size(generate.hypercube(spark, 4)) == (16, 32)
    assert size(generate.expander(spark, 4))[0] == 16
    assert size(generate.barabasi_albert(spark, 20, 2))[0] == 20
    assert size(generate.regular(spark, 10, 3)) == (10, 15)
    assert size(generate.powerlaw_tree(spark, 12)) == (12, 11)
    assert size(generate.watts_strogatz(spark, 20, 4, 0.1))[0] == 20
    assert graph.nodes(generate.small_world(spark, 4)).count() == 16
    n, m = size(generate.erdos_renyi(spark, 300, 0.1))
    assert n == 300 and 3900 < m < 5100
    assert size(generate.erdos_renyi(spark, 30, 0.1, sparse=True, with_cycle=True))[0] == 30


def test_perturbations(spark):
    e = generate.erdos_renyi(spark, 60, 0.2)
    assert generate.perturb(e, 1.0, 60).exceptAll(e).isEmpty()
    kept = generate.perturb(e, 0.9, 60).count()
    assert 0.8 * e.count() < kept
    off = generate.disturb(e, spark.createDataFrame([(3,)], "node long"))
    assert off.where("src = 3").count() == graph.nodes(e).count() - 1
    w = generate.noise(e, "mix").toPandas()
    back = w.merge(w, left_on=["i", "j"], right_on=["j", "i"])
    assert (back.w_x == back.w_y).all() and w.w.nunique() > 100
    p = generate.permutation(e)
    assert p.select("v").distinct().count() == p.count() == 60


def test_partition_and_walks(spark):
    bip = spark.createDataFrame([(l, r) for l in range(8) for r in range(4) if l // 4 == r // 2], "l long, r long")
    left = {r.node: r.part_id for r in partitioner.stream_partition(bip, 2, lambda x: 0.5 * x * x).collect()}
    assert set(left) == set(range(8))
    right = partitioner.partition_right(bip, spark.createDataFrame(list(left.items()), "node long, part_id int"))
    assert right.count() == 4
    e = generate.cycle(spark, 6)
    walks = graph.random_walks(e, graph.nodes(e), 3, 2)
    assert walks.count() == 6 * 2 * 4


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.merge_maps(F.expr("map('a', 1D)"), F.expr("map('a', 2D, 'b', 3D)")).alias("m"),
        scalars.scale_map(F.expr("map('a', 2D)"), 0.5).alias("s"), scalars.append(F.array(F.lit(1)), F.lit(None).cast("int")).alias("a"),
        scalars.present(F.lit(None).cast("int"), F.lit(2)).alias("p"), *[x.alias(f"n{i}") for i, x in enumerate(scalars.pair_of(scalars.pair_number(F.lit(7), F.lit(3), 10), 10))],
        scalars.bisect_root(F.lit(2.0), 2.0).alias("r"),
    ).first()
    assert row.m == {"a": 3.0, "b": 3.0} and row.s == {"a": 1.0} and row.a == [1, 0] and row.p == [2] and (row.n0, row.n1) == (7, 3)
    assert row.r / 2 + row.r == pytest.approx(1)
    assert [scalars.adapt_rho(1, *x) for x in ((100, 1), (1, 100), (1, 1))] == [2, 0.5, 1]


def test_readers_and_writers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    got = readers.edge_list(spark, put("snap", "# c\n1 2\n2\t3\n1 2 3\n4 5 %\n\n")).collect()
    assert {tuple(r) for r in got} == {("1", "2"), ("2", "3")}
    assert {tuple(r) for r in readers.pairs(spark, put("pairs", "('a', 'b')\n(1, 2)\nbad\n")).collect()} == {("a", "b"), ("1", "2")}
    assert readers.costs(spark, put("cost", "(('a', 'b'), 1.5e-3)\n")).first() == ("a", "b", 0.0015)
    f = {r.node: r.features for r in readers.features(spark, put("feat", "('x', [1.0, 2.5])\n3 4 5\n")).collect()}
    assert f == {"x": [1.0, 2.5], "3": [4.0, 5.0]}
    t = readers.objectives(spark, put("obj", "(('i','j'), ([('k','j'), ('m','j')], [('i','l')]))\n")).collect()
    assert {tuple(r) for r in t} == {("i", "j", "k", "j", 1), ("i", "j", "m", "j", 1), ("i", "j", "i", "l", -1)}
    assert {r.node: r.colors for r in readers.colors(spark, put("col", '{"a": ["x", "y"], "b": []}')).collect()} == {"a": ["x", "y"], "b": []}
    assert readers.partition_map(spark, put("part", "{\"('a', 'b')\": 3}")).first() == ("a", "b", 3)
    assert readers.matlab(spark, put("mat", "2 1 0.5\n")).first() == (0, 1, 0.5)
    cells = readers.matrix(spark, put("dense", "1\t2\n3\t4\n"))
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)}
    writers.matrix(cells, str(tmp_path / "m"))
    assert readers.numpy_rows(spark, np.eye(2)).count() == 2
    e = generate.cycle(spark, 4)
    writers.edge_list(e, str(tmp_path / "e"))
    assert readers.edge_list(spark, str(tmp_path / "e")).count() == 8
    s = spark.createDataFrame([("a", "b", 0.5)], "u string, v string, d double")
    writers.pairs(s, str(tmp_path / "p"))
    writers.costs(s, str(tmp_path / "c"))
    assert readers.pairs(spark, str(tmp_path / "p")).first() == ("a", "b") and readers.costs(spark, str(tmp_path / "c")).first() == ("a", "b", 0.5)


def test_evaluation(spark):
    perm = spark.createDataFrame([(0, 1), (1, 0)], "u long, v long")
    z = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.6), (1, 1, 0.4)], "u long, v long, z double")
    stats = {r.metric: r.value for r in evaluate.matching_stats(z, perm).collect()}
    assert stats == {"ell1_diff": pytest.approx(0.9), "dpm": pytest.approx(0.75)}
    assert evaluate.recovered(z, perm) == 1.0
    assert evaluate.average([z, z]).count() == 3
    assert isinstance(pd.DataFrame(stats, index=[0]), pd.DataFrame)


def test_weighted_objective_equals_dense_matrices(spark):
    rng = np.random.default_rng(3)
    n, p = 5, 2.5
    a, b = (rng.random((n, n)) < 0.5).astype(float), rng.normal(1, 0.4, (n, n))
    x = rng.random((n, n))
    edges = spark.createDataFrame([(i, k) for i in range(n) for k in range(n) if a[i, k]], "src long, dst long")
    pairs = [(u, v) for u in range(n) for v in range(n)]
    sup = spark.createDataFrame(pairs, "u long, v long")
    weights = spark.createDataFrame([(k, j, float(b[k, j])) for k, j in pairs], "i long, j long, w double")
    z = spark.createDataFrame([(u, v, float(x[u, v])) for u, v in pairs], "u long, v long, z double")
    t = objective.terms(edges, edges, sup, weights).cache()
    f = a @ x - x @ b
    norm = (np.abs(f) ** p).sum() ** (1 / p)
    assert abs(objective.value(t, z, p).first()[0] - norm) < 1e-9
    s = np.sign(f) * (np.abs(f) / norm) ** (p - 1)
    want = a.T @ s - s @ b.T
    assert all(abs(r.g - want[r.u, r.v]) < 1e-9 for r in objective.gradient(t, z, p).collect())
    d = np.kron(a, np.eye(n)) - np.kron(np.eye(n), b.T)
    got = {(r.i, r.j, r.u, r.v): r.a for r in objective.coefficients(t).collect()}
    assert all(abs(got.get((i, j, u, v), 0) - d[i * n + j, u * n + v]) < 1e-9 for i, j in pairs for u, v in pairs)


def test_distance_pads_the_smaller_side(spark):
    one = spark.createDataFrame([("0", [3.0, 4.0])], "node string, features array<double>")
    two = spark.createDataFrame([("0", [3.0, 4.0]), ("1", [0.0, 1.0]), ("2", [6.0, 8.0])], one.schema)
    got = {(r.u, r.v): r.d for r in objective.pair_distance(one, two, equalize=True).collect()}
    assert len(got) == 9 and got["1", "0"] == 5 and got["2", "2"] == 10 and got["0", "0"] == 0
    assert len(objective.pair_distance(two, one, equalize=True).collect()) == 9 and objective.pair_distance(one, two).count() == 3


def test_fixed_topologies(spark):
    from graphloom.operators import topologies

    for make, n in ((topologies.dtelekom, 68), (topologies.abilene, 9), (topologies.servicenetwork, 8), (topologies.geant, 22)):
        assert graph.nodes(make(spark)).count() == n
    assert topologies.abilene(spark).count() == 26 and topologies.geant(spark).count() == 66
    assert topologies.abilene(spark).where("src = 'SEAT'").count() == 2


def test_assignment_takes_given_pairs_whatever_they_cost(spark):
    cost = spark.createDataFrame([(0, 0, 5e9), (0, 1, 1.0), (1, 0, 2.0), (2, 2, -7e8)], "u long, v long, d double")
    assert {(r.u, r.v) for r in assignment.assignment(cost, perfect=True).collect()} == {(0, 1), (1, 0), (2, 2)}
    lone = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2e7)], "u long, v long, d double")
    assert [(r.u, r.v) for r in assignment.assignment(lone).collect()] == [(0, 0)]
    with pytest.raises(ValueError, match="perfect"):
        assignment.assignment(lone, perfect=True)


def test_frank_wolfe_equals_dense_steps(spark):
    from itertools import permutations

    e1, e2 = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], [(0, 2), (2, 0), (2, 1), (1, 2), (3, 1), (1, 3)]
    a, b = np.zeros((4, 4)), np.zeros((4, 4))
    for m, e in ((a, e1), (b, e2)):
        m[tuple(zip(*e))] = 1
    d = np.arange(16).reshape(4, 4) % 5 / 10
    every = spark.range(16).selectExpr("cast(id div 4 as long) u", "cast(id % 4 as long) v")
    cost = every.withColumn("d", (F.col("u") * 4 + F.col("v")) % 5 / 10)
    t = objective.terms(edges(spark, e1), edges(spark, e2), every)
    z, trace = assignment.frank_wolfe(t, every.withColumn("z", F.lit(0.25)), p=2.0, rounds=3, cost=cost, lam=0.5)
    x = np.full((4, 4), 0.25)
    for n in range(3):
        r = a @ x - x @ b
        norm = np.linalg.norm(r)
        g = (a.T @ r - r @ b.T) / norm + 0.5 * d
        best = min(permutations(range(4)), key=lambda p: sum(g[i, p[i]] for i in range(4)))
        s = np.zeros((4, 4))
        s[range(4), best] = 1
        assert trace[n]["obj_nolin"] == pytest.approx(norm) and trace[n]["obj"] == pytest.approx(norm + 0.5 * (d * x).sum())
        assert trace[n]["gap"] == pytest.approx(((x - s) * g).sum(), abs=1e-9) and trace[n]["gap"] >= -1e-9
        mine = assignment.assignment(assignment.full_gradient(t, spark.createDataFrame([(i, j, float(x[i, j])) for i in range(4) for j in range(4)], "u long, v long, z double"), 2.0, cost, 0.5), "g")
        s = np.zeros((4, 4))
        for row in mine.collect():
            s[row.u, row.v] = 1  # ties between matchings are the operator's to break
        x = x + (s - x) / (n + 2)
    got = z.toPandas().pivot(index="u", columns="v", values="z").to_numpy()
    assert np.allclose(got.sum(axis=0), 1) and np.allclose(got.sum(axis=1), 1) and np.allclose(got, x)
    with pytest.raises(ValueError, match="perfect"):
        assignment.frank_wolfe(t, every.where("u > 1 or v = 0").withColumn("z", F.lit(0.25)), rounds=1)


def test_dumped_runs_go_on_as_if_never_stopped(spark, tmp_path):
    e = edges(spark, [(i, j) for i in range(6) for j in range(6) if abs(i - j) == 1 or i + j == 5 and i != j])
    every = support.all_pairs(e, e)
    t = objective.terms(e, e, every)
    start = lambda: admm.initial(every, t, 6, options=admm.Options())
    read = lambda s: s["z"].toPandas().sort_values(["u", "v"])["z"].to_numpy()
    whole = admm.Options(adapt=True)
    want = read(admm.align(start(), 5, whole))
    first = admm.Options(adapt=True)
    admm.align(start(), 3, first, folder=str(tmp_path), every=2)
    again = admm.Options(adapt=True)
    state, done = admm.latest(spark, str(tmp_path), again)
    assert done == 3 and (again.rho_p, again.rho_q) == (first.rho_p, first.rho_q)
    assert np.allclose(read(admm.align(state, 2, again, folder=str(tmp_path), done=done)), want)
    trace = spark.read.parquet(f"{tmp_path}/trace").toPandas()
    assert sorted(trace.iteration.unique()) == [0, 1, 2, 3, 4] and set(trace.metric) == {"pres", "qres", "tres", "dual"}
    loose = admm.Options(tol=0.5)
    admm.align(start(), 200, loose)
    assert len(loose.trace) < 200 and max(v for k, v in loose.trace[-1].items() if k != "iteration") <= 0.5


def test_regular_graphs_of_any_degree(spark):
    for n, degree in ((100, 8), (60, 30), (9, 8)):
        g = generate.regular(spark, n, degree).toPandas()
        assert len(g) == n * degree and not g.duplicated().any() and (g.src != g.dst).all() and (g.groupby("src").size() == degree).all()
    with pytest.raises(ValueError):
        generate.barabasi_albert(spark, 10**9, 3)


def test_sorted_ids_walk_pairs_and_slices(spark):
    e = edges(spark, [(700_000, -5), (3, 70_000), (3, 9)])
    assert {r.old_id: r.new_id for r in graph.sorted_ids(e).collect()} == {-5: 1, 3: 2, 9: 3, 70_000: 4, 700_000: 5}
    walks = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 2, 1), (1, 1, 1, 2), (1, 1, 2, 3)], "start long, walk int, item long, pos int")
    assert [(r.start, r.item) for r in graph.walk_pairs(walks).collect()] == [(1, 2), (1, 2)]
    f = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "node long, features array<double>")
    assert graph.exogenous(f, 1, 2).first().features == [2.0, 3.0]
    scores = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.2)], "node long, score double")
    assert [r.node for r in graph.ordered(scores).collect()] == [2, 1, 3]


def test_a_pair_without_a_cost_costs_nothing(spark):
    sup = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "u long, v long")
    cost = spark.createDataFrame([(0, 0, 3.0)], "u long, v long, d double")
    z = sup.withColumn("z", F.lit(0.5))
    assert objective.linear_cost(sup, cost, z).first().value == 1.5
    first = admm.initial(sup, objective.terms(edges(spark, [(0, 1)]), edges(spark, [(0, 1)]), sup), 2, cost)
    assert {(r.u, r.v): r.d for r in first["q"].collect()} == {(0, 0): 3.0, (0, 1): 0.0, (1, 0): 0.0}


def test_an_unsolved_block_is_an_error():
    rng = np.random.default_rng(5)
    with pytest.raises(RuntimeError, match="gap"):
        blocks.sweep_l1(rng.normal(size=(8, 9)), rng.normal(size=9) * 50, 0.01, sweeps=1)


def test_the_dual_path_closes_the_gap_on_any_block():
    rng = np.random.default_rng(11)
    for k in range(400):
        m, n = rng.integers(1, 20, size=2)
        d = rng.integers(-1, 2, size=(m, n)).astype(float) if k % 4 < 2 else rng.normal(size=(m, n))
        if k % 2 and m > 2:  # dependent rows
            d[1], d[2] = d[0] * (1 if k % 8 < 4 else -1), d[0] - d[-1]
        zbar, rho = rng.normal(size=n) if k % 3 else np.full(n, 0.25), 10 ** rng.uniform(-2, 2)
        x, w = blocks.dual_path(d, zbar, 1 / rho)
        assert np.abs(w).max() <= 1 + 1e-9 and np.allclose(x, zbar - d.T @ w / rho)
        assert blocks.gap(d, x, w) <= 1e-9 * (1 + np.abs(d @ x).sum())
    d, zbar = rng.integers(-1, 2, size=(5, 12)).astype(float), rng.normal(size=12)
    assert np.allclose(blocks.solve_l1(d, zbar, 1.3), blocks.sweep_l1(d, zbar, 1.3, 50_000), atol=1e-8)


def split_objectives(spark, seed, groups, per=2, width=3):
    """Objectives in independent groups of variables: (a table, zbar table, dense matrices in the same order)."""
    rng = np.random.default_rng(seed)
    d = np.zeros((groups * per, groups * width))
    for g in range(groups):
        d[g * per : (g + 1) * per, g * width : (g + 1) * width] = rng.integers(-1, 2, size=(per, width))
        d[g * per : (g + 1) * per, g * width] = 1
    zbar = rng.normal(size=groups * width)
    a = spark.createDataFrame([(int(i), 0, int(u), 0, float(d[i, u])) for i, u in zip(*np.nonzero(d))], "i int, j int, u int, v int, a double")
    at = spark.createDataFrame([(u, 0, float(z)) for u, z in enumerate(zbar)], "u int, v int, zbar double")
    return a, at, d, zbar


@pytest.mark.parametrize("p", [1.5, 2.0])
def test_one_norm_over_all_blocks_however_they_are_dealt(spark, p):
    a, at, d, zbar = split_objectives(spark, 5, 32)
    found = {}
    for n in (1, 8, 32):
        part = a.select("i", "j", (F.floor(F.col("i") / 2) % n).cast("int").alias("part_id")).distinct()
        own = blocks.placed(a, part)
        copies = blocks.copies_of(own).join(at, ["u", "v"]).withColumn("p", F.col("zbar")).withColumn("phi", F.lit(0.0))
        x, y = pnorm.solve(copies, pnorm.start(copies, own), own, p, 1.0, 1.0, 9)
        x = x.toPandas().sort_values("u")
        assert len(x) == len(zbar)  # independent groups: one copy of each variable
        found[n] = x["p"].to_numpy()
        assert abs(y.agg(F.sum("y")).first()[0] - dense_split(d, zbar, d @ zbar, 0 * d[:, 0], zbar, p, 1.0, 1.0, 9)[1].sum()) < 1e-6
    want = dense_split(d, zbar, d @ zbar, np.zeros(len(d)), zbar, p, 1.0, 1.0, 9)[0]
    for x in found.values():
        assert np.allclose(x, want, atol=1e-6)
    # The rounds go to the minimum of the whole norm.
    best = dense_split(d, zbar, d @ zbar, np.zeros(len(d)), zbar, p, 1.0, 1.0, 3000)[0]
    cost = lambda v: np.linalg.norm(d @ v, p) + 0.5 * ((v - zbar) ** 2).sum()
    rng = np.random.default_rng(6)
    assert all(cost(best) <= cost(best + 1e-3 * rng.normal(size=len(best))) + 1e-9 for _ in range(200))
    assert cost(want) - cost(best) < 1e-2


def test_p_norm_rounds_end_by_their_tolerance_or_fail(spark):
    a, at, d, zbar = split_objectives(spark, 7, 1)
    own = blocks.block_ids(a, 1)
    copies = blocks.copies_of(own).join(at, ["u", "v"]).withColumn("p", F.col("zbar")).withColumn("phi", F.lit(0.0))
    x, y = pnorm.solve(copies, pnorm.start(copies, own), own, 2.0, 1.0, 1.0, 60, tol=1e-3)
    best = dense_split(d, zbar, d @ zbar, np.zeros(len(d)), zbar, 2.0, 1.0, 1.0, 3000)[0]
    assert np.allclose(x.toPandas().sort_values("u")["p"], best, atol=1e-2)
    with pytest.raises(RuntimeError, match="not solved after 2"):
        pnorm.solve(copies, pnorm.start(copies, own), own, 2.0, 1.0, 1.0, 2, tol=1e-9)
    with pytest.raises(ValueError, match="1 objectives have no part"):
        blocks.placed(a, a.where("i > 0").select("i", "j", F.lit(0).alias("part_id")))
    with pytest.raises(ValueError, match="unknown dense"):
        blocks.block_step(own.join(at, ["u", "v"]), "p", 1.0)


def dense_align(d, copies, n, p, rounds, inner):
    """Outer and inner rounds on dense vectors; ``copies``: list of (objective rows, variable columns) of each block."""
    size = d.shape[1]
    square = int(round(size**0.5))
    z = np.full(size, 1 / n)
    q, t, xi, psi = z.copy(), z.copy(), 0 * z, 0 * z
    state = [[np.full(len(c), 1 / n), np.zeros(len(c))] for _, c in copies]
    y, ups = d @ z, np.zeros(len(d))

    def simplex(x):
        out = np.zeros_like(x)
        for k, row in enumerate(x):
            s = np.sort(row)[::-1]
            out[k] = np.maximum(row - ((np.cumsum(s) - 1) / np.arange(1, len(s) + 1)).max(), 0)
        return out

    for _ in range(rounds):
        xi, psi = xi + q - z, psi + t - z
        q, t = simplex((z - xi).reshape(square, square)).ravel(), simplex((z - psi).reshape(square, square).T).T.ravel()
        for (_, c), own in zip(copies, state):
            own[1] = own[1] + own[0] - z[c]
        zbar = [z[c] - own[1] for (_, c), own in zip(copies, state)]
        for _ in range(inner):
            f = np.zeros(len(d))
            for (r, c), own in zip(copies, state):
                f[r] = d[np.ix_(r, c)] @ own[0]
            ups = ups + y - f
            y = dense_prox(f - ups, p, 1.0)
            for (r, c), own, at in zip(copies, state, zbar):
                m = d[np.ix_(r, c)]
                own[0] = np.linalg.solve(np.eye(len(c)) + m.T @ m, at + m.T @ (y + ups)[r])
        total, count = q + xi + t + psi, np.full(size, 2.0)
        for (_, c), own in zip(copies, state):
            total[c] += own[0] + own[1]
            count[c] += 1
        z = total / count
    return z


@pytest.mark.parametrize("blocks_", [None, 3])
def test_p_norm_alignment_equals_dense_rounds(spark, blocks_):
    e1, e2 = edges(spark, [(0, 1), (1, 2), (2, 0), (1, 0)]), edges(spark, [(0, 2), (2, 1), (1, 0)])
    every = support.all_pairs(e1, e2)
    t = objective.terms(e1, e2, every)
    o = admm.Options(norm="p", p=1.5, inner=3, inner_tol=0.0, blocks=blocks_)
    first = admm.initial(every, t, 3, options=o)
    a = first["a"].toPandas() if blocks_ else objective.coefficients(t).toPandas()
    names = sorted({(r.i, r.j) for r in a.itertuples()})
    d = np.zeros((len(names), 9))
    for r in a.itertuples():
        d[names.index((r.i, r.j)), r.u * 3 + r.v] = r.a
    own = {r: ({x.block_id for x in a.itertuples() if (x.i, x.j) == n}.pop() if blocks_ else k) for k, (r, n) in enumerate(zip(range(len(names)), names))}
    copies = []
    for b in sorted(set(own.values())):
        rows = [r for r in own if own[r] == b]
        copies.append((rows, sorted(np.flatnonzero(np.abs(d[rows]).sum(axis=0)).tolist())))
    got = admm.align(first, 2, o)["z"].toPandas().sort_values(["u", "v"])["z"].to_numpy()
    assert np.allclose(got, dense_align(d, copies, 3, 1.5, 2, 3), atol=1e-7)


def test_p_norm_state_is_saved_with_y(spark, tmp_path):
    e = generate.cycle(spark, 3)
    every = support.all_pairs(e, e)
    t = objective.terms(e, e, every)
    o = admm.Options(norm="p", p=1.5, inner=2, inner_tol=0.0)
    read = lambda s: s["z"].toPandas().sort_values(["u", "v"])["z"].to_numpy()
    one = admm.align(admm.initial(every, t, 3, options=o), 1, o)
    admm.save(one, str(tmp_path))
    again = admm.resume(spark, str(tmp_path))
    assert set(again) == {"z", "q", "t", "p", "a", "y"}
    assert np.allclose(read(admm.align(again, 1, o)), read(admm.align(admm.initial(every, t, 3, options=o), 2, o)))


def union_find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root}


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, size=(190, 2))] + [(900 + i, 901 + i) for i in range(70)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components.connected_components(edges(spark, pairs)).collect()}
    assert got == union_find(pairs)
    assert components.connected_components(edges(spark, [])).count() == 0
    assert {tuple(r) for r in components.connected_components(edges(spark, [(7, 7), (3, 3)])).collect()} == {(7, 7), (3, 3)}
    assert components.is_connected(generate.cycle(spark, 9)) and not components.is_connected(edges(spark, [(1, 2), (3, 4)]))
    with pytest.raises(RuntimeError, match="not settled after 1"):
        components.connected_components(edges(spark, pairs), rounds=1)


def test_ranks_are_those_of_one_sorted_list(spark):
    from graphloom.operators import ranks

    rng = np.random.default_rng(6)
    values = [(int(v), i) for i, v in enumerate(rng.integers(-50, 50, size=700))]
    df = spark.createDataFrame(values, "v long, i long").repartition(7)
    got = ranks.ranked(df, F.col("v").desc(), "i", start=0).orderBy("rank").collect()
    assert [(r.v, r.i) for r in got] == sorted(values, key=lambda x: (-x[0], x[1])) and [r["rank"] for r in got] == list(range(700))
    assert ranks.ranked(df.where("v > 99"), "v").count() == 0
    plan = ranks.ranked(df, "v", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "_n#" in plan  # over the counts of the partitions alone
    e = edges(spark, [(i, (i * 7 + 1) % 501) for i in range(501)])
    rows = generate.permutation(e).collect()
    assert sorted(r.u for r in rows) == sorted(r.v for r in rows) == sorted({x for i in range(501) for x in (i, (i * 7 + 1) % 501)})
    assert sum(r.u == r.v for r in rows) < 20 and generate.permutation(e).collect() == rows


@pytest.mark.parametrize(("n", "k", "p"), [(40, 4, 0.0), (60, 4, 0.3), (30, 3, 1.0), (9, 8, 0.9)])
def test_watts_strogatz_is_connected_and_keeps_its_edges(spark, n, k, p):
    e = [tuple(r) for r in generate.watts_strogatz(spark, n, k, p).collect()]
    assert len(e) == len(set(e)) == 2 * n * (k // 2) and set(e) == {(b, a) for a, b in e} and all(a != b for a, b in e)
    assert set(union_find(e).values()) == {0} and len(union_find(e)) == n
    if p == 0:
        assert all(min((a - b) % n, (b - a) % n) <= k // 2 for a, b in e)


def test_watts_strogatz_without_room(spark):
    with pytest.raises(ValueError, match="below n"):
        generate.watts_strogatz(spark, 4, 4, 0.5)
    with pytest.raises(RuntimeError, match="no connected graph in 2"):
        generate.watts_strogatz(spark, 60, 2, 1.0, tries=2)


def test_small_world_links_follow_their_law(spark):
    side, power = 12, 2.0
    grid = {tuple(r) for r in generate.grid(spark, side, side).collect()}
    count, drawn_from = {}, {}
    for seed in range(1, 5):
        got = {tuple(r) for r in generate.small_world(spark, side, seed, power).collect()}
        assert grid <= got
        for a, b in got - grid:
            d = abs(a // side - b // side) + abs(a % side - b % side)
            assert 1 < d <= 2 * (side - 1) and 0 <= b < side * side
            count[d] = count.get(d, 0) + 1
    want = np.zeros(2 * side)
    for a in range(side * side):
        w = np.zeros(2 * side)
        for b in range(side * side):
            d = abs(a // side - b // side) + abs(a % side - b % side)
            if d:
                w[d] += d**-power
        want += w / w.sum()
    # Links of distance 1 are grid edges already; of the others each ring has its share.
    for lo, hi in ((2, 2), (3, 4), (5, 8), (9, 22)):
        expected = 4 * want[lo : hi + 1].sum()
        found = sum(count.get(d, 0) for d in range(lo, hi + 1))
        assert abs(found - expected) < 4 * expected**0.5
    assert generate.small_world(spark, 1).count() == 0 and not drawn_from


def test_partition_maps_come_back_and_place_blocks(spark, tmp_path):
    e = generate.cycle(spark, 5)
    every = support.all_pairs(e, e)
    t = objective.terms(e, e, every)
    parts = every.select("u", "v", (F.col("u") >= 2).cast("int").alias("part_id"))
    at = str(tmp_path / "parts")
    writers.partition_map(partitioner.objective_parts(t, parts).withColumnsRenamed({"i": "u", "j": "v"}), at)
    read = readers.partition_map(spark, at).select(F.col("u").cast("long").alias("i"), F.col("v").cast("long").alias("j"), "part_id")
    assert read.count() == 25 and {r.part_id for r in read.collect()} == {0, 1}
    (tmp_path / "one.json").write_text("{\"('1', '2')\": 3, \"('4','5')\": 0}")
    (tmp_path / "long.json").write_text("{\n \"('1', '2')\": 3,\n \"('4','5')\": 0\n}")
    assert {tuple(r) for r in readers.partition_map(spark, str(tmp_path / "one.json")).collect()} == {("1", "2", 3), ("4", "5", 0)}
    assert readers.partition_map(spark, str(tmp_path / "long.json"), whole=True).count() == 2
    # Blocks dealt in other ways go to one optimum.
    found = []
    for o in (admm.Options(blocks=2), admm.Options(placement=read), admm.Options()):
        state = admm.align(admm.initial(every, t, 5, options=o), 6, o)
        counts = blocks.copy_counts(state["a"]).first() if o.dense else None
        assert counts is None or (counts.blocks == 2 and counts.objectives == 25 and counts.variables == 25 and 25 <= counts.copies <= 50 and counts.largest <= 25)
        found.append(objective.value(t, state["z"], 2.0).first()[0])
    assert max(found) < 1e-6  # the uniform matching of a cycle with itself is a minimum


def test_block_statistics(spark):
    e1, e2 = edges(spark, [(0, 1), (1, 2), (2, 0), (1, 0)]), edges(spark, [(0, 2), (2, 1), (1, 0)])
    every = support.all_pairs(e1, e2)
    t = objective.terms(e1, e2, every)
    for o in (admm.Options(norm="l1", blocks=2), admm.Options(norm="l2", blocks=2), admm.Options(norm="p", p=1.5, blocks=2, inner=2, inner_tol=0.0)):
        old = admm.align(admm.initial(every, t, 3, options=o), 1, o)
        new = admm.align(old, 1, o)
        got = {r.metric: r for r in admm.block_stats(old, new, o).collect()}
        a, p, z = new["a"].toPandas(), new["p"].toPandas(), old["z"].toPandas()
        rows = {k: [] for k in got}
        for b, own in a.groupby("block_id"):
            held = p[p.block_id == b].merge(z, on=["u", "v"])
            f = own.merge(held, on=["u", "v"]).assign(f=lambda x: x.a * x.p, g=lambda x: x.a * x.z).groupby(["i", "j"])[["f", "g"]].sum().abs()
            cost = {"l1": f.sum(), "l2": (f**2).sum() / 2, "p": (f**1.5).sum()}[o.norm]
            err = ((held.p - held.z + held.phi) ** 2).sum() / 2
            for k, v in (("variables", len(held)), ("objectives", len(f)), ("pobj", cost.f), ("zobj", cost.g), ("rhoerr", err), ("proximalobj", err + cost.f)):
                rows[k].append(v)
        for k, v in rows.items():
            assert np.allclose([got[k]["mean"], got[k].least, got[k].most], [np.mean(v), min(v), max(v)])


def dense_program(d, c, n, rounds):
    """Primal-dual rounds on dense matrices for all n * n pairs."""
    r, k = np.kron(np.eye(n), np.ones((1, n))), np.kron(np.ones((1, n)), np.eye(n))
    p, w, a, b = np.full(n * n, 1 / n), np.zeros(len(d)), np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        new = np.maximum(0, p - (c + d.T @ w - r.T @ a - k.T @ b) / (np.abs(d).sum(axis=0) + 2))
        far, p = 2 * new - p, new
        w = np.clip(w + (d @ far) / np.abs(d).sum(axis=1), -1, 1)
        a, b = a + (1 - r @ far) / n, b + (1 - k @ far) / n
    return p, w


def test_program_rounds_equal_dense_ones_and_close_the_gap(spark):
    e1, e2 = edges(spark, [(0, 1), (1, 0), (1, 2), (2, 1), (2, 0)]), edges(spark, [(0, 2), (2, 0), (1, 0), (2, 1), (1, 2)])
    every = support.all_pairs(e1, e2)
    t = objective.terms(e1, e2, every)
    cost = spark.createDataFrame([(u, v, (3 * u + 5 * v) % 7 / 10) for u in range(3) for v in range(3) if u + v], "u long, v long, d double")
    a = objective.coefficients(t).toPandas()
    names = sorted({(r.i, r.j) for r in a.itertuples()})
    d = np.zeros((len(names), 9))
    for r in a.itertuples():
        d[names.index((r.i, r.j)), r.u * 3 + r.v] = r.a
    c = np.array([(3 * u + 5 * v) % 7 / 10 if u + v else 0 for u in range(3) for v in range(3)])
    first = primal_dual.initial(every, t, cost)
    state = primal_dual.solve(first, 4)
    want, multipliers = dense_program(d, c, 3, 4)
    assert np.allclose(state["p"].toPandas().sort_values(["u", "v"])["p"], want)
    assert np.allclose(state["w"].toPandas().sort_values(["i", "j"])["w"], multipliers)
    # The bound stays below the value of every permutation, and meets the best fractional one.
    import itertools

    values = [np.abs(d @ m).sum() + c @ m for q in itertools.permutations(range(3)) for m in [np.eye(3)[list(q)].ravel()]]
    g = primal_dual.gap(state).first()
    assert g.dual <= min(values) + 1e-9
    best = dense_program(d, c, 3, 20_000)[0]
    optimum = np.abs(d @ best).sum() + c @ best
    assert g.dual <= optimum + 1e-6
    done = primal_dual.solve(state, 24, tol=0.5, check=6)
    g = primal_dual.gap(done).first()
    assert g.infeasible <= 0.5 and g.dual <= optimum + 1e-6 and abs(g.primal - g.dual) <= 0.5 * (1 + g.primal)
    with pytest.raises(RuntimeError, match="the gap is"):
        primal_dual.solve(first, 1, tol=1e-9)


def test_laid_out_terms_are_not_shuffled(spark, tmp_path):
    e = generate.cycle(spark, 6)
    every = support.all_pairs(e, e)
    t = objective.terms(e, e, every)
    by_variable, by_objective = objective.layouts(t, str(tmp_path), "laid_out")
    assert by_variable.exceptAll(t.select(*by_variable.columns)).isEmpty() and by_objective.count() == t.count()
    z = every.withColumn("z", (F.col("u") + 1) / (F.col("v") + 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for terms, laid, joined in ((t, None, False), (by_variable, by_objective, True)):
            lines = objective.gradient(terms, z, 2.5, laid)._jdf.queryExecution().executedPlan().toString().splitlines()
            scans = [k for k, line in enumerate(lines) if "FileScan" in line]
            assert bool(scans) == joined and all("Bucketed: true" in lines[k] for k in scans)
            for k in scans:
                depth = re.search(r"\w", lines[k]).start()
                for line in reversed(lines[:k]):  # from the scan up to the join that reads it
                    if re.search(r"\w", line).start() < depth:
                        depth = re.search(r"\w", line).start()
                        assert "Exchange" not in line
                        if "Join" in line:
                            break
                else:
                    raise AssertionError("no join over the scan")
        got = objective.gradient(by_variable, z, 2.5, by_objective).orderBy("u", "v").toPandas()
        want = objective.gradient(t, z, 2.5).orderBy("u", "v").toPandas()
        assert np.allclose(got.g, want.g) and len(got) == 36
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_figures_ride_along_with_the_actions(spark):
    from graphloom.plans.runtime import Runtime

    run = Runtime()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("figures", "")
    with run.timed("count"):
        run.watched("edges", generate.cycle(spark, 7), far=F.max("dst")).write.format("noop").mode("overwrite").save()
    before = len(tracker.getJobIdsForGroup("figures"))
    rows = {(r.step, r.metric): r.value for r in run.rows(spark).collect()}
    assert rows["edges", "rows"] == 14 and rows["edges", "far"] == 6 and rows["count", "seconds"] > 0 and before >= 1


def test_exports_come_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    w = spark.createDataFrame([(0, 1, 0.1 + 0.2), (1, 0, 1e-17)], "i int, j int, w double")
    writers.weights(w, at("w"))
    assert {tuple(r) for r in readers.weights(spark, at("w")).collect()} == {tuple(r) for r in w.collect()}
    writers.permutation(spark.createDataFrame([(0, 2), (2, 0)], "u int, v int"), at("p"))
    assert {tuple(r) for r in readers.edge_list(spark, at("p")).collect()} == {("0", "2"), ("2", "0")}
    writers.trace(spark.createDataFrame([(0, "pres", 1.5)], "iteration int, metric string, value double"), at("t"))
    writers.trace(spark.createDataFrame([(1, "pres", 0.5)], "iteration int, metric string, value double"), at("t"))
    assert {(r.iteration, r.value) for r in readers.trace(spark, at("t")).collect()} == {(0, 1.5), (1, 0.5)}
    writers.costs(spark.createDataFrame([("0", "1", 0.25)], "u string, v string, d double"), at("z"))
    assert readers.solution(spark, at("z")).first() == ("0", "1", 0.25)
    m = {(r.row, r.col): r.val for r in readers.graph_matrix(spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (1, 1, 1.0)], "i int, j int, w double")).collect()}
    assert m == {(0, 1): 3.0, (1, 0): 3.0, (1, 1): 1.0}
    assert readers.graph_matrix(edges(spark, [(0, 1), (0, 1)]), directed=True).collect() == [(0, 1, 1.0)]
    e = generate.cycle(spark, 4)
    features = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "node long, features array<double>")
    split = generate.split(features, 0.5)
    writers.graph_export(e, features, features.select("node", F.lit(1).alias("class")), at("g"), split, spark.createDataFrame([(0, 1)], "start long, item long"))
    flags = {r.node: r.val for r in spark.read.json(at("g-nodes")).collect()}
    assert flags == {r.node: r.val for r in split.collect()}
    assert {r.node: r.row for r in spark.read.json(at("g-id_map")).collect()} == {i: i for i in range(4)}
    assert [r.features for r in spark.read.parquet(at("g-feats")).orderBy("row").collect()] == [[float(i)] for i in range(4)]
    assert readers.edge_list(spark, at("g-walks")).collect() == [("0", "1")] and spark.read.json(at("g-G")).count() == 8
    writers.graph_export(e, features, features.select("node", F.lit(1).alias("class")), at("h"))
    assert not any(r.val for r in spark.read.json(at("h-nodes")).collect())
    with pytest.raises(ValueError, match="number nodes from 0"):
        objective.pair_distance(features.where("node in (0, 3)"), features.where("node < 4"), equalize=True)


def test_the_variable_index_lists_objectives(spark):
    t = spark.createDataFrame([(0, 1, 5, 6, 1), (0, 2, 5, 6, 1), (0, 1, 5, 7, -1)], "i int, j int, u int, v int, sign int")
    got = {(r.u, r.v): ([tuple(x) for x in r.plus], [tuple(x) for x in r.minus]) for r in objective.variable_index(t).collect()}
    assert got == {(5, 6): ([(0, 1), (0, 2)], []), (5, 7): ([], [(0, 1)])}
