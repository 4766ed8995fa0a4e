"""Clustering inside cells against the definition, and cells against each other."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_core import POINTS, blobs, expected_clusters, labels_of, utc
from wayfold.operators import cells, cluster
from wayfold.operators.graph import connected_components
from wayfold.params import Density
from wayfold.streaming import ticks


def by_definition(xyz, ring, was, epsilon, least):
    near = cells.far(xyz, xyz) < epsilon
    np.fill_diagonal(near, False)
    core = ((near.sum(1) > least) | was) & (ring < 2)
    label = {}
    for i in np.flatnonzero(core).tolist():
        stack = [i] if i not in label else []
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = i
                stack += np.flatnonzero(near[j] & core).tolist()
    edges = {}
    for i in np.flatnonzero(~core & (ring == 0)).tolist():
        for j in np.flatnonzero(near[i] & core).tolist():
            edges[i, label[j]] = edges.get((i, label[j]), 0) + 1
    return core, label, edges


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_a_cell_by_the_definition(monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    for seed in range(60):
        draw = np.random.default_rng(seed)
        n, k = int(draw.integers(1, 200)), int(draw.integers(1, 8))
        xyz = draw.uniform(-5, 5, (k, 3))[draw.integers(0, k, n)] + draw.normal(0, draw.choice([0, 0.05, 0.4, 1.0]), (n, 3))
        ring, was = draw.integers(0, 3, n), draw.random(n) < 0.05
        core, root, edges = cells.cluster_cell(xyz, ring, was, 1.0, 3)
        told, label, told_edges = by_definition(xyz, ring, was, 1.0, 3)
        assert core.tolist() == told.tolist()
        names = {int(root[i]): label[i] for i in label}
        assert all(names[int(root[i])] == label[i] for i in label) and len(set(names.values())) == len(names)
        assert {(a, names[r]): m for a, r, m in edges} == told_edges


@pytest.mark.parametrize("apart, met", [(0.999, True), (1.2, False)])
def test_two_clumps_about_epsilon_apart_are_not_paired(apart, met):
    draw = np.random.default_rng(1)
    clump = draw.normal(0, 0.01, (48_000, 3))
    xyz = np.concatenate([clump, draw.normal(0, 0.01, (48_000, 3)) + [apart, 0, 0]])
    core, root, edges = cells.cluster_cell(xyz, np.zeros(len(xyz), dtype=int), np.zeros(len(xyz), dtype=bool), 1.0, 3)
    assert core.all() and len(set(root.tolist())) == 2 - met and not edges


def test_components_of_links():
    draw = random.Random(1)
    for _ in range(50):
        n = draw.randrange(1, 40)
        a, b = ([draw.randrange(n) for _ in range(n // 2)] for _ in range(2))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        assert cells.components(n, np.array(a, dtype=int), np.array(b, dtype=int)).tolist() == label


@pytest.mark.parametrize("most", [5, 20, 10_000])
def test_cells_of_any_size_give_the_same_clusters(spark, most):
    rows = blobs(300, 9)
    found = cluster.cluster_points(spark.createDataFrame(rows, POINTS), most=most)
    assert labels_of(found) == expected_clusters(rows, Density())


def test_crowded_cells_are_clustered_without_bringing_them_together(spark, monkeypatch):
    rows, asked, own = blobs(300, 9), [], cluster.core_graph
    monkeypatch.setattr(cluster, "core_graph", lambda *a: asked.append(1) or own(*a))
    graph = cluster.cell_graph(spark.createDataFrame(rows, POINTS), Density(), most=3, at_most=10)
    expected = expected_clusters(rows, Density())
    assert asked and {r.a for r in graph.core.collect()} == {k for k, (_, label) in expected.items() if label == "CORE"}


def test_ticks_with_small_cells_in_a_top_cell(spark, tmp_path):
    rows = blobs(200, 11)
    order = rows[:]
    random.Random(2).shuffle(order)
    store = ticks.ClusterStore(spark, str(tmp_path / "s"))
    for k in range(3):
        ticks.tick(spark.createDataFrame(order[k::3], POINTS), store, Density(), 20, {"x": (144.0, 146.0), "y": (-38.5, -37.0)})
    assert labels_of(store.read()) == expected_clusters(rows, Density())


def test_borders_whose_cores_lie_in_other_cells(spark):
    draw = random.Random(4)
    rows = [(f"p{k:03d}", utc(2024, 1, 1) + dt.timedelta(minutes=draw.uniform(0, 13 * 400)), 144.95 + k % 7 * 0.0001, -37.8 + k % 11 * 0.0001) for k in range(400)]
    points, expected = spark.createDataFrame(rows, POINTS), expected_clusters(rows, Density())
    assert labels_of(cluster.cluster_points(points, most=10)) == expected


def test_points_on_the_borders_of_cells_belong_to_one(spark):
    eps = Density().epsilon
    rows = [(f"p{i}_{j}_{k}", utc(2024, 1, 1) + dt.timedelta(hours=i), 144.0 + j * eps, -38.0 + k * eps) for i in range(4) for j in range(17) for k in range(9)]
    points = spark.createDataFrame(rows, POINTS)
    for within in (None, {"x": (143.0, 147.0)}):
        own = cluster.grid_cells(points, Density(min_points=0), 4, within=within).where("not halo")
        assert own.count() == len(rows) == own.select("obj_id").distinct().count()
    assert cluster.grid_cells(points.limit(0), Density()).collect() == []
    assert cluster.cluster_points(points.limit(0)).collect() == []


def test_few_links_are_followed_by_one_task(spark):
    draw = random.Random(3)
    edges = spark.createDataFrame([(f"n{draw.randrange(300):03d}", f"n{draw.randrange(300):03d}") for _ in range(260)] + [(None, "x"), ("y", "y")], "a string, b string").repartition(5)
    few, many = (sorted(map(tuple, connected_components(edges, few=k).collect())) for k in (1000, 0))
    assert few == many and few
    assert connected_components(edges.limit(0), few=10).collect() == []
    assert connected_components(edges, few=10).where(F.col("node") == F.col("component")).count() == 0
