"""Algorithms against brute force on a small random multigraph with loops and parallel relationships."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from graphloom.operators import centrality as c
from graphloom.operators import traversal as t
from graphloom.operators.graph import PropertyGraph

N = 12


@pytest.fixture(scope="module", params=[4])
def case(request, spark):
    rng = random.Random(request.param)
    edges = [(i, rng.randrange(N - 1), rng.randrange(N - 1), rng.randint(1, 9)) for i in range(24)]
    edges += [(26, 3, 3, 1), (27, 3, 3, 2), (28, 1, 2, 5), (29, 1, 2, 4)]
    nodes = spark.createDataFrame([(i,) for i in range(N)], "id bigint")
    graph = PropertyGraph(spark).with_nodes(nodes, "N").with_edges(spark.createDataFrame(edges, "id bigint, src bigint, dst bigint, weight bigint"), "T")
    return graph, edges


class Brute:
    def __init__(self, edges):
        self.edges = edges
        self.out, self.und, self.weight = defaultdict(set), defaultdict(set), {}
        for _, a, b, w in edges:
            self.out[a].add(b)
            self.weight[a, b] = min(w, self.weight.get((a, b), math.inf))
            if a != b:
                self.und[a].add(b)
                self.und[b].add(a)

    def depth(self, s, near=None):
        near, d, todo = near or self.out, {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in d:
                    d[v] = d[u] + 1
                    todo.append(v)
        return d

    def simple(self, a, b):
        def grow(p):
            if p[-1] == b:
                yield p
                return
            for v in self.out[p[-1]]:
                if v not in p:
                    yield from grow([*p, v])

        return list(grow([a]))

    def cost(self, p):
        return float(sum(self.weight[a, b] for a, b in zip(p, p[1:])))


def table(df):
    return {r[0]: r[1] for r in df.collect()}


def close(got, want, tolerance=1e-9):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= tolerance for k in want)


def test_reach_and_components(case):
    g, edges = case
    b = Brute(edges)
    far = {i: b.depth(i) for i in range(N)}
    assert {r.id for r in t.bfs(g, 0, 2).collect()} == {k for k, d in far[0].items() if d <= 2}
    assert set(t.dfs(g, 0, 2)) == {k for k, d in far[0].items() if d <= 2} and t.dfs(g, 0, 2)[0] == 0
    assert t.bfs(g, 99, 2).count() == 0
    capped, cut = t.reach(g, g.spark.createDataFrame([(0,), (1,)], "id bigint"), 3, most=3)
    assert capped.count() == 3 and cut
    assert table(c.wcc(g)) == {i: min(b.depth(i, b.und)) for i in range(N)}
    assert table(c.scc(g)) == {i: min(k for k in far[i] if i in far[k]) for i in range(N)}
    assert t.has_cycle(g)
    assert table(c.degree(g, "both")) == {i: len(b.out[i]) + sum(i in b.out[k] for k in range(N)) for i in range(N)}


def test_paths(case):
    g, edges = case
    b = Brute(edges)
    for target in (5, 7):
        every = b.simple(0, target)
        assert sorted(r.path for r in t.all_paths(g, 0, target).collect()) == sorted(every)
        least = min(map(len, every), default=None)
        path = t.shortest_path(g, 0, target)
        assert (len(path) if path else None) == least and (path is None or path in every)
        assert sorted(r.path for r in t.all_shortest_paths(g, 0, target).collect()) == sorted(p for p in every if len(p) == least)
        found = t.dijkstra(g, 0, target)
        assert (found[1] if found else None) == min(map(b.cost, every), default=None)
        assert [w for _, w in t.top_paths(g, 0, target, 4)] == sorted(map(b.cost, every))[:4]
        longest = t.longest_path(g, 0, target)
        assert (len(longest) if longest else None) == max(map(len, every), default=None)
    assert t.shortest_path(g, 0, 0) == [0] and t.all_paths(g, 0, 0).count() == 1


def test_top_paths_of_graphs_beyond_the_former_limit(case, monkeypatch):
    g, edges = case
    b = Brute(edges)
    monkeypatch.setattr(t, "local_edges", None)
    monkeypatch.setattr(t, "SLICE", 7)
    monkeypatch.setattr(t, "NEAR_LINKS", 1)
    every = b.simple(1, 7)
    found = t.top_paths(g, 1, 7, 5)
    assert [w for _, w in found] == sorted(map(b.cost, every))[:5] and all(p in every and b.cost(p) == w for p, w in found)


def test_scores(case):
    g, edges = case
    b = Brute(edges)
    far = {i: b.depth(i) for i in range(N)}
    close(table(c.harmonic(g)), {i: sum(1 / d for d in far[i].values() if d) for i in range(N)})
    want = {}
    for i in range(N):
        total, r = sum(far[i].values()), len(far[i]) - 1
        want[i] = r / total * r / (N - 1) if total else 0.0
    close(table(c.closeness(g)), want)
    between = dict.fromkeys(range(N), 0.0)
    for x, y in itertools.permutations(range(N), 2):
        paths = b.simple(x, y)
        best = [p for p in paths if len(p) == min(map(len, paths))]
        for k in range(N):
            if k not in (x, y) and best:
                between[k] += sum(k in p for p in best) / len(best)
    close(table(c.betweenness(g)), between)
    rank, out = dict.fromkeys(range(N), 1 / N), defaultdict(int)
    for e in edges:
        out[e[1]] += 1
    for _ in range(20):
        new = dict.fromkeys(range(N), 0.15 / N)
        for e in edges:
            new[e[2]] += 0.85 * rank[e[1]] / out[e[1]]
        rank = new
    close(table(c.page_rank(g)), rank)
    x = dict.fromkeys(range(N), 1.0)
    for _ in range(100):
        new = dict.fromkeys(range(N), 1.0)
        for e in edges:
            new[e[2]] += 0.1 * x[e[1]]
        change, x = math.dist(new.values(), x.values()), new
        if change <= 1e-6:
            break
    close(table(c.katz(g)), x, 1e-6)
    assert sum(table(c.eigenvector(g)).values()) == pytest.approx(N)


def test_scores_of_graphs_too_large_to_broadcast(case, monkeypatch):
    g, _ = case
    want = [table(f(g)) for f in (c.harmonic, c.closeness)]
    monkeypatch.setattr(c, "BROADCAST_LINKS", 0)
    for f, own in zip((c.harmonic, c.closeness), want):
        close(table(f(g)), own)


@pytest.mark.parametrize("hubs, cells, links", [(64, 64_000_000, 4_000_000), (0, 500, 30), (3, 1, 1)])
def test_scores_lean_on_hubs(monkeypatch, hubs, cells, links):
    monkeypatch.setattr(c, "HUBS", hubs)
    monkeypatch.setattr(c, "CELLS", cells)
    monkeypatch.setattr(c, "LINKS_AT_ONCE", links)
    rng, n = random.Random(7), 240
    out = {i: set() for i in range(n)}
    for part in (0, 120):  # two graphs apart, each with a hub, a source that lists everything and a chain
        for i in range(part, part + 118):
            out[i] |= {j for j in [part + 7, part + rng.randrange(118)] if j != i}
            out[part + 7] |= {i} if i % 3 and i != part + 7 else set()
            out[part + 118].add(i)
        out[part + 117] = {part + 119}
    depth, before = {}, {}
    for i in range(n):
        depth[i], before[i], todo = {i: 0}, {i: 1}, deque([i])
        while todo:
            u = todo.popleft()
            for v in out[u]:
                if v not in depth[i]:
                    depth[i][v], before[i][v] = depth[i][u] + 1, 0
                    todo.append(v)
                before[i][v] += before[i][u] * (depth[i][v] == depth[i][u] + 1)
    between = [
        sum(
            before[s][k] * before[k][t] / before[s][t]
            for s in range(n) if s != k and k in depth[s]
            for t in depth[s] if t not in (s, k) and t in depth[k] and depth[s][k] + depth[k][t] == depth[s][t]
        )
        for k in range(n)
    ]
    pairs = np.array([(a, b) for a in out for b in out[a]])
    g = c._Adjacency(np.arange(n), pairs[:, 0], pairs[:, 1])
    g.count_to_hubs()
    batches = np.array_split(np.random.default_rng(1).permutation(n), 3)
    for r in pd.concat(c._distance_sums(g, iter(batches))).itertuples():
        far = depth[r.id].values()
        assert (r.reached, r.total) == (len(far) - 1, sum(far)) and r.harmonic == pytest.approx(sum(1 / d for d in far if d))
    assert c._gathered(g, pd.concat(c._dependencies(g, iter(batches)))) == pytest.approx(np.array(between), abs=1e-8)
    if hubs:  # far fewer pairs are visited than there are
        visited = sum(len(level[1]) for _, _, levels in g.searches(np.arange(n), ties=False) for level in levels)
        assert visited < sum(map(len, depth.values())) / 4


def test_triangles_clustering_and_links(spark, case):
    g, edges = case
    b = Brute(edges)
    closed = sum(1 for e, f, h in itertools.permutations(edges, 3) if e[2] == f[1] and f[2] == h[1] and h[2] == e[1])
    assert c.triangles(g).first()[0] == closed
    want = {}
    for i in range(N):
        k = len(b.und[i])
        want[i] = 0.0 if k < 2 else sum(y in b.und[x] for x in b.und[i] for y in b.und[i]) / (k * (k - 1))
    close(table(c.clustering(g)), want)
    pairs = [(0, 1), (2, 5), (3, 99)]
    for r in c.link_scores(g, spark.createDataFrame(pairs, "a bigint, b bigint")).collect():
        x, y = b.und[r.a], b.und[r.b]
        both = x & y
        assert r.common_neighbors == len(both) and r.preferential_attachment == len(x) * len(y)
        assert r.jaccard == pytest.approx(len(both) / len(x | y) if x | y else 0)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(b.und[z])) for z in both if len(b.und[z]) > 1))
        assert r.resource_allocation == pytest.approx(sum(1 / len(b.und[z]) for z in both))


def test_communities_and_forest(case):
    g, edges = case
    label = {i: i for i in range(N)}
    for _ in range(20):
        new = {}
        for i in range(N):
            votes = defaultdict(int)
            for e in edges:
                if e[1] == i:
                    votes[label[e[2]]] += 1
                if e[2] == i:
                    votes[label[e[1]]] += 1
            new[i] = min(votes, key=lambda k: (-votes[k], k)) if votes else label[i]
        if new == label:
            break
        label = new
    assert table(c.label_propagation(g)) == label
    found = table(c.louvain(g))
    assert set(found) == set(range(N)) and all(found[found[i]] == found[i] == min(k for k in found if found[k] == found[i]) for i in found)
    assert all(r.rank <= 2 for r in c.communities(g, top=2).collect())
    root = {i: i for i in range(N)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = count = 0
    for w, _, a, d in sorted((w, i, a, d) for i, a, d, w in edges if a != d):
        if find(a) != find(d):
            root[find(a)] = find(d)
            total, count = total + w, count + 1
    rows = t.spanning_forest(g).collect()
    assert (len(rows), sum(r.weight for r in rows)) == (count, total)


@pytest.mark.parametrize("run", [1, 64])
def test_louvain_moves_as_one_by_one(spark, monkeypatch, run):
    monkeypatch.setattr(c, "RUN", run)
    monkeypatch.setattr(t, "SLICE", 50)
    rng, n = random.Random(3), 60
    links = [(i, (i + rng.randrange(1, 4)) % n if rng.random() < 0.7 else rng.randrange(n)) for i in range(n) for _ in range(3)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(links)], "id bigint, src bigint, dst bigint")
    found = table(c.louvain(PropertyGraph(spark).with_nodes(nodes, "N").with_edges(edges, "T")))
    weight, members = defaultdict(lambda: defaultdict(int)), {i: [i] for i in range(n)}
    for a, b in links:
        weight[a][b] += 1
        weight[b][a] += 1
    while True:
        total, mass = sum(sum(w.values()) for w in weight.values()), {i: sum(weight[i].values()) for i in members}
        degree, own, moves = dict(mass), {i: i for i in members}, None
        while moves != 0:
            before, moves = dict(own), 0
            for i in sorted(members):
                to = defaultdict(int)
                for b, w in weight[i].items():
                    to[own[b]] += w * (b != i)
                mass[own[i]] -= degree[i]
                gain = {x: to[x] * total - mass[x] * degree[i] for x in [own[i], *sorted(to)]}
                own[i] = max(gain, key=gain.get)
                mass[own[i]] += degree[i]
            moves = own != before
        if all(own[i] == i for i in own):
            break
        name = {x: min(i for i in own if own[i] == x) for x in own.values()}
        merged, joint = defaultdict(lambda: defaultdict(int)), defaultdict(list)
        for i in members:
            joint[name[own[i]]] += members[i]
            for b, w in weight[i].items():
                merged[name[own[i]]][name[own[b]]] += w
        weight, members = merged, joint
    assert found == {i: min(m) for m in members.values() for i in m}


def test_max_flow(spark, case):
    g, edges = case
    cap = defaultdict(int)
    for _, a, b, w in edges:
        cap[a, b] += w
    for target in (5, 7):
        # The smallest cut over all divisions of the nodes.
        others = [i for i in range(N) if i not in (0, target)]
        best = min(
            sum(w for (a, b), w in cap.items() if a in side and b not in side)
            for k in range(len(others) + 1)
            for chosen in itertools.combinations(others, k)
            for side in [{0, *chosen}]
        )
        assert t.max_flow(g, 0, target, "weight") == best
    assert t.max_flow(g, 0, 5) == 0.0 == t.max_flow(g, 3, 3, "weight")


def test_max_flow_of_graphs_beyond_the_former_limit(spark, case, monkeypatch):
    g, edges = case
    monkeypatch.setattr(t, "local_edges", None)
    monkeypatch.setattr(t, "SLICE", 7)
    cap = defaultdict(int)
    for _, a, b, w in edges:
        cap[a, b] += w
    others = [i for i in range(N) if i not in (1, 8)]
    sides = [{1, *chosen} for k in range(len(others) + 1) for chosen in itertools.combinations(others, k)]
    assert t.max_flow(g, 1, 8, "weight") == min(sum(w for (a, b), w in cap.items() if a in side and b not in side) for side in sides)
    assert t.max_flow(g, 1, 99, "weight") == 0.0


def test_negative_weights(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    make = lambda rows: PropertyGraph(spark).with_nodes(nodes, "N").with_edges(spark.createDataFrame(rows, "id bigint, src bigint, dst bigint, cost double"), "T")
    assert t.dijkstra(make([(0, 0, 1, 5.0), (1, 1, 2, -3.0), (2, 0, 2, 4.0)]), 0, 2) == ([0, 1, 2], 2.0)
    assert not t.has_cycle(make([(0, 0, 1, 1.0), (1, 1, 2, 1.0)]))


def test_empty(spark):
    empty = PropertyGraph(spark).with_nodes(spark.createDataFrame([], "id bigint"), "N").with_edges(spark.createDataFrame([], "id bigint, src bigint, dst bigint"), "T")
    for run in (c.wcc, c.scc, c.page_rank, c.label_propagation, c.clustering, c.degree, c.louvain, c.harmonic):
        assert run(empty).count() == 0
    assert not t.has_cycle(empty) and t.spanning_forest(empty).count() == 0
