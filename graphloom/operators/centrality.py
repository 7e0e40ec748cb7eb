"""Components, centrality, communities and link scores.

Iterations are joins followed by an aggregate with map-side combining, so a hub
sends one partial row per task; every round ends in a written table. Unless
stated otherwise parallel relationships count and isolated nodes appear in the
result. Nulls among the ends match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import materialize, running_total
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.traversal import local_arrays

#: Up to so many distinct links (4 bytes each) travel to every executor for per-source searches; beyond, these are frontier joins.
BROADCAST_LINKS = 20_000_000
#: Candidates for the hubs that searches lean on; links and cells (source x node) of the searches that run together in a task.
HUBS, LINKS_AT_ONCE, CELLS = 64, 4_000_000, 64_000_000
#: Louvain compares whole runs of nodes once so many in a row have not moved.
RUN = 64
#: More than any distance.
FAR = 1 << 29
#: Sources whose searches by joins run together.
SOURCES = 1_000
#: Rounds without a test for convergence between two written tables.
CUT_ROUNDS = 5


# ---- counts -----------------------------------------------------------------


def degree(graph: PropertyGraph, direction: str = "both") -> DataFrame:
    """``(id, degree)``: distinct neighbours; ``both`` adds the distinct out- and in-neighbours."""
    links = graph.links().where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    out, come = links.select(F.col("src").alias("id")), links.select(F.col("dst").alias("id"))
    ends = {"out": out, "in": come, "both": out.unionByName(come)}[direction.lower()]
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.ids().join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def triangles(graph: PropertyGraph, types: tuple[str, ...] = (), labels: tuple[str | None, ...] = ()) -> DataFrame:
    """``count`` of assignments a->b->c->a with pairwise distinct relationships, one type and label per position.

    Links are grouped first (parallel ones multiply), so a multigraph is not expanded. Corners are ordered by degree, and
    wedges open at the lowest only: a hub pairs none of its neighbours but those of even higher degree.
    """
    wanted = [(types[i % len(types)] if types else None, labels[i] if i < len(labels) else None) for i in range(3)]
    kinds = list(dict.fromkeys(wanted))
    hops = []
    for kind, label in kinds:
        df = graph.edge_frame((kind,) if kind else ())[0].select("id", "src", "dst")
        if label is not None:
            df = df.join(graph.node_frame((label,))[0].select(F.col("id").alias("src")), "src", "left_semi")
        hops.append(materialize(df.where(F.col("src").isNotNull() & F.col("dst").isNotNull())))
    at = [kinds.index(w) for w in wanted]
    # One row per linked pair: how many links of each kind run from the lower corner to the higher one, and back.
    tagged = None
    for i, h in enumerate(hops):
        own = h.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(i))
        tagged = own if tagged is None else tagged.unionByName(own)
    tagged = materialize(tagged)
    ends = tagged.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(tagged.select("dst", "src")).distinct()
    deg = materialize(ends.groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    side = lambda n: deg.select(F.col("id").alias(n), F.col("d").alias(f"d_{n}"))
    ranked = tagged.join(side("src"), "src").join(side("dst"), "dst")
    up = F.struct("d_src", "src") < F.struct("d_dst", "dst")
    count = lambda way, i: F.sum(F.when(way & (F.col("kind") == i), F.col("n")).otherwise(0))
    pairs = ranked.groupBy(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")).agg(
        *[count(up, i).alias(f"f{i}") for i in range(len(kinds))], *[count(~up, i).alias(f"g{i}") for i in range(len(kinds))]
    )
    pairs = materialize(pairs)
    named = lambda u, v, tag: pairs.select(F.col("u").alias(u), F.col("v").alias(v), *[F.col(f"{w}{i}").alias(f"{tag}_{w}{i}") for w in "fg" for i in range(len(kinds))])
    higher = deg.select(F.col("id").alias("w"), F.col("d").alias("dw")), deg.select(F.col("id").alias("v"), F.col("d").alias("dv"))
    wedges = named("u", "v", "uv").join(higher[1], "v").join(named("u", "w", "uw").join(higher[0], "w"), "u").where(F.struct("dv", "v") < F.struct("dw", "w"))
    closed = wedges.join(named("v", "w", "vw"), ["v", "w"])
    n = lambda name, i: F.col(f"{name}{at[i % 3]}")
    per_triangle = sum(
        (n("uv_f", i) * n("vw_f", i + 1) * n("uw_g", i + 2) + n("uw_f", i) * n("vw_g", i + 1) * n("uv_g", i + 2) for i in range(1, 3)),
        n("uv_f", 0) * n("vw_f", 1) * n("uw_g", 2) + n("uw_f", 0) * n("vw_g", 1) * n("uv_g", 2),
    )
    parts = [closed.agg(F.coalesce(F.sum(per_triangle), F.lit(0)).alias("n"))]
    # Walks with fewer than three corners hold self-loops, which are counted one by one.
    loops = [hops[k].where("src = dst").select(F.col("id").alias(f"l{i}"), F.col("src").alias(f"v{i}")) for i, k in enumerate(at)]
    parts.append(
        loops[0].join(loops[1], (F.col("v0") == F.col("v1")) & (F.col("l0") != F.col("l1")))
        .join(loops[2], (F.col("v0") == F.col("v2")) & (F.col("l2") != F.col("l0")) & (F.col("l2") != F.col("l1")))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    for i in range(3):  # a loop at position i, and a 2-cycle at the other two through the same node
        there, back = at[(i + 1) % 3], at[(i + 2) % 3]
        x = tagged.where(F.col("kind") == there).select(F.col("src").alias("p"), F.col("dst").alias("q"), F.col("n").alias("nx"))
        y = tagged.where(F.col("kind") == back).select(F.col("src").alias("q"), F.col("dst").alias("p"), F.col("n").alias("ny"))
        at_loop = loops[i].groupBy(F.col(f"v{i}").alias("p")).agg(F.count(F.lit(1)).alias("nl"))
        parts.append(x.join(at_loop, "p").join(y, ["p", "q"]).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny") * F.col("nl")), F.lit(0)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("n").cast("bigint").alias("count"))


def _undirected(graph: PropertyGraph) -> DataFrame:
    """Distinct neighbour pairs ``(a, b)`` in both directions, without self-loops."""
    links = graph.links().where(F.col("src") != F.col("dst"))
    return links.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select("dst", "src")).distinct()


def clustering(graph: PropertyGraph) -> DataFrame:
    """``(id, score)``: the share of neighbour pairs that are neighbours, 0 below two neighbours.

    Each triangle is found once, from its two lower-degree ends, which keeps hubs from pairing all their neighbours.
    """
    pairs = materialize(_undirected(graph))
    deg = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = materialize(ranked.where(F.struct("da", "a") < F.struct("db", "b")).select("a", "b"))
    wedge = up.join(up.select("a", F.col("b").alias("c")), "a").where("b <> c")
    closed = wedge.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    score = F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return graph.ids().join(deg, "id", "left").join(corners, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def link_scores(graph: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """`pairs` ``(a, b)`` with the five neighbourhood scores; unknown nodes score 0.

    Only the neighbours of a pair's end of lower degree are listed, and looked up at the other end.
    """
    near = materialize(_undirected(graph))
    deg = materialize(near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d")))
    side = lambda n, k: deg.select(F.col("id").alias(n), F.col("d").alias(k))
    wanted = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    wanted = materialize(wanted.join(side("x", "dx"), "x", "left").join(side("y", "dy"), "y", "left"))
    first = F.struct("dx", "x") <= F.struct("dy", "y")
    low, high = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    common = (
        wanted.where("dx IS NOT NULL AND dy IS NOT NULL")
        .select("x", "y", low.alias("low"), high.alias("high"))
        .join(near.select(F.col("a").alias("low"), F.col("b").alias("z")), "low")
        .join(near.select(F.col("a").alias("high"), F.col("b").alias("z")), ["high", "z"])
        .where("z <> x AND z <> y")
        .join(deg.select(F.col("id").alias("z"), F.col("d").alias("dz")), "z")
        .groupBy("x", "y")
        .agg(
            F.count(F.lit(1)).alias("common"),
            F.sum(F.when(F.col("dz") > 1, 1.0 / F.log(F.col("dz").cast("double"))).otherwise(0.0)).alias("aa"),
            F.sum(1.0 / F.col("dz")).alias("ra"),
        )
    )
    all_ = wanted.join(common, ["x", "y"], "left")
    n = F.coalesce("common", F.lit(0))
    dx, dy = F.coalesce("dx", F.lit(0)), F.coalesce("dy", F.lit(0))
    return all_.select(
        F.col("x").alias("a"),
        F.col("y").alias("b"),
        n.alias("common_neighbors"),
        F.when(dx + dy - n > 0, n / (dx + dy - n)).otherwise(0.0).alias("jaccard"),
        F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"),
        F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"),
        (dx * dy).alias("preferential_attachment"),
    )


# ---- components ------------------------------------------------------------------


def connected_components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest node id of the weakly connected component.

    Alternating star contraction: links are rewired to ever smaller representatives, which halves the depth of the
    trees and needs few rounds; every step is a grouped minimum.
    """
    edges = links.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    edges = materialize(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Larger neighbours of every node are linked to its smallest neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        # Every node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct()
        small = materialize(small)
        same = small.count() == edges.count() and not small.exceptAll(edges).take(1)
        edges = small
        if same:
            break
    roots = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def wcc(graph: PropertyGraph) -> DataFrame:
    return connected_components(graph.ids(), graph.links())


def scc(graph: PropertyGraph) -> DataFrame:
    """``(id, component)``: the smallest node id of the strongly connected component.

    Forward colouring with the smallest reaching id, then the nodes that reach their colour's root backwards form its
    component; they are removed and the rest starts again. Nodes without links either way go first, each round.
    """
    left = materialize(graph.ids())
    edges = materialize(graph.links().where("src <> dst").distinct())
    done = []
    while True:
        while True:  # trim: a node without incoming or outgoing links is its own component
            inside = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            inside = materialize(inside)
            alone = left.join(inside, "id", "left_anti")
            done.append(materialize(alone.select("id", F.col("id").alias("component"))))
            before = edges.count()
            edges = materialize(
                edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
            )
            left = inside
            if edges.count() == before:
                break
        if not left.take(1):
            break
        colour = materialize(left.select("id", F.col("id").alias("c")))
        while True:
            offers = edges.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("o"))
            new = materialize(
                colour.join(offers, "id", "left").select("id", F.least("c", F.coalesce("o", "c")).alias("c"), (F.col("o") < F.col("c")).alias("moved"))
            )
            colour = new.drop("moved")
            if not new.where("moved").take(1):
                break
        same = materialize(
            edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
            .join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
            .where("cs = cd")
            .select("src", "dst")
        )
        frontier = materialize(colour.where("id = c"))
        members = frontier
        while True:
            fresh = frontier.select(F.col("id").alias("dst"), "c").join(same, "dst").select(F.col("src").alias("id"), "c").distinct()
            fresh = materialize(fresh.join(members, "id", "left_anti"))
            if not fresh.take(1):
                break
            members, frontier = members.unionByName(fresh), fresh
        members = materialize(members)
        done.append(members.select("id", F.col("c").alias("component")))
        left = materialize(left.join(members, "id", "left_anti"))
        edges = materialize(
            edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# ---- iterative scores ------------------------------------------------------------


def page_rank(graph: PropertyGraph, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``(id, score)``: fixed rounds from 1/n; the mass of nodes without outgoing links is not redistributed."""
    ids = materialize(graph.ids())
    n = ids.count()
    links = graph.links().where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    share = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    flow = materialize(share.join(out, "src").select("src", "dst", (F.col("k") / F.col("total")).alias("part")))
    rank = ids.select("id", F.lit(1.0 / max(n, 1)).alias("score"))
    for round_ in range(iterations):
        sent = flow.join(rank.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("part") * F.col("score")).alias("got"))
        rank = ids.join(sent, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if (round_ + 1) % CUT_ROUNDS == 0:  # no round is read twice, so lineage is cut for its length only
            rank = materialize(rank)
    return rank


def _power(graph: PropertyGraph, start: float, iterations: int, tolerance: float, step: Callable) -> DataFrame:
    """Rounds of x' = step(sum of x over incoming links) until the L2 change is at most `tolerance`."""
    ids = materialize(graph.ids())
    links = materialize(graph.links().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")))
    x = ids.select("id", F.lit(start).alias("score"))
    for _ in range(iterations):
        come = links.join(x.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("k") * F.col("score")).alias("got"))
        new = x.join(come, "id", "left").select("id", F.col("score").alias("old"), F.coalesce("got", F.lit(0.0)).alias("got"))
        new = step(materialize(new))
        if new is None:
            return x
        new = materialize(new)
        change = new.agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("old"), 2)))).first()[0] or 0.0
        x = new.select("id", "score")
        if change <= tolerance:
            break
    return x


def eigenvector(graph: PropertyGraph, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``(id, score)`` by incoming power iteration, scaled to the sum n; uniform if the graph gives no direction."""
    n = graph.node_count()
    collapsed = []

    def step(df: DataFrame) -> DataFrame | None:
        norm = df.agg(F.sqrt(F.sum(F.col("got") * F.col("got")))).first()[0] or 0.0
        if norm == 0:
            collapsed.append(True)
            return None
        return df.select("id", "old", (F.col("got") / norm).alias("score"))

    x = _power(graph, 1.0 / max(n, 1), iterations, tolerance, step)
    if collapsed:
        return graph.ids().select("id", F.lit(1.0 / max(n, 1)).alias("score"))
    total = x.agg(F.sum("score")).first()[0] or 1.0
    return x.select("id", (F.col("score") * (n / total)).alias("score"))


def katz(graph: PropertyGraph, alpha: float = 0.1, beta: float = 1.0, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``(id, score)``: x = alpha A'x + beta, from beta."""
    return _power(graph, beta, iterations, tolerance, lambda df: df.select("id", "old", (alpha * F.col("got") + beta).alias("score")))


def label_propagation(graph: PropertyGraph, iterations: int = 20) -> DataFrame:
    """``(id, community)``: synchronous rounds; every link votes both ways, most votes win, ties go to the smaller label."""
    ids = materialize(graph.ids())
    links = graph.links().where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ways = materialize(links.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select("dst", "src")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")))
    label = ids.select("id", F.col("id").alias("community"))
    for _ in range(iterations):
        votes = ways.join(label.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("k").alias("votes"))
        won = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("community")).alias("negated"))).alias("w"))
        new = label.withColumnRenamed("community", "old").join(won, "id", "left")
        new = materialize(new.select("id", "old", F.coalesce(-F.col("w.negated"), F.col("old")).alias("community")))
        label = new.select("id", "community")
        if not new.where("old <> community").take(1):
            break
    return label


# ---- per-source searches -------------------------------------------------------------


class _Adjacency:
    """Distinct outgoing links as arrays, and the hub that each node's searches can lean on.

    Of the nodes with the most incoming times outgoing links, a node takes the first one that it reaches (`hub`, at
    distance `away`). Whatever is at least as near over the hub need not be searched for: it follows from the hub's own search.
    """

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray):
        self.ids = np.unique(np.concatenate([ids, src, dst]))
        self.own = np.isin(self.ids, ids)
        a, b = (np.searchsorted(self.ids, x).astype(np.int32) for x in (src, dst))
        self.start, self.target = self._rows(a, b)
        self.hub, self.away = np.full(len(self.ids), -1, np.int32), np.full(len(self.ids), FAR, np.int32)
        self._near: tuple = (None,)
        back = self.back = object.__new__(_Adjacency)
        back.ids, (back.start, back.target) = self.ids, self._rows(b, a)
        busy = np.diff(self.start).astype(float) * np.diff(back.start)
        for h in np.argsort(-busy, kind="stable")[:HUBS]:
            if busy[h] and self.hub[h] < 0:  # else whatever reaches it reaches an earlier hub
                away = back.depths(h)
                mine = (away < FAR) & (self.hub < 0)
                self.hub[mine], self.away[mine] = h, away[mine]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "back"} | {"_near": (None,)}

    def _rows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(self.ids)))]), b[order]

    def expand(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all links out of the frontier the place of the source in it, and the target."""
        first = self.start[frontier]
        count = self.start[frontier + 1] - first
        place = np.repeat(np.arange(len(frontier)), count)
        return place, self.target[np.arange(len(place)) + np.repeat(first - np.cumsum(count) + count, count)]

    def depths(self, source: int) -> np.ndarray:
        """The distance of every node from one, FAR where there is no path."""
        depth = np.full(len(self.ids), FAR, np.int32)
        depth[source], frontier, d = 0, np.array([source]), 0
        while len(frontier):
            d += 1
            target = self.expand(frontier)[1]
            frontier = np.unique(target[depth[target] == FAR])
            depth[frontier] = d
        return depth

    def path_counts(self, source: int, depth: np.ndarray) -> np.ndarray:
        """The number of shortest paths from a node to every other one, given the distances."""
        paths = np.zeros(len(self.ids))
        paths[source] = 1.0
        for layer in self._layers(depth)[:-1]:
            place, target = self.expand(layer)
            down = np.flatnonzero(depth[target] == depth[layer[0]] + 1)
            np.add.at(paths, target[down], paths[layer][place[down]])
        return paths

    def carried(self, source: int, depth: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Per node the weights of the targets behind it, by its share of the shortest paths from the source, which gets 0."""
        paths, share = self.path_counts(source, depth), np.zeros(len(self.ids))
        for layer in reversed(self._layers(depth)[:-1]):
            place, target = self.expand(layer)
            down = np.flatnonzero(depth[target] == depth[layer[0]] + 1)
            place, target = place[down], target[down]
            share[layer] = np.bincount(place, paths[layer][place] / paths[target] * (weight[target] + share[target]), len(layer))
        share[source] = 0.0
        return share

    def _layers(self, depth: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(depth, kind="stable")[: (depth < FAR).sum()]
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def count_to_hubs(self) -> None:
        """Add the number of shortest paths of every node to its hub."""
        self.paths_to_hub = np.zeros(len(self.ids))
        for hub in np.unique(self.hub[self.hub >= 0]):
            mine = self.hub == hub
            self.paths_to_hub[mine] = self.back.path_counts(hub, self.back.depths(hub))[mine]

    def near(self, hub: int) -> np.ndarray:
        """Distances from a hub (-1: from none), those of the last one kept."""
        if self._near[0] != hub:
            self._near = hub, self.depths(hub) if hub >= 0 else np.full(len(self.ids), FAR, np.int32)
        return self._near[1]

    def searches(self, sources: np.ndarray, ties: bool) -> Iterator[tuple[int, np.ndarray, list[tuple]]]:
        """Groups of sources with one hub, and their levels ``(owner, node, paths, place, link)``.

        Only nodes nearer than over the hub are visited, with `ties` also those as near without passing it. Owners are
        places in the group; `place` and `link` are the ends of the links into a level, as places in the level before and in
        this one.
        """
        n = len(self.ids)
        size = max(1, min(256, CELLS // max(n, 1)))
        seen = np.zeros(size * n, bool)
        for hub in np.unique(self.hub[sources]):
            near = self.near(hub)
            most = near.copy() if ties else near - 1
            if hub >= 0:
                most[hub] = -1
            with_hub = sources[self.hub[sources] == hub]
            todo = [with_hub[i : i + size] for i in range(0, len(with_hub), size)]
            while todo:
                mine = todo.pop()
                levels = self._levels(mine, most, seen, ties)
                if levels is None:  # too many links at once: half the sources at a time
                    todo += [mine[: len(mine) // 2], mine[len(mine) // 2 :]]
                else:
                    yield int(hub), mine, levels

    def _levels(self, mine: np.ndarray, most: np.ndarray, seen: np.ndarray, counted: bool) -> list[tuple] | None:
        n, away = len(self.ids), self.away[mine]
        owner, node, paths = np.arange(len(mine)), mine, np.ones(len(mine))
        touched, levels = [owner * n + node], [(owner, node, paths, None, None)]
        seen[touched[0]] = True
        while len(node):
            if len(mine) > 1 and (self.start[node + 1] - self.start[node]).sum() > LINKS_AT_ONCE:
                levels = None
                break
            place, target = self.expand(node)
            fits = np.flatnonzero(most[target] + away[owner[place]] >= len(levels))
            place, key = place[fits], owner[place[fits]] * n + target[fits]
            new = ~seen[key]
            place, key = place[new], key[new]
            if counted:
                key, link = np.unique(key, return_inverse=True)
                paths = np.bincount(link, paths[place], len(key))
            else:
                key, link = np.unique(key), None
            seen[key] = True
            touched.append(key)
            owner, node = np.divmod(key, n)
            if len(node):
                levels.append((owner, node, paths, place, link))
        for key in touched:
            seen[key] = False
        return levels


def _shared(graph: PropertyGraph) -> tuple[DataFrame, DataFrame, bool]:
    """Distinct nodes and links (without loops), and whether they are small enough to travel to every executor."""
    ids = materialize(graph.ids().distinct())
    links = materialize(graph.links().where("src <> dst").distinct())
    return ids, links, links.count() <= BROADCAST_LINKS and ids.count() <= BROADCAST_LINKS


def _adjacency(ids: DataFrame, links: DataFrame) -> _Adjacency:
    """The graph as arrays on the driver; `_shared` has bounded it."""
    return _Adjacency(*local_arrays(ids), *local_arrays(links))


def _per_source(ids: DataFrame, g: _Adjacency, work: Callable, ddl: str) -> DataFrame:
    """Run `work(adjacency, batches of sources)` over all sources, spread over the tasks."""
    context = ids.sparkSession.sparkContext
    shared = context.broadcast(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(shared.value, (np.searchsorted(shared.value.ids, b["id"].to_numpy()) for b in batches if len(b)))

    tasks = max(1, min(len(g.ids) // 8, 2 * context.defaultParallelism))
    return ids.repartition(tasks).mapInPandas(run, ddl)


def _distance_sums(g: _Adjacency, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """``(id, harmonic, reached, total)``: what the hub reaches, as far as it is from there, corrected by what is nearer."""
    inverse = lambda d: np.divide(1.0, d, out=np.zeros(len(d)), where=d > 0)
    for sources in batches:
        last, base = None, {}
        for hub, mine, levels in g.searches(sources, ties=False):
            near, away = g.near(hub), g.away[mine].astype(np.int64)
            if hub != last:
                last, base, far = hub, {}, np.bincount(near[near < FAR])
            steps = np.arange(len(far))
            for a in np.unique(away):
                if a not in base:
                    base[a] = (far @ inverse(a + steps), far.sum(), far @ (a + steps))
            harmonic_, reached, total = (np.array(x) for x in zip(*(base[a] for a in away)))
            for d, (owner, node, *_) in enumerate(levels):
                over = near[node].astype(np.int64) + away[owner]
                known = over < FAR
                over[~known] = 0
                sums = lambda weights: np.bincount(owner, weights, len(mine))  # noqa: B023, E731
                harmonic_ = harmonic_ + sums((1.0 / d if d else 0.0) - inverse(over))
                reached = reached + sums(~known).astype(np.int64)
                total = total + sums(d - over).astype(np.int64)
            yield pd.DataFrame({"id": g.ids[mine], "harmonic": harmonic_.astype(float), "reached": reached - 1, "total": total})


def _blocks(ids: DataFrame) -> Iterator[DataFrame]:
    """The sources ``(s, id, d)`` of a search by joins, block by block: a block's searches are held together, not those of all nodes."""
    count = -(-ids.count() // SOURCES)
    for block in range(count):
        mine = ids.where(F.pmod(F.xxhash64("id"), F.lit(count)) == block)
        yield materialize(mine.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))


def _search_levels(links: DataFrame, starts: DataFrame) -> list[DataFrame]:
    """Per hop distance the ``(s, id, d, paths)`` first reached there, with the number of shortest paths, by frontier joins."""
    known, levels = starts, [starts]
    while True:
        frontier = levels[-1]
        fresh = frontier.join(links, frontier["id"] == links["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        fresh = fresh.join(known.select("s", "id"), ["s", "id"], "left_anti")
        fresh = materialize(fresh.select("s", "id", F.lit(len(levels)).alias("d"), "paths"))
        if not fresh.take(1):
            return levels
        levels.append(fresh)
        known = known.unionByName(fresh)


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sums(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, harmonic, reached, total)`` over the nodes each node reaches, for graphs that no executor can hold."""
    done = [ids.limit(0).select("id", F.lit(0.0).alias("harmonic"), F.lit(0).cast("bigint").alias("reached"), F.lit(0).cast("bigint").alias("total"))]
    for starts in _blocks(ids):
        seen = _joined(_search_levels(links, starts))
        part = F.when(F.col("d") > 0, 1.0 / F.col("d")).otherwise(0.0)
        done.append(
            materialize(
                seen.groupBy(F.col("s").alias("id")).agg(F.sum(part).alias("harmonic"), (F.count(F.lit(1)) - 1).alias("reached"), F.sum("d").alias("total"))
            )
        )
    return _joined(done)


def _all_sums(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """The distinct nodes, and `_sums` by whichever way the size allows."""
    ids, links, small = _shared(graph)
    if not small:
        return ids, _sums(ids, links)
    return ids, _per_source(ids, _adjacency(ids, links), _distance_sums, "id bigint, harmonic double, reached bigint, total bigint")


def harmonic(graph: PropertyGraph) -> DataFrame:
    """``(id, score)``: the sum of 1/distance over the nodes that outgoing links reach."""
    return _all_sums(graph)[1].select("id", F.col("harmonic").alias("score"))


def closeness(graph: PropertyGraph) -> DataFrame:
    """``(id, score)``: (r / sum of distances) (r / (n - 1)) for r reached nodes, 0 if there are none."""
    ids, sums = _all_sums(graph)
    r, t, others = F.col("reached"), F.col("total"), ids.count() - 1
    return sums.select("id", F.when(t > 0, r / t * r / F.lit(others)).otherwise(0.0).alias("score"))


def _shares(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, part)``: the dependencies of the sources of every block, accumulated backwards level by level."""
    done = [ids.limit(0).select("id", F.lit(0.0).alias("part"))]
    for starts in _blocks(ids):
        levels = _search_levels(links, starts)
        later = levels[-1].select("s", "id", "paths", F.lit(0.0).alias("share"))
        for level in reversed(levels[:-1]):
            sent = links.join(later.withColumnRenamed("id", "dst"), "dst").groupBy("s", F.col("src").alias("id")).agg(F.sum((F.col("share") + 1.0) / F.col("paths")).alias("per_path"))
            own = level.join(sent, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("per_path", F.lit(0.0))).alias("share"))
            later = materialize(own)
            done.append(later.where("s <> id").groupBy("id").agg(F.sum("share").alias("part")))
        if len(done) > 64:  # one written table for many levels
            done = [materialize(_joined(done).groupBy("id").agg(F.sum("part").alias("part")))]
    return _joined(done)


def _dependencies(g: _Adjacency, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """``(kind, hub, at, part)``: scores by paths that avoid the hub (kind 0), and by how much the paths over the hub are
    fewer than all, per source (1) and per hub and target (2)."""
    n = len(g.ids)
    score, first, second = np.zeros(n), np.zeros(n), {}
    counts: dict[int, np.ndarray] = {}
    for sources in batches:
        for hub, mine, levels in g.searches(sources[g.hub[sources] != sources], ties=True):
            near, away = g.near(hub), g.away[mine]
            if hub >= 0 and hub not in counts:
                counts = {hub: g.path_counts(hub, near)}
            if hub >= 0:
                back = second.setdefault(hub, np.zeros(n))
                to_hub = g.paths_to_hub[mine]
            share = np.zeros(len(levels[-1][0]))
            for d in range(len(levels) - 1, -1, -1):
                owner, node, paths, place, link = levels[d]
                own = np.ones(len(node))
                if hub >= 0:
                    over = near[node] + away[owner]
                    tie = np.flatnonzero(over == d)
                    own[tie] = paths[tie] / (paths[tie] + to_hub[owner[tie]] * counts[hub][node[tie]])
                    known = near[node] < FAR
                    first[mine] += np.bincount(owner[known], own[known], len(mine))
                    np.add.at(back, node[known], own[known])
                if d:
                    np.add.at(score, node, share)
                    before = levels[d - 1][2]
                    share = np.bincount(place, before[place] / paths[link] * (own + share)[link], len(before))
    for kind, hub, part in [(0, -1, score), (1, -1, first), *((2, h, x) for h, x in second.items())]:
        at = np.flatnonzero(part)
        yield pd.DataFrame({"kind": kind, "hub": hub, "at": at, "part": part[at]})


def _gathered(g: _Adjacency, parts: pd.DataFrame) -> np.ndarray:
    """The scores of all nodes from the rows of `_dependencies`."""

    def of(kind: int, hub: int) -> np.ndarray:
        mine = parts[(parts["kind"] == kind) & (parts["hub"] == hub)]
        return np.bincount(mine["at"], mine["part"], len(g.ids)).astype(float)

    score, fewer = of(0, -1), of(1, -1)
    for hub in np.unique(g.hub[g.hub >= 0]):
        near = g.near(hub)
        reached, mine = near < FAR, (g.hub == hub) & g.own
        reached[hub] = mine[hub] = False
        pairs = np.where(mine, np.maximum(reached.sum() - fewer, 0.0), 0.0)
        to = np.where(mine, pairs + 1.0, 0.0)  # the hub is a target too
        score += g.back.carried(hub, g.back.depths(hub), to)
        from_ = np.where(reached, np.maximum(mine.sum() - of(2, hub), 0.0) + g.own[hub], 0.0)  # and a source
        score += g.carried(hub, near, from_)
        score[hub] += pairs.sum()
    return score


def betweenness(graph: PropertyGraph) -> DataFrame:
    """``(id, score)``: directed, unnormalised; parallel links count once.

    A shortest path leads over the hub of its source or avoids it. Paths that avoid it are searched for source by source,
    and only as far as they are not longer. The others consist of a path to the hub and one from it, so one search each way
    carries the scores of all of them, weighted by the pairs of nodes they connect.
    """
    ids, links, small = _shared(graph)
    if small:
        g = _adjacency(ids, links)
        g.count_to_hubs()
        parts = _per_source(ids, g, _dependencies, "kind int, hub int, at int, part double").groupBy("kind", "hub", "at").agg(F.sum("part").alias("part")).toArrow().to_pandas()
        parts = graph.spark.createDataFrame(pa.table({"id": g.ids, "part": _gathered(g, parts)}))
    else:
        parts = _shares(ids, links).groupBy("id").agg(F.sum("part").alias("part"))
    return graph.ids().join(parts, "id", "left").select("id", F.coalesce("part", F.lit(0.0)).alias("score"))


# ---- communities -----------------------------------------------------------------


def _moved(start: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, bool]:
    """The community of each node after greedy moves in ascending order until none gains, and whether any moved.

    Gains are compared as whole numbers (times the total weight). While moves are frequent, nodes are taken one by one. When
    they are rare, runs of nodes are compared at once: up to the first of a run that moves, nothing changes for the others.
    """
    count = len(start) - 1
    source = np.repeat(np.arange(count), np.diff(start))
    degrees = np.bincount(source, weight, count).astype(np.int64)
    total, degree_ = int(degrees.sum()), degrees.tolist()
    apart = source != target
    first = np.concatenate([[0], np.cumsum(np.bincount(source[apart], minlength=count))])
    source, target, weight = source[apart], target[apart], weight[apart]
    ends = first.tolist()
    own, mass = np.arange(count), degrees.copy()

    def best_of(n: int) -> int:
        """The community that node `n` gains most by, its own among equals, then the smallest."""
        near, w = own[target[ends[n] : ends[n + 1]]], weight[ends[n] : ends[n + 1]]
        here, d = own[n], degree_[n]
        if len(near) > 200:
            near, at = np.unique(near, return_inverse=True)
            w = np.bincount(at, w).astype(np.int64)
        to: dict[int, int] = {}
        for c, k in zip(near.tolist(), w.tolist()):
            to[c] = to.get(c, 0) + k
        here = int(here)
        best, gain = here, to.get(here, 0) * total - (int(mass[here]) - d) * d
        masses = mass[list(to)].tolist()
        for (c, k), m in zip(to.items(), masses):
            if c != here:
                g = k * total - m * d
                if g > gain or (g == gain and best != here and c < best):
                    best, gain = c, g
        return best

    def first_mover(low: int, high: int) -> int:
        """The first node of a run that gains by a move, or `high`."""
        links = slice(ends[low], ends[high])
        key = (source[links] - low) * count + own[target[links]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
        to = np.add.reduceat(weight[links][order], cuts) if len(key) else np.array([], int)
        node, c = np.divmod(key[cuts], count)
        here, d = own[low:high], degrees[low:high]
        stay = -(mass[here] - d) * d
        inside = c == here[node]
        stay[node[inside]] += to[inside] * total
        gains = np.flatnonzero(~inside & (to * total - mass[c] * d[node] > stay[node]))
        return low + int(node[gains[0]]) if len(gains) else high

    moved, moves, run = False, count, 0
    while moves:
        moves, n = 0, 0
        while n < count:
            if run:
                high = min(count, n + run)
                n = first_mover(n, high)
                run = min(2 * run, 65_536) if n == high else run // 2
                if n == high or n == count:
                    continue
                run = run if run >= RUN else 0
            best, here = best_of(n), int(own[n])
            if best != here:
                mass[here] -= degree_[n]
                mass[best] += degree_[n]
                own[n], moves, moved, still = best, moves + 1, True, 0
            else:
                still = still + 1 if n else 0
                if still >= RUN:
                    run = RUN
            n += 1
    return own, moved


def louvain(graph: PropertyGraph) -> DataFrame:
    """``(id, community)``: greedy modularity moves in ascending node order, level by level; named by the smallest member.

    Moves depend on each other one by one, so linked nodes are grouped on the driver, which holds their links as arrays;
    nodes without links stay in the cluster.
    """
    links = graph.links().where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    src, dst, k = local_arrays(materialize(links))
    ids = np.unique(np.concatenate([src, dst]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    a, b, k = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([k, k])  # a loop counts at both its ends
    group, size, moved = np.arange(len(ids)), len(ids), len(ids) > 0
    while moved:
        key, at = np.unique(a * size + b, return_inverse=True)
        k = np.bincount(at, k).astype(np.int64)
        a, b = np.divmod(key, size)
        own, moved = _moved(np.searchsorted(a, np.arange(size + 1)), b, k)
        _, least, at = np.unique(own, return_index=True, return_inverse=True)
        place = np.empty(len(least), np.int64)
        place[np.argsort(least)] = np.arange(len(least))  # communities in the order of their smallest members
        group, a, b, size = place[at][group], place[at][a], place[at][b], len(least)
    _, least = np.unique(group, return_index=True)
    found = graph.spark.createDataFrame(pa.table({"id": ids, "community": ids[least[group]] if len(ids) else ids}))
    return graph.ids().distinct().join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def communities(graph: PropertyGraph, iterations: int = 20, top: int | None = None, algorithm: str = "labelPropagation") -> DataFrame:
    """``(community, id, rank)``: members of each community by falling PageRank, then id; rank counts from 1."""
    if algorithm not in ("labelPropagation", "louvain"):
        raise ValueError(f"unknown community algorithm {algorithm}")
    found = louvain(graph) if algorithm == "louvain" else label_propagation(graph, iterations)
    # A community may be the whole graph, so ranks are running totals, not a window over it.
    scored = found.join(page_rank(graph), "id").select("community", "id", (-F.col("score")).alias("_order"), F.lit(1).alias("_one"))
    ranked = running_total(scored, ["community"], ["_order", "id"], "_one", "rank").withColumn("rank", F.col("rank").cast("bigint"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("community", "id", "rank")
