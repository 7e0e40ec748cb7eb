"""Built-in procedures of CALL. Each takes (graph, arguments or None, parameters) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import centrality, search, traversal
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.syntax import QueryError


def table_procedure(rows: DataFrame, inputs: tuple[str, ...] = ()) -> Callable:
    """A procedure over a fixed table: rows whose `inputs` columns equal the arguments, the other columns as outputs."""

    def run(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
        values = [params[n] for n in inputs] if args is None else args
        if len(values) != len(inputs):
            raise QueryError(f"the procedure takes {len(inputs)} arguments")
        out = rows
        for n, value in zip(inputs, values):
            out = out.where(F.col(n).eqNullSafe(F.lit(value)) if value is None else F.col(n) == F.lit(value))
        return out.drop(*inputs)

    return run


def _config(args: list | None, params: dict, *allowed: str) -> dict[str, Any]:
    if args is None:
        return {k: params[k] for k in allowed if k in params}
    if len(args) > 1 or args and not isinstance(args[0], dict):
        raise QueryError("the procedure takes one configuration map")
    config = args[0] if args else {}
    if unknown := set(config) - set(allowed):
        raise QueryError(f"unknown settings: {', '.join(sorted(unknown))}")
    return config


def _positional(args: list | None, params: dict, *names: str) -> list:
    if args is None:
        missing = [n for n in names if n not in params]
        if missing:
            raise QueryError(f"missing parameters: {', '.join(missing)}")
        return [params[n] for n in names]
    if len(args) != len(names):
        raise QueryError(f"the procedure takes {len(names)} arguments")
    return args


def _scores(run: Callable, value: str, output: str, **settings: str) -> Callable:
    """A per-node procedure; `settings` maps configuration keys to keyword arguments."""

    def procedure(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
        config = _config(args, params, *settings)
        rows = run(graph, **{settings[k]: x for k, x in config.items()})
        return rows.select(F.col("id").alias("nodeId"), F.col(value).alias(output))

    return procedure


def _degree(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    way = str(_config(args, params, "direction").get("direction", "BOTH")).lower()
    if way not in ("in", "out", "both"):
        raise QueryError(f"unknown direction {way}")
    return centrality.degree(graph, way).select(F.col("id").alias("nodeId"), F.col("degree").cast("double").alias("score"))


def _communities(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    c = _config(args, params, "maxIterations", "topPerCommunity", "algorithm")
    rows = centrality.communities(graph, c.get("maxIterations", 20), c.get("topPerCommunity"), c.get("algorithm", "labelPropagation"))
    return rows.select(F.col("community").alias("communityId"), F.col("id").alias("nodeId"), "rank")


def _triangles(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    c = _config(args, params, "relTypes", "labels")
    types = c.get("relTypes") or []
    labels = c.get("labels") or []
    types = [types] if isinstance(types, str) else types
    labels = [labels] * 3 if isinstance(labels, str) else labels
    return centrality.triangles(graph, tuple(types), tuple(labels))


def _shortest(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    a, b = _positional(args, params, "srcId", "dstId")
    path = traversal.shortest_path(graph, a, b) or []
    return graph.spark.createDataFrame(list(enumerate(path)), "index bigint, nodeId bigint")


def _dijkstra(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    a, b = _positional(args, params, "srcId", "dstId")
    path, total = traversal.dijkstra(graph, a, b) or ([], 0.0)
    return graph.spark.createDataFrame([(i, n, total) for i, n in enumerate(path)], "index bigint, nodeId bigint, totalWeight double")


def _named(config: dict, names: dict[str, str]) -> dict[str, Any]:
    if unknown := set(config) - set(names):
        raise QueryError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {names[k]: x for k, x in config.items()}


def _retrieve_vector(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    query, *rest = args if args is not None else _positional(None, params, "queryVector")
    settings = _named(rest[0] if rest else {}, {"k": "k", "hops": "hops", "maxDistance": "max_distance", "maxNodes": "max_nodes"})
    return search.retrieve(graph, query, **settings).nodes.select(F.col("node").alias("nodeId"), F.col("score").alias("distance"))


def _retrieve_hybrid(graph: PropertyGraph, args: list | None, params: dict) -> DataFrame:
    vector, text, *rest = args if args is not None else _positional(None, params, "queryVector", "queryText")
    config = dict(rest[0]) if rest else {}
    fusion = config.pop("fusion", "rrf")
    names = {"vectorK": "vector_k", "textK": "text_k", "hops": "hops", "maxDistance": "max_distance", "maxNodes": "max_nodes", "textLabel": "text_label", "textProperty": "text_property", "vectorLabel": "vector_label"}
    settings = _named(config, names)
    if isinstance(fusion, dict):
        if "k" in fusion:
            settings["k"] = float(fusion["k"])
        else:
            settings |= {"strategy": "weighted", "weights": (float(fusion.get("vectorWeight", 0.5)), float(fusion.get("textWeight", 0.5)))}
    elif str(fusion).lower() != "rrf":
        raise QueryError(f"unknown fusion {fusion}")
    return search.retrieve_hybrid(graph, vector, text, **settings).nodes.select(F.col("node").alias("nodeId"), "score")


PROCEDURES: dict[str, Callable] = {
    "pagerank": _scores(centrality.page_rank, "score", "score", iterations="iterations", damping="damping"),
    "betweenness": _scores(centrality.betweenness, "score", "score"),
    "harmonic": _scores(centrality.harmonic, "score", "score"),
    "closeness": _scores(centrality.closeness, "score", "score"),
    "clusteringcoefficient": _scores(centrality.clustering, "score", "score"),
    "eigenvector": _scores(centrality.eigenvector, "score", "score", iterations="iterations", tolerance="tolerance"),
    "katz": _scores(centrality.katz, "score", "score", alpha="alpha", beta="beta", iterations="iterations", tolerance="tolerance"),
    "degree": _degree,
    "wcc": _scores(centrality.wcc, "component", "componentId"),
    "connectedcomponents": _scores(centrality.wcc, "component", "componentId"),
    "scc": _scores(centrality.scc, "component", "componentId"),
    "stronglyconnectedcomponents": _scores(centrality.scc, "component", "componentId"),
    "labelpropagation": _scores(centrality.label_propagation, "community", "communityId", maxIterations="iterations"),
    "louvain": _scores(centrality.louvain, "community", "communityId"),
    "communities": _communities,
    "trianglecount": _triangles,
    "shortestpath": _shortest,
    "dijkstra": _dijkstra,
    "retrieve.vector": _retrieve_vector,
    "retrieve.hybrid": _retrieve_hybrid,
}
