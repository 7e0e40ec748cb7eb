"""Full-text, vector and hybrid search, and retrieval of the graph around the hits.

A text index is two tables: ``postings(node, label, property, term, tf)`` and
``lengths(node, label, property, length)``. Tokenisation runs in Arrow batches;
scoring is joins and aggregates, with the query's few terms broadcast. English
words are stemmed; other languages use their stop words only. Null texts are
not indexed and rows without a node id are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scalars import METRICS
from graphloom.functions.stemmer import stem
from graphloom.functions.stop_words import STOP_WORDS
from graphloom.operators.durable import materialize
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.traversal import reach

#: Longer terms (in bytes) are not indexed.
MAX_TERM = 480
_WORD = re.compile(r"\w+(?:[.'’]\w+)*")
# Latin letters with diacritics and what they are folded to.
FOLD = (
    ("a", "ÀÁÂÃÄÅàáâãäå"), ("ae", "Ææ"), ("c", "Çç"), ("e", "ÈÉÊËèéêë"), ("i", "ÌÍÎÏìíîï"), ("d", "Ðð"), ("n", "Ññ"),
    ("o", "ÒÓÔÕÖØòóôõöø"), ("u", "ÙÚÛÜùúûü"), ("y", "Ýýÿ"), ("ss", "ß"), ("th", "Þþ"),
)
_FOLD = str.maketrans({c: base for base, chars in FOLD for c in chars})


def tokenize(text: str, language: str = "en") -> Counter:
    """Term frequencies of a text."""
    if language not in STOP_WORDS:
        raise ValueError(f"unknown language {language}")
    stops, terms = STOP_WORDS[language], Counter()
    for word in _WORD.findall(text.translate(_FOLD)):
        low = word.strip("_").lower()
        if low and low not in stops:
            term = stem(low) if language == "en" else low
            if len(term.encode()) <= MAX_TERM:
                terms[term] += 1
    return terms


@dataclass(frozen=True)
class TextIndex:
    label: str
    prop: str
    language: str
    postings: DataFrame
    lengths: DataFrame


def _indexer(language: str):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, term, tf = [], [], []
            for i, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist()):
                for t, n in tokenize(text, language).items():
                    node.append(i)
                    term.append(t)
                    tf.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(term, pa.string()), pa.array(tf, pa.int32())], names=["node", "term", "tf"])

    return index


def build_text_index(texts: DataFrame, label: str, prop: str, language: str = "en") -> TextIndex:
    """Index ``texts(node, text)``; both tables are written, so a search reads postings and tokenises nothing but its query."""
    rows = texts.where(F.col("node").isNotNull() & F.col("text").isNotNull()).select(F.col("node").cast("bigint"), F.col("text").cast("string"))
    postings = materialize(rows.mapInArrow(_indexer(language), "node bigint, term string, tf int"))
    return TextIndex(label, prop, language, postings, materialize(postings.groupBy("node").agg(F.sum("tf").alias("length"))))


def create_text_index(graph: PropertyGraph, label: str, prop: str, language: str = "en") -> PropertyGraph:
    df, types = graph.node_frame((label,))
    if prop not in types:
        texts = df.select(F.col("id").alias("node"), F.lit(None).cast("string").alias("text"))
    else:
        texts = df.select(F.col("id").alias("node"), F.col(f"p_{prop}").cast("string").alias("text"))
    known = dict(graph.extensions.get("text", {})) | {(label, prop): build_text_index(texts, label, prop, language)}
    return replace(graph, extensions=graph.extensions | {"text": known})


def drop_text_index(graph: PropertyGraph, label: str, prop: str) -> PropertyGraph:
    known = {k: x for k, x in graph.extensions.get("text", {}).items() if k != (label, prop)}
    return replace(graph, extensions=graph.extensions | {"text": known})


def text_indexes(graph: PropertyGraph) -> list[tuple[str, str, str]]:
    return [(x.label, x.prop, x.language) for x in graph.extensions.get("text", {}).values()]


# ---- scoring --------------------------------------------------------------------


@dataclass(frozen=True)
class Scorer:
    """`idf(documents, documents with the term)` and `score(tf, length, mean length, idf, tf in the query)`, on columns."""

    idf: Callable[[Column, Column], Column]
    score: Callable[[Column, Column, Column, Column, Column], Column]


def bm25(k1: float = 1.2, b: float = 0.75) -> Scorer:
    def score(tf: Column, length: Column, mean: Column, idf: Column, qtf: Column) -> Column:
        ratio = F.when(mean > 0, length / mean).otherwise(1.0)
        return qtf * idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * ratio))

    return Scorer(lambda n, df: F.log((n - df + 0.5) / (df + 0.5) + 1.0), score)


def tf_idf() -> Scorer:
    return Scorer(lambda n, df: F.greatest(F.log(n / (df + 1.0)), F.lit(0.0)), lambda tf, length, mean, idf, qtf: qtf * F.sqrt(tf) * idf)


def score_text(index: TextIndex, query: str, scorer: Scorer | None = None, every_term: bool = False) -> DataFrame:
    """``(node, score)`` of every document with a term (or, `every_term`, all terms) of the query."""
    spark = index.postings.sparkSession
    scorer = scorer or bm25()
    terms = tokenize(query, index.language)
    asked = spark.createDataFrame(list(terms.items()), "term string, qtf int") if terms else spark.createDataFrame([], "term string, qtf int")
    # As many rows as the query has terms.
    hits = index.postings.join(F.broadcast(asked), "term")
    stats = index.lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # At most one row per query term, and one row of totals.
    weights = F.broadcast(df.crossJoin(stats).select("term", scorer.idf(F.col("n"), F.col("df")).alias("idf"), "mean"))
    scored = hits.join(weights, "term").join(index.lengths, "node").select(
        "node", scorer.score(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("mean"), F.col("idf"), F.col("qtf").cast("double")).alias("part")
    )
    out = scored.groupBy("node").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("terms"))
    if every_term:
        out = out.where(F.col("terms") == len(terms))
    return out.select("node", "score")


def text_search(
    graph: PropertyGraph,
    query: str,
    limit: int = 10,
    label: str | None = None,
    prop: str | None = None,
    scorer: Scorer | None = None,
    every_term: bool = False,
) -> DataFrame:
    """``(node, score, label, property)``: scores add up over the indexes; the best-contributing index is named."""
    known = [x for x in graph.extensions.get("text", {}).values() if label in (None, x.label) and prop in (None, x.prop)]
    if not known:
        raise ValueError("there is no such text index")
    if not query.strip():
        raise ValueError("the text query is empty")
    parts = None
    for x in known:
        scored = score_text(x, query, scorer, every_term).select("node", "score", F.lit(x.label).alias("label"), F.lit(x.prop).alias("property"))
        parts = scored if parts is None else parts.unionByName(scored)
    best = F.max(F.struct("score", "label", "property"))
    out = parts.groupBy("node").agg(F.sum("score").alias("score"), best.alias("b")).select("node", "score", "b.label", "b.property")
    return out.orderBy(F.col("score").desc(), "node").limit(limit)


# ---- vectors ----------------------------------------------------------------------


def upsert_vectors(graph: PropertyGraph, vectors: DataFrame) -> PropertyGraph:
    """Add or replace embeddings ``(node_id, embedding)``: nodes must exist, components be finite and of one dimension."""
    new = vectors.select(F.col("node_id").cast("bigint").alias("node_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    if new.where(F.col("embedding").isNull() | ~finite).take(1):
        raise ValueError("an embedding has components that are not finite")
    if new.join(graph.ids().select(F.col("id").alias("node_id")), "node_id", "left_anti").take(1):
        raise ValueError("an embedding belongs to no node")
    kept = new if graph.vectors is None else graph.vectors.join(new, "node_id", "left_anti").unionByName(new)
    sizes = kept.select(F.size("embedding").alias("d")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("the embeddings differ in dimension")
    return replace(graph, vectors=kept)


def remove_vectors(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return graph if graph.vectors is None else replace(graph, vectors=graph.vectors.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti"))


def configure_vectors(graph: PropertyGraph, metric: str, reindex: bool = False) -> PropertyGraph:
    """Choose the metric (cosine, l2, dot); with vectors present this needs `reindex`."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if graph.vectors is not None and metric != graph.metric and not reindex:
        raise ValueError("the metric can only change with reindex=True once there are vectors")
    return replace(graph, metric=metric)


def vector_search(graph: PropertyGraph, query: Sequence[float], k: int = 10, label: str | None = None, equal: dict | None = None) -> DataFrame:
    """``(node, distance)``: the k nearest embeddings; ties by node; filters by label and equal properties."""
    if graph.vectors is None or not graph.vectors.take(1):
        raise ValueError("there are no vectors")
    rows = graph.vectors
    if label or equal:
        df, types = graph.node_frame((label,) if label else ())
        for name, value in (equal or {}).items():
            df = df.where(F.col(f"p_{name}") == F.lit(value) if name in types else F.lit(False))
        rows = rows.join(df.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col("node_id").alias("node"), METRICS[graph.metric](F.col("embedding").cast("array<double>"), q).alias("distance"))
    return scored.where(F.col("distance").isNotNull()).orderBy("distance", "node").limit(k)


# ---- retrieval ----------------------------------------------------------------------


@dataclass(frozen=True)
class Subgraph:
    #: ``(node, score)``; nodes reached by expansion only have a null score
    nodes: DataFrame
    #: ``(id, src, dst, type)`` of the relationships between these nodes
    edges: DataFrame
    truncated: bool


def _around(graph: PropertyGraph, seeds: DataFrame, hops: int, most: int | None) -> Subgraph:
    seeds = materialize(seeds)
    found, truncated = reach(graph, seeds.select(F.col("node").alias("id")), hops, most)
    nodes = found.select(F.col("id").alias("node")).join(seeds, "node", "left")
    edges = graph.edge_frame()[0].select("id", "src", "dst", "type")
    for end in ("src", "dst"):
        edges = edges.join(found.select(F.col("id").alias(end)), end, "left_semi")
    return Subgraph(nodes, edges, truncated)


def retrieve(graph: PropertyGraph, query: Sequence[float], k: int = 10, hops: int = 2, max_distance: float = math.inf, max_nodes: int | None = None) -> Subgraph:
    """Vector hits up to a distance, and everything within `hops` of them."""
    hits = vector_search(graph, query, k).where(F.col("distance") <= max_distance)
    return _around(graph, hits.select("node", F.col("distance").alias("score")), hops, max_nodes)


def fuse(vector: DataFrame, text: DataFrame, vector_k: int, text_k: int, strategy: str = "rrf", k: float = 60.0, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """``(node, score)`` from two hit lists: reciprocal ranks, or a weighted sum of (K - rank) / K, ranks from 0."""
    # The lists are as short as the numbers of hits asked for.
    ranked = lambda df, *order: df.select("node", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))
    lists = ((ranked(vector, "distance", "node"), vector_k, weights[0]), (ranked(text, F.col("score").desc(), "node"), text_k, weights[1]))
    parts = None
    for rows, size, weight in lists:
        if strategy == "rrf":
            part = 1.0 / (F.lit(float(k)) + F.col("rank") + 1.0)
        elif strategy == "weighted":
            part = F.lit(float(weight)) * (F.lit(float(size)) - F.col("rank")) / F.lit(float(size))
        else:
            raise ValueError(f"unknown fusion {strategy}")
        own = rows.select("node", part.alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("node").agg(F.sum("part").alias("score"))


def retrieve_hybrid(
    graph: PropertyGraph,
    vector: Sequence[float],
    text: str,
    vector_k: int = 10,
    text_k: int = 10,
    hops: int = 2,
    max_distance: float = math.inf,
    max_nodes: int | None = None,
    text_label: str | None = None,
    text_property: str | None = None,
    vector_label: str | None = None,
    strategy: str = "rrf",
    k: float = 60.0,
    weights: tuple[float, float] = (0.5, 0.5),
) -> Subgraph:
    """Fused vector and text hits, and everything within `hops` of them; the seeds that fit the cap come first."""
    near = vector_search(graph, vector, vector_k, vector_label).where(F.col("distance") <= max_distance)
    words = text_search(graph, text, text_k, text_label, text_property)
    seeds = fuse(near, words, vector_k, text_k, strategy, k, weights)
    truncated = False
    if max_nodes is not None:
        truncated = len(seeds.limit(max_nodes + 1).collect()) > max_nodes
        seeds = seeds.orderBy(F.col("score").desc(), "node").limit(max_nodes)
    found = _around(graph, seeds, hops, max_nodes)
    return replace(found, truncated=found.truncated or truncated)
