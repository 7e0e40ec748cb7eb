from __future__ import annotations

import math
from collections import Counter

import pytest

from graphloom.functions.stemmer import stem
from graphloom.operators import search
from graphloom.operators.graph import PropertyGraph

TEXTS = {
    1: "Running edges of the graph", 2: "The edge runs into a node", 3: "Graphs and graphs of labels", 4: None, 5: "", 6: "Café labels, über nodes", 7: "the of and",
}


@pytest.fixture(scope="module")
def graph(spark):
    notes = spark.createDataFrame([(n, t, f"t{n}") for n, t in TEXTS.items()], "id bigint, text string, title string")
    links = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 6, 7), (4, 3, 1)], "id bigint, src bigint, dst bigint")
    out = PropertyGraph(spark).with_nodes(notes, "Note").with_edges(links, "NEXT")
    out = search.create_text_index(search.create_text_index(out, "Note", "text"), "Note", "title")
    vectors = spark.createDataFrame([(n, [float(n), 1.0]) for n in (1, 2, 3, 6)] + [(7, [0.0, 0.0])], "node_id bigint, embedding array<double>")
    return search.upsert_vectors(out, vectors)


@pytest.mark.parametrize(
    ("word", "root"),
    [("running", "run"), ("hopped", "hop"), ("hoping", "hope"), ("skies", "sky"), ("ties", "tie"), ("cries", "cri"), ("generously", "generous"), ("happiness", "happi"),
     ("national", "nation"), ("relational", "relat"), ("conditional", "condit"), ("agreed", "agre"), ("knightly", "knight"), ("consist", "consist"), ("consistency", "consist"),
     ("communities", "communiti"), ("news", "news"), ("dying", "die"), ("by", "by"), ("sensational", "sensat"), ("controlled", "control"), ("falling", "fall"), ("adoption", "adopt")],
)
def test_stems(word, root):
    assert stem(word) == root


def test_tokens():
    assert search.tokenize("Café CAFE the über-node's") == Counter({"cafe": 2, "uber": 1, "node": 1})
    assert search.tokenize("Die Größe der Knoten", "de") == Counter({"grosse": 1, "knoten": 1})
    assert search.tokenize("x" * 481) == Counter()
    with pytest.raises(ValueError, match="language"):
        search.tokenize("a", "xx")


def brute(query, score):
    docs = {n: search.tokenize(t) for n, t in TEXTS.items() if t is not None and search.tokenize(t)}
    mean = sum(sum(d.values()) for d in docs.values()) / len(docs)
    out = {}
    for term, q in search.tokenize(query).items():
        df = sum(term in d for d in docs.values())
        for n, d in docs.items():
            if term in d:
                out[n] = out.get(n, 0) + score(d[term], sum(d.values()), mean, len(docs), df, q)
    return out


def test_scores(graph):
    def bm25(tf, length, mean, n, df, q):
        return q * math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))

    def tfidf(tf, length, mean, n, df, q):
        return q * math.sqrt(tf) * max(0.0, math.log(n / (df + 1)))

    query = "graph edges edges"
    for scorer, by_hand in ((None, bm25), (search.tf_idf(), tfidf)):
        got = {r.node: r.score for r in search.text_search(graph, query, prop="text", scorer=scorer).collect()}
        assert got == pytest.approx(brute(query, by_hand))
    every = search.text_search(graph, "graph edges", prop="text", every_term=True).collect()
    assert [r.node for r in every] == [1]
    assert search.text_search(graph, "t3").first()["property"] == "title"
    assert search.text_search(graph, "zebra").count() == 0
    for bad in (lambda: search.text_search(graph, " "), lambda: search.text_search(graph, "x", label="Other")):
        with pytest.raises(ValueError, match="text"):
            bad()


def test_vectors(spark, graph):
    got = [(r.node, round(r.distance, 6)) for r in search.vector_search(graph, [1.0, 1.0], 3).collect()]
    cos = lambda n: 1 - (n + 1) / (math.sqrt(2) * math.hypot(n, 1))
    assert got == [(1, 0.0), (2, round(cos(2), 6)), (3, round(cos(3), 6))]
    assert search.vector_search(graph, [1.0, 1.0], 9).collect()[-1]["distance"] == 1.0  # the zero vector
    assert [r.node for r in search.vector_search(graph, [1.0, 1.0], 9, "Note", {"title": "t6"}).collect()] == [6]
    squared = search.configure_vectors(graph, "l2", reindex=True)
    assert [r.distance for r in search.vector_search(squared, [0.0, 1.0], 2).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError, match="reindex"):
        search.configure_vectors(graph, "dot")
    for bad in ([(1, [float("nan"), 0.0])], [(99, [1.0, 0.0])], [(1, [1.0])]):
        with pytest.raises(ValueError):
            search.upsert_vectors(graph, spark.createDataFrame(bad, "node_id bigint, embedding array<double>"))
    less = search.remove_vectors(graph, spark.createDataFrame([(1,)], "id bigint"))
    assert search.vector_search(less, [1.0, 1.0], 1).first()["node"] == 2
    with pytest.raises(ValueError, match="no vectors"):
        search.vector_search(PropertyGraph(spark), [1.0])


def test_retrieval(graph):
    found = search.retrieve(graph, [6.0, 1.0], 1, hops=1)
    assert sorted((r.node, r.score) for r in found.nodes.collect() if r.score is not None) == [(6, 0.0)]
    assert {r.node for r in found.nodes.collect()} == {6, 7} and [r.id for r in found.edges.collect()] == [3] and not found.truncated
    assert search.retrieve(graph, [-1.0, 0.0], 5, max_distance=0.1).nodes.count() == 0
    mixed = search.retrieve_hybrid(graph, [1.0, 1.0], "labels", vector_k=2, text_k=2, hops=0)
    scores = {r.node: r.score for r in mixed.nodes.collect()}
    words = [r.node for r in search.text_search(graph, "labels", 2).collect()]
    want = Counter({1: 1 / 61, 2: 1 / 62})
    want.update({n: 1 / (61 + i) for i, n in enumerate(words)})
    assert scores == pytest.approx(dict(want))
    weighted = search.retrieve_hybrid(graph, [1.0, 1.0], "labels", 2, 2, hops=0, strategy="weighted", weights=(1.0, 0.5))
    got = {r.node: r.score for r in weighted.nodes.collect()}
    assert got[1] == pytest.approx(1.0 + (0.5 if words[0] == 1 else 0)) and got[2] == pytest.approx(0.5)
    capped = search.retrieve_hybrid(graph, [1.0, 1.0], "labels", hops=2, max_nodes=1)
    assert capped.nodes.count() == 1 and capped.truncated


def test_procedures(graph):
    rows = graph.query("CALL x.retrieve.vector([6.0, 1.0], {k: 1, hops: 1}) YIELD nodeId, distance MATCH (n) WHERE id(n) = nodeId RETURN n.title AS t, distance AS d ORDER BY t").collect()
    assert [(r.t, r.d) for r in rows] == [("t6", 0.0), ("t7", None)]
    assert graph.query("CALL retrieve.hybrid([1.0, 1.0], 'labels', {hops: 0, fusion: {vectorWeight: 1, textWeight: 0}}) YIELD nodeId, score RETURN count(*) AS n").first()["n"] > 2
    got = graph.query("MATCH (n:Note) WHERE n.title = 't1' RETURN vector_dist([1, 0], [0, 1]) AS d").first()["d"]
    assert got == 1.0
