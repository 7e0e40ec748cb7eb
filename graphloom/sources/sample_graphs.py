"""Graphs over the test tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.sources.tables import table


def _renamed(df: DataFrame, key: str, base: int, prefix: str, names: list[str]) -> DataFrame:
    return df.select((F.col(key).cast("bigint") + base).alias("id"), *[F.col(prefix + n).alias(n) for n in names])


@lru_cache(maxsize=8)
def commerce_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The star schema as a graph. Relationships without a key of their own are identified by a hash of the row."""
    t = lambda n: table(spark, folder, n)
    nation, orders, items, customers, suppliers = t("nation"), t("orders"), t("lineitem"), t("customer"), t("supplier")
    link = lambda df, key, src, dst, *props: df.select(key.cast("bigint").alias("id"), src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), *props)
    c = F.col
    graph = (
        PropertyGraph(spark)
        .with_nodes(_renamed(t("region"), "r_regionkey", 0, "r_", ["name"]), "Region")
        .with_nodes(_renamed(nation, "n_nationkey", 1_000, "n_", ["name"]), "Nation")
        .with_nodes(_renamed(suppliers, "s_suppkey", 10_000_000, "s_", ["name", "acctbal"]), "Supplier")
        .with_nodes(_renamed(customers, "c_custkey", 20_000_000, "c_", ["name", "acctbal", "mktsegment"]), "Customer")
        .with_nodes(_renamed(t("part"), "p_partkey", 30_000_000, "p_", ["name", "brand", "type", "size", "retailprice"]), "Part")
        .with_nodes(
            orders.select(
                (c("o_orderkey") + 40_000_000).alias("id"),
                c("o_orderstatus").alias("status"),
                c("o_totalprice").alias("totalprice"),
                c("o_orderdate").alias("orderdate"),
                c("o_orderpriority").alias("priority"),
            ),
            "Order",
        )
        .with_edges(link(nation, c("n_nationkey"), c("n_nationkey") + 1_000, c("n_regionkey")), "IN_REGION", "Nation", "Region")
        .with_edges(link(customers, c("c_custkey"), c("c_custkey") + 20_000_000, c("c_nationkey") + 1_000), "FROM_NATION", "Customer", "Nation")
        .with_edges(link(suppliers, c("s_suppkey") + 5_000_000_000, c("s_suppkey") + 10_000_000, c("s_nationkey") + 1_000), "FROM_NATION", "Supplier", "Nation")
        .with_edges(link(orders, c("o_orderkey"), c("o_custkey") + 20_000_000, c("o_orderkey") + 40_000_000), "PLACED", "Customer", "Order")
        .with_edges(
            link(
                items,
                F.xxhash64(*[c(x) for x in items.columns]),
                c("l_orderkey") + 40_000_000,
                c("l_partkey") + 30_000_000,
                c("l_quantity").alias("quantity"),
                c("l_extendedprice").alias("price"),
                c("l_discount").alias("discount"),
                c("l_returnflag").alias("returnflag"),
                c("l_shipdate").alias("shipdate"),
            ),
            "CONTAINS",
            "Order",
            "Part",
        )
        .with_edges(
            link(items.select("l_partkey", "l_suppkey").distinct(), F.xxhash64("l_partkey", "l_suppkey"), c("l_partkey") + 30_000_000, c("l_suppkey") + 10_000_000),
            "SUPPLIED_BY",
            "Part",
            "Supplier",
        )
    )
    documents = t("documents").select((c("doc_id") + 60_000_000).alias("id"), "text", "lang", "source")
    graph = graph.with_nodes(documents, "Document").with_vectors(
        t("embeddings").select((c("vec_id") + 60_000_000).alias("node_id"), c("embedding").cast("array<float>").alias("embedding"))
    )
    # Customers of consecutive orders know each other. Order keys are dense, so the next one is found by a join, not a global window.
    following = orders.select((c("o_orderkey") - 1).alias("o_orderkey"), c("o_custkey").alias("next_cust"))
    knows = orders.join(following, "o_orderkey").select(
        c("o_orderkey").alias("id"), (c("o_custkey") + 20_000_000).alias("src"), (c("next_cust") + 20_000_000).alias("dst"), c("o_totalprice").alias("weight")
    )
    return graph.with_edges(knows, "KNOWS", "Customer", "Customer")


@lru_cache(maxsize=8)
def social_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph tables: the newest row of each node and edge; edges without both ends are no relationships."""
    nodes = (
        table(spark, folder, "nodes")
        .where(F.col("node_id").isNotNull())
        .groupBy("node_id")
        .agg(F.max(F.struct("loaded_at", "created_at", "name", "age", "city", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))).alias("n"))
        .select(F.col("node_id").alias("id"), "n.labels", "n.name", "n.age", "n.city")
    )
    shared = table(spark, folder, "shared_nodes").select(F.col("node_id").alias("id"), F.array("label").alias("labels"), "name")
    edges = table(spark, folder, "edges")
    weights = edges.where(F.col("edge_id").isNotNull()).groupBy("edge_id").agg(
        F.max(F.struct("loaded_at", "src", "dst", "edge_type", "weight")).alias("e")
    )
    rows = weights.select(F.col("edge_id").alias("id"), "e.src", "e.dst", F.col("e.edge_type").alias("type"), "e.weight")
    rows = rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("type").isNotNull())
    return PropertyGraph(spark).with_nodes(nodes).with_nodes(shared).with_edges(rows)
