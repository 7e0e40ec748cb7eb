from __future__ import annotations

from graphloom.streaming.ingest import append_edges


def test_repeats_are_dropped(spark, tmp_path):
    ddl = "edge_id bigint, src bigint, dst bigint, loaded_at timestamp_ntz"
    at = lambda h: f"timestamp_ntz'2030-01-01 {h:02}:00:00'"
    rows = [(1, 5, 6, at(1)), (1, 5, 6, at(2)), (2, 5, 7, at(1)), ("null", 5, 7, at(1)), (3, 5, 7, "null")]
    values = ", ".join(f"({e}, {a}, {b}, {t})" for e, a, b, t in rows)
    spark.sql(f"SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, loaded_at FROM VALUES {values} t(edge_id, src, dst, loaded_at)").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        append_edges(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = sorted((r.edge_id, r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 5, 6), (2, 5, 7)]
