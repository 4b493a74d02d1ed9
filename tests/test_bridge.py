"""Views that are grouped by whole numbers against their texts, on rows without keys and rows that come again."""

import random

import pytest
from pyspark.sql import functions as F

from linkgrain.operators import change, graph, reports
from linkgrain.sources.bridge import TABLES, VIEWS, Bridge

SCHEMAS = {
    "region": "r_regionkey int", "nation": "n_nationkey int, n_regionkey int", "customer": "c_custkey long, c_nationkey int", "supplier": "s_suppkey long, s_nationkey int", "part": "p_partkey long",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string", "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string",
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of few keys, negative ones and nulls, so that rows meet in every way."""
    rng, out = random.Random(5), tmp_path_factory.mktemp("odd")
    for table, schema in SCHEMAS.items():
        kinds = [c.split()[1] for c in schema.split(", ")]
        words = ("F", "P", "R", "O", None)
        rows = [tuple(rng.choice(words) if k == "string" else rng.choice((None, -2, -1, *range(1, 13), 20, 100)) for k in kinds) for _ in range(400)]
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/{table}.parquet")
    return str(out)


def rows(df, columns):
    return sorted(df.select(*columns).collect(), key=str)


def test_views_by_whole_numbers(spark, odd):
    b = Bridge(spark, odd)
    nodes = spark.sql(VIEWS["nodes"], decl=b.decl)
    got = rows(b.nodes, nodes.columns)
    assert got == rows(nodes, nodes.columns) and any(r.n > 1 for r in got) and any(r.trace_id is None for r in got)
    links = spark.sql(VIEWS["links"], **{t: getattr(b, t) for t in TABLES if "{" + t + "}" in VIEWS["links"]})
    assert rows(b.links, links.columns) == rows(links, links.columns)
    assert b.nodes.schema.simpleString() == nodes.schema.simpleString() and b.links.schema.simpleString() == links.schema.simpleString()


def test_nodes_of_a_kind_read_its_tables(spark, odd):
    plan = Bridge(spark, odd).nodes.filter("node_type = 'supplier' or node_type = 'plan'")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(p_partkey" in plan and "isnotnull(l_orderkey" not in plan


def test_a_full_walk_ends(spark, monkeypatch):
    nodes = spark.range(40).select(F.col("id").cast("string").alias("trace_id"))
    edges = spark.range(39).select(F.col("id").cast("string").alias("f"), F.lit("p").alias("p"), (F.col("id") + 1).cast("string").alias("t"))
    made = []
    monkeypatch.setattr(graph, "kept", lambda df, name, kept=graph.kept: made.append(name) or kept(df, name))
    got = graph.walk(nodes.filter("trace_id = '0'"), nodes, edges, depth=30, max_nodes=4)
    assert sorted(map(tuple, got.collect())) == [(str(n), n) for n in range(4)]
    assert len(made) == 4


def test_few_starts_and_paths_go_to_the_rows(spark, tmp_path):
    spark.range(2000).select(F.concat(F.lit("n"), "id").alias("trace_id"), F.lit("work").alias("node_type"), F.lit("current").alias("status"), F.concat(F.lit("p"), F.col("id") % 3).alias("path"), F.lit(True).alias("active")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    edges = nodes.select(F.col("trace_id").alias("f"), F.lit("p").alias("p"), F.lit("n1").alias("t"))
    starts = nodes.groupBy("trace_id").agg(F.max("path").alias("path")).filter("trace_id in ('n1', 'n2')")
    around = reports.context(starts, nodes, edges)
    assert around._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") >= 2
    assert around.count() == 2 + 2000
    paths = spark.createDataFrame([("p1",), ("p1",), (None,)], "path string")
    own = nodes.unionByName(nodes.limit(1).withColumn("trace_id", F.lit("none")).withColumn("path", F.lit(None).cast("string")))
    merged = change.merged_index(own, nodes.filter("trace_id = 'n4'"), paths.join(paths.select("path"), "path", "left"))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti, (path" not in plan and merged.count() == 2001
    assert {r.trace_id for r in merged.filter("active").collect()} == {"none", "n4", *(f"n{n}" for n in range(2000) if n % 3 != 1)}
