"""One object over a stored index: the questions of a user, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import doctor, graph, reports, search
from .operators.rules import Context
from .plans import policy
from .sources import snapshots


class Traceability:
    """Nodes and edges (and evidence, where there is some) of one index."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, **evidence: DataFrame):
        self.nodes, self.edges, self.evidence, self.index = nodes, edges, evidence, None

    @classmethod
    def read(cls, spark: SparkSession, root: str, *evidence: str) -> Traceability:
        names = ("nodes", "edges", *evidence)
        tables = dict(zip(names, snapshots.read(spark, root, *names), strict=True))
        own = cls(**tables)
        own.index = search.StoredIndex(spark, f"{root}/search", ["trace_id"])
        return own

    def write(self, root: str, version: str) -> None:
        """Publishes all tables as one version, and the nodes' words to the stored search index."""
        spark = self.nodes.sparkSession
        snapshots.publish({"nodes": self.nodes, "edges": self.edges, **self.evidence}, root, snapshots.current(spark, root)[0], version)
        docs = self._documents()
        index = search.StoredIndex(spark, f"{root}/search", [c for c in docs.columns if c != "id"])
        index.update(docs, index.documents().select("id").join(docs, "id", "left_anti") if snapshots.current(spark, index.root)[0] else None)

    def _documents(self) -> DataFrame:
        columns = [c for c in ("trace_id", "title", "path") if c in self.nodes.columns]
        return self.nodes.select(F.col("trace_id").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in columns])

    def of(self, *trace_ids: str) -> DataFrame:
        return self.nodes.filter(F.col("trace_id").isin(*trace_ids))

    def verify(self, profile: str, **how) -> DataFrame:
        return policy.evaluate(Context(self.nodes, self.edges, **self.evidence, **how), profile)

    def why(self, *trace_ids: str, **how) -> DataFrame:
        return graph.why_paths(self.of(*trace_ids), self.nodes, self.edges, **how)

    def impact(self, *trace_ids: str, **how) -> DataFrame:
        return graph.impact(self.of(*trace_ids), self.nodes, self.edges, **how)

    def context(self, *trace_ids: str) -> DataFrame:
        return reports.context(self.of(*trace_ids), self.nodes, self.edges)

    def search(self, query: str, k: int = 20) -> DataFrame:
        """Ids by rank; through the stored index where the tables were read from a stored version."""
        if self.index is not None:
            asked = self.nodes.sparkSession.createDataFrame([("", query)], "query string, text string")
            return self.index.found(asked, k).orderBy("rank").select("id")
        docs = self._documents()
        return search.search(docs, [c for c in docs.columns if c != "id"], query, k)

    def examine(self, declarations: DataFrame, **more) -> DataFrame:
        return doctor.examined(self.nodes, self.edges, declarations, **more)
